"""Command line: what is done follows from the input's extension and the flags.

    python -m bitloom.cli data.csv                      compress a table to data.tgd
    python -m bitloom.cli photo.png                     compress an image to photo.igd
    python -m bitloom.cli data.tgd --rows 0,5,10-20     decode rows to data.csv
    python -m bitloom.cli photo.igd --crop 0,0,9,9      decode a part to photo.png
    python -m bitloom.cli data.tgd --analytics          weighted samples, no row is decoded
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from bitloom.errors import BitloomError
from bitloom.operators.distinct import ExactCounter, HyperLogLogCounter
from bitloom.operators.ingest import load_csv
from bitloom.operators.normalize import Options
from bitloom.plans.compress import Plan, compress
from bitloom.sources import containers, store
from bitloom.timing import init_logging

IMAGES, CONTAINERS = ("png", "jpg", "jpeg", "bmp", "gif"), ("tgd", "igd", "egd")


def parse_ranges(text: str) -> list[tuple[int, int]]:
    """Inclusive ranges of a list like ``0,5,10-20``."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        a, dash, b = part.partition("-")
        try:
            low, high = int(a), int(b) if dash else int(a)
        except ValueError:
            raise ValueError(f"{part!r} is neither a row nor a range") from None
        if low > high:
            raise ValueError(f"the range {part!r} ends before it starts")
        out.append((low, high))
    if not out:
        raise ValueError("no rows are named")
    return out


def parse_rows(text: str) -> list[int]:
    """Row numbers of a list like ``0,5,10-20``, ascending, each once."""
    return sorted({i for a, b in parse_ranges(text) for i in range(a, b + 1)})


def parse_grouping(text: str) -> tuple[int, int]:
    """Width and height of ``3x3``."""
    parts = text.split("x")
    if len(parts) != 2 or not all(p.isdigit() and int(p) for p in parts):
        raise ValueError(f"{text!r} is no grouping like 3x3")
    return int(parts[0]), int(parts[1])


def parse_crop(text: str) -> tuple[int, int, int, int]:
    """Corners of ``x1,y1,x2,y2``, both inclusive."""
    parts = [p.strip() for p in text.split(",")]
    if len(parts) != 4 or not all(p.isdigit() for p in parts):
        raise ValueError(f"{text!r} is no crop like x1,y1,x2,y2")
    x1, y1, x2, y2 = map(int, parts)
    if x1 > x2 or y1 > y2:
        raise ValueError(f"the crop {text!r} ends before it starts")
    return x1, y1, x2, y2


def one_of(*choices: str):
    """A parser of a choice in any case."""

    def parse(text: str) -> str:
        if text.lower() not in choices:
            raise ValueError(f"{text!r} is none of {', '.join(choices)}")
        return text.lower()

    return parse


def derive_output(path: str, extension: str) -> str:
    """The input's path with another extension."""
    folder, slash, name = path.rpartition("/")
    return f"{folder}{slash}{name.rsplit('.', 1)[0] if '.' in name else name}.{extension}"


def format_size(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024 or unit == "GB":
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.2f} {unit}"
        n /= 1024
    raise AssertionError


def format_duration(s: float) -> str:
    return f"{s * 1e3:.1f} ms" if s < 1 else f"{s:.2f} s" if s < 60 else f"{int(s // 60)} m {s % 60:.0f} s"


def arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="bitloom", description="Compress, decode and analyse tables and images.")
    p.add_argument("input")
    p.add_argument("-o", "--output")
    p.add_argument("--analytics", action="store_true", help="weighted samples of a compressed table")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("--pixel-grouping", type=parse_grouping, default=(3, 3))
    p.add_argument("--float-scaling", type=one_of("on", "off"), default="on")
    p.add_argument("--float-precision", type=int, default=9)
    p.add_argument("--rows", type=parse_rows)
    p.add_argument("--base-counting", type=one_of("precise", "approximate"), default="precise")
    p.add_argument("--encoding", type=one_of("normal", "rle", "huffman"))
    p.add_argument("--base-compression", type=one_of("on", "off"))
    p.add_argument("--crop", type=parse_crop)
    return p.parse_args(argv)


def action_of(a: argparse.Namespace) -> str:
    """What the arguments ask for; contradictions are errors."""
    suffix = a.input.rsplit(".", 1)[-1].lower()
    if a.analytics:
        if suffix not in CONTAINERS:
            raise ValueError("--analytics needs a compressed file")
        return "show_analytics"
    if suffix == "csv":
        found = "compress_tabular"
    elif suffix in IMAGES:
        found = "compress_image"
    elif suffix in ("tgd", "egd"):
        found = "decompress_tabular"
    elif suffix == "igd":
        found = "decompress_image"
    else:
        raise ValueError(f"what to do with {a.input} isn't known")
    if a.rows and found != "decompress_tabular":
        raise ValueError("--rows needs a compressed table")
    if a.crop and found != "decompress_image":
        raise ValueError("--crop needs a compressed image")
    return found


def _plan(a: argparse.Namespace, image: bool) -> Plan:
    encoding = a.encoding or ("huffman" if image else "normal")
    delta = (a.base_compression or ("on" if image else "off")) == "on"
    counter = HyperLogLogCounter() if a.base_counting == "approximate" else ExactCounter()
    options = Options(floats="scaled_offset" if a.float_scaling == "on" else "raw", decimals=a.float_precision)
    shared = {"options": options, "counter": counter, "encoding": "flat" if encoding == "normal" else encoding, "delta": "fixed" if delta else None}
    return Plan(decay=0.45, patience=5, m_max=None, **shared) if image else Plan(append_condensed=True, **shared)


def compress_tabular(spark: SparkSession, a: argparse.Namespace) -> str:
    output = store.coerce_extension(a.output or derive_output(a.input, "tgd"), "tgd")
    c = compress(load_csv(spark, a.input), "row_idx", plan=_plan(a, False))
    size = containers.save(c, output)
    return f"{output}: {c.info.n} rows, {c.n_bases} bases, {format_size(size)}"


def compress_image(spark: SparkSession, a: argparse.Namespace) -> str:
    from bitloom.sources import images

    output = store.coerce_extension(a.output or derive_output(a.input, "igd"), "igd")
    c, info = images.compress_image(spark, a.input, a.pixel_grouping, plan=_plan(a, True))
    size = containers.save(c, output, info)
    return f"{output}: {info.width} x {info.height} pixels, {c.n_bases} bases, {format_size(size)}"


def decompress_tabular(spark: SparkSession, a: argparse.Namespace) -> str:
    output = store.coerce_extension(a.output or derive_output(a.input, "csv"), "csv")
    c = containers.load(spark, a.input)
    found = c.rows_at(a.rows) if a.rows else c.decompress().orderBy("row_idx")
    store.write_csv(found.drop("row_idx"), output, True)
    return output


def decompress_image(spark: SparkSession, a: argparse.Namespace) -> str:
    from bitloom.sources import images

    output = a.output or derive_output(a.input, "png")
    if output.rsplit(".", 1)[-1].lower() not in images.FORMATS:
        output = store.coerce_extension(output, "png")
    d = containers.read_igd(containers.read_file(spark, a.input))
    x1, y1, x2, y2 = a.crop or (0, 0, d.image.width - 1, d.image.height - 1)
    pixels = images.decompress_image(containers.to_compressed(spark, d), d.image, a.crop)
    images.write_image(pixels, output, x2 - x1 + 1, y2 - y1 + 1, d.image.channels)
    return output


def show_analytics(spark: SparkSession, a: argparse.Namespace) -> str:
    output = store.coerce_extension(a.output or derive_output(a.input, "csv"), "csv")
    c = containers.load(spark, a.input)
    found = c.analytics()
    found.orderBy("weight", ascending=False).show(20, False)
    store.write_csv(found, output, True)
    return output


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments(argv)
    if a.verbose:
        init_logging("DEBUG")
    began = time.perf_counter()
    try:
        said = globals()[action_of(a)](spark or SparkSession.builder.appName("bitloom").getOrCreate(), a)
    except (BitloomError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    print(f"{said} ({format_duration(time.perf_counter() - began)})")
    return 0


if __name__ == "__main__":
    sys.exit(main())
