"""Image files to pixel frames and back.

PNG, JPEG, BMP and GIF are decoded by Spark's image source, in parallel; only RGB and RGBA
of 8 bits are taken.  PNG and PPM files are written here, JPEG, BMP, GIF and TIFF files by the
codecs of the Java runtime, which take no alpha channel for JPEG and BMP.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from bitloom.errors import ImageError
from bitloom.operators.images import COLOR_MODELS, ImageInfo, crop_pixels, group_pixels, ungroup_pixels
from bitloom.plans.compress import Compressed, Plan, compress_normalized
from bitloom.operators.ordered import settle

EXTENSIONS = "*.{png,PNG,jpg,JPG,jpeg,JPEG,bmp,BMP,gif,GIF}"
#: Extensions that images are written with, and what the Java runtime calls their formats.
FORMATS = {"png": None, "ppm": None, "jpg": "jpg", "jpeg": "jpg", "bmp": "bmp", "gif": "gif", "tif": "tiff", "tiff": "tiff"}
#: Largest image that is put together in one task.
MAX_PIXELS = 1 << 28


def open_images(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height, channels and data (BGR rows) of the image files in or at ``path``."""
    found = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).option("pathGlobFilter", EXTENSIONS).load(path)
    return found.select(F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def header(images: DataFrame) -> ImageInfo:
    """Size and channels of a frame with one image."""
    rows = images.select("width", "height", "channels").head(2)
    if len(rows) != 1:
        raise ImageError(f"{'no' if not rows else 'more than one'} image")
    return ImageInfo(rows[0]["width"], rows[0]["height"], rows[0]["channels"])


def to_pixels(images: DataFrame) -> DataFrame:
    """A pixel frame of the images: image, x, y, r, g, b, a (255 without an alpha channel)."""

    def rows(batches):
        for batch in batches:
            for path, width, height, channels, data in zip(*(batch.column(c).to_pylist() for c in ("path", "width", "height", "channels", "data")), strict=True):
                if channels not in (3, 4):
                    raise ImageError(f"{path} has {channels} channels; only RGB and RGBA are supported")
                cells = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
                for top in range(0, height, 256):
                    part = cells[top : top + 256].reshape(-1, channels).astype(np.int32)
                    at = np.arange(len(part))
                    alpha = part[:, 3] if channels == 4 else np.full(len(part), 255, dtype=np.int32)
                    columns = [pa.array([path] * len(part)), *(pa.array(v.astype(np.int32)) for v in (at % width, at // width + top, part[:, 2], part[:, 1], part[:, 0], alpha))]
                    yield pa.RecordBatch.from_arrays(columns, names=["image", "x", "y", "r", "g", "b", "a"])

    return images.mapInArrow(rows, "image string, x int, y int, r int, g int, b int, a int")


def png_bytes(cells: np.ndarray) -> bytes:
    """A PNG file of an array (height, width, 3 or 4) of bytes."""
    height, width, channels = cells.shape
    if channels not in (3, 4):
        raise ImageError(f"{channels} channels can't be written")

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = np.concatenate([np.zeros((height, 1), dtype=np.uint8), cells.reshape(height, -1)], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if channels == 3 else 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def ppm_bytes(cells: np.ndarray) -> bytes:
    """A binary PPM file of an array (height, width, 3) of bytes."""
    height, width, channels = cells.shape
    if channels != 3:
        raise ImageError(f"{channels} channels can't be written as PPM")
    return f"P6\n{width} {height}\n255\n".encode() + cells.tobytes()


def format_of(path: str) -> str:
    """The extension of an image file, in lower case."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix not in FORMATS:
        raise ImageError(f"images can't be written as {path}")
    return suffix


def image_bytes(spark: SparkSession, cells: np.ndarray, suffix: str) -> bytes:
    """An image file of the kind that an extension names."""
    if suffix == "ppm":
        return ppm_bytes(cells)
    png = png_bytes(cells)
    if not (format_name := FORMATS[suffix]):
        return png
    io, streams = spark._jvm.javax.imageio.ImageIO, spark._jvm.java.io
    out = streams.ByteArrayOutputStream()
    if not io.write(io.read(streams.ByteArrayInputStream(bytearray(png))), format_name, out):
        raise ImageError(f"{cells.shape[2]} channels can't be written as {suffix}")
    return bytes(out.toByteArray())


def write_image(pixels: DataFrame, path: str, width: int, height: int, channels: int = 3) -> None:
    """One image's pixels as a file of the kind that the path's extension names."""
    from bitloom.sources.containers import write_file

    suffix = format_of(path)
    if width * height > MAX_PIXELS:
        raise ImageError(f"{width} x {height} pixels are too many for one file")
    names = ["r", "g", "b", "a"][:channels]
    frame = pixels.select("x", "y", *names).toPandas()
    if len(frame) != width * height:
        raise ImageError(f"{len(frame)} pixels of {width * height}")
    cells = np.zeros((height, width, channels), dtype=np.uint8)
    for i, n in enumerate(names):
        cells[frame["y"], frame["x"], i] = frame[n]
    write_file(pixels.sparkSession, path, image_bytes(pixels.sparkSession, cells, suffix))


def compress_image(spark: SparkSession, path: str, group: tuple[int, int] = (3, 3), grouping: str = "for_first", color_model: str = "ycocg_r", plan: Plan | None = None) -> tuple[Compressed, ImageInfo]:
    """Compress an image file; a block of rows is a row of pixel groups."""
    found = open_images(spark, path)
    head = header(found)
    if color_model not in COLOR_MODELS:
        raise ImageError(f"no colour model is called {color_model}")
    info = ImageInfo(head.width, head.height, head.channels, color_model, grouping, *group)
    rows, layout = group_pixels(to_pixels(found), info)
    plan = plan or Plan(decay=0.45, patience=5, m_max=None, encoding="huffman", delta="fixed")
    plan = Plan(**{**plan.__dict__, "block_rows": info.grid[0]})
    return compress_normalized(settle(rows.drop("image", "gx", "gy"), "groups"), layout, plan), info


def decompress_image(c: Compressed, info: ImageInfo, crop: tuple[int, int, int, int] | None = None) -> DataFrame:
    """The pixels, or those of an inclusive rectangle; only the groups that cover it are decoded."""
    if crop is None:
        return ungroup_pixels(c.normalized(), info, "image")
    from bitloom.operators.images import crop_groups

    across = info.grid[0]
    covered = c.rows.withColumns({"gx": F.col("row_idx") % across, "gy": F.floor(F.col("row_idx") / across)}).where(crop_groups(info, *crop)).drop("gx", "gy")
    part = Compressed(c.info, c.layout, c.bases, covered, c.n_bases, c.plan)
    return crop_pixels(ungroup_pixels(part.normalized(), info, "image"), *crop)
