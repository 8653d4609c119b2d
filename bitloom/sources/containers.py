"""The three single-file containers: EGD (any dataset), TGD (tables), IGD (images).

A container is one stream of bits.  Rows and base tables of any size are packed by tasks, in chunks,
and streamed to the file in order, and read alike (:mod:`bitloom.sources.chunked`).  Here are the
formats, and their writing and reading in memory, up to ``MAX_ROWS``.  Many container files are
read in parallel, one task each.

Layout, little-endian throughout:

* EGD: magic, version, n, m, features; per feature a tag, type, transform and payload,
  width, two bits of state per bit; m weights; the base table, raw or as deltas; the rows,
  flat, run-length or Huffman coded.
* TGD: magic, version, names, types, an EGD.
* IGD: magic, version, size, channels, codes of colour and grouping, an EGD.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bitloom.errors import InvalidBaseId, InvalidMetadata, StorageError
from bitloom.operators import encode
from bitloom.operators.basetable import DEVIATION, ONE, VARIABLE, Layout
from bitloom.operators.images import COLOR_MODELS, GROUPINGS, ImageInfo
from bitloom.operators.normalize import decode
from bitloom.operators.ordered import release, settle, with_position
from bitloom.plans.compress import Compressed, Plan
from bitloom.schema import NONE, OFFSET_SIGNED, OFFSET_UNSIGNED, SCALED, SCALED_OFFSET, TO_SPARK, DatasetInfo, Feature, bits_needed_nonzero, signed64

MAX_ROWS = 50_000_000
#: Most rows of a chunk, a multiple of eight, and most bits that a task unpacks at a time.
CHUNK_ROWS, CHUNK_BITS = 1 << 16, 1 << 25
# fixed values of the formats
VERSION = 1
EGD, TGD, IGD = b"EGD", b"TGD", b"IGD"
TRANSFORM_TAGS = {NONE: 0, SCALED: 1, OFFSET_SIGNED: 2, OFFSET_UNSIGNED: 3, SCALED_OFFSET: 4}
DTYPE_TAGS = {"int8": 0, "int16": 1, "int32": 2, "int64": 3, "uint8": 4, "uint16": 5, "uint32": 6, "uint64": 7, "float16": 8, "float32": 9, "float64": 10, "uint128": 11, "uint": 12}
COLUMN_TAGS = {"float16": 0, "float32": 1, "float64": 2, "int8": 3, "int16": 4, "int32": 5, "int64": 6, "uint8": 7, "uint16": 8, "uint32": 9, "uint64": 10}
TABLE_RAW, TABLE_UNARY, TABLE_FIXED = 0, 1, 2
ROWS_FLAT, ROWS_RLE, ROWS_HUFFMAN = 0, 2, 3


def _to_bytes(bits: np.ndarray) -> bytes:
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def _to_bits(data: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, dtype=np.uint8), bitorder="little", count=count)


def _value_bits(values: np.ndarray, width: int) -> np.ndarray:
    """A row of bits, least significant first, per value."""
    return ((values.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)


def _bits_value(bits: np.ndarray) -> np.ndarray:
    return (bits.astype(np.uint64) << np.arange(bits.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


class Reader:
    """A cursor over bytes that reports truncation."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise StorageError(f"the file ends at byte {len(self.data)}, {n} bytes are wanted at {self.at}")
        self.at += n
        return self.data[self.at - n : self.at]

    def integer(self, n: int, signed: bool = False) -> int:
        return int.from_bytes(self.take(n), "little", signed=signed)

    def magic(self, wanted: bytes) -> None:
        if (found := self.take(3)) != wanted:
            raise InvalidMetadata(f"this is no {wanted.decode()} file: it starts with {found!r}")
        if (version := self.integer(1)) != VERSION:
            raise InvalidMetadata(f"version {version} isn't known")


@dataclass
class Dataset:
    """A container in memory: layout, base rows (a bit per variable position) and per row its base and deviation bits."""

    info: DatasetInfo
    layout: Layout
    bases: np.ndarray
    ids: np.ndarray
    deviations: np.ndarray
    block_rows: int = encode.BLOCK_ROWS
    order: list[int] | None = None
    image: ImageInfo | None = None
    encoding: str = "flat"
    delta: str | None = None
    columns: list[tuple[str, str]] = field(default_factory=list)

    def values(self, rows: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Unsigned values of the features, of all rows or some."""
        ids, deviations = (self.ids, self.deviations) if rows is None else (self.ids[rows], self.deviations[rows])
        if len(ids) and (ids.max() >= len(self.bases)):
            raise InvalidBaseId(f"base {ids.max()} of {len(self.bases)}")
        full = np.zeros((len(ids), self.info.chunk_size), dtype=np.uint8)
        full[:, self.layout.positions(ONE)] = 1
        full[:, self.layout.variable] = self.bases[ids]
        full[:, self.layout.deviation] = deviations
        out = {}
        for f, offset in zip(self.info.features, self.info.offsets, strict=False):
            out[f.name] = _bits_value(full[:, offset : offset + f.bits]).view(np.int64)
        return out


# rows


def _symbols(d: Dataset) -> np.ndarray:
    return np.concatenate([d.deviations, _value_bits(d.ids, bits_needed_nonzero(len(d.bases)))], axis=1)


def _stretches(d: Dataset) -> list[tuple[int, int]]:
    """Blocks of data rows, then the condensed rows as one."""
    found = [(a, min(a + d.block_rows, d.info.n)) for a in range(0, d.info.n, d.block_rows)]
    return found + ([(d.info.n, len(d.ids))] if len(d.ids) > d.info.n else [])


def pairs_of(changed: np.ndarray) -> list[tuple[int, int]]:
    """(r, m) pairs of one stretch of rows; ``changed[i]`` tells whether row i differs from the one before."""
    starts = np.flatnonzero(changed)
    out: list[list[int]] = []
    for length in np.diff(np.r_[starts, len(changed)]).tolist():
        while length:
            piece = min(length, encode.MAX_RUN)
            if piece > 1:
                out.append([piece - 1, 0])
            elif out and out[-1][1] < encode.MAX_LITERALS:
                out[-1][1] += 1
            else:
                out.append([0, 1])
            length -= piece
    return [(r, m) for r, m in out]


def runs_of(symbols: np.ndarray, stretches: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[int], list[tuple[int, int]]]:
    """(r, m) pairs of stretches of rows, the rows whose symbols are kept, and for each stretch how many of both come before it."""
    pairs: list[tuple[int, int]] = []
    kept: list[int] = []
    marks = []
    for a, b in stretches:
        marks.append((len(pairs), len(kept)))
        part = symbols[a:b]
        found = pairs_of(np.r_[True, (part[1:] != part[:-1]).any(axis=1)])
        at = a
        for r, m in found:
            if r:
                kept.append(at)
                at += r + 1
            kept += range(at, at + m)
            at += m
        pairs += found
    return pairs, kept, marks


def _write_rows(d: Dataset, encoding: str) -> bytes:
    """The rows in an encoding; flat instead of Huffman codes for more than MAX_SYMBOLS bases."""
    encoding = "flat" if encoding == "huffman" and len(d.bases) > encode.MAX_SYMBOLS else encoding
    id_bits, dev_bits = bits_needed_nonzero(len(d.bases)), d.deviations.shape[1]
    if encoding == "flat":
        return bytes([ROWS_FLAT]) + _to_bytes(_symbols(d).reshape(-1))
    blocks = _stretches(d)
    data_blocks = blocks[: -(-d.info.n // d.block_rows)] if d.info.n else []
    if encoding == "rle":
        symbols = _symbols(d)
        pairs, kept, marks = runs_of(symbols, blocks)
        offsets = [(p, k * symbols.shape[1]) for p, k in marks[: len(data_blocks)]]
        head = struct.pack("<BII", ROWS_RLE, len(offsets), d.block_rows) + b"".join(struct.pack("<II", *o) for o in offsets)
        return head + struct.pack("<I", len(pairs)) + b"".join(bytes(p) for p in pairs) + _to_bytes(symbols[kept].reshape(-1))
    if dev_bits > 255:
        raise InvalidMetadata(f"{dev_bits} deviation bits don't fit the Huffman header; use flat rows")
    counts = np.bincount(d.ids, minlength=len(d.bases))
    codes = encode.canonical_codes(encode.code_lengths({i: int(c) for i, c in enumerate(counts)}))
    of = {s: [(code >> k) & 1 for k in range(length - 1, -1, -1)] for s, length, code in codes}
    stream, offsets = [], []
    for i, s in enumerate(d.ids.tolist()):
        if i < d.info.n and i % d.block_rows == 0:
            offsets.append(len(stream))
        stream += of[s]
    width = -(-id_bits // 8)
    head = struct.pack("<BIBBII", ROWS_HUFFMAN, len(codes), id_bits, dev_bits, len(offsets), d.block_rows)
    table = b"".join(s.to_bytes(width, "little") + bytes([length]) for s, length, _ in codes)
    return head + table + b"".join(struct.pack("<I", o) for o in offsets) + _to_bytes(d.deviations.reshape(-1)) + _to_bytes(np.array(stream, dtype=np.uint8))


def _read_rows(r: Reader, rows: int, n: int, bases: int, dev_bits: int) -> tuple[np.ndarray, np.ndarray, int, str]:
    id_bits, tag = bits_needed_nonzero(bases), r.integer(1)
    if tag == ROWS_FLAT:
        count = rows * (dev_bits + id_bits)
        symbols = _to_bits(r.take(-(-count // 8)), count).reshape(rows, dev_bits + id_bits)
        return _bits_value(symbols[:, dev_bits:]).astype(np.int64), symbols[:, :dev_bits], encode.BLOCK_ROWS, "flat"
    if tag == ROWS_RLE:
        blocks, width = r.integer(4), r.integer(4)
        r.take(8 * blocks)
        pairs = np.frombuffer(r.take(2 * r.integer(4)), dtype=np.uint8).reshape(-1, 2).astype(np.int64)
        repeats = []
        for run, literals in pairs.tolist():
            repeats += ([run + 1] if run else []) + [1] * literals
        if sum(repeats) != rows:
            raise InvalidMetadata(f"the runs make {sum(repeats)} rows of {rows}")
        count = len(repeats) * (dev_bits + id_bits)
        symbols = np.repeat(_to_bits(r.take(-(-count // 8)), count).reshape(len(repeats), dev_bits + id_bits), repeats, axis=0)
        return _bits_value(symbols[:, dev_bits:]).astype(np.int64), symbols[:, :dev_bits], width, "rle"
    if tag != ROWS_HUFFMAN:
        raise InvalidMetadata(f"no row encoding has the tag {tag}")
    symbols, l_id, l_d, blocks, width = r.integer(4), r.integer(1), r.integer(1), r.integer(4), r.integer(4)
    if l_id != id_bits or l_d != dev_bits:
        raise InvalidMetadata("the Huffman header and the layout disagree")
    lengths = {}
    for _ in range(symbols):
        s = r.integer(-(-l_id // 8))
        lengths[s] = r.integer(1)
        if not 0 < lengths[s] <= encode.MAX_CODE:
            raise InvalidMetadata(f"a code of {lengths[s]} bits")
    offsets = [r.integer(4) for _ in range(blocks)]
    if any(b < a for a, b in zip(offsets, offsets[1:], strict=False)):
        raise InvalidMetadata("the block offsets fall")
    deviations = _to_bits(r.take(-(-rows * l_d // 8)), rows * l_d).reshape(rows, l_d)
    decoder = {(length, code): s for s, length, code in encode.canonical_codes(lengths)}
    stream, ids, at = np.unpackbits(np.frombuffer(r.data[r.at :], dtype=np.uint8), bitorder="little").tolist(), [], 0
    for _ in range(rows):
        code = length = 0
        while True:
            if at >= len(stream) or length > encode.MAX_CODE:
                raise InvalidMetadata("the code stream ends early or holds no code")
            code, length, at = code << 1 | stream[at], length + 1, at + 1
            if (s := decoder.get((length, code))) is not None:
                ids.append(s)
                break
    r.at = len(r.data)
    return np.array(ids, dtype=np.int64), deviations, width, "huffman"


# base table


def delta_head(delta: str, count: int, order: list[int], first: bytes, bits: int) -> bytes:
    """What a base table of deltas holds before its ``bits``."""
    width = -(-bits_needed_nonzero(max(len(order), 1)) // 8)
    head = struct.pack("<BQQ", TABLE_UNARY if delta == "unary" else TABLE_FIXED, count, len(order))
    return head + b"".join(i.to_bytes(width, "little") for i in order) + first + struct.pack("<QQ", count - 1, bits)


def delta_bits(steps: list[int], delta: str, v: int) -> list[int]:
    """The bits of the differences of keys of any width."""
    tiers = encode.UNARY_TIERS if delta == "unary" else encode.fixed_tiers()
    bits: list[int] = []
    for s in steps:
        value, length = s - 1, (s - 1).bit_length()
        tier = next((i for i, w in enumerate(tiers) if length <= w), len(tiers))
        if delta == "unary":
            bits += [1] * tier + ([0] if tier < len(tiers) else [])
        else:
            bits += [tier >> k & 1 for k in range(encode.FIXED_PREFIX)]
        bits += [value >> k & 1 for k in range(tiers[tier] if tier < len(tiers) else v)]
    return bits


def _write_table(d: Dataset, delta: str | None) -> bytes:
    v = len(d.layout.variable)
    if delta and d.order is not None and len(d.bases):
        keys = [int("".join(map(str, row[d.order])), 2) if v else 0 for row in d.bases]
        steps = [a - b for a, b in zip(keys, keys[1:], strict=False)]
        if all(s > 0 for s in steps):
            bits = delta_bits(steps, delta, v)
            return delta_head(delta, len(keys), d.order, keys[0].to_bytes(-(-v // 8), "little"), len(bits)) + _to_bytes(np.array(bits, dtype=np.uint8))
    return struct.pack("<BQ", TABLE_RAW, len(d.bases)) + (np.packbits(d.bases, axis=1, bitorder="little").tobytes() if v else b"")


def _read_table(r: Reader, v: int) -> tuple[np.ndarray, list[int] | None, str | None]:
    tag, count = r.integer(1), r.integer(8)
    if tag == TABLE_RAW:
        width = -(-v // 8)
        rows = np.frombuffer(r.take(count * width), dtype=np.uint8).reshape(count, width)
        return np.unpackbits(rows, axis=1, bitorder="little", count=v) if v else np.zeros((count, 0), dtype=np.uint8), None, None
    if tag not in (TABLE_UNARY, TABLE_FIXED):
        raise InvalidMetadata(f"no base table has the tag {tag}")
    width = -(-bits_needed_nonzero(max(v, 1)) // 8)
    order = [r.integer(width) for _ in range(r.integer(8))]
    key = r.integer(-(-v // 8)) if count else 0
    steps, length = r.integer(8), r.integer(8)
    bits = _to_bits(r.take(-(-length // 8)), length).tolist()
    tiers, keys, at = encode.UNARY_TIERS if tag == TABLE_UNARY else encode.fixed_tiers(), [key] if count else [], 0
    for _ in range(steps):
        if tag == TABLE_UNARY:
            tier = 0
            while tier < len(tiers) and bits[at]:
                tier, at = tier + 1, at + 1
            at += tier < len(tiers)
        else:
            tier = sum(b << k for k, b in enumerate(bits[at : at + encode.FIXED_PREFIX]))
            at += encode.FIXED_PREFIX
        payload = tiers[tier] if tier < len(tiers) else v
        key -= 1 + sum(b << k for k, b in enumerate(bits[at : at + payload]))
        at += payload
        if key < 0:
            raise InvalidMetadata("the deltas pass below zero")
        keys.append(key)
    rows = np.zeros((len(keys), v), dtype=np.uint8)
    for i, k in enumerate(keys):
        for rank, column in enumerate(order):
            rows[i, column] = k >> (v - 1 - rank) & 1
    return rows, order, "unary" if tag == TABLE_UNARY else "fixed"


# containers


def stored_type(f: Feature) -> str:
    """The type a container names: that of the unsigned value, or the original one where nothing was moved."""
    if f.transform == NONE:
        return f.dtype if f.dtype in DTYPE_TAGS else "uint"
    return f"uint{f.bits}" if f"uint{f.bits}" in DTYPE_TAGS else "uint"


def original_type(stored: str, transform: str) -> str:
    """The type an EGD's feature is decoded to, as its original one isn't kept: the widest of its kind."""
    return {NONE: stored, OFFSET_SIGNED: "int64", OFFSET_UNSIGNED: "uint64"}.get(transform, "float64")


def egd_head(info: DatasetInfo, layout: Layout) -> bytes:
    """What an EGD holds before its base table."""
    out = [EGD, struct.pack("<BQQQ", VERSION, info.n, len(info.weights), len(info.features))]
    for f, offset in zip(info.features, info.offsets, strict=False):
        out.append(bytes([1, DTYPE_TAGS[stored_type(f)], TRANSFORM_TAGS[f.transform]]))
        if f.transform in (SCALED, SCALED_OFFSET):
            out.append(bytes([f.decimals]))
        if f.transform in (OFFSET_SIGNED, OFFSET_UNSIGNED, SCALED_OFFSET):
            out.append(struct.pack("<Q", f.minimum & (1 << 64) - 1))
        states = np.array(layout.states[offset : offset + f.bits], dtype=np.uint8)
        out += [struct.pack("<H", f.bits), _to_bytes(np.stack([states & 1, states >> 1], axis=1).reshape(-1))]
    width = -(-bits_needed_nonzero(info.n) // 8)
    for w in info.weights:
        if w >> 8 * width:
            raise InvalidMetadata(f"a weight of {w} doesn't fit {width} bytes")
        out.append(w.to_bytes(width, "little"))
    return b"".join(out)


def egd_bytes(d: Dataset, encoding: str | None = None, delta: str | None = None) -> bytes:
    """An EGD file."""
    return b"".join([egd_head(d.info, d.layout), _write_table(d, delta or d.delta), _write_rows(d, encoding or d.encoding)])


def _egd_front(r: Reader) -> tuple[DatasetInfo, Layout]:
    r.magic(EGD)
    n, m, count = r.integer(8), r.integer(8), r.integer(8)
    names, kinds = {v: k for k, v in TRANSFORM_TAGS.items()}, {v: k for k, v in DTYPE_TAGS.items()}
    features, states = [], []
    for i in range(count):
        if r.integer(1) != 1:
            raise InvalidMetadata("a feature's tag isn't 1")
        dtype, transform = kinds.get(r.integer(1)), names.get(r.integer(1))
        if dtype is None or transform is None:
            raise InvalidMetadata("a feature's type or transform isn't known")
        decimals = r.integer(1) if transform in (SCALED, SCALED_OFFSET) else 0
        minimum = r.integer(8, transform != OFFSET_UNSIGNED) if transform in (OFFSET_SIGNED, OFFSET_UNSIGNED, SCALED_OFFSET) else -(1 << 63) if transform == SCALED else 0
        bits = r.integer(2)
        features.append(Feature(f"f{i}", original_type(dtype, transform), bits, transform, minimum, decimals))
        two = _to_bits(r.take(-(-2 * bits // 8)), 2 * bits).reshape(bits, 2)
        states += (two[:, 0] + 2 * two[:, 1]).tolist()
    width = -(-bits_needed_nonzero(n) // 8)
    info = DatasetInfo(features, n, [r.integer(width) for _ in range(m)])
    return info, Layout(tuple(states), tuple(b for b, s in enumerate(states) if s != DEVIATION))


def read_egd(data: bytes) -> Dataset:
    r = Reader(data)
    info, layout = _egd_front(r)
    bases, order, delta = _read_table(r, len(layout.variable))
    ids, deviations, block, encoding = _read_rows(r, info.n + len(info.weights), info.n, len(bases), len(layout.deviation))
    return Dataset(info, layout, bases, ids, deviations, block, order, None, encoding, delta)


def tgd_head(columns: list[tuple[str, str]], size: int) -> bytes:
    """Column names and types, which a TGD holds before an EGD of ``size`` bytes."""
    names = b"".join(struct.pack("<H", len(n.encode())) + n.encode() for n, _ in columns)
    kinds = bytes(COLUMN_TAGS[t] for _, t in columns)
    return TGD + struct.pack("<BII", VERSION, len(columns), len(names)) + names + struct.pack("<I", len(kinds)) + kinds + struct.pack("<Q", size)


def tgd_bytes(d: Dataset, encoding: str | None = None, delta: str | None = None) -> bytes:
    """A TGD file."""
    payload = egd_bytes(d, encoding, delta)
    return tgd_head(d.columns, len(payload)) + payload


def _tgd_front(r: Reader) -> list[tuple[str, str]]:
    r.magic(TGD)
    count, _ = r.integer(4), r.integer(4)
    names = [r.take(r.integer(2)).decode() for _ in range(count)]
    kinds = {v: k for k, v in COLUMN_TAGS.items()}
    types = [kinds.get(t, "float64") for t in r.take(r.integer(4))]
    if len(types) != len(names):
        raise InvalidMetadata(f"{len(names)} names and {len(types)} types")
    return list(zip(names, types, strict=True))


def _named(info: DatasetInfo, columns: list[tuple[str, str]]) -> DatasetInfo:
    """An EGD's features with the names and types of a TGD."""
    if len(columns) != len(info.features):
        raise InvalidMetadata(f"{len(columns)} names and {len(info.features)} features")
    return DatasetInfo([Feature(n, t, f.bits, f.transform, f.minimum, f.decimals) for (n, t), f in zip(columns, info.features, strict=True)], info.n, info.weights)


def read_tgd(data: bytes) -> Dataset:
    r = Reader(data)
    columns = _tgd_front(r)
    d = read_egd(r.take(r.integer(8)))
    d.info, d.columns = _named(d.info, columns), columns
    return d


def igd_head(i: ImageInfo, size: int) -> bytes:
    """What an IGD holds before an EGD of ``size`` bytes."""
    head = struct.pack("<BIIBBBBII", VERSION, i.width, i.height, i.channels, i.colorspace, COLOR_MODELS[i.color_model], GROUPINGS[i.grouping], i.group_width, i.group_height)
    return IGD + head + struct.pack("<Q", size)


def by_channel(info: DatasetInfo, image: ImageInfo) -> DatasetInfo:
    """The features of an IGD, one per channel: the sub-fields of a channel are put side by side."""
    per = len(info.features) // image.channels
    merged = [Feature(f"f{c}", "uint", sum(f.bits for f in info.features[c * per : (c + 1) * per])) for c in range(image.channels)]
    return DatasetInfo(merged, info.n, info.weights)


def igd_bytes(d: Dataset, encoding: str | None = None, delta: str | None = None) -> bytes:
    """An IGD file."""
    payload = egd_bytes(Dataset(by_channel(d.info, d.image), d.layout, d.bases, d.ids, d.deviations, d.block_rows, d.order, None, d.encoding, d.delta), encoding, delta)
    return igd_head(d.image, len(payload)) + payload


def _igd_front(r: Reader) -> ImageInfo:
    r.magic(IGD)
    width, height, channels, colorspace, color, grouping, gw, gh = struct.unpack("<IIBBBBII", r.take(20))
    colors, groups = {v: k for k, v in COLOR_MODELS.items()}, {v: k for k, v in GROUPINGS.items()}
    if color not in colors or grouping not in groups:
        raise InvalidMetadata("the colour model or the grouping isn't known")
    return ImageInfo(width, height, channels, colors[color], groups[grouping], gw, gh, colorspace)


def _by_field(info: DatasetInfo, image: ImageInfo) -> DatasetInfo:
    """The features of an IGD, one per sub-field again."""
    from bitloom.operators.images import field_names

    fields = [Feature(n, "uint16", w) for n, w in field_names(image)]
    if sum(f.bits for f in fields) != info.chunk_size:
        raise InvalidMetadata("the features don't fit the grouping")
    return DatasetInfo(fields, info.n, info.weights)


def read_igd(data: bytes) -> Dataset:
    r = Reader(data)
    image = _igd_front(r)
    d = read_egd(r.take(r.integer(8)))
    d.info, d.image = _by_field(d.info, image), image
    return d


def read_front(r: Reader, kind: str, size: int) -> tuple[DatasetInfo, Layout, int]:
    """Features and layout of a container of ``size`` bytes, and where it ends; the base table is next."""
    columns = _tgd_front(r) if kind == "tgd" else None
    image = _igd_front(r) if kind == "igd" else None
    end = size if kind == "egd" else r.integer(8) + r.at
    if end > size:
        raise StorageError(f"the file ends at byte {size}, {end} are wanted")
    info, layout = _egd_front(r)
    return _named(info, columns) if columns is not None else _by_field(info, image) if image else info, layout, end


READERS = {"egd": read_egd, "tgd": read_tgd, "igd": read_igd}


# to and from frames


def collect(c: Compressed, image: ImageInfo | None = None) -> Dataset:
    """A compressed table in memory, for :func:`egd_bytes` and the like; bounded by ``MAX_ROWS``."""
    total = c.info.n + len(c.info.weights)
    if total > MAX_ROWS or c.n_bases > MAX_ROWS:
        raise StorageError(f"{total} rows are too many for a container; use the Parquet store")
    rows = c.rows.orderBy("row_idx").toPandas()
    return Dataset(c.info, c.layout, _base_bits(c), rows["base_id"].to_numpy().astype(np.int64), _bits_at(rows, [c.info.place(p) for p in c.layout.deviation]), c.plan.block_rows, c.order, image, c.plan.encoding, c.plan.delta, _columns(c))


def _columns(c: Compressed) -> list[tuple[str, str]]:
    return [(f.name, f.dtype) for f in c.info.features]


def _bits_at(frame, places: list[tuple[str, int]]) -> np.ndarray:
    """A row of the bits at ``places``, columns and bits in them, for each row of a Pandas frame or an Arrow table."""
    out = np.zeros((len(frame), len(places)), dtype=np.uint8)
    for i, (name, local) in enumerate(places):
        out[:, i] = frame[name].to_numpy().astype(np.int64) >> local & 1
    return out


def _base_bits(c: Compressed) -> np.ndarray:
    return _bits_at(c.bases.orderBy("base_id").toPandas(), [c.info.place(p) for p in c.layout.variable])


def _numbered(frame: DataFrame, position: str) -> DataFrame:
    """``frame`` with positions from 0 without gaps, in the same order."""
    found = frame.agg(F.min(position).alias("low"), F.max(position).alias("high"), F.count("*").alias("n")).first()
    if not found["n"] or (found["low"], found["high"]) == (0, found["n"] - 1):
        return frame
    return with_position(frame.withColumnRenamed(position, "_old"), [F.col("_old")], position).drop("_old")


def chunk_rows(width: int) -> int:
    """Rows of a chunk where each takes ``width`` bits: a multiple of eight, so that a chunk ends at a whole byte."""
    return max(8, min(CHUNK_ROWS, CHUNK_BITS // max(1, width)) // 8 * 8)


def by_chunk(frame: DataFrame, position: str, info: DatasetInfo, positions: list[int], chunk: Column, pack: Callable[[int, np.ndarray, np.ndarray], dict], schema: str) -> DataFrame:
    """For each chunk what ``pack`` makes of its number and, in the order of a dense ``position``, its base ids and bits at ``positions``."""
    import pyarrow as pa

    places = [info.place(p) for p in positions]
    alias = {name: f"_{i}" for i, name in enumerate(dict.fromkeys(name for name, _ in places))}
    places = [(alias[name], local) for name, local in places]

    def work(key, table):
        table = table.sort_by("_at")
        made = pack(key[0].as_py(), table["_id"].to_numpy(), _bits_at(table, places))
        return pa.table({"chunk": [key[0].as_py()], **{name: [value] for name, value in made.items()}})

    chosen = frame.select(chunk.alias("chunk"), F.col(position).cast("bigint").alias("_at"), F.col("base_id").cast("bigint").alias("_id"), *[F.col(f"`{name}`").alias(a) for name, a in alias.items()])
    return chosen.groupBy("chunk").applyInArrow(work, f"chunk long, {schema}")


def packed_chunks(frame: DataFrame, position: str, info: DatasetInfo, positions: list[int], id_bits: int, width: int) -> DataFrame:
    """Chunks of rows, in the order of a dense ``position``, as bytes: the bits at ``positions``, then ``id_bits`` of base_id, then zeros up to ``width`` bits a row."""

    def pack(key: int, ids: np.ndarray, found: np.ndarray) -> dict:
        bits = np.zeros((len(ids), width), dtype=np.uint8)
        bits[:, : len(positions)] = found
        if id_bits:
            bits[:, len(positions) : len(positions) + id_bits] = _value_bits(ids, id_bits)
        return {"data": _to_bytes(bits.reshape(-1))}

    return by_chunk(frame, position, info, positions, F.floor(F.col(position).cast("bigint") / chunk_rows(width)), pack, "data binary")


def in_order(chunks: DataFrame) -> Iterable[bytes]:
    """The chunks' bytes, of which the driver holds those of a partition or two at a time."""
    placed = settle(chunks, "chunks")
    for row in placed.orderBy("chunk").select("data").toLocalIterator():
        yield bytes(row["data"])
    release(placed)


def _flat_parts(c: Compressed) -> tuple[int, Iterable[bytes]]:
    """Bytes of flat rows: how many, and the pieces."""
    id_bits = bits_needed_nonzero(c.n_bases)
    width = len(c.layout.deviation) + id_bits
    rows = in_order(packed_chunks(_numbered(c.rows, "row_idx"), "row_idx", c.info, c.layout.deviation, id_bits, width))
    return 1 + -(-(c.info.n + len(c.info.weights)) * width // 8), chain([bytes([ROWS_FLAT])], rows)


def _raw_parts(c: Compressed) -> tuple[int, Iterable[bytes]]:
    """Bytes of a raw base table."""
    begin, wide = struct.pack("<BQ", TABLE_RAW, c.n_bases), -(-len(c.layout.variable) // 8)
    rows = in_order(packed_chunks(_numbered(c.bases, "base_id"), "base_id", c.info, c.layout.variable, 0, 8 * wide)) if wide else []
    return len(begin) + c.n_bases * wide, chain([begin], rows)


def feature_values(info: DatasetInfo, bits: np.ndarray, positions: list[int], ones: list[int]) -> dict[str, np.ndarray]:
    """Unsigned values of the features from rows of bits at ``positions``; those at ``ones`` are set, all others clear."""
    full = np.zeros((len(bits), info.chunk_size), dtype=np.uint8)
    full[:, ones] = 1
    full[:, positions] = bits
    return {f.name: _bits_value(full[:, o : o + f.bits]).view(np.int64) for f, o in zip(info.features, info.offsets, strict=False)}


def to_compressed(spark: SparkSession, d: Dataset) -> Compressed:
    """A container's dataset as frames again; base counts are recounted from the ids."""
    counts = np.bincount(d.ids, minlength=len(d.bases)).astype(np.int64)
    fields = ", ".join(f"`{f.name}` long" for f in d.info.features)
    bases = pd.DataFrame({"base_id": np.arange(len(d.bases), dtype=np.int64), **feature_values(d.info, d.bases, d.layout.variable, d.layout.positions(ONE)), "cnt": counts, "first_row": np.zeros(len(d.bases), dtype=np.int64)})
    at = np.arange(len(d.ids), dtype=np.int64)
    rows = pd.DataFrame({"row_idx": at, "base_id": d.ids, **feature_values(d.info, d.deviations, d.layout.deviation, []), "block_id": at // d.block_rows})
    made = spark.createDataFrame(rows, f"row_idx long, base_id long, {fields}, block_id long")
    return Compressed(d.info, d.layout, spark.createDataFrame(bases, f"base_id long, {fields}, cnt long, first_row long"), made, len(d.bases), Plan(block_rows=d.block_rows, encoding=d.encoding, delta=d.delta), d.order)


def write_file(spark: SparkSession, path: str, data: bytes | Iterable[bytes]) -> int:
    """Write bytes, or pieces of them, through Spark's file system layer, so that any store will do; returns how many.

    A file that could not be finished is deleted.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    out, written = fs.create(where, True), 0
    try:
        for piece in [data] if isinstance(data, bytes) else data:
            for i in range(0, len(piece), 1 << 20):
                out.write(bytearray(piece[i : i + (1 << 20)]))
            written += len(piece)
        out.close()
    except BaseException:
        out.close()
        fs.delete(where, False)
        raise
    return written


def read_file(spark: SparkSession, path: str) -> bytes:
    found = spark.read.format("binaryFile").load(path).select("content").head(1)
    if not found:
        raise StorageError(f"{path} isn't there")
    return bytes(found[0]["content"])


def kind_of(path: str) -> str:
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix not in READERS:
        raise InvalidMetadata(f"{path} is no container by its name")
    return suffix


def save(c: Compressed, path: str, image: ImageInfo | None = None) -> int:
    """Write a container whose kind the path's extension names, packed by tasks; returns its bytes."""
    from bitloom.sources import chunked

    kind = kind_of(path)
    head = egd_head(by_channel(c.info, image) if kind == "igd" else c.info, c.layout)
    table_size, table = (chunked.delta_parts(c) if c.plan.delta else None) or _raw_parts(c)
    rows_size, rows = {"flat": _flat_parts, "rle": chunked.run_parts, "huffman": chunked.huffman_parts}[c.plan.encoding](c)
    size = len(head) + table_size + rows_size
    before = {"egd": lambda: b"", "tgd": lambda: tgd_head(_columns(c), size), "igd": lambda: igd_head(image, size)}[kind]()
    written = write_file(c.rows.sparkSession, path, chain([before, head], table, rows))
    if written != len(before) + size:
        raise StorageError(f"{path} has {written} bytes instead of {len(before) + size}")
    return written


def load(spark: SparkSession, path: str) -> Compressed:
    """A container as frames; the file is read as a stream and decoded by tasks."""
    from bitloom.sources import chunked

    return chunked.load(spark, path)


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """Decoded rows of all container files of a kind below ``path``, one task per file, with their file and row_idx.

    The files must have the same columns; the first one tells them.
    """
    files = spark.read.format("binaryFile").load(path)
    head = files.orderBy("path").select("path", "content").head(1)
    if not head:
        raise StorageError(f"no files in {path}")
    kind = kind_of(head[0]["path"])
    info = READERS[kind](bytes(head[0]["content"])).info
    fields = ", ".join(f"`{f.name}` long" for f in info.features)

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                d = READERS[kind_of(name)](content)
                values = d.values(np.arange(d.info.n))
                minimum = [signed64(f.minimum) for f in d.info.features]
                columns = [pa.array(v) for v in values.values()]
                for f, m, found in zip(info.features, minimum, d.info.features, strict=True):
                    if (f.bits, f.transform, signed64(f.minimum)) != (found.bits, found.transform, m):
                        raise InvalidMetadata(f"{name} has another layout than the first file")
                yield pa.RecordBatch.from_arrays([pa.array([name] * d.info.n), pa.array(np.arange(d.info.n)), *columns], names=["file", "row_idx", *[f.name for f in info.features]])

    normal = files.select("path", "content").mapInArrow(rows, f"file string, row_idx long, {fields}")
    return normal.select("file", "row_idx", *[decode(F.col(f"`{f.name}`"), f).alias(f.name) for f in info.features if f.dtype in TO_SPARK])
