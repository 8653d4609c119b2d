"""Images as rows: pixel frames, colour models, and blocks of pixels as features.

A pixel frame has (image, x, y, r, g, b[, a]).  A block of w x h pixels becomes one row
(image, gx, gy, row_idx) with, per channel, one column for each sub-field of its feature:
no integer is wider than 9 bits, so there is no limit on the block.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from bitloom.errors import ImageError, InvalidFeatureSpec
from bitloom.functions import numbers
from bitloom.schema import DatasetInfo, Feature, min_position_bits

#: Codes of colour models and grouping transforms in containers (fixed values).
COLOR_MODELS = {"rgb": 0, "ycocg": 1, "ycocg_r": 2}
GROUPINGS = {"raw": 0, "for_first": 1, "for_min": 2}


@dataclass(frozen=True)
class ImageInfo:
    """What is needed to put an image together again."""

    width: int
    height: int
    channels: int = 3
    color_model: str = "ycocg_r"
    grouping: str = "for_first"
    group_width: int = 3
    group_height: int = 3
    colorspace: int = 0

    def __post_init__(self) -> None:
        if self.channels not in (3, 4):
            raise ImageError(f"{self.channels} channels; only RGB and RGBA are supported")
        if self.group_width < 1 or self.group_height < 1:
            raise InvalidFeatureSpec("a pixel group needs a width and a height")

    @property
    def pixels(self) -> int:
        return self.group_width * self.group_height

    @property
    def grid(self) -> tuple[int, int]:
        """Groups in a row, and rows of groups."""
        return -(-self.width // self.group_width), -(-self.height // self.group_height)


def feature_bits(grouping: str, pixels: int) -> list[int]:
    """Widths of a channel's sub-fields, first the anchor (and its place, for the minimum)."""
    if pixels < 1:
        raise InvalidFeatureSpec("a pixel group holds a pixel at least")
    if grouping == "raw":
        return [8] * pixels
    if grouping == "for_first":
        return [8, *[9] * (pixels - 1)]
    if grouping == "for_min":
        return [8, min_position_bits(pixels), *[8] * (pixels - 1)]
    raise InvalidFeatureSpec(f"no grouping is called {grouping}")


def channel_names(info: ImageInfo) -> list[str]:
    return ["c0", "c1", "c2", "c3"][: info.channels]


def to_channels(pixels: DataFrame, info: ImageInfo) -> DataFrame:
    """r, g, b[, a] as channels c0.. of the colour model."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    if info.color_model == "ycocg_r":
        found = numbers.rgb_to_ycocg_r(r, g, b)
    elif info.color_model == "ycocg":
        found = numbers.rgb_to_ycocg(r, g, b)
    else:
        found = {"r": r, "g": g, "b": b}
    channels = [c.cast("int").alias(f"c{i}") for i, c in enumerate(found.values())] + ([F.col("a").alias("c3")] if info.channels == 4 else [])
    return pixels.select("image", "x", "y", *channels)


def from_channels(pixels: DataFrame, info: ImageInfo) -> DataFrame:
    c = [F.col("c0"), F.col("c1"), F.col("c2")]
    found = {"ycocg_r": numbers.ycocg_r_to_rgb, "ycocg": numbers.ycocg_to_rgb}.get(info.color_model, lambda *x: dict(zip("rgb", x, strict=True)))(*c)
    return pixels.select("image", "x", "y", *[v.cast("int").alias(k) for k, v in found.items()], *([F.col("c3").alias("a")] if info.channels == 4 else []))


def encode_group(values: Column, grouping: str, pixels: int) -> list[Column]:
    """Sub-fields of an array of a channel's values in raster order."""
    at = [F.get(values, F.lit(i)) for i in range(pixels)]
    if grouping == "raw":
        return at
    if grouping == "for_first":
        return [at[0], *[numbers.zigzag_encode(v - at[0]) for v in at[1:]]]
    least = F.array_min(values)
    place = F.array_position(values, least) - 1
    # the differences of the others, in order, without the minimum's own
    rest = [F.get(values, F.when(F.lit(i) < place, F.lit(i)).otherwise(F.lit(i + 1)).cast("int")) - least for i in range(pixels - 1)]
    return [least, place.cast("int"), *rest]


def decode_group(fields: list[Column], grouping: str, pixels: int) -> Column:
    """The array of a channel's values of its sub-fields."""
    if grouping == "raw":
        return F.array(*fields)
    if grouping == "for_first":
        return F.array(fields[0], *[fields[0] + numbers.zigzag_decode(f) for f in fields[1:]])
    least, place, rest = fields[0], fields[1], F.array(*fields[2:]) if pixels > 1 else F.array().cast("array<int>")
    return F.transform(F.sequence(F.lit(0), F.lit(pixels - 1)), lambda i: F.when(i == place, least).otherwise(least + F.get(rest, F.when(i < place, i).otherwise(i - 1).cast("int"))))


def field_names(info: ImageInfo) -> list[tuple[str, int]]:
    """Name and width of every sub-field, channel by channel; a place among one pixel has no bits and no field."""
    widths = feature_bits(info.grouping, info.pixels)
    return [(f"{c}_{i}", w) for c in channel_names(info) for i, w in enumerate(widths) if w]


def group_pixels(pixels: DataFrame, info: ImageInfo) -> tuple[DataFrame, DatasetInfo]:
    """Blocks of channel values as normalised rows, row by row of groups; beyond the edge are zeros."""
    gw, gh = info.group_width, info.group_height
    across, down = info.grid
    channels = to_channels(pixels, info)
    place = (F.col("y") % gh) * gw + F.col("x") % gw
    at = channels.select("image", F.floor(F.col("x") / gw).alias("gx"), F.floor(F.col("y") / gh).alias("gy"), place.cast("int").alias("p"), *channel_names(info))
    grouped = at.groupBy("image", "gx", "gy").agg(*[F.map_from_entries(F.collect_list(F.struct("p", c))).alias(c) for c in channel_names(info)])

    def full(channel: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(info.pixels - 1)), lambda i: F.coalesce(F.try_element_at(F.col(channel), i), F.lit(0)))

    padded = grouped.select("image", "gx", "gy", *[full(c).alias(c) for c in channel_names(info)])
    columns = []
    for c in channel_names(info):
        widths = feature_bits(info.grouping, info.pixels)
        columns += [f.cast("bigint").alias(f"{c}_{i}") for i, (f, w) in enumerate(zip(encode_group(F.col(c), info.grouping, info.pixels), widths, strict=True)) if w]
    rows = padded.select("image", "gx", "gy", (F.col("gy") * across + F.col("gx")).alias("row_idx"), *columns)
    return rows, DatasetInfo([Feature(n, "uint16", w) for n, w in field_names(info)], across * down)


def ungroup_pixels(rows: DataFrame, info: ImageInfo, image: str | None = None) -> DataFrame:
    """Normalised rows (row_idx and sub-fields) back to pixels; those beyond the edge go."""
    across, _ = info.grid
    gw, gh = info.group_width, info.group_height
    widths = feature_bits(info.grouping, info.pixels)
    arrays = [decode_group([F.col(f"{c}_{i}") if w else F.lit(0) for i, w in enumerate(widths)], info.grouping, info.pixels).alias(c) for c in channel_names(info)]
    first = F.lit(image) if image is not None or "image" not in rows.columns else F.col("image")
    parts = rows.select(first.alias("image"), F.floor(F.col("row_idx") / across).alias("gy"), (F.col("row_idx") % across).alias("gx"), *arrays)
    long = parts.select("image", "gx", "gy", F.posexplode(F.arrays_zip(*[F.col(c).alias(c) for c in channel_names(info)])).alias("p", "v"))
    x = (F.col("gx") * gw + F.col("p") % gw).cast("int")
    y = (F.col("gy") * gh + F.floor(F.col("p") / gw)).cast("int")
    out = long.select("image", x.alias("x"), y.alias("y"), *[F.col(f"v.{c}").cast("int").alias(c) for c in channel_names(info)])
    return from_channels(out.where((F.col("x") < info.width) & (F.col("y") < info.height)), info)


def crop_groups(info: ImageInfo, x1: int, y1: int, x2: int, y2: int) -> Column:
    """Whether a group (gx, gy) covers a pixel of the inclusive rectangle."""
    if not (0 <= x1 <= x2 < info.width and 0 <= y1 <= y2 < info.height):
        raise ImageError(f"the crop {x1},{y1},{x2},{y2} doesn't lie in {info.width} x {info.height}")
    return F.col("gx").between(x1 // info.group_width, x2 // info.group_width) & F.col("gy").between(y1 // info.group_height, y2 // info.group_height)


def crop_pixels(pixels: DataFrame, x1: int, y1: int, x2: int, y2: int) -> DataFrame:
    """The pixels of the inclusive rectangle, with their places in it."""
    return pixels.where(F.col("x").between(x1, x2) & F.col("y").between(y1, y2)).withColumn("x", F.col("x") - x1).withColumn("y", F.col("y") - y1)
