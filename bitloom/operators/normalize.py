"""Columns to compact unsigned integers and back.

One aggregation finds each column's range and its null and non-finite counts; the rest is
projection.  Integers are moved by their minimum; floats are scaled to integers first or
kept as raw IEEE bits.  Everything stays in BIGINT (or DECIMAL where a range passes 2^63),
so the way back is exact.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from bitloom.errors import DataLoadError, FrameError, InvalidDataType, InvalidFeatureSpec
from bitloom.schema import NONE, OFFSET_SIGNED, OFFSET_UNSIGNED, SCALED, SCALED_OFFSET, TO_SPARK, WIDTHS, DatasetInfo, Feature, dtype_of, smallest_unsigned

log = logging.getLogger(__name__)

#: More decimals than these are reported, as a double hardly holds them.
SAFE_DECIMALS = 9


@dataclass(frozen=True)
class Options:
    """How columns become unsigned integers.

    ``floats``: "scaled_offset" (scale, then move by the minimum), "scaled" (scale, then
    flip the sign bit) or "raw" (IEEE bits, lossless).  ``zero_integers``: move integers
    by their minimum instead of flipping the sign bit of their type.
    """

    floats: str = "scaled_offset"
    decimals: int = 9
    zero_integers: bool = True


def fixed_signed_bias(bits: int) -> int:
    """The smallest value of a signed type."""
    return -(1 << (bits - 1))


def _is_float(dtype: str) -> bool:
    return dtype.startswith("float")


def _scaled(column: Column, decimals: int) -> Column:
    return F.round(column * F.lit(10.0**decimals), 0)


def profile(df: DataFrame, columns: list[str], options: Options = Options()) -> dict[str, dict]:
    """Count, nulls, non-finite values, minimum and maximum of each column (floats: scaled), in one aggregation."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    aggregates = [F.count("*").alias("n")]
    for i, name in enumerate(columns):
        dtype, c = dtype_of(kinds[name]), F.col(f"`{name}`")
        finite = ~(F.isnan(c) | c.isin(float("inf"), float("-inf"))) if _is_float(dtype) else F.lit(True)
        value = F.when(finite, _scaled(c.cast("double"), options.decimals)) if _is_float(dtype) and options.floats != "raw" else c
        aggregates += [F.count_if(c.isNull()).alias(f"nulls{i}"), F.count_if(c.isNotNull() & ~finite).alias(f"odd{i}"), F.min(value).alias(f"min{i}"), F.max(value).alias(f"max{i}")]
    row = df.agg(*aggregates).first()
    return {name: {"n": row["n"], "nulls": row[f"nulls{i}"], "nonfinite": row[f"odd{i}"], "min": row[f"min{i}"], "max": row[f"max{i}"]} for i, name in enumerate(columns)}


def specify(name: str, spark_type: str, found: dict, options: Options = Options()) -> Feature:
    """The feature of a column with the profile ``found``."""
    dtype = dtype_of(spark_type)
    if found["nulls"]:
        raise DataLoadError(f"column {name} holds {found['nulls']} nulls")
    width = WIDTHS[dtype]
    if _is_float(dtype):
        if options.floats == "raw":
            return Feature(name, dtype, width)
        if found["nonfinite"]:
            raise InvalidFeatureSpec(f"column {name} holds values that aren't finite")
        if options.decimals > SAFE_DECIMALS:
            log.warning("column %s: more than %d decimals may not survive", name, SAFE_DECIMALS)
        least, most = int(found["min"]), int(found["max"])
        if least < -(1 << 63) or most >= 1 << 63:
            raise InvalidFeatureSpec(f"column {name}: scaled by 10^{options.decimals}, values pass 64 bits")
        if options.floats == "scaled":
            return Feature(name, dtype, smallest_unsigned(most - fixed_signed_bias(64)), SCALED, fixed_signed_bias(64), options.decimals)
        return Feature(name, dtype, smallest_unsigned(most - least), SCALED_OFFSET, least, options.decimals)
    signed = dtype.startswith("int")
    if not options.zero_integers:
        most = int(found["max"])
        return Feature(name, dtype, smallest_unsigned(most - fixed_signed_bias(width)), OFFSET_SIGNED, fixed_signed_bias(width)) if signed else Feature(name, dtype, smallest_unsigned(most))
    least = int(found["min"])
    return Feature(name, dtype, smallest_unsigned(int(found["max"]) - least), OFFSET_SIGNED if signed else OFFSET_UNSIGNED, least)


def raw_bits(column: Column, dtype: str) -> Column:
    """IEEE bits of a float as BIGINT."""
    if dtype == "float64":
        return F.java_method(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), column).cast("bigint")
    return F.java_method(F.lit("java.lang.Float"), F.lit("floatToRawIntBits"), column).cast("bigint").bitwiseAND(F.lit((1 << 32) - 1))


def from_raw_bits(column: Column, dtype: str) -> Column:
    if dtype == "float64":
        return F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), column).cast("double")
    return F.java_method(F.lit("java.lang.Float"), F.lit("intBitsToFloat"), F.when(column >= 1 << 31, column - (1 << 32)).otherwise(column).cast("int")).cast("float")


def _decimal(value: int) -> Column:
    return F.lit(str(value)).cast("decimal(21,0)")


def _shifted(value: Column, f: Feature) -> Column:
    """``value - minimum`` as an unsigned pattern."""
    if f.bits < 64 and -(1 << 62) < f.minimum < 1 << 62 and f.dtype != "uint64":
        return value.cast("bigint") - F.lit(f.minimum).cast("bigint")
    wide = value.cast("decimal(20,0)").cast("decimal(21,0)") - _decimal(f.minimum)
    return F.when(wide >= _decimal(1 << 63), wide - _decimal(1 << 64)).otherwise(wide).cast("bigint")


def encode(column: Column, f: Feature) -> Column:
    """The unsigned integer of a column's value."""
    if f.transform in (SCALED, SCALED_OFFSET):
        return _shifted(_scaled(column.cast("double"), f.decimals).cast("bigint"), f)
    if f.transform == NONE and _is_float(f.dtype):
        return raw_bits(column, f.dtype)
    return _shifted(column, f)


def decode(column: Column, f: Feature) -> Column:
    """The original value of an unsigned integer, in the original type."""
    if f.transform == NONE and _is_float(f.dtype):
        return from_raw_bits(column, f.dtype)
    if f.bits < 64 and -(1 << 62) < f.minimum < 1 << 62:
        value = column + F.lit(f.minimum).cast("bigint")
    else:
        unsigned = column.cast("decimal(20,0)").cast("decimal(21,0)")
        value = (F.when(column < 0, unsigned + _decimal(1 << 64)).otherwise(unsigned) + _decimal(f.minimum)).cast("decimal(20,0)")
    if f.transform in (SCALED, SCALED_OFFSET):
        value = value.cast("double") / F.lit(10.0**f.decimals)
    return value.cast(TO_SPARK[f.dtype])


def normalize(df: DataFrame, row_idx: str, columns: list[str] | None = None, options: Options = Options()) -> tuple[DataFrame, DatasetInfo]:
    """Rows of (row_idx, unsigned integers) and their layout; runs one aggregation, the rest is lazy."""
    columns = [c for c in df.columns if c != row_idx] if columns is None else columns
    if not columns:
        raise FrameError("no columns to normalise")
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    found = profile(df, columns, options)
    n = found[columns[0]]["n"]
    if not n:
        raise FrameError("no rows to normalise")
    features = [specify(c, kinds[c], found[c], options) for c in columns]
    rows = df.select(F.col(f"`{row_idx}`").cast("bigint").alias("row_idx"), *[encode(F.col(f"`{f.name}`"), f).alias(f.name) for f in features])
    return rows, DatasetInfo(features, n)


def reconstruct(rows: DataFrame, info: DatasetInfo, keep: list[str] | None = None) -> DataFrame:
    """Original values in original types; ``keep`` (row_idx by default) passes through."""
    keep = ["row_idx"] if keep is None else keep
    return rows.select(*keep, *[decode(F.col(f"`{f.name}`"), f).alias(f.name) for f in info.features])


def checked(df: DataFrame, columns: list[str]) -> None:
    """Raise unless every column has a supported type."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    for c in columns:
        try:
            dtype_of(kinds[c])
        except InvalidDataType as e:
            raise InvalidDataType(f"column {c}: {e}") from e
