"""Condensed samples: a few weighted mean rows that stand for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bitloom.functions.bits import base_columns, deviation_columns
from bitloom.operators.distinct import ExactCounter
from bitloom.operators.entropy import BitScore, feature_order
from bitloom.schema import DatasetInfo, signed64


def prefix_for(curve: list[int], constants: int, m_max: int) -> int:
    """The shortest prefix, constants included, with at least ``m_max`` groups; all bits if there is none."""
    return next((k for k in range(constants, len(curve)) if curve[k] >= m_max), len(curve) - 1)


def means(rows: DataFrame, info: DatasetInfo, bits: list[int]) -> DataFrame:
    """One row per group of equal ``bits``: weight, and per feature the base value plus the floored mean of the other bits."""
    base, rest = base_columns(info, bits), deviation_columns(info, bits)
    names = [f.name for f in info.features]
    parts = rows.select(*[base[n].alias(f"_b_{n}") for n in names], *[rest[n].alias(f"_d_{n}") for n in names])

    def total(f):
        # features of 64 bits are unsigned patterns, whose sums need decimals
        if f.bits < 44:
            return F.sum(f"_d_{f.name}")
        d = F.col(f"_d_{f.name}").cast("decimal(20,0)")
        return F.sum(F.when(d < 0, d + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(d))

    grouped = parts.groupBy(*[f"_b_{n}" for n in names]).agg(F.count("*").alias("weight"), *[total(f).alias(f"_s_{f.name}") for f in info.features])

    def value(f):
        if f.bits < 44:
            return (F.col(f"_b_{f.name}") + F.floor(F.col(f"_s_{f.name}") / F.col("weight"))).bitwiseAND(F.lit(signed64(f.mask)))
        # the sum of two unsigned 64-bit patterns, wrapped: in decimals, then back to a pattern
        base, whole, half = F.col(f"_b_{f.name}").cast("decimal(22,0)"), F.lit(str(1 << 64)).cast("decimal(22,0)"), F.lit(str(1 << 63)).cast("decimal(22,0)")
        mean = F.expr(f"cast(floor(`_s_{f.name}` / weight) as decimal(22,0))")
        total = F.when(base < 0, base + whole).otherwise(base) + mean
        total = F.when(total >= whole, total - whole).otherwise(total)
        return F.when(total >= half, total - whole).otherwise(total).cast("bigint").bitwiseAND(F.lit(signed64(f.mask)))

    return grouped.select("weight", *[value(f).alias(f.name) for f in info.features])


def condense(rows: DataFrame, info: DatasetInfo, scores: list[BitScore], m_max: int = 30) -> tuple[DataFrame, list[int]]:
    """Condensed rows (weight, features) and the bits that group them.

    Bits are taken feature-wise from the top until there are at least ``m_max`` groups, so
    there can be more: one bit may double them.
    """
    order = feature_order(scores, info)
    constants = sum(s.constant for s in scores)
    k = prefix_for(ExactCounter().curve(rows, info, order), constants, m_max)
    return means(rows, info, order[:k]), order[:k]


def append(rows: DataFrame, condensed: DataFrame, n: int) -> DataFrame:
    """Condensed rows behind the data rows, numbered from ``n``; for layouts that store them together."""
    from bitloom.operators.ordered import with_position

    names = [c for c in rows.columns if c != "row_idx"]
    return rows.unionByName(with_position(condensed, [F.col(f"`{c}`") for c in names], "row_idx", n).select("row_idx", *names))
