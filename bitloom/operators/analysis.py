"""Analyses: distributions of ids and deviations, counting errors, delta lengths, tier plans."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from bitloom.operators.distinct import ExactCounter, HyperLogLogCounter
from bitloom.operators.entropy import BitScore
from bitloom.operators.ordered import with_position
from bitloom.schema import DatasetInfo


def _entropy(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values and Shannon entropy, from counts: log2(n) - sum(c log2 c) / n."""
    counts = df.groupBy(*columns).agg(F.count("*").alias("c"))
    return counts.agg(F.count("*").alias("k"), (F.log2(F.sum("c").cast("double")) - F.sum(F.col("c") * F.log2(F.col("c").cast("double"))) / F.sum("c")).alias("h"))


def id_deviation_entropy(encoded: DataFrame, deviation: list[str]) -> DataFrame:
    """One row: distinct base ids and their entropy, distinct deviations and theirs."""
    ids = _entropy(encoded, ["base_id"]).select(F.col("k").alias("n_ids"), F.col("h").alias("id_entropy"))
    others = _entropy(encoded, deviation).select(F.col("k").alias("n_deviations"), F.col("h").alias("deviation_entropy"))
    return ids.join(F.broadcast(others))  # one row each


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """Values with counts, ranked by falling count, then value."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("cnt"))
    return with_position(counts, [F.col("cnt").desc(), F.col("value")], "rank", 1)


def counter_precision(spark: SparkSession, rows: DataFrame, info: DatasetInfo, scores: list[BitScore], order: list[int], limit_bits: int | None = None) -> DataFrame:
    """Exact and approximate distinct counts of every prefix, with errors."""
    order = order[:limit_bits]
    constant = {s.bit: s.constant for s in scores}
    entropies = {s.bit: s.entropy for s in scores}
    exact, approximate = (c.curve(rows, info, order) for c in (ExactCounter(), HyperLogLogCounter()))
    out = [(k, b, entropies[b], constant[b], exact[k], approximate[k], abs(approximate[k] - exact[k]), (approximate[k] - exact[k]) / exact[k] if exact[k] else 0.0) for k, b in enumerate(order, 1)]
    return spark.createDataFrame(out, "step int, bit int, entropy double, is_constant boolean, exact long, approximate long, abs_error long, relative_error double")


def precision_summary(precision: DataFrame) -> DataFrame:
    """Mean absolute and root mean square relative error and bias, over the bits that vary."""
    e = F.col("relative_error")
    return precision.where("not is_constant").agg(F.count("*").alias("steps"), F.avg(F.abs(e)).alias("mape"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"))


def precision_by_step(traces: DataFrame) -> DataFrame:
    """Several precision traces averaged step by step."""
    return traces.groupBy("step").agg(F.count("*").alias("traces"), F.avg("exact").alias("exact"), F.avg("approximate").alias("approximate"), F.avg("abs_error").alias("abs_error"), F.avg("relative_error").alias("relative_error"))


def bit_length_histogram(deltas: DataFrame) -> DataFrame:
    """bit_length, cnt and the cumulative per cent; at most one row per length."""
    counts = deltas.groupBy("bit_length").agg(F.count("*").alias("cnt"))
    upto, everything = Window.orderBy("bit_length"), Window.partitionBy()
    return counts.withColumn("cumulative_pct", 100.0 * F.sum("cnt").over(upto) / F.sum("cnt").over(everything))


def lower_bound(histogram: dict[int, int]) -> float:
    """Bits that no tier code can save: payloads and the entropy of the lengths."""
    total = sum(histogram.values())
    return sum(b * c for b, c in histogram.items()) + sum(c * math.log2(total / c) for c in histogram.values() if c)


def best_tiers(histogram: dict[int, int], tiers: int, prefix_bits: int | None) -> tuple[int, list[int]]:
    """Least bits with ``tiers`` payload widths, and the widths; unary prefixes if ``prefix_bits`` is None.

    Dynamic programming over distinct lengths, a tier being a stretch of them.
    """
    lengths = sorted(histogram)
    upto = np.concatenate([[0], np.cumsum([histogram[b] for b in lengths])])
    n = len(lengths)
    if not 1 <= tiers <= n:
        raise ValueError("there must be between one tier and one per distinct length")
    widths = np.array(lengths)
    best = np.full(n + 1, np.inf)
    best[0] = 0
    choices = []
    for t in range(tiers):
        prefix = t + 1 if prefix_bits is None else prefix_bits
        following, back = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int)
        for j in range(1, n + 1):
            cost = best[:j] + (prefix + widths[j - 1]) * (upto[j] - upto[:j])
            back[j] = int(cost.argmin())
            following[j] = cost[back[j]]
        best = following
        choices.append(back)
    at, found = n, []
    for back in reversed(choices):
        found.append(lengths[at - 1])
        at = back[at]
    return int(best[n]), found[::-1]


def plans(histogram: dict[int, int], most_unary: int = 32, most_prefix_bits: int = 6) -> list[dict]:
    """The best plan for every prefix kind and number of tiers."""
    n, total, least = len(histogram), sum(histogram.values()), lower_bound(histogram)
    kinds = [(None, min(most_unary, n)), *((p, min(1 << p, n)) for p in range(1, most_prefix_bits + 1))]
    out = []
    for prefix, limit in kinds:
        for tiers in range(1, limit + 1):
            bits, widths = best_tiers(histogram, tiers, prefix)
            out.append({"mode": "unary" if prefix is None else "fixed", "prefix_bits": prefix or 0, "tiers": tiers, "total_bits": bits, "overhead_pct": 100.0 * (bits / least - 1) if least else 0.0, "bits_per_delta": bits / total, "widths": widths})
    return out


def knee(family: list[dict], least_gain_pct: float) -> dict:
    """The last plan of one prefix kind before another tier gains less than ``least_gain_pct`` per cent."""
    ordered = sorted(family, key=lambda p: p["tiers"])
    for a, b in zip(ordered, ordered[1:], strict=False):
        if a["total_bits"] <= 0 or 100.0 * (a["total_bits"] - b["total_bits"]) / a["total_bits"] < least_gain_pct:
            return a
    return ordered[-1]


def simplest_good(found: list[dict], histogram: dict[int, int], penalty_pct: float) -> dict:
    """The plan with the least bits after a penalty per tier, in per cent of the lower bound."""
    each = lower_bound(histogram) * penalty_pct / 100
    return min(found, key=lambda p: p["total_bits"] + each * p["tiers"])


def tier_plans(spark: SparkSession, histogram: dict[int, int]) -> DataFrame:
    """All plans as a table; the histogram has one entry per bit length."""
    rows = [(p["mode"], p["prefix_bits"], p["tiers"], p["total_bits"], p["overhead_pct"], p["bits_per_delta"], p["widths"]) for p in plans(histogram)]
    return spark.createDataFrame(rows, "mode string, prefix_bits int, tiers int, total_bits long, overhead_pct double, bits_per_delta double, widths array<int>")
