"""Entropy of every bit position, constant bits, and the orders bits are tried in."""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from bitloom.functions.bits import bit
from bitloom.schema import DatasetInfo


@dataclass(frozen=True)
class BitScore:
    """How often a bit is set among ``n`` rows."""

    bit: int
    ones: int
    n: int

    @property
    def entropy(self) -> float:
        return binary_entropy(self.ones, self.n)

    @property
    def constant(self) -> bool:
        return self.ones in (0, self.n)

    @property
    def rank(self) -> tuple[int, int]:
        """Sorts by entropy without comparing floats, ties by position."""
        return min(self.ones, self.n - self.ones), self.bit


def binary_entropy(ones: int, n: int) -> float:
    if n == 0 or ones in (0, n):
        return 0.0
    p = ones / n
    return -p * math.log2(p) - (1 - p) * math.log2(1 - p)


def bit_scores(rows: DataFrame, info: DatasetInfo) -> list[BitScore]:
    """Set-bit counts of all positions in one aggregation; the result has one number per bit."""
    counts = rows.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(bit(info, b)), F.lit(0)).alias(f"b{b}") for b in range(info.chunk_size)]).first()
    return [BitScore(b, counts[f"b{b}"], counts["n"]) for b in range(info.chunk_size)]


def as_table(spark: SparkSession, scores: list[BitScore], info: DatasetInfo) -> DataFrame:
    """A row per bit: position, column, local bit, ones, n, entropy."""
    return spark.createDataFrame([(s.bit, *info.place(s.bit), s.ones, s.n, s.entropy) for s in scores], "bit int, feature string, local_bit int, ones long, n long, entropy double")


def constant_bits(scores: list[BitScore]) -> tuple[list[int], list[int]]:
    """Positions that are 0, and that are 1, in all rows."""
    return [s.bit for s in scores if s.ones == 0 and s.n], [s.bit for s in scores if s.ones == s.n and s.n]


def still_constant(extra: DataFrame, info: DatasetInfo, zeros: list[int], ones: list[int]) -> tuple[list[int], list[int]]:
    """Of the constant positions those that rows added later keep constant."""
    if not zeros + ones:
        return [], []
    low_high = extra.agg(*[a for b in zeros + ones for a in (F.min(bit(info, b)), F.max(bit(info, b)))]).first()
    seen = {b: (low_high[2 * i], low_high[2 * i + 1]) for i, b in enumerate(zeros + ones)}
    return [b for b in zeros if seen[b][1] in (0, None)], [b for b in ones if seen[b][0] in (1, None)]


def entropy_order(scores: list[BitScore]) -> list[int]:
    """Positions by ascending entropy, ties by position; constants come first."""
    return [s.bit for s in sorted(scores, key=lambda s: s.rank)]


def feature_order(scores: list[BitScore], info: DatasetInfo) -> list[int]:
    """Constants first; then again and again, of each feature's highest bit left, the one with most entropy (ties: the larger position)."""
    first = [s.bit for s in scores if s.constant]
    left = {}
    for s in scores:
        if not s.constant:
            left.setdefault(info.feature_of(s.bit), []).append(s)
    heap = [(-min(x.ones, x.n - x.ones), -x.bit, f) for f, found in left.items() if (x := found[-1])]
    heapq.heapify(heap)
    out = []
    while heap:
        _, negative, f = heapq.heappop(heap)
        out.append(-negative)
        left[f].pop()
        if left[f]:
            x = left[f][-1]
            heapq.heappush(heap, (-min(x.ones, x.n - x.ones), -x.bit, f))
    return first + out
