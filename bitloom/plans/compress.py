"""Compressing a table and getting it back.

Jobs: one aggregation for ranges, one for bit counts, one distinct and sort for the curve,
one aggregation for the base table; everything else is lazy until it is written.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from bitloom.errors import MissingSample
from bitloom.operators import basetable, condense, encode, entropy, normalize, selection
from bitloom.operators.basetable import Layout
from bitloom.operators.distinct import DistinctCounter
from bitloom.operators.ordered import settle, with_position
from bitloom.schema import DatasetInfo
from bitloom.timing import timed

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Plan:
    """Parameters of a compression; the defaults are those for tables."""

    options: normalize.Options = normalize.Options()
    method: str = "adaptive"
    patience: int = 10
    decay: float = 0.5
    threshold: float = 0.1
    m_max: int | None = 30
    in_order: bool = False
    encoding: str = "flat"  # flat, rle or huffman
    delta: str | None = None  # None, unary or fixed; sorts the base table
    counter: DistinctCounter | None = None
    block_rows: int = encode.BLOCK_ROWS
    #: Store the condensed rows behind the data rows, where containers keep them.
    append_condensed: bool = False


@dataclass
class Compressed:
    """A compressed table: bases, encoded rows and what the driver knows about them."""

    info: DatasetInfo
    layout: Layout
    bases: DataFrame
    rows: DataFrame
    n_bases: int
    plan: Plan = field(default_factory=Plan)
    order: list[int] | None = None
    condensed: DataFrame | None = None
    selection: selection.Selection | None = None
    scores: list[entropy.BitScore] | None = None

    def normalized(self, check: bool = False) -> DataFrame:
        return basetable.merge(self.rows, self.info, self.bases, self.n_bases, check)

    def decompress(self, check: bool = False) -> DataFrame:
        """All data rows with their original values."""
        return normalize.reconstruct(self.normalized(check).where(F.col("row_idx") < self.info.n), self.info)

    def rows_at(self, indices: list[int]) -> DataFrame:
        """The rows with these numbers, ascending, repeated as asked; a number out of range is an error.

        The filter on block and row reaches the scan of stored rows, so only their blocks are read.
        """
        if bad := [i for i in indices if not 0 <= i < self.info.n]:
            raise MissingSample(f"no row {bad[0]}; there are {self.info.n}")
        spark = self.rows.sparkSession
        found = self.rows
        if indices:
            blocks = sorted({i // self.plan.block_rows for i in indices})
            found = found.where(F.col("block_id").isin(blocks) & F.col("row_idx").between(min(indices), max(indices)))
        wanted = spark.createDataFrame([(i,) for i in indices], "row_idx long")
        part = Compressed(self.info, self.layout, self.bases, found.join(F.broadcast(wanted), "row_idx"), self.n_bases, self.plan)
        return part.decompress().orderBy("row_idx")

    def rows_between(self, ranges: list[tuple[int, int]]) -> DataFrame:
        """The rows in inclusive ranges, each once."""
        keep = F.lit(False)
        for a, b in ranges:
            if a > b or a < 0 or b >= self.info.n:
                raise MissingSample(f"no rows {a} to {b}; there are {self.info.n}")
            keep = keep | (F.col("block_id").between(a // self.plan.block_rows, b // self.plan.block_rows) & F.col("row_idx").between(a, b))
        return Compressed(self.info, self.layout, self.bases, self.rows.where(keep), self.n_bases, self.plan).decompress()

    def analytics(self) -> DataFrame:
        """Condensed rows in original values, with weights; no stored row is read."""
        if self.condensed is None and self.info.weights:
            spark = self.rows.sparkSession
            weights = spark.createDataFrame([(self.info.n + i, w) for i, w in enumerate(self.info.weights)], "row_idx long, weight long")
            part = Compressed(self.info, self.layout, self.bases, self.rows.where(F.col("row_idx") >= self.info.n), self.n_bases, self.plan)
            return normalize.reconstruct(part.normalized().join(F.broadcast(weights), "row_idx"), self.info, keep=["weight"])
        if self.condensed is None:
            return self.base_samples()
        return normalize.reconstruct(self.condensed, self.info, keep=["weight"])

    def base_samples(self) -> DataFrame:
        """The base patterns in original values, with the number of their rows."""
        return normalize.reconstruct(self.bases.withColumnRenamed("cnt", "weight"), self.info, keep=["weight"])

    def sizes(self) -> selection.Size:
        return selection.size_of(self.info.n, len(self.info.features), self.info.chunk_size, len(self.layout.selected), self.n_bases)


def compress(df: DataFrame, row_idx: str, columns: list[str] | None = None, plan: Plan = Plan()) -> Compressed:
    """Compress the numeric columns of ``df``; ``row_idx`` numbers its rows from 0 without gaps."""
    with timed("normalize"):
        rows, info = normalize.normalize(df, row_idx, columns, plan.options)
        rows = settle(rows, "normalized")
    return compress_normalized(rows, info, plan)


def compress_normalized(rows: DataFrame, info: DatasetInfo, plan: Plan = Plan()) -> Compressed:
    """Compress rows that are unsigned integers already and cheap to read again."""
    with timed("entropy"):
        scores = entropy.bit_scores(rows, info)
    condensed = None
    if plan.m_max is not None:
        with timed("condense"):
            condensed, _ = condense.condense(rows, info, scores, plan.m_max)
    zeros, ones = entropy.constant_bits(scores)
    if condensed is not None and plan.append_condensed:
        condensed = settle(with_position(condensed, [F.col(f"`{f.name}`") for f in info.features], "row_idx", info.n), "condensed")
        rows = settle(rows.unionByName(condensed.drop("weight")), "appended")
        weights = [r["weight"] for r in condensed.orderBy("row_idx").select("weight").collect()]
        info = DatasetInfo(info.features, info.n, weights)
        # scores stay those of the data; constants that a mean has changed are constants no more
        zeros, ones = entropy.still_constant(condensed, info, zeros, ones)
        kept = {*zeros, *ones}
        scores = [s if not s.constant or s.bit in kept else entropy.BitScore(s.bit, abs(s.ones - 1), s.n) for s in scores]
        scores = [entropy.BitScore(s.bit, s.n + len(weights) if s.ones == s.n else s.ones, s.n + len(weights)) for s in scores]
    with timed("select"):
        chosen = selection.select(rows, info, scores, plan.method, plan.patience, plan.threshold, plan.decay, plan.counter)
    layout = Layout.of(info, chosen.bits, zeros, ones)
    with timed("base table"):
        bases, order = basetable.build(rows, info, layout, plan.in_order or plan.delta is not None)
        bases = settle(bases, "bases")
        n_bases = bases.count()
    encoded = basetable.assign(rows, info, layout, bases, n_bases, plan.block_rows)
    return Compressed(info, layout, bases, encoded, n_bases, plan, order, condensed, chosen, scores)


def compress_batch(rows: DataFrame, info: DatasetInfo, layout: Layout, plan: Plan = Plan()) -> Compressed:
    """Compress more rows with a layout found before; values that the layout's constants don't fit are an error."""
    from bitloom.errors import InvalidMetadata

    found = entropy.still_constant(rows, info, layout.positions(basetable.ZERO), layout.positions(basetable.ONE))
    if len(found[0]) + len(found[1]) < len(layout.positions(basetable.ZERO)) + len(layout.positions(basetable.ONE)):
        raise InvalidMetadata("the rows change a bit that the layout holds constant")
    bases = settle(basetable.build(rows, info, layout, plan.in_order)[0], "bases")
    n_bases = bases.count()
    return Compressed(info, layout, bases, basetable.assign(rows, info, layout, bases, n_bases, plan.block_rows), n_bases, plan)
