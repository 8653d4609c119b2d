"""What the operators of this subpackage share: scratch tables, partition counts, schemas."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bitloom.operators.ordered import clear_scratch, release, scratch, scratch_mark, settle

__all__ = ["clear_scratch", "freeing", "input_bytes", "join_unique", "partitions", "parts_for", "release", "remainder", "scratch", "scratch_mark", "settle", "small_batches", "table", "text_blocks"]


#: Rows and bytes of a batch where texts or packed shingles go to Python.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}
#: Most partitions that are made on account of the input's size; a shuffle can't serve many more.
MOST_PARTS = 20_000
#: A key of more rows than this is joined by broadcast, unless there could be more than HOT_KEYS such keys.
HOT_ROWS = 1000
HOT_KEYS = 100_000
#: Most bytes that are broadcast to join.
BROADCAST_BYTES = 32 << 20


def release_memory() -> None:
    """Give freed memory back to the system, as a Python worker lives on after its task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def freeing(rows: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A batch function that releases its memory when its task ends."""

    def run(batches):
        yield from rows(batches)
        release_memory()

    return run


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within, jobs hand Python workers batches of the size in BATCHES; both sides hold less memory."""
    before = {k: spark.conf.get(k) for k in BATCHES}
    for k, v in BATCHES.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def text_blocks(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int, list]]:
    """Stretches of a batch (from, to, values of a text column) of about ``most_bytes`` bytes of text, so that few texts are in memory twice."""
    values = batch.column(column)
    upto = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(values):
        before = upto[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(upto, before + most_bytes, side="right")))
        yield at, stop, values.slice(at, stop - at).to_pylist()
        at = stop


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_bytes(df: DataFrame) -> int | None:
    """Bytes of the tables ``df`` reads; None where a source doesn't know its size, as frames made in memory."""
    unknown = df.sparkSession._jsparkSession.sessionState().conf().defaultSizeInBytes()
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]  # joins would multiply estimates
    return None if any(size >= unknown for size in sizes) else sum(sizes)


def parts_for(df: DataFrame, bytes_per_part: int = 16 << 20) -> int:
    """Partitions for work over ``df``: as set for shuffles, and more, up to MOST_PARTS, where the input's size is known and asks for them."""
    wanted = -(-(input_bytes(df) or 0) // bytes_per_part)
    return max(partitions(df.sparkSession), min(wanted, MOST_PARTS))


def join_unique(left: DataFrame, right: DataFrame, on: list[str], weights: DataFrame, row_bytes: Column | None = None) -> DataFrame:
    """``left`` with the columns of ``right`` (one row for each ``on``, whole numbers or strings, never null) where there is one, else nulls.

    ``weights`` has ``on`` and ``_rows``, how many rows of ``left`` have it.  A small ``right`` is
    broadcast.  Else only its keys of many rows are: fewer than HOT_KEYS keys can have more than
    a HOT_KEYS-th of all rows.  Rows that have met theirs are dealt by chance in the shuffle
    that joins the others, so no task gets a hot key.  ``right`` should be settled.
    """
    value = [c for c in right.columns if c not in on]
    cost = F.lit(64) if row_bytes is None else row_bytes + 64
    size = right.agg(F.coalesce(F.sum(cost), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), on, "left")
    limit = max(HOT_ROWS, (weights.agg(F.sum("_rows")).first()[0] or 0) // HOT_KEYS)
    heavy = right.join(weights.where(F.col("_rows") > limit).select(*on), on, "left_semi").withColumn("_hot", F.lit(True))
    if row_bytes is not None:  # the heaviest that fit; a long one goes by shuffle, where adaptive execution splits it
        heavy = heavy.where(cost <= BROADCAST_BYTES // HOT_KEYS)
    heavy = settle(heavy, "hot")
    met = left.join(F.broadcast(heavy), on, "left")
    types = dict(left.dtypes)
    # rows that have met theirs get keys of their own, and are kept from meeting another by the condition
    own = F.coalesce("_hot", F.lit(False))
    met = met.withColumns({f"_on_{c}": F.when(own, F.xxhash64(F.monotonically_increasing_id(), F.lit(i)).cast(types[c])).otherwise(F.col(c)) for i, c in enumerate(on)}).withColumn("_met", own).drop("_hot")
    met = met.withColumnsRenamed({c: f"_met_{c}" for c in value})
    other = right.withColumnsRenamed({c: f"_right_{c}" for c in on} | {c: f"_cold_{c}" for c in value})
    condition = ~F.col("_met")
    for c in on:
        condition = condition & (F.col(f"_on_{c}") == F.col(f"_right_{c}"))
    joined = met.join(other, condition, "left")
    return joined.select(*left.columns, *[F.when(F.col("_met"), F.col(f"_met_{c}")).otherwise(F.col(f"_cold_{c}")).alias(c) for c in value])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id, divisor: int):
    """crc32 of the id as text, modulo ``divisor``: the fixed split into learning and held-out rows."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % divisor
