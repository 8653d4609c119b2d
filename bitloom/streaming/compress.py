"""Compressing a stream: each micro-batch is appended to a store with a layout found before."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from bitloom.operators.normalize import encode
from bitloom.operators.ordered import with_position
from bitloom.plans.compress import Compressed, compress_batch


def start(stream: DataFrame, first: Compressed, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write a stream of the table's columns below ``path``, a folder per batch; a batch that is run again replaces its folder.

    The layout is frozen: values that pass a feature's width, or change a constant bit, fail
    the batch, and a new layout has to be chosen.
    """

    def write(batch: DataFrame, number: int) -> None:
        if not batch.head(1):
            return
        features = first.info.features
        rows = batch.select(*[encode(F.col(f"`{f.name}`"), f).alias(f.name) for f in features])
        wide = [F.max((F.col(f"`{f.name}`") < 0) | (F.col(f"`{f.name}`") > f.mask)) for f in features if f.bits < 64]
        if wide and any(rows.agg(*[w.alias(f"w{i}") for i, w in enumerate(wide)]).first()):
            raise ValueError(f"batch {number} holds values that the frozen layout is too narrow for")
        found = compress_batch(with_position(rows, [], "row_idx"), first.info, first.layout, first.plan)
        found.bases.write.mode("overwrite").parquet(f"{path}/batch={number}/bases")
        found.rows.write.mode("overwrite").parquet(f"{path}/batch={number}/rows")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
