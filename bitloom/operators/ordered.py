"""Positions, running totals and neighbours over a global order, without a window in one task."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_ROW_BITS = 33
_made: list[str] = []
_path_of: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which executors and driver share.

    Where the setting is missing, a session on one machine gets a temporary folder; on a cluster
    it is an error, as executors and driver would write to different disks.
    """
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append(f"file://{tempfile.mkdtemp(prefix='bitloom-')}")
    return _local[0]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    _made.append(f"{shared_folder(spark)}/bitloom/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def _delete(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True))


def clear_scratch(spark: SparkSession, after: int = 0, keep: DataFrame | None = None) -> int:
    """Delete the scratch tables this process has made since mark ``after``, but for ``keep``; returns how many.

    No frame may be read from them any more.
    """
    kept = [p for p in _made[after:] if keep is not None and p == _path_of.get(keep)]
    gone = [p for p in _made[after:] if p not in kept]
    _made[after:] = kept
    return sum(_delete(spark, p) for p in gone)


def scratch_mark() -> int:
    """How many scratch tables there are: a mark for :func:`clear_scratch`."""
    return len(_made)


def release(*frames: DataFrame) -> None:
    """Delete the tables of frames that :func:`settle` made, once nothing is read from them any more."""
    for frame in frames:
        if path := _path_of.pop(frame, None):
            _made.remove(path)
            _delete(frame.sparkSession, path)


def settle(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table and read again; cuts the lineage and fixes what is not repeatable."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _path_of[out] = path
    return out


def _offsets(placed: DataFrame, amount: Column, start: int) -> DataFrame:
    """For each partition number what the ones before it add up to: a row per partition."""
    totals = sorted((r["p"], r["t"]) for r in placed.groupBy(F.shiftright("_at", _ROW_BITS).alias("p")).agg(F.sum(amount).alias("t")).collect())
    rows, run = [], start
    for p, t in totals:
        rows.append((p, run))
        run += t or 0
    return placed.sparkSession.createDataFrame(rows, "_p long, _before long")


def with_position(df: DataFrame, order: list[Column], name: str, start: int = 0) -> DataFrame:
    """``df`` with a dense number by the order: ranges are sorted apart, and each adds the sizes of those before it.

    Without an order, rows are numbered as they are scanned.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    placed = settle(ordered.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    before = F.broadcast(_offsets(placed, F.lit(1).cast("bigint"), start))
    local = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return placed.join(before, F.shiftright("_at", _ROW_BITS) == F.col("_p")).withColumn(name, local + F.col("_before")).drop("_at", "_p", "_before")


def with_running_total(df: DataFrame, position: str, value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before, by a dense ``position``: within blocks, then over block totals.

    Sums of decimals stay exact, up to 38 digits.
    """
    from pyspark.sql import Window

    block = F.shiftright(position, 12)
    totals = df.groupBy(block.alias("_b")).agg(F.sum(value).alias("_t"))
    groups = totals.groupBy(F.shiftright("_b", 12).alias("_g")).agg(F.sum("_t").alias("_gt"))
    # a group holds 16 million rows, so this last order is short
    groups = groups.withColumn("_before_g", F.coalesce(F.sum("_gt").over(Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = totals.withColumn("_g", F.shiftright("_b", 12)).withColumn("_before_b", F.coalesce(F.sum("_t").over(Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = inside.join(groups.select("_g", "_before_g"), "_g").select("_b", (F.col("_before_g") + F.col("_before_b")).alias("_before"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_b").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("_b", block).withColumn("_own", own).join(before, "_b").withColumn(name, (F.col("_before") + F.col("_own")).cast("decimal(38,0)" if dict(df.dtypes)[value].startswith("decimal") else "bigint")).drop("_b", "_own", "_before")


def with_previous(df: DataFrame, position: str, columns: list[str], prefix: str = "prev_") -> DataFrame:
    """``df`` with the columns of the row one position before, by an equi-join instead of a global lag."""
    moved = df.select((F.col(position) + 1).alias(position), *[F.col(c).alias(prefix + c) for c in columns])
    return df.join(moved, position, "left")
