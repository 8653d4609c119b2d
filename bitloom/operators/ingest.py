"""Scans: tables of any Spark source with a row number, null filling, histograms."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from bitloom.errors import DataLoadError
from bitloom.operators.ordered import settle, with_position

FILLS = ("forward", "backward", "mean", "min", "max", "zero", "one")


def fill_nulls(df: DataFrame, strategy: str, columns: list[str], row_idx: str = "row_idx") -> DataFrame:
    """``df`` with the columns' nulls filled.

    "forward" and "backward" take the nearest value before or behind in row order: first
    within blocks of rows, then over the blocks' ends, so no task sorts all rows.
    """
    if strategy not in FILLS:
        raise DataLoadError(f"no strategy is called {strategy}")
    if strategy in ("zero", "one"):
        return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit(int(strategy == "one")).cast(t)).alias(c) if c in columns else F.col(f"`{c}`") for c, t in df.dtypes])
    if strategy in ("mean", "min", "max"):
        row = df.agg(*[getattr(F, "avg" if strategy == "mean" else strategy)(f"`{c}`").alias(f"v{i}") for i, c in enumerate(columns)]).first()
        kinds = dict(df.dtypes)
        return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit(row[f"v{columns.index(c)}"]).cast(kinds[c])).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])
    block = F.shiftright(row_idx, 16)
    after = strategy == "backward"
    inner = Window.partitionBy("_block").orderBy(F.col(row_idx).desc() if after else F.col(row_idx)).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_block", block)
    # one row per block of 65,536 rows: the block's last value, carried over blocks without any
    pick = F.min_by if after else F.max_by
    ends = rows.groupBy("_block").agg(*[pick(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), F.col(row_idx))).alias(f"_e{i}") for i, c in enumerate(columns)])
    across = Window.orderBy(F.col("_block").desc() if after else F.col("_block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_block", *[F.last(f"_e{i}", True).over(across).alias(f"_c{i}") for i in range(len(columns))])
    filled = rows.withColumns({f"_f{i}": F.last(f"`{c}`", True).over(inner) for i, c in enumerate(columns)}).join(carried, "_block")
    return filled.select(*[F.coalesce(f"_f{columns.index(c)}", f"_c{columns.index(c)}").alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])


@dataclass(frozen=True)
class Source:
    """A table to read: any format Spark reads, CSV with a header by default."""

    path: str
    format: str = "csv"
    options: dict = field(default_factory=dict)

    def load(self, spark: SparkSession) -> DataFrame:
        reader = spark.read.format(self.format)
        if self.format == "csv":
            reader = reader.options(header=True, inferSchema=True)
        try:
            return reader.options(**self.options).load(self.path)
        except Exception as e:
            raise DataLoadError(f"{self.path} can't be read: {e}") from e


def with_row_idx(df: DataFrame, name: str = "row_idx") -> DataFrame:
    """``df`` numbered from 0 without gaps in the order it is scanned."""
    return with_position(df, [], name)


def load_csv(spark: SparkSession, path: str, has_header: bool = True, fill: str | None = None) -> DataFrame:
    """A CSV file with a row number; nulls filled if a strategy is given."""
    df = with_row_idx(Source(path, options={"header": has_header}).load(spark))
    columns = [c for c in df.columns if c != "row_idx"]
    return settle(fill_nulls(df, fill, columns), "filled") if fill else df


def load_histogram(spark: SparkSession, path: str) -> DataFrame:
    """bit_len and count of a CSV file: rows without a positive count go, repeated lengths are added up."""
    df = spark.read.option("header", True).schema("bit_len int, count long").csv(path)
    found = df.where("count > 0").groupBy("bit_len").agg(F.sum("count").alias("count"))
    if not found.head(1):
        raise DataLoadError("the histogram has no positive count")
    return found
