"""The native store: Parquet tables of bases and rows, and a small metadata file.

Rows are sorted by block, so that a row number or a range of them reads only the files and
row groups whose statistics cover its block.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from bitloom.errors import StorageError
from bitloom.operators.basetable import Layout
from bitloom.operators.normalize import Options
from bitloom.plans.compress import Compressed, Plan
from bitloom.schema import DatasetInfo
from bitloom.sources.containers import read_file, write_file


def save(c: Compressed, path: str) -> None:
    """Write a compressed table below ``path``; the metadata come last, so a broken write is no store."""
    spark = c.rows.sparkSession
    path = path.rstrip("/")
    c.bases.write.mode("overwrite").parquet(f"{path}/bases")
    c.rows.repartitionByRange("block_id").sortWithinPartitions("row_idx").write.mode("overwrite").parquet(f"{path}/rows")
    if c.condensed is not None:
        c.condensed.write.mode("overwrite").parquet(f"{path}/condensed")
    plan = {k: v for k, v in asdict(c.plan).items() if k != "counter"}
    meta = {"info": c.info.to_dict(), "states": c.layout.states, "selected": c.layout.selected, "n_bases": c.n_bases, "order": c.order, "plan": plan, "condensed": c.condensed is not None}
    write_file(spark, f"{path}/meta.json", json.dumps(meta).encode())


def load(spark: SparkSession, path: str) -> Compressed:
    path = path.rstrip("/")
    try:
        meta = json.loads(read_file(spark, f"{path}/meta.json"))
    except Exception as e:
        raise StorageError(f"{path} is no store: {e}") from e
    plan = Plan(**{**meta["plan"], "options": Options(**meta["plan"]["options"])})
    condensed = spark.read.parquet(f"{path}/condensed") if meta["condensed"] else None
    return Compressed(DatasetInfo.from_dict(meta["info"]), Layout(tuple(meta["states"]), tuple(meta["selected"])), spark.read.parquet(f"{path}/bases"), spark.read.parquet(f"{path}/rows"), meta["n_bases"], plan, meta["order"], condensed)


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV files with a header; one file if ``single``, for results that fit a task."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def write_analytics(c: Compressed, path: str) -> None:
    """Weight and columns of the condensed rows."""
    write_csv(c.analytics(), path, True)


def coerce_extension(path: str, extension: str) -> str:
    """``path`` with the extension of its kind."""
    stem, dot, suffix = path.rpartition(".")
    if dot and suffix.lower() == extension:
        return path
    return f"{stem if dot and '/' not in suffix else path}.{extension}"


def numbered(path: str, taken) -> str:
    """``path``, or with _1, _2 ... before its extension where ``taken(path)`` holds."""
    stem, dot, suffix = path.rpartition(".")
    k, found = 0, path
    while taken(found):
        k += 1
        found = f"{stem}_{k}.{suffix}" if dot else f"{path}_{k}"
    return found
