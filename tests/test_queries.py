"""Every query that has SQL is compared with it over whole tables."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from bitloom import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sf_dir, oracle, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    assert found or name == "constant_bits_events"
    if name not in catalog.ORACLE_SQL:
        return
    result = oracle.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)
    assert found == expected


def _same_as_sql(spark, folder, name, events):
    """A query over an ``events`` table of (event_id, user_id, value), compared with its SQL."""
    spark.createDataFrame(events, "event_id long, user_id long, value double").coalesce(1).write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    result = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(tuple(r[n] for n in names) for r in catalog.QUERIES[name](spark, str(folder)).collect()) == sorted(result.fetchall())


@pytest.mark.parametrize("name", ["base_table_sorted_events", "huffman_total_bits_events", "delta_roundtrip_keys"])
def test_no_base_bit_varies(spark, tmp_path, name):
    """Users so far apart that the first bits of the entropy order are all constant."""
    _same_as_sql(spark, tmp_path, name, [(i, 65536 * (i % 2), 1.5) for i in range(4)])


def test_total_bits_of_long_codes(spark, tmp_path):
    """Counts that grow like Fibonacci numbers give codes longer than a container's."""
    counts = [1, 1]
    while len(counts) < 27:
        counts.append(counts[-1] + counts[-2])
    users = np.repeat(np.arange(27), counts)
    # 9 bits are constant and the 5 of the users come next, as those of the values are balanced
    pd.DataFrame({"event_id": np.arange(len(users)), "user_id": users, "value": np.arange(len(users)) % 4 / 100}).to_parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    found = catalog.QUERIES["huffman_total_bits_events"](spark, str(tmp_path)).collect()
    assert found[0]["symbols"] == 27 and [tuple(r) for r in found] == con.execute(catalog.ORACLE_SQL["huffman_total_bits_events"]).fetchall()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "entropy" in df.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
