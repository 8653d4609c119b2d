"""The corpus pipeline, stage by stage, against what the operators' brute-force versions keep."""

import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from bitloom.llm.common import settle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = settle(stage(spark, docs, sf_dir), f"test-{name}")
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "pii", "mixing", "packing"]
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name].columns == stages["documents"].columns
        assert stages[name].where("n_chars != length(text)").count() == 0


def test_quality_keeps_what_passes(stages):
    from tests.llm.test_operators import _brute_stats

    kept = {r["doc_id"] for r in stages["quality"].collect()}
    for r in stages["documents"].collect():
        n, _, _, _, repeated = _brute_stats(r["text"])
        if n < 20 or 100 * repeated > 30 * n:
            assert r["doc_id"] not in kept
        elif r["doc_id"] not in kept:
            pytest.fail(f"document {r['doc_id']} was lost")


def test_one_of_each_group_stays(stages):
    from tests.llm.test_operators import _brute_components

    groups = _brute_components({r["doc_id"]: r["text"] for r in stages["quality"].collect()})
    assert sorted(r["doc_id"] for r in stages["near_duplicates"].collect()) == sorted(k for k, (_, c) in groups.items() if c == k)


def test_personal_data_is_gone_and_nothing_else(stages):
    from tests.llm.test_operators import _base_spans

    before = {r["doc_id"]: r["text"] for r in stages["near_duplicates"].collect()}
    for r in stages["pii"].collect():
        assert _base_spans(r["text"]) == ""
        if not re.search(r"<(EMAIL|IP|CARD|PHONE|IBAN|SECRET|NATIONAL_ID)>", r["text"]):
            assert r["text"] == before[r["doc_id"]]
    assert stages["pii"].count() == len(before)


def test_mixing_draws_everything_at_least_once(stages):
    drawn = stages["mixing"]
    assert drawn.select("doc_id").distinct().count() == stages["pii"].count() <= drawn.count()
    assert drawn.select("doc_id", "text").distinct().exceptAll(stages["pii"].select("doc_id", "text")).count() == 0


def test_everything_is_packed(stages):
    packed = stages["packing"]
    draws = {r["doc_id"]: r["count"] for r in stages["mixing"].groupBy("doc_id").count().collect()}
    firsts = {r["doc_id"]: r["count"] for r in packed.where("piece = 0").groupBy("doc_id").count().collect()}
    assert firsts == draws
    fill = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert fill.where("n > 2048 OR n != end").count() == 0


def test_run_gives_the_stages_rows(spark, sf_dir, stages):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert corpus_pipeline.run(spark, sf_dir).select(columns).exceptAll(stages["packing"].select(columns)).count() == 0


def test_edges(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "w " * 30, None, None, 60), (3, "x " * 5, "en", "a", 10)]
    rows += [(10, " ".join(f"p{i}" for i in range(50)), "en", "a", None)] * 2
    for n, part in enumerate((rows, [])):
        spark.createDataFrame(part, DOCS).write.parquet(f"{tmp_path}/{n}/documents.parquet")
        found = corpus_pipeline.run(spark, f"file://{tmp_path}/{n}").collect()
        assert {r["doc_id"] for r in found} == ({10} if part else set())
