"""Corpus pipeline: quality rules, near duplicates, personal data, mixing, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's ``docs``.  All
but the last return the columns of ``documents``.  Each stage works on all its
predecessor kept, and its decisions take effect:

* quality: rejected documents go, and frequent lines go from the others' texts (lines that more
  than 20 near copies share count as frequent; a text keeps 30 % of its words or goes);
* near_duplicates: of each group of linked documents the one with the smallest id stays;
* pii: personal data is replaced by its kind;
* mixing: every document is drawn at least once, and those of small sources again, up to
  the repetition limit, so that the sources' shares of tokens meet the weights;
* packing: pieces of up to 2048 tokens, placed in sequences.  A document drawn twice is
  packed twice.

Edge cases (nulls, empty and very long texts, repeated rows, empty tables, more columns)
are the operators'; see their modules.  ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bitloom.llm.common import clear_scratch, scratch_mark, settle
from bitloom.llm.jaccard import one_of_each
from bitloom.llm.mixing import mix
from bitloom.llm.packing import pack_documents
from bitloom.llm.pii import redact
from bitloom.llm.quality import clean

#: Most often a document is drawn by the mixing stage, on average over its source.
MAX_EPOCHS = 1.25


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(clean(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(redact(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs, target_entropy=None, max_epochs=MAX_EPOCHS, budget_times=None).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("pii", pii), ("mixing", mixing), ("packing", packing)]

#: Token ids, hashed permutations and the packing order can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``.  Once a stage is written, the scratch tables made until then go."""
    docs, mark = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch_mark()
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
        clear_scratch(spark, mark, keep=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
