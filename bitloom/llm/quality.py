"""Quality rules: text statistics and cross-document line frequency, in DataFrame functions only.

Base rules fail a document with too few words or too much of its text repeated in
eight-word windows.  The method hashes each document's normalised lines (case,
digits and blanks folded), counts for every host how many distinct documents hold a
line, removes the lines above the limit, and rejects documents of which too little
remains.

Documents are distinct if their texts differ in any character; a document of many copies
counts once.  Near copies count each, so a family of more than ``LINE_DOCUMENTS`` of them
loses the lines that its members have in common: run the near-duplicate stage first where
that isn't wanted.  The limit is absolute, so a line's verdict never turns with more rows.

Edge cases: a null text has no words and fails the base rule; a null host is a host of
its own; a null id changes nothing, as rows are known by host and text; repeated rows count once
and get the same verdict; an empty table gives an empty result; columns with other names
pass through :func:`clean` untouched.  Texts and lines are known by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bitloom.llm.common import join_unique, settle

#: Words are runs of anything but these blanks; the class is the complement of [\x20\x09-\x0D].
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30

#: A line is boilerplate for a host if more than this many distinct documents of the host hold it.
LINE_DOCUMENTS = 20
#: A document is depleted if less than this share of its words remains.
LEAST_LEFT = 0.3


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def normalised(line: Column) -> Column:
    """Lower case, digits as 0, runs of blanks as one, none at the ends; empty if there is no word."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), r"[\x20\x09-\x0D]+", " "))


def has_word(line: Column) -> Column:
    return line.rlike(WORD)


def joined_windows(hashes: Column, width: int) -> Column:
    """From the hashes of all windows of ``width`` words those of all windows of twice as many."""
    n = F.greatest(F.size(hashes) - width, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, 1 + width, n), lambda a, b: F.xxhash64(a, b))


def repeated_words(hashes: Column, n_words: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more; ``hashes`` has one hash per window.

    Windows are sorted by hash, those equal to a neighbour are kept, and their
    positions, sorted, cover min(WINDOW, distance to the next one) words each.
    """
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("int").alias("i"))))
    following = F.concat(F.slice(ordered, 2, F.size(hashes)), F.array(F.lit(None).cast("struct<h:bigint,i:int>")))
    before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), ordered)
    flagged = F.zip_with(F.arrays_zip(ordered.alias("own"), following.alias("next")), before, lambda x, b: F.when((x["own"]["h"] == x["next"]["h"]) | (x["own"]["h"] == b["h"]), x["own"]["i"]))
    starts = F.array_sort(F.filter(flagged, lambda i: i.isNotNull()))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).cast("bigint").alias("covered"), F.lit(-WINDOW).alias("last")),
        lambda acc, i: F.struct((acc["covered"] + F.least(F.lit(WINDOW), i - acc["last"])).cast("bigint").alias("covered"), i.alias("last")),
        lambda acc: acc["covered"],
    )
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(covered)


def base_rules(docs: DataFrame, keep: dict[str, Column], text_col: str = "text") -> DataFrame:
    """Per row: what ``keep`` names, the five base statistics and base_failed.  One pass, no shuffle."""
    rows = docs.select(*[c.alias(name) for name, c in keep.items()], F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.select(*keep, "_text", words(F.col("_text")).alias("_words"), F.filter(F.split("_text", "\n", -1), has_word).alias("_lines"))
    rows = rows.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    rows = rows.select(
        *keep,
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        "_hashes",
    )
    # windows of two, four, then eight words: each step hashes an array with itself moved on
    for width in (1, 2, 4):
        rows = rows.withColumn("_hashes", joined_windows(F.col("_hashes"), width))
    rows = rows.withColumnRenamed("_hashes", "_windows")
    rows = rows.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", repeated_words(F.col("_windows"), F.col("n_words")).alias("n_repeat_words"))
    return rows.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")))


def known_as(text_col: str, host_col: str) -> Column:
    """A hash of a row's host and whole text: rows that share it get the same verdict."""
    host = F.col(host_col).cast("string")
    return F.xxhash64(host.isNull(), F.coalesce(host, F.lit("")), F.coalesce(F.col(text_col), F.lit("")))


def line_table(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """A row for each line with a word: the row's name, a hash of its host, the line's place, key and words; settled, as it is read again."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1), normalised), lambda line: line != "")
    host = F.col(host_col).cast("string")
    rows = docs.select(known_as(text_col, host_col).alias("name"), F.xxhash64(host.isNull(), F.coalesce(host, F.lit(""))).alias("host"), lines.alias("_l"))
    # blanks are single and none is at an end, so words are blanks and one
    found = rows.select("name", "host", F.posexplode("_l").alias("place", "_l"))
    return settle(found.select("name", "host", "place", F.xxhash64("_l").alias("key"), (F.length("_l") - F.length(F.replace("_l", F.lit(" "), F.lit(""))) + 1).alias("n")), "lines")


def frequent_lines(lines: DataFrame, line_documents: int = LINE_DOCUMENTS) -> DataFrame:
    """Host and key of the lines that more than ``line_documents`` distinct documents of the host hold, with their number."""
    held = lines.select("host", "key", "name").distinct()
    return held.groupBy("host", "key").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > line_documents)


def removals(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """For each distinct document that holds frequent lines: name, the removed lines' keys and the words removed; settled.

    Repeated rows share name, place and line, so each line of a document counts once.
    """
    hit = lines.join(frequent.select("host", "key"), ["host", "key"], "left_semi").select("name", "place", "key", "n").distinct()
    return settle(hit.groupBy("name").agg(F.collect_set("key").alias("removed"), F.sum("n").cast("bigint").alias("removed_words")), "removals")


def row_counts(lines: DataFrame) -> DataFrame:
    """How many rows have a name: their first lines are counted."""
    return lines.where("place = 0").groupBy("name").agg(F.count("*").alias("_rows"))


def enough_left(n_words: Column, removed_words: Column) -> Column:
    return n_words - removed_words >= LEAST_LEFT * n_words


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Base statistics, base_failed, removed_words and kept of every row."""
    lines = line_table(docs, text_col, host_col)
    lost = removals(lines, frequent_lines(lines)).select("name", "removed_words")
    base = base_rules(docs, {"doc_id": F.col(id_col), "name": known_as(text_col, host_col)}, text_col)
    joined = join_unique(base, lost, ["name"], row_counts(lines)).drop("name").withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("bigint")))
    return joined.withColumn("kept", ~F.col("base_failed") & enough_left(F.col("n_words"), F.col("removed_words")))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``docs`` without rejected documents and, in the others, without the frequent lines.

    Texts stay where they are if the table of removed lines is small; else they are shuffled once.
    """
    lines = line_table(docs, text_col, host_col)
    lost = removals(lines, frequent_lines(lines))
    rows = base_rules(docs, {"_row": F.struct("*"), "name": known_as(text_col, host_col)}, text_col)
    # a filter isn't pushed below a row number, so the statistics are computed once and not again inside the filter
    rows = rows.withColumn("_at", F.monotonically_increasing_id()).where(~F.col("base_failed") & (F.col("_at") >= 0))
    joined = join_unique(rows, lost, ["name"], row_counts(lines), 8 * F.size("removed")).where(F.col("removed_words").isNull() | enough_left(F.col("n_words"), F.col("removed_words")))
    text = F.col(f"_row.{text_col}")
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda line: ~F.array_contains(F.col("removed"), F.xxhash64(normalised(line)))), "\n")
    return joined.select(*[(F.when(F.col("removed").isNotNull(), left).otherwise(text) if c == text_col else F.col("_row")[c]).alias(c) for c in docs.columns])
