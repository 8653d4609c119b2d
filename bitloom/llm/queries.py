"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bitloom.llm.common import remainder, scratch, table


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitloom.llm.fingerprint import fingerprint_with_edits

    return fingerprint_with_edits(table(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitloom.llm.langid import identify, learn

    docs = table(spark, sf_dir, "documents")
    split = docs.withColumn("held_out", remainder("doc_id", 3) == 1)
    model = learn(split.where(~F.col("held_out")))
    return identify(split, model, keep=["doc_id", "held_out"])


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitloom.llm.toxicity import detect, learn

    docs = table(spark, sf_dir, "documents").withColumn("held_out", remainder("doc_id", 4) == 2)
    labels = table(spark, sf_dir, "labels").where(F.col("toxic").isNotNull() & (remainder("doc_id", 4) != 2)).select("doc_id", "toxic")
    model = learn(docs, labels)
    return detect(docs, model, keep=["doc_id", "held_out"]).withColumn("n_sentences", F.size("sentences")).drop("sentences")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitloom.llm.quality import judge

    return judge(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from bitloom.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitloom.llm.pii import digests

    return digests(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitloom.llm.mixing import mix, token_count

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", token_count(F.col("text")).alias("tokens"), "mix_epoch", "mix_block", "mix_place", "mix_weight")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitloom.llm.sharding import ShardStore

    store = ShardStore(spark, scratch(spark, "shards"))
    store.append(table(spark, sf_dir, "documents"))
    store.compact()
    store.vacuum()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitloom.llm.jaccard import link

    return link(table(spark, sf_dir, "documents"))


#: The rules that query op7 judges by before its models do.
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bitloom.llm.urls import Rule, filter_urls

    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), [Rule(*r) for r in URL_RULES])


# what SQL can say of the operators above, over the same whole tables


def op1_fingerprint_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_fingerprint(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def op5_pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def op7_urls_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_urls(spark, sf_dir).select("page_id", "host", "path", "rule")


QUERIES = {
    "op1_fingerprint": op1_fingerprint,
    "op10_langid": op10_langid,
    "op4_toxicity": op4_toxicity,
    "op9_quality": op9_quality,
    "op6_packing": op6_packing,
    "op5_pii": op5_pii,
    "op3_mixing": op3_mixing,
    "op2_sharding": op2_sharding,
    "op8_jaccard": op8_jaccard,
    "op7_urls": op7_urls,
    "op1_fingerprint_texts": op1_fingerprint_texts,
    "op5_pii_counts": op5_pii_counts,
    "op7_urls_rules": op7_urls_rules,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

_TEXTS_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lead(coalesce(text, '')) OVER (ORDER BY doc_id) AS following, first_value(coalesce(text, '')) OVER (ORDER BY doc_id) AS first_text FROM documents),
e AS (SELECT doc_id, t, coalesce(following, first_text) AS following, length(t) // 2 AS k FROM d)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(left(t, length(t) - k) || left(following, k)) AS edited_sha256 FROM e"""

_PII_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS emails, regexp_extract_all(t, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') AS ips,
list_transform(regexp_extract_all(t, '[0-9](?:[\x20-]?[0-9])+'), lambda x: reverse(regexp_replace(x, '[^0-9]', '', 'g'))) AS cards, list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g'))) AS phones FROM d)
SELECT doc_id, CAST(len(emails) AS BIGINT) AS n_email,
CAST(len(list_filter(ips, lambda x: list_max(list_transform(string_split(x, '.'), lambda p: coalesce(try_cast(p AS INTEGER), 999))) <= 255)) AS BIGINT) AS n_ip,
CAST(len(list_filter(cards, lambda x: length(x) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN i % 2 = 0 THEN 2 * CAST(substr(x, CAST(i AS INTEGER), 1) AS INTEGER) // 10 + 2 * CAST(substr(x, CAST(i AS INTEGER), 1) AS INTEGER) % 10 ELSE CAST(substr(x, CAST(i AS INTEGER), 1) AS INTEGER) END)) % 10 = 0)) AS BIGINT) AS n_card,
CAST(len(list_filter(phones, lambda x: x BETWEEN 8 AND 15)) AS BIGINT) AS n_phone FROM m"""

_RULES_SQL = (
    "WITH rules(host, path, pattern) AS (VALUES " + ", ".join("('{0}', '/{1}', '{0}/{1}')".format(*p.split("/", 1)) for _, p in URL_RULES) + "), "
    "p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages), "
    f"q AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p) "
    "SELECT page_id, host, path, (SELECT max_by(r.pattern, length(r.pattern)) FROM rules r WHERE (q.host = r.host OR ends_with(q.host, '.' || r.host)) AND starts_with(q.path, r.path)) AS rule FROM q"
)

_LINKS_SQL = (
    f"WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents), "
    "sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM w)), "
    "sizes AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, '|' ORDER BY s)) AS k FROM sh GROUP BY doc_id), "
    "links AS (SELECT u, v FROM (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL) JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)), "
    "reached AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reached.doc_id, links.v FROM reached JOIN links ON links.u = reached.r) "
    "SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, (SELECT min(r) FROM reached WHERE reached.doc_id = d.doc_id) AS component_id, "
    "CAST(coalesce((SELECT count(*) FROM sizes o WHERE o.k = sizes.k), 0) + CASE WHEN sizes.k IS NULL THEN 1 ELSE 0 END AS BIGINT) AS n_copies, CAST((SELECT count(*) FROM links WHERE u = d.doc_id) AS BIGINT) AS n_links FROM documents d LEFT JOIN sizes USING (doc_id)"
)

_QUALITY_SQL = (
    f"WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents), "
    r"l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w), "
    "windows AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)), "
    "again AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS times FROM windows), range(0, 8) r(k) WHERE times > 1 GROUP BY doc_id), "
    r"lines AS (SELECT doc_id, source, t, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS key FROM (SELECT doc_id, source, t, unnest(l) AS line FROM l)), "
    "frequent AS (SELECT source, key FROM lines GROUP BY source, key HAVING count(DISTINCT t) > 20), "
    "lost AS (SELECT doc_id, sum(length(lines.key) - length(replace(lines.key, ' ', '')) + 1) AS n FROM lines JOIN frequent ON lines.source IS NOT DISTINCT FROM frequent.source AND lines.key = frequent.key GROUP BY doc_id), "
    r"base AS (SELECT l.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS removed_words FROM l LEFT JOIN again USING (doc_id) LEFT JOIN lost USING (doc_id)) "
    "SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - removed_words >= CAST(0.3 AS DOUBLE) * n_words AS kept FROM base"
)

#: The others need hashes, models or searches that SQL doesn't have; tests compare them with brute force.
ORACLE_SQL = {
    "op2_sharding": "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents",
    "op8_jaccard": _LINKS_SQL,
    "op9_quality": _QUALITY_SQL,
    "op1_fingerprint_texts": _TEXTS_SQL,
    "op5_pii_counts": _PII_SQL,
    "op7_urls_rules": _RULES_SQL,
}
