"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and its edge cases."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.llm import common, fingerprint, jaccard, langid, mixing, packing, pii, quality, queries, sharding, toxicity, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and more columns whose names the operators use inside."""
    long_text = "word " * 30_000 + "é" * 50_000 + " 1" * 3_000
    rows = [
        (1, None, None, None, None, "x", 1),
        (2, "", "en", "a", 0, "x", 2),
        (3, " \n\t ", "en", "a", 4, "x", 3),
        (4, long_text, "en", "a", len(long_text), "x", 4),
        (5, "one two three", None, "a", 13, "x", 5),
        (5, "one two three", None, "a", 13, "x", 5),
        (6, "One two THREE", "de", None, 13, "x", 6),
        (None, "one two three four five six", "de", "b", 27, None, None),
        (8, "a b c d e f g h i j " * 40, "fr", "b", 800, "y", 8),
        (9, "a b c d e f g h i j " * 40, "fr", "b", 800, "y", 8),
    ]
    return spark.createDataFrame(rows, f"{DOCS}, sid string, tokens long").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_queries_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    result = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=str) == sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=str)


# 1 fingerprints


def test_fingerprints_brute_force(spark, sf_dir, documents):
    found = {r["doc_id"]: r for r in queries.op1_fingerprint(spark, sf_dir).collect()}
    assert len(found) == len(documents)
    for i, (doc_id, text, *_) in enumerate(documents):
        following = documents[(i + 1) % len(documents)][1]
        cut = len(text) // 2
        changed = text[: len(text) - cut] + following[:cut]
        r = found[doc_id]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == fingerprint.digest(text.encode()) and r["edited_fingerprint"] == fingerprint.digest(changed.encode())
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
    assert sum(r["near_edited"] > r["near_next"] for r in found.values()) >= 0.95 * len(found)


def test_digest_counts_every_triplet():
    data = bytes(random.Random(1).randrange(256) for _ in range(500))
    assert fingerprint.bucket_counts(data).sum() == sum(max(0, len(data) - t[2]) for t in fingerprint.TRIPLETS)
    whole = fingerprint.bucket_counts(data * 10)
    fingerprint._CHUNK, kept = 1000, fingerprint._CHUNK
    try:
        assert (fingerprint.bucket_counts(data * 10) == whole).all()
    finally:
        fingerprint._CHUNK = kept
    assert fingerprint.likeness(fingerprint.digest(b""), fingerprint.digest(b"")) == 1


def test_fingerprint_edges(odd, empty):
    rows = fingerprint.fingerprint_with_edits(odd).collect()
    assert len(rows) == odd.count() and [r["n_chars"] for r in rows if r["doc_id"] == 1] == [0]
    by_text = defaultdict(set)
    for r in rows:
        by_text[r["doc_id"]].add(r["fingerprint"])
    assert len(by_text[5]) == 1
    assert fingerprint.fingerprint_with_edits(empty).count() == 0
    single = fingerprint.fingerprint_with_edits(odd.where("doc_id = 8")).first()
    assert single["near_next"] == 1.0


# 2 sharding


def test_compaction_keeps_rows_and_versions(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=1 << 20, fan_in=3)
    for _ in range(4):
        store.append(docs, shard_rows=40)
    before = store.shards().count()
    assert store.compact() > 3 and store.shards().count() < before
    tiers = {r["tier"]: r["count"] for r in store.shards().where(F.col("bytes") < store.target_bytes // 2).groupBy("tier").count().collect()}
    assert all(n < 3 for n in tiers.values())
    assert store.read().exceptAll(docs.union(docs).union(docs).union(docs)).count() == 0 and store.read().count() == 4 * docs.count()
    assert store.read(0).count() == docs.count()  # old versions stay
    version = store.version()
    assert not store._publish(version, {}) and store.version() == version  # a version is never replaced
    stale = store.shards(0)
    with pytest.raises(sharding.CommitConflict):
        store._commit(store.shards().limit(0).drop("since"), stale, docs.schema, "late merge")
    assert store.vacuum() > 0 and store.read().count() == 4 * docs.count()


def test_sharding_edges(spark, odd, empty, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/e")
    assert store.shards().count() == 0 and store.version() == -1
    store.append(empty)
    assert store.read().count() == 0 and store.read().columns == empty.columns
    other = sharding.ShardStore(spark, f"file://{tmp_path}/o", fan_in=2)
    other.append(odd, shard_rows=2)
    other.compact()
    assert other.read().exceptAll(odd).count() == 0 and other.read().count() == odd.count()


# 3 mixing


def _brute_mix(rows, alpha, times, seed=0):
    """(source, epoch, doc) draws by sorting each source's permutation; units from Spark's own hash."""
    total = sum(t for _, _, t, _ in rows)
    by_source = defaultdict(list)
    for doc, source, tokens, unit in rows:
        by_source[source].append((doc, tokens, unit))
    norm = sum((sum(t for _, t, _ in v) / total) ** alpha for v in by_source.values())
    draws = set()
    for source, v in by_source.items():
        own = sum(t for _, t, _ in v)
        epochs = times * (own / total) ** alpha / norm * total / own
        whole = int(epochs + 1e-9)
        draws |= {(source, e, d) for e in range(whole) for d, _, _ in v}
        quota, run = (epochs - whole) * own, 0
        for d, t, u in sorted(v, key=lambda x: x[2](whole)):
            run += t
            if run > quota:
                break
            draws.add((source, whole, d))
    return draws


def test_mixing_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, "big").when(F.col("doc_id") % 3 == 1, F.concat(F.lit("s"), F.col("doc_id") % 5)).alias("source"))
    found = mixing.mix(docs, target_entropy=0.9, max_epochs=3.0)
    rows = docs.select("doc_id", F.coalesce("source", F.lit("none")).alias("s"), mixing.token_count(F.col("text")).alias("t"), *[mixing._unit(F.col("doc_id"), F.lit(e), F.lit(0)).alias(f"u{e}") for e in range(4)]).collect()
    totals = Counter()
    for r in rows:
        totals[r["s"]] += r["t"]
    shares = spark.createDataFrame([(v / sum(totals.values()),) for v in totals.values()], "share double")
    solved = mixing.solve(shares, len(totals), 0.9, 3.0, 1.0)
    weights = {r["s"]: r["w"] for r in found.select(F.coalesce("source", F.lit("none")).alias("s"), F.col("mix_weight").alias("w")).distinct().collect()}
    assert abs(sum(weights.values()) - 1) < 1e-9
    entropy = -sum(w * math.log(w) for w in weights.values())
    assert entropy >= 0.9 * math.log(len(totals)) - 1e-9 or solved["epochs"] >= 3.0 - 1e-6
    assert solved["epochs"] <= 3.0 + 1e-9
    unit = lambda r: lambda e: r[f"u{e}"]
    expected = _brute_mix([(r["doc_id"], r["s"], r["t"], unit(r)) for r in rows], solved["alpha"], 1.0)
    got = {(r["s"], r["mix_epoch"], r["doc_id"]) for r in found.select(F.coalesce("source", F.lit("none")).alias("s"), "mix_epoch", "doc_id").collect()}
    assert got == expected


def test_mixing_covers_every_document_within_the_limit(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 10 < 7, "big").otherwise(F.concat(F.lit("s"), F.col("doc_id") % 4)))
    found = mixing.mix(docs, target_entropy=None, max_epochs=1.5, budget_times=None)
    assert found.select("doc_id").distinct().count() == docs.count()
    assert found.agg(F.max("mix_epoch")).first()[0] == 1 and found.count() > docs.count()
    big = found.where("source = 'big'")
    assert big.count() == docs.where("source = 'big'").count()


def test_mixing_edges(odd, empty):
    found = mixing.mix(odd, target_entropy=None, max_epochs=2.0, budget_times=None)
    assert set(odd.columns) < set(found.columns) and found.where("doc_id = 1").count() >= 1
    assert found.where("doc_id = 5").count() % 2 == 0
    assert mixing.mix(empty).count() == 0


# 4 toxicity


def test_toxicity_is_learned_and_located(spark):
    rng = random.Random(4)
    words, bad = [f"{a}{b}" for a in "bcdfg" for b in ("alo", "emi", "uri", "ona")], ["vilex", "gruncha"]
    rows, labels = [], []
    for i in range(700):
        sentences = [" ".join(rng.choice(words) for _ in range(6)) for _ in range(rng.randint(1, 8))]
        toxic = i % 5 == 0
        if toxic:
            k = rng.randrange(len(sentences))
            sentences[k] += f" {rng.choice(bad)}{rng.choice('stq')}"
        rows.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    held = F.col("doc_id") % 4 == 2
    model = toxicity.learn(docs.where(~held), marks.where(~held))
    found = {r["doc_id"]: r for r in toxicity.detect(docs, model, ["doc_id"]).collect()}
    texts, truth = dict(rows), dict(labels)
    wrong = [i for i in truth if i % 4 == 2 and found[i]["predicted"] != truth[i]]
    assert len(wrong) <= 5
    for i, r in found.items():
        for s in r["sentences"]:
            assert any(b in texts[i][s["start"] : s["end"]] for b in bad)


def test_toxicity_on_the_tables(spark, sf_dir, documents):
    found = {r["doc_id"]: r for r in queries.op4_toxicity(spark, sf_dir).collect()}
    assert len(found) == len(documents)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for i, r in found.items())


def test_toxicity_query_brute_force(spark, sf_dir, documents, monkeypatch):
    """Every document's score is the noisy-or of its sentences under the weights that were learned, and a long text doesn't end the sample."""
    kept, original = {}, toxicity.fit

    def fit(texts, labels):
        kept["model"], kept["texts"] = original(texts, labels), texts
        return kept["model"]

    monkeypatch.setattr(toxicity, "fit", fit)
    longest = max(len(d[1]) for d in documents if zlib.crc32(str(d[0]).encode()) % 4 != 2)
    monkeypatch.setattr(toxicity, "TRAIN_CHARS", 40 * longest // 2)
    found = {r["doc_id"]: r for r in queries.op4_toxicity(spark, sf_dir).collect()}
    weights, bias = kept["model"]["weights"], kept["model"]["bias"]
    assert kept["texts"] and sum(map(len, kept["texts"])) <= toxicity.TRAIN_CHARS
    learnt = {d[1] for d in documents if zlib.crc32(str(d[0]).encode()) % 4 != 2}
    assert all(t in learnt for t in kept["texts"])
    for doc_id, text, *_ in documents:
        none_toxic = 1.0
        parts = [set(w) for x in re.split(r"[.!?\n]+", text) if (w := re.findall(r"[^\W\d_]+", x.lower()))]
        for words in parts or [set()]:
            z = bias + sum(weights.get(f"{w}$", 0.0) + sum(weights.get(w[:n], 0.0) for n in range(3, min(9, len(w)) + 1)) for w in words)
            none_toxic *= 1 - 1 / (1 + math.exp(-max(-500, min(500, z))))
        assert abs(found[doc_id]["score"] - (1 - none_toxic)) < 1e-6 and found[doc_id]["n_sentences"] <= max(1, len(parts))


def test_toxicity_edges(spark, odd, empty):
    marks = spark.createDataFrame([(1, 1), (2, 0), (5, None), (4, 0)], "doc_id long, toxic int")
    model = toxicity.learn(odd, marks)
    rows = toxicity.detect(odd, model, ["doc_id"]).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    nothing = toxicity.learn(empty, marks)
    assert all(r["score"] < 0.01 and not r["predicted"] for r in toxicity.detect(odd, nothing, ["doc_id"]).collect())
    assert toxicity.detect(empty, model, ["doc_id"]).count() == 0


# 5 personal data


def _base_spans(text):
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", m))
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in out)


def test_base_spans_on_random_texts(spark):
    rng = random.Random(1)
    parts = ["a", "b", ".", "@", "-", "_", "%", "+", "1", "4", "255", "300", "0", " ", "(", ")", "4111111111111111", "x.y", "a@b.c", "1.2.3.4", "+1 (017) 555-7713", "\n", "é", "DE89370400440532013000 "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += [None, "", "1" * 20_000, "a" * 30_000 + "@", ".1" * 20_000, "a." * 30_000, "x@" + "a.b" * 20_000, "+1" + " 2" * 20_000]
    rows = pii.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = _base_spans(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        kinds = Counter(s.split(":")[0] for s in base.split(",") if s)
        assert [r[f"n_{k}"] for k in pii.BASE] == [kinds[k] for k in pii.BASE] and r["spans"].startswith(base)


def test_added_kinds_and_redaction(spark):
    texts = {
        1: "pay to IBAN DE89370400440532013000 now",
        2: "pay to IBAN DE89370400440532013001 now",  # wrong check digits
        3: 'token = "0123456789abcdef0123456789"',
        4: "a word 0123456789abcdef0123456789 alone",  # no context
        5: "his social security number is 123-45-6789",
        6: "item 123-45-6789",
        7: "mail a@b.co and c@d.ef or +1 (017) 555-7713.",
    }
    docs = spark.createDataFrame([(k, v, "keep") for k, v in texts.items()], "doc_id long, text string, pii_email string")
    spans = {r["doc_id"]: r["spans"] for r in pii.digests(docs).collect()}
    assert spans[1].startswith("iban:12:") and spans[3].startswith("secret:9:") and spans[5].startswith("national_id:")
    assert spans[2] == spans[4] == spans[6] == ""
    clean = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert clean[7]["text"] == "mail <EMAIL> and <EMAIL> or <PHONE>." and clean[1]["text"] == "pay to IBAN <IBAN> now"
    assert clean[6]["text"] == texts[6] and clean[7]["pii_email"] == "keep"


def test_context_counts_on_both_sides(spark):
    texts = ["123-45-6789 is the social security number", "a b 123-45-6789 c d", "number 123-45-6789, and a long way on, far beyond all context, ssn", "DE89370400440532013000"]
    spans = [r["spans"] for r in pii.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert spans == ["national_id:0:11", "", "", "iban:0:22"]


def test_very_many_matches_in_one_text(spark):
    """100,000 matches in a text, of base and added kinds, found and replaced in seconds."""
    email = " ".join(f"é{i}@b{i % 7}.co" for i in range(100_000))
    mixed = " ".join(["a@b.co ssn 123-45-6789 1.2.3.4 é"] * 20_000)
    docs = spark.createDataFrame([(1, email), (2, mixed)], "doc_id long, text string").coalesce(1)
    began = time.time()
    found = {r["doc_id"]: r for r in pii.digests(docs).collect()}
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert time.time() - began < 60
    base = _base_spans(email)
    assert found[1]["n_email"] == 100_000 and found[1]["spans"] == base and found[1]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    assert found[2]["n_email"] == found[2]["n_ip"] == found[2]["spans"].count("national_id") == 20_000
    assert clean[1] == " ".join(["é<EMAIL>"] * 100_000) and clean[2] == " ".join(["<EMAIL> ssn <NATIONAL_ID> <IP> é"] * 20_000)


def test_redaction_brute_force(spark, monkeypatch):
    """Overlapping spans, texts longer than a block, matches on the blocks' borders."""
    rng = random.Random(11)
    parts = ["a@b.co", "+1 (017) 555-7713", "4111111111111111", "1.2.3.4", "x", "é😀", "\n", " ", " card ", "+1.2.3.4", "DE89370400440532013000", "password: 0123456789abcdef0123456789"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", "", "y" * rng.choice([1, 300, 2040])]) for _ in range(rng.choice([0, 3, 60, 700]))) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r["doc_id"]: [(int(a), int(b), k) for k, a, b in (x.split(":") for x in r["spans"].split(",") if x)] for r in pii.digests(docs).collect()}
    for r in pii.redact(docs).collect():
        text, at, out = texts[r["doc_id"]], 0, ""
        for a, b, k in sorted(spans[r["doc_id"]]):
            if a >= at:
                out += f"{text[at:a]}<{k.upper()}>"
            at = max(at, b)
        assert r["text"] == out + text[at:]
        base = [x for x in spans[r["doc_id"]] if x[2] in pii.BASE]
        assert not any(a < d and c < b for a, b, k in spans[r["doc_id"]] if k not in pii.BASE for c, d, _ in base)


def test_pii_edges(odd, empty):
    assert pii.redact(odd).columns == odd.columns and pii.redact(odd).count() == odd.count()
    assert pii.redact(odd).where("doc_id = 1").first()["text"] is None
    assert pii.digests(empty).count() == 0


# 6 packing


def test_packing_round_trip(spark, sf_dir, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = {}
    for doc_id, text, *_ in documents:
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            expected[doc_id, k // 2048] = (k, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()))
    rows = queries.op6_packing(spark, sf_dir).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == expected and len(rows) == len(expected)
    _check_sequences(rows, 2048)
    assert len({r["sequence_id"] for r in rows}) <= -(-sum(r["length"] for r in rows) // 2048) * 1.05 + 3


def _check_sequences(rows, capacity):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity


def test_words_are_encoded_as_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, words = Tokenizer.from_file(path), packing.WordEncoder(path)
    rng = random.Random(2)
    parts = ["Straße", "ÉCOLE", "œuvre", "don't", "it's", "a,b", "x.", "!!!", "<|endoftext|>", "<|ENDOFTEXT|>", "ΣΟΦΟΣ", "İst", "e\u0301", "日本", "1234", "a1b", "\u00a0", "\x1c", "ﬁ", "ñandú", "naïve.", "½", "_", "µ", "ß", "\t", "\r\n"]
    texts = [rng.choice(["", " "]).join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(400)] + [" ".join(rng.sample(parts, 8)) for _ in range(300)]
    for text, got in zip(texts, words.encode(texts), strict=True):
        assert np.frombuffer(got, dtype="<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_placement_is_the_sum_of_squares_rule():
    rng = random.Random(3)
    capacity, lengths = 20, [rng.randint(1, 20) for _ in range(200)]
    sequence, offset = packing.place(np.array(lengths), capacity)
    gaps: dict[int, int] = {}
    for size, s, o in zip(lengths, sequence.tolist(), offset.tolist(), strict=True):

        def after(where):
            counts = Counter(g for k, g in {**gaps, where: gaps.get(where, capacity) - size}.items() if g)
            return sum(n * n for n in counts.values())

        options = {k: after(k) for k, g in gaps.items() if g >= size} | {len(gaps): after(len(gaps))}
        assert options[s] == min(options.values()) and o == capacity - gaps.get(s, capacity)
        gaps[s] = gaps.get(s, capacity) - size


def test_packing_edges(spark, odd, empty):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack_documents(odd, path).collect()
    assert [r["length"] for r in rows if r["doc_id"] == 1] == [1] and sum(r["doc_id"] == 5 for r in rows) == 2
    _check_sequences(rows, 2048)
    assert packing.pack_documents(empty, path).count() == 0


# 7 URLs


@pytest.mark.parametrize("compiled", [0, 200])
def test_hosts_paths_and_rules(spark, compiled, monkeypatch):
    monkeypatch.setattr(urls, "MOST_COMPILED", compiled)
    rules = [urls.Rule(*r) for r in queries.URL_RULES] + [urls.Rule("block", "net/")]
    cases = {
        "http://WWW.Example.ORG/es/1?x=/": ("www.example.org", "/es/1", "example.org/es/"),
        "https://a.org": ("a.org", "", None),
        "https://a.org/": ("a.org", "/", "org/"),
        "http://example.org/en/12#t": ("example.org", "/en/12", "example.org/en/1"),
        "http://notexample.org/en/12": ("notexample.org", "/en/12", "org/"),
        "x.com/fr/": ("", "", None),
        "s://x.com/fr/?q": ("x.com", "/fr/", "com/fr/"),
        "s://xcom/de/": ("xcom", "/de/", None),
        "s://net/a://b": ("net", "/a://b", "net/"),
        "s://É.org?/x": ("É.org", "", None),
        "": ("", "", None),
    }
    pages = spark.createDataFrame([*enumerate(cases), (99, None)], "page_id long, url string")
    found = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in urls.filter_urls(pages, rules).collect()}
    assert [found[i] for i in range(len(cases))] == list(cases.values()) and found[99] == ("", "", None)


def test_thousands_of_rules(spark):
    rules = [urls.Rule("block" if i % 2 else "allow", f"h{i}.net/{'p/' * (i % 3)}") for i in range(3000)]
    pages = spark.createDataFrame([(i, f"http://www.h{i}.net/p/p/x") for i in range(0, 4000, 500)], "page_id long, url string")
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.filter_urls(pages, rules).collect()}
    assert all(found[i] == (rules[i].pattern, rules[i].verdict) for i in range(0, 3000, 500)) and found[3500][0] is None


def test_markov_probabilities_sum_to_one(spark):
    examples = spark.createDataFrame([("abcab", 0), ("abd", 0), ("xyz", 0), ("a", 1), ("\u2603b", 1)], "url string, kind int")
    chars = sorted({c for c in "abcdxyz\u2603\x03"})
    contexts = ("", "a", "ab", "\x02ab", "zz", "bcab")
    wanted = spark.createDataFrame([(context + c,) for context in contexts for c in [*chars, "\u00e9"]], "window string")
    found = {r["window"]: r for r in urls.window_chances(wanted, urls.window_counts(examples)).collect()}
    for context in contexts:
        for kind in ("p_accepted", "p_rejected"):
            seen = sum(found[context + c][kind] for c in chars)
            assert abs(seen + (urls.ALPHABET - len(chars)) * found[context + "\u00e9"][kind] - 1) < 1e-9


def test_windows_of_urls(spark):
    cases = ["", "a", "h\u00e9\U0001f600llo/x", "abcdefghij"]
    rows = spark.createDataFrame([*enumerate(cases), (9, None)], "id long, url string")
    found = defaultdict(list)
    for r in urls.windows_of(rows, ["id"]).collect():
        found[r["id"]].append(r["window"])
    for i, url in [*enumerate(cases), (9, "")]:
        marked = f"\x02{url}\x03"
        assert sorted(found[i]) == sorted(marked[max(0, k - urls.ORDER) : k + 1] for k in range(1, len(marked)))


def test_url_models_learn(spark):
    rng = random.Random(5)
    good = [f"http://{rng.choice(['news', 'wiki', 'blog'])}{rng.randrange(50)}.org/article/{rng.randrange(999)}" for _ in range(400)]
    bad = [f"http://{rng.choice(['casino', 'pills', 'bets'])}{rng.randrange(50)}.org/win/{rng.randrange(999)}" for _ in range(400)]
    known = [spark.createDataFrame([(u,) for u in x[:300]], "url string") for x in (good, bad)]
    pages = spark.createDataFrame(list(enumerate(good[300:] + bad[300:])), "page_id long, url string")
    found = {r["page_id"]: r["verdict"] for r in urls.filter_urls(pages, [], accepted=known[0], rejected=known[1]).collect()}
    assert sum((found[i] == "block") == (i >= 100) for i in range(200)) >= 198


def test_url_examples_split(spark):
    """A kind whose examples all fall on one side serves both ends; without one kind there is no model; copies count once."""
    frame = lambda *x: spark.createDataFrame([(u,) for u in x], "url string")
    counted, sample = urls.split_examples(frame("a://b", "a://b", None), frame("c://d"))
    assert sorted(counted.collect()) == sorted(sample.collect()) == [("a://b", 0), ("c://d", 1)]
    assert urls.split_examples(frame("a://b"), frame()) is None and urls.split_examples(frame("a"), frame(None)) is None


def test_url_scores_are_joined_alike(spark, monkeypatch):
    """Beyond what may be broadcast, windows and URLs are shuffled with the same results, hot ones included."""
    rng = random.Random(8)
    pages = [f"http://{rng.choice(['news', 'pills'])}{rng.randrange(9)}.{rng.choice(['org', 'com'])}/{rng.choice(['fr', 'de', 'x'])}/{rng.randrange(99)}" for _ in range(300)] + ["http://copy.net/x"] * 200 + [None]
    pages = spark.createDataFrame(list(enumerate(pages)), "page_id long, url string")
    rules = [urls.Rule(*r) for r in queries.URL_RULES]
    small = sorted(urls.filter_urls(pages, rules).collect())
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    assert small == sorted(urls.filter_urls(pages, rules).collect()) and len(small) == 501


def test_url_query_brute_force(spark, sf_dir):
    """Rules, then the length-normalised ratio of two interpolated models and its calibration, counted anew."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.xxhash64("url").alias("h")).collect()

    def judged(url):
        if url is None or "://" not in url:
            return "", "", None
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(p), v, p) for v, p in queries.URL_RULES if (host == (h := p.split("/", 1)[0]) or host.endswith("." + h)) and path.startswith("/" + p.split("/", 1)[1])]
        return host, path, max(fits)[1:] if fits else None

    verdicts = {r["page_id"]: judged(r["url"]) for r in rows}
    urls_of = {v: [u for _, u in sorted({(r["h"], r["url"]) for r in rows if (verdicts[r["page_id"]][2] or ("",))[0] == v})] for v in ("allow", "block")}
    assert all(len(v) <= urls.SAMPLE for v in urls_of.values())
    hashes = {r["url"]: r["h"] for r in rows}
    fitted = {v: [u for u in x if hashes[u] % urls.CALIBRATE] for v, x in urls_of.items()}
    held = {v: [u for u in x if hashes[u] % urls.CALIBRATE == 0] for v, x in urls_of.items()}
    assert all(fitted.values()) and all(held.values())

    def counts(texts):
        out = defaultdict(Counter)
        for t in texts:
            t = f"\x02{t}\x03"
            for i in range(1, len(t)):
                for k in range(0, min(i, urls.ORDER) + 1):
                    out[t[i - k : i]][t[i]] += 1
        return out

    tables = {v: counts(x) for v, x in fitted.items()}

    def chance(table, context, c):
        if context == "":
            below = 1 / urls.ALPHABET
        else:
            below = chance(table, context[1:], c)
        if context not in table:
            return below
        after = table[context]
        return (after[c] + len(after) * below) / (after.total() + len(after))

    def ratio(url):
        t = f"\x02{url}\x03"
        at = [(t[max(0, i - urls.ORDER) : i], t[i]) for i in range(1, len(t))]
        return sum(math.log(chance(tables["block"], *x) / chance(tables["allow"], *x)) for x in at) / len(at)

    scores = [(ratio(u), v == "block") for v in held for u in held[v]]
    slope, offset = urls.calibrate(np.array([x for x, _ in scores]), np.array([b for _, b in scores]))
    for r in queries.op7_urls(spark, sf_dir).collect():
        host, path, rule = verdicts[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule[1])
        url = next(x["url"] for x in rows if x["page_id"] == r["page_id"]) or ""
        difference = ratio(url)
        p = 1 / (1 + math.exp(-slope * difference - offset))
        assert abs(r["difference"] - difference) < 1e-8 and abs(r["p_block"] - p) < 1e-6
        assert r["verdict"] == (rule[0] if rule else "block" if p >= 0.5 else "allow")


def test_url_edges(spark, sf_dir):
    pages = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "http://x.net/" + "a" * 100_000)], "page_id long, url string")
    rows = urls.filter_urls(pages, []).collect()
    assert len(rows) == 4 and {r["verdict"] for r in rows} == {"allow"} and {r["p_block"] for r in rows} == {0.5}
    assert urls.filter_urls(pages.limit(0), [urls.Rule("block", "net/")]).count() == 0
    assert queries.op7_urls(spark, sf_dir).where("verdict NOT IN ('allow', 'block')").count() == 0


# 8 Jaccard join


def _brute_components(texts):
    """Components by comparing every pair that shares a shingle."""
    sets = {}
    for k, text in texts.items():
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {k: k for k in sets}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    holders = defaultdict(list)
    for k in sorted(sets):
        shared = Counter(o for s in sets[k] for o in holders[s])
        for o, n in shared.items():
            if 100 * n >= 75 * (len(sets[k]) + len(sets[o]) - n):
                a, b = root(o), root(k)
                parent[max(a, b)] = min(a, b)
        for s in sets[k]:
            holders[s].append(k)
    return {k: (len(s), root(k)) for k, s in sets.items()}


def test_jaccard_brute_force(spark, sf_dir, documents):
    expected = _brute_components({d[0]: d[1] for d in documents})
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op8_jaccard(spark, sf_dir).collect()} == expected


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_on_chains_groups_and_passages(spark, seed, monkeypatch):
    """Near copies at all distances, chains of edits, shared passages and copies, with blocks so small that every step runs."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(2000)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = {}
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 20, 90]))]
        for _ in range(rng.choice([1, 3, 14])):
            words = list(base)
            for _ in range(rng.randint(0, 1 + len(words) // 25)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.4:
                base = words  # a chain: the next copy starts from this one
            texts[len(texts)] = " ".join(words + (passage if g % 4 == 3 else []))
    for _ in range(15):
        texts[len(texts)] = " ".join([rng.choice(vocabulary) for _ in range(rng.randint(10, 100))] + passage)
    for k in (0, 3, 9):
        for _ in range(4):
            texts[len(texts)] = texts[k].upper() if rng.random() < 0.5 else texts[k]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    if seed == 2:  # more slices than partitions, small joins by shuffle with hot keys, shingles passed on as frequent
        monkeypatch.setattr(jaccard, "input_bytes", lambda df: 30 * jaccard.SLICE_BYTES)
        monkeypatch.setattr(jaccard, "MOST_PARTS", 3)
        monkeypatch.setattr(jaccard, "_REGROUP", 2000)
        monkeypatch.setattr(jaccard, "RARE_UPTO", 5)
        monkeypatch.setattr(jaccard, "NOTICED", 2)
        monkeypatch.setattr(jaccard, "GATHERED", 300)
        monkeypatch.setattr(common, "BROADCAST_BYTES", 1000)
        monkeypatch.setattr(common, "HOT_ROWS", 2)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link(docs).collect()}
    assert found == _brute_components(texts)


@pytest.mark.parametrize("block", [4, 256])
def test_jaccard_counts_every_link(spark, block, monkeypatch):
    """Families of different near copies, with exact copies among them: links of every document against all pairs."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(block)
    texts = []
    for size in (60, 25, 8, 200):
        base = [f"w{rng.randrange(3000)}" for _ in range(size)]
        for _ in range(25):
            words = base[: size - rng.randint(0, size // 4)]
            for _ in range(rng.randint(0, 1 + size // 30)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(3000)}"
            texts += [" ".join(words)] * rng.choice([1, 1, 2])
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in map(str.split, texts)]
    expected = {i: sum(4 * len(a & b) >= 3 * len(a | b) for b in sets) - 1 for i, a in enumerate(sets)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["n_links"] for r in jaccard.link(docs).collect()} == expected


def test_many_search_tasks_write_few_files(spark):
    """40 steps on 16 partitions, two linked sets each; one pair of sets meets in two steps, and its links add up."""
    tokens = np.arange(20, dtype="<u8").tobytes()
    rows = [(task, jaccard.BOTH, 2 * min(task, 38) + k, 20, 1, tokens) for task in range(40) for k in range(2)]
    found = jaccard._run_search(spark.createDataFrame(rows, "task long, side int, sid long, n long, n_copies long, tokens binary"), 40)
    expected = [(2 * task + k, 2 * task, 2 if task == 38 else 1) for task in range(39) for k in range(2)]
    assert sorted(map(tuple, found.collect())) == expected and found.columns == ["u", "v", "links"]
    assert len(found.inputFiles()) <= common.partitions(spark)


def test_frames_made_in_memory_get_few_partitions(spark, sf_dir):
    made = spark.createDataFrame([(1, "a b c")], "doc_id long, text string").rdd.toDF()
    assert common.input_bytes(made) is None and common.parts_for(made) == common.partitions(spark)
    assert common.input_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet")) > 10_000


def test_frequent_shingles_are_passed_on_with_the_same_rank(monkeypatch):
    """A slice of the index that passes frequent shingles on early says what one that gathers all says."""
    rng = random.Random(3)
    sets = [(k, -k, 0, rng.sample(range(60), rng.randint(1, 20)) + [900, 901] * (k % 2)) for k in range(300)]

    def index(gathered, upto):
        monkeypatch.setattr(jaccard, "GATHERED", gathered)
        monkeypatch.setattr(jaccard, "RARE_UPTO", upto)
        postings, out = jaccard.Postings(), []
        for at in range(0, 300, 20):
            some = sets[at : at + 20]
            owner = np.repeat(np.arange(len(some)), [len(s[3]) for s in some])
            out += postings.add(jaccard.packed(bytes([at // 20]), owner, np.concatenate([np.array(s[3], dtype=np.uint64) for s in some])))
        found = set()
        for r in out + postings.finish():
            owner, tokens = jaccard.unpacked(r)
            found |= {(r["batch"][0] * 20 + int(o), int(t), d) for o, t, d in zip(owner, tokens, r["dfs"], strict=True)}
        return found

    holders = Counter(t for s in sets for t in set(s[3]))
    assert index(10_000, 30) == index(200, 30) == {(s[0], t, min(holders[t], 30)) for s in sets for t in s[3] if holders[t] > 1}
    frequent = jaccard.Frequent()
    for _ in range(4):
        frequent.add(np.repeat(np.arange(20, dtype=np.uint64), np.arange(20)))
    assert frequent.known.tolist() == [t for t in range(20) if t >= jaccard.NOTICED and 4 * t >= 30]


def test_divide_skip_finds_what_counting_finds(monkeypatch):
    rng = random.Random(7)
    for scan_cost in (0, 1, 16, 10_000):
        monkeypatch.setattr(jaccard, "SCAN_COST", scan_cost)
        for _ in range(60):
            sets = [set(rng.sample(range(40), rng.randint(1, 30))) for _ in range(20)]
            query = set(rng.sample(range(40), rng.randint(1, 30)))
            lists = jaccard.Lists([np.array(sorted(s), dtype=np.uint64) for s in sets], [len(s) for s in sets])
            found = jaccard.divide_skip(lists, np.array(sorted(query), dtype=np.uint64), len(query))
            assert found.tolist() == [k for k, s in enumerate(sets) if 100 * len(query & s) >= 75 * len(query | s)]


def test_components_in_rounds(spark, monkeypatch):
    from bitloom.llm import components

    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    frame = spark.createDataFrame(edges, "u long, v long")
    solved = {r["node"]: r["component"] for r in components.components(frame).collect()}
    monkeypatch.setattr(components, "LOCAL_EDGES", 20)
    assert {r["node"]: r["component"] for r in components.components(frame).collect()} == solved
    assert {solved[i] for i in range(61)} == {0} and solved[110] == 100


def test_jaccard_edges(odd, empty):
    found = jaccard.link(odd).collect()
    assert len(found) == odd.count()
    by_id = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found}
    assert by_id[1] == (0, 1) and by_id[3] == (0, 3) and by_id[5] == (1, 5) and by_id[6] == (1, 5) and by_id[9][1] == 8
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 8]
    assert jaccard.link(empty).count() == 0 and jaccard.one_of_each(empty).count() == 0


# 9 quality


def _brute_stats(text):
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = defaultdict(list)
    for i in range(len(w) - 7):
        windows[tuple(w[i : i + 8])].append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def _brute_verdicts(rows, limit=20):
    """(removed words, kept) of each row (id, text, host), by counting the distinct texts that hold a line."""
    lines = [[n for x in (text or "").split("\n") if (n := " ".join(WORD.findall(re.sub("[0-9]+", "0", x.lower()))))] for _, text, _ in rows]
    holders = defaultdict(set)
    for (_, text, host), own in zip(rows, lines, strict=True):
        for x in own:
            holders[host, x].add(text)
    out = []
    for (_, text, host), own in zip(rows, lines, strict=True):
        stats = _brute_stats(text or "")
        removed = sum(len(x.split(" ")) for x in own if len(holders[host, x]) > limit)
        failed = stats[0] < 20 or 100 * stats[4] > 30 * stats[0]
        out.append((removed, not failed and 10 * (stats[0] - removed) >= 3 * stats[0]))
    return out


def test_quality_brute_force(spark, sf_dir, documents):
    rows = {r["doc_id"]: r for r in queries.op9_quality(spark, sf_dir).collect()}
    verdicts = _brute_verdicts([(d[0], d[1], d[3]) for d in documents])
    for (doc_id, text, *_), verdict in zip(documents, verdicts, strict=True):
        r, expected = rows[doc_id], _brute_stats(text)
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == expected
        assert r["base_failed"] == (expected[0] < 20 or 100 * expected[4] > 30 * expected[0])
        assert (r["removed_words"], r["kept"]) == verdict


@pytest.mark.parametrize("by_broadcast", [True, False])
def test_line_verdicts_brute_force(spark, by_broadcast, monkeypatch):
    """Repeated rows, null ids and hosts, lines twice in a text, texts that differ in digits only; joined by broadcast and by shuffle with hot keys."""
    if not by_broadcast:
        monkeypatch.setattr(common, "BROADCAST_BYTES", 1000)
        monkeypatch.setattr(common, "HOT_ROWS", 3)
        monkeypatch.setattr(common, "HOT_KEYS", 10)
    rng = random.Random(9)
    words = [a + b + c for a in "bcdfghkl" for b in "aeiou" for c in "mnprst"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    notes, rows = [line(13) for _ in range(4)], []
    for i in range(120):
        own = [line(rng.choice([3, 14, 60])) for _ in range(rng.randint(1, 3))]
        shared = [x for x in notes if rng.random() < 0.5] * rng.choice([1, 1, 2])
        rows.append((rng.choice([i, i, None]), "\n".join(rng.sample(own + shared, len(own) + len(shared))), rng.choice(["a", "a", "b", None])))
    rows += [rows[k] for k in rng.choices(range(120), k=40)] + [rows[5]] * 30
    rows += [(1000 + i, f"Report {i} of 20{i}\n{notes[0]}\n{' '.join(words[:40])}", "numbers") for i in range(60)] + [(2000, None, "a"), (2001, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    found = Counter((r["doc_id"], r["removed_words"], r["kept"]) for r in quality.judge(docs).collect())
    verdicts = _brute_verdicts(rows)
    assert found == Counter((r[0], *v) for r, v in zip(rows, verdicts, strict=True)) and sum(v[0] > 0 for v in verdicts) > 100
    cleaned = quality.clean(docs).collect()
    assert Counter(r["doc_id"] for r in cleaned) == Counter(r[0] for r, v in zip(rows, verdicts, strict=True) if v[1])
    kept_words = sum(len(WORD.findall(r[1])) - v[0] for r, v in zip(rows, verdicts, strict=True) if v[1])
    assert sum(len(WORD.findall(r["text"])) for r in cleaned) == kept_words


def test_two_rows_of_one_id_and_a_null_id(spark):
    note, own = " ".join(f"n{'x' * i}" for i in range(13)), lambda k: " ".join(f"w{'y' * k}{'z' * i}" for i in range(14))
    rows = [(i, f"{own(i)}\n{note}", "h") for i in range(30)]
    rows += [rows[3], (None, f"{own(40)}\n{note}", "h")]
    found = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {(r["n_words"], r["removed_words"], r["kept"]) for r in found} == {(27, 13, True)} and len(found) == 32


def test_frequent_lines_go_and_depleted_documents_with_them(spark):
    rng = random.Random(6)
    words = [a + b + c for a in "bcdfghkl" for b in "aeiou" for c in "mnprst"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    note = "All   Rights Reserved 2024 by the House of Lines and Words for All Who Read Them here and there"
    rows = [(i, f"{line(30)}\n{note.replace('2024', str(2000 + i))}\n{line(20)}", "h") for i in range(60)]
    rows.append((100, f"{note}\n{line(4)}", "h"))  # little is left
    copied = f"{line(25)}\n{line(25)}"
    rows += [(200 + i, copied, "h") for i in range(60)]  # copies aren't boilerplate
    rows += [(300 + i, f"{line(30)}\n{note}", "other") for i in range(5)]  # another host, below the limit
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    verdict = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert not verdict[100]["kept"] and all(r["kept"] for i, r in verdict.items() if i != 100)
    assert verdict[3]["removed_words"] == len(note.split()) and verdict[205]["removed_words"] == 0
    cleaned = {r["doc_id"]: r["text"] for r in quality.clean(docs).collect()}
    assert set(cleaned) == set(verdict) - {100}
    before = {r[0]: r[1] for r in rows}
    assert cleaned[3] == "\n".join(x for x in before[3].split("\n") if not x.startswith("All")) and cleaned[205] == copied and "Reserved" in cleaned[301]


@pytest.mark.parametrize("own_words", [4, 13, 60])
def test_templates_of_several_lines_go(spark, own_words):
    rng = random.Random(own_words)
    words = [a + b + c for a in "bcdfghkl" for b in "aeiou" for c in "mnprst"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    template = [line(20) for _ in range(10)]
    rows = [(i, "\n".join([*template[:5], line(own_words), *template[5:], line(own_words)]), "h") for i in range(100)]
    rows += [(200 + i, "\n".join(rng.sample(template, 6)), "h") for i in range(30)]  # nothing but the template
    verdict = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()}
    assert {verdict[i]["removed_words"] for i in range(100)} == {200} and {verdict[200 + i]["removed_words"] for i in range(30)} == {120}
    assert all(verdict[i]["kept"] == (2 * own_words >= 0.3 * (200 + 2 * own_words)) for i in range(100)) and not any(verdict[200 + i]["kept"] for i in range(30))


def test_quality_edges(odd, empty):
    rows = quality.judge(odd).collect()
    assert len(rows) == odd.count() and not any(r["kept"] for r in rows if r["doc_id"] in (1, 2, 3, 8))
    assert quality.clean(odd).columns == odd.columns
    assert quality.judge(empty).count() == 0 and quality.clean(empty).count() == 0


# 10 language


def test_automaton_walk_is_greedy_longest_match():
    rng = random.Random(9)
    table = langid.symbol_table(list("abc"))
    for _ in range(30):
        sample = "".join(rng.choice("abc ") for _ in range(80))
        text = "".join(rng.choice("abcd ") for _ in range(60))
        coded, read = langid.symbols(sample, table), langid.symbols(text, table)
        moves = langid.suffix_automaton(coded)
        model = {"walk": langid.walk_table(moves, 0).reshape(-1), "starts": np.array([0], dtype=np.int32)}
        joined, count, at = coded.tobytes(), 0, 0
        while at < len(read):
            size = 0
            while at + size < len(read) and read[at : at + size + 1].tobytes() in joined:
                size += 1
            count, at = count + 1, at + max(1, size)
        got = int(langid.phrase_counts([read], model)[0, 0])
        assert abs(got - count) <= 1 + text.count("d")  # a symbol the sample lacks ends a phrase and is one


def test_language_query_brute_force(spark, tmp_path):
    """Predictions and scores of the whole query against counting longest matches in the sample texts one by one."""
    rng = random.Random(12)
    alphabets = {"aa": "abcdeé", "bb": "abxyzж", "cc": "defxyz"}
    words = {k: ["".join(rng.choice(v) for _ in range(rng.randint(2, 6))) for _ in range(30)] for k, v in alphabets.items()}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(rng.choice([1, 4, 30, 900]))).capitalize(), k, "s", 0) for i, k in enumerate(rng.choice(list(words)) for _ in range(90))]
    rows += [(200, None, "aa", "s", 0), (201, "12 34!", "bb", "s", 0), (202, "日本語 текст", None, "s", 0), (203, rows[0][1] * 40, "aa", "s", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    kept, original = {}, langid.build_model

    def build(samples):
        kept.update(samples)
        return original(samples)

    langid.build_model = build
    try:
        found = {r["doc_id"]: r for r in queries.op10_langid(spark, str(tmp_path)).collect()}
    finally:
        langid.build_model = original
    whole = {t for i, t, k, *_ in rows if zlib.crc32(str(i).encode()) % 3 != 1}
    assert set(kept) == set(words) and all(t in whole for texts in kept.values() for t in texts)
    table = langid.symbol_table([c for c, _ in sorted(Counter(c.lower() for k in sorted(kept) for t in kept[k] for c in t if c.isalpha()).items(), key=lambda x: (-x[1], x[0]))])
    samples = {k: langid.symbols(" ".join(v), table).tobytes() for k, v in kept.items()}
    for doc_id, text, *_ in rows:
        read, costs = langid.symbols(text or "", table).tobytes(), []
        if not read.strip(b"\0"):
            assert (found[doc_id]["lang_pred"], found[doc_id]["score"]) == ("und", 0.0)
            continue
        for k in sorted(samples):
            phrases = 0
            for at in range(0, len(read), langid.SEGMENT):
                part, i = read[at : at + langid.SEGMENT], 0
                while i < len(part):
                    size, alone = 1, part[i : i + 1] not in samples[k]
                    while not alone and i + size < len(part) and part[i : i + size + 1] in samples[k]:
                        size += 1
                    phrases, i = phrases + 1, i + size
                phrases += alone  # a phrase that ends with the segment is closed at its end once more
            costs.append(phrases * math.log2(len(samples[k]) + 2))
        assert found[doc_id]["lang_pred"] == sorted(samples)[int(np.argmin(costs))], (doc_id, costs)
        two = sorted(costs)[:2]
        assert abs(found[doc_id]["score"] - (1 - two[0] / two[1])) < 1e-9


def test_languages_with_long_texts_only_are_learned(spark, monkeypatch):
    long = [(k, f"{k} " * (langid.SAMPLE_TEXT + n)) for k in ("ab", "cd") for n in (0, 5)]
    monkeypatch.setattr(langid, "build_model", lambda samples: samples)
    samples = langid.learn(spark.createDataFrame(long * 3, "lang string, text string"))
    assert samples == {"ab": [long[0][1]], "cd": [long[2][1]]}


def test_languages_held_out(spark, sf_dir, documents):
    found = {r["doc_id"]: r for r in queries.op10_langid(spark, sf_dir).collect()}
    assert len(found) == len(documents)
    held = [d for d in documents if zlib.crc32(str(d[0]).encode()) % 3 == 1]
    assert all(found[d[0]]["held_out"] for d in held)
    assert sum(found[d[0]]["lang_pred"] == d[2] for d in held) >= 0.95 * len(held)


def test_languages_of_many_copies_are_learned(spark, monkeypatch):
    few = [(f"copied{k}", f"text {chr(97 + k) * 5} {'xyzuvw'[i % 6] * (i + 1)}") for k in range(5) for i in range(1 + 3 * (k == 4))]
    rows = [r for r in few for _ in range(3000 if r[0] != "copied4" else 800)] + [("many", f"word {i}") for i in range(900)]
    monkeypatch.setattr(langid, "build_model", lambda samples: samples)
    samples = langid.learn(spark.createDataFrame(rows, "lang string, text string").repartition(4))
    assert {(k, t) for k, texts in samples.items() if k != "many" for t in texts} == set(few)
    assert len(samples["many"]) == len(set(samples["many"])) == langid.SAMPLE_DOCS and sum(map(len, samples.values())) == len(few) + langid.SAMPLE_DOCS


def test_language_edges(spark, odd, empty):
    model = langid.learn(odd.where("lang IS NOT NULL"))
    rows = langid.identify(odd, model, ["doc_id"]).collect()
    assert len(rows) == odd.count()
    by_id = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows}
    assert by_id[1] == ("und", 0.0) and by_id[2] == ("und", 0.0) and by_id[3] == ("und", 0.0) and by_id[8][0] == "fr"
    nothing = langid.learn(empty)
    assert {r["lang_pred"] for r in langid.identify(odd, nothing, ["doc_id"]).collect()} == {"und"}
    assert langid.identify(empty, model, ["doc_id"]).count() == 0
