"""Language identification by cross-parsing against suffix automata.

For each language a suffix automaton is built from a bounded sample of whole labelled
texts, which is the same size however many languages there are; the model's memory and
the work per character grow with the number of languages (about 16 MB each).  A document is cut greedily into the longest phrases that occur in the
sample; the language that needs the fewest phrases, normalised by the document's
length and the sample's size, wins.  Parsing is a walk over a table: one step a
character, a flag where a phrase ends.  All documents of a block and all languages
walk side by side as array lanes.  Texts are parsed whole, in segments of
``SEGMENT`` symbols, so a very long text costs as much per character as any other.

Edge cases: null texts and texts without a letter are ``und`` with score 0, and so
is every text where nothing could be learned; ties go to the language whose name
sorts first; a language's name is whatever non-null label the learning rows hold;
one single learned language is always predicted with score 1.  Repeated rows are
scored alike, an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from bitloom.llm.common import freeing, text_blocks

UNKNOWN = "und"
#: Symbols: 0 separates words, 1 is unused, then come frequent letters; the last RARE ones share the other letters by code block.
SYMBOL_BITS = 6
SYMBOLS = 1 << SYMBOL_BITS
RARE = 12
SEGMENT = 2048
LANES = 1024
#: The sample of a language: at most so many rows, of at most so many characters together, none longer than SAMPLE_TEXT.
SAMPLE_DOCS = 96
SAMPLE_CHARS = 32_000
SAMPLE_TEXT = 4_000
_BLOCK_CHARS = 2_000_000


def symbol_table(frequent: list[str]) -> np.ndarray:
    """For every code point its symbol; upper and lower case share one."""
    rank = {c: i + 2 for i, c in enumerate(frequent[: SYMBOLS - 2 - RARE])}
    out = np.zeros(0x110000, dtype=np.uint8)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            out[cp] = rank.get(c.lower(), SYMBOLS - RARE + (cp >> 7) % RARE)
    return out


def symbols(text: str, table: np.ndarray) -> np.ndarray:
    """The text's symbols; runs of non-letters become one separator."""
    parts = [table[np.frombuffer(text[i : i + _BLOCK_CHARS].encode("utf-32-le"), dtype=np.uint32)] for i in range(0, len(text), _BLOCK_CHARS)]
    out = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint8)
    if len(out):
        keep = out > 0
        keep[1:] |= out[:-1] > 0
        out = out[keep]
    return out


def suffix_automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that reads every substring of ``text`` from state 0."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                split = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = split
                    p = link[p]
                link[q] = link[new] = split
        last = new
    return moves


def walk_table(moves: list[dict[int, int]], base: int) -> np.ndarray:
    """For each state and symbol: next state (from ``base``) times 4, plus the phrases that end on the way.

    Where the automaton cannot go on, the phrase ends and a new one starts with the
    symbol; a symbol the language never showed is a phrase of its own.
    """
    start = np.full(SYMBOLS, base << 2 | 1, dtype=np.int32)
    for c, to in moves[0].items():
        start[c] = (base + to) << 2
    restart = np.where(start & 3, base << 2 | 2, start | 1).astype(np.int32)
    out = np.tile(restart, (len(moves), 1))
    out[0] = start
    for state, edges in enumerate(moves[1:], 1):
        for c, to in edges.items():
            out[state, c] = (base + to) << 2
    return out


def build_model(samples: dict[str, list[str]]) -> dict:
    """Languages, walk table, start states and the weight of a phrase, from sample texts."""
    names = sorted(samples)
    letters = Counter(c.lower() for n in names for t in samples[n] for c in t if c.isalpha())
    table = symbol_table([c for c, _ in sorted(letters.items(), key=lambda x: (-x[1], x[0])) if len(c) == 1])
    walks, starts, weights, base = [], [], [], 0
    for n in names:
        text = symbols(" ".join(samples[n]), table)
        moves = suffix_automaton(text)
        walks.append(walk_table(moves, base))
        starts.append(base)
        weights.append(math.log2(len(text) + 2))
        base += len(moves)
    return {"names": names, "table": table, "walk": np.concatenate(walks).reshape(-1) if walks else None, "starts": np.array(starts, dtype=np.int32), "weights": np.array(weights)}


def phrase_counts(texts: list[np.ndarray], model: dict) -> np.ndarray:
    """Phrases that each text (symbols) needs in each language: an array texts by languages."""
    walk, starts = model["walk"], model["starts"]
    total = np.zeros((len(texts), len(starts)), dtype=np.int64)
    pieces = [(len(t[i : i + SEGMENT]), n, i) for n, t in enumerate(texts) for i in range(0, len(t), SEGMENT)]
    pieces.sort(reverse=True)
    for at in range(0, len(pieces), LANES):
        group = pieces[at : at + LANES]
        lengths = np.array([p[0] for p in group])
        lanes = np.zeros((len(group), lengths[0]), dtype=np.int32)
        for k, (n_symbols, n, i) in enumerate(group):
            lanes[k, :n_symbols] = texts[n][i : i + n_symbols]
        steps = np.ascontiguousarray(lanes.T)
        state = np.repeat((starts << 2)[:, None], len(group), axis=1)
        found = np.ones((len(starts), len(group)), dtype=np.int32)  # the phrase still open at the end
        active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
        for t in range(lengths[0]):
            k = active[t]
            go = walk[((state[:, :k] >> 2) << SYMBOL_BITS) + steps[t, :k]]
            found[:, :k] += go & 3
            state[:, :k] = go
        np.add.at(total, [p[1] for p in group], found.T)
    return total


def predict(texts: list[str | None], model: dict) -> tuple[list[str], list[float]]:
    """Language and score of each text; the score is how far the runner-up lies behind, from 0 to 1."""
    coded = [symbols(t or "", model["table"]) for t in texts]
    lettered = [bool(c.any()) for c in coded]
    if not model["names"]:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    cost = phrase_counts(coded, model) * model["weights"]
    best = cost.argmin(axis=1)
    names = [model["names"][b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
    if len(model["names"]) == 1:
        return names, [float(ok) for ok in lettered]
    two = np.partition(cost, 1, axis=1)[:, :2]
    score = np.where(two[:, 1] > 0, 1 - two[:, 0] / np.maximum(two[:, 1], 1e-9), 0.0)
    return names, [float(s) if ok else 0.0 for s, ok in zip(score, lettered, strict=True)]


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict:
    """Build the model from a bounded sample of each language's distinct texts, all of them whole.

    Texts of up to ``SAMPLE_TEXT`` characters are drawn in the order of their hash, so neither row
    order nor copies matter, up to ``SAMPLE_DOCS`` texts and ``SAMPLE_CHARS`` characters; one that
    doesn't fit any more is passed over.  A language that has only longer texts is learned from its shortest.
    """
    spark = labelled.sparkSession
    lettered = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("name"), F.col(text_col).alias("text"))
    heads = lettered.select("lang", "name", F.length("text").alias("n"))
    short = F.when(F.col("n") <= SAMPLE_TEXT, 1)
    counts = heads.distinct().groupBy("lang").agg(F.count(short).alias("short"), F.min(F.struct("n", "name")).alias("shortest")).collect()
    if not counts:
        return build_model({})
    chosen = [(r["lang"], r["shortest"]["name"], 0) for r in counts if not r["short"]]
    # about six times the rows that are wanted pass this threshold, so a language's hashes can be ranked in one place
    wide = 1 << 40
    limit = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(int(wide * min(1.0, 6 * SAMPLE_DOCS / max(1, r["short"])))))])
    drawn = heads.where(F.col("n") <= SAMPLE_TEXT).withColumn("h", F.pmod("name", F.lit(wide))).where(F.col("h") < F.element_at(limit, F.col("lang"))).groupBy("lang", "h", "name").agg(F.max("n").alias("n"))
    first = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "name"))).where(F.col("rank") <= SAMPLE_DOCS)
    room = dict.fromkeys((r["lang"] for r in counts), SAMPLE_CHARS)
    for r in sorted(first.select("lang", "rank", "name", "n").collect(), key=lambda r: (r["lang"], r["rank"])):
        if r["n"] <= room[r["lang"]]:
            room[r["lang"]] -= r["n"]
            chosen.append((r["lang"], r["name"], r["rank"]))
    wanted = spark.createDataFrame(chosen, "lang string, name long, rank int")
    texts = lettered.join(F.broadcast(wanted), ["lang", "name"]).groupBy("lang", "rank").agg(F.min("text").alias("text")).collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(texts, key=lambda r: (r["lang"], r["rank"])):
        samples.setdefault(r["lang"], []).append(r["text"])
    return build_model(samples)


def identify(docs: DataFrame, model: dict, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` with ``lang_pred`` and ``score`` of every whole text, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        for batch in batches:
            names, scores = [], []
            for _, _, texts in text_blocks(batch, "_text", 2 << 20):
                n, s = predict(texts, shared.value)
                names += n
                scores += s
            kept = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    chosen = docs.select(*keep, F.col(text_col).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(freeing(rows), f"{fields}, lang_pred string, score double")
