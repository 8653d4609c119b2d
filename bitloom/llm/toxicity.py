"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's probability is a logistic function of the words it holds; a document is
toxic with the noisy-or of its sentences, 1 - prod(1 - p).  The word weights are
fitted on document labels alone, by gradient steps through the noisy-or, on a bounded
sample of labelled rows.  Scoring covers every sentence of every whole text and also
returns the offending sentences as spans.

Edge cases: null and empty texts have no sentence and score the model's prior rate of
toxic labels among empty texts, which is 0 unless learned otherwise (a document
without words counts as one empty sentence); rows whose label is null teach nothing;
without a positive or a negative label every score is the smoothed rate of the other, and
without any label about 0;
repeated rows are scored alike; empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bitloom.llm.common import freeing, text_blocks


#: Bounds of the sample the model is fitted on: documents, and characters over all of them.
TRAIN_DOCS = 8_000
TRAIN_CHARS = 16_000_000
VOCABULARY = 200_000
LEAST_DOCS = 5
PREFIXES = range(3, 10)
STEPS = 160
RATE = 0.15
PENALTY = 2e-4
THRESHOLD = 0.3

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """Start, end and lower-cased words of each sentence that has a word; one empty sentence if none has."""
    found = [(m.start(), m.end(), words) for m in SENTENCE.finditer(text) if (words := WORD.findall(m[0].lower()))]
    return found or [(0, 0, [])]


def features(word: str) -> list[str]:
    """The word itself and its beginnings, which stand for words that were never seen."""
    return [f"{word}$", *(word[:n] for n in PREFIXES if n <= len(word))]


def fit(texts: list[str], labels: list[int], steps: int = STEPS) -> dict:
    """Feature weights and bias: proximal Adam on the noisy-or likelihood with an L1 penalty.

    A sentence's logit is the bias plus the weights of its distinct words; a word's
    weight is the sum over its features.
    """
    y = np.array(labels, dtype=bool)
    if not len(y):
        return {"weights": {}, "bias": -30.0}
    rate = (y.sum() + 0.5) / (len(y) + 1)
    if y.all() or not y.any():
        return {"weights": {}, "bias": math.log(rate / (1 - rate))}
    word_id: dict[str, int] = {}
    word_in, row, owner, df = array("i"), array("i"), array("i"), Counter()
    for d, text in enumerate(texts):
        seen = set()
        for _, _, words in sentences(text):
            distinct = set(words)
            word_in.extend(word_id.setdefault(w, len(word_id)) for w in distinct)
            row.extend([len(owner)] * len(distinct))
            owner.append(d)
            seen |= distinct
        df.update({f for w in seen for f in features(w)})
    names = [f for f, n in sorted(df.items(), key=lambda x: (-x[1], x[0])) if n >= LEAST_DOCS][:VOCABULARY]
    index = {f: i for i, f in enumerate(names)}
    pairs = [(i, index[f]) for w, i in word_id.items() for f in features(w) if f in index]
    of_word, of_feature = np.array(pairs, dtype=np.int32).reshape(-1, 2).T
    word_in, row, owner = np.array(word_in, dtype=np.int32), np.array(row, dtype=np.int32), np.array(owner, dtype=np.int32)
    # the bias starts where a document of mean length is toxic at the labels' rate
    theta, bias = np.zeros(len(names)), math.log(rate * len(y) / len(owner))
    mean, square = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, steps + 1):
        by_word = np.bincount(of_word, weights=theta[of_feature], minlength=len(word_id))
        z = np.bincount(row, weights=by_word[word_in], minlength=len(owner)) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        silent = np.bincount(owner, weights=np.logaddexp(0, z), minlength=len(y))  # -log P(no sentence is toxic)
        slope = np.where(y, -1 / np.expm1(np.clip(silent, 1e-6, 500)), 1.0)[owner] * p
        for_word = np.bincount(word_in, weights=slope[row], minlength=len(word_id))
        gradient = np.append(np.bincount(of_feature, weights=for_word[of_word], minlength=len(names)), slope.sum()) / len(y)
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        rates = RATE / (np.sqrt(square / (1 - 0.99**step)) + 1e-5)
        move = rates * mean / (1 - 0.9**step)
        bias -= move[-1]
        theta = theta - move[:-1]
        theta = np.sign(theta) * np.maximum(np.abs(theta) - rates[:-1] * PENALTY, 0)
    return {"weights": {f: float(v) for f, v in zip(names, theta, strict=True) if v}, "bias": float(bias)}


class WordWeights(dict):
    """Weight of a word, computed once; forgets all when it gets large."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= 500_000:
            self.clear()
        self[word] = found = sum(self.weights.get(f, 0.0) for f in features(word))
        return found


def score(text: str, weights: WordWeights, bias: float, span_at: float = THRESHOLD) -> tuple[float, list[dict]]:
    """The noisy-or of the text's sentences, and those whose own probability reaches ``span_at``."""
    silent, spans = 0.0, []
    for start, end, words in sentences(text):
        z = bias + sum(weights[w] for w in set(words))
        silent += math.log1p(math.exp(z)) if z < 30 else z
        if (p := 1 / (1 + math.exp(-max(z, -500)))) >= span_at:
            spans.append({"start": start, "end": end, "score": p})
    return -math.expm1(-silent), spans


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[list[str], list[int]]:
    """At most ``TRAIN_DOCS`` labelled texts of ``TRAIN_CHARS`` characters together, drawn by a hash of the text.

    Only ids, hashes and lengths meet the labels; the texts drawn are fetched afterwards by
    their ids, whose number is bounded.  Copies with one label count once, whole texts are
    taken, and the hash order keeps the labels' shares whatever the order of rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    heads = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.length(text).alias("n"))
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    drawn = heads.join(known, "id").groupBy("h", "label").agg(F.min("id").alias("id"), F.max("n").alias("n")).orderBy("h", "label").limit(TRAIN_DOCS).collect()
    room, chosen = TRAIN_CHARS, []
    for r in drawn:
        if r["n"] <= room:  # a text that doesn't fit is passed over
            room -= r["n"]
            chosen.append((r["id"], r["h"], r["label"]))
    if not chosen:
        return [], []
    wanted = docs.sparkSession.createDataFrame(chosen, "id long, h long, label int")
    fetched = docs.select(F.col(id_col).alias("id"), text.alias("text")).join(F.broadcast(wanted), "id").where(F.xxhash64("text") == F.col("h"))
    texts = {(r["h"], r["label"]): r["text"] for r in fetched.select("h", "label", "text").collect()}
    found = [(texts[h, label], label) for _, h, label in chosen if (h, label) in texts]
    return [t for t, _ in found], [y for _, y in found]


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    return fit(*sample(docs, labels, id_col, text_col, label_col))


def detect(docs: DataFrame, model: dict, keep: list[str], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Columns ``keep`` with score, predicted and the offending sentences of every whole text, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def rows(batches):
        weights, bias = WordWeights(shared.value["weights"]), shared.value["bias"]
        for batch in batches:
            found = [score(t or "", weights, bias) for _, _, texts in text_blocks(batch, "_text") for t in texts]
            scores = [s for s, _ in found]
            kept = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array([x for _, x in found], span)], names=[*keep, "score", "predicted", "sentences"])

    chosen = docs.select(*keep, F.col(text_col).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(freeing(rows), f"{fields}, score double, predicted int, sentences array<struct<start:bigint,end:bigint,score:double>>")
