"""Document fingerprints: quartile bucket digests and their bounded difference.

A digest counts hashed byte triplets of a sliding five-byte window in ``buckets``
counters, replaces each counter by the quartile it falls in (two bits) and puts a
logarithmic length code in front.  Two digests are compared bucket by bucket; the
sum of the quartile differences plus a length term is cut off at a bound, so the
likeness lies between 0 and 1 and is 1 for equal texts.

Edge cases: a null text counts as empty; texts under three bytes have no triplet
and get the all-zero digest with their length code; equal texts always get equal
digests; an empty table gives an empty result; repeated rows and repeated ids keep
one output row each (ordered by id, then text); a null id sorts first.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from bitloom.llm.common import freeing, parts_for

BUCKETS = 128
#: Offsets of the byte triplets taken from each five-byte window.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))
#: Quartile codes three apart count double, as opposite ends seldom meet by chance.
CODE_COST = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]], dtype=np.int64)
LENGTH_CAP = 32
#: Input bytes of a range of ids, and most ranges; a range is sorted with spills and then streamed.
RANGE_BYTES = 128 << 20
MOST_RANGES = 20_000
_CHUNK = 1 << 20


def bucket_counts(data: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket is hit by the hashed triplets of ``data``."""
    total = np.zeros(buckets, dtype=np.int64)
    shift = 32 - buckets.bit_length() + 1
    for start in range(0, max(len(data) - 2, 0), _CHUNK):
        raw = np.frombuffer(data, dtype=np.uint8)[start : start + _CHUNK + 4].astype(np.uint32)
        ends = min(len(data) - start, _CHUNK + 4)
        for k, (i, j, m) in enumerate(TRIPLETS):
            n = min(ends - m, _CHUNK)
            if n <= 0:
                continue
            mixed = raw[i : i + n] * np.uint32(0x9E3779B1) + raw[j : j + n] * np.uint32(0x85EBCA77)
            mixed += raw[m : m + n] * np.uint32(0xC2B2AE3D) + np.uint32(0x27D4EB2F * (k + 1) & 0xFFFFFFFF)
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x2C1B3C6D)
            total += np.bincount(mixed >> np.uint32(shift), minlength=buckets)
    return total


def length_code(n: int) -> int:
    """A byte that grows by one for each 5 % of length."""
    return 0 if n == 0 else min(255, 1 + int(math.log(n) / math.log(1.05)))


def digest(data: bytes, buckets: int = BUCKETS) -> str:
    """Length code and quartile codes as hexadecimal digits."""
    counts = bucket_counts(data, buckets)
    quartiles = np.partition(counts, (buckets // 4, buckets // 2, 3 * buckets // 4))[[buckets // 4, buckets // 2, 3 * buckets // 4]]
    codes = (counts[:, None] > quartiles[None, :]).sum(axis=1).astype(np.uint8).reshape(-1, 4)
    packed = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    return f"{length_code(len(data)):02x}" + packed.tobytes().hex()


def _codes(fingerprint: str) -> tuple[int, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex(fingerprint), dtype=np.uint8)
    return int(raw[0]), ((raw[1:, None] >> np.array([0, 2, 4, 6], dtype=np.uint8)) & 3).reshape(-1)


def likeness(a: str, b: str) -> float:
    """1 minus the bounded difference of two digests; equal digests give 1."""
    if a == b:
        return 1.0
    (len_a, codes_a), (len_b, codes_b) = _codes(a), _codes(b)
    bound = 2 * len(codes_a) + LENGTH_CAP
    difference = int(CODE_COST[codes_a, codes_b].sum()) + min(abs(len_a - len_b), LENGTH_CAP)
    return 1.0 - min(difference, bound) / bound


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """The last half of ``text`` replaced by as many first code points of ``following`` (or all it has)."""
    cut = len(text) // 2
    return text[: len(text) - cut] + following[:cut]


def _with_next(buckets: int):
    """Arrow batches sorted by (is_next, id, text) to result batches; the first is_next row follows the last own row."""

    def rows(batches):
        held, out = None, []

        def emit(following):
            doc_id, text, own = held
            changed = edited(text, following[1])
            changed_bytes = changed.encode()
            print_changed = own if changed == text else digest(changed_bytes, buckets)
            out.append((doc_id, len(text), hashlib.sha256(changed_bytes).hexdigest(), own, print_changed, likeness(own, print_changed), likeness(own, following[2])))

        done = False
        for batch in batches:
            for doc_id, text, is_next in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "is_next")), strict=True):
                if done:
                    continue
                current = (doc_id, text, digest(text.encode(), buckets))
                if held is not None:
                    emit(current)
                held, done = current, is_next
            if out:
                yield _batch(out)
                out = []

    return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [f.split()[0] for f in RESULT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _constants(values: list[int]) -> Column:
    """An array that the optimizer folds to one literal, however long it is."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _rank(bounds: list[int], value: Column) -> Column:
    """How many of the ascending bounds are at most ``value``: among every step-th first, then within the step."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    coarse = F.size(F.filter(_constants(bounds[::step]), lambda b: b <= value))
    fine = F.size(F.filter(F.slice(_constants(bounds), (coarse - 1) * step + 1, F.lit(step)), lambda b: b <= value))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + fine)


def fingerprint_with_edits(docs: DataFrame, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest every text, its edited text (see :func:`edited`) and compare it with the next document's.

    Documents are dealt by ranges of their id, whose bounds come from an id-only
    aggregate; each range's first documents are also sent to the range before, so
    every text crosses the network once and no global order is sorted in one task.
    """
    n, lowest = min(parts_for(docs, RANGE_BYTES), MOST_RANGES), -(1 << 63)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("at", F.coalesce("doc_id", F.lit(lowest)))
    keys = rows.select("at")
    bounds = keys.agg(F.percentile_approx("at", [i / n for i in range(1, n)] or [0.5], F.lit(min(100 * n, 200_000))).alias("q")).first()["q"]
    bounds = sorted(set(bounds or []))
    dealt = _rank(bounds, F.col("at"))
    firsts = sorted((r["part"], r["first"]) for r in keys.withColumn("part", dealt).groupBy("part").agg(F.min("at").alias("first")).collect())
    before = {part: firsts[i - 1][0] for i, (part, _) in enumerate(firsts)}
    first_of = {part: first for part, first in firsts}
    size = len(bounds) + 1
    first_at = _constants([first_of.get(p, lowest) for p in range(size)])
    target = _constants([before.get(p, 0) for p in range(size)]).cast("array<int>")
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("is_next"))
    copies = F.when(F.col("at") == F.get(first_at, F.col("part")), F.array(own, F.struct(F.get(target, F.col("part")).alias("part"), F.lit(True).alias("is_next")))).otherwise(F.array(own))
    dealt_rows = rows.withColumn("part", dealt).withColumn("to", F.explode(copies)).select("doc_id", "text", "at", F.col("to.part").alias("part"), F.col("to.is_next").alias("is_next"))
    together = dealt_rows.repartitionById(size, F.col("part").cast("int")).sortWithinPartitions("is_next", "at", "text")
    return together.select("doc_id", "text", "is_next").mapInArrow(freeing(_with_next(buckets)), RESULT)
