"""How many distinct values the first k bits of an order take, for every k at once.

Sorted distinct keys give the whole curve: two neighbours with a common prefix of p bits
are apart for every k above p, so n_b(k) = 1 + the number of neighbours with p < k.
"""

from __future__ import annotations

import math
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bitloom.functions.bits import LIMB, base_columns, key_limbs
from bitloom.schema import DatasetInfo

HLL_PRECISION = 8
#: Seed and constants of the splitmix64 words that bits are hashed by (fixed values).
WORD_SEED = 0xD1B54A32D192ED03
SPLITMIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_U64 = (1 << 64) - 1


class DistinctCounter(Protocol):
    """The extension point: distinct values over all prefixes of an order of bits."""

    def curve(self, rows: DataFrame, info: DatasetInfo, order: list[int]) -> list[int]: ...


def _common_prefix(a: np.ndarray, b: np.ndarray, widths: list[int]) -> np.ndarray:
    """Length of the common prefix of key rows; a column per limb, most significant first."""
    out = np.full(len(a), sum(widths), dtype=np.int64)
    open_ = np.ones(len(a), dtype=bool)
    done = 0
    for j, w in enumerate(widths):
        x = a[:, j] ^ b[:, j]
        differs = open_ & (x != 0)
        if differs.any():
            v = x[differs]
            length = np.zeros(len(v), dtype=np.int64)
            for step in (32, 16, 8, 4, 2, 1):  # bit length by halving
                high = v >> step
                more = high > 0
                length += np.where(more, step, 0)
                v = np.where(more, high, v)
            out[differs] = done + w - (length + 1)
            open_ &= ~differs
        done += w
    return out


class ExactCounter:
    """Exact counts: one distinct, one range sort, one histogram per range."""

    def curve(self, rows: DataFrame, info: DatasetInfo, order: list[int]) -> list[int]:
        """n_b(0), ..., n_b(len(order)); the driver gets one histogram and two keys per range."""
        if not order:
            return [1 if rows.head(1) else 0]
        limbs = key_limbs(info, order)
        widths = [min(LIMB, len(order) - i) for i in range(0, len(order), LIMB)]
        names = [f"k{i}" for i in range(len(limbs))]
        keys = rows.select(*[c.alias(n) for c, n in zip(limbs, names, strict=True)]).distinct()
        ordered = keys.repartitionByRange(*names).sortWithinPartitions(*names)
        length = len(order)

        def histogram(batches):
            counts, first, last = np.zeros(length + 1, dtype=np.int64), None, None
            for batch in batches:
                if not batch.num_rows:
                    continue
                found = np.stack([batch.column(n).to_numpy() for n in names], axis=1)
                run = found if last is None else np.vstack([last, found])
                if len(run) > 1:
                    counts += np.bincount(_common_prefix(run[:-1], run[1:], widths), minlength=length + 1)
                first = found[:1] if first is None else first
                last = found[-1:]
            if first is not None:
                yield pa.RecordBatch.from_pydict({"first": [first[0].tolist()], "last": [last[0].tolist()], "counts": [counts.tolist()]})

        parts = ordered.mapInArrow(histogram, "first array<bigint>, last array<bigint>, counts array<bigint>").collect()
        if not parts:
            return [0] * (length + 1)
        parts.sort(key=lambda r: r["first"])
        counts = np.sum([r["counts"] for r in parts], axis=0)
        if len(parts) > 1:
            a, b = (np.array([r[side] for r in some], dtype=np.int64) for side, some in (("last", parts[:-1]), ("first", parts[1:])))
            counts += np.bincount(_common_prefix(a, b, widths), minlength=length + 1)
        return [1 + int(c) for c in np.concatenate([[0], np.cumsum(counts[:length])])]


def hash_words(count: int) -> list[int]:
    """The word of each bit position: successive splitmix64 values."""
    out, state = [], WORD_SEED
    for _ in range(count):
        state = (state + SPLITMIX[0]) & _U64
        z = ((state ^ state >> 30) * SPLITMIX[1]) & _U64
        z = ((z ^ z >> 27) * SPLITMIX[2]) & _U64
        out.append(z ^ z >> 31)
    return out


def estimate(registers: np.ndarray, n: int) -> int:
    """HyperLogLog estimate, by linear counting where small, between 1 and ``n``."""
    if n == 0:
        return 0
    m = len(registers)
    value = 0.7213 / (1 + 1.079 / m) * m * m / float(np.sum(2.0 ** -registers.astype(float)))
    zeros = int((registers == 0).sum())
    if value <= 2.5 * m and zeros:
        value = m * math.log(m / zeros)
    return int(max(1, min(n, math.floor(value + 0.5))))


#: Partitions that fold the registers of all others.
FOLDS = 8


class HyperLogLogCounter:
    """Estimates from 256 registers of a hash that XORs one word per set bit.  One pass for the whole curve."""

    def curve(self, rows: DataFrame, info: DatasetInfo, order: list[int]) -> list[int]:
        words = np.array(hash_words(info.chunk_size), dtype=np.uint64)
        places = [(info.place(b), int(words[b])) for b in order]
        names, buckets, length = [f.name for f in info.features], 1 << HLL_PRECISION, len(order)

        def registers(batches):
            found, n = np.zeros((length + 1, buckets), dtype=np.uint8), 0
            for batch in batches:
                values = {name: batch.column(name).to_numpy() for name in names}
                n += batch.num_rows
                h = np.zeros(batch.num_rows, dtype=np.uint64)
                for k in range(length + 1):
                    if k:
                        (name, local), word = places[k - 1]
                        h = np.where(values[name] >> local & 1, h ^ np.uint64(word), h)
                    suffix = h << np.uint64(HLL_PRECISION)
                    # leading zeros of 64 bits from the float exponent of the upper part, corrected
                    top = np.zeros(len(h), dtype=np.int64)
                    v = suffix.copy()
                    for step in (32, 16, 8, 4, 2, 1):
                        high = v >> np.uint64(step)
                        more = high > 0
                        top += np.where(more, step, 0)
                        v = np.where(more, high, v)
                    rank = np.where(suffix == 0, 65 - HLL_PRECISION, np.minimum(64 - top, 65 - HLL_PRECISION)).astype(np.uint8)
                    np.maximum.at(found[k], (h >> np.uint64(64 - HLL_PRECISION)).astype(np.int64), rank)
            yield pa.RecordBatch.from_pydict({"n": [n], "registers": [found.tobytes()]})

        def folded(batches):
            merged, n = np.zeros((length + 1, buckets), dtype=np.uint8), 0
            for batch in batches:
                n += sum(batch.column("n").to_pylist())
                for found in batch.column("registers").to_pylist():
                    np.maximum(merged, np.frombuffer(found, dtype=np.uint8).reshape(merged.shape), out=merged)
            yield pa.RecordBatch.from_pydict({"n": [n], "registers": [merged.tobytes()]})

        schema = "n long, registers binary"
        each = rows.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(registers, schema)
        parts = each.repartition(FOLDS).mapInArrow(folded, schema).collect()  # a few rows, however many partitions there are
        n = sum(r["n"] for r in parts)
        merged = np.zeros((length + 1, buckets), dtype=np.uint8)
        for r in parts:
            merged = np.maximum(merged, np.frombuffer(r["registers"], dtype=np.uint8).reshape(merged.shape))
        # nothing is hashed before the first bit that varies; the idiomatic count of no bits is 1
        return [min(1, n)] + [estimate(merged[k], n) for k in range(1, length + 1)]


def count_distinct(rows: DataFrame, info: DatasetInfo, bits: list[int]) -> int:
    """Distinct values of the given bits."""
    return rows.select(*[c.alias(n) for n, c in base_columns(info, bits).items()]).distinct().count()
