"""Choosing the base bits.  Every selector walks one order of bits and judges its prefixes
by a size model, so all it needs is the curve of distinct values; the walks are arithmetic
on at most one number per bit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from bitloom.operators.distinct import DistinctCounter, ExactCounter
from bitloom.operators.entropy import BitScore, entropy_order
from bitloom.schema import DatasetInfo, bits_needed_nonzero


@dataclass(frozen=True)
class Size:
    """Bits of a compressed dataset by part."""

    bases: int
    size_bases: int
    size_deviations: int
    size_ids: int
    size_params: int

    @property
    def total(self) -> int:
        return self.size_bases + self.size_deviations + self.size_ids + self.size_params


def size_of(n: int, features: int, chunk_size: int, base_bits: int, bases: int) -> Size:
    """The size model: base patterns, deviations and ids of the rows, and parameters."""
    id_bits = bits_needed_nonzero(bases) if bases else 0
    return Size(bases, bases * base_bits, n * (chunk_size - base_bits), n * id_bits, 16 * features + 16 + chunk_size)


@dataclass
class Selection:
    """The chosen base bits in the order they were taken, and the trials that led there."""

    bits: list[int]
    bases: int
    size: int
    trials: list[tuple[int, int, Size]]  # prefix length, bit, size

    @property
    def k(self) -> int:
        return len(self.bits)


class _Walk:
    """Sizes of the prefixes of an order."""

    def __init__(self, order: list[int], curve: list[int], n: int, info: DatasetInfo):
        self.order, self.curve, self.n, self.info, self.trials = order, curve, n, info, []

    def size(self, k: int) -> int:
        found = size_of(self.n, len(self.info.features), self.info.chunk_size, k, self.curve[k])
        self.trials.append((k, self.order[k - 1] if k else -1, found))
        return found.total

    def chosen(self, k: int, size: int) -> Selection:
        return Selection(self.order[:k], self.curve[k], size, self.trials)

    def greedy(self, start: int, best: int, best_size: int, patience: int, check_always: bool) -> tuple[int, int]:
        """Bit by bit; a trial keeps what it took even if that didn't help, and ``patience`` failures in a row end it."""
        failures = 0
        for k in range(start + 1, len(self.order) + 1):
            size = self.size(k)
            if size < best_size:
                best, best_size, failures = k, size, 0
            else:
                failures += 1
            if failures >= patience and (check_always or failures):
                break
        return best, best_size


def select_naive(order: list[int], curve: list[int], constants: int, n: int, info: DatasetInfo, patience: int) -> Selection:
    """Constants, then greedily by ascending entropy."""
    walk = _Walk(order, curve, n, info)
    best, size = walk.greedy(constants, constants, walk.size(constants), patience, True)
    return walk.chosen(best, size)


def select_threshold(order: list[int], curve: list[int], constants: int, n: int, info: DatasetInfo, patience: int, entropies: list[float], threshold: float) -> Selection:
    """All bits of an entropy up to the threshold at once, then greedily.  ``entropies`` follow ``order``."""
    walk = _Walk(order, curve, n, info)
    bulk = max(constants, sum(e <= threshold for e in entropies))
    best, size = walk.greedy(bulk, bulk, walk.size(bulk), patience, True)
    return walk.chosen(best, size)


def entropy_clusters(entropies: list[float], decay: float) -> list[int]:
    """Sizes of clusters of ascending entropies; a cluster's width is ``decay`` times the one before, from the whole range on."""
    if not entropies:
        return []
    span = entropies[-1] - entropies[0]
    if span == 0:
        return [len(entropies)]
    sizes, at, width = [], 0, span * decay
    while at < len(entropies):
        end = at + 1
        while end < len(entropies) and entropies[end] - entropies[at] <= width:
            end += 1
        sizes.append(end - at)
        at, width = end, width * decay
    return sizes


def select_adaptive(order: list[int], curve: list[int], constants: int, n: int, info: DatasetInfo, patience: int, entropies: list[float], decay: float = 0.5) -> Selection:
    """Cluster by cluster while that helps, then greedily from the last cluster that did."""
    if not 0 < decay < 1:
        raise ValueError("decay must lie between 0 and 1")
    walk = _Walk(order, curve, n, info)
    best, size = constants, walk.size(constants)
    for cluster in entropy_clusters(entropies[constants:], decay):
        tried = walk.size(best + cluster)
        if tried >= size:
            break
        best, size = best + cluster, tried
    best, size = walk.greedy(best, best, size, max(1, patience), False)
    return walk.chosen(best, size)


def profile_all(order: list[int], curve: list[int], n: int, info: DatasetInfo, batch: int = 1) -> Selection:
    """Takes every bit, ``batch`` at a time."""
    walk = _Walk(order, curve, n, info)
    for k in range(0, len(order), max(1, batch)):
        walk.size(k)
    return walk.chosen(len(order), walk.size(len(order)))


def select(rows: DataFrame, info: DatasetInfo, scores: list[BitScore], method: str = "adaptive", patience: int = 10, threshold: float = 0.1, decay: float = 0.5, counter: DistinctCounter | None = None) -> Selection:
    """Base bits of a normalised table; one job computes the curve, the choice is arithmetic."""
    order = entropy_order(scores)
    by_bit = {s.bit: s for s in scores}
    entropies = [by_bit[b].entropy for b in order]
    constants = sum(by_bit[b].constant for b in order)
    curve = (counter or ExactCounter()).curve(rows, info, order)
    n = scores[0].n
    if method == "naive":
        return select_naive(order, curve, constants, n, info, patience)
    if method == "threshold":
        return select_threshold(order, curve, constants, n, info, patience, entropies, threshold)
    if method == "adaptive":
        return select_adaptive(order, curve, constants, n, info, patience, entropies, decay)
    if method == "all":
        return profile_all(order, curve, n, info)
    raise ValueError(f"no selector is called {method}")


def trace(spark: SparkSession, selection: Selection) -> DataFrame:
    """A row per trial: prefix length, bit, distinct bases and the size's parts."""
    rows = [(i, k, bit, s.bases, s.size_bases, s.size_deviations, s.size_ids, s.size_params, s.total) for i, (k, bit, s) in enumerate(selection.trials)]
    return spark.createDataFrame(rows, "trial int, base_bits int, bit_position int, num_bases long, size_bases long, size_deviations long, size_ids long, size_params long, total_size long")
