"""N-gram Jaccard join by T-occurrence search.

Documents are sets of five-word shingles; two link when the Jaccard similarity of their
sets reaches 0.75.  The steps:

1. Equal sets become one set, known by a 128-bit hash of its shingles.  A task sends each
   set once, in batches; between tasks, equal sets are only merged after step 2.
2. An inverted index of all shingles, dealt by hash in slices of bounded size, tells for
   each batch which of its sets' shingles occur in another set.  A set of which less than
   3/4 do links with nothing and is done.  Shared passages alone therefore never make candidates.
   A shingle's rank by frequency ends at ``RARE_UPTO`` sets.  A shingle that reaches it is
   streamed on instead of gathered, so a line that a third of all texts hold needs no memory.
3. Of each set that is left only a prefix is indexed: as many of its rarest shingles as
   it needs for any partner to share one.  The sets in a shingle's list are candidates.
4. Sets whose lists hang together form a cluster.  A small cluster is searched in one step,
   every set as a query.  The sets of a larger one are cut into blocks by size and by the
   lists they are in, and blocks are searched against each other if they share a list, so
   that each pair that may link is tested once.  A step returns its sets' numbers of links
   and the edges that span them, not the pairs.

A search is DivideSkip: the query's inverted lists are sorted by length, the short ones
merged with counts, the long ones binary-probed for the sets that can still reach
the required overlap.  Every test is exact on the sets' 64-bit shingle hashes.

Edge cases: null, empty and blank texts have no shingle, component_id is their own
doc_id; fewer than five words make one shingle of the whole sequence; repeated rows
are copies like any others; a null doc_id takes part and gets the component of its
copies; an empty table gives an empty result.

Batches are made from rows in the order they are read, so ``docs`` should be a table, or settled:
a frame whose rows come in another order when a lost task runs again would mix batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from bitloom.llm.common import MOST_PARTS, freeing, input_bytes, join_unique, partitions, settle, small_batches, text_blocks
from bitloom.llm.components import components

WORDS = 5
#: 0.75 as a fraction, so that thresholds are exact.
SIMILAR = (3, 4)
#: Text whose shingles are gathered in one slice of the index.
SLICE_BYTES = 16 << 20
#: Sets that hold a shingle are counted up to here.
RARE_UPTO = 255
#: Entries of a slice beyond which its shingles of RARE_UPTO sets are passed on, and a block's share of a shingle from which a task counts it.
GATHERED, NOTICED = 4_000_000, 8
#: A cluster of more sets or shingles is cut in blocks; a block has a sixteenth of its sets, between the two bounds.
BLOCK, MOST_BLOCK = 256, 4096
BLOCK_SHINGLES, MOST_SHINGLES = 500_000, 4_000_000
#: Weight of a binary probe against a merge step when the long lists are chosen.
PROBE_COST = 0.02
#: A binary search costs as much as merging so many entries.
SCAN_COST = 16
#: Most ids to drop that are broadcast.
BROADCAST_IDS = 1_000_000


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; A-Z lower-cased, words split at ASCII blanks."""
    import xxhash

    words = text.encode().lower().split()  # on bytes, both are ASCII-only
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=n)
    width = min(n, WORDS)
    out = np.full(n - width + 1, 0x9E3779B97F4A7C15 + width, dtype=np.uint64)
    for k in range(width):
        out = (out ^ h[k : k + len(out)]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def needed(n: int) -> int:
    """The fewest shingles a set of ``n`` shares with any set it links to."""
    return -(-SIMILAR[0] * n // SIMILAR[1])


def required(n: int, m):
    """The overlap at which sets of ``n`` and ``m`` shingles link."""
    a, b = SIMILAR
    return -(-a * (n + m) // (a + b))


# step 1 and 2

#: A set's name, and its number of shingles.
NAME = np.dtype([("hi", "<i8"), ("lo", "<i8"), ("n", "<u4")])
_SIGN, _LOW = 1 << 63, (1 << 64) - 1
DEALT = "part int, slice int, doc_id long, hi long, lo long, n long, batch binary, names binary, owners binary, tokens binary, dfs binary"
_PACKED = ("batch", "names", "owners", "tokens", "dfs")
_DEALT = pa.schema([("part", pa.int32()), ("slice", pa.int32()), *[(c, pa.int64()) for c in ("doc_id", "hi", "lo", "n")], *[(c, pa.binary()) for c in _PACKED]])
#: Most sets of one batch: their places fit 16 bits.
_MOST = 1 << 16


def spread(values: np.ndarray, slices: int) -> np.ndarray:
    """A slice for each value, by its mixed upper bits."""
    return ((values * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(slices)).astype(np.int64)


def part_of(values: np.ndarray, slices: int, parts: int) -> np.ndarray:
    """The partition that a value's slice is in: a range of slices."""
    return spread(values, slices) * parts // slices


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal values."""
    if not len(sorted_values):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    starts = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])
    return starts, np.diff(np.r_[starts, len(sorted_values)])


def packed(batch: bytes, owner: np.ndarray, tokens: np.ndarray, dfs: np.ndarray | None = None) -> dict:
    """Entries of one batch: for each the place of its set in the batch, the shingle and, once it is known, the rank."""
    return {"batch": batch, "owners": owner.astype("<u2").tobytes(), "tokens": tokens.astype("<u8").tobytes(), "dfs": None if dfs is None else dfs.tobytes()}


def by_key(key: np.ndarray, batch: bytes, owner: np.ndarray, tokens: np.ndarray) -> Iterator[tuple[int, dict]]:
    """A packed row for each key."""
    order = np.argsort(key, kind="stable")
    key, owner, tokens = key[order], owner[order], tokens[order]
    for a, n in zip(*_runs(key), strict=True):
        yield int(key[a]), packed(batch, owner[a : a + n], tokens[a : a + n])


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["owners"], dtype="<u2"), np.frombuffer(row["tokens"], dtype="<u8")


def _in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _each(batches, columns: list[str], where: str) -> Iterator[dict]:
    """Rows of which column ``where`` isn't null, one by one, as the packed columns are large."""
    for batch in batches:
        some = batch.filter(batch.column(where).is_valid()).select(columns)
        for k in range(some.num_rows):
            yield some.slice(k, 1).to_pylist()[0]


#: Bytes of shingles that are regrouped at once.
_REGROUP = 64 << 20


def _regroup(slices: int):
    """Packed rows of a partition of several slices, dealt to its slices.  Batches stay apart, so rows are joined per batch before."""

    def rows(batches):
        held: dict[bytes, list[tuple]] = {}
        size = 0

        def dealt():
            out = []
            for batch, found in held.items():
                owner, tokens = (np.concatenate(c) for c in zip(*found, strict=True))
                out += [{"slice": k} | r for k, r in by_key(spread(tokens, slices), batch, owner, tokens)]
            for at in range(0, len(out), 10_000):
                yield pa.RecordBatch.from_pylist(out[at : at + 10_000], schema=_DEALT)

        for batch in batches:
            if (passed := batch.filter(pc.invert(batch.column("slice").is_valid()))).num_rows:
                yield passed.select(_DEALT.names).cast(_DEALT)
            for row in _each([batch], list(_PACKED), "tokens"):
                if row["names"] is None:
                    held.setdefault(row["batch"], []).append(unpacked(row))
                    size += len(row["tokens"])
            if size > _REGROUP:
                yield from dealt()
                held, size = {}, 0
        yield from dealt()

    return rows


class Frequent:
    """Shingles that a task has sent to the index for RARE_UPTO sets: the index knows their rank, so more needn't go there."""

    def __init__(self):
        self.known = self.seen = np.zeros(0, dtype=np.uint64)
        self.counts = np.zeros(0, dtype=np.int64)

    def add(self, tokens: np.ndarray) -> None:
        values, counts = np.unique(tokens, return_counts=True)
        often = counts >= NOTICED
        if not often.any():
            return
        values, place = np.unique(np.concatenate([self.seen, values[often]]), return_inverse=True)
        counts = np.bincount(place, weights=np.concatenate([self.counts, counts[often]])).astype(np.int64)
        done = counts >= RARE_UPTO
        self.known = np.union1d(self.known, values[done])
        left = np.flatnonzero(~done)
        if len(left) > 100_000:  # those seen most may still get there; the others go to the index as ever
            left = np.sort(left[np.argsort(-counts[left], kind="stable")[:50_000]])
        self.seen, self.counts = values[left], counts[left]


def _deal(slices: int, parts: int):
    """Batches of documents to rows for the index: one per document, one per batch with its sets, and one per batch and slice with shingles."""

    def rows(batches):
        import xxhash

        sent: set[int] = set()
        frequent, turn = Frequent(), 0
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for at, stop, texts in text_blocks(batch, "text", 4 << 20):
                out, found, names = [], [], []
                for doc_id, text in zip(ids[at:stop], texts, strict=True):
                    h, turn = shingles(text), turn + 1
                    if not len(h):
                        out.append({"part": turn % parts, "doc_id": doc_id, "n": 0})
                        continue
                    whole = xxhash.xxh3_128_intdigest(h.tobytes())
                    hi, lo = (whole >> 64) - _SIGN, (whole & _LOW) - _SIGN
                    out.append({"part": turn % parts, "doc_id": doc_id, "hi": hi, "lo": lo, "n": len(h)})
                    if whole not in sent:
                        sent.add(whole)
                        found.append(h)
                        names.append((hi, lo, len(h)))
                for first in range(0, len(found), _MOST):
                    some = np.array(names[first : first + _MOST], dtype=NAME).tobytes()
                    uid = xxhash.xxh3_128_digest(some)  # batches of the same name hold the same sets in the same places
                    held = found[first : first + _MOST]
                    tokens, owner = np.concatenate(held), np.repeat(np.arange(len(held)), [len(h) for h in held])
                    known = _in(tokens, frequent.known)
                    out.append({"part": turn % parts, "names": some} | packed(uid, owner[known], tokens[known], np.full(known.sum(), RARE_UPTO, dtype=np.uint8)))
                    tokens, owner = tokens[~known], owner[~known]
                    frequent.add(tokens)
                    out += [{"part": k, "slice": k} | r for k, r in by_key(part_of(tokens, slices, parts), uid, owner, tokens)]
                yield pa.RecordBatch.from_pylist(out, schema=_DEALT)

    return rows


class Postings:
    """The entries of one slice of the index, in batches.  Beyond GATHERED of them, those of frequent shingles are passed on."""

    def __init__(self):
        self.batches: list[list] = []  # name, places of sets, shingles
        self.size, self.room = 0, GATHERED
        self.frequent = np.zeros(0, dtype=np.uint64)

    def _out(self, batch: bytes, owner: np.ndarray, tokens: np.ndarray, ranks: np.ndarray | None = None) -> list[dict]:
        return [packed(batch, owner, tokens, np.full(len(tokens), RARE_UPTO, dtype=np.uint8) if ranks is None else ranks)] if len(tokens) else []

    def _counts(self) -> list[np.ndarray]:
        """For each batch how many sets have its shingles, a set counting once in each batch it is in."""
        every = np.concatenate([b[2] for b in self.batches])
        order = np.argsort(every, kind="stable")
        _, lengths = _runs(every[order])
        df = np.empty(len(every), dtype=np.int64)
        df[order] = np.repeat(lengths, lengths)
        return np.split(df, np.cumsum([len(b[2]) for b in self.batches])[:-1])

    def add(self, row: dict) -> list[dict]:
        owner, tokens = unpacked(row)
        out, known = [], _in(tokens, self.frequent)
        if known.any():
            out += self._out(row["batch"], owner[known], tokens[known])
            owner, tokens = owner[~known], tokens[~known]
        self.batches.append([row["batch"], owner, tokens])
        self.size += len(tokens)
        if self.size > self.room:
            frequent, left = [self.frequent], []
            for (batch, owner, tokens), df in zip(self.batches, self._counts(), strict=True):
                often = df >= RARE_UPTO
                out += self._out(batch, owner[often], tokens[often])
                frequent.append(tokens[often])
                left.append([batch, owner[~often], tokens[~often]])
            self.frequent, self.batches = np.unique(np.concatenate(frequent)), left
            self.size = sum(len(b[2]) for b in left)
            self.room = max(GATHERED, 2 * self.size)
        return out

    def finish(self) -> list[dict]:
        """What two sets or more hold, with its rank."""
        out = []
        for (batch, owner, tokens), df in zip(self.batches, self._counts() if self.batches else [], strict=True):
            shared = df > 1
            out += self._out(batch, owner[shared], tokens[shared], np.minimum(df[shared], RARE_UPTO).astype(np.uint8))
        return out


INDEXED = "doc_id long, hi long, lo long, n long, batch binary, names binary, owners binary, tokens binary, dfs binary"
_INDEXED = pa.schema([f for f in _DEALT if f.name not in ("part", "slice")])


def _index(batches):
    """The rows of one part, slice by slice: documents and sets pass; shingles that two sets or more hold get their ranks."""
    open_slice, postings = None, Postings()

    def emitted(found: list[dict]):
        for at in range(0, len(found), 1000):
            yield pa.RecordBatch.from_pylist(found[at : at + 1000], schema=_INDEXED)

    for batch in batches:
        if (passed := batch.filter(pc.invert(batch.column("slice").is_valid()))).num_rows:
            yield pa.RecordBatch.from_arrays([passed.column(f.name) for f in _INDEXED], schema=_INDEXED)
        for row in _each([batch], ["slice", *_PACKED], "slice"):
            if row["slice"] != open_slice:
                yield from emitted(postings.finish())
                open_slice, postings = row["slice"], Postings()
            yield from emitted(postings.add(row))
    yield from emitted(postings.finish())


SURVIVING = "hi long, lo long, n long, shared long, tokens binary"
_SURVIVING = pa.schema([*[(c, pa.int64()) for c in ("hi", "lo", "n", "shared")], ("tokens", pa.binary())])
#: Bytes of shingles in one batch of sets.
_BATCH = 8 << 20


def _surviving(batches):
    """The entries of one batch after the other to its sets of which enough shingles are shared, rarest shingles first."""
    from itertools import groupby

    for _, group in groupby(_each(batches, list(_PACKED), "batch"), key=lambda r: r["batch"]):
        names, found = None, []
        for row in group:
            names = row["names"] or names
            found.append((*unpacked(row), np.frombuffer(row["dfs"], dtype=np.uint8)))
        names = np.frombuffer(names, dtype=NAME)
        owner, tokens, dfs = (np.concatenate(c) for c in zip(*found, strict=True))
        n = names["n"].astype(np.int64)
        # entries come twice from batches of the same name, so this may keep too many; they are counted again below
        keep = (SIMILAR[1] * np.bincount(owner, minlength=len(names)) >= SIMILAR[0] * n)[owner]
        owner, tokens, dfs = owner[keep], tokens[keep], dfs[keep]
        order = np.lexsort((tokens, dfs, owner))
        owner, tokens = owner[order], tokens[order]
        first = np.r_[True, (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])] if len(tokens) else np.zeros(0, dtype=bool)
        owner, tokens = owner[first], tokens[first]
        out, size = [], 0
        for a, shared in zip(*_runs(owner), strict=True):
            k = owner[a]
            if SIMILAR[1] * shared < SIMILAR[0] * n[k]:
                continue
            out.append({"hi": int(names["hi"][k]), "lo": int(names["lo"][k]), "n": int(n[k]), "shared": int(shared), "tokens": tokens[a : a + shared].tobytes()})
            size += 8 * int(shared)
            if size > _BATCH:
                yield pa.RecordBatch.from_pylist(out, schema=_SURVIVING)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_SURVIVING)


# step 3


#: A surviving set's number, size, and shingles of its own.
SET = np.dtype([("sid", "<i8"), ("n", "<i8"), ("own", "<i8")])
PREFIXES = "part int, slice int, sets binary, tokens binary, of binary"
_PREFIXES = pa.schema([("part", pa.int32()), ("slice", pa.int32()), ("sets", pa.binary()), ("tokens", pa.binary()), ("of", pa.binary())])


def _prefix_rows(key: np.ndarray, sets: np.ndarray, of: np.ndarray, tokens: np.ndarray) -> list[dict]:
    """For each key its entries: the sets that have some, the shingles, and the place of each one's set."""
    order, out = np.argsort(key, kind="stable"), []
    key, of, tokens = key[order], of[order], tokens[order]
    for a, size in zip(*_runs(key), strict=True):
        used, local = np.unique(of[a : a + size], return_inverse=True)
        out.append({"slice": int(key[a]), "sets": sets[used].tobytes(), "tokens": tokens[a : a + size].astype("<u8").tobytes(), "of": local.astype("<u4").tobytes()})
    return out


def _prefix_entries(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sets, of, tokens, base = [], [], [], 0
    for row in rows:
        sets.append(np.frombuffer(row["sets"], dtype=SET))
        of.append(np.frombuffer(row["of"], dtype="<u4").astype(np.int64) + base)
        tokens.append(np.frombuffer(row["tokens"], dtype="<u8"))
        base += len(sets[-1])
    return np.concatenate(sets), np.concatenate(of), np.concatenate(tokens)


def _prefixes(slices: int, parts: int):
    """Surviving sets to packed prefix entries: their rarest shared shingles, as many as a partner must hit one of."""

    def rows(batches):
        for batch in batches:
            sets, tokens = [], []
            for sid, n, shared, t in zip(*(batch.column(c).to_pylist() for c in ("sid", "n", "shared", "tokens")), strict=True):
                tokens.append(np.frombuffer(t, dtype="<u8")[: shared - needed(n) + 1])
                sets.append((sid, n, n - shared))
            if sets:
                of, tokens = np.repeat(np.arange(len(sets)), [len(t) for t in tokens]), np.concatenate(tokens)
                out = _prefix_rows(part_of(tokens, slices, parts), np.array(sets, dtype=SET), of, tokens)
                yield pa.RecordBatch.from_pylist([{"part": r["slice"]} | r for r in out], schema=_PREFIXES)

    return rows


def _regroup_prefixes(slices: int):
    """Packed prefixes of a partition of several slices, dealt to its slices."""

    def rows(batches):
        held, size = [], 0
        for row in _each(batches, ["sets", "tokens", "of"], "slice"):
            held.append(row)
            size += len(row["tokens"])
            if size > _REGROUP:
                sets, of, tokens = _prefix_entries(held)
                yield pa.RecordBatch.from_pylist(_prefix_rows(spread(tokens, slices), sets, of, tokens), schema=_PREFIXES)
                held, size = [], 0
        if held:
            sets, of, tokens = _prefix_entries(held)
            yield pa.RecordBatch.from_pylist(_prefix_rows(spread(tokens, slices), sets, of, tokens), schema=_PREFIXES)

    return rows


def in_slices(rows: DataFrame, slices: int, parts: int, regroup, schema: str) -> DataFrame:
    """``rows`` dealt to their partitions, in which slices follow one another.

    A partition is one slice, unless there are more slices than a shuffle can serve; then a
    partition's rows are regrouped by slice, and Spark's sort, which spills, puts them in order.
    """
    dealt = rows.repartitionById(parts, F.col("part"))
    return dealt if slices == parts else dealt.mapInArrow(freeing(regroup(slices)), schema).sortWithinPartitions("slice")


#: Base of the size classes: sets that link differ by a ratio of 4/3 at most, so by one class.
CLASS_BASE = 1.334

LISTS = "list long, sid long, pivot long"


def _lists(batches):
    """Packed prefix entries, slice by slice, to the distinct lists of two sets or more, each with its pivot.

    A list's name is a hash of the sets in it, so equal lists of different shingles are one.
    """
    from itertools import groupby

    for _, group in groupby(_each(batches, ["slice", "sets", "tokens", "of"], "slice"), key=lambda r: r["slice"]):
        sets, of, tokens = _prefix_entries(list(group))
        rank = np.empty(len(sets), dtype=np.int64)  # pivots come first: few shingles of their own, then the smaller name
        rank[np.lexsort((sets["sid"], sets["own"] / np.maximum(sets["n"], 1)))] = np.arange(len(sets))
        order = np.lexsort((rank[of], tokens))
        tokens, of = tokens[order], of[order]
        starts, sizes = _runs(tokens)
        mixed = sets["sid"][of].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        names = (np.add.reduceat(mixed, starts) ^ sizes.astype(np.uint64)).view(np.int64)
        keep = np.flatnonzero(sizes > 1)
        keep = keep[np.unique(names[keep], return_index=True)[1]]
        for block in np.array_split(keep, max(1, int(sizes[keep].sum()) // 100_000 + 1)) if len(keep) else []:
            at = np.concatenate([np.arange(starts[k], starts[k] + sizes[k]) for k in block]) if len(block) else np.zeros(0, dtype=int)
            pivot = np.repeat(of[starts[block]], sizes[block])
            columns = [np.repeat(names[block], sizes[block]), sets["sid"][of[at]], sets["sid"][pivot]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["list", "sid", "pivot"])


# step 4


class Lists:
    """Inverted lists of a block of sets: for each shingle, ascending, the places of the sets that hold it."""

    def __init__(self, held: list[np.ndarray], sizes: list[int]):
        tokens, owner = np.concatenate(held), np.repeat(np.arange(len(held)), [len(t) for t in held])
        order = np.argsort(tokens, kind="stable")
        tokens, self.owner = tokens[order], owner[order]
        self.starts, self.lengths = _runs(tokens)
        self.tokens, self.sizes = tokens[self.starts], np.array(sizes)
        self.keys = np.repeat(np.arange(len(self.starts)), self.lengths) * len(held) + self.owner

    def of(self, query: np.ndarray) -> np.ndarray:
        """The numbers of the query's lists."""
        at = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        return at[self.tokens[at] == query]

    def merged(self, lists: np.ndarray) -> np.ndarray:
        """For each set in how many of the lists it is."""
        lengths = self.lengths[lists]
        upto = np.cumsum(lengths)
        at = np.repeat(self.starts[lists] - upto + lengths, lengths) + np.arange(upto[-1] if len(upto) else 0)
        return np.bincount(self.owner[at], minlength=len(self.sizes))

    def probed(self, lists: np.ndarray, sets: np.ndarray) -> np.ndarray:
        """The same for some sets only, by binary search of each in each list."""
        wanted = lists[:, None] * len(self.sizes) + sets[None, :]
        at = np.minimum(np.searchsorted(self.keys, wanted.ravel()), len(self.keys) - 1)
        return (self.keys[at].reshape(wanted.shape) == wanted).sum(axis=0)


def divide_skip(lists: Lists, query: np.ndarray, n: int) -> np.ndarray:
    """Places of the indexed sets that link with a query of ``n`` shingles, of which ``query`` are those any may hold.

    The short lists are merged with counts.  Only sets that could still reach the required overlap
    are looked up in the long ones; where they are so many that merging costs less, these are merged, too.
    """
    least, own = needed(n), lists.of(query)
    if len(own) < least:
        return np.zeros(0, dtype=np.int64)
    own = own[np.argsort(lists.lengths[own], kind="stable")]
    skipped = min(least - 1, int(least / (PROBE_COST * math.log2(lists.lengths[own[-1]] + 1) + 1)))
    short, long = own[: len(own) - skipped], own[len(own) - skipped :]
    counts = lists.merged(short)
    found = np.flatnonzero(counts >= max(1, least - skipped))
    wanted = required(n, lists.sizes[found])
    alive = counts[found] + skipped >= wanted
    found, wanted = found[alive], wanted[alive]
    if not len(found):
        return found
    by_probe = SCAN_COST * len(found) * skipped < lists.lengths[long].sum()
    more = lists.probed(long, found) if by_probe else lists.merged(long)[found]
    return found[counts[found] + more >= wanted]


#: What a row is in its task: in the index and a query, in the index only, a query only.
BOTH, INDEX, QUERY = 0, 1, 2
FOUND = "u long, v long, links long"


def _search(batches):
    """Rows sorted by task to (set, a linked set that spans its group in the task, documents in the sets it links to there)."""
    from itertools import chain

    def tasks():
        key, rows = None, []
        for row in chain.from_iterable(zip(*(b.column(c).to_pylist() for c in ("task", "side", "sid", "n", "n_copies", "tokens")), strict=True) for b in batches):
            if row[0] != key:
                if rows:
                    yield rows
                key, rows = row[0], []
            rows.append(row)
        if rows:
            yield rows

    out = []
    for rows in tasks():
        index, queries = [r for r in rows if r[1] != QUERY], [r for r in rows if r[1] != INDEX]
        if not index or not queries:
            continue
        lists = Lists([np.frombuffer(r[5], dtype="<u8") for r in index], [r[3] for r in index])
        both = queries[0][1] == BOTH  # a step's rows are all queries and indexed, or each is one of them
        nodes = index if both else index + queries
        copies, links = np.array([r[4] for r in nodes]), np.zeros(len(nodes), dtype=np.int64)
        group = np.arange(len(nodes))
        for q, (_, _, _, n, n_copies, t) in enumerate(queries, 0 if both else len(index)):
            found = divide_skip(lists, np.frombuffer(t, dtype="<u8"), n)
            if both:
                found = found[found > q]  # each two sets once
            if not len(found):
                continue
            links[q] += copies[found].sum()
            links[found] += n_copies
            for other in np.unique(group[found]):
                if other != group[q]:
                    group[group == max(other, group[q])] = min(other, group[q])
        linked = np.flatnonzero(links)
        out += [(nodes[k][2], nodes[group[k]][2], int(links[k])) for k in linked]
        if len(out) > 50_000:
            yield _found(out)
            out = []
    if out:
        yield _found(out)


def _found(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["u", "v", "links"])


def _run_search(rows: DataFrame, n_tasks: int) -> DataFrame:
    """``rows``: task, side, sid, n, n_copies, tokens."""
    parts = max(1, min(n_tasks, 4 * partitions(rows.sparkSession)))
    dealt = rows.repartition(parts, "task").sortWithinPartitions("task", "side", "sid")
    # summed in a shuffle, as each of very many tasks would write a file of the few links it finds
    return settle(dealt.mapInArrow(freeing(_search), FOUND).groupBy("u", "v").agg(F.sum("links").alias("links")), "links")


def _blocks(count: Column, shingles_: Column) -> Column:
    """Into how many blocks so many sets are cut."""
    size = F.greatest(F.lit(BLOCK), F.least(F.lit(MOST_BLOCK), F.floor(count / 16)))
    return F.greatest(F.ceil(count / size), F.ceil(shingles_ / MOST_SHINGLES), F.lit(1)).cast("long")


def _tasks(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """Steps of the search (task, side, sid, n, n_copies), so that each two sets that may link meet in one.

    Sets that link share a list, so they are in one cluster, and their sizes are in neighbouring
    classes.  A class of a large cluster is cut by hashes of the sets' first lists, so that sets
    of the same lists are together, and parts that are still too large by hashes of the sets.
    """
    clusters = components(lists.select(F.col("sid").alias("u"), F.col("pivot").alias("v"))).withColumnRenamed("node", "sid").withColumnRenamed("component", "cluster")
    members = settle(sets.join(clusters, "sid"), "clusters")
    sized = settle(members.groupBy("cluster").agg(F.count("*").alias("_rows"), F.sum("n").alias("shingles")), "sizes")
    big = settle(sized.where((F.col("_rows") > BLOCK) | (F.col("shingles") > BLOCK_SHINGLES)).select("cluster", F.lit(True).alias("big")), "big")
    members = join_unique(members, big, ["cluster"], sized.select("cluster", "_rows"))
    small = members.where("big IS NULL").select(F.xxhash64("cluster").alias("task"), F.lit(BOTH).alias("side"), "sid", "n", "n_copies")
    if not big.head(1):
        return small
    cut = members.where("big").select("cluster", F.floor(F.log(F.col("n").cast("double")) / math.log(CLASS_BASE)).cast("int").alias("class"), "sid", "n", "n_copies")
    held = settle(lists.select("list", "sid").join(cut, "sid"), "held")
    placed = held.groupBy("cluster", "class", "sid", "n", "n_copies").agg(F.min("list").alias("first"))
    own = settle(placed.groupBy("cluster", "class").agg(F.count("*").alias("_rows"), _blocks(F.count("*"), F.sum("n")).alias("blocks")), "classes")
    placed = join_unique(placed, own.drop("_rows"), ["cluster", "class"], own.select("cluster", "class", "_rows"))
    placed = settle(placed.withColumn("group", F.pmod(F.xxhash64("first"), "blocks")).select("cluster", "class", "group", "sid", "n", "n_copies", "blocks"), "groups")
    # a group gets as many blocks as its share of the class
    share = placed.groupBy("cluster", "class", "group").agg(F.count("*").alias("_rows"), F.sum("n").alias("shingles"))
    whole = own.select("cluster", "class", F.col("_rows").alias("all"), F.col("blocks").alias("of"))
    share = settle(share.join(whole, ["cluster", "class"]).withColumn("parts", F.greatest(F.ceil(F.col("_rows") * F.col("of") / F.col("all")), F.ceil(F.col("shingles") / MOST_SHINGLES)).cast("long")).select("cluster", "class", "group", "parts", "_rows"), "shares")
    placed = join_unique(placed, share.drop("_rows"), ["cluster", "class", "group"], share.drop("parts"))
    block = F.xxhash64("cluster", "class", "group", F.pmod(F.xxhash64("sid"), "parts"))
    placed = settle(placed.select("sid", "n", "n_copies", "class", block.alias("block")), "blocks")
    # the blocks in each list; lists of the same blocks are one
    lies = settle(held.select("list", "sid").join(placed.select("sid", "class", "block"), "sid").select("list", "class", "block").distinct(), "lies")
    alike = lies.groupBy("list").agg(F.sum(F.xxhash64("block").cast("decimal(38,0)")).alias("s"), F.count("*").alias("c")).groupBy("s", "c").agg(F.min("list").alias("list")).select("list")
    lies = lies.join(alike, "list", "left_semi")
    left = lies.select("list", "block", "class", F.explode(F.array("class", F.col("class") + 1)).alias("class2"))
    right = lies.select("list", F.col("block").alias("block2"), F.col("class").alias("class2"))
    pairs = left.join(right, ["list", "class2"]).where((F.col("class2") > F.col("class")) | (F.col("block2") >= F.col("block"))).select("block", "block2").distinct()
    pairs = settle(pairs.withColumn("task", F.xxhash64("block", "block2")), "pairs")
    same = F.col("block") == F.col("block2")
    first = pairs.select("block", "task", F.when(same, BOTH).otherwise(INDEX).alias("side"))
    second = pairs.where(~same).select(F.col("block2").alias("block"), "task", F.lit(QUERY).alias("side"))
    return small.unionByName(placed.join(first.unionByName(second), "block").select("task", "side", "sid", "n", "n_copies"))


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every document; n_copies counts the documents with an equal set, n_links the other documents it links to."""
    with small_batches(docs.sparkSession):
        return _link(docs, id_col, text_col)


def _link(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    # a slice is worked on in memory; a partition holds one, or several in turn where there are very many
    slices = max(partitions(docs.sparkSession), -(-(input_bytes(docs) or 0) // SLICE_BYTES))
    parts = min(slices, max(MOST_PARTS, partitions(docs.sparkSession)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = in_slices(rows.mapInArrow(freeing(_deal(slices, parts)), DEALT), slices, parts, _regroup, DEALT)
    indexed = settle(dealt.mapInArrow(freeing(_index), INDEXED), "index")
    members = indexed.where("batch is null").select("doc_id", "hi", "lo", "n")
    sets = settle(members.where("hi is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_copies")), "sets")
    entries = indexed.where("batch is not null").select(*_PACKED).repartition(parts, "batch").sortWithinPartitions("batch")
    surviving = settle(entries.mapInArrow(freeing(_surviving), SURVIVING).withColumn("sid", F.monotonically_increasing_id()), "surviving")
    known = settle(surviving.groupBy("hi", "lo").agg(F.min("sid").alias("sid"), F.first("n").alias("n"), F.count("*").alias("times")).join(sets, ["hi", "lo"]), "known")
    if known.where("times > 1").head(1):  # sets that more than one task has sent
        again = surviving.select("sid").join(known.select("sid"), "sid", "left_anti")
        surviving = settle(surviving.join(again, "sid", "left_anti"), "surviving")
    prefixes = surviving.select("sid", "n", "shared", "tokens").mapInArrow(freeing(_prefixes(slices, parts)), PREFIXES)
    lists = settle(in_slices(prefixes, slices, parts, _regroup_prefixes, PREFIXES).mapInArrow(freeing(_lists), LISTS).distinct(), "lists")
    tasks = settle(_tasks(lists, known.select("sid", "n", "n_copies")), "tasks")
    n_tasks = tasks.select("task").distinct().count()
    found = _run_search(tasks.join(surviving.select("sid", "tokens"), "sid").select("task", "side", "sid", "n", "n_copies", "tokens"), n_tasks)
    linked = found.groupBy("u").agg(F.sum("links").alias("links"))
    named = components(found.select("u", "v")).join(linked, F.col("node") == F.col("u")).join(known, F.col("node") == F.col("sid")).select("hi", "lo", "component", "first", "links")
    named = settle(named, "named")
    lowest = settle(named.groupBy("component").agg(F.min("first").alias("lowest"), F.count("*").alias("_rows")), "lowest")
    named = join_unique(named, lowest.drop("_rows"), ["component"], lowest.drop("lowest")).select("hi", "lo", "lowest", "links")
    # what a set of one document that links with nothing gets needs no join
    of_set = sets.join(named, ["hi", "lo"], "left").where("n_copies > 1 or links is not null")
    of_set = settle(of_set.select("hi", "lo", F.coalesce("lowest", "first").alias("component_id"), "n_copies", (F.coalesce("links", F.lit(0)) + F.col("n_copies") - 1).alias("n_links")), "of-set")
    weights = sets.where("n_copies > 1").select("hi", "lo", F.col("n_copies").alias("_rows"))
    joined = join_unique(members.where("hi is not null"), of_set, ["hi", "lo"], weights)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    joined = joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_copies", one).alias("n_copies"), F.coalesce("n_links", none).alias("n_links"))
    alone = members.where("hi is null").select("doc_id", none.alias("n_shingles"), F.col("doc_id").alias("component_id"), one.alias("n_copies"), none.alias("n_links"))
    return joined.unionByName(alone)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id.

    The ids to drop are broadcast if there are at most ``BROADCAST_IDS``; else both sides
    are shuffled by id.  Rows that share an id and a text count as one document, and rows without
    an id stay unless they are copies of one with an id.
    """
    linked = settle(link(docs, id_col, text_col), "linked")
    dropped = settle(linked.where("doc_id != component_id").select(F.col("doc_id").alias("_drop")).distinct(), "dropped")
    few = dropped.count() <= BROADCAST_IDS
    kept = docs.join(F.broadcast(dropped) if few else dropped, docs[id_col] == dropped["_drop"], "left_anti")
    repeated = linked.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select(F.col("doc_id").alias("_twice"))
    if repeated.head(1):
        repeated = settle(repeated, "repeated")
        again = kept.join(repeated, kept[id_col] == repeated["_twice"], "left_semi").dropDuplicates([id_col, text_col])
        kept = kept.join(repeated, kept[id_col] == repeated["_twice"], "left_anti").unionByName(again)
    if linked.where("doc_id is null and component_id is not null").head(1):
        ids = linked.where("doc_id is not null").select("doc_id")
        named = docs.join(ids, docs[id_col] == ids["doc_id"], "left_semi").select(F.col(text_col).alias("_text")).distinct()
        kept = kept.where(F.col(id_col).isNotNull()).unionByName(kept.where(F.col(id_col).isNull()).join(named, F.col(text_col) == F.col("_text"), "left_anti"))
    return kept
