"""Best-fit packing by the sum-of-squares rule.

Documents become token ids and one closing id; only those longer than a sequence are
cut.  Pieces are placed one after the other: of all ways to place a piece (an open
sequence with enough room, or a new one), the one is taken after which the sum over
all gaps g of (number of open sequences with gap g) squared is smallest.  Pieces come in a
hashed order, the short ones last and by falling length, where they fill what is left;
a few limits of what counts as short are tried and the fewest sequences kept.

Each group of about ``GROUP`` pieces is packed by itself, so work and memory of a task
are bounded; a group wastes a few sequences at most (under 0.1 % of them).

Edge cases: a null text is an empty one, and an empty one is a piece of one token, the
closing id; a document of exactly ``capacity`` tokens is one piece and fills its
sequence; repeated rows are packed as often as they occur; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bitloom.llm.common import freeing, settle, small_batches, text_blocks

CAPACITY = 2048
END_ID = 0
#: Pieces packed together by one task.
GROUP = 1 << 16
#: Pieces up to one of these lengths are held back to the end.
SHORT = (128, 256, 64, CAPACITY)
#: Words whose ids a worker remembers, besides as many that it remembered before.
CACHED_WORDS = 400_000

LATIN = re.compile("[\x00-\xff]*")
PLAIN = re.compile("([a-zß-öø-ÿ]+)([.,;:!?]*)")
#: Byte-level vocabularies spell the bytes that print in Latin-1 as themselves and the others, in order, from U+0100 on.
BYTE_LETTERS = {b: 256 + k for k, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordEncoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, with the ids of words remembered.

    The tokenizer named must lower-case, split at blanks first and between letters and
    other characters next, as word-end BPE vocabularies do.  A text's ids are then those
    of its blank-separated parts in sequence, and a plain word followed by punctuation is
    the word's ids and the punctuation's.  A plain word (lower-case Latin-1 letters) goes
    straight to the BPE model, everything else through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {"": b""}
        self.before: dict[str, bytes] = {}

    def _plain(self, word: str) -> bytes:
        """Ids of a plain word; the model wants its UTF-8 bytes spelled as letters."""
        spelled = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LETTERS)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def learn(self, new: set[str]) -> None:
        known, before, hard = self.known, self.before, []
        for w in new:
            if (ids := before.get(w)) is not None:
                known[w] = ids
                continue
            if w.isascii() and w.isalpha() and w.islower():
                known[w] = self._plain(w)
                continue
            m = PLAIN.fullmatch(w)
            if m is None:
                hard.append(w)
                continue
            word, rest = m.groups()
            if (ids := known.get(word)) is None:
                ids = known[word] = before.get(word) or self._plain(word)
            if rest:
                if (after := known.get(rest)) is None:
                    after = known[rest] = self._whole([rest])[0]
                known[w] = ids + after
        for w, ids in zip(hard, self._whole(hard), strict=True):
            known[w] = ids

    def forget(self) -> None:
        """Drop what is remembered; the worker may idle on beside other stages."""
        self.known, self.before = {"": b""}, {}

    def _whole(self, parts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = []
        for t in texts:
            # lower-casing is the tokenizer's own first step for these characters; the names of special tokens stay
            if LATIN.fullmatch(t) and "<|" not in t:
                t = t.lower()
            parts.append(t.replace("\n", " ").split(" "))
        if len(self.known) > CACHED_WORDS:
            self.known, self.before = {"": b""}, self.known  # words in use come back from there
        self.learn(set().union(*parts).difference(self.known))
        known = self.known.__getitem__
        return [b"".join(map(known, p)) for p in parts]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker; the tokenizer is kept from task to task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def tokenize(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, number of the piece, its start in the document, length and crc32 of its ids."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def rows(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        words = encoder(tokenizer_path)
        for batch in batches:
            ids, out = batch.column("doc_id").to_pylist(), []
            for at, stop, texts in text_blocks(batch, "text", 4 << 20):
                for doc_id, coded in zip(ids[at:stop], words.encode(texts), strict=True):
                    coded += end
                    for k, b in enumerate(range(0, len(coded), 4 * capacity)):
                        part = coded[b : b + 4 * capacity]
                        out.append((doc_id, k, b // 4, len(part) // 4, zlib.crc32(part)))
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        words.forget()

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return chosen.mapInArrow(freeing(rows), PIECES)


def place(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, placed in the order given."""
    count = np.zeros(capacity + 1, dtype=np.int64)  # open sequences by gap
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset, made = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64), 0
    for i, size in enumerate(lengths.tolist()):
        # v[r]: how the sum of squares changes if the piece leaves a gap of r
        there = count[size:]
        v = 2 * (count[: capacity - size + 1] - there) + 2
        v[0] -= 1  # a full sequence isn't open
        v[there == 0] = np.iinfo(np.int64).max
        v[-1] = 2 * count[capacity - size] + 1 if size < capacity else 0
        gap = int(v.argmin())
        if gap == capacity - size:
            number, made = made, made + 1
        else:
            number = open_at[gap + size].pop()
            count[gap + size] -= 1
            offset[i] = capacity - gap - size
        if gap:
            open_at[gap].append(number)
            count[gap] += 1
        sequence[i] = number
    return sequence, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``pieces`` (a table that is cheap to read twice) with sequence_id and offset."""
    groups = max(1, -(-pieces.count() // group))

    def rows(batches):
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        lengths, order = table.column("length").to_numpy(), table.column("_order").to_numpy()
        best = None
        for most in SHORT:
            short = lengths <= most
            turn = np.lexsort((order, np.where(short, -lengths, 0), short))
            found = place(lengths[turn], capacity)
            if best is None or found[0].max() < best[1].max():
                best = turn, *found
            least = -(-int(lengths.sum()) // capacity)
            if best[1].max() + 1 <= least + least // 1000:
                break
        turn = best[0]
        sequence, offset = np.zeros(len(turn), dtype=np.int64), np.zeros(len(turn), dtype=np.int64)
        sequence[turn], offset[turn] = best[1:]
        sequence += table.column("_group")[0].as_py() << 32
        table = table.drop_columns(["_group", "_order"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        yield from table.combine_chunks().to_batches()

    hashed = pieces.withColumn("_order", F.xxhash64("doc_id", "piece", "ids_crc32")).withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    return hashed.repartitionById(groups, F.col("_group")).mapInArrow(freeing(rows), f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize and pack all documents.  The pieces are settled between, so no text is tokenized twice."""
    with small_batches(docs.sparkSession):
        pieces = settle(tokenize(docs, tokenizer_path, capacity), "pieces")
    return pack(pieces, capacity)
