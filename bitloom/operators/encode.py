"""Encodings of the rows (flat, run-length, Huffman) and of the sorted base table (tiered deltas)."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from bitloom.errors import InvalidMetadata
from bitloom.functions.bits import pack
from bitloom.operators.basetable import Layout
from bitloom.operators.ordered import with_position, with_previous, with_running_total
from bitloom.schema import DatasetInfo, bits_needed_nonzero

#: Rows of a block; blocks are encoded apart, so that rows can be reached by block.
BLOCK_ROWS = 1024
#: Longest run and longest stretch of literals of one pair (fixed values).
MAX_RUN, MAX_LITERALS = 136, 135
#: Longest Huffman code (fixed value).
MAX_CODE = 24
#: Symbols a Huffman code is built for on the driver; beyond, the flat encoding is used.
MAX_SYMBOLS = 1_000_000
#: Payload widths of the delta codes (fixed values): unary prefixes, and prefixes of 6 bits.
UNARY_TIERS = (9, 19, 28, 37, 45, 54, 63, 73, 82, 89, 97, 106, 115, 123, 131, 140, 147, 156, 163, 170, 175, 180, 185, 189, 193, 197, 202, 207, 210, 212)
FIXED_TIERS = (
    1, 3, 5, 6, 7, 9, 11, 12, 14, 15, 17, 19, 20, 22, 24, 26, 28, 29, 31, 33, 35, 37, 39, 41, 43, 45, 47, 49, 51, 54, 57, 60, 63, 65, 68, 71, 73, 76, 79, 82, 85, 88, 91, 94, 97, 100,
    104, 107, 111, 115, 119, 123, 128, 133, 140, 145, 150, 156, 162, 170, 177, 187, 197, 212,
)
FIXED_PREFIX = 6


# run lengths


def islands(encoded: DataFrame, symbol: list[str], block: str = "block_id") -> DataFrame:
    """Maximal stretches of equal neighbours in a block: block, start, length and the symbol's columns.

    A window spans one block of bounded size; nothing is sorted globally.
    """
    w = Window.partitionBy(block).orderBy("row_idx")
    same = [F.col(f"`{c}`").eqNullSafe(F.lag(f"`{c}`").over(w)) for c in symbol]
    changed = F.lag("row_idx").over(w).isNull()
    for s in same:
        changed = changed | ~s
    numbered = encoded.select(block, "row_idx", *symbol, changed.cast("int").alias("_new")).withColumn("_island", F.sum("_new").over(w))
    return numbered.groupBy(block, "_island", *symbol).agg(F.min("row_idx").alias("start"), F.count("*").alias("length")).drop("_island")


def run_pairs(encoded: DataFrame, symbol: list[str], block: str = "block_id") -> DataFrame:
    """Control pairs (r, m) of each block in order: an optional run of r + 1 equal symbols, then m literals.

    Islands are cut after MAX_RUN; pieces of one symbol are literals; a run starts a pair,
    and so does each stretch of MAX_LITERALS after the first.
    """
    pieces = islands(encoded, symbol, block).select(block, "start", "length", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / MAX_RUN).cast("int"))).alias("_p"))
    pieces = pieces.select(block, (F.col("start") + F.col("_p") * MAX_RUN).alias("start"), F.least(F.lit(MAX_RUN), F.col("length") - F.col("_p") * MAX_RUN).alias("length"))
    w = Window.partitionBy(block).orderBy("start")
    grouped = pieces.withColumn("_run", (F.col("length") > 1).cast("int")).withColumn("_pair", F.sum("_run").over(w))
    pairs = grouped.groupBy(block, "_pair").agg(F.min("start").alias("start"), F.max(F.when(F.col("_run") == 1, F.col("length"))).alias("run"), F.sum(1 - F.col("_run")).alias("literals"))
    pairs = pairs.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("literals") / MAX_LITERALS) - 1, F.lit(0)).cast("int"))).alias("_q"))
    run = F.when(F.col("_q") == 0, F.coalesce("run", F.lit(0))).otherwise(0)
    start = F.when(F.col("_q") == 0, F.col("start")).otherwise(F.col("start") + F.coalesce("run", F.lit(0)) + F.col("_q") * MAX_LITERALS)
    literals = F.least(F.lit(MAX_LITERALS), F.col("literals") - F.col("_q") * MAX_LITERALS)
    return pairs.select(block, start.alias("start"), F.when(run > 0, run - 1).otherwise(0).cast("int").alias("r"), literals.cast("int").alias("m"))


def control_bits(value: Column) -> Column:
    """Bits a control value is accounted with."""
    return F.when(value <= 7, 4).otherwise(8)


def pair_offsets(pairs: DataFrame, symbol_bits: int, block: str = "block_id") -> DataFrame:
    """For each block the number of its first pair and of its first symbol's bit."""
    symbols = F.col("m") + (F.col("r") > 0).cast("int")
    per_block = pairs.groupBy(block).agg(F.count("*").alias("pairs"), (F.sum(symbols) * symbol_bits).alias("bits"))
    placed = with_position(per_block, [F.col(block)], "_i")
    return with_running_total(with_running_total(placed, "_i", "pairs", "pair_offset"), "_i", "bits", "bit_offset").drop("_i")


def expand_runs(runs: DataFrame, symbol: list[str]) -> DataFrame:
    """Islands (start, length, symbol) back to rows."""
    return runs.select(F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("row_idx"), *symbol)


# Huffman


def code_lengths(frequencies: dict[int, int], longest: int = MAX_CODE) -> dict[int, int]:
    """Huffman code lengths; ties go to the subtree with the smaller symbol.  Longer ones than ``longest`` are limited."""
    symbols = sorted(frequencies)
    n = len(symbols)
    if n <= 1:
        return dict.fromkeys(symbols, 1)
    # an entry is one number, (weight, least symbol's place, node), as a tuple takes three times the memory
    parent, nodes = np.zeros(2 * n - 1, dtype=np.int32), 2 * n
    heap = [(frequencies[s] * n + i) * nodes + i for i, s in enumerate(symbols)]
    heapq.heapify(heap)
    for node in range(n, 2 * n - 1):
        (a, i), (b, j) = divmod(heapq.heappop(heap), nodes), divmod(heapq.heappop(heap), nodes)
        parent[i] = parent[j] = node
        heapq.heappush(heap, ((a // n + b // n) * n + min(a % n, b % n)) * nodes + node)
    depth = np.zeros(2 * n - 1, dtype=np.int32)
    for node in range(2 * n - 3, -1, -1):
        depth[node] = depth[parent[node]] + 1
    if depth.max() > longest:
        return limited_lengths(frequencies, longest)
    return dict(zip(symbols, depth[:n].tolist(), strict=True))


def limited_lengths(frequencies: dict[int, int], longest: int) -> dict[int, int]:
    """Optimal code lengths up to ``longest`` by package-merge.

    Of a level only the weights and which items are leaves are kept: the items taken of it are its
    first, so each time their leaves are the rarest symbols, and their packages the first items of the level before.
    """
    n = len(frequencies)
    if n > 1 << longest:
        raise InvalidMetadata(f"{n} symbols don't fit codes of {longest} bits")
    symbols = sorted(frequencies, key=lambda s: (frequencies[s], s))
    leaves = np.array([frequencies[s] for s in symbols], dtype=np.int64)
    items, levels = leaves[:0], []
    for _ in range(longest):
        pairs = len(items) // 2
        both = np.concatenate([items[: 2 * pairs : 2] + items[1 : 2 * pairs : 2], leaves])
        order = np.argsort(both, kind="stable")
        items = both[order]
        levels.append(order >= pairs)
    lengths, taken = np.zeros(n, dtype=np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        some = int(is_leaf[:taken].sum())
        lengths[:some] += 1
        taken = 2 * (taken - some)
    return dict(zip(symbols, lengths.tolist(), strict=True))


def canonical_codes(lengths: dict[int, int]) -> list[tuple[int, int, int]]:
    """(symbol, length, code) by length, then symbol; codes count up."""
    out, code, before = [], 0, 0
    for symbol, length in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= length - before
        if code >> length:
            raise InvalidMetadata("code lengths are no prefix code")
        out.append((symbol, length, code))
        code, before = code + 1, length
    return out


def code_table(spark: SparkSession, bases: DataFrame, longest: int = MAX_CODE) -> DataFrame:
    """base_id, code_len up to ``longest``, code of a base table with counts; ids themselves, all of one length, if there are more than MAX_SYMBOLS."""
    n = bases.count()
    if n > MAX_SYMBOLS:
        return bases.select("base_id", F.lit(bits_needed_nonzero(n)).cast("int").alias("code_len"), F.col("base_id").alias("code"))
    lengths = code_lengths({r["base_id"]: r["cnt"] for r in bases.select("base_id", "cnt").collect()}, longest)
    return spark.createDataFrame(canonical_codes(lengths), "base_id long, code_len int, code long")


def block_code_offsets(encoded: DataFrame, codes: DataFrame, block: str = "block_id") -> DataFrame:
    """For each block the bit its codes start at, and their bits."""
    per_block = encoded.join(codes, "base_id").groupBy(block).agg(F.sum("code_len").cast("bigint").alias("bits"))
    return with_running_total(with_position(per_block, [F.col(block)], "_i"), "_i", "bits", "bit_offset").drop("_i")


# base table deltas


def tier_of(bit_length: Column, tiers: tuple[int, ...], key_bits: int) -> tuple[Column, Column]:
    """Tier and payload bits of a delta; deltas beyond the last tier are written whole, in ``key_bits``."""
    tier, width = F.lit(len(tiers)), F.lit(key_bits)
    for i, w in reversed(list(enumerate(tiers))):
        tier, width = F.when(bit_length <= w, i).otherwise(tier), F.when(bit_length <= w, w).otherwise(width)
    return tier, width


def fixed_tiers() -> tuple[int, ...]:
    """The tiers of the 6-bit prefix: the last code would be the overflow's."""
    return FIXED_TIERS[:63]


def sort_keys(bases: DataFrame, info: DatasetInfo, layout: Layout, order: list[int]) -> DataFrame:
    """base_id and the integer whose descending order is the table's; keys up to 63 bits are BIGINT, up to 126 DECIMAL."""
    bits = [layout.variable[i] for i in order]
    if len(bits) > 126:
        raise InvalidMetadata(f"keys of {len(bits)} bits have no native integer; the table is kept as it is")
    if len(bits) <= 63:
        return bases.select("base_id", pack(info, bits[::-1]).alias("key"))
    high, low = bits[:-63], bits[-63:]
    wide = pack(info, high[::-1]).cast("decimal(19,0)") * F.lit(str(1 << 63)).cast("decimal(19,0)") + pack(info, low[::-1]).cast("decimal(19,0)")
    return bases.select("base_id", wide.cast("decimal(38,0)").alias("key"))


def bit_length(value: Column, kind: str) -> Column:
    """Bits of a number from 0 up to below 2^126, exactly; wide ones are cut in two halves of 63 bits."""

    def of_long(x: Column) -> Column:
        return F.when(x == 0, 0).otherwise(F.length(F.bin(x)))

    if kind == "bigint":
        return of_long(value).cast("int")
    half = F.lit(str(1 << 63)).cast("decimal(38,0)")
    low = (value % half).cast("bigint")
    high = F.call_function("div", (value - value % half).cast("decimal(38,0)"), half).cast("bigint")
    return F.when(high > 0, of_long(high) + 63).otherwise(of_long(low)).cast("int")


def deltas(keys: DataFrame, unary: bool = True, key_bits: int = 63) -> DataFrame:
    """For each base but the first: base_id, delta - 1, its bit length, tier, prefix and payload bits.

    The row before is found by its dense id, an equi-join, not a global sort.
    """
    kind = dict(keys.dtypes)["key"]
    d = (F.col("prev_key") - F.col("key") - 1).cast(kind)
    found = with_previous(keys, "base_id", ["key"]).where("prev_key is not null").select("base_id", d.alias("delta"))
    found = found.withColumn("bit_length", bit_length(F.col("delta"), kind))
    tiers = UNARY_TIERS if unary else fixed_tiers()
    tier, width = tier_of(F.col("bit_length"), tiers, key_bits)
    prefix = F.when(tier == len(tiers), len(tiers)).otherwise(tier + 1) if unary else F.lit(FIXED_PREFIX)
    return found.select("base_id", "delta", "bit_length", tier.alias("tier"), prefix.alias("prefix_bits"), width.alias("payload_bits"))


def undo_deltas(first_key: int, found: DataFrame) -> DataFrame:
    """Keys again: the first minus what has come together, by running totals in blocks."""
    kind = dict(found.dtypes)["delta"]
    start = found.sparkSession.range(1).select(F.col("id").alias("base_id"), F.lit(0).cast(kind).alias("step"))
    steps = found.select("base_id", (F.col("delta") + 1).cast(kind).alias("step")).unionByName(start)
    first = F.lit(str(first_key)).cast(kind)
    return with_running_total(steps, "base_id", "step", "_sum").select("base_id", (first - F.col("_sum") - F.col("step")).cast(kind).alias("key"))


def symbol_bits(info: DatasetInfo, layout: Layout, n_bases: int) -> tuple[int, int]:
    """Deviation and id bits of a row."""
    return info.chunk_size - len(layout.selected), bits_needed_nonzero(n_bases)
