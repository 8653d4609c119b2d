"""The base table: distinct base patterns with counts and ids, and each row's id and deviation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from bitloom.errors import InvalidBaseId
from bitloom.functions.bits import LIMB, base_columns, bit, deviation_columns, pack
from bitloom.operators.entropy import binary_entropy
from bitloom.operators.ordered import with_position
from bitloom.schema import DatasetInfo

#: Per-bit state in a layout (fixed values of the container formats).
DEVIATION, VARIABLE, ZERO, ONE = 0, 1, 2, 3
#: Base tables up to this many bytes are broadcast to the rows; larger ones are joined by shuffle.
BROADCAST_BYTES = 32 << 20


@dataclass(frozen=True)
class Layout:
    """State of every bit, and the selected bits in the order they were taken."""

    states: tuple[int, ...]
    selected: tuple[int, ...]

    @classmethod
    def of(cls, info: DatasetInfo, selected: list[int], zeros: list[int], ones: list[int]) -> Layout:
        states = [DEVIATION] * info.chunk_size
        for b in selected:
            states[b] = VARIABLE
        chosen = set(selected)
        for bits, state in ((zeros, ZERO), (ones, ONE)):
            for b in bits:
                if b in chosen:
                    states[b] = state
        return cls(tuple(states), tuple(selected))

    def positions(self, state: int) -> list[int]:
        return [b for b, s in enumerate(self.states) if s == state]

    @property
    def variable(self) -> list[int]:
        """Base bits that aren't constant, ascending."""
        return self.positions(VARIABLE)

    @property
    def deviation(self) -> list[int]:
        return self.positions(DEVIATION)


def union_positions(*lists: list[int]) -> list[int]:
    """Distinct positions, ascending."""
    return sorted(set().union(*lists))


def new_positions(mask: set[int], positions: list[int]) -> list[int]:
    """Positions not in the mask yet, each once, in the order given."""
    return [p for p in dict.fromkeys(positions) if p not in mask]


def column_order(bases: DataFrame, info: DatasetInfo, variable: list[int]) -> list[int]:
    """The variable bits by ascending entropy over the base table, where each base counts once; indices into ``variable``."""
    if not variable:
        return []
    row = bases.agg(F.count("*").alias("n"), *[F.sum(bit(info, b)).alias(f"b{b}") for b in variable]).first()
    return sorted(range(len(variable)), key=lambda i: (min(row[f"b{variable[i]}"] or 0, row["n"] - (row[f"b{variable[i]}"] or 0)), i))


def build(rows: DataFrame, info: DatasetInfo, layout: Layout, in_order: bool = False) -> tuple[DataFrame, list[int] | None]:
    """Bases (base_id, feature columns masked to the base bits, cnt, first_row), and the column order if sorted.

    Ids are dense: by first occurrence, or descending by the column order.
    """
    columns = base_columns(info, list(layout.selected))
    names = [f.name for f in info.features]
    grouped = rows.select("row_idx", *[c.alias(n) for n, c in columns.items()]).groupBy(*names).agg(F.count("*").alias("cnt"), F.min("row_idx").alias("first_row"))
    if not in_order:
        return with_position(grouped, [F.col("first_row")], "base_id").select("base_id", *names, "cnt", "first_row"), None
    order = column_order(grouped, info, layout.variable)
    bits = [layout.variable[i] for i in order]
    limbs = [pack(info, bits[i : i + LIMB][::-1]).desc() for i in range(0, len(bits), LIMB)] or [F.col("first_row")]
    return with_position(grouped, limbs, "base_id").select("base_id", *names, "cnt", "first_row"), order


def _join(left: DataFrame, bases: DataFrame, condition, n_bases: int | None) -> DataFrame:
    small = n_bases is not None and 8 * n_bases * len(bases.columns) <= BROADCAST_BYTES  # all columns are longs
    return left.join(F.broadcast(bases) if small else bases, condition)


def assign(rows: DataFrame, info: DatasetInfo, layout: Layout, bases: DataFrame, n_bases: int | None = None, block: int | None = 1024) -> DataFrame:
    """Rows as (row_idx, block_id, base_id, deviation columns)."""
    names = [f.name for f in info.features]
    base, deviation = base_columns(info, list(layout.selected)), deviation_columns(info, list(layout.selected))
    split = rows.select("row_idx", *[base[n].alias(f"_b_{n}") for n in names], *[deviation[n].alias(n) for n in names])
    table = bases.select("base_id", *[F.col(f"`{n}`").alias(f"_t_{n}") for n in names])
    condition = [F.col(f"_b_{n}") == F.col(f"_t_{n}") for n in names if any(info.place(b)[0] == n for b in layout.selected)]
    # without base bits there is one base, and nothing to join on
    joined = _join(split, table, condition, n_bases) if condition else split.withColumn("base_id", F.lit(0).cast("bigint"))
    out = joined.select("row_idx", "base_id", *names)
    return out.withColumn("block_id", F.floor(F.col("row_idx") / block)) if block else out


def merge(encoded: DataFrame, info: DatasetInfo, bases: DataFrame, n_bases: int | None = None, check: bool = False) -> DataFrame:
    """Encoded rows back to normalised rows: each deviation joined to its base and the bits put together.

    ``check`` makes an id without a base an error; it costs one more job.
    """
    names = [f.name for f in info.features]
    table = bases.select(F.col("base_id").alias("_id"), *[F.col(f"`{n}`").alias(f"_t_{n}") for n in names])
    if check and (bad := encoded.join(table, F.col("base_id") == F.col("_id"), "left_anti").head(1)):
        raise InvalidBaseId(f"row {bad[0]['row_idx']} has base {bad[0]['base_id']}, which isn't in the table")
    joined = _join(encoded, table, F.col("base_id") == F.col("_id"), n_bases)
    return joined.select("row_idx", *[F.col(f"_t_{n}").bitwiseOR(F.col(f"`{n}`")).alias(n) for n in names])


def recount(encoded: DataFrame) -> DataFrame:
    """Rows of each base, counted from the ids."""
    return encoded.groupBy("base_id").agg(F.count("*").alias("cnt"))


def base_entropies(bases: DataFrame, info: DatasetInfo, variable: list[int]) -> list[float]:
    """Unweighted entropy of each variable bit over the base table."""
    row = bases.agg(F.count("*").alias("n"), *[F.sum(bit(info, b)).alias(f"b{b}") for b in variable]).first()
    return [binary_entropy(row[f"b{b}"], row["n"]) for b in variable]
