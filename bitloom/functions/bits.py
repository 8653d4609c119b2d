"""Column expressions on bits of BIGINT columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from bitloom.schema import DatasetInfo, signed64

#: Bits packed into one BIGINT of a key; the sign bit stays free, so keys sort as integers.
LIMB = 62


def _bit(info: DatasetInfo, position: int) -> str:
    name, local = info.place(position)
    return f"CAST(getbit(`{name}`, {local}) AS BIGINT)"


def bit(info: DatasetInfo, position: int) -> Column:
    """The bit at a global position, as BIGINT 0 or 1.  Written as SQL: there are many, and each costs one call to the JVM."""
    return F.expr(_bit(info, position))


def bit_slice(column: Column, start: int, width: int) -> Column:
    """``width`` bits of a column from local bit ``start``."""
    return F.shiftrightunsigned(column, start).bitwiseAND(F.lit(signed64((1 << width) - 1)))


def masked(name: str, mask: int) -> Column:
    return F.col(f"`{name}`").bitwiseAND(F.lit(signed64(mask)))


def pack(info: DatasetInfo, positions: list[int]) -> Column:
    """The bits at up to 63 global positions as one integer, the first as the least significant."""
    return F.expr(" | ".join(["0L", *[f"shiftleft({_bit(info, p)}, {i})" for i, p in enumerate(positions)]]))


def key_limbs(info: DatasetInfo, order: list[int]) -> list[Column]:
    """The bits in ``order``, most significant first, as BIGINTs of LIMB bits (the last of what is left)."""
    return [pack(info, order[i : i + LIMB][::-1]) for i in range(0, len(order), LIMB)]


def base_columns(info: DatasetInfo, base_bits: list[int]) -> dict[str, Column]:
    """Per feature the value with all but the base bits cleared."""
    return {name: masked(name, mask) for name, mask in info.masks(base_bits).items()}


def deviation_columns(info: DatasetInfo, base_bits: list[int]) -> dict[str, Column]:
    """Per feature the value with the base bits cleared."""
    masks = info.masks(base_bits)
    return {f.name: masked(f.name, f.mask & ~masks[f.name]) for f in info.features}
