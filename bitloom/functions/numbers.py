"""Scalar functions on integers and pixels, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def zigzag_encode(value: Column) -> Column:
    """0, -1, 1, -2, 2 ... to 0, 1, 2, 3, 4 ..."""
    return F.when(value >= 0, 2 * value).otherwise(-2 * value - 1)


def zigzag_decode(value: Column) -> Column:
    return F.when(value % 2 == 0, F.shiftright(value, 1)).otherwise(-F.shiftright(value + 1, 1))


def signed_half_wrapped(value: Column) -> Column:
    """Half of a byte read as signed, rounded down, as a byte."""
    return F.pmod(F.shiftright(F.when(value > 127, value - 256).otherwise(value), 1), F.lit(256))


def byte(value: Column) -> Column:
    """Modulo 256."""
    return F.pmod(value, F.lit(256))


def clamp(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0)), F.lit(255))


def rgb_to_ycocg_r(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """The reversible transform on wrapped bytes; co and cg are shifted by 128."""
    co = byte(r - b)
    t = byte(b + signed_half_wrapped(co))
    cg = byte(g - t)
    return {"y": byte(t + signed_half_wrapped(cg)), "co": byte(co + 128), "cg": byte(cg + 128)}


def ycocg_r_to_rgb(y: Column, co: Column, cg: Column) -> dict[str, Column]:
    co, cg = byte(co - 128), byte(cg - 128)
    t = byte(y - signed_half_wrapped(cg))
    g = byte(cg + t)
    b = byte(t - signed_half_wrapped(co))
    return {"r": byte(b + co), "g": g, "b": b}


def rgb_to_ycocg(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """The lossy transform: quarters and halves are cut off channel by channel."""
    quarter = lambda c: F.shiftright(c, 2)
    half = lambda c: F.shiftright(c, 1)
    return {"y": byte(quarter(r) + half(g) + quarter(b)), "co": byte(half(r) - half(b) + 128), "cg": byte(half(g) - quarter(r) - quarter(b) + 128)}


def ycocg_to_rgb(y: Column, co: Column, cg: Column) -> dict[str, Column]:
    """Inverse of :func:`rgb_to_ycocg` up to what it cut off; values are clamped to bytes."""
    co, cg = co - 128, cg - 128
    return {"r": clamp(y + co - cg), "g": clamp(y + cg), "b": clamp(y - co - cg)}
