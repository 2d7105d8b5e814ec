"""Deterministic multipliers from a hash of (seed, key, draw): the same in any engine and any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The points of the two- and six-point distributions.
MAMMEN = (-(math.sqrt(5) - 1) / 2, (math.sqrt(5) + 1) / 2, (math.sqrt(5) + 1) / (2 * math.sqrt(5)))
WEBB = (-math.sqrt(1.5), -1.0, -math.sqrt(0.5), math.sqrt(0.5), 1.0, math.sqrt(1.5))
NAMES = ("rademacher", "webb", "mammen", "wgb", "normal", "exp")


def digest(seed: int, key: Column, draw: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), draw.cast("string")))


def uniform(seed: int, key: Column, draw: Column, offset: int = 1) -> Column:
    """In [0, 1): 12 hexadecimal digits of the digest."""
    return F.conv(F.substring(digest(seed, key, draw), offset, 12), 16, 10).cast("double") / F.lit(float(16**12))


def multiplier(dist: str, seed: int, key: Column, draw: Column) -> Column:
    """Mean 0, variance 1 (``exp``: mean 1, for the weighted quantile bootstrap)."""
    if dist == "rademacher":
        return F.when(F.substring(digest(seed, key, draw), 1, 1) < "8", 1.0).otherwise(-1.0)
    u = uniform(seed, key, draw)
    if dist == "webb":
        return F.element_at(F.array(*[F.lit(x) for x in WEBB]), (F.floor(u * 6) + 1).cast("int"))
    if dist in ("mammen", "wgb"):
        return F.when(u < MAMMEN[2], MAMMEN[0]).otherwise(MAMMEN[1])
    if dist == "exp":
        return -F.log(1 - u)
    if dist == "normal":
        v = uniform(seed, key, draw, 13)
        return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)
    raise ValueError(f"unknown distribution {dist!r}; one of {', '.join(NAMES)}")


def enumerated(draw: Column, index: Column) -> Column:
    """Element (draw, index) of the full sign grid."""
    return (F.expr("1.0D") * (2 * (F.call_function("shiftright", draw.cast("long"), index.cast("int")).bitwiseAND(F.lit(1))) - 1)).cast("double")


def enumerated_webb(draw: Column, index: Column) -> Column:
    digit = F.floor(draw / F.pow(F.lit(6.0), index)) % 6
    return F.element_at(F.array(*[F.lit(x) for x in WEBB]), (digit + 1).cast("int"))
