"""Kernels, bandwidths and distances, as column expressions or scalars."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def hac(x: Column, kernel: str) -> Column:
    """Bartlett, Parzen or quadratic-spectral weight at scaled distance ``x``."""
    a = F.abs(x)
    if kernel == "bartlett":
        return F.greatest(F.lit(0.0), 1 - a)
    if kernel == "parzen":
        return F.when(a <= 0.5, 1 - 6 * a * a + 6 * a * a * a).when(a <= 1, 2 * F.pow(1 - a, F.lit(3.0))).otherwise(0.0)
    if kernel == "qs":
        z = 6 * math.pi * a / 5
        return F.when(a < 1e-8, 1.0).otherwise(3 / (z * z) * (F.sin(z) / z - F.cos(z)))
    raise ValueError(f"unknown kernel {kernel!r}")


def bandwidth_nw94(n: int, kernel: str = "bartlett", as_integer: bool | None = None) -> float:
    """The 1994 rule, whole for Bartlett's kernel; the other kernels have the 1991 rule's constants."""
    if kernel != "bartlett":
        b = bandwidth_andrews91(n, kernel)
        return float(math.floor(b)) if as_integer else b
    as_integer = as_integer is not False
    b = 4.0 * (n / 100.0) ** (2.0 / 9.0)
    return float(math.floor(b)) if as_integer else b


def bandwidth_andrews91(n: int, kernel: str = "qs") -> float:
    scale, power = {"qs": (1.3221, 0.2), "bartlett": (1.1447, 1 / 3), "parzen": (2.6614, 0.2)}[kernel]
    return scale * n**power


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_KM) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), F.lit(2.0)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2.0))
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))))


def gaussian_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def silverman(n: int, sd: float) -> float:
    return 1.06 * sd * n**-0.2


def level(ci: float) -> float:
    """A confidence level given as 95 or 0.95."""
    x = ci / 100.0 if ci > 1 else ci
    if not 0 < x < 1:
        raise ValueError("the confidence level lies between 0 and 1, or 0 and 100")
    return x
