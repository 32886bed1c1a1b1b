"""Fixed 3-vectors as tuples of Columns: a point costs no array and stays in generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(*names: str) -> Vec:
    return tuple(F.col(n) for n in names)


def lit(values: Sequence[float]) -> Vec:
    return tuple(F.lit(float(v)) for v in values)


def items(array: Column, n: int = 3) -> Vec:
    """The first n entries of an array column."""
    return tuple(array.getItem(i) for i in range(n))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b))


def add(a: Vec, b: Vec) -> Vec:
    return tuple(x + y for x, y in zip(a, b))


def scale(a: Vec, k: Column) -> Vec:
    return tuple(x * k for x in a)


def dot(a: Vec, b: Vec) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:]):
        out = out + x * y
    return out


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vec, floor: float = 1e-8) -> Vec:
    """a over its length plus a floor, so that a zero vector stays zero; floor 0: nothing is added but to a zero length."""
    n = norm(a) + F.lit(floor) if floor else F.greatest(norm(a), F.lit(1e-300))
    return tuple(x / n for x in a)


def clip(x: Column, lo: Column | float, hi: Column | float) -> Column:
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lo, hi))
    return F.least(F.greatest(x, lo), hi)


def named(a: Vec, names: Sequence[str]) -> list[Column]:
    return [x.alias(n) for x, n in zip(a, names)]


def sphere_coordinates(p: Vec) -> tuple[Column, Column, Column]:
    """Radius (at least 1e-10), polar angle, azimuth."""
    r = F.greatest(norm(p), F.lit(1e-10))
    return r, F.acos(clip(p[2] / r, -1, 1)), F.atan2(p[1], p[0])


def plane_basis(n: Vec) -> tuple[Vec, Vec]:
    """Two unit vectors u, v that span the plane of the unit normal n; the helper axis avoids n's direction."""
    near_x = F.abs(n[0]) > 0.9
    helper = (F.when(near_x, 0.0).otherwise(1.0), F.when(near_x, 1.0).otherwise(0.0), F.lit(0.0))
    u = unit(cross(n, helper), 0.0)
    return u, cross(n, u)


def hashed_uniform(*key: Column, seed: int = 42) -> Column:
    """A number in [0, 1) that depends on key and seed alone: the same on every run, partitioning and retry."""
    h = F.xxhash64(F.lit(seed).cast("long"), *key)
    return F.shiftrightunsigned(h, 11).cast("double") * F.lit(2.0**-53)


def curvedness(mean: Column, gauss: Column) -> tuple[Column, Column, Column]:
    """Both principal curvatures and their root mean square, from mean and Gaussian curvature."""
    d = F.sqrt(F.greatest(mean * mean - gauss, F.lit(0.0)))
    k1, k2 = mean + d, mean - d
    return k1, k2, F.sqrt((k1 * k1 + k2 * k2) / 2)
