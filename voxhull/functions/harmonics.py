"""Real spherical harmonics as Columns (P14, P15, P19): closed recurrences, unrolled when the plan is built."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import poly
from .vectors import Vec, sphere_coordinates


def legendre(l: int, m: int, cos: Column, sin: Column) -> Column:
    """The associated Legendre function with the Condon-Shortley phase, for 0 <= m <= l."""
    out = F.lit(1.0)
    for i in range(1, m + 1):
        out = out * sin * F.lit(-(2.0 * i - 1))
    if l == m:
        return out
    before, here = out, cos * F.lit(2.0 * m + 1) * out
    for n in range(m + 2, l + 1):
        before, here = here, (cos * F.lit(2.0 * n - 1) * here - F.lit(n + m - 1.0) * before) / F.lit(float(n - m))
    return here


def real_harmonic(l: int, m: int, p: Vec) -> Column:
    """Real part of Y_l^m for m >= 0, its imaginary part for m < 0."""
    _, theta, phi = sphere_coordinates(p)
    k = abs(m)
    scale = math.sqrt((2 * l + 1) / (4 * math.pi) * math.factorial(l - k) / math.factorial(l + k))
    base = F.lit(scale) * legendre(l, k, F.cos(theta), F.sin(theta))
    if m >= 0:
        return base * F.cos(phi * k)
    # Y_l^-k = (-1)^k conj(Y_l^k), so its imaginary part is -(-1)^k times that of Y_l^k
    return base * F.sin(phi * k) * F.lit(float(-((-1) ** k)))


def feature_names(l_max: int, r_max: int) -> list[tuple[str, int, int, int]]:
    """(name, power of r, l, m) of P14, by power, then l, then m."""
    return [(f"r^{k}*Y_{l}^{m}", k, l, m) for k in range(r_max + 1) for l in range(l_max + 1) for m in range(-l, l + 1)]


def feature(p: Vec, k: int, l: int, m: int) -> Column:
    r, _, _ = sphere_coordinates(p)
    return F.pow(r, F.lit(float(k))) * real_harmonic(l, m, p)


def hybrid_names(degree: int = 6, l_max: int = 8, r_max: int = 3) -> list[str]:
    """Monomials, then harmonics but for the constant r^0*Y_0^0."""
    return poly.names(degree) + [n for n, *_ in feature_names(l_max, r_max) if n != "r^0*Y_0^0"]


def hybrid_feature(p: Vec, name: str) -> Column:
    if name.startswith("r^"):
        k, lm = name[2:].split("*Y_")
        l, m = lm.split("^")
        return feature(p, int(k), int(l), int(m))
    return poly.monomial(p, poly.parse(name))


def hybrid_matrix(x: np.ndarray, names: Sequence[str]) -> np.ndarray:
    """hybrid_feature's values in numpy for points x: a row a point, a column a name. Each Legendre function is built up once."""
    r = np.maximum(np.sqrt((x * x).sum(1)), 1e-10)
    cos = (x[:, 2] / r).clip(-1, 1)
    sin, phi = np.sqrt(1 - cos * cos), np.arctan2(x[:, 1], x[:, 0])
    held: dict[tuple[int, int], np.ndarray] = {}

    def of(l: int, m: int) -> np.ndarray:
        if (l, m) not in held:
            if l == m:
                held[l, m] = np.ones(len(x)) if not m else of(m - 1, m - 1) * sin * -(2.0 * m - 1)
            else:
                before = of(l - 2, m) if l > m + 1 else 0.0
                held[l, m] = (cos * (2.0 * l - 1) * of(l - 1, m) - (l + m - 1.0) * before) / (l - m)
        return held[l, m]

    out = np.empty((len(x), len(names)))
    for i, name in enumerate(names):
        if name.startswith("r^"):
            k, lm = name[2:].split("*Y_")
            l, m = map(int, lm.split("^"))
            n = abs(m)
            scale = math.sqrt((2 * l + 1) / (4 * math.pi) * math.factorial(l - n) / math.factorial(l + n))
            turn = np.cos(n * phi) if m >= 0 else np.sin(n * phi) * -((-1) ** n)
            out[:, i] = r ** int(k) * scale * of(l, n) * turn
        else:
            out[:, i] = (x ** np.array(poly.parse(name))).prod(1)
    return out


def hybrid_evaluate(p: Vec, coefficients: Mapping[str, float], least: float = 1e-4) -> Column:
    """The sum over features by name, without negligible coefficients. Keyed by name, so growing a basis keeps them aligned."""
    out = F.lit(0.0)
    for n, c in coefficients.items():
        if abs(c) >= least:
            out = out + F.lit(float(c)) * hybrid_feature(p, n)
    return out
