"""Polynomials as term tables: features, names, evaluation, algebra, gradients.

A term table is a dict {(p0, p1, p2): coefficient}. It is small (C(d + 3, 3) terms), lives on the driver and becomes a
Column, so evaluation runs in generated code whatever the number of rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import Vec, norm

Powers = tuple[int, int, int]
Terms = dict[Powers, float]


def exponents(degree: int, dims: int = 3) -> list[Powers]:
    """All monomials up to the degree, by total degree, then with the power of x0 falling, then x1."""
    out = []
    for total in range(degree + 1):
        for combo in itertools.combinations_with_replacement(range(dims), total):
            out.append(tuple(combo.count(i) for i in range(dims)))
    return out


def name(powers: Powers) -> str:
    parts = [f"x{i}" if p == 1 else f"x{i}^{p}" for i, p in enumerate(powers) if p]
    return " ".join(parts) or "1"


def names(degree: int) -> list[str]:
    return [name(p) for p in exponents(degree)]


def parse(text: str) -> Powers:
    """Powers of a feature name; the inverse of name()."""
    out = [0, 0, 0]
    for part in ([] if text == "1" else text.split(" ")):
        var, _, power = part.partition("^")
        out[int(var[1:])] += int(power or 1)
    return tuple(out)


def _power(x: Column, n: int) -> Column | None:
    if n == 0:
        return None
    out = x
    for _ in range(n - 1):
        out = out * x
    return out


def monomial(p: Vec, powers: Powers) -> Column:
    """P18."""
    out = None
    for x, n in zip(p, powers):
        f = _power(x, n)
        out = f if out is None else out if f is None else out * f
    return F.lit(1.0) if out is None else out


def features(p: Vec, degree: int) -> list[Column]:
    return [monomial(p, e).alias(f"f{i}") for i, e in enumerate(exponents(degree))]


def evaluate(p: Vec, terms: Mapping[Powers, float]) -> Column:
    """The polynomial's value. Terms are nested by Horner's rule in x0, then x1, then x2."""

    def horner(items: list[tuple[Sequence[int], float]], dims: Sequence[Column]) -> Column:
        if not dims:
            return F.lit(float(sum(c for _, c in items)))
        groups: dict[int, list] = {}
        for powers, c in items:
            groups.setdefault(powers[0], []).append((powers[1:], c))
        out = None
        for n in range(max(groups), -1, -1):
            here = horner(groups[n], dims[1:]) if n in groups else None
            out = here if out is None else out * dims[0] if here is None else out * dims[0] + here
        return out

    return horner(list(terms.items()), list(p)) if terms else F.lit(0.0)


def derivative(terms: Mapping[Powers, float], axis: int) -> Terms:
    out: Terms = {}
    for powers, c in terms.items():
        if powers[axis]:
            q = tuple(n - (i == axis) for i, n in enumerate(powers))
            out[q] = out.get(q, 0.0) + c * powers[axis]
    return out


def gradient(p: Vec, terms: Mapping[Powers, float]) -> Vec:
    """P21."""
    return tuple(evaluate(p, derivative(terms, i)) for i in range(3))


def normal(p: Vec, terms: Mapping[Powers, float]) -> Vec:
    """The gradient over its length plus 1e-8."""
    g = gradient(p, terms)
    n = norm(g) + F.lit(1e-8)
    return tuple(x / n for x in g)


def smooth_abs(x: Column) -> Column:
    """A differentiable absolute value."""
    return F.sqrt(x * x + F.lit(1e-8))


def from_coefficients(alphas: Iterable[float], degree: int, least: float = 1e-10) -> Terms:
    """E2 with F9: terms of the coefficients that aren't negligible."""
    return {e: float(a) for e, a in zip(exponents(degree), alphas) if abs(a) >= least}


def to_coefficients(terms: Mapping[Powers, float], degree: int) -> np.ndarray | None:
    """Coefficients in feature order; None if a term isn't among the features."""
    order = {e: i for i, e in enumerate(exponents(degree))}
    if any(e not in order for e in terms):
        return None
    out = np.zeros(len(order))
    for e, c in terms.items():
        out[order[e]] = c
    return out


def expand(alphas: np.ndarray, old: int, new: int) -> np.ndarray:
    """Coefficients of a higher degree; the lower degree's features come first."""
    out = np.zeros(len(exponents(new)))
    out[: len(exponents(old))] = alphas
    return out


def plus(a: Mapping[Powers, float], b: Mapping[Powers, float], k: float = 1.0) -> Terms:
    out = dict(a)
    for e, c in b.items():
        out[e] = out.get(e, 0.0) + k * c
    return out


def times(a: Mapping[Powers, float], b: Mapping[Powers, float]) -> Terms:
    out: Terms = {}
    for (ea, ca), (eb, cb) in itertools.product(a.items(), b.items()):
        e = tuple(x + y for x, y in zip(ea, eb))
        out[e] = out.get(e, 0.0) + ca * cb
    return out


def denormalize(terms: Mapping[Powers, float], center: Sequence[float], scale: float) -> Terms:
    """The polynomial q with q(x) = terms((x - center) / scale), expanded."""
    out: Terms = {}
    for powers, c in terms.items():
        parts = [[(j, math.comb(n, j) * (-center[i]) ** (n - j)) for j in range(n + 1)] for i, n in enumerate(powers)]
        for (i, a), (j, b), (k, d) in itertools.product(*parts):
            out[i, j, k] = out.get((i, j, k), 0.0) + c * a * b * d / scale ** sum(powers)
    return out


def degree_of(terms: Mapping[Powers, float]) -> int:
    return max((sum(e) for e in terms), default=0)


def sphere_terms(degree: int, radius: float) -> Terms:
    """Degree 2 is |x|^2 - r^2; a higher even degree multiplies it by (|x|^2 + 0.5) to degree / 2 - 1."""
    if degree < 2 or degree % 2:
        raise ValueError("a sphere needs an even degree of at least 2")
    square: Terms = {(2, 0, 0): 1.0, (0, 2, 0): 1.0, (0, 0, 2): 1.0}
    out = plus(square, {(0, 0, 0): -radius * radius})
    for _ in range(degree // 2 - 1):
        out = times(out, plus(square, {(0, 0, 0): 0.5}))
    return out


def worth_fitting(c: float) -> bool:
    """neither negligible nor a structural one."""
    return abs(c) >= 1e-10 and abs(abs(c) - 1.0) >= 1e-10
