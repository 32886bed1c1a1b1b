"""Blends of equations (E6 to E10): smooth minimum, polynomial weight, partition of unity, residual correction."""

from __future__ import annotations


import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import poly
from ..functions.vectors import Vec, dot, lit, sub, vec
from . import fit


def smooth_minimum(a: Column, b: Column, k: float = 0.1) -> Column:
    """-k log(exp(-a / k) + exp(-b / k)), shifted by the minimum so that nothing overflows. k = 0 is the minimum itself, below 0 raises; both warn."""
    if k <= 0:
        warnings.warn("smooth_minimum wants k > 0", stacklevel=2)
        if k < 0:
            raise ValueError("k is negative")
        return F.least(a, b)
    low = F.least(a, b)
    return low - F.log(F.exp((low - a) / k) + F.exp((low - b) / k)) * k


def partition_of_unity(a: Column, b: Column, p: Vec, seed_a: Sequence[float], seed_b: Sequence[float], sigma: float) -> Column:
    """Both fields weighted by exp(-|x - seed|^2 / sigma^2), weights summing to one; written as a logistic, which can't divide zero by zero."""
    da, db = sub(p, lit(seed_a)), sub(p, lit(seed_b))
    w = F.lit(1.0) / (F.exp((dot(da, da) - dot(db, db)) / (sigma * sigma)) + 1.0)
    return w * a + (F.lit(1.0) - w) * b


def polynomial_weight(samples: DataFrame, a: Mapping[poly.Powers, float], b: Mapping[poly.Powers, float], degree: int = 2, ridge: float = 1e-3) -> poly.Terms:
    """(1 - w) a + w b with a polynomial w fitted by ridge regression to the samples' y; a if b is the same field there, the other one if either is zero there.

    Fields and targets are divided by their scales for the fit; rows count where the scaled fields differ. The bias isn't penalised.
    """
    p = vec("x0", "x1", "x2")
    fa, fb = poly.evaluate(p, a), poly.evaluate(p, b)
    s = samples.agg(F.sqrt(F.avg(fa**2)).alias("a"), F.sqrt(F.avg(fb**2)).alias("b"), F.sum((F.abs(fb - fa) > 1e-10).cast("int")).alias("n")).first()
    if not s.a:
        return dict(b)
    if not s.b or s.n < 10:
        return dict(a)
    sa, sb = s.a + 1e-10, s.b + 1e-10
    d = fb / sb - fa / sa
    w = (F.col("y") / ((sa + sb) / 2) - fa / sa) / d
    rows = samples.where((F.abs(fb - fa) > 1e-10) & (F.abs(d) > 1e-12))
    g, h, _, n = fit.gram(rows, poly.features(p, degree), w)
    if not n:
        return dict(a)
    # centred sums leave the bias free
    mean, centre = g[0] / n, h[0] / n
    gc, hc = g[1:, 1:] - n * mean[1:, None] * mean[None, 1:], h[1:] - n * mean[1:] * centre
    slope = fit.least_squares(gc, hc, ridge)
    weight = {e: float(c) for e, c in zip(poly.exponents(degree), [centre - mean[1:] @ slope, *slope])}
    return poly.plus(dict(a), poly.times(weight, poly.plus(dict(b), a, -1.0)))


def residual_merge(samples: DataFrame, terms: poly.Terms, degree: int = 4, done: float = 1e-4, near: float = 1e-3) -> tuple[poly.Terms, float]:
    """Under ``done`` root mean square error the equation stays; under ``near`` its constants are refitted; else an equation fitted to the
    residual is added and all is refitted. The best of what was tried is returned, with its error.
    """
    p = vec("x0", "x1", "x2")
    error = lambda t: float(fit.rmse(samples, poly.evaluate(p, t), F.col("y")).first().rmse or 0.0)
    before = error(terms)
    if before < done:
        return dict(terms), before
    tried = [(before, dict(terms))]
    if before >= near:
        rest = samples.withColumn("y", F.col("y") - poly.evaluate(p, terms))
        terms = poly.plus(terms, fit.fit_polynomial(rest, degree)["terms"])
        tried.append((error(terms), dict(terms)))
    refitted = fit.refit_terms(samples, terms)
    tried.append((error(refitted), refitted))
    best = min(tried, key=lambda t: t[0])
    return best[1], best[0]
