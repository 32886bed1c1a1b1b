"""Support vector regression over any number of rows (M16's svr).

The radial kernel is taken by random Fourier features, so that a fit is a linear one in a fixed number of coefficients:

    1/2 |w|^2 + C * sum of max(0, |f(x) - y| - epsilon),   f(x) = w . phi(x) + b

Each of the loss's two hinges lies under a parabola that touches it at the present f. The parabolas' minimum is a weighted
least squares fit, whose sums one aggregate gives, and it never raises the loss. No row leaves its executor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fit
from .storage import stored


@dataclass(frozen=True)
class Fourier:
    """Features whose products are about exp(-gamma |x - y|^2), and a constant behind them."""

    directions: np.ndarray  # dimensions by features
    phases: np.ndarray

    @staticmethod
    def drawn(dimensions: int, size: int, gamma: float, seed: int = 0) -> Fourier:
        rng = np.random.default_rng(seed)
        return Fourier(rng.normal(0, np.sqrt(2 * gamma), (dimensions, size)), rng.uniform(0, 2 * np.pi, size))

    @property
    def size(self) -> int:
        return len(self.phases) + 1

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.cos(x @ self.directions + self.phases) * np.sqrt(2 / max(1, len(self.phases)))
        return np.column_stack([z, np.ones(len(x))])


def tube_sums(flat: DataFrame, design: fit.Design, w: np.ndarray, epsilon: float, least: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(G, b, loss) at the coefficients w of flat(_c..., _y): the parabolas' fit solves G w = b for w; loss is what leaves the tube, summed.

    A parabola that touches a hinge nearer than ``least`` to its bend is that of ``least``. Rows with a null or NaN don't count.
    """
    k, matrix = design.size, design.matrix

    def part(x: np.ndarray) -> Iterator[tuple[int, np.ndarray, int]]:
        z, y = matrix(x[:, :-1]), x[:, -1]
        r = z @ w - y
        above, below = np.maximum(np.abs(r - epsilon), least), np.maximum(np.abs(r + epsilon), least)
        weight = 0.25 / above + 0.25 / below
        aim = weight * y + 0.25 * (epsilon / above - 1) - 0.25 * (epsilon / below - 1)
        root = np.sqrt(weight)
        both = np.column_stack([z * root[:, None], aim / root])
        out = both.T @ both
        out[k, k] = np.maximum(np.abs(r) - epsilon, 0).sum()
        yield 0, out, len(x)

    m = fit.summed(flat, k + 1, part).get(0, (np.zeros((k + 1, k + 1)), 0))[0]
    return m[:k, :k], m[:k, k], float(m[k, k])


def fit_tube(flat: DataFrame, design: fit.Design, c: float = 10.0, epsilon: float = 0.01, steps: int = 100, tol: float = 1e-4) -> tuple[np.ndarray, list[float]]:
    """Coefficients of flat(_c..., _y), the last one the constant's, which has no penalty; and the objective before each step, which falls.

    Ends where a step gains less than ``tol`` of the objective. An empty table gives zeros.
    """
    k = design.size
    penalty = np.diag([1.0] * (k - 1) + [0.0])
    w, seen, best, low = np.zeros(k), [], np.zeros(k), np.inf
    for _ in range(steps):
        g, b, outside = tube_sums(flat, design, w, epsilon, max(0.05 * epsilon, 1e-6))
        value = 0.5 * float(w[:-1] @ w[:-1]) + c * outside
        seen.append(value)
        gained = low - value
        if value < low:
            best, low = w, value
        if gained <= tol * max(low, 1e-300):
            break
        w = np.linalg.lstsq(penalty + 2 * c * g, 2 * c * b, rcond=None)[0]
    return best, seen


@dataclass(frozen=True)
class SupportVectorModel:
    features: Fourier
    w: np.ndarray
    losses: list[float]

    def transform(self, rows: DataFrame) -> DataFrame:
        """rows(features vector) with ``prediction``."""
        from pyspark.ml.functions import vector_to_array

        held = rows.sparkSession.sparkContext.broadcast((self.features, self.w))  # as many numbers as coefficients, times dimensions

        @F.pandas_udf("double")
        def predicted(x: pd.Series) -> pd.Series:
            features, w = held.value
            if not len(x) or not w.any():  # a fit to no rows doesn't know the dimensions
                return pd.Series(np.zeros(len(x)))
            return pd.Series(features(np.stack(x.to_numpy())) @ w)

        return rows.withColumn("prediction", predicted(vector_to_array("features")))


@dataclass(frozen=True)
class SupportVectorRegressor:
    """A regressor over a vector column ``features`` with label ``y``. gamma: 1 / (dimensions * variance of all coordinates) where None."""

    C: float = 10.0
    epsilon: float = 0.01
    gamma: float | None = None
    size: int = 256
    steps: int = 100
    seed: int = 0

    def fit(self, rows: DataFrame) -> SupportVectorModel:
        """Rows with a null label or features don't count; no rows give a field of zero."""
        from pyspark.ml.functions import vector_to_array

        rows = rows.where("features is not null and y is not null").select(vector_to_array("features").alias("x"), F.col("y").cast("double").alias("_y"))
        some = rows.select(F.size("x").alias("n")).first()
        n = some.n if some else 1
        flat = stored(rows.select(*[F.col("x")[i].alias(f"_c{i}") for i in range(n)], "_y"))
        gamma = self.gamma
        if gamma is None:
            spread = flat.select(F.explode(F.array(*[f"_c{i}" for i in range(n)])).alias("v")).agg(F.var_pop("v").alias("v")).first().v
            gamma = 1 / (n * spread) if spread else 1.0
        features = Fourier.drawn(n, self.size, gamma, self.seed)
        design = fit.Design(tuple(F.col(f"_c{i}") for i in range(n)), features.size, features)
        return SupportVectorModel(features, *fit_tube(flat, design, self.C, self.epsilon, self.steps))
