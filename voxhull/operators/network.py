"""Neural fields (P25, M15, R7, C5's fit) and generic regressors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fit, spatial
from .storage import stored

Layers = list[tuple[np.ndarray, np.ndarray]]
OMEGA = 30.0
WIDTH = 64  # numbers in a row of the blocks in which derivatives travel


def _act(x: np.ndarray, kind: str) -> np.ndarray:
    if kind == "relu":
        return np.maximum(x, 0)
    if kind == "tanh":
        return np.tanh(x)
    if kind == "sine":
        return np.sin(OMEGA * x)
    raise ValueError(f"unknown activation: {kind}")


def _slope(x: np.ndarray, kind: str) -> np.ndarray:
    return (x > 0).astype(x.dtype) if kind == "relu" else 1 - np.tanh(x) ** 2 if kind == "tanh" else OMEGA * np.cos(OMEGA * x)


def initial(hidden: int = 64, layers: int = 3, kind: str = "tanh", seed: int = 0) -> Layers:
    """Kaiming's scale, or for sine 1 / width at first and sqrt(6 / width) / omega behind; one output."""
    rng, out, width = np.random.default_rng(seed), [], 3
    for n in range(layers + 1):
        size = hidden if n < layers else 1
        bound = (1 / width if n == 0 else np.sqrt(6 / width) / OMEGA) if kind == "sine" else np.sqrt(6 / width) / (1.0 if kind == "relu" else 1.7)
        out.append((rng.uniform(-bound, bound, (size, width)), rng.uniform(-bound, bound, size)))
        width = size
    return out


def forward(layers: Layers, x: np.ndarray, kind: str = "tanh") -> np.ndarray:
    """P25d."""
    h = x
    for w, b in layers[:-1]:
        h = _act(h @ w.T + b, kind)
    return (h @ layers[-1][0].T + layers[-1][1])[:, 0]


def as_sphere(layers: Layers, radius: float, kind: str = "tanh", seed: int = 0) -> Layers:
    """The last layer fitted so that the field is about |x| - radius in the cube of side 2."""
    x = np.random.default_rng(seed).uniform(-1, 1, (4000, 3))
    h = x
    for w, b in layers[:-1]:
        h = _act(h @ w.T + b, kind)
    sol = np.linalg.lstsq(np.column_stack([h, np.ones(len(h))]), np.linalg.norm(x, axis=1) - radius, rcond=None)[0]
    return [*layers[:-1], (sol[None, :-1], sol[-1:])]


def predict(points: DataFrame, layers: Layers, kind: str = "tanh", out: str = "value") -> DataFrame:
    """P25: points with the network's value; the weights (some thousand numbers) go to every task."""
    held = points.sparkSession.sparkContext.broadcast(layers)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b[out] = forward(held.value, b[["x0", "x1", "x2"]].to_numpy(float), kind)
            yield b

    schema = ", ".join([*(f"`{n}` {t}" for n, t in points.dtypes), f"{out} double"])
    return points.mapInPandas(run, schema)


def step_sums(flat: DataFrame, layers: Layers, kind: str, counts: tuple[int, int], batch: int, step: int, sign_weight: float = 1.0) -> tuple[list[np.ndarray], float]:
    """The loss of train() at some weights and its derivatives by them, those of each layer's matrix, then its shifts; one job.

    flat(x0, x1, x2, y, draw): draw is a whole number below 2**50 that tells rows apart. Rows off the surface take part by a draw of
    this step, ``batch`` of them on average (R7). A task adds up its own rows' derivatives; what is shuffled is one vector a task, in blocks.
    """
    on, off = counts
    share, several = min(1.0, batch / max(1, off)), max(1, min(batch, off))
    salt = np.uint64((step * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)

    def part(rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, int]]:
        x, y = rows[:, :3], rows[:, 3]
        chance = ((rows[:, 4].astype(np.uint64) ^ salt) * np.uint64(0xBF58476D1CE4E5B9) ^ salt >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
        use = (y == 0) | ((chance >> np.uint64(11)) * 2.0**-53 < share)
        x, sign = x[use], np.sign(y[use])
        acts, pre = [x], []
        for w, b in layers[:-1]:
            pre.append(acts[-1] @ w.T + b)
            acts.append(_act(pre[-1], kind))
        f = (acts[-1] @ layers[-1][0].T + layers[-1][1])[:, 0]
        wrong = np.maximum(-f * sign, 0)
        loss = np.where(sign == 0, f * f / max(1, on), sign_weight * wrong * wrong / several).sum()
        d, grads = np.where(sign == 0, 2 * f / max(1, on), -2 * sign_weight * wrong * sign / several)[:, None], []
        for i in range(len(layers) - 1, -1, -1):
            grads = [(d.T @ acts[i]).ravel(), d.sum(0), *grads]
            if i:
                d = (d @ layers[i][0]) * _slope(pre[i - 1], kind)
        out = np.concatenate([*grads, [loss]])
        yield 0, np.pad(out, (0, -len(out) % WIDTH)).reshape(-1, WIDTH), int(use.sum())

    shapes = [p.shape for wb in layers for p in wb]
    sizes = [int(np.prod(s)) for s in shapes]
    total = fit.summed(flat, WIDTH, part).get(0, (np.zeros(sum(sizes) + 1), 0))[0].ravel()
    ends = np.cumsum(sizes)
    return [total[e - n : e].reshape(s) for n, e, s in zip(sizes, ends, shapes)], float(total[ends[-1]])


def train(samples: DataFrame, layers: Layers, kind: str = "tanh", steps: int = 400, rate: float = 3e-3, batch: int = 2048, sign_weight: float = 1.0) -> tuple[Layers, list[float]]:
    """C5's fit: Adam on mean f^2 over surface rows (y = 0), all of them each step, plus sign_weight * mean relu(-f sign y)^2 over
    a drawn part of the others (R7). The weights and the losses of all steps.

    samples(x0, x1, x2, y) may have any number of rows: each step sums derivatives over the partitions, and the driver holds
    the weights alone. Draws depend on a row's coordinates and the step, so a rerun gives the same but for the order of sums.
    """
    draw = F.pmod(F.xxhash64("x0", "x1", "x2", "y"), F.lit(1 << 50)).cast("double")
    flat = stored(samples.select(*[F.col(c).cast("double").alias(c) for c in ("x0", "x1", "x2", "y")], draw.alias("draw"))).persist()
    n = flat.agg(F.sum((F.col("y") == 0).cast("long")).alias("on"), F.sum((F.col("y") != 0).cast("long")).alias("off")).first()
    params = [p.astype(float).copy() for wb in layers for p in wb]
    m, v, seen = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], []
    for t in range(1, steps + 1):
        net = [(params[i], params[i + 1]) for i in range(0, len(params), 2)]
        grads, loss = step_sums(flat, net, kind, (n.on or 0, n.off or 0), batch, t, sign_weight)
        seen.append(loss)
        for i, gr in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * gr
            v[i] = 0.999 * v[i] + 0.001 * gr * gr
            params[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    flat.unpersist()
    return [(params[i], params[i + 1]) for i in range(0, len(params), 2)], seen


# ------------------------------------------------------------------------------------------ generic regressors

def make_model(name: str, params: dict | None = None):
    """A regressor over a vector column ``features`` with label ``y``; rf and gbm here, lgbm stands for gbm, svr is that of .svr. knn has its own operator."""
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    params = params or {}
    if name == "rf":
        return RandomForestRegressor(featuresCol="features", labelCol="y", seed=0, **params)
    if name in ("gbm", "lgbm"):
        return GBTRegressor(featuresCol="features", labelCol="y", seed=0, **params)
    if name == "svr":
        from .svr import SupportVectorRegressor

        return SupportVectorRegressor(**params)
    if name == "knn":
        raise NotImplementedError("knn isn't an estimator; see knn_predict")
    raise ValueError(f"unknown model: {name}")


def assembled(points: DataFrame, columns: Sequence[str] = ("x0", "x1", "x2")) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(points)


def knn_predict(queries: DataFrame, samples: DataFrame, k: int = 5) -> DataFrame:
    """M16's knn: id, value: the k nearest samples' y weighted by 1 / d; a sample at the query itself decides."""
    near = spatial.knn(queries, samples.select(F.col("pt_id").alias("nid"), "x0", "x1", "x2"), k)
    j = near.join(samples.select(F.col("pt_id").alias("nid"), "y"), "nid")
    w: Column = F.lit(1.0) / F.greatest("d", F.lit(1e-12))
    return j.groupBy("id").agg((F.sum(w * F.col("y")) / F.sum(w)).alias("value"))
