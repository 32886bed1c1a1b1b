"""Gaussian process regression of patches (M1 to M3): each patch's few hundred samples are one group's NumPy fit; patches of more are cut into cells of as many."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored


def kernel(a: np.ndarray, b: np.ndarray, variance: float, length: float) -> np.ndarray:
    """M1 without its noise: variance * exp(-|x - y|^2 / 2 length^2)."""
    d2 = np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0)
    return variance * np.exp(-d2 / (2 * length**2))


def fit(x: np.ndarray, y: np.ndarray, backend: str = "numpy", jitter: float = 1e-6) -> dict:
    """M2: a model {"x", "weights", "variance", "length", "noise", "mean", "std", "likelihood"}.

    Targets are standardised. Length and noise are searched on a grid around half of the diagonal, then refined; the variance
    follows in closed form. backend: numpy; others aren't there and raise.
    """
    if backend == "gpytorch":
        raise NotImplementedError("only the numpy backend exists")
    if backend != "numpy":
        raise ValueError(f"unknown backend: {backend}")
    if not len(x):
        raise ValueError("no samples")
    mean, std = float(y.mean()), float(y.std()) or 1.0
    t, n = (y - mean) / std, len(x)
    start = max(1e-6, float(np.linalg.norm(np.ptp(x, axis=0))) / 2)

    def score(length: float, noise: float):
        k = kernel(x, x, 1.0, length) + (noise + jitter) * np.eye(n)
        try:
            low = np.linalg.cholesky(k)
        except np.linalg.LinAlgError:
            return -np.inf, None, 1.0
        w = np.linalg.solve(low.T, np.linalg.solve(low, t))
        variance = max(1e-12, float(t @ w) / n)
        return -0.5 * n * np.log(variance) - np.log(np.diag(low)).sum() - 0.5 * n * (1 + np.log(2 * np.pi)), w, variance

    best = (-np.inf, None, 1.0, start, 1e-4)
    lengths, noises = start * np.geomspace(0.05, 8, 9), np.geomspace(1e-8, 1e-1, 5)
    for _ in range(3):
        for a in lengths:
            for b in noises:
                value, w, v = score(a, b)
                if value > best[0]:
                    best = (value, w, v, a, b)
        lengths, noises = best[3] * np.geomspace(0.6, 1.6, 5), best[4] * np.geomspace(0.2, 5, 3)
    value, w, v, a, b = best
    return {"x": x, "weights": w, "variance": v, "length": float(a), "noise": float(b), "mean": mean, "std": std, "likelihood": float(value)}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    """M3: the mean."""
    return kernel(x, model["x"], 1.0, model["length"]) @ model["weights"] * model["std"] + model["mean"]


#: Samples of one model at most; a patch of more is cut into cells. A fit takes time by the cube of its samples.
MOST = 512
#: Cells that a task fits, on average.
TOGETHER = 2
MODEL = "pid long, cell long, way array<struct<axis:int,at:double,also:boolean>>, x array<double>, weights array<double>, variance double, length double, noise double, mean double, std double, likelihood double"
_AXES = ("x0", "x1", "x2")


def _below() -> Column:
    """Does a point go to the lower side of a cut (axis, at, also)? also: points at the cut go there too."""
    x = F.when(F.col("axis") == 0, F.col("x0")).when(F.col("axis") == 1, F.col("x1")).otherwise(F.col("x2"))
    return F.coalesce((x < F.col("at")) | (F.col("also") & (x == F.col("at"))), F.lit(False))


def cells(samples: DataFrame, most: int = MOST, key: str = "pid") -> DataFrame:
    """samples(pid, x0..x2, y) with cell and way: each patch of more than ``most`` samples is halved across its widest axis near the median, and so are its
    halves, until none holds more. Every sample is in one cell; a cell's halves are numbered 2 cell and 2 cell + 1, way are the cuts from the patch to it.

    A round takes one aggregate over all cells that are still too large. More than ``most`` samples in one place, of which a process knows nothing but
    their mean, become one sample of that mean.
    """
    cuts = "array<struct<axis:int,at:double,also:boolean>>"
    left = stored(samples.withColumn("cell", F.lit(1).cast("long")).withColumn("way", F.array().cast(cuts)))
    columns, done = left.columns, None
    while True:
        spread = [F.struct((F.max(x) - F.min(x)).alias("wide"), F.lit(i).alias("axis"), F.min(x).alias("lo"), F.percentile_approx(x, 0.5, 1000).alias("at")) for i, x in enumerate(_AXES)]
        told = left.groupBy(key, "cell").agg(F.count("*").alias("n"), F.greatest(*spread).alias("w"), F.struct(*[F.min(x).alias(x) for x in _AXES], F.avg("y").alias("y"), F.first("way").alias("way")).alias("one")).where(F.col("n") > most)
        flat = ~F.coalesce(F.col("w.wide") > 0, F.lit(False))
        told = stored(told.select(key, "cell", F.when(flat, -1).otherwise(F.col("w.axis")).cast("int").alias("axis"), F.col("w.at").alias("at"), F.coalesce(F.col("w.at") <= F.col("w.lo"), F.lit(False)).alias("also"), "one"))
        if told.limit(1).count() == 0:
            return left if done is None else done.unionByName(left)
        j = left.join(told.drop("one"), [key, "cell"], "left")
        ready = stored(j.where("axis is null").select(columns).unionByName(told.where("axis < 0").select(key, "cell", "one.*").select(columns)))
        done = ready if done is None else done.unionByName(ready)
        way = F.concat("way", F.array(F.struct("axis", "at", "also")))
        left = stored(j.where("axis >= 0").withColumn("cell", F.col("cell") * 2 + F.when(_below(), 0).otherwise(1)).withColumn("way", way.cast(cuts)).select(columns))


def fit_patches(samples: DataFrame, key: str = "pid", most: int = MOST) -> DataFrame:
    """M2 for each cell of each patch of samples(pid, x0..x2, y); a patch of at most ``most`` samples is one cell (R3), which bounds a group."""

    def run(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m = fit(pdf[["x0", "x1", "x2"]].to_numpy(), pdf.y.to_numpy())
        way = [tuple(w.values()) if isinstance(w, dict) else tuple(w) for w in pdf.way.iloc[0]]
        return pd.DataFrame([{"pid": k[0], "cell": k[1], "way": [dict(zip(("axis", "at", "also"), w)) for w in way], **m, "x": m["x"].ravel().tolist(), "weights": m["weights"].tolist()}])

    dealt = cells(samples.select(F.col(key).alias("pid"), "x0", "x1", "x2", "y"), most)
    # a fit is much work on few bytes: by its bytes a table of hundreds of cells would be one task
    n = dealt.select("pid", "cell").distinct().count()
    return dealt.repartition(max(1, -(-n // TOGETHER)), "pid", "cell").groupBy("pid", "cell").applyInPandas(run, MODEL)


def placed(queries: DataFrame, models: DataFrame) -> DataFrame:
    """queries(pid, x0..x2, ...) with the cell of models(pid, cell, way) in which each lies: a join with one level of cuts after the other."""
    cut = models.select("pid", F.posexplode("way").alias("k", "w"), "cell", F.size("way").alias("deep"))
    node = F.expr("shiftright(cell, deep - k)")
    cut = stored(cut.select("pid", node.alias("cell"), "w.axis", "w.at", "w.also", "k").distinct())
    deepest = cut.agg(F.max("k")).first()[0]
    out = queries.withColumn("cell", F.lit(1).cast("long"))
    columns = out.columns
    for k in range(0 if deepest is None else deepest + 1):
        j = out.join(cut.where(F.col("k") == k).drop("k"), ["pid", "cell"], "left")
        out = j.withColumn("cell", F.when(F.col("axis").isNull(), F.col("cell")).otherwise(F.col("cell") * 2 + F.when(_below(), 0).otherwise(1))).select(columns)
    return out


def predict_patches(models: DataFrame, queries: DataFrame) -> DataFrame:
    """M3: pid, pt_id, x0..x2, y of queries(pid, pt_id, x0..x2) by the model of their patch's cell."""
    models = stored(models)
    q = placed(queries.select("pid", "pt_id", "x0", "x1", "x2"), models.select("pid", "cell", "way"))

    def run(key: tuple, points: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if points.empty or model.empty:
            return points[["pid", "pt_id", "x0", "x1", "x2"]].iloc[:0].assign(y=0.0)
        r = model.iloc[0]
        m = {"x": np.asarray(r.x, float).reshape(-1, 3), "weights": np.asarray(r.weights), "length": r.length, "mean": r["mean"], "std": r["std"]}
        at = points[["x0", "x1", "x2"]].to_numpy()
        y = [predict(m, at[i : i + 4096]) for i in range(0, len(at), 4096)]
        return points[["pid", "pt_id", "x0", "x1", "x2"]].assign(y=np.concatenate(y))

    by = models.select("pid", "cell", "x", "weights", "length", "mean", "std").groupBy("pid", "cell")
    return q.groupBy("pid", "cell").cogroup(by).applyInPandas(run, "pid long, pt_id long, x0 double, x1 double, x2 double, y double")
