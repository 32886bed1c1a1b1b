"""Gaussian processes of patches that are too large for one fit."""

import numpy as np
from pyspark.sql import functions as F

from voxhull.operators import gaussian
from voxhull.plans import pipelines


def samples(spark, n, seed=1):
    x = np.random.default_rng(seed).uniform(-1, 1, (n, 3))
    rows = [(i % 2, i, *map(float, p), float(p[0] ** 2 + p[1] - 0.5 * p[1] * p[2])) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "pid long, pt_id long, x0 double, x1 double, x2 double, y double")


def test_every_sample_is_fitted_and_no_fit_is_large(spark):
    df = samples(spark, 900)
    models = gaussian.fit_patches(df, most=64).cache()
    sizes = [len(m.weights) for m in models.collect()]
    assert sum(sizes) == 900 and max(sizes) <= 64 and len(sizes) < 40
    got = gaussian.predict_patches(models, df.drop("y")).join(df.select("pt_id", F.col("y").alias("want")), "pt_id").toPandas()
    assert len(got) == 900 and np.abs(got.y - got.want).max() < 0.02


def test_small_patches_are_one_cell_with_the_plain_fit(spark):
    df = samples(spark, 80)
    got = gaussian.predict_patches(gaussian.fit_patches(df), df.drop("y")).toPandas().sort_values("pt_id")
    for pid, g in df.toPandas().groupby("pid"):
        x = g[["x0", "x1", "x2"]].to_numpy()
        assert np.allclose(gaussian.predict(gaussian.fit(x, g.y.to_numpy()), x), got[got.pid == pid].y, atol=1e-6)


def test_many_samples_in_one_place(spark):
    rows = [(0, i, 1.0, 2.0, 3.0, float(i % 2)) for i in range(100)] + [(0, 100 + i, i * 0.1, 2.0, 3.0, 0.0) for i in range(30)]
    df = spark.createDataFrame(rows, "pid long, pt_id long, x0 double, x1 double, x2 double, y double")
    got = {r.pt_id: r.y for r in gaussian.predict_patches(gaussian.fit_patches(df, most=16), df.drop("y")).collect()}
    assert len(got) == 130 and abs(got[5] - 0.5) < 0.2 and abs(got[101]) < 0.2


def test_leaf_equations_of_patches_larger_than_a_fit(spark):
    df = samples(spark, 3000)
    got = pipelines.leaf_equations(df, pipelines.PatchConfig(degree=2, resolution=6)).collect()
    assert sorted(r.pid for r in got) == [0, 1] and all(len(r.alphas) == 10 and r.rmse < 0.02 for r in got)


def test_fits_are_dealt_to_tasks_by_their_number(spark):
    """The cells' bytes are few, so that by bytes one task would fit them all."""
    models = gaussian.fit_patches(samples(spark, 900), most=64)
    dealt = models.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in dealt) >= 15 and len(dealt) > 4 and max(r["count"] for r in dealt) <= 8
