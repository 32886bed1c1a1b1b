"""Distances to many long, thin triangles, which all lie in a few cells."""

import math

from pyspark.sql import functions as F

from voxhull.functions.vectors import vec
from voxhull.operators import rays


def test_only_triangles_that_may_be_nearest_are_measured(spark, monkeypatch):
    rows, n = [], 600
    for i in range(n):  # a ring of slivers as high as wide
        a, b = (2 * math.pi * k / n for k in (i, i + 1))
        rows.append((i, math.cos(a), math.sin(a), 0.0, math.cos(b), math.sin(b), 0.0, math.cos(a), math.sin(a), 0.9))
    t = spark.createDataFrame(rows, "fid long, " + ", ".join(f"{c} double" for c in rays._NAMES))
    p = spark.createDataFrame([(i, 0.9 * math.cos(i), 0.8 * math.sin(i), 0.1 * i) for i in range(8)], "id long, x0 double, x1 double, x2 double")
    measured, stored = [], rays.stored

    def watched(df):
        out = stored(df)
        if {"x0", "a0"} <= set(out.columns):
            measured.append(out.count())
        return out

    monkeypatch.setattr(rays, "stored", watched)
    got = {r.id: r.near for r in rays.distances(p, t).collect()}
    d = rays.triangle_distance(vec("x0", "x1", "x2"), *(rays.corner(c) for c in "abc"))
    want = {r.id: r.near for r in p.crossJoin(t).groupBy("id").agg(F.min(d).alias("near")).collect()}
    assert got == want
    assert measured and sum(measured) < 8 * n / 2, measured
