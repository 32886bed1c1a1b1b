"""Exact percentiles against sorting."""

import random

import numpy as np
import pytest

from voxhull.operators import quantiles


@pytest.mark.parametrize("buckets, few", [(4096, 4096), (3, 4)])
def test_percentiles_equal_sorting(spark, buckets, few):
    """Even and skewed values, ties of most rows, one value, neighbours far apart, a null group, and values that aren't numbers."""
    rnd = random.Random(2)
    groups = {"even": [rnd.random() for _ in range(301)], "skew": [rnd.lognormvariate(0, 4) * rnd.choice([-1, 1]) for _ in range(250)], "ties": [1.0] * 200 + [0.5, 2.0, 3.0], "one": [7.25], "two": [-1e300, 1e300][:2], None: [3.0, 1.0, 2.0, 2.0]}
    groups["two"] = [-1e9, 1e9]
    rows = [(k, x) for k, xs in groups.items() for x in xs] + [("even", None), ("even", float("nan")), ("even", float("inf")), ("none", None)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "part string, v double").repartition(5)
    wanted = {"lo": 0.0, "q1": 0.25, "mid": 0.5, "p95": 0.95, "hi": 1.0}
    got = {r.part: r for r in quantiles.percentiles(df, ["part"], "v", wanted, buckets, few).collect()}
    assert set(got) == set(groups)
    for k, xs in groups.items():
        for name, q in wanted.items():
            assert got[k][name] == pytest.approx(float(np.quantile(xs, q)), rel=1e-12, abs=1e-12), (k, name)


def test_percentiles_without_keys_and_rows(spark):
    df = spark.range(1001).selectExpr("cast(id as double) as v")
    assert quantiles.percentiles(df, [], "v", {"a": 0.1, "b": 0.9995}, 10, 5).collect()[0].asDict() == {"a": 100.0, "b": 999.5}
    assert quantiles.percentiles(df.where("v < 0").selectExpr("1 as g", "v"), ["g"], "v", {"a": 0.5}).count() == 0
