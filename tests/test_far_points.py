"""Neighbours, distances and rays of points far from what they look for, against all pairs."""

import numpy as np
import pandas as pd
import pytest

from voxhull.operators import rays, spatial
from voxhull.sources import meshes


def cloud(spark, at, key):
    return spark.createDataFrame(pd.DataFrame({key: np.arange(len(at)), "x0": at[:, 0], "x1": at[:, 1], "x2": at[:, 2]}))


@pytest.mark.parametrize("shift", [[3.0, 0.0, 0.0], [50.0, -20.0, 7.0]])
def test_neighbours_of_a_cloud_apart(spark, shift):
    rng = np.random.default_rng(1)
    right = np.round(rng.normal(size=(400, 3)), 1)  # with ties and repeated places
    left = np.concatenate([rng.normal(size=(40, 3)) + shift, rng.normal(size=(20, 3))])
    got = {(r.id, r.rank): (r.nid, r.d) for r in spatial.knn(cloud(spark, left, "id"), cloud(spark, right, "nid"), 4).collect()}
    d = np.linalg.norm(left[:, None] - right[None], axis=2)
    want = np.sort(d, axis=1)[:, :4]
    assert len(got) == 4 * len(left)
    for (i, rank), (j, near) in got.items():
        assert abs(near - want[i, rank - 1]) < 1e-9 and abs(d[i, j] - near) < 1e-9


def triangles(spark):
    v, f = meshes.icosphere(spark, 2)
    at = {r.vid: (r.x0, r.x1, r.x2) for r in v.collect()}
    return spark.createDataFrame([(r.fid, *at[r.v0], *at[r.v1], *at[r.v2]) for r in f.collect()], "fid long, " + ", ".join(f"{p}{i} double" for p in "abc" for i in range(3)))


def test_distances_and_rays_from_far_away(spark):
    rng = np.random.default_rng(2)
    tri = triangles(spark).cache()
    at = np.concatenate([rng.normal(size=(20, 3)) * 40, rng.normal(size=(10, 3))])
    near = {r.id: r.near for r in rays.distances(cloud(spark, at, "id"), tri).collect()}
    assert len(near) == len(at) and all(abs(near[i] - abs(np.linalg.norm(at[i]) - 1)) < 0.05 for i in near)
    way = -at / np.linalg.norm(at, axis=1, keepdims=True)
    rows = [(i, *map(float, at[i]), *map(float, s * way[i])) for i in range(20) for s in (1, -1) if s == 1 or i % 2]
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    found = {r.id: r.t for r in rays.nearest_hits(spark.createDataFrame(rows, "id long, x0 double, x1 double, x2 double, d0 double, d1 double, d2 double"), tri).collect()}
    for k, *r in rows:
        x, d = np.array(r[:3]), np.array(r[3:])
        assert (k in found) == (x @ d < 0)
        if k in found:
            assert abs(found[k] - (np.linalg.norm(x) - 1)) < 0.05
