"""Iso-surfaces of fields whose area, volume and shape are known."""

import math
import random

import pytest
from pyspark.sql import functions as F

from voxhull.functions import sdf
from voxhull.operators import isosurface, mesh


def facts(v, f):
    n_v, n_f = v.count(), f.count()
    w = mesh.watertight(f).first()
    area = mesh.face_geometry(v, f).agg(F.sum("area")).first()[0]
    return n_v - w.n_edges + n_f, w.watertight, w.winding_consistent, area, isosurface.volume(v, f).first().volume


@pytest.mark.parametrize("shape, euler, area, volume", [
    ({"type": "sphere", "center": (0.1, 0.0, -0.05), "radius": 0.8}, 2, 4 * math.pi * 0.64, 4 / 3 * math.pi * 0.512),
    ({"type": "torus", "center": (0.0, 0.0, 0.0), "radius": 0.25, "axis": (0.0, 0.6, 0.8), "major_radius": 0.6}, 0, 4 * math.pi**2 * 0.15, 2 * math.pi**2 * 0.6 * 0.0625),
])
def test_a_field_becomes_a_closed_mesh(spark, shape, euler, area, volume):
    n = 25
    step = [2.2 / (n - 1)] * 3
    cells = isosurface.cells_of_field(spark, [n] * 3, [-1.1] * 3, step, lambda p: sdf.primitive(p, shape))
    v, f = (x.cache() for x in isosurface.surface(cells, [-1.1] * 3, step))
    e, closed, wound, a, vol = facts(v, f)
    assert (e, closed, wound) == (euler, True, True)
    assert abs(a / area - 1) < 0.03 and abs(vol / volume - 1) < 0.03
    assert v.select("vid").distinct().count() == v.count() == f.select(F.explode(F.array("v0", "v1", "v2"))).distinct().count()
    off = v.select(F.max(F.abs(sdf.primitive(tuple(F.col(f"x{i}") for i in range(3)), shape)))).first()[0]
    assert off < 3 * step[0] ** 2 / (8 * 0.25)  # of a chord as long as a cell's diagonal, at the least radius


def test_values_of_a_table_equal_the_field(spark):
    n, field = 9, lambda p: p[0] * p[0] + p[1] * p[1] * 2 + p[2] - 20.5
    cells = isosurface.cells_of_field(spark, [n] * 3, [0] * 3, [1] * 3, field)
    places = spark.range(n**3).select(F.expr(f"id div {n * n}").alias("i"), F.expr(f"id div {n} % {n}").alias("j"), F.expr(f"id % {n}").alias("k"))
    values = places.select("i", "j", "k", field((F.col("i"), F.col("j"), F.col("k"))).cast("double").alias("f")).repartition(4)
    moved = values.select(*[(F.col(a) + 1).alias(a) for a in "ijk"], "f")
    got = isosurface.cells_of_values(moved)
    key = lambda df: sorted((r.i, r.j, r.k, tuple(r.f)) for r in df.collect())
    assert key(got.select(*[(F.col(a) - 1).alias(a) for a in "ijk"], "f")) == key(cells.select("i", "j", "k", "f"))
    (v, f), (v2, f2) = isosurface.surface(cells, [0] * 3, [1] * 3), isosurface.surface(got, [-1] * 3, [1] * 3)
    at = lambda x: sorted(tuple(round(c, 9) for c in r[2:]) for r in x.collect())
    assert at(v) == at(v2) and f.count() == f2.count() > 50


def test_noise_with_gaps_and_zeros_is_closed_where_the_rest_is_outside(spark):
    """Random values, zeros among them, at some places only, and rows that aren't places: closed and wound the same way throughout."""
    rnd = random.Random(3)
    rows = [(i, j, k, rnd.choice([-1.0, -0.25, 0.0, 0.5, 1.0])) for i in range(1, 8) for j in range(1, 7) for k in range(1, 6) if rnd.random() < 0.7]
    rows += [(0, 3, 3, -1.0), (1 << 19, 3, 3, -1.0), (3, 3, 30, None), (4, 4, 30, float("nan"))]
    values = spark.createDataFrame(rows, "i long, j long, k long, f double")
    v, f = isosurface.surface(isosurface.cells_of_values(values, missing=1.0), [0] * 3, [1] * 3)
    w = mesh.watertight(f).first()
    inside = sum(1 for r in rows[:-4] if r[3] < 0)
    undirected = f.select(F.inline(F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))])))
    balance = undirected.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.sum(F.when(F.col("a") < F.col("b"), 1).otherwise(-1)).alias("n"))
    assert inside > 40 and balance.where("n <> 0").count() == 0 and w.watertight and w.winding_consistent
    assert 0 < isosurface.volume(v, f).first().volume < 6 * inside
    left_out = isosurface.cells_of_values(values)
    have = {r[:3] for r in rows[:-4]}
    want = {(i, j, k) for i in range(8) for j in range(7) for k in range(6) if all((i + a, j + b, k + c) in have for a in (0, 1) for b in (0, 1) for c in (0, 1))}
    assert {(r.i, r.j, r.k) for r in left_out.collect()} == want


def test_no_surface(spark):
    cells = isosurface.cells_of_field(spark, [4] * 3, [0] * 3, [1] * 3, lambda p: p[0] + 1.0)
    v, f = isosurface.surface(cells, [0] * 3, [1] * 3)
    assert v.count() == f.count() == 0
    none = spark.createDataFrame([], "i long, j long, k long, f double")
    assert isosurface.cells_of_values(none, missing=1.0).count() == 0


def test_measures_equal_those_of_the_mesh_without_shuffling_its_faces(spark):
    """Random values, some missing, over several bricks: counts, edges, area and volume as the mesh itself has them."""
    rnd = random.Random(5)
    rows = [(i, j, k, rnd.choice([-1.0, -0.25, 0.0, 0.5, 1.0])) for i in range(10, 36) for j in range(14, 20) for k in range(1, 6) if rnd.random() < 0.7]
    cells = isosurface.cells_of_values(spark.createDataFrame(rows, "i long, j long, k long, f double"), missing=1.0).cache()
    lo, step = [0.5, 0.0, -1.0], [1.0, 0.5, 2.0]
    v, f = (x.cache() for x in isosurface.surface(cells, lo, step))
    w = mesh.watertight(f).first()
    got = isosurface.measured(cells, lo, step).first()
    assert (got.n_vertices, got.n_faces, got.n_edges, got.watertight, got.winding_consistent) == (v.count(), f.count(), w.n_edges, True, True)
    assert w.watertight and w.winding_consistent and w.n_edges * 2 == got.n_faces * 3 > 6000
    assert abs(got.area / mesh.face_geometry(v, f).agg(F.sum("area")).first()[0] - 1) < 1e-9 and abs(got.volume / isosurface.volume(v, f).first().volume - 1) < 1e-9
    torn = cells.where("i <> 20 or j <> 16 or k <> 3")  # a cell gone: its neighbours' edges have one face
    assert isosurface.measured(torn, lo, step).first().watertight is False
    assert isosurface.measured(cells.where("false"), lo, step).count() == 0
