"""Winding, outward normals and holes against meshes whose right faces are known."""

import random

from pyspark.sql import functions as F

from voxhull.operators import mesh, repair
from voxhull.sources import meshes

FACE = "mesh_id string, fid long, v0 long, v1 long, v2 long"


def first_least(f):
    k = f.index(min(f))
    return f[k:] + f[:k]


def faces_of(df, mesh_id=None):
    return sorted(first_least((r.v0, r.v1, r.v2)) for r in df.collect() if mesh_id in (None, r.mesh_id))


def damaged(rows, seed, share=0.4):
    rnd = random.Random(seed)
    return [(m, f, a, c, b) if rnd.random() < share else (m, f, a, b, c) for m, f, a, b, c in rows]


def test_winding_and_volume_restore_turned_faces(spark):
    """Two closed meshes at once; of one nearly all faces are turned, so that the least face is, too."""
    parts, verts = [], None
    for v, f in (meshes.torus(spark, around=9, across=5, mesh_id="t"), meshes.icosphere(spark, 1, mesh_id="s")):
        parts.append([tuple(r) for r in f.select("mesh_id", "fid", "v0", "v1", "v2").collect()])
        verts = v if verts is None else verts.unionByName(v)
    broken = damaged(parts[0], 1) + damaged(parts[1], 2, 0.95)
    df = spark.createDataFrame(broken, FACE)
    wound = repair.wind(df)
    check = {r.mesh_id: r for r in mesh.watertight(wound).collect()}
    assert all(r.watertight and r.winding_consistent for r in check.values()) and wound.where("not orientable").count() == 0
    out = repair.repaired(verts, df)
    for name, rows in zip("ts", parts):
        assert faces_of(out, name) == sorted(first_least(r[2:]) for r in rows)
    was = {(m, f): first_least(v) for m, f, *v in broken}
    assert all((was[r.mesh_id, r.fid] != first_least([r.v0, r.v1, r.v2])) == r.flipped for r in out.collect())


def test_a_moebius_strip_has_no_consistent_winding(spark):
    n = 7
    rows = []
    for i in range(n):
        a, b = 2 * i, 2 * i + 1
        c, d = (2 * i + 2, 2 * i + 3) if i < n - 1 else (1, 0)
        rows += [("m", 2 * i, a, c, d), ("m", 2 * i + 1, a, d, b)]
    got = repair.wind(spark.createDataFrame(rows + [("other", 5, 0, 1, 2), ("other", 6, 1, 0, 3)], FACE))
    assert {(r.mesh_id, r.orientable, r.component) for r in got.collect()} == {("m", False, 0), ("other", True, 5)}
    assert got.where("flipped").count() == 0


def lattice(n, m, gone=()):
    """Faces of n by m squares, without those in gone."""
    at = lambda i, j: i * (m + 1) + j
    out = []
    for i in range(n):
        for j in range(m):
            if (i, j) not in gone:
                out += [("g", 2 * at(i, j), at(i, j), at(i + 1, j), at(i + 1, j + 1)), ("g", 2 * at(i, j) + 1, at(i, j), at(i + 1, j + 1), at(i, j + 1))]
    return out


def test_borders_that_meet_in_a_vertex_are_told_apart(spark):
    """Holes side by side over corners: each is a loop of its own, and the outer border is one."""
    gone = {(1, 1), (2, 2), (1, 3), (3, 1), (4, 4), (4, 5)}
    rows = lattice(7, 8, gone)
    wound = repair.wind(spark.createDataFrame(damaged(rows, 3), FACE)).cache()
    got = repair.loops(repair.hole_edges(wound)).toPandas()
    sizes = sorted(got.groupby("loop").size().tolist())
    assert sizes == [4, 4, 4, 4, 6, 30]
    for _, g in got.groupby("loop"):
        g = g.sort_values("at")
        assert g["at"].tolist() == list(range(len(g))) and (g["size"] == len(g)).all()
        assert g.t.tolist() == [*g.s.tolist()[1:], g.s.tolist()[0]] and (g.s.iloc[0], g.t.iloc[0]) == min(zip(g.s, g.t))
    filled = repair.fill_holes(wound)
    assert filled.where("added").count() == 8 and filled.select("fid").distinct().count() == filled.count()
    ends = mesh.watertight(filled).first()
    assert ends.winding_consistent and not ends.watertight
    edges = repair.half_edges(filled).groupBy(F.least("a", "b"), F.greatest("a", "b")).count()
    assert edges.where("count = 1").count() == 36 and edges.where("count > 2").count() == 0


def test_no_faces_and_bare_faces(spark):
    none = spark.createDataFrame([], FACE)
    v = spark.createDataFrame([("a", i, float(i), float(i * i), 0.0) for i in range(6)], "mesh_id string, vid long, x0 double, x1 double, x2 double")
    assert repair.repaired(v, none).count() == 0
    one = spark.createDataFrame([("a", 3, 0, 1, 2)], FACE)
    assert faces_of(repair.repaired(v, one, most=3)) == [(0, 1, 2), (0, 2, 1)]  # its border is a hole of three edges
    assert faces_of(repair.repaired(v, one, most=2)) == [(0, 1, 2)]
    three = spark.createDataFrame([("a", 1, 0, 1, 2), ("a", 2, 0, 1, 3), ("a", 4, 1, 0, 4)], FACE)  # three faces on an edge
    assert faces_of(repair.wind(three)) == [(0, 1, 2), (0, 1, 3), (0, 4, 1)]
