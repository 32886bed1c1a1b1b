"""Region growing in rounds and within parts, against growing face by face."""

import math
import random

import pytest

from voxhull.operators import mesh, segment


def plain(faces, links, least):
    """faces: fid to normal; seeds in order of fid, each taking what it reaches among free faces with its normal."""
    near = {f: set() for f in faces}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    region = {}
    for seed in sorted(faces):
        if seed not in region:
            region[seed], stack = seed, [seed]
            while stack:
                for g in near[stack.pop()]:
                    if g not in region and abs(sum(x * y for x, y in zip(faces[g], faces[seed]))) >= least:
                        region[g] = seed
                        stack.append(g)
    return region


def rough(rnd, name, n, m):
    """A height field with flat and slanted stretches: vertices and faces."""
    h = [[rnd.choice([0.0, 0.0, 0.05, 0.3, rnd.random()]) for _ in range(m)] for _ in range(n)]
    v = [(name, i * m + j, float(i), float(j), h[i][j]) for i in range(n) for j in range(m)]
    numbers = list(range(2 * (n - 1) * (m - 1)))
    rnd.shuffle(numbers)
    squares = [(i * m + j, (i + 1) * m + j, (i + 1) * m + j + 1, i * m + j + 1) for i in range(n - 1) for j in range(m - 1)]
    return v, [(name, numbers[2 * k + side], *t) for k, (a, b, c, d) in enumerate(squares) for side, t in enumerate(((a, b, c), (a, c, d)))]


@pytest.mark.parametrize("least, sizes", [(0.998, (1 << 18,)), (0.9, (0, 1 << 18))])
def test_a_hundred_meshes_grow_in_rounds_as_face_by_face(spark, least, sizes):
    rnd = random.Random(17)
    v, f = [], []
    for k in range(100):
        a, b = rough(rnd, f"m{k}", rnd.randint(2, 4), rnd.randint(2, 5))
        v += a
        f += b
    vertices = spark.createDataFrame(v, "mesh_id string, vid long, x0 double, x1 double, x2 double")
    faces = spark.createDataFrame(f, "mesh_id string, fid long, v0 long, v1 long, v2 long")
    geometry, adjacency = mesh.face_geometry(vertices, faces).cache(), mesh.face_adjacency(faces).cache()
    normals = {}
    for r in geometry.collect():
        normals.setdefault(r.mesh_id, {})[r.fid] = (r.n0, r.n1, r.n2)
    links = {}
    for r in adjacency.collect():
        links.setdefault(r.mesh_id, []).append((r.f0, r.f1))
    want = {(m, k): s for m in normals for k, s in plain(normals[m], links.get(m, []), least).items()}
    for together in sizes:
        got = segment.grow_regions(geometry, adjacency, least, together).collect()
        assert {(r.mesh_id, r.fid): r.region for r in got} == want and len(got) == len(want)
    assert 100 < len({(m, s) for (m, _), s in want.items()}) < len(want)


def test_opposite_normals_share_a_region_and_no_faces_have_none(spark):
    faces = spark.createDataFrame([("a", 5, 0.0, 0.0, 1.0), ("a", 7, 0.0, 0.0, -1.0), ("a", 9, 0.0, math.sin(0.2), math.cos(0.2))], "mesh_id string, fid long, n0 double, n1 double, n2 double")
    near = spark.createDataFrame([("a", 5, 7, 0, 1), ("a", 7, 9, 1, 2)], "mesh_id string, f0 long, f1 long, v0 long, v1 long")
    for together in (0, 10):
        assert {r.fid: r.region for r in segment.grow_regions(faces, near, 0.998, together).collect()} == {5: 5, 7: 5, 9: 9}
        assert segment.grow_regions(faces.where("fid < 0"), near.where("f0 < 0"), 0.998, together).count() == 0


@pytest.mark.parametrize("least, per", [(0.9, 16), (0.8, 40), (0.998, 25)])
def test_regions_that_cross_chunks_again_and_again_grow_as_face_by_face(spark, least, per):
    """One rough surface whose faces are numbered at random, so that regions leave and enter chunks many times, and one numbered in rows."""
    rnd = random.Random(per)
    v, f = rough(rnd, "mixed", 13, 14)
    w, g = rough(rnd, "rows", 12, 12)
    g = [(m, 3 * k + 1, *t) for k, (m, _, *t) in enumerate(g)]
    vertices = spark.createDataFrame(v + w, "mesh_id string, vid long, x0 double, x1 double, x2 double")
    faces = spark.createDataFrame(f + g, "mesh_id string, fid long, v0 long, v1 long, v2 long")
    geometry, adjacency = mesh.face_geometry(vertices, faces).cache(), mesh.face_adjacency(faces).cache()
    links = adjacency.select("mesh_id", "f0", "f1")
    got = {(r.mesh_id, r.fid): r.region for r in segment._rounds(geometry.select("mesh_id", "fid", "n0", "n1", "n2"), links, least, per).collect()}
    for name in ("mixed", "rows"):
        normals = {r.fid: (r.n0, r.n1, r.n2) for r in geometry.where(geometry.mesh_id == name).collect()}
        want = plain(normals, [(r.f0, r.f1) for r in links.where(links.mesh_id == name).collect()], least)
        assert {k: s for (m, k), s in got.items() if m == name} == want


def test_sets_of_a_few_faces_share_calls(spark):
    sets = spark.range(4000).selectExpr("'m' AS mesh_id", "id div 2 AS part", "2L AS size").unionByName(spark.createDataFrame([("m", 7777, 9999)], "mesh_id string, part long, size long"))
    calls = {r.b: r.n for r in sets.groupBy(segment._batch(sets).alias("b")).agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert calls.pop(-7778) == 1 and len(calls) <= int(spark.conf.get("spark.sql.shuffle.partitions")) and max(calls.values()) < 2000
