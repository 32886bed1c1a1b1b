"""Meshes, sampling, rays, segmentation: analytic ground truth."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxhull.functions.vectors import lit, vec
from voxhull.operators import graphs, mesh, rays, sampling, segment, skeleton
from voxhull.sources import grids, meshes, sinks


@pytest.fixture(scope="module")
def sphere(spark):
    v, f = meshes.icosphere(spark, 2)
    return v.cache(), f.cache()


def test_icosphere(sphere):
    v, f = sphere
    assert v.count() == 10 * 4**2 + 2 and f.count() == 20 * 4**2
    assert v.select(F.max(F.abs(F.sqrt(F.col("x0") ** 2 + F.col("x1") ** 2 + F.col("x2") ** 2) - 1))).first()[0] < 1e-12
    w = mesh.watertight(f).first()
    assert w.watertight and w.winding_consistent and v.count() - w.n_edges + f.count() == 2
    c = mesh.centroid(mesh.face_geometry(v, f)).first()
    assert abs(c.area - 4 * math.pi) < 0.3 and max(abs(c.c0), abs(c.c1), abs(c.c2)) < 1e-9


def test_torus_and_box(spark):
    v, f = meshes.torus(spark, around=32, across=16)
    w = mesh.watertight(f).first()
    assert w.watertight and w.winding_consistent and v.count() - w.n_edges + f.count() == 0
    c = mesh.centroid(mesh.face_geometry(v, f)).first()
    assert abs(c.area - 4 * math.pi**2 * 0.3) < 0.2
    v, f = meshes.box(spark, (1, 0.6, 0.4))
    assert abs(mesh.centroid(mesh.face_geometry(v, f)).first().area - 2 * (0.6 + 0.4 + 0.24)) < 1e-12
    assert mesh.watertight(f.where("fid > 0")).first().watertight is False


def test_normals_point_out(sphere):
    v, f = sphere
    j = mesh.vertex_normals(mesh.face_geometry(v, f)).join(v, "vid")
    assert j.agg(F.min(F.col("n0") * F.col("x0") + F.col("n1") * F.col("x1") + F.col("n2") * F.col("x2"))).first()[0] > 0.99


def test_adjacency(sphere):
    _, f = sphere
    a = mesh.face_adjacency(f)
    assert a.count() == 3 * f.count() // 2 and a.where("f0 >= f1 or v0 >= v1").count() == 0


def test_obj_reader(spark, tmp_path):
    (tmp_path / "m.obj").write_text("# c\nv 0 0 0\nv 1 0 0\r\nvn 0 0 1\nv 1 1 0\nv 0 1 0\nf 1/1/1 2/2 3 4\nf -4 -3 -1\n")
    (tmp_path / "n.obj").write_text("")
    v, f = meshes.read_obj(spark, str(tmp_path))
    assert [tuple(r)[1:] for r in v.orderBy("vid").collect()] == [(0, 0, 0, 0), (1, 1, 0, 0), (2, 1, 1, 0), (3, 0, 1, 0)]
    assert [tuple(r)[2:] for r in f.orderBy("fid").collect()] == [(0, 1, 2), (0, 2, 3), (0, 1, 3)]


def test_normalizing(spark):
    v, f = meshes.box(spark, (2, 1, 1))
    b = mesh.bounds(mesh.normalize_mesh(v)).first()
    assert (b.lo0, b.hi0, b.lo1) == (-0.5, 0.5, -0.25)
    b = mesh.bounds(mesh.normalize_by_centroid(v, f)).first()
    assert abs(b.diagonal - 1) < 1e-12


def test_surface_samples(sphere):
    v, f = sphere
    g = mesh.face_geometry(v, f)
    s = sampling.sample_surface(g, 2000, vertex_normals=mesh.vertex_normals(g)).toPandas()
    r = np.linalg.norm(s[["x0", "x1", "x2"]], axis=1)
    assert len(s) == 2000 and ((r > 0.95) & (r <= 1.0001)).all() and np.allclose(np.linalg.norm(s[["n0", "n1", "n2"]], axis=1), 1)
    assert np.abs(s[["x0", "x1", "x2"]].mean()).max() < 0.06  # uniform by area
    again = sampling.sample_surface(g.repartition(7), 2000).toPandas()
    assert np.allclose(np.sort(again.x0), np.sort(s.x0))


def test_layers_and_strata(spark, sphere):
    v, f = sphere
    g = mesh.face_geometry(v, f)
    t = sampling.training_data(sampling.sample_surface(g, 300), 0.01)
    assert {(r.kind, round(r.y, 6)) for r in t.select("kind", "y").distinct().collect()} == {("on", 0.0), ("outside", 0.01), ("inside", -0.01)}
    s = sampling.stratified(t, 150)
    assert {r["count"] for r in s.groupBy("kind").count().collect()} == {50}
    on = sampling.sign_subset(t, 20, 30)
    assert on.count() == 50 and {r.y for r in on.select("y").distinct().collect()} == {1e6, 1.0, -1.0}


def test_patch_samples(sphere):
    v, f = sphere
    patch = v.where("x2 > 0.5").select(F.lit(0).alias("pid"), "vid")
    s = sampling.patch_samples(v, f, patch, 0, 90).toPandas()
    assert (s.groupby("kind").size() == 30).all() and not s.isna().any().any()


def test_weighted_draws_follow_weights(spark):
    w = spark.createDataFrame([(0, 1.0), (1, 0.0), (2, 3.0)], "k long, w double")
    n = {r.k: r["count"] for r in sampling.weighted_draws(spark, w, "w", "k", 4000).groupBy("k").count().collect()}
    assert set(n) == {0, 2} and abs(n[2] / 4000 - 0.75) < 0.03 and sum(n.values()) == 4000
    assert sampling.weighted_draws(spark, w.where("k = 1"), "w", "k", 5).count() == 0


def test_inside_and_distance(spark, sphere):
    g = mesh.face_geometry(*sphere).cache()
    p = spark.createDataFrame([(0, 0.0, 0.01, 0.02), (1, 0.0, 0.0, 0.9), (2, 1.5, 0.1, 0.0), (3, 0.0, -2.0, 0.0)], "id long, x0 double, x1 double, x2 double")
    inside = {r.id: r.inside for r in rays.inside_votes(p, g).collect()}
    assert inside == {0: True, 1: True, 2: False, 3: False}
    d = {r.id: r.distance for r in rays.signed_distance(p, g).collect()}
    assert -1 < d[0] < -0.9 and abs(d[1] + 0.09) < 0.03 and abs(d[2] - 0.51) < 0.03 and abs(d[3] - 1) < 0.03


def test_curvature_and_seeds(sphere):
    v, f = sphere
    g, a = mesh.face_geometry(v, f), mesh.face_adjacency(f)
    c = segment.vertex_curvature(g, v).toPandas()
    assert abs(c.gauss.sum() - 4 * math.pi) < 1e-6 and (c["mean"] > 0).all()
    n = segment.seed_estimate(g, a).first().n_seeds
    assert n >= 2 and n % 2 == 0
    assert segment.seed_estimate_accurate(g, v).first().n_seeds % 2 == 0
    w = segment.curvature_weights(g, a, v).toPandas().w
    assert w.min() >= 1 and abs(w.max() - 6) < 1e-9


def test_regions_of_a_box(spark):
    v, f = meshes.box(spark, (1, 0.6, 0.4))
    g, a = mesh.face_geometry(v, f), mesh.face_adjacency(f)
    r = segment.grow_regions(g, a)
    assert r.groupBy("region").count().where("count = 2").count() == 6
    s = mesh.region_summary(g, r.select("fid", "region")).toPandas()
    assert abs(s.share.sum() - 1) < 1e-12
    assert mesh.region_edge_length(v, f, r.select("fid", "region")).count() == 6


def test_grid(spark):
    b = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0, 2.0, 1.0)], "lo0 double, lo1 double, lo2 double, hi0 double, hi1 double, hi2 double")
    g = grids.grid(spark, b, 10).toPandas()
    assert len(g) == 1000 and abs(g.x0.min() + 0.1) < 1e-12 and abs(g.x1.max() - 2.2) < 1e-12 and (g.x2 == 1).all()
    assert g.sort_values("pt_id").x0.is_monotonic_increasing


def test_hulls():
    from voxhull.operators import slabs

    grid = np.array([(x, y) for x in range(7) for y in range(7) if not (2 <= x <= 4 and y >= 2)], float)  # a U
    assert abs(slabs.signed_area(slabs.convex_hull(grid)) - 36) < 1e-9
    assert 16 < slabs.signed_area(slabs.concave_hull(grid, 1.0)) < 30
    assert len(slabs.concave_hull(np.zeros((3, 2)), 1.0)) == 1


def test_slabs_of_a_box_are_its_sides(spark):
    from voxhull.functions import sdf
    from voxhull.functions.vectors import vec
    from voxhull.operators import slabs

    rows = slabs.slabs(*meshes.box(spark, (1.0, 0.6, 0.4))).collect()
    assert sorted(round(r.thickness, 6) for r in rows) == [0.4, 0.4, 0.6, 0.6, 1.0, 1.0] and all(len(r.hull) == 4 for r in rows)
    top = next(r for r in rows if r.n2 > 0.9)
    p = spark.createDataFrame([(0.0, 0.0, 0.2), (0.0, 0.0, 0.45), (0.6, 0.0, 0.2)], "x0 double, x1 double, x2 double")
    d = [r[0] for r in p.select(sdf.primitive(vec("x0", "x1", "x2"), slabs.primitive(top))).collect()]
    assert d[0] < 0 and abs(d[1] - 0.05) < 1e-9 and abs(d[2] - 0.1) < 1e-9


def test_rays_and_distances_equal_all_pairs(spark):
    rng = np.random.default_rng(0)
    a = rng.uniform(-2, 2, (60, 3))
    size = 10 ** rng.uniform(-2, 0.3, (60, 1, 1))
    t = np.concatenate([a[:, None], a[:, None] + rng.normal(size=(60, 2, 3)) * size], 1)
    tri = spark.createDataFrame([(i, *map(float, q.ravel())) for i, q in enumerate(t)], "fid long, " + ", ".join(f"{p}{i} double" for p in "abc" for i in range(3)))
    x = np.vstack([rng.uniform(-3, 3, (40, 3)), [[30.0, 0.0, 0.0]]])
    d = rng.normal(size=(41, 3))
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    points = spark.createDataFrame([(i, *map(float, p), *map(float, w)) for i, (p, w) in enumerate(zip(x, d))], "id long, x0 double, x1 double, x2 double, d0 double, d1 double, d2 double")
    pairs = points.crossJoin(tri)
    p, w = vec("x0", "x1", "x2"), vec("d0", "d1", "d2")
    corners = [rays.corner(c) for c in "abc"]
    want = pairs.select("id", rays.hit(p, w, *corners).alias("t")).where("t > 0.005").groupBy("id").agg(F.min("t").alias("t"))
    assert {r.id: r.t for r in rays.nearest_hits(points, tri).collect()} == pytest.approx({r.id: r.t for r in want.collect()})
    want = pairs.groupBy("id").agg(F.min(rays.triangle_distance(p, *corners)).alias("near"))
    assert {r.id: r.near for r in rays.distances(points, tri).collect()} == pytest.approx({r.id: r.near for r in want.collect()})
    counts = pairs.groupBy("id").agg(*[F.sum(rays.hit(p, lit(q), *corners).isNotNull().cast("int") % 2).alias(f"h{i}") for i, q in enumerate(rays.DIRECTIONS)])
    votes = counts.select("id", sum((F.col(f"h{i}") % 2 for i in range(1, 5)), F.col("h0") % 2).alias("votes"))
    assert {r.id: r.votes for r in rays.inside_votes(points, tri).collect()} == {r.id: r.votes for r in votes.collect()}
    assert rays.distances(points, tri.limit(0)).count() == 0 and rays.inside_votes(points.limit(0), tri).count() == 0
    plan = rays.inside_votes(points, tri)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_skeleton_classes(spark):
    rows, i = [], 0
    def put(points, radii, off):
        nonlocal i
        for p, r in zip(points, radii):
            rows.append((i, float(p[0] + off), float(p[1]), float(p[2]), float(r)))
            i += 1
    put([(0, 0, 0)], [0.2], 0)
    put([(0, 0, k * 0.1) for k in range(8)], [0.1] * 8, 10)
    put([(0, 0, k * 0.5) for k in range(8)], [0.25 + 0.08 * k for k in range(8)], 20)
    put([(np.cos(a), np.sin(a), 0) for a in np.arange(24) * np.pi / 12], [0.15] * 24, 30)
    put([(np.cos(a), np.sin(a), 0) for a in np.arange(12) * np.pi / 12], [0.15] * 12, 40)
    df = spark.createDataFrame(rows, "id long, x0 double, x1 double, x2 double, r double")
    got = {r.component: r for r in skeleton.classify(df).collect()}
    assert [got[k].type for k in sorted(got)] == ["sphere", "cylinder", "cone", "torus", "capped_torus"]
    torus = got[17]
    assert abs(torus.major_radius - 1) < 1e-6 and abs(abs(torus.axis[2]) - 1) < 1e-9
    cone = got[9]
    assert (cone.r_top > cone.r_bottom) == (cone.axis[2] > 0)


def test_crowded_spheres_are_a_box_around_the_surface(spark):
    rng = np.random.default_rng(0)
    p = rng.uniform(-0.05, 0.05, (9, 3))
    spheres = spark.createDataFrame([(i, *map(float, q), 0.5) for i, q in enumerate(p)], "id long, x0 double, x1 double, x2 double, r double")
    x = rng.uniform(-1, 1, (500, 3)) * [0.4, 0.2, 0.1]
    far = np.array([[5.0, 5.0, 5.0]])
    surface = spark.createDataFrame([tuple(map(float, q)) for q in np.vstack([x, far])], "x0 double, x1 double, x2 double")
    got = skeleton.classify(spheres, surface).collect()
    assert [(r.type, len(r.source)) for r in got] == [("box", 9)]
    assert np.allclose(sorted(got[0].half_extents), sorted(np.ptp(x @ np.linalg.svd(x - x.mean(0), full_matrices=False)[2].T, axis=0) / 2), atol=1e-6)
    bare = skeleton.classify(spheres).first()
    assert bare.type == "box" and min(bare.half_extents) > 0.5


def test_largest_breaks_ties_by_id(spark):
    df = spark.createDataFrame([(3, 0.5), (1, 0.5), (2, 0.9), (4, 0.001)], "id long, r double")
    assert [r.id for r in skeleton.largest(df, 2).collect()] == [2, 1]


def test_segmentation(spark):
    v, f = meshes.icosphere(spark, 1)
    with pytest.raises(ValueError):
        segment.segment_mesh(v, f, 2, "other")
    s = segment.segment_mesh(v, f, 2)
    assert len(set(s["seeds"])) == 2
    own = {(r.pid, r.vid) for r in s["patch"].collect()}
    assert all((i, x) in own for i, x in enumerate(s["seeds"]))
    cells = graphs.voronoi(s["dist"])
    assert cells.count() == v.count() == cells.select("vid").distinct().count()
    assert s["adjacency"].where("i >= j").count() == 0


def test_equation_and_weight_sinks(spark, tmp_path):
    lines = sinks.equation_text({(2, 0, 0): 1.0, (0, 0, 0): -1.0})
    assert lines == ["-1.0 + 1.0*x0**2", "2.0*x0", "0", "0"]
    sinks.write_equation(spark, {(1, 0, 0): 2.0}, str(tmp_path / "eq"))
    assert [r.value for r in spark.read.text(str(tmp_path / "eq")).collect()] == ["2.0*x0", "2.0", "0", "0"]
    rng = np.random.default_rng(0)
    layers = [(rng.normal(size=(4, 3)), rng.normal(size=4)), (rng.normal(size=(1, 4)), rng.normal(size=1))]
    back, act, center, scale = sinks.read_weights(sinks.weights_bytes(layers, "sine", (1, 2, 3), 0.5))
    assert act == "sine" and center == [1, 2, 3] and scale == 0.5 and all(np.allclose(a, b, atol=1e-6) for x, y in zip(layers, back) for a, b in zip(x, y))
    with pytest.raises(ValueError):
        sinks.read_weights(b"nothing at all")


def test_both_directions_of_an_edge_take_one_shuffle(spark):
    """Closed, open, turned, thrice used and degenerate faces; edges are shuffled once, and their sums once."""
    closed = [(0, 2, 1), (0, 1, 3), (1, 2, 3), (2, 0, 3)]
    kinds = {"closed": closed, "open": closed[:3], "turned": [(0, 1, 2), *closed[1:]], "thrice": [*closed, (0, 1, 4), (4, 1, 0)], "flat": [(0, 0, 1)]}
    f = spark.createDataFrame([(m, n, *v) for m, vs in kinds.items() for n, v in enumerate(vs)], "mesh_id string, fid long, v0 long, v1 long, v2 long")
    w = mesh.watertight(f)
    assert {r.mesh_id: tuple(r)[1:] for r in w.collect()} == {"closed": (6, True, True), "open": (6, False, True), "turned": (6, True, False), "thrice": (8, False, False), "flat": (2, False, True)}
    assert w._jdf.queryExecution().sparkPlan().toString().count("HashAggregate") == 4
