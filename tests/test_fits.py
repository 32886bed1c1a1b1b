"""Joins on cells, graphs, fits, greedy choices and composites."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxhull.functions import poly
from voxhull.functions.vectors import vec
from voxhull.operators import blend, fit, gaussian, graphs, greedy, network, spatial
from voxhull.plans import pipelines
from voxhull.sources import meshes
from voxhull.streaming import fields

X = ("x0", "x1", "x2")


def cloud(spark, n=300, seed=0, clustered=False):
    rng = np.random.default_rng(seed)
    p = rng.normal(size=(n, 3)) * (np.where(rng.random((n, 1)) < 0.5, 0.01, 1.0) if clustered else 1.0)
    return p, spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(p)], "id long, x0 double, x1 double, x2 double")


@pytest.mark.parametrize("clustered,per_cell", [(False, 64), (True, 64), (True, 1)])
def test_knn_equals_brute_force(spark, clustered, per_cell):
    p, df = cloud(spark, 200, 1, clustered)
    got = spatial.knn(df, df.withColumnRenamed("id", "nid"), 6, same=True, per_cell=per_cell).toPandas()
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    np.fill_diagonal(d, np.inf)
    for i, g in got.groupby("id"):
        assert g.sort_values("rank").nid.tolist() == np.argsort(d[i], kind="stable")[:6].tolist()
    assert len(got) == 1200


def test_knn_far_queries_few_points_and_none(spark):
    _, df = cloud(spark, 3)
    far = spark.createDataFrame([(7, 50.0, 0.0, 0.0)], "id long, x0 double, x1 double, x2 double")
    right = df.withColumnRenamed("id", "nid")
    assert spatial.knn(far, right, 5).count() == 3
    assert spatial.knn(far, right.limit(0), 5).count() == 0 and spatial.knn(far.limit(0), right, 5).count() == 0


def test_knn_of_points_at_one_place_takes_the_first_by_id(spark):
    df = spark.createDataFrame([(i, 1.0, 2.0, 3.0) for i in range(50)] + [(99, 4.0, 2.0, 3.0)], "id long, x0 double, x1 double, x2 double")
    got = spatial.knn(df, df.withColumnRenamed("id", "nid"), 2, same=True).groupBy("id").agg(F.sort_array(F.collect_list("nid")).alias("n")).collect()
    assert {r.id: r.n for r in got} == {i: [j for j in range(3) if j != i][:2] for i in [*range(50), 99]}


def test_knn_in_a_cluster_stays_bounded(spark):
    p = np.random.default_rng(3).normal(size=(6000, 3)) * np.where(np.arange(6000) % 2, 1.0, 1e-3)[:, None]  # half of all points in one coarse cell
    df = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(p)], "id long, x0 double, x1 double, x2 double")
    got = spatial.knn(df, df.withColumnRenamed("id", "nid"), 3, same=True).toPandas()
    assert len(got) == 18000
    for i in (0, 1, 5000, 5999):
        d = np.linalg.norm(p - p[i], axis=1)
        d[i] = np.inf
        assert got[got.id == i].sort_values("rank").nid.tolist() == np.argsort(d)[:3].tolist()


def test_sphere_overlaps_equal_all_pairs(spark):
    rng = np.random.default_rng(4)
    x, r = rng.uniform(0, 4, (150, 3)), 10 ** rng.uniform(-3, 0.3, 150)
    df = spark.createDataFrame([(i, *map(float, q), float(v)) for i, (q, v) in enumerate(zip(x, r))], "id long, x0 double, x1 double, x2 double, r double")
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if np.linalg.norm(x[i] - x[j]) < 1.1 * (r[i] + r[j])}
    got = [(q.i, q.j) for q in spatial.sphere_overlaps(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_components_and_paths(spark):
    rng = np.random.default_rng(2)
    n = 60
    e = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, n, 55), rng.integers(0, n, 55), rng.random(55)) if a != b]
    links = spark.createDataFrame([(a, b) for a, b, _ in e], "a long, b long")
    got = {r.node: r.component for r in graphs.components(spark.range(n).withColumnRenamed("id", "node"), links).collect()}
    near = {i: [] for i in range(n)}
    for a, b, w in e:
        near[a].append((b, w))
        near[b].append((a, w))
    d, todo = {0: 0.0}, [(0.0, 0)]
    while todo:
        x, i = heapq.heappop(todo)
        for j, w in near[i]:
            if x + w < d.get(j, 9e9):
                d[j] = x + w
                heapq.heappush(todo, (x + w, j))
    assert {i for i in range(n) if got[i] == got[0]} == set(d)
    both = spark.createDataFrame([(a, b, w) for a, b, w in e] + [(b, a, w) for a, b, w in e], "src long, dst long, w double")
    found = {r.vid: r.d for r in graphs.shortest_paths(both, spark.createDataFrame([(0,)], "source long")).collect()}
    assert found == pytest.approx(d)


def test_farthest_points_of_a_path(spark):
    e = [(i, i + 1, 1.0) for i in range(8)]
    g = spark.createDataFrame(e + [(b, a, w) for a, b, w in e], "src long, dst long, w double")
    assert graphs.farthest_points(g, 0, 3)[0] == [0, 8, 4]


def sample(spark, terms, n=600, seed=0):
    x = np.random.default_rng(seed).uniform(-1, 1, (n, 3))
    y = pipelines.Equation(terms)(x)
    return spark.createDataFrame([(i, *map(float, p), float(v)) for i, (p, v) in enumerate(zip(x, y))], "pt_id long, x0 double, x1 double, x2 double, y double")


TERMS = {(2, 0, 0): 1.0, (0, 2, 0): 1.0, (0, 0, 2): 1.0, (0, 0, 0): -0.64}


def test_sparse_regression_recovers_a_sphere(spark):
    out = fit.fit_polynomial(sample(spark, TERMS), 4)
    assert out["rmse"] < 1e-6
    big = {e: c for e, c in out["terms"].items() if abs(c) > 1e-4}
    assert set(big) == set(TERMS) and all(abs(big[e] - TERMS[e]) < 1e-4 for e in big)


def test_gram_by_fold_and_loss(spark):
    s = sample(spark, TERMS, 200)
    p = vec(*X)
    whole = fit.gram(s, poly.features(p, 2), F.col("y"))
    parts = fit.gram(s, poly.features(p, 2), F.col("y"), F.pmod("pt_id", F.lit(5)))
    assert np.allclose(whole[0], sum(g for g, *_ in parts.values())) and whole[3] == 200
    a = fit.least_squares(whole[0], whole[1])
    assert fit.loss(*whole, a) < 1e-6
    o = fit.orthogonal_matching(whole[0], whole[1], 4)
    assert set(np.flatnonzero(np.abs(o) > 1e-8)) == {0, 4, 7, 9}
    assert np.count_nonzero(fit.refit_support(whole[0], whole[1], np.eye(10)[0])) == 1


def test_lasso_is_sparse_and_warm_start_of_wrong_length_is_ignored(spark):
    s = sample(spark, TERMS, 200)
    parts = fit.gram(s, poly.features(vec(*X), 3), F.col("y"), F.pmod("pt_id", F.lit(5)))
    a, lam = fit.lasso_cv(parts)
    b, _ = fit.lasso_cv(parts, np.ones(3))
    assert lam > 0 and np.allclose(a, b) and np.count_nonzero(np.abs(a) > 1e-3) <= 8


def test_sign_hinge_lowers_its_loss(spark):
    x = np.random.default_rng(0).normal(size=(500, 3))
    r = np.linalg.norm(x, axis=1, keepdims=True)
    on = x / r * 0.8
    rows = [(i, *map(float, p), 0.0) for i, p in enumerate(on)] + [(1000 + i, *map(float, p * 1.1), 0.01) for i, p in enumerate(on)] + [(2000 + i, *map(float, p * 0.9), -0.01) for i, p in enumerate(on)]
    df = spark.createDataFrame(rows, "pt_id long, x0 double, x1 double, x2 double, y double")
    start = poly.to_coefficients({(2, 0, 0): 1.0, (0, 2, 0): 0.7, (0, 0, 2): 1.3, (0, 0, 0): -0.6}, 2)
    a, seen = fit.sign_hinge_fit(df, poly.features(vec(*X), 2), start, steps=15)
    assert seen[-1] < 0.2 * seen[0] and abs(np.linalg.norm(a) - np.linalg.norm(start)) < 1e-9


def test_refit_keeps_structure(spark):
    s = sample(spark, {(2, 0, 0): 2.5, (1, 0, 0): 1.0, (0, 0, 0): -0.5})
    got = fit.refit_terms(s, {(2, 0, 0): 2.0, (1, 0, 0): 1.0, (0, 0, 0): -0.3})
    assert got[1, 0, 0] == 1.0 and abs(got[2, 0, 0] - 2.5) < 1e-9
    assert fit.refit_terms(s, {(2, 0, 0): 50.0}) == {(2, 0, 0): 50.0}
    assert not poly.worth_fitting(1.0) and not poly.worth_fitting(-1.0) and poly.worth_fitting(0.5)


def test_polynomial_blend_and_residual(spark):
    s = sample(spark, TERMS)
    a, b = dict(TERMS), poly.plus(dict(TERMS), {(0, 0, 0): 0.3})
    error = lambda t: float(fit.rmse(s, poly.evaluate(vec(*X), t), F.col("y")).first().rmse)
    assert np.isfinite(error(blend.polynomial_weight(s, a, b)))
    half = poly.plus(dict(TERMS), {(0, 0, 0): -0.3})
    assert error(blend.polynomial_weight(s, half, b)) < error(b)  # between two fields that miss on either side
    assert blend.polynomial_weight(s, {}, b) == b and blend.polynomial_weight(s, a, a) == a
    terms, error = blend.residual_merge(s, b, 2)
    assert error < 1e-6
    assert blend.residual_merge(s, TERMS, 2)[0] == TERMS


def test_gaussian_process(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (150, 3))
    y = np.linalg.norm(x, axis=1) - 0.7
    m = gaussian.fit(x, y)
    q = rng.uniform(-0.8, 0.8, (50, 3))
    assert np.isfinite(m["likelihood"]) and np.abs(gaussian.predict(m, q) - (np.linalg.norm(q, axis=1) - 0.7)).mean() < 0.02
    with pytest.raises(NotImplementedError):
        gaussian.fit(x, y, "gpytorch")
    with pytest.raises(ValueError):
        gaussian.fit(x, y, "other")


def test_network(spark):
    rng = np.random.default_rng(0)
    layers = network.as_sphere(network.initial(32, 2), 0.6)
    x = rng.uniform(-1, 1, (500, 3))
    assert np.abs(network.forward(layers, x) - (np.linalg.norm(x, axis=1) - 0.6)).mean() < 0.05
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id long, x0 double, x1 double, x2 double")
    got = network.predict(df, layers).orderBy("id").toPandas().value
    assert np.allclose(got, network.forward(layers, x))
    on = x / np.linalg.norm(x, axis=1, keepdims=True) * 0.8
    xs, ys = np.vstack([on, on * 1.2, on * 0.8]), np.repeat([0.0, 0.1, -0.1], 500)
    samples = spark.createDataFrame([(*map(float, p), float(v)) for p, v in zip(xs, ys)], "x0 double, x1 double, x2 double, y double")
    _, losses = network.train(samples, layers, steps=60)
    assert losses[-1] < 0.2 * losses[0]
    for bad, error in (("knn", NotImplementedError), ("nope", ValueError)):
        with pytest.raises(error):
            network.make_model(bad)


def test_matching_equals_sequential_choice(spark):
    rng = np.random.default_rng(5)
    c = sorted({(int(min(a, b)), int(max(a, b))): int(n) for a, b, n in zip(rng.integers(0, 20, 80), rng.integers(0, 20, 80), rng.integers(1, 6, 80)) if a != b}.items())
    df = spark.createDataFrame([(a, b, n) for (a, b), n in c], "a long, b long, n long")
    want, used = set(), set()
    for n, a, b in sorted(((n, a, b) for (a, b), n in c), reverse=True):
        if a not in used and b not in used:
            want.add((a, b, n))
            used |= {a, b}
    assert {tuple(r) for r in greedy.greedy_matching(df).collect()} == want


def test_merge_tree_keeps_every_patch(spark):
    nodes = spark.createDataFrame([(i, [i]) for i in range(5)], "node_id long, patch_ids array<long>")
    overlap = spark.createDataFrame([(0, 1), (0, 1), (1, 2), (3, 4)], "i long, j long")
    levels = []
    got = greedy.merge_tree(nodes, overlap, lambda level, pairs: levels.append(pairs.count()))
    assert sorted(sorted(r.patch_ids) for r in got.collect()) == [[0, 1, 2], [3, 4]] and levels == [2, 1]


def test_greedy_cover_explains_a_sphere(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    on = x / np.linalg.norm(x, axis=1, keepdims=True)
    surface = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(on * 0.9)], "nid long, x0 double, x1 double, x2 double")
    v = np.vstack([[0, 0, 0], rng.uniform(-0.5, 0.5, (80, 3))])
    voxels = spark.createDataFrame([(i, *map(float, p), float(1 - np.linalg.norm(p))) for i, p in enumerate(v)], "id long, x0 double, x1 double, x2 double, depth double")
    log = []
    got = greedy.greedy_cover(surface, voxels, largest=2.0, k=5, most=2, log=log)
    assert got[0]["type"] == "sphere" and abs(got[0]["radius"] - 0.9) < 1e-9 and log[0] == 1.0 and len(got) == 1


def test_capsules_lie_along_their_surroundings(spark):
    rng = np.random.default_rng(1)
    rod = np.column_stack([rng.uniform(-1, 1, 400), rng.normal(size=(400, 2)) * 0.02])
    near = np.vstack([rod, rng.normal(size=(3, 3)) * 0.01 + [9, 9, 9]])
    deep = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(near)], "id long, x0 double, x1 double, x2 double")
    seeds = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.8), (2, 9.0, 9.0, 9.0, 0.8)], "id long, x0 double, x1 double, x2 double, depth double")
    got = greedy.capsules(seeds, deep, 0.3).collect()
    assert [r.id for r in got] == [1]  # too few points around the other
    c = got[0]
    off = rod[np.linalg.norm(rod, axis=1) <= 1.2]
    axis = np.linalg.svd(off, full_matrices=False)[2][0]
    assert abs(abs(np.dot(c.axis, axis)) - 1) < 1e-6 and c.radius == 0.3 and abs(c.half_height - min(np.ptp(off @ axis) / 2, 0.72)) < 1e-9
    assert not greedy.capsules(seeds, deep, 5.0).count()  # wider than long
    shell = spark.createDataFrame([(0.3, 0.3, 0.0), (0.9, 0.0, 0.0), (-0.2, 0.0, 0.31)], "x0 double, x1 double, x2 double")
    assert [r.gained for r in greedy.capsule_gains(greedy.capsules(seeds, deep, 0.3), shell, 0.02).collect()] == [2]


def test_balloon_finds_the_sphere(spark):
    v, f = meshes.icosphere(spark, 2)
    e = pipelines.compile_balloon(v, f, pipelines.BalloonConfig(n_surface=1500, n_volume=0))
    assert e.degree == 2 and e.rmse < 1e-2
    assert np.allclose(e.terms[2, 0, 0], e.terms[0, 2, 0], rtol=0.05)


def test_the_sign_loss_decides_a_fit(spark):
    """A box by a polynomial of degree 2: steps of the loss change the fit and lower that loss, though not the error of least squares."""
    rng = np.random.default_rng(5)
    half = np.array([0.9, 0.5, 0.3])
    x = rng.uniform(-1, 1, (600, 3))
    d = np.abs(x) - half
    off = np.linalg.norm(np.maximum(d, 0), axis=1) + np.minimum(d.max(1), 0)
    on = rng.uniform(-1, 1, (300, 3)) * half
    side = rng.integers(0, 3, 300)
    on[np.arange(300), side] = half[side] * rng.choice([-1, 1], 300)
    rows = [(*map(float, p), float(v)) for p, v in zip(np.vstack([x, on]), [*off, *np.zeros(300)])]
    samples = spark.createDataFrame(rows, "x0 double, x1 double, x2 double, y double").cache()
    design = fit.Design.polynomial(vec(*X), 2)
    sums = fit.gram(samples, design, F.col("y"))
    start = poly.to_coefficients(poly.sphere_terms(2, 0.6), 2)
    loss = lambda a: np.mean((m[600:] @ a) ** 2) / (a @ a) + np.mean(np.maximum(-(m[:600] @ a) * np.sign(off), 0) ** 2) / (a @ a)
    m = fit.monomials(np.vstack([x, on]), np.array(poly.exponents(2)))
    (plain_error, plain), (error, hinge) = (pipelines.fitted(samples, design, F.col("y"), sums, start, pipelines.BalloonConfig(newton_steps=k), 2) for k in (0, 12))
    assert error >= plain_error and not np.allclose(plain, hinge, rtol=1e-2)
    assert loss(hinge) < 0.9 * loss(plain)


def test_gram_of_a_high_degree(spark):
    s = sample(spark, TERMS, 500)
    g, b, yy, n = fit.gram(s, fit.Design.polynomial(vec(*X), 10), F.col("y"))
    assert g.shape == (286, 286) and n == 500 and fit.loss(g, b, yy, n, fit.least_squares(g, b)) < 1e-6
    few = fit.gram(s, poly.features(vec(*X), 3), F.col("y"))
    assert np.allclose(g[:20, :20], few[0]) and np.allclose(b[:20], few[1])


def test_curvature_and_its_derivatives():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6, 3))
    powers = np.array(poly.exponents(2))
    sphere = poly.to_coefficients(poly.sphere_terms(2, 1.0), 2)
    d = fit.derivative_matrices(x, powers)
    h, by = fit.curvature([m @ sphere for m in d])
    assert np.allclose(h, 1 / np.linalg.norm(x, axis=1), atol=1e-6)
    a = sphere + rng.normal(size=10) * 0.1
    h, by = fit.curvature([m @ a for m in d])
    jacobian = sum(b[:, None] * m for b, m in zip(by, d))
    for k in range(10):
        step = np.zeros(10)
        step[k] = 1e-6
        up, down = (fit.curvature([m @ (a + sign * step) for m in d])[0] for sign in (1, -1))
        assert np.allclose((up - down) / 2e-6, jacobian[:, k], atol=1e-4)


def test_balloon_with_curvature(spark):
    v, f = meshes.icosphere(spark, 2)
    e = pipelines.compile_balloon(v, f, pipelines.BalloonConfig(n_surface=600, n_volume=50, curvature_weight=0.01, newton_steps=5))
    assert e.degree == 2 and e.rmse < 2e-2


def test_patches_merge_to_the_sphere_by_either_blend(spark):
    v, f = meshes.icosphere(spark, 3)
    x = np.random.default_rng(0).normal(size=(300, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for merge in ("polynomial", "partition_of_unity"):
        e, merges = pipelines.compile_mesh(v, f, pipelines.PatchConfig(n_seeds=6, degree=4, resolution=8, merge=merge))
        assert sum(len(level) for level in merges) == 5
        r = np.linspace(0.5, 1.5, 401)
        values = e((x[:, None, :] * r[None, :, None]).reshape(-1, 3)).reshape(300, 401)
        turn = np.abs(values).argmin(1)
        assert 0.85 < r[turn].mean() < 1.15


class Spheres:
    """A backend of one's own: every patch is the unit sphere."""

    def fit_patches(self, samples, config):
        alphas = poly.to_coefficients(poly.sphere_terms(2, 1.0), config.degree)
        return samples.select("pid").distinct().select("pid", F.array(*[F.lit(float(a)) for a in alphas]).alias("alphas"), F.lit(0.0).alias("rmse"))


def test_patches_by_a_backend_of_ones_own(spark):
    v, f = meshes.icosphere(spark, 2)
    e, _ = pipelines.compile_mesh(v, f, pipelines.PatchConfig(n_seeds=2, degree=2, backend=Spheres()))
    assert abs(e(np.array([[1.0, 0.0, 0.0]]))[0]) < 0.1


def test_patch_pipeline_finds_the_sphere(spark):
    v, f = meshes.icosphere(spark, 2)
    with pytest.raises(ValueError):
        pipelines.compile_mesh(v, f, pipelines.PatchConfig(merge="other"))
    e, merges = pipelines.compile_mesh(v, f, pipelines.PatchConfig(n_seeds=2, degree=2, resolution=6))
    x = np.random.default_rng(0).normal(size=(200, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert np.isfinite(e.rmse) and np.abs(e(x)).mean() < 0.2 and merges


def test_streamed_coverage_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-01 00:{i:02d}:00", 0.15 if i % 3 else 0.9, 0.0, 0.0) for i in range(50)]
    df = spark.createDataFrame(rows, "t string, x0 double, x1 double, x2 double").select(F.col("t").cast("timestamp").alias("ts"), *X)
    df.write.parquet(str(tmp_path / "in"))
    ball = [{"type": "sphere", "center": (0, 0, 0), "radius": 0.15}]
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = fields.coverage_by_window(stream, ball).writeStream.format("memory").queryName("cov").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    want = fields.coverage_by_window(df, ball)
    assert sorted(map(tuple, spark.table("cov").collect())) == sorted(map(tuple, want.collect())) and want.count() == 5
    q = fields.distances(stream, ball).writeStream.format("memory").queryName("each").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("each").where("covered").count() == sum(1 for i in range(50) if i % 3)


def test_seed_gains_count_without_a_row_for_each_pair(spark, monkeypatch):
    monkeypatch.setattr(greedy, "BLOCK", 7)
    monkeypatch.setattr(greedy, "PART", 50)
    monkeypatch.setattr(spatial, "radius_join", None)  # spheres as wide as the cloud: cells would join all with all
    x = np.random.default_rng(3).normal(size=(300, 3)) * 0.2
    surface = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "nid long, x0 double, x1 double, x2 double")
    seeds = spark.createDataFrame([(i, *map(float, x[i]), 0.1 + 0.01 * i) for i in range(30)], "id int, x0 double, x1 double, x2 double, r double")
    got = {r.id: r.gained for r in greedy.seed_gains(seeds, surface, 0.02).collect()}
    want = {i: sum(abs(np.linalg.norm(q - x[i]) - (0.1 + 0.01 * i)) <= 0.02 for q in x) for i in range(30)}
    assert got == {i: n for i, n in want.items() if n}
