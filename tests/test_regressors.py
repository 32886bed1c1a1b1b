"""Support vector regression and distributed training against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxhull.operators import fit, network, svr
from voxhull.plans import pipelines
from voxhull.sources import meshes


def rows_of(spark, x, y):
    return spark.createDataFrame([(*map(float, p), None if v is None else float(v)) for p, v in zip(x, y)], "x0 double, x1 double, x2 double, y double")


def exact_tube(z, y, c, epsilon, rounds=20000, rho=5.0):
    """The same objective by alternating directions: f - y is a variable of its own, whose best value is known in closed form."""
    p = np.diag([1.0] * (z.shape[1] - 1) + [0.0])
    solve = np.linalg.inv(p + rho * z.T @ z)
    r, u = np.zeros(len(y)), np.zeros(len(y))
    for _ in range(rounds):
        w = solve @ (rho * z.T @ (y + r - u))
        a = z @ w - y + u
        out = np.abs(a) - epsilon
        r = np.where(out <= 0, a, np.sign(a) * (epsilon + np.maximum(out - c / rho, 0)))
        u = u + z @ w - y - r
    return w, 0.5 * w[:-1] @ w[:-1] + c * np.maximum(np.abs(z @ w - y) - epsilon, 0).sum()


def test_tube_equals_an_exact_solver(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (200, 3))
    y = np.linalg.norm(x, axis=1) - 0.6 + rng.normal(0, 0.05, 200)
    y[::40] += 2  # far off: the loss grows with distance, not with its square
    features = svr.Fourier.drawn(3, 20, 0.8)
    flat = rows_of(spark, x, y).toDF("_c0", "_c1", "_c2", "_y")
    design = fit.Design(tuple(F.col(f"_c{i}") for i in range(3)), features.size, features)
    w, seen = svr.fit_tube(flat, design, 2.0, 0.05, tol=1e-6)
    want, least = exact_tube(features(x), y, 2.0, 0.05)
    assert all(b <= a * (1 + 1e-3) for a, b in zip(seen, seen[1:]))
    assert least * (1 - 1e-6) <= min(seen) <= 1.005 * least
    assert np.abs(features(x) @ w - features(x) @ want).mean() < 0.02


def test_svr_learns_a_field_and_leaves_out_nulls(spark):
    x = np.random.default_rng(2).uniform(-1, 1, (1500, 3))
    y = [*(np.linalg.norm(x, axis=1) - 0.6)[:-1], None]
    rows = network.assembled(rows_of(spark, x, y))
    got = network.make_model("svr").fit(rows).transform(rows)
    assert got.columns == [*rows.columns, "prediction"] and got.count() == 1500
    assert got.agg(F.sqrt(F.avg((F.col("prediction") - F.col("y")) ** 2))).first()[0] < 0.03
    none = rows.limit(0)
    assert network.make_model("svr", {"size": 8}).fit(none).transform(rows.limit(3)).where("prediction = 0").count() == 3


@pytest.mark.parametrize("kind", ["tanh", "sine", "relu"])
def test_derivatives_equal_differences(spark, kind):
    rng = np.random.default_rng(3)
    x, y = rng.uniform(-1, 1, (60, 3)), rng.choice([-0.1, 0.0, 0.1], 60)
    flat = rows_of(spark, x, y).withColumn("draw", F.pmod(F.xxhash64("x0"), F.lit(1 << 50)).cast("double")).repartition(3).persist()
    layers = network.initial(70, 1, kind, seed=4)  # more weights than one row of a block holds
    counts = int((y == 0).sum()), int((y != 0).sum())

    def loss(net):
        f, s = network.forward(net, x, kind), np.sign(y)
        return (f[s == 0] ** 2).mean() + 2.0 * (np.maximum(-f * s, 0)[s != 0] ** 2).mean()

    grads, value = network.step_sums(flat, layers, kind, counts, 1000, 1, 2.0)
    assert np.isclose(value, loss(layers))
    assert [g.shape for g in grads] == [p.shape for wb in layers for p in wb]
    for n, at in ((0, (5, 1)), (1, (8,)), (2, (0, 40)), (3, (0,))):
        ends = []
        for d in (1e-6, -1e-6):
            params = [p.copy() for wb in layers for p in wb]
            params[n][at] += d
            ends.append(loss([(params[0], params[1]), (params[2], params[3])]))
        assert np.isclose(grads[n][at], (ends[0] - ends[1]) / 2e-6, rtol=1e-4, atol=1e-7)


def test_a_step_draws_part_of_the_rows_off_the_surface(spark):
    rng = np.random.default_rng(5)
    x, y = rng.uniform(-1, 1, (4000, 3)), np.repeat(-1.0, 4000)  # all on the wrong side of a field of 1
    flat = rows_of(spark, x, y).withColumn("draw", F.pmod(F.xxhash64("x0", "x1"), F.lit(1 << 50)).cast("double")).persist()
    ones = [(np.zeros((2, 3)), np.zeros(2)), (np.zeros((1, 2)), np.ones(1))]
    seen = [network.step_sums(flat, ones, "tanh", (0, 4000), 400, t)[1] for t in (1, 2, 1)]
    assert seen[0] == seen[2] != seen[1] and all(0.8 < v < 1.2 for v in seen)


def test_network_of_a_mesh(spark):
    v, f = meshes.icosphere(spark, 2)
    got = pipelines.compile_network(v, f, pipelines.NetworkConfig(n_surface=400, n_volume=100, hidden=16, steps=40))
    x = np.random.default_rng(0).normal(size=(100, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    at = (x - np.array(got["center"])) / got["scale"]
    assert got["losses"][-1] < got["losses"][0] and np.abs(network.forward(got["layers"], at)).mean() < 0.1
