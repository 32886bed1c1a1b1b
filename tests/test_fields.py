"""Fields, polynomials and harmonics: analytic values and invariances."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxhull.functions import harmonics, poly, sdf
from voxhull.functions.vectors import hashed_uniform, vec
from voxhull.operators import blend
from voxhull.plans.pipelines import Equation

X = ("x0", "x1", "x2")


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rng.uniform(-1, 1, (200, 3)))], "id long, x0 double, x1 double, x2 double").cache()


def column(points, c, *more):
    rows = points.select("id", *X, c.alias("v"), *more).orderBy("id").collect()
    return np.array([r.v for r in rows]), np.array([[r[x] for x in X] for r in rows])


def test_sphere_and_translation(points):
    got, p = column(points, sdf.primitive(vec(*X), {"type": "sphere", "center": (0.1, 0, 0), "radius": 0.5}))
    assert np.allclose(got, np.linalg.norm(p - [0.1, 0, 0], axis=1) - 0.5)


def test_zero_set_of_each_solid(spark):
    at = [("capsule", (0, 0, 1.5)), ("cylinder", (0.5, 0, 0.2)), ("box", (0.3, 0, 0)), ("torus", (1.3, 0, 0)), ("cone", (0.2, 0, 1.0))]
    base = {"center": (0, 0, 0), "axis": (0, 0, 1), "radius": 0.5, "half_height": 1.0, "axes": ((1, 0, 0), (0, 1, 0), (0, 0, 1)), "half_extents": (0.3, 0.4, 0.5), "major_radius": 1.0, "r_top": 0.2, "r_bottom": 0.4}
    for kind, p in at:
        q = dict(base, type=kind, radius=0.3 if kind == "torus" else 0.5)
        df = spark.createDataFrame([tuple(map(float, p))], "x0 double, x1 double, x2 double")
        assert abs(df.select(sdf.primitive(vec(*X), q)).first()[0]) < 1e-12, kind


def test_concave_polygon(spark):
    hull = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (5.0, 0.0), (2.0, 0.5)], "u double, v double")
    got = [r[0] for r in df.select(sdf.polygon(F.col("u"), F.col("v"), hull)).collect()]
    assert got[0] < 0 < got[1] and abs(got[2] - 1) < 1e-12 and got[3] < 0


def test_smooth_union_depends_on_order_and_stays_below_minimum(points):
    ps = [{"type": "sphere", "center": (0.1 * i, 0, 0), "radius": 0.2} for i in range(4)]
    u, _ = column(points, sdf.smooth_union(vec(*X), ps))
    parts = [column(points, sdf.primitive(vec(*X), q))[0] for q in ps]
    assert (u <= np.min(parts, axis=0) + 1e-12).all()
    want = parts[0]
    for d in parts[1:]:
        h = np.clip(0.5 + 0.5 * (d - want) * 32, 0, 1)
        want = d * (1 - h) + want * h - h * (1 - h) / 32
    assert np.allclose(u, want, atol=1e-14)
    assert column(points, sdf.smooth_union(vec(*X), []))[0].min() == math.inf
    assert not points.select(sdf.covered(sdf.smooth_union(vec(*X), [])).alias("c")).where("c").count()


def test_unknown_primitives_raise(spark, points):
    with pytest.raises(ValueError):
        sdf.primitive(vec(*X), {"type": "blob"})
    bad = spark.createDataFrame([(("blob", [0.0, 0.0, 0.0], 1.0),)], "prim struct<type:string,center:array<double>,radius:double>")
    sdf.register_primitive("ball", sdf.sphere)
    try:
        with pytest.raises(Exception, match="blob|FIELD_NOT_FOUND|No such struct field"):
            points.limit(1).join(bad).select(sdf.primitive_of(vec(*X), F.col("prim"))).collect()
    finally:
        del sdf.PRIMITIVES["ball"]


def test_features_and_names():
    assert [len(poly.exponents(d)) for d in (2, 4)] == [10, 35]
    assert poly.names(2) == ["1", "x0", "x1", "x2", "x0^2", "x0 x1", "x0 x2", "x1^2", "x1 x2", "x2^2"]
    assert [poly.parse(n) for n in poly.names(4)] == poly.exponents(4)


def test_terms_round_trip_and_algebra():
    rng = np.random.default_rng(1)
    a = rng.normal(size=35)
    t = poly.from_coefficients(a, 4)
    assert np.allclose(poly.to_coefficients(t, 4), a) and poly.to_coefficients({(5, 0, 0): 1.0}, 4) is None
    x = rng.normal(size=(20, 3))
    moved = poly.denormalize(t, (0.3, -0.1, 0.2), 1.7)
    assert np.allclose(Equation(moved)(x), Equation(t)((x - [0.3, -0.1, 0.2]) / 1.7))
    assert np.allclose(Equation(poly.times(t, t))(x), Equation(t)(x) ** 2)
    assert np.allclose(poly.expand(a, 4, 6)[:35], a) and len(poly.expand(a, 4, 6)) == 84
    s = poly.sphere_terms(6, 0.8)
    assert poly.degree_of(s) == 6 and abs(Equation(s)(np.array([[0.8, 0, 0]]))[0]) < 1e-12
    with pytest.raises(ValueError):
        poly.sphere_terms(3, 1.0)


def test_gradient_and_normal(points):
    t = {(2, 0, 0): 1.0, (1, 1, 1): -2.0, (0, 0, 3): 0.5, (0, 0, 0): -1.0}
    rows = Equation(t).normal(Equation(t).gradient(points)).orderBy("id").collect()
    for r in rows[:50]:
        g = np.array([2 * r.x0 - 2 * r.x1 * r.x2, -2 * r.x0 * r.x2, -2 * r.x0 * r.x1 + 1.5 * r.x2**2])
        assert np.allclose([r.g0, r.g1, r.g2], g) and np.allclose([r.n0, r.n1, r.n2], g / (np.linalg.norm(g) + 1e-8))


def test_harmonics_are_orthonormal(spark):
    n = 40
    z, w = np.polynomial.legendre.leggauss(n)
    phi = np.arange(2 * n) * np.pi / n
    rows = [(float(np.sqrt(1 - a * a) * np.cos(p)), float(np.sqrt(1 - a * a) * np.sin(p)), float(a), float(b * np.pi / n)) for a, b in zip(z, w) for p in phi]
    df = spark.createDataFrame(rows, "x0 double, x1 double, x2 double, w double")
    names = [(2, -2), (3, -1), (3, 0), (3, 2), (4, 4)]
    ys = [harmonics.real_harmonic(l, m, vec(*X)) for l, m in names]
    got = df.agg(*[F.sum(a * b * F.col("w")) for a in ys for b in ys]).first()
    m = np.array(list(got)).reshape(5, 5)
    assert np.allclose(m - np.diag(np.diag(m)), 0, atol=1e-9)
    assert np.allclose(np.diag(m), [1.0 if k == 0 else 0.5 for _, k in names], atol=1e-9)


def test_hybrid_matrix_equals_the_columns(spark):
    names = harmonics.hybrid_names(2, 3, 1)
    x = np.vstack([np.random.default_rng(0).normal(size=(20, 3)), np.zeros(3), [0, 0, 2.0], [0, 0, -2.0]])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id long, x0 double, x1 double, x2 double")
    want = df.select("id", *[harmonics.hybrid_feature(vec("x0", "x1", "x2"), n).alias(f"f{i}") for i, n in enumerate(names)]).orderBy("id").toPandas().to_numpy()[:, 1:]
    assert np.allclose(harmonics.hybrid_matrix(x, names), want, atol=1e-9)


def test_hybrid_basis_drops_one_constant():
    assert len(harmonics.hybrid_names(2, 2, 1)) == 10 + 2 * 9 - 1


def test_blends(points):
    a, b = F.col("x0"), F.col("x1")
    s, p = column(points, blend.smooth_minimum(a, b, 0.1))
    assert (s <= np.minimum(p[:, 0], p[:, 1])).all()
    with pytest.warns(UserWarning):
        z, _ = column(points, blend.smooth_minimum(a, b, 0.0))
    assert np.allclose(z, np.minimum(p[:, 0], p[:, 1]))
    u, p = column(points, blend.partition_of_unity(a, b, vec(*X), (5, 0, 0), (-5, 0, 0), 0.5))
    assert np.allclose(u[p[:, 0] > 0.3], p[p[:, 0] > 0.3, 0])


def test_hashed_uniform_is_uniform_and_repeats(spark):
    df = spark.range(20000).select(hashed_uniform(F.col("id")).alias("u"))
    r = df.agg(F.min("u"), F.max("u"), F.avg("u"), F.stddev("u")).first()
    assert 0 <= r[0] < 0.001 and 0.999 < r[1] < 1 and abs(r[2] - 0.5) < 0.01 and abs(r[3] - 12**-0.5) < 0.01
