"""Expression trees: values and derivatives against finite differences, constants refitted to data."""

import math
import random

import pytest
from pyspark.sql import functions as F

from voxhull.functions import expr as E
from voxhull.operators import fit

X0, X1, X2 = E.coordinates()
FORMS = {
    "wave": 0.8 * E.sin(2.3 * X0) + E.exp(1.4 * X1) * E.absolute(X2) - 0.5,
    "ratio": (X0 * X0 + 1.5) / (2.0 + E.cos(X1 * X2)) - X2**3,
    "roots": E.sqrt(X0 * X0 + 0.25) * E.log(X1 * X1 + 1.25) + (X2 * X2 + 0.5) ** 1.7,
    "powers": (X0 * X0 + 1.1) ** X1 + 3.0 / (X2 * X2 + 4.0),
}


@pytest.mark.parametrize("name", sorted(FORMS))
def test_values_and_gradients(spark, name):
    form, rnd = FORMS[name], random.Random(1)
    rows = [tuple(rnd.uniform(-1.5, 1.5) for _ in range(3)) for _ in range(40)]
    f = E.Formula(form)
    got = f.normal(f.gradient(f.value(spark.createDataFrame(rows, "x0 double, x1 double, x2 double")))).collect()
    for r in got:
        x = (r.x0, r.x1, r.x2)
        assert r.value == pytest.approx(E.evaluate(form, x), rel=1e-12, abs=1e-12)
        moved = lambda i, h: tuple(c + h * (k == i) for k, c in enumerate(x))
        slopes = [(E.evaluate(form, moved(i, 1e-6)) - E.evaluate(form, moved(i, -1e-6))) / 2e-6 for i in range(3)]
        assert [r.g0, r.g1, r.g2] == pytest.approx(slopes, rel=1e-5, abs=1e-4)
        size = math.sqrt(r.g0**2 + r.g1**2 + r.g2**2)
        assert [r.n0, r.n1, r.n2] == pytest.approx([r.g0 / (size + 1e-8), r.g1 / (size + 1e-8), r.g2 / (size + 1e-8)])


def test_constants_and_terms():
    assert E.constants(2.5 * X0**2 + 0.0 * X1 + 1.0 * X2 - X1) == [2.5]
    assert E.constants(0.5 * X0**2 + 1.732 * X1 - 0.866) == [0.5, 1.732, -0.866]
    assert E.constants(0.7 * X0 + E.sin(0.7 * X1) + X2**1.5) == [0.7, 1.5]
    places, values = E.parametric(0.7 * X0 + E.sin(0.7 * X1))
    assert values == [0.7] and E.evaluate(E.filled(places, [2.0]), (1.0, 0.5, 0.0)) == 2.0 + math.sin(1.0)
    terms = E.additive_terms(2.0 * X0 * 3.0 + E.sin(X1) * -1.0 + 4.0 + X2)
    assert [(c, repr(f)) for c, f in terms] == [(6.0, "x0"), (-1.0, "sin(x1)"), (1.0, "x2")]
    assert E.additive_terms(E.tree(5.0)) == []
    assert E.evaluate(E.from_terms({(2, 0, 1): 3.0, (0, 0, 0): -1.0}), (2.0, 9.0, 0.5)) == 5.0
    with pytest.raises(ValueError, match="abs"):
        E.derivative(E.absolute(X0), X0)


def cloud(spark, n=300):
    rnd = random.Random(8)
    return spark.createDataFrame([tuple(rnd.uniform(-1, 1) for _ in range(3)) for _ in range(n)], "x0 double, x1 double, x2 double")


def test_constants_are_refitted_to_data(spark):
    true = 0.9 * E.sin(2.0 * X0) + E.exp(1.1 * X1) * E.absolute(X2) - 0.3
    samples = cloud(spark).withColumn("y", E.column(E.smoothed(true), (F.col("x0"), F.col("x1"), F.col("x2")))).cache()
    got, losses = fit.refit_expression(samples, FORMS["wave"], steps=12)
    assert E.constants(got) == pytest.approx([0.9, 2.0, 1.1, -0.3], abs=1e-6)
    assert losses == sorted(losses, reverse=True) and losses[-1] < 1e-12 < losses[0]
    same, none = fit.refit_expression(samples, 25.0 * X0 + 0.5)
    assert (same, none) == (25.0 * X0 + 0.5, []) and fit.refit_expression(samples, X0 - X1) == (X0 - X1, [])


def test_the_sign_loss_moves_a_surface(spark):
    """A sphere of the wrong radius: the surface's rows and the signs around it put it right."""
    r = F.sqrt(F.col("x0") ** 2 + F.col("x1") ** 2 + F.col("x2") ** 2)
    near = cloud(spark, 200).where(r > 0.1)
    on = near.select(*[(F.col(f"x{i}") / r * 0.6).alias(f"x{i}") for i in range(3)], F.lit(0.0).alias("y"))
    samples = on.unionByName(near.withColumn("y", F.signum(r - 0.6))).cache()
    got, losses = fit.refit_expression(samples, E.sqrt(X0 * X0 + X1 * X1 + X2 * X2) - 0.8, steps=8, signed=True)
    assert E.constants(got) == pytest.approx([-0.6], abs=1e-6) and losses[-1] < 1e-9 < losses[0]
