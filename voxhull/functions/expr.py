"""Expressions of any form (D11, P21, P21c, E9, F10): trees of numbers, coordinates and functions, evaluated and derived as Columns.

    x0, x1, x2 = coordinates()
    e = 0.8 * sin(2.3 * x0) + exp(1.4 * x1) * absolute(x2)

Trees are small and live on the driver; what runs on rows is the Column that a tree becomes, in generated code.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .poly import worth_fitting
from .vectors import Vec, norm, vec

#: Added under the root that stands for an absolute value, so that it has a derivative everywhere.
SMOOTH = 1e-8
_CALLS = {"sin": F.sin, "cos": F.cos, "exp": F.exp, "log": F.log, "sqrt": F.sqrt, "abs": F.abs}


@dataclass(frozen=True)
class Expr:
    """op: number, x (a coordinate), p (a constant by its place), + * / ** or a function's name; value: of a number, or which coordinate or place."""

    op: str
    args: tuple[Expr, ...] = ()
    value: float = 0.0

    def __add__(self, o): return plus(self, tree(o))  # noqa: E704
    def __radd__(self, o): return plus(tree(o), self)  # noqa: E704
    def __sub__(self, o): return plus(self, times(tree(-1.0), tree(o)))  # noqa: E704
    def __rsub__(self, o): return plus(tree(o), times(tree(-1.0), self))  # noqa: E704
    def __mul__(self, o): return times(self, tree(o))  # noqa: E704
    def __rmul__(self, o): return times(tree(o), self)  # noqa: E704
    def __truediv__(self, o): return times(self, power(tree(o), tree(-1.0)))  # noqa: E704
    def __rtruediv__(self, o): return times(tree(o), power(self, tree(-1.0)))  # noqa: E704
    def __pow__(self, o): return power(self, tree(o))  # noqa: E704
    def __neg__(self): return times(tree(-1.0), self)  # noqa: E704

    def __repr__(self) -> str:
        if self.op == "number":
            return f"{self.value:g}"
        if self.op in "xp":
            return f"{self.op}{int(self.value)}"
        return f"({f' {self.op} '.join(map(repr, self.args))})" if self.op in ("+", "*", "**") else f"{self.op}({self.args[0]!r})"


def tree(v: Expr | float) -> Expr:
    return v if isinstance(v, Expr) else Expr("number", value=float(v))


def coordinates(n: int = 3) -> tuple[Expr, ...]:
    return tuple(Expr("x", value=i) for i in range(n))


def _is(e: Expr, v: float) -> bool:
    return e.op == "number" and e.value == v


def plus(a: Expr, b: Expr) -> Expr:
    if _is(a, 0):
        return b
    return a if _is(b, 0) else Expr("+", (a, b))


def times(a: Expr, b: Expr) -> Expr:
    if _is(a, 0) or _is(b, 0):
        return tree(0.0)
    if _is(a, 1):
        return b
    if a.op == b.op == "number":
        return tree(a.value * b.value)
    return a if _is(b, 1) else Expr("*", (a, b))


def power(a: Expr, b: Expr) -> Expr:
    return a if _is(b, 1) else tree(1.0) if _is(b, 0) else Expr("**", (a, b))


def call(name: str):
    return lambda a: Expr(name, (tree(a),))


sin, cos, exp, log, sqrt, absolute = (call(n) for n in _CALLS)


def replaced(e: Expr, rule) -> Expr:
    """e with rule applied to each node, from the leaves up; rule gives another tree or None."""
    inner = Expr(e.op, tuple(replaced(a, rule) for a in e.args), e.value)
    return rule(inner) or inner


def smoothed(e: Expr) -> Expr:
    """Absolute values as roots of squares."""
    return replaced(e, lambda n: sqrt(n.args[0] ** 2 + SMOOTH) if n.op == "abs" else None)


def column(e: Expr, p: Sequence[Column], constants: Sequence[float] = ()) -> Column:
    """e of the coordinates p; constants: the values of places."""
    if e.op == "number":
        return F.lit(e.value)
    if e.op == "x":
        return p[int(e.value)]
    if e.op == "p":
        return F.lit(float(constants[int(e.value)]))
    a = [column(x, p, constants) for x in e.args]
    if e.op == "+":
        return a[0] + a[1]
    if e.op == "*":
        return a[0] * a[1]
    if e.op == "**":
        k = e.args[1]
        if k.op == "number" and k.value == int(k.value) and 1 <= abs(k.value) <= 8:  # products keep signs and last digits
            out = a[0]
            for _ in range(int(abs(k.value)) - 1):
                out = out * a[0]
            return out if k.value > 0 else F.try_divide(F.lit(1.0), out)
        return F.pow(a[0], a[1])
    return _CALLS[e.op](a[0])


def derivative(e: Expr, of: Expr) -> Expr:
    """By a coordinate or a place; absolute values must have been smoothed."""
    if e == of:
        return tree(1.0)
    if not e.args:
        return tree(0.0)
    a = e.args[0]
    da = derivative(a, of)
    if e.op in ("+", "*", "**"):
        b = e.args[1]
        db = derivative(b, of)
        if e.op == "+":
            return plus(da, db)
        if e.op == "*":
            return plus(times(da, b), times(a, db))
        grown = times(times(b, power(a, b - 1.0 if b.op != "number" else tree(b.value - 1))), da)
        return grown if _is(db, 0) else plus(grown, times(times(e, log(a)), db))
    outer = {"sin": lambda: cos(a), "cos": lambda: -sin(a), "exp": lambda: e, "log": lambda: power(a, tree(-1.0)), "sqrt": lambda: 0.5 * power(e, tree(-1.0))}
    if e.op not in outer:
        raise ValueError(f"no derivative of {e.op}")
    return times(outer[e.op](), da)


def gradient(e: Expr, p: Vec) -> Vec:
    """P21."""
    smooth = smoothed(e)
    return tuple(column(derivative(smooth, x), p) for x in coordinates())


def constants(e: Expr) -> list[float]:
    """the distinct numbers worth fitting, in their order in the tree; whole exponents are structure."""
    found: list[float] = []

    def see(n: Expr) -> None:
        if n.op == "number" and worth_fitting(n.value) and n.value not in found:
            found.append(n.value)
        for i, a in enumerate(n.args):
            if not (n.op == "**" and i == 1 and a.op == "number" and a.value == int(a.value)):
                see(a)

    see(e)
    return found


def parametric(e: Expr) -> tuple[Expr, list[float]]:
    """e with a place for each of constants(), and these; one number in two places of the tree is one constant."""
    found = constants(e)

    def put(n: Expr) -> Expr:
        if n.op == "number" and n.value in found:
            return Expr("p", value=found.index(n.value))
        whole = lambda i, a: n.op == "**" and i == 1 and a.op == "number" and a.value == int(a.value)
        return Expr(n.op, tuple(a if whole(i, a) else put(a) for i, a in enumerate(n.args)), n.value)

    return put(e), found


def filled(e: Expr, values: Sequence[float]) -> Expr:
    return replaced(e, lambda n: tree(values[int(n.value)]) if n.op == "p" else None)


def additive_terms(e: Expr) -> list[tuple[float, Expr]]:
    """(coefficient, function) of the sum that e is; functions that are numbers are left out."""
    if e.op == "+":
        return [t for a in e.args for t in additive_terms(a)]
    factor, rest = 1.0, tree(1.0)
    for a in _factors(e):
        factor, rest = (factor * a.value, rest) if a.op == "number" else (factor, times(rest, a))
    return [] if _is(rest, 1) else [(factor, rest)]


def _factors(e: Expr) -> list[Expr]:
    return [f for a in e.args for f in _factors(a)] if e.op == "*" else [e]


def from_terms(terms: Mapping[tuple[int, ...], float]) -> Expr:
    """A polynomial's term table as a tree."""
    out = tree(0.0)
    for powers, c in terms.items():
        one = tree(float(c))
        for x, n in zip(coordinates(len(powers)), powers):
            one = one * x**n
        out = out + one
    return out


@dataclass(frozen=True)
class Formula:
    """C7 for expressions that are no polynomials: callable on points, with gradient and normal."""

    expr: Expr
    rmse: float = float("nan")

    def value(self, points: DataFrame, out: str = "value") -> DataFrame:
        return points.withColumn(out, column(self.expr, vec("x0", "x1", "x2")))

    def gradient(self, points: DataFrame) -> DataFrame:
        return points.select("*", *[g.alias(f"g{i}") for i, g in enumerate(gradient(self.expr, vec("x0", "x1", "x2")))])

    def normal(self, points: DataFrame) -> DataFrame:
        g = gradient(self.expr, vec("x0", "x1", "x2"))
        size = norm(g) + 1e-8
        return points.select("*", *[(c / size).alias(f"n{i}") for i, c in enumerate(g)])

    @property
    def additive_terms(self) -> list[tuple[float, Expr]]:
        return additive_terms(self.expr)


def evaluate(e: Expr, x: Sequence[float]) -> float:
    """At one point, on the driver."""
    if e.op in ("number", "x"):
        return e.value if e.op == "number" else x[int(e.value)]
    a = [evaluate(n, x) for n in e.args]
    return {"+": lambda: a[0] + a[1], "*": lambda: a[0] * a[1], "**": lambda: a[0] ** a[1], "abs": lambda: abs(a[0])}.get(e.op, lambda: getattr(math, e.op)(a[0]))()
