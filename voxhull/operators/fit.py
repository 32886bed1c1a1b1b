"""Fits on Gram matrices.

Least squares in all its forms needs sums of products of features only. Each task multiplies its rows' feature matrix with
itself, batch by batch; the tasks' matrices are added up block by block in a shuffle, and the driver solves. No row
leaves its executor, and a polynomial's features are made where they are multiplied: only coordinates travel to Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr, poly
from ..functions.vectors import Vec, vec
from . import spatial

BLOCK = 64  # rows of a matrix that travel together
ROWS = 4096  # rows whose features are held at a time
SUMS = "g long, block int, n long, data binary"
_SUMS = pa.schema([("g", pa.int64()), ("block", pa.int32()), ("n", pa.int64()), ("data", pa.binary())])


@dataclass(frozen=True)
class Design:
    """Features of a fit: Columns, and what makes a matrix of features, rows by ``size``, of their values."""

    columns: tuple[Column, ...]
    size: int
    matrix: Callable[[np.ndarray], np.ndarray]

    @staticmethod
    def of(features: Sequence[Column] | Design) -> Design:
        return features if isinstance(features, Design) else Design(tuple(features), len(features), lambda x: x)

    @staticmethod
    def polynomial(p: Vec, degree: int) -> Design:
        """The monomials of poly.exponents(degree)."""
        powers = np.array(poly.exponents(degree))
        return Design(tuple(p), len(powers), lambda x: monomials(x, powers))


def monomials(x: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """x, a row a point, to the powers, a row a monomial."""
    out = np.ones((len(x), len(powers)))
    for i in range(x.shape[1]):
        ladder = np.cumprod(np.column_stack([np.ones(len(x)), *[x[:, i]] * int(powers[:, i].max(initial=0))]), axis=1)
        out *= ladder[:, powers[:, i]]
    return out


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of one group's blocks, one at a time."""
    total, n, first = None, 0, None
    for batch in batches:
        for i in range(batch.num_rows):
            part = np.frombuffer(batch.column(3)[i].as_py())
            total = part.copy() if total is None else total + part
            n += batch.column(2)[i].as_py()
            first = first or (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
    yield pa.RecordBatch.from_arrays([pa.array([first[0]], pa.int64()), pa.array([first[1]], pa.int32()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], schema=_SUMS)


def summed(rows: DataFrame, width: int, part: Callable[[np.ndarray], Iterator[tuple[int, np.ndarray, int]]]) -> dict[int, tuple[np.ndarray, int]]:
    """Sums of matrices with ``width`` columns by group: part(values) yields (group, matrix, count) of some rows' values.

    rows: columns of doubles; rows with a null are left out. A task adds up its own, so what is shuffled is one matrix a task and
    group, in blocks of rows, and one task adds up one block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, int] = {}
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            x = x[~np.isnan(x).any(axis=1)]
            for lo in range(0, len(x), ROWS):
                for g, m, n in part(x[lo : lo + ROWS]):
                    sums[g] = m if g not in sums else sums[g] + m
                    counts[g] = counts.get(g, 0) + n
        for g, m in sums.items():
            for lo in range(0, len(m), BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([lo], pa.int32()), pa.array([0 if lo else counts[g]], pa.int64()), pa.array([m[lo : lo + BLOCK].tobytes()], pa.binary())], schema=_SUMS)

    total = rows.mapInArrow(run, SUMS).groupBy("g", "block").applyInArrow(_added, SUMS).toArrow().sort_by([("g", "ascending"), ("block", "ascending")])
    out: dict[int, tuple[np.ndarray, int]] = {}
    for g in dict.fromkeys(total["g"].to_pylist()):
        at = [i for i, x in enumerate(total["g"].to_pylist()) if x == g]
        out[g] = np.concatenate([np.frombuffer(total["data"][i].as_py()).reshape(-1, width) for i in at]), sum(total["n"][i].as_py() for i in at)
    return out


def gram(rows: DataFrame, features: Sequence[Column] | Design, y: Column, by: Column | None = None):
    """(G, b, yy, n) with G = sum of f f', b = sum of f y; a dict of these by the group (a whole number) where ``by`` is given.

    Rows with a null or NaN among them don't count.
    """
    design = Design.of(features)
    k, matrix = design.size, design.matrix
    flat = rows.select(*[c.cast("double").alias(f"_c{i}") for i, c in enumerate(design.columns)], y.cast("double").alias("_y"), (F.lit(0.0) if by is None else by.cast("double")).alias("_g"))

    def part(x: np.ndarray) -> Iterator[tuple[int, np.ndarray, int]]:
        z = np.column_stack([matrix(x[:, :-2]), x[:, -2]])
        for g in np.unique(x[:, -1]):
            own = z[x[:, -1] == g]
            yield int(g), own.T @ own, len(own)

    got = {g: (m[:k, :k], m[:k, k], float(m[k, k]), n) for g, (m, n) in summed(flat, k + 1, part).items()}
    if by is None:
        return got.get(0, (np.zeros((k, k)), np.zeros(k), 0.0, 0))
    return got  # by: a few folds or regions


def least_squares(g: np.ndarray, b: np.ndarray, ridge: float = 0.0) -> np.ndarray:
    return np.linalg.lstsq(g + ridge * np.eye(len(b)), b, rcond=None)[0]


def loss(g, b, yy, n, alpha) -> float:
    """Root mean square error of coefficients, from the sums alone."""
    return float(np.sqrt(max(0.0, (alpha @ g @ alpha - 2 * alpha @ b + yy) / max(1, n))))


def rmse(rows: DataFrame, predicted: Column, y: Column) -> DataFrame:
    """A9 over rows, for any prediction."""
    return rows.agg(F.sqrt(F.avg((predicted - y) ** 2)).alias("rmse"), F.count("*").alias("n"))


def lasso_path_point(g: np.ndarray, b: np.ndarray, n: int, lam: float, start: np.ndarray | None = None, rounds: int = 500, tol: float = 1e-7) -> np.ndarray:
    """Coordinate descent on |y - Fa|^2 / 2n + lam |a|_1, all from the Gram matrix."""
    a = np.zeros(len(b)) if start is None else start.astype(float).copy()
    q = g @ a
    diag = np.diag(g)
    for _ in range(rounds):
        most = 0.0
        for i in np.flatnonzero(diag > 0):
            rho = b[i] - q[i] + diag[i] * a[i]
            new = np.sign(rho) * max(abs(rho) - lam * n, 0.0) / diag[i]
            if new != a[i]:
                q += g[:, i] * (new - a[i])
                most = max(most, abs(new - a[i]))
                a[i] = new
        if most <= tol * max(1e-12, np.abs(a).max()):
            break
    return a


def lasso_cv(folds: Mapping[int, tuple], start: np.ndarray | None = None, n_lambdas: int = 60, floor: float = 1e-3) -> tuple[np.ndarray, float]:
    """M4: the penalty of least cross-validated error over folds' sums, and its coefficients on all rows.

    start: coefficients to begin the final fit from (a warm start at the found penalty); of a wrong length it is ignored.
    """
    g, b, yy, n = (sum(f[i] for f in folds.values()) for i in range(4))
    top = np.abs(b).max() / max(1, n)
    if top == 0:
        return np.zeros(len(b)), 0.0
    lambdas = np.geomspace(top, top * floor, n_lambdas)
    errors = np.zeros(n_lambdas)
    for fg, fb, fyy, fn in folds.values():
        a = None
        for i, lam in enumerate(lambdas):
            a = lasso_path_point(g - fg, b - fb, n - fn, lam, a, rounds=200, tol=1e-5)
            errors[i] += a @ fg @ a - 2 * a @ fb + fyy
    lam = lambdas[int(np.argmin(errors))]
    return lasso_path_point(g, b, n, lam, start if start is not None and len(start) == len(b) else None), float(lam)


def refit_support(g: np.ndarray, b: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """M5: the exact least squares on the coefficients that aren't zero; the others stay zero."""
    on = np.flatnonzero(alpha)
    out = np.zeros(len(alpha))
    if len(on):
        out[on] = np.linalg.lstsq(g[np.ix_(on, on)], b[on], rcond=None)[0]
    return out


def orthogonal_matching(g: np.ndarray, b: np.ndarray, most: int = 50, tol: float = 1e-10) -> np.ndarray:
    """M9: the features that explain most of what is left, one at a time, refitted each time; columns count as of length 1."""
    size = np.sqrt(np.maximum(np.diag(g), 1e-300))
    chosen: list[int] = []
    a = np.zeros(len(b))
    for _ in range(min(most, len(b))):
        left = np.abs(b - g @ a) / size
        left[chosen] = -1
        i = int(np.argmax(left))
        if left[i] <= tol:
            break
        chosen.append(i)
        a = np.zeros(len(b))
        a[chosen] = np.linalg.lstsq(g[np.ix_(chosen, chosen)], b[chosen], rcond=None)[0]
    return a


def fit_polynomial(samples: DataFrame, degree: int = 4, start: np.ndarray | None = None, order: str = "pt_id", folds: int = 5) -> dict:
    """M6: sparse regression of samples(x0..x2, y): normalise, expand, choose by cross-validated lasso, refit, move back.

    {"terms" (world frame), "alphas" (normalised frame), "rmse" (normalised), "center", "scale", "lambda"}. Folds are hashes of ``order``.
    """
    from .sampling import normalize_points

    frame = samples.agg(*[F.avg(f"x{i}").alias(f"c{i}") for i in range(3)]).first()
    center = [frame[f"c{i}"] for i in range(3)]
    scale = normalize_points(samples).select("scale").first().scale
    p = tuple((F.col(f"x{i}") - center[i]) / scale for i in range(3))
    k = folds if samples.limit(2 * folds).count() == 2 * folds else 1
    sums = gram(samples, Design.polynomial(p, degree), F.col("y"), F.pmod(F.xxhash64(order), F.lit(k)))
    g, b, yy, n = (sum(f[i] for f in sums.values()) for i in range(4))
    alphas, lam = lasso_cv(sums, start) if len(sums) > 1 else (least_squares(g, b), 0.0)
    alphas = refit_support(g, b, alphas)
    world = poly.denormalize(poly.from_coefficients(alphas, degree), center, scale)
    return {"terms": world, "alphas": alphas, "rmse": loss(g, b, yy, n, alphas), "center": center, "scale": scale, "lambda": lam}


def refit_terms(samples: DataFrame, terms: poly.Terms, limit: float = 20.0) -> poly.Terms:
    """M14 for polynomials, with F10 and F11: constants worth fitting are refitted together, structural 0 and 1 stay; a constant
    above the limit leaves all as it is.
    """
    if any(abs(c) > limit for c in terms.values()):
        return dict(terms)
    free = [e for e, c in terms.items() if poly.worth_fitting(c)]
    if not free:
        return dict(terms)
    p = vec("x0", "x1", "x2")
    fixed = {e: c for e, c in terms.items() if e not in free}
    g, b, _, _ = gram(samples, [poly.monomial(p, e) for e in free], F.col("y") - poly.evaluate(p, fixed))
    return fixed | dict(zip(free, least_squares(g, b).tolist()))


def expression_sums(samples: DataFrame, form: expr.Expr, values: Sequence[float], signs: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Of an expression with places for constants the sums that a Gauss-Newton step takes, one aggregate: products of its derivatives by the constants,
    these times what is missing, and the loss.

    The loss is the mean square of f - y; with ``signs``, the numbers of surface rows (y = 0) and others, it is the surface rows' mean square of f plus the
    others' mean square of f where its sign is wrong.
    """
    p = vec("x0", "x1", "x2")
    smooth = expr.smoothed(form)
    f = expr.column(smooth, p, values)
    slopes = [expr.column(expr.derivative(smooth, expr.Expr("p", value=i)), p, values) for i in range(len(values))]
    if signs is None:
        g, b, yy, n = gram(samples, slopes, F.col("y") - f)
        return g / max(n, 1), b / max(n, 1), yy / max(n, 1)
    on, off = (float(max(n, 1)) ** -0.5 for n in signs)
    weight = F.when(F.col("y") == 0, F.lit(on)).when(f * F.signum("y") < 0, F.lit(off)).otherwise(F.lit(0.0))
    g, b, yy, _ = gram(samples, [s * weight for s in slopes], -f * weight)
    return g, b, yy


def refit_expression(samples: DataFrame, form: expr.Expr, steps: int = 30, limit: float = 20.0, signed: bool = False, tol: float = 1e-12) -> tuple[expr.Expr, list[float]]:
    """M14 with F10, F11: the constants of any expression refitted to samples(x0, x1, x2, y), its structure as it is; the expression and the losses so far.

    Damped Gauss-Newton steps, each one aggregate over the samples; a step that doesn't lower the loss is taken back and damped more. A constant
    above the limit, or none worth fitting, leaves all as it is.
    """
    places, values = expr.parametric(form)
    if not values or any(abs(c) > limit for c in values):
        return form, []
    counts = None
    if signed:
        n = samples.agg(F.sum((F.col("y") == 0).cast("long")).alias("on"), F.sum((F.col("y") != 0).cast("long")).alias("off")).first()
        counts = (n.on or 0, n.off or 0)
    best, damping = np.array(values), 1e-3
    g, b, least = expression_sums(samples, places, best, counts)
    losses = [least]
    for _ in range(steps):
        step = np.linalg.lstsq(g + damping * np.diag(np.diag(g)) + 1e-15 * np.eye(len(b)), b, rcond=None)[0]
        g2, b2, now = expression_sums(samples, places, best + step, counts)
        if np.isfinite(now) and now < least:
            done = least - now <= tol * max(least, 1e-300)
            best, g, b, least, damping = best + step, g2, b2, now, damping / 5
            losses.append(least)
            if done or least < 1e-24:
                break
        else:
            damping *= 10
            if damping > 1e6:
                break
    return expr.filled(places, best.tolist()), losses


def curvature(d: Sequence[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The mean curvature of level sets from the derivatives x, y, z, xx, yy, zz, xy, xz, yz, and its derivatives by each of these."""
    gx, gy, gz, xx, yy, zz, xy, xz, yz = d
    m2 = gx * gx + gy * gy + gz * gz + 1e-8
    m = np.sqrt(m2)
    trace = xx + yy + zz
    along = gx * gx * xx + gy * gy * yy + gz * gz * zz + 2 * (gx * gy * xy + gx * gz * xz + gy * gz * yz)
    top, low = m2 * trace - along, 2 * (m2 * m + 1e-8)
    by_first = []
    for g, row in ((gx, (xx, xy, xz)), (gy, (xy, yy, yz)), (gz, (xz, yz, zz))):
        dtop = 2 * g * trace - 2 * (row[0] * gx + row[1] * gy + row[2] * gz)
        by_first.append((dtop * low - top * 6 * m * g) / (low * low))
    second = [(m2 - g * g) / low for g in (gx, gy, gz)] + [-2 * a * b / low for a, b in ((gx, gy), (gx, gz), (gy, gz))]
    return top / low, by_first + second


def derivative_matrices(x: np.ndarray, powers: np.ndarray) -> list[np.ndarray]:
    """The features' derivatives in the order of curvature()."""

    def by(axes: Sequence[int]) -> np.ndarray:
        q, c = powers.copy(), np.ones(len(powers))
        for a in axes:
            c = c * q[:, a]
            q[:, a] = np.maximum(q[:, a] - 1, 0)
        return monomials(x, q) * c

    return [by(a) for a in ((0,), (1,), (2,), (0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2))]


def hinge_sums(samples: DataFrame, design: Design, alphas: np.ndarray, counts: tuple[int, int], sign_weight: float = 1.0, curved: float = 0.0, powers: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """One step's sums of the loss of sign_hinge_fit at the coefficients: (J'J, J'r, r'r) over its residuals r. samples(_c..., _s, _h); one job.

    The curvature term, where curved > 0, is that of surface rows with a target _h (NaN: none); it needs a polynomial's powers.
    """
    on, off = (max(1, n) for n in counts)
    k, matrix = design.size, design.matrix

    def part(x: np.ndarray) -> Iterator[tuple[int, np.ndarray, int]]:
        f, sign, target = matrix(x[:, :-2]), x[:, -2], x[:, -1]
        value = f @ alphas
        weight = np.where(sign == 0, 1.0 / on, np.where(value * sign < 0, sign_weight / off, 0.0))
        use = weight > 0
        j, r, w = f[use], value[use], weight[use]
        z = np.column_stack([j, r]) * np.sqrt(w)[:, None]
        out = z.T @ z
        bent = (sign == 0) & (target < NO_TARGET) if curved and powers is not None else np.zeros(len(x), bool)
        if bent.any():
            d = derivative_matrices(x[bent][:, :-2], powers)
            h, by = curvature([m @ alphas for m in d])
            z = np.column_stack([sum(b[:, None] * m for b, m in zip(by, d)), h - target[bent]]) * np.sqrt(curved / on)
            out = out + z.T @ z
        yield 0, out, len(x)

    m = summed(samples, k + 1, part).get(0, (np.zeros((k + 1, k + 1)), 0))[0]
    return m[:k, :k], m[:k, k], float(m[k, k])


NO_TARGET = 1e300


def sign_hinge_fit(samples: DataFrame, features: Sequence[Column] | Design, alphas: np.ndarray, steps: int = 50, rate: float = 1.0, sign_weight: float = 1.0, ridge: float = 1e-5, curved: float = 0.0, target: str | None = None, degree: int | None = None) -> tuple[np.ndarray, list[float]]:
    """Mean f^2 on the surface (y = 0) + sign_weight * mean relu(-f sign y)^2 off it + curved * mean (curvature - target)^2 + ridge |a|^2.

    A row on its right side adds nothing. Each step aggregates the residuals' sums at the current coefficients (one job, whatever the
    number of rows) and takes a damped Gauss-Newton step that keeps the coefficients' length, which rules out the zero field.
    curved, target, degree: the curvature term is for polynomial features of that degree with a column of targets, null where there is none.
    """
    from .storage import stored

    design = Design.of(features)
    powers = np.array(poly.exponents(degree)) if degree is not None else None
    h = F.lit(NO_TARGET) if target is None else F.coalesce(F.col(target).cast("double"), F.lit(NO_TARGET))
    flat = stored(samples.select(*[c.cast("double").alias(f"_c{i}") for i, c in enumerate(design.columns)], F.signum("y").alias("_s"), h.alias("_h")))
    counts = flat.agg(F.sum((F.col("_s") == 0).cast("int")).alias("on"), F.sum((F.col("_s") != 0).cast("int")).alias("off")).first()
    a, length, seen = alphas.astype(float).copy(), float(np.linalg.norm(alphas)), []
    best, low, damping = a, np.inf, 1e-3
    for _ in range(steps):
        g, r, now = hinge_sums(flat, design, a, (counts.on or 0, counts.off or 0), sign_weight, curved, powers)
        value = now + ridge * float(a @ a)
        seen.append(min(value, low))
        if value < low:
            done = low - value <= 1e-9 * max(1e-12, low) if np.isfinite(low) else False
            best, low, damping = a, value, max(damping / 3, 1e-9)
            top, slope = g, r + ridge * a
            if done:
                break
        else:  # a step too far: back, and shorter
            a, damping = best, damping * 10
            if damping > 1e6:
                break
        scale = max(float(np.trace(top)) / len(a), 1e-300)
        new = best - rate * np.linalg.solve(top + (ridge + damping * scale) * np.eye(len(a)), slope)
        norm = np.linalg.norm(new)
        a = new * (length / norm) if norm > 0 else best
    return best, seen


def nearest_curvature(surface: DataFrame, vertices: DataFrame, value: str, key: str = "pt_id") -> DataFrame:
    """Key, target: at each surface point the value of the nearest of vertices(vid, x0..x2, value), divided by all points' standard deviation."""
    near = spatial.nearest(surface.select(F.col(key).alias("id"), "x0", "x1", "x2"), vertices.select(F.col("vid").alias("nid"), "x0", "x1", "x2"))
    got = near.join(vertices.select(F.col("vid").alias("nid"), F.col(value).alias("v")), "nid")
    spread = got.agg(F.stddev_pop("v").alias("s"))  # one row
    return got.join(F.broadcast(spread), F.lit(True)).select(F.col("id").alias(key), (F.col("v") / (F.col("s") + 1e-8)).alias("target"))


# ------------------------------------------------------------------------------------ shapes of point groups

def covariances(points: DataFrame, key: str) -> DataFrame:
    """A17's sums: count, means m0..m2 and the six population covariances of each group; all partial aggregates."""
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    return points.groupBy(key).agg(F.count("*").alias("n"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(3)], *[F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}{j}") for i, j in pairs])


def principal_values() -> tuple[Column, Column, Column]:
    """The eigenvalues of c00..c22, falling, in closed form for symmetric 3x3 matrices."""
    c = {(i, j): F.col(f"c{min(i, j)}{max(i, j)}") for i in range(3) for j in range(3)}
    q = (c[0, 0] + c[1, 1] + c[2, 2]) / 3
    off = c[0, 1] ** 2 + c[0, 2] ** 2 + c[1, 2] ** 2
    p = F.sqrt(((c[0, 0] - q) ** 2 + (c[1, 1] - q) ** 2 + (c[2, 2] - q) ** 2 + off * 2) / 6)
    b = {k: (v - (q if k[0] == k[1] else 0)) / F.greatest(p, F.lit(1e-300)) for k, v in c.items()}
    det = b[0, 0] * (b[1, 1] * b[2, 2] - b[1, 2] ** 2) - b[0, 1] * (b[0, 1] * b[2, 2] - b[1, 2] * b[0, 2]) + b[0, 2] * (b[0, 1] * b[1, 2] - b[1, 1] * b[0, 2])
    phi = F.acos(F.least(F.greatest(det / 2, F.lit(-1.0)), F.lit(1.0))) / 3
    big, small = q + p * 2 * F.cos(phi), q + p * 2 * F.cos(phi + F.lit(2 * np.pi / 3))
    flat = p <= 1e-300
    return F.when(flat, q).otherwise(big), F.when(flat, q).otherwise(q * 3 - big - small), F.when(flat, q).otherwise(small)


def principal_axes(sums: DataFrame, key: str) -> DataFrame:
    """sums(key, c00..c22, ...) with its rows' eigenvalues l1 >= l2 >= l3 and axes a10..a32, each axis with its largest part positive.

    A row is a group's aggregate, so what goes to Python is one row a group; each batch is decomposed at once.
    """
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    names = [*[f"l{k}" for k in (1, 2, 3)], *[f"a{k}{i}" for k in (1, 2, 3) for i in range(3)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = np.zeros((batch.num_rows, 3, 3))
            for n, (i, j) in enumerate(pairs):
                c[:, i, j] = c[:, j, i] = batch.column(n).to_numpy(zero_copy_only=False)
            values, axes = np.linalg.eigh(np.nan_to_num(c))
            values, axes = np.maximum(values[:, ::-1], 0.0), axes[:, :, ::-1].transpose(0, 2, 1)
            top = np.take_along_axis(axes, np.abs(axes).argmax(2)[:, :, None], 2)
            axes = axes * np.where(top < 0, -1.0, 1.0)
            new = [pa.array(values[:, k]) for k in range(3)] + [pa.array(np.ascontiguousarray(axes[:, k, i])) for k in range(3) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[len(pairs) :], *new], names=[*batch.schema.names[len(pairs) :], *names])

    rest = [c for c in sums.columns if c not in {f"c{i}{j}" for i, j in pairs}]
    schema = ", ".join([*[f"`{c}` {t}" for c, t in sums.select(*rest).dtypes], *[f"{n} double" for n in names]])
    return sums.select(*[f"c{i}{j}" for i, j in pairs], *rest).mapInArrow(run, schema)


def line_and_plane(points: DataFrame, key: str) -> DataFrame:
    """Of each group the share of variance on its first axis (line_r2), and flatness = third over first singular value."""
    a, b, c = principal_values()
    s = covariances(points, key).select(key, "n", a.alias("l1"), b.alias("l2"), F.greatest(c, F.lit(0.0)).alias("l3"))
    total = (F.col("l1") + F.col("l2") + F.col("l3")) * F.col("n")
    return s.select("*", (F.col("l1") * F.col("n") / (total + 1e-10)).alias("line_r2"), (F.sqrt(F.col("l3") * F.col("n")) / (F.sqrt(F.col("l1") * F.col("n")) + 1e-10)).alias("flatness"))


def circles(points: DataFrame, key: str, u: Column, v: Column) -> DataFrame:
    """The algebraic circle fit of each group's plane coordinates u, v: cu, cv, radius, r2; groups under 3 points have r2 0 and radius 0.

    The nine sums are one aggregate and the 3x3 system is solved by Cramer's rule; residuals take a second pass.
    """
    q = points.select(key, u.alias("u"), v.alias("v")).withColumn("z", F.col("u") ** 2 + F.col("v") ** 2)
    s = q.groupBy(key).agg(F.count("*").alias("n"), *[F.sum(e).alias(a) for a, e in (("su", F.col("u")), ("sv", F.col("v")), ("suu", F.col("u") ** 2), ("svv", F.col("v") ** 2), ("suv", F.col("u") * F.col("v")), ("sz", F.col("z")), ("suz", F.col("u") * F.col("z")), ("svz", F.col("v") * F.col("z")))])
    m = [[F.col("suu") * 4, F.col("suv") * 4, F.col("su") * 2], [F.col("suv") * 4, F.col("svv") * 4, F.col("sv") * 2], [F.col("su") * 2, F.col("sv") * 2, F.col("n").cast("double")]]
    rhs = [F.col("suz") * 2, F.col("svz") * 2, F.col("sz")]

    def det(a):
        return a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])

    d = det(m)
    cu, cv, c = (F.try_divide(det([[rhs[r] if k == i else m[r][k] for k in range(3)] for r in range(3)]), d) for i in range(3))
    centre = s.select(key, "n", cu.alias("cu"), cv.alias("cv"), c.alias("c")).withColumn("radius", F.sqrt(F.col("c") + F.col("cu") ** 2 + F.col("cv") ** 2))
    j = q.join(centre, key)
    off = F.sqrt((F.col("u") - F.col("cu")) ** 2 + (F.col("v") - F.col("cv")) ** 2) - F.col("radius")
    r = j.groupBy(key).agg(F.sum(off**2).alias("res"), F.var_pop(F.sqrt("z")).alias("var"))
    out = centre.join(r, key)
    ok = F.col("n") >= 3
    return out.select(key, "n", *[F.when(ok, F.col(x)).otherwise(0.0).alias(x) for x in ("cu", "cv", "radius")], F.when(ok, F.lit(1.0) - F.col("res") / (F.col("var") * F.col("n") + 1e-10)).otherwise(0.0).alias("r2"))


def radius_trends(points: DataFrame, key: str, position: str, radius: str) -> DataFrame:
    """Slope of radius over position, coefficient of variation, and the radii at either end."""
    at = F.struct(position, "id")
    return points.groupBy(key).agg(F.regr_slope(radius, position).alias("slope"), (F.stddev_pop(radius) / (F.avg(radius) + 1e-10)).alias("cv"), F.min_by(radius, at).alias("r_first"), F.max_by(radius, at).alias("r_last"))


def axis_box(points: DataFrame, key: str, axes: Sequence[Vec]) -> DataFrame:
    """Half extents h0..h2 of each group along axes."""
    from ..functions.vectors import dot

    p = vec("x0", "x1", "x2")
    return points.groupBy(key).agg(*[((F.max(dot(p, a)) - F.min(dot(p, a))) / 2).alias(f"h{i}") for i, a in enumerate(axes)])
