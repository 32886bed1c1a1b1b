"""Composite pipelines (C1, C2, C4, C5, C6): from a mesh to an implicit equation. Configurations are frozen dataclasses."""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import harmonics, poly
from ..functions.vectors import Vec, vec
from ..operators import fit, gaussian, greedy, mesh, network, sampling, segment
from ..operators.storage import stored

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Equation:
    """A polynomial with its error; callable on points, with gradient and normal."""

    terms: poly.Terms
    rmse: float = float("nan")

    @property
    def degree(self) -> int:
        return poly.degree_of(self.terms)

    def value(self, points: DataFrame, out: str = "value") -> DataFrame:
        return points.withColumn(out, poly.evaluate(vec("x0", "x1", "x2"), self.terms))

    def gradient(self, points: DataFrame) -> DataFrame:
        g = poly.gradient(vec("x0", "x1", "x2"), self.terms)
        return points.select("*", *[c.alias(f"g{i}") for i, c in enumerate(g)])

    def normal(self, points: DataFrame) -> DataFrame:
        n = poly.normal(vec("x0", "x1", "x2"), self.terms)
        return points.select("*", *[c.alias(f"n{i}") for i, c in enumerate(n)])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.atleast_2d(x)
        return sum((c * (x ** np.array(e)).prod(1) for e, c in self.terms.items()), np.zeros(len(x)))

    def __repr__(self) -> str:
        return f"Equation(degree={self.degree}, terms={len(self.terms)}, rmse={self.rmse:.3g})"


class Backend(Protocol):
    """M7: what fits one equation to each patch's samples. A backend may ignore what it has no use for."""

    def fit_patches(self, samples: DataFrame, config: PatchConfig) -> DataFrame:
        """pid, alphas (world frame, in feature order of config.degree), rmse of samples(pid, x0..x2, y)."""
        ...


class PolynomialBackend:
    """The default: a Gaussian process on each patch, and a polynomial fitted to its mean on a grid."""

    def fit_patches(self, samples: DataFrame, config: PatchConfig) -> DataFrame:
        return leaf_equations(samples, config)


@dataclass(frozen=True)
class PatchConfig:
    """C1e."""

    n_seeds: int | None = None
    degree: int = 4
    budget: int = 300
    resolution: int = 10
    strategy: str = "radius"
    merge: str = "polynomial"
    least_overlap: int = 5
    seed: int = 42
    blend_sigma: float | None = None  # of E8; the patches' radius where none is given
    backend: Backend = field(default_factory=lambda: PolynomialBackend())


def leaf_equations(samples: DataFrame, config: PatchConfig) -> DataFrame:
    """Pid, alphas (world frame, in feature order), rmse for samples(pid, x0..x2, y): per patch a Gaussian process, its mean on
    a grid over the patch (S5), and a polynomial fitted to that. A patch of more samples than a process takes has one for each of its cells,
    and the grid asks that of the cell it lies in; error and bounds are partial aggregates.
    """
    powers = np.array(poly.exponents(config.degree))
    s = stored(samples.select(F.col("pid").cast("long").alias("pid"), "x0", "x1", "x2", "y"))
    axes = ("x0", "x1", "x2")
    box = s.groupBy("pid").agg(*[f(x).alias(f"{n}{i}") for n, f in (("lo", F.min), ("hi", F.max)) for i, x in enumerate(axes)])
    n = config.resolution
    # as np.linspace has it: lo + k * step, and the end itself
    at = lambda i, k: F.when(k == n - 1, F.col(f"b{i}")).otherwise(F.col(f"a{i}") + k * ((F.col(f"b{i}") - F.col(f"a{i}")) / max(1, n - 1)))
    pad = [F.lit(0.1) * (F.col(f"hi{i}") - F.col(f"lo{i}")) for i in range(3)]
    wide = box.select("pid", *[(F.col(f"lo{i}") - pad[i]).alias(f"a{i}") for i in range(3)], *[(F.col(f"hi{i}") + pad[i]).alias(f"b{i}") for i in range(3)])
    g = wide.select("*", F.explode(F.sequence(F.lit(0), F.lit(n**3 - 1))).alias("g"))
    k = (F.expr(f"g div {n * n}"), F.expr(f"g div {n} % {n}"), F.expr(f"g % {n}"))
    grid = g.select("pid", F.col("g").cast("long").alias("pt_id"), *[at(i, k[i]).alias(f"x{i}") for i in range(3)])
    values = gaussian.predict_patches(gaussian.fit_patches(s), grid)

    def run(key: tuple[int], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pt_id")
        q, v = pdf[list(axes)].to_numpy(), pdf.y.to_numpy()
        c, size = q.mean(0), max(1e-10, np.abs(q - q.mean(0)).max())
        phi = (((q - c) / size)[:, None, :] ** powers[None]).prod(2)
        a = np.linalg.lstsq(phi.T @ phi + 1e-8 * np.eye(len(powers)), phi.T @ v, rcond=None)[0]
        world = poly.to_coefficients(poly.denormalize(poly.from_coefficients(a, config.degree), c.tolist(), float(size)), config.degree)
        return pd.DataFrame([{"pid": key[0], "alphas": world.tolist()}])

    fitted = stored(values.groupBy("pid").applyInPandas(run, "pid long, alphas array<double>"))
    mono = lambda e: math.prod([F.col(x) for x, m in zip(axes, e) for _ in range(m)], start=F.lit(1.0))
    off = sum((F.col("alphas")[i] * mono(e) for i, e in enumerate(powers.tolist())), F.lit(0.0)) - F.col("y")
    rmse = s.join(fitted, "pid").groupBy("pid").agg(F.sqrt(F.avg(off * off)).alias("rmse"))
    return fitted.join(rmse, "pid").select("pid", "alphas", "rmse")


def leaf_samples(vertices: DataFrame, faces: DataFrame, patch: DataFrame, config: PatchConfig) -> DataFrame:
    """R4 for every patch at once: pid, pt_id, kind, x0..x2, y. Vertices of a patch with area-weighted normals, offset by
    the patch's epsilon (A1) and subsampled by stratum (R3).
    """
    geometry = mesh.face_geometry(vertices, faces)
    normals = mesh.vertex_normals(geometry).drop("mesh_id")
    p = patch.select(F.col("pid").cast("long").alias("pid"), "vid").join(vertices.drop("mesh_id"), "vid").join(normals, "vid")
    eps = mesh.bounds(p, "pid").select("pid", "epsilon")
    on = p.join(eps, "pid").withColumn("pt_id", F.col("vid"))
    layers = F.array(*[F.struct(F.lit(k).alias("kind"), (F.col("epsilon") * s).alias("y")) for k, s in (("on", 0.0), ("outside", 1.0), ("inside", -1.0))])
    e = on.withColumn("layer", F.explode(layers)).select("pid", "pt_id", F.col("layer.kind").alias("kind"), *[(F.col(f"x{i}") + F.col("layer.y") * F.col(f"n{i}")).alias(f"x{i}") for i in range(3)], F.col("layer.y").alias("y"))
    from pyspark.sql import Window

    w = Window.partitionBy("pid", "kind").orderBy(F.xxhash64(F.lit(config.seed), "pt_id", "kind"), "pt_id")
    return e.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= config.budget // 3).drop("_n")


@dataclass(frozen=True)
class Node:
    """C1f: a part of the merge tree: its equation, its patches, and the middle and the bounds of their samples."""

    equation: Equation
    patches: frozenset[int]
    centroid: tuple[float, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    rows: int

    def united(self, other: Node, equation: Equation) -> Node:
        n = self.rows + other.rows
        middle = tuple((a * self.rows + b * other.rows) / n for a, b in zip(self.centroid, other.centroid))
        return Node(equation, self.patches | other.patches, middle, tuple(map(min, self.low, other.low)), tuple(map(max, self.high, other.high)), n)


def _value(x: np.ndarray, terms: poly.Terms) -> np.ndarray:
    if not terms:
        return np.zeros(len(x))
    return fit.monomials(x, np.array(list(terms))) @ np.array(list(terms.values()))


def merge_nodes(samples: DataFrame, overlap: DataFrame, pairs: dict[int, tuple[Node, Node]], config: PatchConfig, sigma: float) -> dict[int, Node]:
    """C1d: one level of merges, whatever the number of pairs: each step is one job over all pairs' rows, whose sums are grouped by pair.

    samples(pid, pt_id, x0..x2, y); overlap(i, j, vid). The blend of a pair (E7: a weight polynomial fitted to the rows in the
    overlap, E8: weights by the distances to both middles) is projected on polynomials of the configured degree by least squares over all rows of
    both. E10 and F11 follow from the same sums: a blend in error is corrected by a fit to its residual, or its constants are refitted unless one exceeds the limit.
    """
    spark = samples.sparkSession
    side = spark.createDataFrame([(p, g) for g, ns in pairs.items() for n in ns for p in sorted(n.patches)], "pid long, pair long")  # a row a patch
    rows = stored(samples.join(F.broadcast(side), "pid").select("pair", "pt_id", "x0", "x1", "x2", "y"))
    terms = {g: (a.equation.terms, b.equation.terms) for g, (a, b) in pairs.items()}
    middle = {g: (np.array(a.centroid), np.array(b.centroid)) for g, (a, b) in pairs.items()}
    center, scale = {}, {}
    for g, (a, b) in pairs.items():
        low, high = np.minimum(a.low, b.low), np.maximum(a.high, b.high)
        center[g], scale[g] = (low + high) / 2, float(max(1e-10, (high - low).max() / 2))
    powers, second = np.array(poly.exponents(config.degree)), np.array(poly.exponents(2))
    by_pair = lambda df: df.select("x0", "x1", "x2", "y", F.col("pair").cast("double"))

    def each(x: np.ndarray):
        for g in np.unique(x[:, 4]).astype(int).tolist():
            own = x[x[:, 4] == g]
            p = own[:, :3]
            yield g, p, (p - center[g]) / scale[g], own[:, 3], _value(p, terms[g][0]), _value(p, terms[g][1])

    weight: dict[int, np.ndarray] = {}
    weighted = config.merge == "polynomial"  # tasks get no configuration: a backend need not travel
    if weighted:
        a = side.select(F.col("pid").alias("i"), F.col("pair").alias("pair"))
        b = side.select(F.col("pid").alias("j"), F.col("pair").alias("pair"))
        shared = overlap.join(F.broadcast(a), "i").join(F.broadcast(b), ["j", "pair"]).select("pair", F.col("vid").alias("pt_id")).distinct()
        both = stored(rows.join(shared, ["pair", "pt_id"], "left_semi"))

        def sizes(x: np.ndarray):
            for g, _, _, _, fa, fb in each(x):
                yield g, np.array([[fa @ fa, fb @ fb]]), len(fa)

        sums = fit.summed(by_pair(both), 2, sizes)
        unit = {g: np.sqrt(m[0] / max(1, n)) + 1e-10 for g, (m, n) in sums.items()}

        def weights(x: np.ndarray):
            for g, _, q, y, fa, fb in each(x):
                sa, sb = unit[g]
                d = fb / sb - fa / sa
                use = (np.abs(fb - fa) > 1e-10) & (np.abs(d) > 1e-12)
                z = np.column_stack([fit.monomials(q[use], second), (y[use] / ((sa + sb) / 2) - fa[use] / sa) / d[use]])
                yield g, z.T @ z, int(use.sum())

        for g, (m, n) in fit.summed(by_pair(both), len(second) + 1, weights).items():
            if n >= 10:
                # the bias isn't penalised: centred sums leave it out
                h, r = m[:-1, :-1], m[:-1, -1]
                mean, centre = h[0] / n, r[0] / n
                slope = fit.least_squares(h[1:, 1:] - n * np.outer(mean[1:], mean[1:]), r[1:] - n * mean[1:] * centre, 1e-3)
                weight[g] = np.array([centre - mean[1:] @ slope, *slope])

    def blended(x: np.ndarray):
        for g, p, q, y, fa, fb in each(x):
            if weighted:
                w = fit.monomials(q, second) @ weight[g] if g in weight else 0.0  # without an overlap the first equation stands, until its residual is fitted
            else:
                da, db = (((p - c) ** 2).sum(1) for c in middle[g])
                w = 1 - 1 / (np.exp(np.clip((da - db) / (sigma * sigma), -700, 700)) + 1)
            z = np.column_stack([fit.monomials(q, powers), (1 - w) * fa + w * fb, y])
            yield g, z.T @ z, len(z)

    out = {}
    for g, (m, n) in fit.summed(by_pair(rows), len(powers) + 2, blended).items():
        a, b = pairs[g]
        alphas, error = corrected(m[:-2, :-2], m[:-2, -2], m[:-2, -1], float(m[-1, -1]), n)
        world = poly.denormalize(poly.from_coefficients(alphas, config.degree), center[g].tolist(), scale[g])
        out[g] = a.united(b, Equation(world, error))
    return out


def corrected(g: np.ndarray, blend_b: np.ndarray, y_b: np.ndarray, yy: float, n: int, done: float = 1e-4, near: float = 1e-3, limit: float = 20.0) -> tuple[np.ndarray, float]:
    """E10 with F11 from sums alone: the best of the blend, its refit, and the blend with an equation fitted to its residual; and the error."""
    error = lambda a: fit.loss(g, y_b, yy, n, a)
    alphas = fit.least_squares(g, blend_b)
    tried = [alphas]
    if error(alphas) >= done:
        if error(alphas) >= near:
            alphas = alphas + fit.least_squares(g, y_b - g @ alphas, 1e-8 * max(1.0, float(np.trace(g)) / len(g)))
            tried.append(alphas)
        if np.abs(alphas).max(initial=0) <= limit:
            tried.append(fit.refit_support(g, y_b, alphas))
    best = min(tried, key=error)
    return best, error(best)


def compile_mesh(vertices: DataFrame, faces: DataFrame, config: PatchConfig = PatchConfig()) -> tuple[Equation, list]:
    """Segment (G13), fit patches, merge pairs by overlap (G5, G6) with blending (E7 or E8) and residual correction (E10), to one equation.

    Also returns the merges, level by level. Nodes that overlap nothing are paired last, the largest with the next, so that every patch counts.
    """
    if config.merge not in ("polynomial", "partition_of_unity"):
        raise ValueError(f"unknown merge: {config.merge}")
    parts = segment.segment_mesh(vertices, faces, config.n_seeds, config.strategy)
    samples = stored(leaf_samples(vertices, faces, parts["patch"], config))
    leaves = config.backend.fit_patches(samples, config).collect()  # one row a patch
    shape = {r.pid: r for r in samples.groupBy("pid").agg(F.count("*").alias("n"), *[f(f"x{i}").alias(f"{k}{i}") for i in range(3) for k, f in (("m", F.avg), ("l", F.min), ("h", F.max))]).collect()}
    nodes = {}
    for r in leaves:
        s = shape[r.pid]
        nodes[r.pid] = Node(Equation(poly.from_coefficients(r.alphas, config.degree), r.rmse), frozenset([r.pid]), *(tuple(s[f"{k}{i}"] for i in range(3)) for k in "mlh"), s.n)
    sigma = config.blend_sigma or parts.get("radius") or 1.0
    spark = vertices.sparkSession
    table = stored(spark.createDataFrame([(p, [p]) for p in nodes], "node_id long, patch_ids array<long>"))
    overlap = stored(parts["adjacency"].where(F.col("n") >= config.least_overlap).select("i", "j", F.explode("overlap").alias("vid")))
    merges: list = []
    while len(nodes) > 1:
        pairs, after = greedy.merge_level(table, overlap)
        found = sorted((r.a, r.b, r.n) for r in pairs.collect())  # half as many as nodes
        if found:
            table = after
        else:
            order = sorted(nodes, key=lambda k: (-nodes[k].rows, k))
            found = [(*sorted(two), 0) for two in zip(order[::2], order[1::2])]
            lower = {b: a for a, b, _ in found}
            table = stored(table.withColumn("node_id", F.coalesce(*[F.when(F.col("node_id") == b, F.lit(a)) for b, a in lower.items()], F.col("node_id"))).groupBy("node_id").agg(F.flatten(F.collect_list("patch_ids")).alias("patch_ids")))
        merged = merge_nodes(samples, overlap, {a: (nodes[a], nodes[b]) for a, b, _ in found}, config, sigma)
        for a, b, _ in found:
            nodes[a] = merged[a]
            del nodes[b]
        merges.append(found)
    return next(iter(nodes.values())).equation, merges


@dataclass(frozen=True)
class BalloonConfig:
    """C2b."""

    n_surface: int = 10_000
    n_volume: int = 2_000
    epsilon: float = 0.01
    first_degree: int = 2
    last_degree: int = 20
    step: int = 2
    threshold: float = 1e-2
    patience: int = 3
    newton_steps: int = 30
    sign_weight: float = 1.0
    curvature_weight: float = 0.0
    seed: int = 42


def fitted(samples: DataFrame, design: fit.Design, y: Column, sums: tuple, start: np.ndarray, config, degree: int | None = None, target: str | None = None, again: bool = False) -> tuple[float, np.ndarray]:
    """The minimum of the surface and sign loss that lies nearest the least squares fit on start's support, or nearest start itself (again), scaled to
    distances; and its root mean square error, which is no less than that of least squares. Without steps, least squares alone.
    """
    g, b, yy, n = sums
    plain = start if again else fit.refit_support(g, b, np.where(np.abs(start) > 0, start, 1e-12))
    if not config.newton_steps:
        return fit.loss(g, b, yy, n, plain), plain
    curved = getattr(config, "curvature_weight", 0.0) if target else 0.0
    ridge = 1e-4 / degree**2 if degree else 1e-5
    hinge, _ = fit.sign_hinge_fit(samples.withColumn("y", y), design, plain, config.newton_steps, 1.0, config.sign_weight, ridge, curved, target, degree)
    size = float(hinge @ g @ hinge)
    hinge = hinge * (float(hinge @ b) / size if size > 0 and hinge @ b > 0 else 1.0)
    return fit.loss(g, b, yy, n, hinge), hinge


def compile_balloon(vertices: DataFrame, faces: DataFrame, config: BalloonConfig = BalloonConfig()) -> Equation:
    """One polynomial for the whole mesh, from a sphere (M10), raising the degree while the error stays above the threshold.

    Each degree is fitted by least squares and refined by the surface and sign loss (M12), with the curvature term (J10) where it has a weight.
    Coefficients of a lower degree come first in a higher one, so each degree starts from the one before it (M11). A degree is refined in rounds until
    ``patience`` of them in a row lower the error by under a hundredth, or one leaves the coefficients as they are; then the degree is raised. The threshold
    or the last degree ends the search, and the best of all rounds is returned.
    """
    samples = stored(sampling.sample_field(vertices, faces, config.n_surface, config.epsilon, config.n_volume, config.seed))
    frame = sampling.normalize_points(samples).select("c0", "c1", "c2", "scale").first()
    center, scale = [frame.c0, frame.c1, frame.c2], frame.scale
    p = tuple((F.col(f"x{i}") - center[i]) / scale for i in range(3))
    target = None
    if config.curvature_weight:
        geometry = mesh.face_geometry(vertices, faces)
        bent = segment.vertex_curvature(geometry, vertices).join(vertices.drop("mesh_id"), "vid")
        on = fit.nearest_curvature(samples.where("kind = 'on'"), bent, "mean").withColumn("kind", F.lit("on"))
        samples, target = stored(samples.join(on, ["pt_id", "kind"], "left")), "target"
    mean_r = samples.where("kind = 'on'").agg(F.avg(F.sqrt(p[0] ** 2 + p[1] ** 2 + p[2] ** 2)).alias("r")).first().r
    degree = config.first_degree
    alphas = poly.to_coefficients(poly.sphere_terms(2, mean_r), degree)
    best: tuple[float, np.ndarray, int] | None = None
    while True:
        design, y = fit.Design.polynomial(p, degree), F.col("y") / scale
        sums, flat, level = fit.gram(samples, design, y), 0, np.inf if best is None else best[0]
        before = None
        while flat < max(1, config.patience):
            error, alphas = fitted(samples, design, y, sums, alphas, config, degree, target, again=before is not None)
            log.info("balloon: degree %d, error %.5f", degree, error)
            if best is None or error < best[0]:
                best = (error, alphas, degree)
            same = before is not None and np.allclose(alphas, before, rtol=1e-6, atol=1e-9)
            if error < config.threshold or same or not config.newton_steps:
                break
            flat = 0 if error < 0.99 * level else flat + 1
            level, before = min(level, error), alphas
        if error < config.threshold or degree + config.step > config.last_degree:
            break
        alphas = poly.expand(alphas, degree, degree + config.step)
        degree += config.step
    error, alphas, degree = best
    return Equation(poly.denormalize(poly.from_coefficients(alphas * scale, degree), center, scale), error * scale)


@dataclass(frozen=True)
class HybridConfig:
    """C4b."""

    n_surface: int = 20_000
    n_volume: int = 2_000
    epsilon: float = 0.05
    degree: int = 6
    l_max: int = 4
    r_max: int = 2
    last_l: int = 12
    last_r: int = 5
    step: int = 2
    most_features: int = 40
    last_features: int = 150
    features_step: int = 20
    threshold: float = 0.01
    patience: int = 3
    newton_steps: int = 30
    sign_weight: float = 1.0
    seed: int = 42


def _hybrid(p: Vec, names: list[str]) -> fit.Design:
    return fit.Design(tuple(p), len(names), lambda x: harmonics.hybrid_matrix(x, names))


def compile_hybrid(vertices: DataFrame, faces: DataFrame, config: HybridConfig = HybridConfig()) -> dict:
    """C4: monomials and spherical harmonics (P15), the few that matter by matching pursuit (M9), refined by the surface and sign loss.

    Bands, radial degrees and the number of features grow while the error stays above the threshold. {"coefficients" by name, "center", "scale",
    "rmse"} in the normalised frame.
    """
    samples = stored(sampling.sample_field(vertices, faces, config.n_surface, config.epsilon, config.n_volume, config.seed))
    frame = sampling.normalize_points(samples).select("c0", "c1", "c2", "scale").first()
    center, scale = [frame.c0, frame.c1, frame.c2], frame.scale
    p = tuple((F.col(f"x{i}") - center[i]) / scale for i in range(3))
    l_max, r_max, most, flat = config.l_max, config.r_max, config.most_features, 0
    best: tuple[float, dict] | None = None
    while True:
        names = harmonics.hybrid_names(config.degree, l_max, r_max)
        y = F.col("y")
        sums = fit.gram(samples, _hybrid(p, names), y)
        on = np.flatnonzero(fit.orthogonal_matching(sums[0], sums[1], most))
        few = (sums[0][np.ix_(on, on)], sums[1][on], *sums[2:])
        error, alphas = fitted(samples, _hybrid(p, [names[i] for i in on]), y, few, np.ones(len(on)), config)
        log.info("hybrid: bands %d, features %d, error %.5f", l_max, len(on), error)
        flat = 0 if best is None or error < 0.99 * best[0] else flat + 1
        if best is None or error < best[0]:
            best = (error, {names[i]: float(a) for i, a in zip(on.tolist(), alphas) if a})
        grown = min(l_max + config.step, config.last_l), min(r_max + 1, config.last_r), min(most + config.features_step, config.last_features)
        if error < config.threshold or flat >= config.patience or grown == (l_max, r_max, most):
            break
        l_max, r_max, most = grown
    error, found = best
    return {"coefficients": found, "center": center, "scale": scale, "rmse": error}


@dataclass(frozen=True)
class NetworkConfig:
    """C5b."""

    n_surface: int = 3_000
    n_volume: int = 1_000
    epsilon: float = 0.02
    hidden: int = 32
    layers: int = 2
    activation: str = "tanh"
    steps: int = 400
    batch: int = 2048
    seed: int = 42


def compile_network(vertices: DataFrame, faces: DataFrame, config: NetworkConfig = NetworkConfig()) -> dict:
    """A small network fitted to samples of the mesh, derivatives summed over their partitions, to be evaluated over any number of points by network.predict."""
    samples = stored(sampling.sample_field(vertices, faces, config.n_surface, config.epsilon, config.n_volume, config.seed))
    frame = sampling.normalize_points(samples).select("c0", "c1", "c2", "scale").first()
    center, scale = [frame.c0, frame.c1, frame.c2], frame.scale
    unit = samples.select(*[((F.col(f"x{i}") - center[i]) / scale).alias(f"x{i}") for i in range(3)], "y")
    radius = unit.where("y = 0").agg(F.avg(F.sqrt(F.expr("x0 * x0 + x1 * x1 + x2 * x2"))).alias("r")).first().r
    start = network.initial(config.hidden, config.layers, config.activation, config.seed)
    start = network.as_sphere(start, radius or 0.5, config.activation)
    layers, losses = network.train(unit, start, config.activation, config.steps, batch=config.batch)
    return {"layers": layers, "activation": config.activation, "center": center, "scale": scale, "losses": losses}


@dataclass(frozen=True)
class RegressorConfig:
    """C6b."""

    model: str = "rf"
    params: dict = field(default_factory=dict)
    n_surface: int = 3_000
    n_volume: int = 1_000
    epsilon: float = 0.02
    seed: int = 42


def compile_regressor(vertices: DataFrame, faces: DataFrame, config: RegressorConfig = RegressorConfig()):
    """A fitted regressor of the field over world coordinates."""
    samples = stored(sampling.sample_field(vertices, faces, config.n_surface, config.epsilon, config.n_volume, config.seed))
    return network.make_model(config.model, config.params).fit(network.assembled(samples))
