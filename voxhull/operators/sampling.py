"""Sampling (P23, P24, R1 to R7, S5 draws): every draw is a hash of seed and row number, so runs and retries agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import clip, hashed_uniform, named, unit, vec

X = ("x0", "x1", "x2")


def normalize_points(points: DataFrame) -> DataFrame:
    """Points moved to their mean and divided by the largest absolute coordinate (1 if under 1e-10); with c0..c2, scale.

    One aggregate gives mean, least and most, from which the largest distance to the mean on an axis follows.
    """
    s = points.agg(*[F.avg(x).alias(f"c{i}") for i, x in enumerate(X)], *[F.min(x).alias(f"lo{i}") for i, x in enumerate(X)], *[F.max(x).alias(f"hi{i}") for i, x in enumerate(X)])
    far = F.greatest(*[F.col(f"hi{i}") - F.col(f"c{i}") for i in range(3)], *[F.col(f"c{i}") - F.col(f"lo{i}") for i in range(3)])
    s = s.select("c0", "c1", "c2", F.when(far < 1e-10, 1.0).otherwise(far).alias("scale"))
    j = points.join(F.broadcast(s), F.lit(True))  # one row
    return j.select(*[c for c in points.columns if c not in X], *[((F.col(x) - F.col(f"c{i}")) / F.col("scale")).alias(x) for i, x in enumerate(X)], "c0", "c1", "c2", "scale")


def offset_layers(points: DataFrame, epsilon: float | Column, key: str = "pt_id") -> DataFrame:
    """Each point on the surface (y 0), and moved by plus and minus epsilon along its normal n0..n2 (y plus, minus epsilon)."""
    e = epsilon if isinstance(epsilon, Column) else F.lit(float(epsilon))
    layers = F.array(*[F.struct(F.lit(k).alias("kind"), (e * s).alias("y")) for k, s in (("on", 0.0), ("outside", 1.0), ("inside", -1.0))])
    j = points.withColumn("layer", F.explode(layers))
    return j.select(key, F.col("layer.kind").alias("kind"), *[(F.col(x) + F.col("layer.y") * F.col(f"n{i}")).alias(x) for i, x in enumerate(X)], F.col("layer.y").alias("y"))


def training_data(points: DataFrame, epsilon: float, vertices: DataFrame | None = None) -> DataFrame:
    """The layers, and vertices on the surface too where given."""
    out = offset_layers(points, epsilon)
    if vertices is not None:
        out = vertices.select(F.col("vid").alias("pt_id"), F.lit("on").alias("kind"), *X, F.lit(0.0).alias("y")).unionByName(out)
    return out


def stratified(rows: DataFrame, budget: int, stratum: str = "kind", key: str = "pt_id", seed: int = 0, draw: Column | None = None) -> DataFrame:
    """At most budget // 3 rows of each stratum, those of least ``draw``, a hash of key and seed. The bound is the operator's feature."""
    w = Window.partitionBy(stratum).orderBy(hashed_uniform(F.col(key), F.col(stratum), seed=seed) if draw is None else draw, key)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= budget // 3).drop("_n")


def cumulative(weighted: DataFrame, weight: str, key: str, parts: int = 64) -> DataFrame:
    """lo, hi of each row's share on the axis of summed weights, in the order of key; without gathering rows in one task.

    Rows are dealt into ranges of key; a range's sums go before those of later ones, and only the ranges' totals meet.
    """
    dealt = weighted.repartitionByRange(parts, key).withColumn("part", F.spark_partition_id())
    w = Window.partitionBy("part").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    inside = dealt.withColumn("hi", F.sum(weight).over(w)).persist()
    totals = inside.groupBy("part").agg(F.max("hi").alias("t"))
    before = totals.withColumn("before", F.coalesce(F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    j = inside.join(F.broadcast(before.select("part", "before")), "part")  # a row for each range
    return j.withColumn("hi", F.col("hi") + F.col("before")).withColumn("lo", F.col("hi") - F.col(weight)).drop("part", "before")


def weighted_draws(spark: SparkSession, weighted: DataFrame, weight: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """N draws (draw, key) with chances in proportion to weight.

    Draws and rows meet by bucket of the cumulative axis: a row reaches the buckets it covers, a draw is in one.
    """
    axis = cumulative(weighted, weight, key)
    total = axis.agg(F.max("hi").alias("t")).first().t
    if not total:
        return weighted.select(F.lit(0).cast("long").alias("draw"), key).limit(0)
    step = total / max(1, n)
    draws = spark.range(n).select(F.col("id").alias("draw"), (hashed_uniform(F.col("id"), seed=seed) * total).alias("at")).withColumn("bucket", F.floor(F.col("at") / step))
    reach = axis.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / step), F.floor(F.col("hi") / step))))
    return draws.join(reach, "bucket").where((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))).select("draw", key)


def sample_surface(geometry: DataFrame, n: int, seed: int = 42, vertex_normals: DataFrame | None = None) -> DataFrame:
    """N points pt_id, x0..x2, n0..n2 on faces of one mesh, uniform by area; normals of the face, or interpolated and of length 1."""
    spark = geometry.sparkSession
    j = weighted_draws(spark, geometry.select("fid", "area"), "area", "fid", n, seed).join(geometry, "fid")
    r1, r2 = F.sqrt(hashed_uniform(F.col("draw"), seed=seed + 1)), hashed_uniform(F.col("draw"), seed=seed + 2)
    weights = (F.lit(1.0) - r1, r1 * (F.lit(1.0) - r2), r1 * r2)
    j = j.select("*", *[w.alias(f"w{k}") for k, w in enumerate(weights)])
    at = [sum((F.col(f"w{k}") * F.col(f"{p}{i}") for k, p in enumerate("abc")), F.lit(0.0)).alias(f"x{i}") for i in range(3)]
    if vertex_normals is None:
        return j.select(F.col("draw").alias("pt_id"), "fid", *at, "n0", "n1", "n2")
    vn = vertex_normals.select(F.col("vid").alias("at_vid"), *[F.col(f"n{i}").alias(f"m{i}") for i in range(3)])
    slots = F.array(*[F.struct(F.col(f"v{k}").alias("vid"), F.col(f"w{k}").alias("w")) for k in range(3)])
    parts = j.select("draw", F.explode(slots).alias("s")).join(vn, F.col("s.vid") == F.col("at_vid"))
    mixed = parts.groupBy("draw").agg(*[F.sum(F.col("s.w") * F.col(f"m{i}")).alias(f"m{i}") for i in range(3)])
    return j.select("draw", "fid", *at).join(mixed, "draw").select(F.col("draw").alias("pt_id"), "fid", *X, *named(unit(vec("m0", "m1", "m2"), 1e-300), ("n0", "n1", "n2")))


def random_in_bounds(spark: SparkSession, bounds: DataFrame, n: int, grow: float = 1.05, seed: int = 42) -> DataFrame:
    """R5's draws: n points, uniform in bounds grown about their middle."""
    out = [F.col("id").alias("id")]
    for i in range(3):
        lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        out.append(((lo + hi) / 2 + (hi - lo) * grow * (hashed_uniform(F.col("id"), seed=seed + i) - 0.5)).alias(f"x{i}"))
    return spark.range(n).join(F.broadcast(bounds), F.lit(True)).select(*out)  # one row


def sample_field(vertices: DataFrame, faces: DataFrame, n_surface: int = 10_000, epsilon: float = 0.01, n_volume: int = 10_000, seed: int = 42) -> DataFrame:
    """R2: pt_id, kind, x0..x2, y: surface points, both offsets, and points in the bounds times 1.2 with their distance to the
    mesh, clipped to 5 epsilon either way, negative inside.
    """
    from . import mesh, rays

    geometry = mesh.face_geometry(vertices, faces).persist()
    layers = offset_layers(sample_surface(geometry, n_surface, seed), epsilon)
    b = mesh.bounds(vertices)
    box = random_in_bounds(vertices.sparkSession, b, n_volume, 1.2, seed + 10)
    d = rays.signed_distance(box, geometry)
    volume = box.join(d, "id").select(F.col("id").alias("pt_id"), F.lit("volume").alias("kind"), *X, clip(F.col("distance"), -5 * epsilon, 5 * epsilon).alias("y"))
    return layers.unionByName(volume)


def sign_subset(samples: DataFrame, n_surface: int = 2000, n_sign: int = 6000, sentinel: float = 1e6, seed: int = 0) -> DataFrame:
    """Surface rows labelled with a sentinel, and sign rows with -1 or 1, each set those of least hash."""
    draw = hashed_uniform(F.col("pt_id"), F.col("kind"), seed=seed)
    on = samples.where("y = 0").orderBy(draw, "pt_id").limit(n_surface).withColumn("y", F.lit(sentinel))
    off = samples.where("y <> 0").orderBy(draw, "pt_id", "kind").limit(n_sign).withColumn("y", F.signum("y"))
    return on.unionByName(off)


def patch_samples(vertices: DataFrame, faces: DataFrame, patch: DataFrame, pid: int, budget: int = 300, seed: int = 42) -> DataFrame:
    """The labelled samples of one patch(pid, vid): A2's number of surface points, offsets by A1's epsilon, a stratified subset.

    The patch's vertices count as surface points if they are at most a third of the budget.
    """
    from . import mesh

    own = patch.where(F.col("pid") == pid)
    mine = vertices.join(own.select("vid"), "vid", "left_semi")
    geometry = mesh.face_geometry(vertices, faces.join(mesh.patch_faces(faces, own).select("fid"), "fid", "left_semi")).persist()
    facts = geometry.agg(F.sum("area").alias("area")).select(mesh.sample_count(F.col("area")).alias("n")).first()
    epsilon = mesh.bounds(mine).first().epsilon
    points = sample_surface(geometry, facts.n or 0, seed, mesh.vertex_normals(geometry))
    few = mine.count() <= budget // 3
    return stratified(training_data(points, epsilon, mine if few else None), budget, seed=seed)
