"""Spatial joins on a grid of cells.

A point's cell is an equi-join key, so near points meet by a shuffle on cells, never by all pairs. k nearest neighbours
search grids from fine to coarse, and only points whose k-th neighbour might lie outside the searched cells go on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import norm, sub, vec
from .storage import stored

X = ("x0", "x1", "x2")


def cell(size: Column | float, names=X) -> list[Column]:
    return [F.floor(F.col(n) / size).cast("long").alias(f"k{i}") for i, n in enumerate(names)]


def _around(name: str, ring: int, lo: int | None = None, hi: int | None = None) -> Column:
    """The cell numbers up to ring away; those from lo to hi alone, if these are given."""
    first, last = F.col(name) - ring, F.col(name) + ring
    if lo is None:
        return F.sequence(first, last)
    first, last = F.greatest(first, F.lit(lo)), F.least(last, F.lit(hi))
    return F.when(first <= last, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<bigint>"))


def radius_join(left: DataFrame, right: DataFrame, radius: float, left_id: str = "id", right_id: str = "nid") -> DataFrame:
    """(left_id, right_id, d) for points at most radius apart, inclusive. Cells are radius wide, so 27 of them do."""
    a = left.select(F.col(left_id), *[F.col(x).alias(f"a{i}") for i, x in enumerate(X)], *cell(radius))
    for i in range(3):
        a = a.withColumn(f"k{i}", F.explode(_around(f"k{i}", 1)))
    b = right.select(F.col(right_id), *[F.col(x).alias(f"b{i}") for i, x in enumerate(X)], *cell(radius))
    d = norm(sub(vec("a0", "a1", "a2"), vec("b0", "b1", "b2")))
    return a.join(b, ["k0", "k1", "k2"]).select(left_id, right_id, d.alias("d")).where(F.col("d") <= radius)


def outside(at: tuple[str, ...], low: list[float], high: list[float]) -> Column:
    """The square of a point's distance to a box; 0 within it."""
    by = [F.greatest(F.lit(0.0), F.lit(lo) - F.col(n), F.col(n) - F.lit(hi)) for n, lo, hi in zip(at, low, high)]
    return by[0] * by[0] + by[1] * by[1] + by[2] * by[2]


def in_reach(points: DataFrame, items: DataFrame, need: int, size: float, key: str, at: tuple[str, ...]) -> DataFrame:
    """The rows of points(key, at) with those rows of items(lo0, hi0, lo1, ...) that may be among their ``need`` nearest; at least ``need`` items exist.

    For points far from all items, where rings of cells would hold everything. Cells are searched from coarse to fine like the nodes of a tree: a
    point keeps a cell if the box of its items begins no further off than the boxes of enough other cells end. Cells are ``size`` wide at last. The
    first levels, of at most 4096 cells by their number, are broadcast; later ones meet the points by equi-joins.
    """
    ends = items.agg(*[F.min(f"lo{i}").alias(f"o{i}") for i in range(3)], *[F.max(f"lo{i}").alias(f"p{i}") for i in range(3)]).first()
    levels = max(1, math.ceil(math.log2(max(1.0, max(ends[f"p{i}"] - ends[f"o{i}"] for i in range(3)) / size))) + 1)
    placed = items.select("*", *[F.floor((F.col(f"lo{i}") - ends[f"o{i}"]) / size).cast("long").alias(f"_k{i}") for i in range(3)])
    extents = [f(f"{e}{i}").alias(f"_{e}{i}") for i in range(3) for e, f in (("lo", F.min), ("hi", F.max))]
    fine = stored(placed.groupBy("_k0", "_k1", "_k2").agg(F.count("*").alias("_n"), *extents))
    merged = [F.sum("_n").alias("_n"), *[f(f"_{e}{i}").alias(f"_{e}{i}") for i in range(3) for e, f in (("lo", F.min), ("hi", F.max))]]
    begins = [F.greatest(F.lit(0.0), F.col(f"_lo{i}") - F.col(n), F.col(n) - F.col(f"_hi{i}")) for i, n in enumerate(at)]
    goes = [F.greatest(F.abs(F.col(n) - F.col(f"_lo{i}")), F.abs(F.col(n) - F.col(f"_hi{i}"))) for i, n in enumerate(at)]
    mine = Window.partitionBy(key)
    looks = points.select(key, *at, *[F.lit(0).cast("long").alias(f"_k{i}") for i in range(3)])
    for level in range(levels - 1, -1, -1):
        up = [F.shiftright(f"_k{i}", level).alias(f"_c{i}") for i in range(3)]
        cells = fine.groupBy(*up).agg(*merged).select("*", *[F.shiftright(f"_c{i}", 1).alias(f"_k{i}") for i in range(3)])
        small = 8 ** (levels - level) <= 4096
        met = looks.join(F.broadcast(cells) if small else cells, ["_k0", "_k1", "_k2"])
        met = met.select(key, *at, "_n", *[F.col(f"_c{i}").alias(f"_k{i}") for i in range(3)], norm(tuple(begins)).alias("_from"), norm(tuple(goes)).alias("_to"))
        met = met.withColumn("_sum", F.sum("_n").over(mine.orderBy("_to").rowsBetween(Window.unboundedPreceding, 0)))
        met = met.withColumn("_enough", F.min(F.when(F.col("_sum") >= need, F.col("_to"))).over(mine))
        looks = met.where(F.col("_from") <= F.col("_enough") * (1 + 1e-9)).select(key, *at, "_k0", "_k1", "_k2")
        if not small and level % 4 == 0 and level:
            looks = stored(looks)
    return looks.join(placed, ["_k0", "_k1", "_k2"]).drop("_k0", "_k1", "_k2")


def knn(left: DataFrame, right: DataFrame, k: int, left_id: str = "id", right_id: str = "nid", same: bool = False, per_cell: int = 64) -> DataFrame:
    """left_id, right_id, d, rank (1 is the nearest; ties by right_id). same: a point isn't its own neighbour.

    Rounds on grids, each twice as coarse as the one before: a point sees the 27 cells around it and is settled once its
    k-th neighbour is no further than a cell is wide. The first grid is so fine that no cell holds more than about ``per_cell`` * k
    points of ``right`` (counted cell by cell, the cells are halved until that holds), so a cluster is settled among itself, and what goes on to
    coarse cells is what is sparse at the scale before. Points far outside the box of ``right`` search cells as a tree (in_reach). Of points at one
    place the first few by right_id stand for all.
    """
    empty = left.join(right.select(F.col(right_id), F.lit(0.0).alias("d")), F.lit(False)).select(left_id, right_id, "d", F.lit(1).alias("rank"))
    bounds = [f(x).alias(f"{n}{i}") for i, x in enumerate(X) for n, f in (("lo", F.min), ("hi", F.max))]
    here, there = right.agg(F.count("*").alias("n"), *bounds).first(), left.agg(*bounds).first()
    if not here.n or there.lo0 is None:
        return empty
    need = min(k + same, here.n)
    place = Window.partitionBy("b0", "b1", "b2").orderBy(right_id)
    b = right.select(F.col(right_id), *[F.col(x).alias(f"b{i}") for i, x in enumerate(X)])
    b = stored(b.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= need).drop("_n"))
    origin = [here[f"lo{i}"] for i in range(3)]
    sides = [here[f"hi{i}"] - origin[i] for i in range(3)]
    span = max(max(sides), 1e-12)
    reach = max(max(abs(there[f"hi{i}"] - origin[i]), abs(here[f"hi{i}"] - there[f"lo{i}"]), sides[i]) for i in range(3))
    size, least = max((sides[0] * sides[1] * sides[2] * need / (1.5 * here.n)) ** (1 / 3), span * 2.0**-10), span * 2.0**-24
    cells = lambda p, size: [F.floor((F.col(f"{p}{i}") - origin[i]) / size).cast("long").alias(f"k{i}") for i in range(3)]
    rim = 4 * size
    while size > least and b.groupBy(*cells("b", size)).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n > per_cell * max(1, need):
        size /= 2
    todo = left.select(F.col(left_id), *[F.col(x).alias(f"a{i}") for i, x in enumerate(X)])
    d = norm(sub(vec("a0", "a1", "a2"), vec("b0", "b1", "b2")))
    w = Window.partitionBy(left_id).orderBy("d", right_id)
    rounds = []
    if any(there[f"lo{i}"] < here[f"lo{i}"] - rim / 2 or there[f"hi{i}"] > here[f"hi{i}"] + rim / 2 for i in range(3)):
        off = outside(("a0", "a1", "a2"), origin, [here[f"hi{i}"] for i in range(3)]) > rim * rim
        items = b.select("*", *[F.col(f"b{i}").alias(f"{e}{i}") for i in range(3) for e in ("lo", "hi")])
        met = in_reach(todo.where(off), items, need, size, left_id, ("a0", "a1", "a2")).select(left_id, right_id, d.alias("d"))
        rounds.append(stored(met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= need).select(left_id, right_id, "d")))
        todo, reach = todo.where(~off), min(reach, max(sides) + rim)
    while True:
        last = size >= reach
        probe = todo.select("*", *cells("a", size))
        for i in range(3):
            probe = probe.withColumn(f"k{i}", F.explode(_around(f"k{i}", 1, -1, int(sides[i] // size) + 1)))
        near = probe.join(b.select("*", *cells("b", size)), ["k0", "k1", "k2"]).select(left_id, right_id, d.alias("d"))
        top = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= need)
        if last:
            rounds.append(top.select(left_id, right_id, "d"))
            break
        # a row for each point, settled or not
        held = top.groupBy(left_id).agg(F.collect_list(F.struct(right_id, "d")).alias("near"), F.max("d").alias("worst"), F.count("*").alias("n"))
        settled = (F.col("n") >= need) & (F.col("worst") <= size)
        found = stored(todo.join(held, left_id, "left").withColumn("settled", F.coalesce(settled, F.lit(False))))
        rounds.append(found.where("settled").select(left_id, F.explode("near").alias("e")).select(left_id, f"e.{right_id}", "e.d"))
        todo = found.where("not settled").select(left_id, "a0", "a1", "a2")
        if todo.limit(1).count() == 0:
            break
        size *= 2
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    if same:
        out = out.where(F.col(left_id) != F.col(right_id))
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(left: DataFrame, right: DataFrame, left_id: str = "id", right_id: str = "nid") -> DataFrame:
    """The nearest right point of each left point."""
    return knn(left, right, 1, left_id, right_id).drop("rank")


def local_maxima(points: DataFrame, value: str, k: int, key: str = "id") -> DataFrame:
    """Key of points whose value exceeds that of all their k nearest neighbours; equal values disqualify both."""
    other = points.select(F.col(key).alias("nid"), *X)
    pairs = knn(points, other, k, key, "nid", same=True)
    v = points.select(key, F.col(value).alias("v"))
    n = points.select(F.col(key).alias("nid"), F.col(value).alias("nv"))
    return pairs.join(v, key).join(n, "nid").groupBy(key).agg(F.min(F.col("v") > F.col("nv")).alias("is_max")).where("is_max").select(key)


def sphere_overlaps(spheres: DataFrame, factor: float = 1.1) -> DataFrame:
    """I < j of spheres(id, x0, x1, x2, r) nearer than factor * (r_i + r_j).

    Spheres are classed by the power of two of their radius. Of a pair the larger one's class says how wide cells are, so a
    large sphere meets small ones in wide cells and small ones meet each other in narrow ones. The driver sees the classes alone.
    """
    s = spheres.select("id", *X, "r", F.floor(F.log2(F.greatest(F.col("r"), F.lit(1e-300)))).cast("int").alias("c"))
    classes = sorted(r.c for r in s.select("c").distinct().collect())  # at most as many as a double has exponents
    width = F.pow(F.lit(2.0), F.col("g") + 2) * factor  # no less than the reach of a pair whose larger one is of class g
    cells = [F.floor(F.col(x) / width).cast("long").alias(f"k{i}") for i, x in enumerate(X)]
    levels = F.filter(F.array(*[F.lit(c) for c in classes]), lambda c: c >= F.col("c")) if classes else F.array().cast("array<int>")
    small = s.select("*", F.explode(levels).alias("g")).select("g", *cells, *[F.col(c).alias(f"s_{c}") for c in ("id", "r", "c", *X)])
    large = s.withColumn("g", F.col("c")).select("*", *cells)
    for i in range(3):
        large = large.withColumn(f"k{i}", F.explode(_around(f"k{i}", 1)))
    d = norm(sub(vec(*X), vec(*[f"s_{x}" for x in X])))
    once = (F.col("s_c") < F.col("c")) | (F.col("s_id") < F.col("id"))  # of equal classes either one is the larger
    pairs = large.join(small, ["g", "k0", "k1", "k2"]).where(once & (F.col("id") != F.col("s_id")))
    pairs = pairs.select(F.least("id", "s_id").alias("i"), F.greatest("id", "s_id").alias("j"), d.alias("d"), (F.col("r") + F.col("s_r")).alias("rr"))
    return pairs.where(F.col("d") < F.col("rr") * factor).select("i", "j", "d")


def in_balls(points: DataFrame, balls: DataFrame) -> DataFrame:
    """The columns of balls(c0..c2, reach, ...) and of points(x0..x2, ...) for points at most reach from a ball's centre.

    Balls are classed by the power of two of their reach, and a ball meets the points of the 27 cells around it in cells as wide.
    """
    b = balls.withColumn("g", F.floor(F.log2(F.greatest(F.col("reach"), F.lit(1e-300)))).cast("int"))
    classes = sorted(r.g for r in b.select("g").distinct().collect())  # at most as many as a double has exponents
    width = F.pow(F.lit(2.0), F.col("g") + 1)
    b = b.select("*", *[F.floor(F.col(f"c{i}") / width).cast("long").alias(f"k{i}") for i in range(3)])
    for i in range(3):
        b = b.withColumn(f"k{i}", F.explode(_around(f"k{i}", 1)))
    p = points.select("*", F.explode(F.array(*[F.lit(c) for c in classes]) if classes else F.array().cast("array<int>")).alias("g"))
    p = p.select("*", *[F.floor(F.col(x) / width).cast("long").alias(f"k{i}") for i, x in enumerate(X)])
    return b.join(p, ["g", "k0", "k1", "k2"]).where(norm(sub(vec(*X), vec("c0", "c1", "c2"))) <= F.col("reach")).drop("g", "k0", "k1", "k2")


def without_slabs(points: DataFrame, surface: DataFrame, slab_distance: Column, tolerance: float = 0.005) -> DataFrame:
    """points whose nearest surface point isn't within tolerance of a slab."""
    flat = surface.where(F.abs(slab_distance) <= tolerance).select(F.col("nid"))
    near = nearest(points, surface)
    return points.join(near.join(flat, "nid", "left_semi").select("id"), "id", "left_anti")
