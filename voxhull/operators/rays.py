"""Rays and distances to triangles (F2, J11, G11, signed distance).

Triangles meet points and rays by equi-joins on grid cells: along a fixed direction cells of the plane across it, for the nearest
triangle cells around the point, and along a ray the cells it runs by.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import Vec, add, clip, cross, dot, lit, norm, scale, sub, vec
from .spatial import in_reach, outside
from .storage import sent, stored

#: F2's five ray directions, the last one shorter than 1.
DIRECTIONS = ((0.4395064455, 0.617598629942, 0.652231566745), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0), (0.577, 0.577, 0.577))


def corner(p: str) -> Vec:
    return vec(*(f"{p}{i}" for i in range(3)))


def hit(origin: Vec, direction: Vec, a: Vec, b: Vec, c: Vec) -> Column:
    """Moeller and Trumbore: the ray parameter where it meets the triangle, null if it doesn't."""
    e1, e2 = sub(b, a), sub(c, a)
    h = cross(direction, e2)
    det = dot(e1, h)
    flat = F.abs(det) <= 1e-12
    inverse = F.lit(1.0) / F.when(flat, 1.0).otherwise(det)
    s = sub(origin, a)
    u = dot(s, h) * inverse
    q = cross(s, e1)
    v = dot(direction, q) * inverse
    t = dot(e2, q) * inverse
    return F.when(~flat & (u >= 0) & (v >= 0) & (u + v <= 1) & (t > 0), t)


_NAMES = [f"{p}{i}" for p in "abc" for i in range(3)]


def _plane(d: tuple[float, ...]) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Two unit vectors at right angles to a direction and each other."""
    n = np.array(d) / np.linalg.norm(d)
    u = np.cross(n, np.eye(3)[np.abs(n).argmin()])
    u /= np.linalg.norm(u)
    return tuple(u.tolist()), tuple(np.cross(n, u).tolist())


def _boxes(triangles: DataFrame, axes: list[tuple[float, ...]]) -> DataFrame:
    """fid, corners, and lo0, hi0, ... : a triangle's extent along each axis."""
    spans = []
    for i, axis in enumerate(axes):
        at = [dot(corner(p), lit(axis)) for p in "abc"]
        spans += [F.least(*at).alias(f"lo{i}"), F.greatest(*at).alias(f"hi{i}")]
    return triangles.select("fid", *_NAMES, *spans)


def _width(boxes: DataFrame, dims: int) -> tuple[float, float]:
    """A cell's width, such that triangles cover some cells each on the whole, and the largest coordinate, for rounding's sake."""
    sizes = [F.col(f"hi{i}") - F.col(f"lo{i}") for i in range(dims)]
    r = boxes.agg(F.sqrt(F.avg(sum((x * x for x in sizes[1:]), sizes[0] * sizes[0]))).alias("w"), F.max(F.greatest(*[F.abs(f"{e}{i}") for e in ("lo", "hi") for i in range(dims)])).alias("far")).first()
    return max(r.w or 0.0, (r.far or 0.0) * 1e-6, 1e-12), r.far or 0.0


def _in_cells(boxes: DataFrame, dims: int, width: float, slack: float) -> DataFrame:
    """boxes with k0, k1, ... of each cell they touch, ``slack`` wider to any side."""
    for i in range(dims):
        first, last = F.floor((F.col(f"lo{i}") - slack) / width).cast("long"), F.floor((F.col(f"hi{i}") + slack) / width).cast("long")
        boxes = boxes.withColumn(f"k{i}", F.explode(F.sequence(first, last)))
    return boxes


def _crossings(points: DataFrame, triangles: DataFrame, direction: tuple[float, ...]) -> DataFrame:
    """id, n: how many triangles the ray from each of points(id, x0..x2) meets; points that meet none are left out.

    Seen along the ray, a triangle is a shape in a plane and a point one spot of it, so they meet by an equi-join on cells of that plane.
    """
    axes = list(_plane(direction))
    boxes = _boxes(triangles, axes)
    width, far = _width(boxes, 2)
    spots = points.select("id", "x0", "x1", "x2", *[F.floor(dot(vec("x0", "x1", "x2"), lit(a)) / width).cast("long").alias(f"k{i}") for i, a in enumerate(axes)])
    met = spots.join(_in_cells(boxes, 2, width, 1e-9 * max(far, width)).select("k0", "k1", *_NAMES), ["k0", "k1"])
    t = hit(vec("x0", "x1", "x2"), lit(direction), corner("a"), corner("b"), corner("c"))
    return met.where(t.isNotNull()).groupBy("id").agg(F.count("*").alias("n"))


def inside_votes(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """id, votes, inside: a direction votes inside if its ray meets the mesh an odd number of times; three of five decide."""
    votes = points.select("id").distinct().select("id", F.lit(0).alias("vote"))
    for d in DIRECTIONS:
        votes = votes.unionByName(_crossings(points, triangles, d).select("id", (F.col("n") % 2).cast("int").alias("vote")))
    return votes.groupBy("id").agg(F.sum("vote").cast("int").alias("votes")).select("id", "votes", (F.col("votes") >= 3).alias("inside"))


def triangle_distance(p: Vec, a: Vec, b: Vec, c: Vec) -> Column:
    """Distance of a point to a triangle: to the plane if its foot is inside, else to the nearest side."""

    def side(u: Vec, v: Vec) -> Column:
        e, d = sub(v, u), sub(p, u)
        t = clip(dot(d, e) / F.greatest(dot(e, e), F.lit(1e-300)), 0, 1)
        return norm(sub(d, scale(e, t)))

    n = cross(sub(b, a), sub(c, a))
    inside = (dot(cross(sub(b, a), sub(p, a)), n) >= 0) & (dot(cross(sub(c, b), sub(p, b)), n) >= 0) & (dot(cross(sub(a, c), sub(p, c)), n) >= 0)
    plane = F.abs(dot(sub(p, a), n)) / F.greatest(norm(n), F.lit(1e-300))
    return F.when(inside, plane).otherwise(F.least(side(a, b), side(b, c), side(c, a)))


def distances(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """id, near: the distance of points(id, x0..x2) to the nearest triangle; no rows without triangles.

    Rounds on grids, each twice as coarse: a point sees the triangles in the 27 cells around it and is settled once the nearest one is no
    further than a cell is wide. Points far outside the mesh's box search cells as a tree.
    """
    axes = [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)]
    boxes = stored(_boxes(triangles, axes))
    width, far = _width(boxes, 3)
    reach = points.agg(F.max(F.greatest(*[F.abs(f"x{i}") for i in range(3)])).alias("r")).first().r
    if reach is None or not boxes.limit(1).count():
        return points.select("id", F.lit(0.0).alias("near")).where(F.lit(False))
    low = boxes.agg(*[F.min(f"lo{i}").alias(f"lo{i}") for i in range(3)], *[F.max(f"hi{i}").alias(f"hi{i}") for i in range(3)]).first()
    todo, rounds = points.select("id", "x0", "x1", "x2"), []
    near = F.min(triangle_distance(vec("x0", "x1", "x2"), corner("a"), corner("b"), corner("c"))).alias("near")
    squares = [reduce(lambda u, v: u + v, [(F.col(f"x{i}") - F.col(f"{p}{i}")) * (F.col(f"x{i}") - F.col(f"{p}{i}")) for i in range(3)]) for p in "abc"]
    beside = [F.greatest(F.lit(0.0), F.col(f"lo{i}") - F.col(f"x{i}"), F.col(f"x{i}") - F.col(f"hi{i}")) for i in range(3)]
    spans = [f"{e}{i}" for i in range(3) for e in ("lo", "hi")]
    if reach > far:  # else no point can be outside
        off = outside(("x0", "x1", "x2"), [low[f"lo{i}"] for i in range(3)], [low[f"hi{i}"] for i in range(3)]) > 16 * width * width
        rounds.append(stored(in_reach(todo.where(off), boxes, 1, width, "id", ("x0", "x1", "x2")).groupBy("id").agg(near)))
        todo, reach = todo.where(~off), min(reach, far + 4 * width)
    while True:
        probe = todo.select("*", *[F.floor(F.col(f"x{i}") / width).cast("long").alias(f"k{i}") for i in range(3)])
        for i in range(3):
            first, last = int(low[f"lo{i}"] // width), int(low[f"hi{i}"] // width)
            a, b = F.greatest(F.col(f"k{i}") - 1, F.lit(first)), F.least(F.col(f"k{i}") + 1, F.lit(last))
            probe = probe.withColumn(f"k{i}", F.explode(F.when(a <= b, F.sequence(a, F.greatest(a, b))).otherwise(F.array().cast("array<bigint>"))))
        # the nearest corner bounds the distance from above and a triangle's box from below: what can't be nearest isn't measured
        met = probe.join(_in_cells(boxes, 3, width, 0.0).select("k0", "k1", "k2", *_NAMES, *spans), ["k0", "k1", "k2"])
        bound = stored(met.groupBy("id").agg(F.min(F.least(*squares)).alias("most")))
        may = beside[0] * beside[0] + beside[1] * beside[1] + beside[2] * beside[2] <= F.col("most") * (1 + 1e-9)
        close = stored(met.join(bound, "id").where(may).select("id", "x0", "x1", "x2", *_NAMES))
        found = close.groupBy("id").agg(near)
        if width >= 2 * (reach + far):  # these cells hold everything
            rounds.append(found)
            break
        both = stored(todo.join(found, "id", "left"))
        settled = F.coalesce(F.col("near") <= width, F.lit(False))
        rounds.append(both.where(settled).select("id", "near"))
        todo = both.where(~settled).select("id", "x0", "x1", "x2")
        if not todo.limit(1).count():
            break
        width *= 2
    return reduce(DataFrame.unionByName, rounds)


def signed_distance(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """id, distance to the nearest triangle, negative inside by F2's vote."""
    j = distances(points, triangles).join(inside_votes(points, triangles), "id")
    return j.select("id", F.when(F.col("inside"), -F.col("near")).otherwise(F.col("near")).alias("distance"))


def nearest_hits(rays: DataFrame, triangles: DataFrame, least: float = 0.005) -> DataFrame:
    """Id and t of the nearest hit beyond ``least`` of rays(id, x0..x2, d0..d2), d of length 1.

    A ray is walked from where it enters the mesh's box to where it leaves it, in stretches twice as long each time; the cells that a stretch runs by meet
    the triangles in them, and a ray whose nearest hit lies within what was walked goes no further. Rays that miss the box are left out at once.
    """
    axes = [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)]
    boxes = stored(_boxes(triangles, axes))
    width, far = _width(boxes, 3)
    box = boxes.agg(*[F.min(f"lo{i}").alias(f"lo{i}") for i in range(3)], *[F.max(f"hi{i}").alias(f"hi{i}") for i in range(3)]).first()
    if box.lo0 is None:
        return rays.select("id", F.lit(0.0).alias("t")).where(F.lit(False))
    cells = _in_cells(boxes, 3, width, 1e-9 * max(far, width)).select("fid", "k0", "k1", "k2", *_NAMES)
    origin, way = vec("x0", "x1", "x2"), vec("d0", "d1", "d2")
    enter, leave = [F.lit(0.0)], []
    for i, (x, d) in enumerate(zip(origin, way)):  # the box is a cell wider, which covers rounding and rays all but parallel to a side
        lo, hi, along = F.lit(box[f"lo{i}"] - width), F.lit(box[f"hi{i}"] + width), F.abs(d) > 1e-12
        beside, a, b = (x < lo) | (x > hi), (lo - x) / F.when(along, d), (hi - x) / F.when(along, d)
        enter.append(F.when(along, F.least(a, b)).when(beside, F.lit(float("inf"))).otherwise(F.lit(0.0)))
        leave.append(F.when(along, F.greatest(a, b)).when(beside, F.lit(-1.0)).otherwise(F.lit(float("inf"))))
    clipped = rays.select("id", "x0", "x1", "x2", "d0", "d1", "d2", F.greatest(*enter).alias("t0"), F.least(*leave).alias("t1")).where("t0 <= t1")
    todo, rounds, start, stop = stored(clipped), [], 0.0, 8 * width
    while True:
        # spots half a cell apart from where the ray enters; what lies between two of them is in their cells or the next ones
        most = F.least(F.lit(int(stop / width * 2) + 1), F.ceil((F.col("t1") - F.col("t0")) / width * 2).cast("int") + 1)
        spots = todo.select("*", F.explode(F.sequence(F.lit(int(start / width * 2)), F.greatest(most, F.lit(int(start / width * 2))))).alias("s"))
        spots = spots.select("*", *[((x + d * (F.col("t0") + F.col("s") * (width / 2))) / width).alias(f"p{i}") for i, (x, d) in enumerate(zip(origin, way))])
        keys = spots.select("*", *[F.floor(f"p{i}").cast("long").alias(f"m{i}") for i in range(3)])
        for i in range(3):
            side = F.col(f"m{i}") + F.when(F.col(f"p{i}") - F.col(f"m{i}") < 0.5, -1).otherwise(1)
            keys = keys.withColumn(f"k{i}", F.explode(F.array(F.col(f"m{i}"), side)))
        keys = keys.select("id", *[f"{c}{i}" for c in "xdk" for i in range(3)]).distinct()
        h = hit(origin, way, corner("a"), corner("b"), corner("c"))
        n = todo.count()
        # at most so many spots of eight cells, where Spark would take them for as few as rays
        found = sent(keys, n * 8 * (int(stop / width * 2) + 2 - int(start / width * 2))).join(cells, ["k0", "k1", "k2"]).select("id", h.alias("t")).where(F.col("t") > least).groupBy("id").agg(F.min("t").alias("t"))
        both = stored(todo.join(sent(found, n), "id", "left"))
        walked = F.col("t1") - F.col("t0") <= stop
        settled = F.coalesce(F.col("t") - F.col("t0") <= stop, F.lit(False))
        rounds.append(both.where((settled | walked) & F.col("t").isNotNull()).select("id", "t"))
        todo = both.where(~settled & ~walked).drop("t")
        if not todo.limit(1).count():
            break
        start, stop = stop, stop * 2
    return reduce(DataFrame.unionByName, rounds)


def thickness(regions: DataFrame, triangles: DataFrame, offset: float = 0.01, least: float = 1e-4) -> DataFrame:
    """Region, thickness for regions(region, c0..c2, n0..n2): the smaller distance from the region to the next face along
    either normal direction. Rays start ``offset`` off the surface, before it, and what they meet within 0.005 behind it is the region itself.
    """
    sides = F.array(*[F.struct(F.lit(s).alias("s")) for s in (1.0, -1.0)])
    both = regions.withColumn("side", F.explode(sides))
    c, n = vec("c0", "c1", "c2"), vec("n0", "n1", "n2")
    start, way = add(c, scale(n, F.col("side.s") * offset)), scale(n, -F.col("side.s"))
    rays = both.select(F.struct("region", "side.s").alias("id"), *[x.alias(f"x{i}") for i, x in enumerate(start)], *[x.alias(f"d{i}") for i, x in enumerate(way)])
    found = nearest_hits(rays, triangles, offset + 0.005).groupBy(F.col("id.region").alias("region")).agg((F.min("t") - offset).alias("thickness"))
    return found.where(F.col("thickness") >= least)
