"""Concave outlines (G12): the border of the alpha shape of points in a plane, for all regions at once.

An edge of the border joins two points on a circle of radius 1 / alpha that holds no other point, and whose other circle holds
one. A circle through p is told by the direction of its centre, and each neighbour r of p, nearer than twice the radius, forbids an arc of
directions; where arcs leave a gap, the border comes to p from the arc before the gap and goes on to the one after. So what is
needed is a join with neighbours on cells and, at each point, a running maximum over arcs in the order of their starts.

Points whose directions are all forbidden by a few near neighbours are inside and need no others: those of a cell in the midst of
filled cells are told by the cells alone (sparse), others by the arcs of a few points (candidates). The rest, as many as the
border is long and not as the region is large, are joined with all within twice the radius.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .repair import loops
from .storage import sent, shuffled, stored

_EPS = 1e-12


#: Of the width within which points are neighbours, the parts that cells of the first trial are wide.
_FINE = 8


def neighbours(points: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """region, id, radius, nid, angle, d: those of others (all points, if None) within twice the radius of each of points(region, id, u, v, radius), by cells of that width."""
    wide = F.col("radius") * 2
    cell = [F.floor(F.col(x) / wide).alias(c) for x, c in (("u", "i"), ("v", "j"))]
    p, o = (x.select("region", "id", "u", "v", "radius", *cell) for x in (points, points if others is None else others))
    about = F.array(*[F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    p = p.select("region", "id", "u", "v", "radius", F.inline(about))
    q = o.select("region", F.col("id").alias("nid"), F.col("u").alias("nu"), F.col("v").alias("nv"), "i", "j")
    d = F.hypot(F.col("nu") - F.col("u"), F.col("nv") - F.col("v"))
    # points are few or many; nine cells a row, which Spark would not count
    j = sent(p, points.count() * 9).join(q, ["region", "i", "j"]).where(F.col("id") != F.col("nid"))
    return j.select("region", "id", "radius", "nid", F.atan2(F.col("nv") - F.col("v"), F.col("nu") - F.col("u")).alias("angle"), d.alias("d")).where(F.col("d") < F.col("radius") * 2)


def sparse(points: DataFrame) -> DataFrame:
    """Those of points(region, id, u, v, radius), with the cells i, j of a fine lattice they lie in, that have an empty cell among the 24 about their own.

    The others are inside: a cell is a quarter of the radius wide, and a circle through a point of the middle one holds the whole of the
    cell that lies half a radius from the point towards the circle's centre. Told from the cells, which are no more where points lie denser.
    """
    wide = F.col("radius") * 2 / _FINE
    cell = [F.floor(F.col(x) / wide).alias(c) for x, c in (("u", "i"), ("v", "j"))]
    p = points.select("region", "id", "u", "v", "radius", *cell)
    ring = F.array(*[F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j")) for a in range(-2, 3) for b in range(-2, 3) if a or b])
    filled = p.select("region", "i", "j").distinct().select("region", F.inline(ring)).groupBy("region", "i", "j").agg(F.count("*").alias("n")).where("n = 24")
    filled = stored(filled.select("region", "i", "j"))
    return p.join(sent(filled, filled.count()), ["region", "i", "j"], "left_anti").select("region", "id", "u", "v", "radius", "i", "j")


def candidates(points: DataFrame) -> DataFrame:
    """Those of points(region, id, u, v, radius), each in a place of its own, that may lie on the border; regions of one radius each.

    Tried are the arcs of a few points: of each cell of a fine lattice about a point the outermost by eight directions, whatever the cell
    holds. A point that these surround is left out, and more arcs could not change that; one that they don't stays.
    """
    wide = F.col("radius") * 2 / _FINE
    cell = [F.floor(F.col(x) / wide).alias(c) for x, c in (("u", "i"), ("v", "j"))]
    p = points.select("region", "id", "u", "v", "radius", *cell)
    out = [(F.col("u") * a + F.col("v") * b) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1))]
    ends = p.groupBy("region", "i", "j").agg(*[F.max(F.struct(e.alias("e"), "id", "u", "v")).alias(f"m{n}") for n, e in enumerate(out)])
    few = F.array_distinct(F.array(*[F.struct(F.col(f"m{n}.id").alias("nid"), F.col(f"m{n}.u").alias("nu"), F.col(f"m{n}.v").alias("nv")) for n in range(len(out))]))
    about = F.array(*[F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    each = ends.select("region", few.alias("few"), F.inline(about)).groupBy("region", "i", "j").agg(F.flatten(F.collect_list("few")).alias("few"))
    turn = 2 * 3.141592653589793

    def arc(n: Column) -> Column:
        du, dv = n["nu"] - F.col("u"), n["nv"] - F.col("v")
        half = F.acos(F.least(F.hypot(du, dv) / (F.col("radius") * 2), F.lit(1.0)))
        start = F.atan2(dv, du) - half
        start = F.when(start < -turn / 2, start + turn).otherwise(start)
        return F.struct(start.alias("start"), (start + half * 2).alias("end"))

    near = F.filter("few", lambda n: (n["nid"] != F.col("id")) & (F.hypot(n["nu"] - F.col("u"), n["nv"] - F.col("v")) < F.col("radius") * 2))
    # dealt by number: arcs take their time by rows, of which many fit into a few bytes
    tried = p.sparkSession.conf.get("spark.sql.shuffle.partitions")
    arcs = sparse(points).join(shuffled(each), ["region", "i", "j"], "left").repartition(int(tried), "region", "id").select("region", "id", "u", "v", "radius", F.array_sort(F.transform(near, arc)).alias("arcs"))
    last = F.array_max(F.transform("arcs", lambda a: a["end"])) - turn
    # how far the arcs reach without a gap, from where those reach that go round; a gap is told apart from none with room for rounding, on the safe side
    reached = F.aggregate("arcs", last, lambda r, a: F.when(a["start"] > r - _EPS, F.lit(float("inf"))).otherwise(F.greatest(r, a["end"])))
    return arcs.where((F.coalesce(F.size("arcs"), F.lit(0)) == 0) | (reached == float("inf"))).select("region", "id", "u", "v", "radius")


def border(points: DataFrame) -> DataFrame:
    """region, s, t, next: the edges of the alpha shape's border of points(region, id, u, v, radius), the shape to the left of s -> t, and where the
    border goes on from t. Of points in one place the least id counts; edges with the shape on neither side are left out."""
    once = points.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("radius") > 0)).groupBy("region", "u", "v").agg(F.min("id").alias("id"), F.max("radius").alias("radius"))
    once = stored(once.select("region", "id", "u", "v", "radius"))
    turn = 2 * 3.141592653589793
    half = F.acos(F.least(F.col("d") / (F.col("radius") * 2), F.lit(1.0)))
    start = F.col("angle") - half
    start = F.when(start < -turn / 2, start + turn).otherwise(start)
    arcs = neighbours(stored(candidates(once)), once).select("region", "id", "nid", start.alias("start"), half.alias("half")).select("region", "id", "nid", "start", F.struct((F.col("start") + F.col("half") * 2).alias("end"), F.col("nid").alias("nid")).alias("e"))
    around = Window.partitionBy("region", "id")
    inside = around.orderBy("start", F.desc("e"))
    before = F.max("e").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    last = F.max("e").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    seen = arcs.select("region", "id", "nid", "start", before.alias("b"), F.struct((last["end"] - turn).alias("end"), last["nid"].alias("nid")).alias("l"))
    reached = F.greatest(F.coalesce(F.col("b"), F.col("l")), F.col("l"))
    gaps = seen.select("region", "id", F.col("nid").alias("to"), "start", reached.alias("r")).where(F.col("start") > F.col("r.end") + _EPS)
    gaps = stored(gaps.select("region", "id", F.col("r.nid").alias("came"), "to", "start"))
    # an edge that bounds the shape on neither side is met from both ends; past it the border goes on in the next gap
    back = gaps.select("region", F.col("id").alias("to"), F.col("to").alias("id"), F.lit(True).alias("bare"))
    marked = gaps.join(shuffled(back), ["region", "id", "to"], "left").withColumn("out", F.when(F.col("bare").isNull(), F.col("to")))
    following = F.first("out", ignorenulls=True).over(around.orderBy("start").rowsBetween(0, Window.unboundedFollowing))
    first = F.first("out", ignorenulls=True).over(around.orderBy("start").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    turns = stored(marked.select("region", "id", "came", "out", F.coalesce(following, first).alias("goes")))
    edges = turns.where(F.col("out").isNotNull()).select("region", F.col("id").alias("s"), F.col("out").alias("t"))
    on = turns.select("region", F.col("came").alias("s"), F.col("id").alias("t"), F.col("goes").alias("next"))
    return edges.join(shuffled(on), ["region", "s", "t"])


def outlines(points: DataFrame) -> DataFrame:
    """region, hull (an array of u, v in the order of the border, shape to the left) and hull_area: of each region of points(region, id, u, v, radius)
    the piece of the border that encloses most; a region whose points enclose nothing has no row."""
    edges = border(points).select(F.col("region").alias("mesh_id"), F.col("s").alias("fid"), F.col("t").alias("k"), "s", "t", "next")
    walk = loops(edges).select(F.col("mesh_id").alias("region"), "loop", "at", F.col("s").alias("id"), F.col("t").alias("to"))
    at = points.select("region", "id", "u", "v")
    placed = walk.join(shuffled(at), ["region", "id"]).join(shuffled(at.select("region", F.col("id").alias("to"), F.col("u").alias("u2"), F.col("v").alias("v2"))), ["region", "to"])
    area = F.sum(F.col("u") * F.col("v2") - F.col("u2") * F.col("v")) / 2
    pieces = stored(placed.groupBy("region", "loop").agg(area.alias("area"), F.array_sort(F.collect_list(F.struct("at", "u", "v"))).alias("w")))
    best = pieces.where("area > 0").groupBy("region").agg(F.max(F.struct("area", "loop", "w")).alias("m"))
    return best.select("region", F.transform("m.w", lambda x: F.struct(x["u"].alias("u"), x["v"].alias("v"))).alias("hull"), F.col("m.area").alias("hull_area"))


def widened(points: DataFrame, rounds: int = 12) -> DataFrame:
    """outlines(), where a region encloses nothing with circles that grow four times as wide each round: at last all but its convex hull."""
    left = stored(points.select("region", "id", "u", "v", "radius"))
    found = None
    for _ in range(rounds):
        got = stored(outlines(left))
        found = got if found is None else found.unionByName(got)
        left = left.join(sent(got.select("region"), got.count()), "region", "left_anti").withColumn("radius", F.col("radius") * 4)
        if left.limit(1).count() == 0:
            break
        left = stored(left)
    return found
