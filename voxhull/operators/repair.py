"""Mesh repair (S3): consistent winding, outward normals, holes.

Everything is joins and aggregates over half-edges, for all meshes at once: winding by components of a graph with two nodes a face, one
for each way round; holes by following their border in steps that double, 1, 2, 4, ... edges at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cross, dot, vec
from .graphs import components
from .mesh import corners
from .storage import sent, shuffled, stored

V = ("v0", "v1", "v2")


def half_edges(faces: DataFrame) -> DataFrame:
    """mesh_id, fid, k, a, b, c: side k of a face leads from a to b, and c is its third corner."""
    side = lambda k: F.struct(F.lit(k).alias("k"), *[F.col(V[(k + i) % 3]).alias(n) for i, n in enumerate("abc")])
    return faces.select("mesh_id", "fid", F.inline(F.array(side(0), side(1), side(2))))


def _turned(faces: DataFrame, turn, *rest: str) -> DataFrame:
    """faces with the corners in the other order where turn holds."""
    return faces.select("mesh_id", "fid", "v0", F.when(turn, F.col("v2")).otherwise(F.col("v1")).alias("v1"), F.when(turn, F.col("v1")).otherwise(F.col("v2")).alias("v2"), *rest)


def wind(faces: DataFrame) -> DataFrame:
    """faces(mesh_id, fid, v0, v1, v2) turned so that neighbours agree, with flipped, orientable, component (its least fid).

    Neighbours are the two faces of an edge that has two; edges of more faces bind none of them. In a component the face of least fid
    stays as it is. Where no way round is consistent, as on a Moebius strip, faces stay and orientable is false.
    """
    sides = half_edges(faces).select("mesh_id", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), F.struct("fid", (F.col("a") < F.col("b")).alias("up")).alias("s"))
    pairs = sides.groupBy("mesh_id", "lo", "hi").agg(F.count("*").alias("n"), F.min("s").alias("s"), F.max("s").alias("t")).where("n = 2 and s.fid <> t.fid")
    # a face's node 2 fid stands for the face as it is, 2 fid + 1 for the face turned; a link joins what can stand side by side
    node = lambda f, way: F.struct(F.col("mesh_id").alias("m"), (F.col(f) * 2 + way).alias("n"))
    clash = (F.col("s.up") == F.col("t.up")).cast("long")
    links = pairs.select(F.inline(F.array(*[F.struct(node("s.fid", F.lit(w)).alias("a"), node("t.fid", (clash + w) % 2).alias("b")) for w in (0, 1)])))
    nodes = faces.select(F.explode(F.array(node("fid", F.lit(0)), node("fid", F.lit(1)))).alias("node"))
    label = components(nodes, links).select(F.col("node.m").alias("mesh_id"), F.expr("node.n div 2").alias("fid"), F.expr("node.n % 2").alias("way"), F.col("component.n").alias("c"))
    # 2 fid lies with 2 m, m the least fid of the component, or with 2 m + 1; it lies with both where a way round leads back turned
    own = F.max(F.when(F.col("way") == 0, F.col("c")))
    ways = label.groupBy("mesh_id", "fid").agg((F.min("c") != F.max("c")).alias("orientable"), (own % 2 == 1).alias("odd"), F.expr("min(c) div 2").alias("component"))
    out = faces.select("mesh_id", "fid", *V).join(ways, ["mesh_id", "fid"]).withColumn("flipped", F.col("orientable") & F.col("odd"))
    return _turned(out, F.col("flipped"), "flipped", "orientable", "component")


def outward(vertices: DataFrame, wound: DataFrame) -> DataFrame:
    """wind()'s faces with the closed components of negative volume turned; flipped tells the difference to the faces before."""
    edge = half_edges(wound).groupBy("mesh_id", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.count("*").alias("n"), F.min("fid").alias("fid"))
    open_ = edge.where("n <> 2").join(wound.select("mesh_id", "fid", "component"), ["mesh_id", "fid"]).select("mesh_id", "component").distinct()
    c = corners(vertices, wound).join(wound.select("mesh_id", "fid", "component", "orientable"), ["mesh_id", "fid"])
    a, b, d = (vec(*(f"{p}{i}" for i in range(3))) for p in "abc")
    volume = c.where("orientable").groupBy("mesh_id", "component").agg(F.sum(dot(a, cross(b, d))).alias("volume"))
    inside_out = volume.where("volume < 0").join(open_, ["mesh_id", "component"], "left_anti").select("mesh_id", "component", F.lit(True).alias("turn"))
    out = wound.join(inside_out, ["mesh_id", "component"], "left").withColumn("turn", F.coalesce("turn", F.lit(False))).withColumn("flipped", F.col("flipped") != F.col("turn"))
    return _turned(out, F.col("turn"), "flipped", "orientable", "component")


def hole_edges(wound: DataFrame) -> DataFrame:
    """mesh_id, fid, k, s, t, next: the missing partner s -> t of each side (fid, k) that has none, and the vertex to which the border goes on from t.

    Where two fans of faces touch in a vertex only, the border goes on along the hole that it bounds, that is with the other fan; where more do,
    their order about the vertex is unknown and it stays with its own. Which fan is whose is found by turning about the vertex from
    face to face, in steps that double. Edges of which a face has two sides, or three faces share, have no border.
    """
    h = half_edges(wound)
    edge = h.groupBy("mesh_id", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.count("*").alias("n"), F.first(F.struct("fid", "k", F.col("b").alias("s"), F.col("a").alias("t"))).alias("e")).where("n = 1")
    border = stored(edge.select("mesh_id", "e.*"))
    leaving = border.groupBy("mesh_id", F.col("s").alias("t")).agg(F.count("*").alias("n"), F.first("t").alias("next"))
    plain = border.join(leaving.where("n = 1").select("mesh_id", "t", "next"), ["mesh_id", "t"]).select("mesh_id", "fid", "k", "s", "t", "next")
    shared = stored(leaving.where("n > 1").select("mesh_id", F.col("t").alias("a")))
    if shared.limit(1).count() == 0:
        return plain
    # from side a -> b of a face the next side about a is a -> c, if that is a side; else the border goes on from a to c
    about = h.join(shared, ["mesh_id", "a"]).select("mesh_id", "a", "b", "c")
    ends = border.select("mesh_id", F.col("s").alias("a"), F.col("t").alias("c"), F.lit(True).alias("done"))
    turn = stored(about.join(ends, ["mesh_id", "a", "c"], "left").select("mesh_id", "a", "b", "c", F.coalesce("done", F.lit(False)).alias("done")))
    starts = border.select("mesh_id", F.col("t").alias("a"), F.col("s").alias("b"))
    while turn.where("not done").join(starts, ["mesh_id", "a", "b"], "left_semi").limit(1).count():
        further = turn.select("mesh_id", "a", F.col("b").alias("c"), F.col("c").alias("c2"), F.col("done").alias("done2"))
        open_ = turn.where("not done").join(further, ["mesh_id", "a", "c"], "left").select("mesh_id", "a", "b", F.coalesce("c2", "c").alias("c"), F.coalesce("done2", F.lit(True)).alias("done"))
        turn = stored(turn.where("done").unionByName(open_))
    own = border.join(turn.select("mesh_id", F.col("a").alias("t"), F.col("b").alias("s"), F.col("c").alias("next")), ["mesh_id", "s", "t"])
    two = own.groupBy("mesh_id", "t").agg(F.count("*").alias("fans"), F.sum("next").alias("both"))
    met = own.join(two, ["mesh_id", "t"]).withColumn("next", F.when(F.col("fans") == 2, F.col("both") - F.col("next")).otherwise(F.col("next")))
    return plain.unionByName(met.select("mesh_id", "fid", "k", "s", "t", "next"))


def loops(edges: DataFrame) -> DataFrame:
    """hole_edges() with loop (its least edge, a struct of s and t), size and at: the edge's place in its loop from 0.

    Each edge knows the least of the next 2^n edges and how far it is; a round doubles that, until no edge learns of a lesser one.
    """
    me = F.struct("s", "t")
    seen = stored(edges.select("mesh_id", "fid", "k", me.alias("e"), me.alias("low"), F.lit(0).cast("long").alias("far"), F.struct(F.col("t").alias("s"), F.col("next").alias("t")).alias("to")))
    step = 1
    while True:
        ahead = seen.select("mesh_id", F.col("e").alias("to"), F.col("low").alias("low2"), F.col("far").alias("far2"), F.col("to").alias("to2"))
        both = seen.join(shuffled(ahead), ["mesh_id", "to"])
        lesser = F.col("low2") < F.col("low")
        seen = stored(both.select("mesh_id", "fid", "k", "e", F.least("low", "low2").alias("low"), F.when(lesser, F.col("far2") + step).otherwise(F.col("far")).alias("far"), F.col("to2").alias("to"), lesser.alias("new")))
        if seen.where("new").limit(1).count() == 0:
            break
        step *= 2
    size = stored(seen.groupBy("mesh_id", "low").agg(F.count("*").alias("size")))  # a row a loop: few or many
    out = seen.join(sent(size, size.count()), ["mesh_id", "low"])
    return out.select("mesh_id", "fid", "k", "e.s", "e.t", F.col("low").alias("loop"), "size", ((F.col("size") - F.col("far")) % F.col("size")).alias("at"))


def fill_holes(wound: DataFrame, most: int = 4) -> DataFrame:
    """wind()'s faces and, added, a fan over each hole of at most ``most`` edges, from the start of its least edge.

    An added face has the number -1 - (3 fid + k) of the side it is built on, so numbers don't repeat. Longer borders stay open.
    """
    fan = loops(hole_edges(wound)).where((F.col("size") <= most) & (F.col("at") >= 1) & (F.col("at") <= F.col("size") - 2))
    owner = wound.select("mesh_id", "fid", "component", "orientable")
    new = fan.join(owner, ["mesh_id", "fid"]).select(
        "mesh_id", (-1 - (F.col("fid") * 3 + F.col("k"))).alias("fid"), F.col("loop.s").alias("v0"), F.col("s").alias("v1"), F.col("t").alias("v2"),
        F.lit(False).alias("flipped"), "orientable", "component", F.lit(True).alias("added"),
    )
    return wound.withColumn("added", F.lit(False)).unionByName(new)


def repaired(vertices: DataFrame, faces: DataFrame, most: int = 4) -> DataFrame:
    """S3: mesh_id, fid, v0, v1, v2 with flipped, orientable, component, added: wound, small holes filled, closed parts turned outward."""
    wound = stored(wind(faces))
    filled = stored(fill_holes(wound, most))
    return outward(vertices, filled.drop("added")).join(filled.select("mesh_id", "fid", "added"), ["mesh_id", "fid"])
