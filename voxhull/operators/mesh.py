"""Mesh derivation (S3, S4, J1, J2, J3, A1, A2, A11, A12 and the library calls of SURVEY 2.12).

Lookups of vertices by face corner are equi-joins on (mesh_id, vid), so many meshes go through one plan; they are shuffled, since
what Spark knows of a table's size before it runs is that of files, and both sides grow with the meshes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cross, dot, named, norm, sub, unit, vec
from .storage import shuffled

X = ("x0", "x1", "x2")


def corners(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces with the coordinates a0..a2, b0..b2, c0..c2 of their corners.

    One join instead of three: corners are exploded, joined once and pivoted back by an aggregate.
    """
    slots = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"v{k}").alias("vid")) for k in range(3)])
    parts = faces.select("mesh_id", "fid", "v0", "v1", "v2", F.explode(slots).alias("s")).select("mesh_id", "fid", "v0", "v1", "v2", "s.k", "s.vid")
    joined = parts.join(shuffled(vertices), ["mesh_id", "vid"])
    cols = [F.max(F.when(F.col("k") == k, F.col(x))).alias(f"{c}{i}") for k, c in enumerate("abc") for i, x in enumerate(X)]
    return joined.groupBy("mesh_id", "fid", "v0", "v1", "v2").agg(*cols)


def face_geometry(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """corners() with area, unit normal n0..n2 and centre g0..g2."""
    c = corners(vertices, faces)
    a, b, d = (vec(*(f"{p}{i}" for i in range(3))) for p in "abc")
    n = cross(sub(b, a), sub(d, a))
    return c.select("*", (norm(n) / 2).alias("area"), *named(unit(n, 0.0), ("n0", "n1", "n2")), *[((a[i] + b[i] + d[i]) / 3).alias(f"g{i}") for i in range(3)])


def edges(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """mesh_id, src < dst, w (length), n_faces for each undirected edge."""
    pair = lambda a, b: F.struct(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"))
    e = faces.select("mesh_id", F.explode(F.array(pair("v0", "v1"), pair("v1", "v2"), pair("v2", "v0"))).alias("e"))
    e = e.groupBy("mesh_id", F.col("e.src").alias("src"), F.col("e.dst").alias("dst")).agg(F.count("*").alias("n_faces"))
    for end, mark in (("src", "p"), ("dst", "q")):
        e = e.join(shuffled(vertices.select("mesh_id", F.col("vid").alias(end), *[F.col(x).alias(f"{mark}{i}") for i, x in enumerate(X)])), ["mesh_id", end])
    return e.select("mesh_id", "src", "dst", norm(sub(vec("p0", "p1", "p2"), vec("q0", "q1", "q2"))).alias("w"), "n_faces")


def graph(edge_table: DataFrame) -> DataFrame:
    """Both directions of every edge."""
    e = edge_table.select("mesh_id", "src", "dst", "w")
    return e.unionByName(e.select("mesh_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def face_adjacency(faces: DataFrame) -> DataFrame:
    """mesh_id, f0 < f1 and the shared edge v0 < v1."""
    pair = lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    side = faces.select("mesh_id", "fid", F.explode(F.array(pair("v0", "v1"), pair("v1", "v2"), pair("v2", "v0"))).alias("e"))
    # an edge has two faces in a closed mesh, so lists are short
    shared = side.groupBy("mesh_id", F.col("e.a").alias("v0"), F.col("e.b").alias("v1")).agg(F.array_sort(F.collect_set("fid")).alias("fs")).where(F.size("fs") >= 2)
    first = shared.select("*", F.posexplode("fs").alias("i", "f0"))
    return first.select("mesh_id", "f0", F.explode(F.slice("fs", F.col("i") + 2, F.size("fs"))).alias("f1"), "v0", "v1")


def watertight(faces: DataFrame) -> DataFrame:
    """S3: per mesh, is every undirected edge in two faces, and is every directed edge used once (consistent winding)?"""
    step = lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), (F.col(a) < F.col(b)).cast("long").alias("up"))
    d = faces.select("mesh_id", F.inline(F.array(step("v0", "v1"), step("v1", "v2"), step("v2", "v0"))))
    # both directions of an edge are told from one aggregate
    und = d.groupBy("mesh_id", "a", "b").agg(F.count("*").alias("n"), F.sum("up").alias("up")).select("mesh_id", "n", F.greatest("up", F.col("n") - F.col("up")).alias("most"))
    return und.groupBy("mesh_id").agg(F.count("*").alias("n_edges"), F.min(F.col("n") == 2).alias("watertight"), F.min(F.col("most") == 1).alias("winding_consistent"))


def bounds(points: DataFrame, *keys: str) -> DataFrame:
    """A1: lo0..lo2, hi0..hi2, diagonal and epsilon = 0.005 * diagonal, in one aggregate."""
    b = points.groupBy(*keys).agg(*[f(x).alias(f"{n}{i}") for n, f in (("lo", F.min), ("hi", F.max)) for i, x in enumerate(X)])
    diagonal = F.sqrt(sum(((F.col(f"hi{i}") - F.col(f"lo{i}")) ** 2 for i in range(1, 3)), (F.col("hi0") - F.col("lo0")) ** 2))
    return b.withColumn("diagonal", diagonal).withColumn("epsilon", F.col("diagonal") * 0.005)


def normalize_mesh(vertices: DataFrame) -> DataFrame:
    """Each mesh moved to its bounds' middle and divided by max of maxima minus min of minima."""
    b = bounds(vertices, "mesh_id").withColumn("extent", F.greatest("hi0", "hi1", "hi2") - F.least("lo0", "lo1", "lo2"))
    j = vertices.join(b, "mesh_id")
    return j.select("mesh_id", "vid", *[F.try_divide(F.col(x) - (F.col(f"lo{i}") + F.col(f"hi{i}")) / 2, F.col("extent")).alias(x) for i, x in enumerate(X)])


def centroid(geometry: DataFrame) -> DataFrame:
    """Area-weighted centre and total area of each mesh's face_geometry."""
    area = F.sum("area")
    return geometry.groupBy("mesh_id").agg(area.alias("area"), *[F.try_divide(F.sum(F.col(f"g{i}") * F.col("area")), area).alias(f"c{i}") for i in range(3)])


def normalize_by_centroid(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Moved to the area-weighted centroid, divided by the bounds' diagonal."""
    c, b = centroid(face_geometry(vertices, faces)), bounds(vertices, "mesh_id").select("mesh_id", "diagonal")
    j = vertices.join(c, "mesh_id").join(b, "mesh_id")
    return j.select("mesh_id", "vid", *[F.try_divide(F.col(x) - F.col(f"c{i}"), F.col("diagonal")).alias(x) for i, x in enumerate(X)])


def vertex_normals(geometry: DataFrame) -> DataFrame:
    """Mean of incident face normals weighted by area, of length 1."""
    e = geometry.select("mesh_id", F.explode(F.array("v0", "v1", "v2")).alias("vid"), *[(F.col(f"n{i}") * F.col("area")).alias(f"w{i}") for i in range(3)])
    s = e.groupBy("mesh_id", "vid").agg(*[F.sum(f"w{i}").alias(f"w{i}") for i in range(3)])
    return s.select("mesh_id", "vid", *named(unit(vec("w0", "w1", "w2"), 1e-300), ("n0", "n1", "n2")))


def patch_faces(faces: DataFrame, patch: DataFrame) -> DataFrame:
    """Pid, fid of faces with any corner in the patch(pid, vid)."""
    e = faces.select("fid", F.explode(F.array("v0", "v1", "v2")).alias("vid"))
    return e.join(shuffled(patch), "vid").select("pid", "fid").distinct()


def sample_count(area: Column, per_area: int = 5000, least: int = 30, most: int = 600) -> Column:
    """A2."""
    return F.least(F.greatest(F.floor(area * per_area), F.lit(least)), F.lit(most)).cast("int")


def region_summary(geometry: DataFrame, regions: DataFrame) -> DataFrame:
    """Per region(fid, region) its area, share of all area, faces and area-weighted mean unit normal."""
    j = geometry.join(shuffled(regions), "fid")
    total = geometry.agg(F.sum("area").alias("total"))  # one row
    s = j.groupBy("region").agg(F.sum("area").alias("area"), F.count("*").alias("n_faces"), *[F.sum(F.col(f"n{i}") * F.col("area")).alias(f"s{i}") for i in range(3)])
    n = unit(vec("s0", "s1", "s2"), 1e-300)
    return s.join(F.broadcast(total), F.lit(True)).select("region", "area", "n_faces", F.try_divide("area", "total").alias("share"), *named(n, ("n0", "n1", "n2")))


def region_edge_length(vertices: DataFrame, faces: DataFrame, regions: DataFrame) -> DataFrame:
    """Mean length of the region's faces' first edges, and alpha = 1 / (2 mean)."""
    c = corners(vertices, faces).join(shuffled(regions), "fid")
    length = norm(sub(vec("b0", "b1", "b2"), vec("a0", "a1", "a2")))
    return c.groupBy("region").agg(F.avg(length).alias("mean_edge")).withColumn("alpha", F.try_divide(F.lit(0.5), F.col("mean_edge")))


def dihedral_bend(geometry: DataFrame, adjacency: DataFrame) -> DataFrame:
    """1 - n1.n2 for each pair of adjacent faces."""
    n = geometry.select("mesh_id", "fid", "n0", "n1", "n2")
    j = adjacency.join(shuffled(n.select("mesh_id", F.col("fid").alias("f0"), *[F.col(f"n{i}").alias(f"p{i}") for i in range(3)])), ["mesh_id", "f0"])
    j = j.join(shuffled(n.select("mesh_id", F.col("fid").alias("f1"), *[F.col(f"n{i}").alias(f"q{i}") for i in range(3)])), ["mesh_id", "f1"])
    return j.select("mesh_id", "f0", "f1", "v0", "v1", (F.lit(1.0) - dot(vec("p0", "p1", "p2"), vec("q0", "q1", "q2"))).alias("bend"))


