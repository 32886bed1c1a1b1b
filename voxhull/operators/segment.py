"""Segmentation (A3 to A8, P26, G4, G13): curvature, seed counts, regions and patches."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cross, curvedness, dot, norm, sub, vec
from . import graphs, mesh
from .quantiles import percentiles
from .storage import shuffled, stored


def curvature_weights(geometry: DataFrame, adjacency: DataFrame, vertices: DataFrame, alpha: float = 5.0) -> DataFrame:
    """A3: mesh_id, vid, w = 1 + alpha * c, c the mean bend of edges at the vertex over the mesh's largest; isolated ones 1."""
    bend = mesh.dihedral_bend(geometry, adjacency)
    at = bend.select("mesh_id", F.explode(F.array("v0", "v1")).alias("vid"), "bend").groupBy("mesh_id", "vid").agg(F.avg("bend").alias("c"))
    most = at.groupBy("mesh_id").agg(F.max("c").alias("most"))
    j = vertices.select("mesh_id", "vid").join(shuffled(at), ["mesh_id", "vid"], "left").join(most, "mesh_id", "left")
    return j.select("mesh_id", "vid", (F.lit(1.0) + F.coalesce(F.when(F.col("most") > 0, F.col("c") / F.col("most")).otherwise(0.0), F.lit(0.0)) * alpha).alias("w"))


def even_seeds(n: Column) -> Column:
    """At least two, and even, upward."""
    n = F.greatest(n.cast("int"), F.lit(2))
    return n + n % 2


def patch_capacity(area: Column, degree: int = 4, tolerance: float = 1e-3) -> Column:
    """A6."""
    return area / 20.0 * degree * tolerance


def seed_estimate(geometry: DataFrame, adjacency: DataFrame, degree: int = 4, tolerance: float = 1e-3) -> DataFrame:
    """A4 with A6 and A7: mesh_id, total and median bend, n_edges, area, n_seeds."""
    bend = stored(mesh.dihedral_bend(geometry, adjacency).select("mesh_id", "bend"))
    total = bend.groupBy("mesh_id").agg(F.sum("bend").alias("total"), F.count("*").alias("n_edges"))
    area = geometry.groupBy("mesh_id").agg(F.sum("area").alias("area"))
    j = total.join(percentiles(bend, ["mesh_id"], "bend", {"median": 0.5}), "mesh_id").join(area, "mesh_id")
    per_edge = patch_capacity(F.col("area"), degree, tolerance) * F.col("n_edges") / F.col("area")
    return j.withColumn("n_seeds", even_seeds(F.ceil(F.col("total") / per_edge)))


def vertex_curvature(geometry: DataFrame, vertices: DataFrame) -> DataFrame:
    """mesh_id, vid, gauss (angle defect), mean (half the sum of edge length times signed bend angle over two), k1, k2, curvedness."""
    a, b, c = (vec(*(f"{p}{i}" for i in range(3))) for p in "abc")

    def angle(p, q, r):
        u, v = sub(q, p), sub(r, p)
        return F.atan2(norm(cross(u, v)), dot(u, v))

    slots = F.array(F.struct(F.col("v0").alias("vid"), angle(a, b, c).alias("t")), F.struct(F.col("v1").alias("vid"), angle(b, c, a).alias("t")), F.struct(F.col("v2").alias("vid"), angle(c, a, b).alias("t")))
    defect = geometry.select("mesh_id", F.explode(slots).alias("s")).groupBy("mesh_id", F.col("s.vid").alias("vid")).agg((F.lit(2 * np.pi) - F.sum("s.t")).alias("gauss"))
    sides = []
    for p, q, o in (("v0", "v1", "v2"), ("v1", "v2", "v0"), ("v2", "v0", "v1")):
        pa, pb = "abc"[int(p[1])], "abc"[int(q[1])]
        sides.append(F.struct(F.least(p, q).alias("lo"), F.greatest(p, q).alias("hi"), F.col("fid"), *[F.col(f"n{i}") for i in range(3)], *[F.col(f"g{i}") for i in range(3)], norm(sub(vec(*(f"{pa}{i}" for i in range(3))), vec(*(f"{pb}{i}" for i in range(3))))).alias("len")))
    e = geometry.select("mesh_id", F.explode(F.array(*sides)).alias("e")).groupBy("mesh_id", "e.lo", "e.hi").agg(F.min("e").alias("p"), F.max("e").alias("q")).where("p.fid <> q.fid")
    np_, nq = tuple(F.col(f"p.n{i}") for i in range(3)), tuple(F.col(f"q.n{i}") for i in range(3))
    across = tuple(F.col(f"q.g{i}") - F.col(f"p.g{i}") for i in range(3))
    turn = F.atan2(norm(cross(np_, nq)), dot(np_, nq)) * F.when(dot(np_, across) <= 0, 1.0).otherwise(-1.0)
    bent = e.select("mesh_id", F.explode(F.array("lo", "hi")).alias("vid"), (turn * F.col("p.len") / 4).alias("h")).groupBy("mesh_id", "vid").agg(F.sum("h").alias("mean"))
    j = vertices.select("mesh_id", "vid").join(shuffled(defect), ["mesh_id", "vid"], "left").join(shuffled(bent), ["mesh_id", "vid"], "left").fillna(0.0, ["gauss", "mean"])

    k1, k2, c = curvedness(F.col("mean"), F.col("gauss"))
    return j.select("*", k1.alias("k1"), k2.alias("k2"), c.alias("curvedness"))


def seed_estimate_accurate(geometry: DataFrame, vertices: DataFrame, degree: int = 4, tolerance: float = 1e-3) -> DataFrame:
    """A5 with A6 and A7."""
    c = stored(vertex_curvature(geometry, vertices).select("mesh_id", "curvedness"))
    middle = percentiles(c, ["mesh_id"], "curvedness", {"median": 0.5, "p95": 0.95}).join(c.groupBy("mesh_id").agg(F.avg("curvedness").alias("mean")), "mesh_id")
    j = middle.select("mesh_id", "median", "mean", "p95").join(geometry.groupBy("mesh_id").agg(F.sum("area").alias("area")), "mesh_id")
    return j.withColumn("n_seeds", even_seeds(F.ceil(F.col("median") * F.col("area") / patch_capacity(F.col("area"), degree, tolerance))))


def patch_radius(area: Column, n_seeds: Column, overlap: float = 0.25) -> Column:
    """A8."""
    return F.sqrt(area / n_seeds / np.pi) * (1.0 + overlap)


#: Faces that may grow in one task; larger sets of faces that could meet in a region grow in chunks of about as many.
TOGETHER = 1 << 18
#: Faces, about so many, of small sets that grow in one call.
_BATCH = 1 << 15
_N = ("n0", "n1", "n2")


def _grown(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """G4 in one task: rows of faces (face, fid, n0..n2) and of links between them (not face, fid, f1)."""
    faces = pdf[pdf.face].sort_values("fid")
    ids, normals = faces.fid.to_numpy(), faces[list(_N)].to_numpy()
    at = {f: i for i, f in enumerate(ids)}
    near: list[list[int]] = [[] for _ in ids]
    pairs = pdf[~pdf.face]
    for f, g in zip(pairs.fid, pairs.f1):
        near[at[f]].append(at[g])
        near[at[g]].append(at[f])
    region = np.full(len(ids), -1)
    for seed in range(len(ids)):
        if region[seed] >= 0:
            continue
        stack, region[seed] = [seed], seed
        while stack:
            for j in near[stack.pop()]:
                if region[j] < 0 and abs(normals[j] @ normals[seed]) >= least:
                    region[j] = seed
                    stack.append(j)
    return pd.DataFrame({"mesh_id": pdf.mesh_id.iloc[0], "fid": ids, "region": ids[region]})


_S = ("s0", "s1", "s2")
_GROWN = "mesh_id string, chunk int, fid long, region long, s0 double, s1 double, s2 double, lost long"


def _in_chunk(pdf: pd.DataFrame, known: pd.DataFrame, least: float) -> pd.DataFrame:
    """G4 in a chunk: regions in the order of their seeds, those of faces of its own and those that come in. pdf: rows of faces and of links within
    the chunk (face, fid, n0..n2, f1); known: where regions come in (enters, fid, region, s0..s2), and the regions that faces had before."""
    faces = pdf[pdf.face].sort_values("fid")
    ids, normals = faces.fid.tolist(), list(zip(*(faces[c].tolist() for c in _N)))
    own = faces.fid.to_numpy()
    near: list[list[int]] = [[] for _ in ids]
    pairs = pdf[~pdf.face]
    for i, j in zip(np.searchsorted(own, pairs.fid.to_numpy()).tolist(), np.searchsorted(own, pairs.f1.to_numpy()).tolist()):
        near[i].append(j)
        near[j].append(i)
    coming = known[known.enters].sort_values("region", kind="stable")
    enter: dict[int, list[int]] = {}
    about: dict[int, tuple] = {}
    for i, r, *n in zip(np.searchsorted(own, coming.fid.to_numpy()).tolist(), coming.region.tolist(), *(coming[c].tolist() for c in _S)):
        enter.setdefault(r, []).append(i)
        about[r] = tuple(n)
    at = {r: int(i) for r, i in zip(enter, np.searchsorted(own, list(enter)))}
    seeds = [(r, i if i < len(ids) and ids[i] == r else -1) for r, i in at.items()]
    seeds = sorted({*seeds, *zip(ids, range(len(ids)))})
    region: list[int] = [-1] * len(ids)
    for r, i in seeds:
        if i >= 0:
            if region[i] >= 0:
                continue  # it has a region of lesser number, and so isn't a seed
            stack, (a, b, c) = [i], normals[i]
            about[r] = normals[i]
            region[i] = r
        else:
            stack, (a, b, c) = [], about[r]
        for j in enter.get(r, ()):
            if region[j] < 0:
                region[j] = r
                stack.append(j)
        while stack:
            for j in near[stack.pop()]:
                if region[j] < 0:
                    n = normals[j]
                    if abs(a * n[0] + b * n[1] + c * n[2]) >= least:
                        region[j] = r
                        stack.append(j)
    out = np.array(region, np.int64)
    held = known[~known.enters]
    lost = np.full(len(ids), -1, np.int64)
    lost[np.searchsorted(own, held.fid.to_numpy())] = held.region.to_numpy()
    lost[lost == out] = -1
    of = np.array([about[r] for r in region])
    return pd.DataFrame({"mesh_id": pdf.mesh_id.iloc[0], "chunk": pdf.chunk.iloc[0], "fid": own, "region": out, "s0": of[:, 0], "s1": of[:, 1], "s2": of[:, 2], "lost": pd.array(lost, "Int64").copy()})


def _rounds(faces: DataFrame, links: DataFrame, least: float, together: int = TOGETHER) -> DataFrame:
    """G4 of faces(mesh_id, fid, n0..n2) and links(mesh_id, f0, f1) in chunks of about ``together`` faces each, by ranges of fid.

    A chunk grows its regions in the order of their seeds, and hands them on over the links to other chunks. What comes in anew or no more makes a
    chunk grow again from nothing. A region that lost a face anywhere is first taken back from all chunks but its seed's, so that none is kept
    up by its own traces alone. By then what settles is the result of the order: the regions of all seeds before one settle, then its own. Rounds
    follow the chunks that a chain of regions crosses; those to which nothing new comes rest.
    """
    n = max(1, -(-faces.count() // max(together, 16)))
    placed = stored(faces.repartitionByRange(n, "mesh_id", "fid").select("mesh_id", F.spark_partition_id().alias("chunk"), "fid", *_N))
    end = lambda f, *rest: placed.select("mesh_id", F.col("chunk").alias(f"c{f[1]}"), F.col("fid").alias(f), *rest)
    met = stored(links.join(end("f0", *[F.col(x).alias(f"p{i}") for i, x in enumerate(_N)]), ["mesh_id", "f0"]).join(end("f1", *[F.col(x).alias(f"q{i}") for i, x in enumerate(_N)]), ["mesh_id", "f1"]))
    rows = placed.select("mesh_id", "chunk", F.lit(True).alias("face"), "fid", *_N, F.lit(0).cast("long").alias("f1"))
    rows = stored(rows.unionByName(met.where("c0 = c1").select("mesh_id", F.col("c0").alias("chunk"), F.lit(False).alias("face"), F.col("f0").alias("fid"), *[F.lit(0.0).alias(x) for x in _N], "f1")))
    across = met.where("c0 <> c1")
    one = across.select("mesh_id", F.col("f0").alias("fid"), F.col("c1").alias("chunk"), F.col("f1").alias("to"), *[F.col(f"q{i}").alias(x) for i, x in enumerate(_N)])
    across = stored(one.unionByName(across.select("mesh_id", F.col("f1").alias("fid"), F.col("c0").alias("chunk"), F.col("f0").alias("to"), *[F.col(f"p{i}").alias(x) for i, x in enumerate(_N)])))
    place = ["mesh_id", "chunk"]

    def run(f: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        return _in_chunk(f, known, least) if len(f) else pd.DataFrame({c.split()[0]: [] for c in _GROWN.split(", ")})

    def grown(own: DataFrame, coming: DataFrame, before: DataFrame) -> DataFrame:
        cols = (*place, "fid", "region", *_S)
        known = coming.select(F.lit(True).alias("enters"), *cols).unionByName(before.select(F.lit(False).alias("enters"), *cols))
        return own.groupBy(*place).cogroup(known.groupBy(*place)).applyInPandas(run, _GROWN)

    none = placed.limit(0).select(*place, "fid", F.col("fid").alias("region"), *[F.col(x).alias(y) for x, y in zip(_N, _S)])
    label, came = stored(grown(rows, none, none).drop("lost")), stored(none)
    gone = stored(came.select("mesh_id", "region"))
    while True:
        reached = across.join(label.select("mesh_id", "fid", "region", *_S), ["mesh_id", "fid"]).where((F.abs(dot(vec(*_S), vec(*_N))) >= least) & (F.col("to") > F.col("region")))
        coming = stored(reached.join(gone, ["mesh_id", "region"], "left_anti").select(*place, F.col("to").alias("fid"), "region", *_S).dropDuplicates([*place, "fid", "region"]))
        key = (*place, "fid", "region")
        differs = came.select(*key).unionByName(coming.select(*key)).groupBy(*key).agg(F.count("*").alias("n")).where("n = 1")
        again = stored(differs.select(*place).distinct())
        if again.limit(1).count() == 0:
            return label.select("mesh_id", "fid", "region")
        active = lambda t: t.join(F.broadcast(again), place, "left_semi")  # noqa: E731  # a row a chunk
        after = stored(grown(active(rows), active(coming), active(label)))
        # a region that was just taken back has lost its faces by that, and stands on its seed alone
        lost = after.where("lost >= 0").select("mesh_id", F.col("lost").alias("region")).distinct().join(gone, ["mesh_id", "region"], "left_anti")
        gone = stored(lost.join(coming, ["mesh_id", "region"], "left_semi"))
        label = stored(label.join(F.broadcast(again), place, "left_anti").unionByName(after.drop("lost")))
        came = coming


def _batch(sets: DataFrame) -> Column:
    """The call in which a set of sets(mesh_id, part, size), a row a face, size 1 for any of a few faces, grows: those of a few faces share one by the thousand, as none touches another."""
    n = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sets.count() // _BATCH))
    return F.when(F.col("size") <= _BATCH // 8, F.expr(f"pmod(xxhash64(mesh_id, part), {n})")).otherwise(-1 - F.col("part"))


def grow_regions(geometry: DataFrame, adjacency: DataFrame, least: float = 0.998, together: int = TOGETHER) -> DataFrame:
    """mesh_id, fid, region (its seed, the face of least number). A face joins the region whose seed's normal it shares up to sign, faces taken
    as seeds in order of fid; the result is that of this order.

    Faces of a region differ by twice its angle at most, so sets that are connected by such neighbours grow apart from each other: those of at most
    ``together`` faces in a task each, larger ones in chunks of about as many (_rounds).
    """
    n = geometry.select("mesh_id", "fid", *_N)
    p, q = (n.select("mesh_id", F.col("fid").alias(f), *[F.col(x).alias(f"{c}{i}") for i, x in enumerate(_N)]) for f, c in (("f0", "p"), ("f1", "q")))
    widest = np.cos(min(np.pi / 2, 2 * np.arccos(min(1.0, least)) + 1e-9))
    links = adjacency.select("mesh_id", "f0", "f1").join(shuffled(p), ["mesh_id", "f0"]).join(shuffled(q), ["mesh_id", "f1"]).where(F.abs(dot(vec("p0", "p1", "p2"), vec("q0", "q1", "q2"))) >= widest).select("mesh_id", "f0", "f1")
    links = stored(links)
    node = lambda f: F.struct("mesh_id", F.col(f).alias("fid"))
    sets = graphs.components(n.select(node("fid").alias("node")), links.select(node("f0").alias("a"), node("f1").alias("b"))).select("node.mesh_id", "node.fid", F.col("component.fid").alias("part"))
    # sizes of sets that are not small alone: a row for some thousands of faces at most, where sets of a few faces would have a row each
    sizes = sets.groupBy("mesh_id", "part").agg(F.count("*").alias("size")).where(F.col("size") > min(_BATCH // 8, together))
    sets = sets.join(F.broadcast(sizes), ["mesh_id", "part"], "left").withColumn("size", F.coalesce("size", F.lit(1)))
    dealt = stored(n.join(shuffled(sets), ["mesh_id", "fid"]))
    linked = links.join(shuffled(dealt.select("mesh_id", F.col("fid").alias("f0"), "part", "size")), ["mesh_id", "f0"])
    small = F.col("size") <= together
    batch = _batch(dealt.where(small)).alias("batch")
    rows = dealt.where(small).select("mesh_id", batch, F.lit(True).alias("face"), "fid", *_N, F.lit(0).cast("long").alias("f1"))
    rows = rows.unionByName(linked.where(small).select("mesh_id", batch, F.lit(False).alias("face"), F.col("f0").alias("fid"), *[F.lit(0.0).alias(x) for x in _N], "f1"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _grown(pdf, least)

    out = rows.groupBy("mesh_id", "batch").applyInPandas(run, "mesh_id string, fid long, region long")
    if dealt.where(~small).limit(1).count():
        out = out.unionByName(_rounds(dealt.where(~small).select("mesh_id", "fid", *_N), stored(linked.where(~small).select("mesh_id", "f0", "f1")), least, together))
    return out


def flat_components(geometry: DataFrame, adjacency: DataFrame, least: float = 0.998) -> DataFrame:
    """The relaxed form of G4 for very large meshes: components of faces over edges across which normals agree. It differs
    from G4 where normals drift slowly along a chain of faces.
    """
    bend = mesh.dihedral_bend(geometry, adjacency).where(F.abs(F.lit(1.0) - F.col("bend")) >= least)
    return graphs.components(geometry.select(F.col("fid").alias("node")), bend.select(F.col("f0").alias("a"), F.col("f1").alias("b"))).select(F.col("node").alias("fid"), F.col("component").alias("region"))


def segment_mesh(vertices: DataFrame, faces: DataFrame, n_seeds: int | None = None, strategy: str = "radius", curvature_weighted: bool = True, overlap: float = 0.25) -> dict:
    """Seeds, dist(seed_rank, vid, d), patch(pid, vid), adjacency(i, j, overlap, n), radius of one mesh.

    The first seed is the vertex nearest the area-weighted centroid. strategy: radius or voronoi, else ValueError;
    Voronoi cells don't overlap, so patches that touch along an edge are given as adjacent with an empty overlap.
    """
    if strategy not in ("radius", "voronoi"):
        raise ValueError(f"unknown strategy: {strategy}")
    geometry = mesh.face_geometry(vertices, faces).persist()
    adjacency = mesh.face_adjacency(faces)
    if n_seeds is None:
        n_seeds = seed_estimate(geometry, adjacency).first().n_seeds
    edges = mesh.edges(vertices, faces).persist()
    c = mesh.centroid(geometry).first()
    d = norm(sub(vec("x0", "x1", "x2"), tuple(F.lit(c[f"c{i}"]) for i in range(3))))
    first = vertices.agg(F.min(F.struct(d.alias("d"), "vid")).alias("m")).first().m.vid
    weights = curvature_weights(geometry, adjacency, vertices).select("vid", "w") if curvature_weighted else None
    seeds, dist = graphs.farthest_points(mesh.graph(edges), first, n_seeds, weights)
    radius = float(np.sqrt(c.area / len(seeds) / np.pi) * (1 + overlap))
    if strategy == "radius":
        patch = graphs.radius_patches(dist, radius)
        adjacent = graphs.patch_overlaps(patch)
    else:
        patch = graphs.voronoi(dist).select("pid", "vid")
        p, q = patch.select(F.col("pid").alias("p"), F.col("vid").alias("src")), patch.select(F.col("pid").alias("q"), F.col("vid").alias("dst"))
        touch = edges.join(p, "src").join(q, "dst").where("p <> q").select(F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j")).distinct()
        adjacent = touch.select("i", "j", F.array().cast("array<bigint>").alias("overlap"), F.lit(0).cast("long").alias("n"))
    return {"seeds": seeds, "dist": dist, "patch": patch, "adjacency": adjacent, "radius": radius}


