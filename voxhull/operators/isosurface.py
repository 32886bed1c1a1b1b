"""Iso-surfaces (S9, V6 to V9): the mesh where a field on a lattice is zero, by marching tetrahedra.

A cell of the lattice is cut into six tetrahedra along its diagonal, the same way in every cell, so neighbours meet without gaps. A vertex of
the mesh lies on an edge of the lattice, and that edge is its number: vertices need no merging by position, and a face is made
from its cell alone. Cells that the surface doesn't cross are dropped before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import Vec, cross, dot, norm, sub, vec
from .mesh import corners

#: Places on an axis of the lattice: places are numbered, 19 bits an axis, so that vertex and face numbers fit 64.
SIDE = 1 << 19
#: Cells along a side of what a task makes at once.
BRICK = 16
#: Corner c of a cell lies ahead on axis i where bit i of c is set. A tetrahedron goes from corner 0 to 7, an axis at a time.
TETRAHEDRA = tuple((0, 1 << p, (1 << p) | (1 << q), 7) for p, q, _ in permutations(range(3)))
_OFFSET = tuple(sum(SIDE ** (2 - i) * (c >> i & 1) for i in range(3)) for c in range(8))

Edge = tuple[int, int]


def _faces(tetrahedron: Sequence[int], inside: Sequence[int]) -> list[tuple[Edge, Edge, Edge]]:
    """The faces between the corners inside and the others, as edges of the cell, turned to the others."""
    outside = [c for c in tetrahedron if c not in inside]
    edge = lambda a, b: (min(a, b), max(a, b))
    if len(inside) == 2:
        (a, b), (c, d) = inside, outside
        ring = [edge(a, c), edge(a, d), edge(b, d), edge(b, c)]
    else:
        (one,), rest = (inside, outside) if len(inside) == 1 else (outside, inside)
        ring = [edge(one, c) for c in rest]
    at = lambda c: [c >> i & 1 for i in range(3)]
    mid = lambda e: [(x + y) / 2 for x, y in zip(at(e[0]), at(e[1]))]
    mean = lambda cs: [sum(x) / len(cs) for x in zip(*map(at, cs))]
    p, q, r = (mid(e) for e in ring[:3])
    u, v = [y - x for x, y in zip(p, q)], [y - x for x, y in zip(p, r)]
    normal = [u[(i + 1) % 3] * v[(i + 2) % 3] - u[(i + 2) % 3] * v[(i + 1) % 3] for i in range(3)]
    if sum(n * (y - x) for n, x, y in zip(normal, mean(inside), mean(outside))) < 0:
        ring.reverse()
    return [(ring[0], ring[k], ring[k + 1]) for k in range(1, len(ring) - 1)]


def _cases(spark: SparkSession) -> DataFrame:
    """t, m, faces: of each tetrahedron and each set of its corners inside, as bits of m, the faces; 84 rows."""
    rows = []
    for t, tetrahedron in enumerate(TETRAHEDRA):
        for m in range(1, 15):
            faces = _faces(tetrahedron, [c for b, c in enumerate(tetrahedron) if m >> b & 1])
            rows.append((t, m, [(q, list(f)) for q, f in enumerate(faces)]))
    return spark.createDataFrame(rows, "t int, m int, faces array<struct<q:int,edges:array<struct<lo:int,hi:int>>>>")


def cells_of_field(spark: SparkSession, places: Sequence[int], lo: Sequence[float], step: Sequence[float], field: Callable[[Vec], Column]) -> DataFrame:
    """cell, i, j, k, f: the cells of a lattice of so many places an axis, and the field at their eight corners. No shuffle."""
    n = [p - 1 for p in places]
    g = spark.range(n[0] * n[1] * n[2])
    at = g.select(F.expr(f"id div {n[1] * n[2]}").alias("i"), F.expr(f"id div {n[2]} % {n[1]}").alias("j"), F.expr(f"id % {n[2]}").alias("k"))
    place = lambda c: tuple(F.lit(float(lo[x])) + (F.col(a) + (c >> x & 1)) * float(step[x]) for x, a in enumerate("ijk"))
    return _numbered(at.select("i", "j", "k", F.array(*[field(place(c)) for c in range(8)]).alias("f")))


def cells_of_values(values: DataFrame, missing: float | None = None) -> DataFrame:
    """The same of values(i, j, k, f), whole numbers from 1 to 2**19 - 2 an axis, one row a place.

    A place without a value, or with a null or NaN one, has ``missing``; if that is None, cells with such a corner are left out. Places go to bricks of
    cells, those on a brick's rim to the bricks beside it too, and cells of which no corner has a value are never made.
    """
    real = values.where(F.col("f").isNotNull() & ~F.isnan("f")).where(" and ".join(f"{a} between 1 and {SIDE - 2}" for a in "ijk"))
    # a place lies in the brick of its own cell, and at a brick's first places in that of the cells before
    first = lambda a: F.when(F.col(a) % BRICK == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = real.select(*[F.col(a).cast("long").alias(a) for a in "ijk"], F.col("f").cast("double").alias("f"))
    for n, a in enumerate("ijk"):
        rows = rows.select("*", F.explode(first(a)).alias("back")).withColumn(f"b{n}", F.expr(f"{a} div {BRICK} - back")).drop("back")
    local = " + ".join(f"({a} - b{n} * {BRICK}) * {(BRICK + 1) ** (2 - n)}" for n, a in enumerate("ijk"))
    rows = rows.select(F.expr(f"(b0 * {SIDE} + b1) * {SIDE} + b2").alias("brick"), F.expr(local).cast("int").alias("at"), "f")

    def run(table: pa.Table) -> pa.Table:
        n = BRICK + 1
        brick, at, f = table["brick"][0].as_py(), table["at"].to_numpy(), table["f"].to_numpy()
        value, known = np.full(n**3, -np.inf), np.zeros(n**3, bool)
        np.maximum.at(value, at, f)
        known[at] = True
        if missing is not None:
            value[~known] = missing
        value, known = value.reshape(n, n, n), known.reshape(n, n, n)
        part = lambda x, c: x[tuple(slice(c >> a & 1, BRICK + (c >> a & 1)) for a in range(3))]
        have = sum(part(known, c).astype(int) for c in range(8))
        use = np.nonzero(have == 8 if missing is None else have > 0)
        base = [brick // SIDE**2 * BRICK, brick // SIDE % SIDE * BRICK, brick % SIDE * BRICK]
        corners = np.stack([part(value, c)[use] for c in range(8)], 1)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, corners.size + 1, 8), pa.int32()), pa.array(corners.ravel()))
        return pa.table({**{a: pa.array((use[x] + base[x]).astype(np.int64)) for x, a in enumerate("ijk")}, "f": flat})

    # few bytes become many cells and faces: by its bytes the table would be one task
    rows = rows.repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), "brick")
    return _numbered(rows.groupBy("brick").applyInArrow(run, "i long, j long, k long, f array<double>"))


def _numbered(cells: DataFrame) -> DataFrame:
    return cells.select(((F.col("i") * SIDE + F.col("j")) * SIDE + F.col("k")).alias("cell"), "i", "j", "k", "f")


def _cut(cells: DataFrame) -> DataFrame:
    """cell, i, j, k, f, t, q, edges: a row for each face, made in its cell."""
    signs = F.transform("f", lambda x: (x < 0).cast("int"))
    crossed = cells.withColumn("s", signs).where(F.array_contains("s", 0) & F.array_contains("s", 1))
    masks = F.array(*[F.struct(F.lit(t).alias("t"), sum((F.col("s")[c] * (1 << b) for b, c in enumerate(corner)), F.lit(0)).alias("m")) for t, corner in enumerate(TETRAHEDRA)])
    cut = crossed.select("cell", "i", "j", "k", "f", F.inline(masks)).where("m between 1 and 14").join(F.broadcast(_cases(cells.sparkSession)), ["t", "m"])
    return cut.select("cell", "i", "j", "k", "f", "t", F.inline("faces"))


def _joints(mask: int) -> tuple[int, int, int, list[int]]:
    """Of a cell with the corners of mask inside: the edges of its faces that two of them share, how many of these fail (not two faces, or both the
    same way round), and the rest by sides: of side 2 * axis + bit the edges on it, six bits for one way round and six for the other."""
    ways: dict = {}
    for tetrahedron in TETRAHEDRA:
        inside = [c for c in tetrahedron if mask >> c & 1]
        for ring in _faces(tetrahedron, inside) if 0 < len(inside) < 4 else []:
            for a, b in zip(ring, (*ring[1:], ring[0])):
                ways.setdefault((min(a, b), max(a, b)), []).append(a < b)
    inner, open_, turned, sides = 0, 0, 0, [0] * 6
    for (a, b), way in ways.items():
        on = [(x, c) for x in range(3) for c in (0, 1) if all(e >> x & 1 == c for e in (*a, *b))]
        if len(way) == 1 and len(on) == 1:
            x, c = on[0]
            sides[2 * x + c] |= 1 << (_SEGMENTS[x].index(tuple(tuple(e & ~(1 << x) for e in v) for v in (a, b))) + 6 * way[0])
        else:
            inner, open_, turned = inner + 1, open_ + (len(way) != 2), turned + (len(set(way)) != len(way))
    return inner, open_, turned, sides


def _segments(x: int) -> list[tuple[Edge, Edge]]:
    """The six places of a mesh's edge on a side across axis x, three in each of its triangles, between the lattice's edges there."""
    p, q = (1 << a for a in range(3) if a != x)
    return [pair for m in (p, q) for pair in ((min(a, b), max(a, b)) for a, b in (((0, m), (0, p | q)), ((0, m), (m, p | q)), ((0, p | q), (m, p | q))))]


_SEGMENTS = [_segments(x) for x in range(3)]


def measured(cells: DataFrame, lo: Sequence[float], step: Sequence[float]) -> DataFrame:
    """n_vertices, n_faces, n_edges, watertight, winding_consistent, area and volume of surface(cells), of which neither vertices nor faces are shuffled.

    For cells_of_values with ``missing``, where each crossed edge of the lattice is in the cell of its lower end: a vertex counts there. What a cell's faces share
    within it follows from the signs of its corners; what they share with another cell meets it by the side between the two. A surface without faces has no row.
    """
    spark = cells.sparkSession
    mask = F.expr("aggregate(transform(f, (x, c) -> if(x < 0, shiftleft(1, c), 0)), 0, (a, b) -> a | b)")
    crossed = cells.select("cell", mask.alias("mask")).where("mask between 1 and 254")
    kinds = [(m, sum((m ^ m >> d) & 1 for d in range(1, 8)), *_joints(m)) for m in range(1, 255)]
    table = F.broadcast(spark.createDataFrame(kinds, "mask int, here int, inner int, open int, turned int, sides array<int>"))
    known = crossed.join(table, "mask")
    whole = known.agg(F.sum("here").alias("n_vertices"), F.sum("inner").alias("inner"), F.sum("open").alias("open"), F.sum("turned").alias("turned"))
    ahead = F.array(*[F.struct((F.col("cell") * 3 + x + (3 * SIDE ** (2 - x) if c else 0)).alias("side"), F.shiftleft(F.col("sides")[2 * x + c], 12 * c).alias("code")) for x in range(3) for c in (0, 1)])
    met = known.select(F.inline(ahead)).where("code <> 0").groupBy("side").agg(F.bit_or("code").alias("code"))
    met = met.select(F.expr("code & 4095").alias("p"), F.expr("shiftright(code, 12)").alias("q"))
    either = lambda c: F.expr(f"({c} | shiftright({c}, 6)) & 63")
    met = met.select("p", "q", either("p").alias("a"), either("q").alias("b"), either("(p & q)").alias("same"))
    shared = met.agg(F.sum(F.expr("bit_count(a | b)")).alias("edges"), F.max(F.expr("a <> b")).alias("gap"), F.max(F.expr("same <> 0")).alias("against"))
    at = lambda e, x: F.lit(float(lo[x])) + (F.col("ijk"[x]) + F.shiftright(e["lo"], x).bitwiseAND(F.lit(1)) + _along(e) * (F.shiftright(e["hi"], x).bitwiseAND(F.lit(1)) - F.shiftright(e["lo"], x).bitwiseAND(F.lit(1)))) * float(step[x])
    placed = _cut(cells).select(*[at(F.col("edges")[n], x).alias(f"{c}{x}") for n, c in enumerate("abc") for x in range(3)])
    a, b, c = (vec(*(f"{p}{x}" for x in range(3))) for p in "abc")
    size = placed.agg(F.count("*").alias("n_faces"), (F.sum(norm(cross(sub(b, a), sub(c, a)))) / 2).alias("area"), (F.sum(dot(a, cross(b, c))) / 6).alias("volume"))
    out = whole.join(shared, F.lit(True)).join(size, F.lit(True)).where("n_faces > 0")  # one row each
    n_edges = (F.col("inner") + F.coalesce("edges", F.lit(0))).alias("n_edges")
    tight = ((F.col("open") == 0) & ~F.coalesce("gap", F.lit(False))).alias("watertight")
    wound = ((F.col("turned") == 0) & ~F.coalesce("against", F.lit(False))).alias("winding_consistent")
    return out.select("n_vertices", "n_faces", n_edges, tight, wound, "area", "volume")


def _along(e: Column) -> Column:
    a, b = F.col("f")[e["lo"]], F.col("f")[e["hi"]]
    return a / (a - b)


def surface(cells: DataFrame, lo: Sequence[float], step: Sequence[float], mesh_id: str = "surface") -> tuple[DataFrame, DataFrame]:
    """vertices(mesh_id, vid, x0, x1, x2) and faces(mesh_id, fid, v0, v1, v2) where f crosses zero, turned to where it is positive.

    The inside is where f < 0. Place (i, j, k) lies at lo + step * (i, j, k), and along an edge the field counts as linear. The mesh is closed
    wherever the surface doesn't leave the cells.
    """
    faces = _cut(cells)
    offset = F.array(*[F.lit(o).cast("long") for o in _OFFSET])
    vid = lambda e: (F.col("cell") + offset[e["lo"]]) * 8 + (e["hi"] - e["lo"])
    name = F.lit(mesh_id).alias("mesh_id")
    out = faces.select(name, ((F.col("cell") * 6 + F.col("t")) * 2 + F.col("q")).alias("fid"), *[vid(F.col("edges")[n]).alias(f"v{n}") for n in range(3)])
    ends = faces.select("cell", "i", "j", "k", "f", F.explode("edges").alias("e")).select("cell", "i", "j", "k", "e", F.col("f")[F.col("e.lo")].alias("a"), F.col("f")[F.col("e.hi")].alias("b"))
    bit = lambda end, x: F.shiftright(F.col(f"e.{end}"), x).bitwiseAND(F.lit(1))
    along = F.col("a") / (F.col("a") - F.col("b"))
    at = [(F.lit(float(lo[x])) + (F.col(c) + bit("lo", x) + along * (bit("hi", x) - bit("lo", x))) * float(step[x])).alias(f"x{x}") for x, c in enumerate("ijk")]
    # a vertex is met by each cell around its edge, with the same two values each time
    vertices = ends.select(vid(F.col("e")).alias("vid"), *at).groupBy("vid").agg(*[F.first(f"x{x}").alias(f"x{x}") for x in range(3)])
    return vertices.select(name, "vid", "x0", "x1", "x2"), out


def volume(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """mesh_id, volume: what closed meshes hold, negative where they are turned inward."""
    a, b, c = (vec(*(f"{p}{i}" for i in range(3))) for p in "abc")
    return corners(vertices, faces).groupBy("mesh_id").agg((F.sum(dot(a, cross(b, c))) / 6).alias("volume"))
