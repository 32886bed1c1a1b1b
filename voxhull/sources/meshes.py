"""Mesh sources (S1, S2): OBJ text, and analytic meshes made of spark.range and expressions.

A mesh is two tables, vertices(mesh_id, vid, x0, x1, x2) and faces(mesh_id, fid, v0, v1, v2); ids count from 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Mesh = tuple[DataFrame, DataFrame]


def _numbered(lines: DataFrame, kind: str) -> DataFrame:
    """mesh_id, file, block, at, words, n: the lines of a kind, n their number in the file from 0, in the order of the file; and so of files that Spark reads in many splits.

    Within a split Spark numbers the lines that pass a filter without gaps; a split's lines go after those of the file's splits before it,
    and only the splits' counts meet. So no row moves to be numbered.
    """
    from pyspark.sql import Window

    own = lines.where(F.col("kind") == kind).withColumn("at", F.monotonically_increasing_id())
    splits = own.groupBy("file", "block").agg(F.min("at").alias("start"), F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = splits.select("file", "block", (before - F.col("start")).alias("shift"))
    return own.join(offset, ["file", "block"]).select("mesh_id", "file", "block", "at", "words", (F.col("at") + F.col("shift")).alias("n"))


def read_obj(spark: SparkSession, path: str) -> Mesh:
    """Every OBJ file under path is a mesh, named by its file; large files are read in splits.

    Lines ``v x y z`` and ``f a b c ...`` count, faces of more corners become fans, texture and normal indexes are ignored. A negative index
    counts back from the vertices before the face's line. Rows of lines are numbered where they are read (_numbered); only files with negative
    indexes have their lines put in order, a split a task.
    """
    from pyspark.sql import Window

    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = text.select(F.element_at(F.split("file", "/"), -1).alias("mesh_id"), "file", "block", F.split(F.trim(F.translate("value", "\t\r", "  ")), " +").alias("words"))
    lines = lines.select("*", F.col("words")[0].alias("kind")).where(F.col("kind").isin("v", "f") & (F.size("words") > 3))
    v = _numbered(lines, "v")
    vertices = v.select("mesh_id", F.col("n").alias("vid"), *[F.col("words")[i + 1].cast("double").alias(f"x{i}") for i in range(3)])
    ids = F.transform(F.slice("words", 2, 1 << 20), lambda t: F.substring_index(t, "/", 1).cast("long"))
    f = _numbered(lines, "f").select("mesh_id", "file", "block", "n", ids.alias("ids"))
    back = f.where(F.exists("ids", lambda i: i < 0))
    # vertices before a line: those of its file's splits before, and of its split
    order = lines.join(back.select("file").distinct(), "file", "left_semi").withColumn("at", F.monotonically_increasing_id())
    so_far = F.sum((F.col("kind") == "v").cast("long")).over(Window.partitionBy("file", "block").orderBy("at"))
    number = F.sum((F.col("kind") == "f").cast("long")).over(Window.partitionBy("file", "block").orderBy("at"))
    count = lambda kind: F.sum((F.col("kind") == kind).cast("long"))
    splits = order.groupBy("file", "block").agg(count("v").alias("vs"), count("f").alias("fs"))
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "block", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(c) for c in ("vs", "fs")])
    known = order.select("file", "block", "kind", so_far.alias("v"), number.alias("f")).where("kind = 'f'").join(splits, ["file", "block"])
    known = known.select("file", (F.col("f") - 1 + F.col("fs")).alias("n"), (F.col("v") + F.col("vs")).alias("before"))
    relative = back.join(known, ["file", "n"]).select("mesh_id", "n", F.transform("ids", lambda i: F.when(i < 0, F.col("before") + i).otherwise(i - 1)).alias("ids"))
    plain = f.where(~F.exists("ids", lambda i: i < 0)).select("mesh_id", "n", F.transform("ids", lambda i: i - 1).alias("ids"))
    fans = plain.unionByName(relative).select("mesh_id", "n", "ids", F.explode(F.sequence(F.lit(1), F.size("ids") - 2)).alias("k"))
    rows = fans.select("mesh_id", (F.col("n") * (1 << 20) + F.col("k")).alias("fid"), F.col("ids")[0].alias("v0"), F.expr("ids[k]").alias("v1"), F.expr("ids[k + 1]").alias("v2"))
    return vertices, rows


def torus(spark: SparkSession, major: float = 1.0, minor: float = 0.3, around: int = 128, across: int = 64, mesh_id: str = "torus") -> Mesh:
    """Around * across vertices, twice as many faces, turned outward."""
    g = spark.range(around * across)
    return swollen_torus(g.select(F.expr(f"id div {across}").alias("i"), F.expr(f"id % {across}").alias("j"), F.lit(0.0).alias("swell")), around, across, major, minor, mesh_id)


def swollen_torus(lattice: DataFrame, around: int, across: int, major: float = 1.0, minor: float = 0.3, mesh_id: str = "torus") -> Mesh:
    """S2 for measured data: a closed mesh of lattice(i, j, swell), i of around, j of across, with radius minor * (1 + swell) there.

    Each place of the lattice has one row; it is a vertex, i * across + j, and a square of two faces, turned outward.
    """
    i, j = F.col("i").cast("long"), F.col("j").cast("long")
    a, b = i * (2 * 3.141592653589793 / around), j * (2 * 3.141592653589793 / across)
    r = F.lit(minor) * (F.col("swell") + 1.0)
    rho = F.lit(major) + F.cos(b) * r
    vid = i * across + j
    vertices = lattice.select(F.lit(mesh_id).alias("mesh_id"), vid.alias("vid"), (rho * F.cos(a)).alias("x0"), (rho * F.sin(a)).alias("x1"), (F.sin(b) * r).alias("x2"))
    at = lambda di, dj: ((i + di) % around) * across + (j + dj) % across
    face = lambda k, *v: F.struct((vid * 2 + k).alias("fid"), *[c.alias(f"v{n}") for n, c in enumerate(v)])
    faces = lattice.select(F.lit(mesh_id).alias("mesh_id"), F.inline(F.array(face(0, at(0, 0), at(1, 0), at(1, 1)), face(1, at(0, 0), at(1, 1), at(0, 1)))))
    return vertices, faces


#: The corners of the unit cube, bit i of the number on axis i, and its faces turned outward.
BOX_FACES = ((0, 2, 1), (1, 2, 3), (4, 5, 6), (5, 7, 6), (0, 1, 4), (1, 5, 4), (2, 6, 3), (3, 6, 7), (0, 4, 2), (2, 4, 6), (1, 3, 5), (3, 7, 5))


def boxes(table: DataFrame) -> Mesh:
    """S2 for measured data: a box for each row of table(mesh_id, box, e0, e1, e2, o0, o1, o2), with these extents about the middle o; vertices are numbered 8 box + i,
    faces 12 box + i."""
    corner = F.array(*[F.struct(F.lit(c).alias("c"), *[(F.col(f"o{i}") + F.col(f"e{i}") * ((c >> i & 1) - 0.5)).alias(f"x{i}") for i in range(3)]) for c in range(8)])
    v = table.select("mesh_id", "box", F.inline(corner)).select("mesh_id", (F.col("box") * 8 + F.col("c")).alias("vid"), "x0", "x1", "x2")
    side = F.array(*[F.struct((F.col("box") * 12 + k).alias("fid"), *[(F.col("box") * 8 + c).alias(f"v{n}") for n, c in enumerate(f)]) for k, f in enumerate(BOX_FACES)])
    return v, table.select("mesh_id", F.inline(side))


def box(spark: SparkSession, extents=(1.0, 1.0, 1.0), mesh_id: str = "box") -> Mesh:
    bit = lambda n: F.shiftright("id", n).bitwiseAND(F.lit(1))
    vertices = spark.range(8).select(F.lit(mesh_id).alias("mesh_id"), F.col("id").alias("vid"), *[((bit(i) - 0.5) * extents[i]).alias(f"x{i}") for i in range(3)])
    faces = spark.createDataFrame([(mesh_id, i, *f) for i, f in enumerate(BOX_FACES)], "mesh_id string, fid long, v0 long, v1 long, v2 long")
    return vertices, faces


def height_field(cells: DataFrame, width: int) -> Mesh:
    """S2 for measured data: cells(mesh_id, i, j, x0, x1, x2), 0 <= j < width, are vertices on a lattice, and where all four corners
    of a square are there it has two faces. Vertices are numbered i * width + j, so no pass over all rows is needed to number them.

    A square is found by its corners' count, in one aggregate; each vertex is a corner of at most four.
    """
    vid = F.col("i").cast("long") * width + F.col("j")
    vertices = cells.select("mesh_id", vid.alias("vid"), *[F.col(f"x{k}").cast("double").alias(f"x{k}") for k in range(3)])
    corner = F.array(*[F.struct((F.col("i").cast("long") - di).alias("i"), (F.col("j").cast("long") - dj).alias("j")) for di in (0, 1) for dj in (0, 1)])
    squares = cells.select("mesh_id", F.inline(corner)).where((F.col("i") >= 0) & F.col("j").between(0, width - 2))
    whole = squares.groupBy("mesh_id", "i", "j").agg(F.count("*").alias("n")).where("n = 4").select("mesh_id", (F.col("i") * width + F.col("j")).alias("at"))
    at = F.col("at")
    face = lambda k, *v: F.struct((at * 2 + k).alias("fid"), *[(at + d).alias(f"v{n}") for n, d in enumerate(v)])
    return vertices, whole.select("mesh_id", F.inline(F.array(face(0, 0, width, width + 1), face(1, 0, width + 1, 1))))


def icosphere(spark: SparkSession, subdivisions: int = 3, radius: float = 1.0, mesh_id: str = "icosphere") -> Mesh:
    """Each subdivision splits faces at their edges' midpoints, which an aggregate over undirected edges numbers."""
    g = (1 + 5**0.5) / 2
    corners = [(-1, g, 0), (1, g, 0), (-1, -g, 0), (1, -g, 0), (0, -1, g), (0, 1, g), (0, -1, -g), (0, 1, -g), (g, 0, -1), (g, 0, 1), (-g, 0, -1), (-g, 0, 1)]
    near = 4.0 + 1e-9  # squared edge length
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(corners[a], corners[b]))
    turned = lambda a, b, c: _outward(corners[a], corners[b], corners[c])
    start = [(a, b, c) if turned(a, b, c) else (a, c, b) for a in range(12) for b in range(a + 1, 12) for c in range(b + 1, 12) if max(d2(a, b), d2(a, c), d2(b, c)) <= near]
    v = spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(corners)], "vid long, x0 double, x1 double, x2 double")
    f = spark.createDataFrame([(i, *t) for i, t in enumerate(start)], "fid long, v0 long, v1 long, v2 long")
    n_vertices, n_faces = 12, 20
    for _ in range(subdivisions):
        pair = lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        edges = f.select(F.explode(F.array(pair("v0", "v1"), pair("v1", "v2"), pair("v2", "v0"))).alias("e")).distinct()
        # an edge's number follows from its ends alone
        middle = edges.select("e", (F.lit(n_vertices) + F.row_number().over(_by_edge()) - 1).cast("long").alias("m"))
        ends = middle.join(v.alias("p"), F.col("e.a") == F.col("p.vid")).join(v.alias("q"), F.col("e.b") == F.col("q.vid"))
        mid = ends.select(F.col("m").alias("vid"), *[((F.col(f"p.x{i}") + F.col(f"q.x{i}")) / 2).alias(f"x{i}") for i in range(3)])
        h = f
        for k, (a, b) in enumerate((("v0", "v1"), ("v1", "v2"), ("v2", "v0"))):
            h = h.join(middle.select(F.col("e").alias(f"e{k}"), F.col("m").alias(f"m{k}")), pair(F.col(a), F.col(b)) == F.col(f"e{k}"))
        four = F.array(*[F.struct(F.lit(k).alias("k"), *[F.col(c).alias(n) for c, n in zip(t, ("v0", "v1", "v2"))]) for k, t in enumerate((("v0", "m0", "m2"), ("m0", "v1", "m1"), ("m2", "m1", "v2"), ("m0", "m1", "m2")))])
        f = h.select("fid", F.explode(four).alias("t")).select((F.col("fid") * 4 + F.col("t.k")).alias("fid"), "t.v0", "t.v1", "t.v2")
        v = v.unionByName(mid)
        n_vertices, n_faces = n_vertices + n_faces * 3 // 2, n_faces * 4
    size = F.sqrt(F.col("x0") ** 2 + F.col("x1") ** 2 + F.col("x2") ** 2)
    vertices = v.select(F.lit(mesh_id).alias("mesh_id"), "vid", *[(F.col(f"x{i}") / size * radius).alias(f"x{i}") for i in range(3)])
    return vertices, f.select(F.lit(mesh_id).alias("mesh_id"), "fid", "v0", "v1", "v2")


def _by_edge():
    from pyspark.sql import Window

    return Window.orderBy("e")  # of one analytic mesh: some thousand edges


def _outward(a, b, c) -> bool:
    u, w = [y - x for x, y in zip(a, b)], [y - x for x, y in zip(a, c)]
    n = (u[1] * w[2] - u[2] * w[1], u[2] * w[0] - u[0] * w[2], u[0] * w[1] - u[1] * w[0])
    return sum(x * y for x, y in zip(n, a)) > 0
