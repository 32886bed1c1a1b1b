"""Borders of alpha shapes against all pairs and all circles."""

import math
import random

from voxhull.operators import outline

POINT = "region long, id long, u double, v double, radius double"


def plain(points, r):
    """Directed edges whose right circle of radius r is empty and whose left one is not."""
    bare = set()
    for i, (a, b) in points.items():
        for j, (c, d) in points.items():
            w = math.hypot(c - a, d - b)
            if i != j and 0 < w < 2 * r:
                h = math.sqrt(r * r - w * w / 4)
                x, y = (a + c) / 2 + (d - b) / w * h, (b + d) / 2 - (c - a) / w * h
                if all(math.hypot(p - x, q - y) > r - 1e-9 for k, (p, q) in points.items() if k not in (i, j)):
                    bare.add((i, j))
    return {(i, j) for i, j in bare if (j, i) not in bare}


def ring(rnd, n, lo, hi):
    out = []
    while len(out) < n:
        u, v = rnd.uniform(-hi, hi), rnd.uniform(-hi, hi)
        if lo <= math.hypot(u, v) <= hi:
            out.append((u, v))
    return out


def test_borders_equal_all_pairs(spark):
    """Clouds with holes, with pieces apart, with lone points and spurs; two regions of different radius share ids."""
    rnd = random.Random(9)
    sets = {0: (ring(rnd, 70, 0.5, 1.0), 0.35), 1: (ring(rnd, 25, 0.0, 1.0) + [(u + 5, v) for u, v in ring(rnd, 25, 0.0, 1.0)] + [(20.0, 0.0), (2.0, 0.1), (2.6, 0.1)], 0.7), 2: ([(rnd.random(), rnd.random()) for _ in range(60)], 0.13), 3: ([(0.0, 0.0), (1.0, 0.0)], 2.0), 4: ([(0.0, 0.0)], 2.0)}
    rows = [(region, i, u, v, r) for region, (ps, r) in sets.items() for i, (u, v) in enumerate(ps)]
    rows += [(0, 900, *sets[0][0][3], 0.35), (0, 901, None, 1.0, 0.35)]  # a point in the place of another, and no point
    got = outline.border(spark.createDataFrame(rows, POINT).repartition(4)).collect()
    for region, (ps, r) in sets.items():
        mine = [(x.s, x.t) for x in got if x.region == region]
        assert set(mine) == plain(dict(enumerate(ps)), r) and len(mine) == len(set(mine)), region
    ends = {(x.region, x.s, x.t) for x in got}
    assert len(got) > 60 and all((x.region, x.t, x.next) in ends for x in got)


def test_outlines_take_the_piece_that_encloses_most(spark):
    rnd = random.Random(4)
    rows = [(1, i, u, v, 0.5) for i, (u, v) in enumerate(ring(rnd, 150, 0.6, 2.0))]
    rows += [(1, 500 + i, u + 9, v, 0.5) for i, (u, v) in enumerate(ring(rnd, 40, 0.0, 1.0))]
    rows += [(2, i, float(i % 4), float(i // 4), 0.8) for i in range(12)]
    rows += [(3, 0, 0.0, 0.0, 0.1), (3, 1, 1.0, 0.0, 0.1), (3, 2, 0.0, 1.0, 0.1), (4, 0, 0.0, 0.0, 1.0), (4, 1, 1.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, POINT)
    got = {r.region: r for r in outline.outlines(df).collect()}
    assert set(got) == {1, 2} and 9 < got[1].hull_area < math.pi * 4 and abs(got[2].hull_area - 6) < 1e-9 and len(got[2].hull) == 10
    shoelace = sum(p.u * q.v - q.u * p.v for p, q in zip(got[1].hull, [*got[1].hull[1:], got[1].hull[0]])) / 2
    assert abs(shoelace - got[1].hull_area) < 1e-9
    wide = {r.region: r.hull_area for r in outline.widened(df, 6).collect()}
    assert set(wide) == {1, 2, 3} and abs(wide[3] - 0.5) < 1e-9


def test_few_points_of_a_dense_region_meet_all_their_neighbours(spark, monkeypatch):
    """What is inside is told by a few points about it, and what is left out changes no edge."""
    rnd = random.Random(7)
    df = spark.createDataFrame([(0, i, rnd.gauss(0, 0.13), rnd.gauss(0, 0.13), 0.12) for i in range(2000)], POINT)
    kept = {r.id for r in outline.candidates(df).collect()}
    got = {(x.s, x.t, x.next) for x in outline.border(df).collect()}
    assert len(kept) < 200 and got and {i for s, t, _ in got for i in (s, t)} <= kept
    monkeypatch.setattr(outline, "candidates", lambda points: points)
    assert got == {(x.s, x.t, x.next) for x in outline.border(df).collect()}


def test_points_amid_filled_cells_need_no_arcs(spark, monkeypatch):
    """A dense ring: what is left for the arcs follows the rim, and the border is that of trying every point, from all partitions."""
    rnd = random.Random(4)
    rows = [(0, i, u, v, 0.2) for i, (u, v) in enumerate(ring(rnd, 8000, 0.5, 1.0))]
    points = spark.createDataFrame(rows, POINT).cache()
    rim = outline.sparse(points)
    left = {r.id for r in rim.collect()}
    # a place is left only where a cell within three widths may be empty
    assert 0 < len(left) < 6400 and all(math.hypot(*rows[i][2:4]) < 0.5 + 0.22 or math.hypot(*rows[i][2:4]) > 1.0 - 0.22 for i in left)
    got = {(r.s, r.t, r.next) for r in outline.border(points).collect()}
    assert outline.candidates(points).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    cell = lambda p: p.selectExpr("*", "floor(u / (radius * 2 / 8)) AS i", "floor(v / (radius * 2 / 8)) AS j")
    monkeypatch.setattr(outline, "sparse", cell)
    assert got == {(r.s, r.t, r.next) for r in outline.border(points).collect()} and len(got) > 50
