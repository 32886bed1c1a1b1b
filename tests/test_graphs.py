"""Paths and components over parts, against searches over the whole graph."""

import heapq
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from voxhull.operators import graphs


def dijkstra(edges, source):
    to = defaultdict(list)
    for a, b, w in edges:
        to[a].append((b, w))
    best, heap = {source: 0.0}, [(0.0, source)]
    while heap:
        d, v = heapq.heappop(heap)
        if d <= best[v]:
            for t, w in to[v]:
                if d + w < best.get(t, float("inf")):
                    best[t] = d + w
                    heapq.heappush(heap, (d + w, t))
    return best


@pytest.mark.parametrize("span", [None, 1, 16])
def test_paths_equal_a_search_of_the_whole_graph(spark, span):
    """A lattice with shortcuts, an unreachable part, repeated edges, loops and edges of length 0; lengths are sums of eighths, so they are exact."""
    rnd = random.Random(7)
    edges = []
    for v in range(64):
        for t in (v + 1, v + 8):
            if t < 64 and (t % 8 or t == v + 8):
                w = rnd.randint(1, 20) / 8
                edges += [(v, t, w), (t, v, w)]
    edges += [(rnd.randrange(64), rnd.randrange(64), rnd.randint(0, 90) / 8) for _ in range(12)] + [(5, 5, 0.0), (100, 101, 1.0), (101, 100, 1.0), edges[0]]
    sources = [0, 37, 100, 999]
    got = graphs.shortest_paths(spark.createDataFrame(edges, "src long, dst long, w double"), spark.createDataFrame([(s,) for s in [*sources, 0]], "source long"), span)
    want = {(s, v): d for s in sources for v, d in dijkstra(edges, s).items()}
    rows = got.collect()
    assert {(r.source, r.vid): r.d for r in rows} == want and len(rows) == len(want)


def test_rounds_follow_parts_and_not_steps(spark, monkeypatch):
    """A path of 60 edges in four parts takes a round for each part, and one part a single round."""
    rounds = []
    monkeypatch.setattr(graphs, "stored", lambda df, f=graphs.stored: (rounds.append(1), f(df))[1])
    path = spark.range(60).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("w"))
    one = spark.createDataFrame([(0,)], "source long")
    took = []
    for span in (100, 16):
        rounds.clear()
        assert graphs.shortest_paths(path, one, span).agg(F.max("d")).first()[0] == 60.0
        took.append(len(rounds) - 3)
    assert took == [1, 4]


def test_paths_refuse_negative_lengths_and_take_empty_graphs(spark):
    one = spark.createDataFrame([(3,)], "source long")
    with pytest.raises(ValueError, match="negative"):
        graphs.shortest_paths(spark.createDataFrame([(0, 1, -1.0)], "src long, dst long, w double"), one)
    none = spark.createDataFrame([], "src long, dst long, w double")
    assert [tuple(r) for r in graphs.shortest_paths(none, one).collect()] == [(3, 3, 0.0)]
    assert graphs.shortest_paths(none, one.where("source < 0")).count() == 0


@pytest.mark.parametrize("kind", ["long", "string", "struct<m:string,n:long>"])
def test_components_of_any_kind_of_node(spark, kind):
    rnd = random.Random(11)
    n = 80
    links = [(i, i + 1) for i in range(0, 50) if i % 17] + [(rnd.randrange(50, n), rnd.randrange(50, n)) for _ in range(25)] + [(4, 4)]
    name = {"long": lambda i: i, "string": lambda i: f"v{i:03}", "struct<m:string,n:long>": lambda i: (f"m{i % 2}", i)}[kind]
    parent = {name(i): name(i) for i in range(n)}

    def least(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = least(name(a)), least(name(b))
        parent[max(a, b)] = min(a, b)
    nodes = spark.createDataFrame([(name(i),) for i in range(n)], f"node {kind}")
    df = spark.createDataFrame([(name(a), name(b)) for a, b in links], f"a {kind}, b {kind}").repartition(5)
    plain = lambda x: tuple(x) if isinstance(x, tuple) else x
    got = {plain(r.node): plain(r.component) for r in graphs.components(nodes, df).collect()}
    assert got == {x: least(x) for x in parent}


@pytest.mark.parametrize("together", [10, 1 << 20])
def test_stars_join_what_the_links_join(spark, together):
    df = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).where("a % 100 <> 99")
    nodes = spark.range(301).select(F.col("id").alias("node"))
    stars = graphs._stars(df, together)
    assert stars.count() <= df.count() and stars.where("a < b").count() == 0
    assert {r.node: r.component for r in graphs.components(nodes, stars).collect()} == {i: i // 100 * 100 for i in range(301)}


def test_a_part_holds_its_edges_as_arrays():
    """What a search holds beside its distances is some numbers for each edge, and no part of the usual size is large."""
    import tracemalloc

    import numpy as np
    import pandas as pd

    n = 20000
    src = np.repeat(np.arange(n), 6)
    edges = pd.DataFrame({"src": src, "dst": (src + np.tile([1, 2, 3, 5, 7, 11], n)) % n + 5, "w": np.random.default_rng(2).random(6 * n)})
    known = pd.DataFrame({"source": [0], "vid": [n], "d": [0.0], "open": [True]})  # a vertex without edges
    tracemalloc.start()
    try:
        assert len(graphs._within(0, edges, known, 1 << 15)) == 0
        held = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert held < 60 * len(edges) and graphs.PART <= 1 << 18
