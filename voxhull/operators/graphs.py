"""Graph operators.

Iterations are rounds of joins and partial aggregates; each round is a checkpoint in the shared folder, so plans stay
short and a lost executor costs one round. The driver sees counts only. What can be settled within a part of the graph is settled
there by a small search, so that rounds go from part to part and not from node to node.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import shuffled, stored


def _stars(links: DataFrame, together: int = 1 << 20) -> DataFrame:
    """links(a, b), of each run of about so many in a partition those from each node to the least of its component: as connected, but no
    longer than one step. Nodes are numbers, strings or structs of these."""
    schema = links.select("a", "b").schema

    def join(pairs: list[pa.RecordBatch]) -> pa.RecordBatch:
        plain = lambda x: tuple(x.values()) if isinstance(x, dict) else x
        parent: dict = {}

        def least(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent.setdefault(up, up)
            return x

        t = pa.Table.from_batches(pairs)
        for a, b in zip(t["a"].to_pylist(), t["b"].to_pylist()):
            a, b = least(plain(a)), least(plain(b))
            if a != b:
                parent[max(a, b)] = min(a, b)
        ends = [(x, r) for x in parent if (r := least(x)) != x]
        kind = t.schema.field("a").type
        back = lambda x: dict(zip((f.name for f in kind), x)) if pa.types.is_struct(kind) else x
        return pa.RecordBatch.from_arrays([pa.array([back(x) for x, _ in ends], kind), pa.array([back(r) for _, r in ends], kind)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= together:
                yield join(held)
                held, n = [], 0
        if held:
            yield join(held)

    return links.select("a", "b").where("a <> b").repartitionByRange("a").mapInArrow(run, schema)


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Node, component (its smallest node) for nodes(node) and links(a, b). Links are joined within parts first; then labels spread along
    what is left, and by pointer jumps."""
    star = stored(_stars(links))
    both = stored(star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = stored(nodes.select("node", F.col("node").alias("component")))
    while True:
        heard = both.join(shuffled(label.select(F.col("node").alias("a"), "component")), "a").groupBy(F.col("b").alias("node")).agg(F.min("component").alias("heard"))
        low = label.join(shuffled(heard), "node", "left").select("node", F.least("component", "heard").alias("component"), F.col("component").alias("old"))
        jump = low.select(F.col("node").alias("component"), F.col("component").alias("further"))
        after = stored(low.join(shuffled(jump), "component", "left").select("node", F.least("component", "further").alias("component"), "old"))
        label = after.select("node", "component")
        if after.where("component <> old").limit(1).count() == 0:
            return label


#: Of a part: vertices times sources at most about so many, so that a part's distances fit a task.
PART = 1 << 18


def _within(part: int, edges: pd.DataFrame, known: pd.DataFrame, span: int) -> pd.DataFrame:
    """Dijkstra from a part's fresh vertices: what gets nearer in the part, and what its edges reach in others (open)."""
    order = np.argsort(edges["src"].to_numpy(), kind="stable")
    src, dst, w = (edges[c].to_numpy()[order] for c in ("src", "dst", "w"))
    low = part * span
    # edges stay arrays, of which only a vertex's own become numbers of Python at a time
    first = np.searchsorted(src, np.arange(low, (int(src[-1]) if len(src) else low - 1) + 2))
    out = []
    for source, mine in known.groupby("source"):
        best = dict(zip(mine["vid"].tolist(), mine["d"].tolist()))
        fresh = mine[mine["open"]]
        heap = list(zip(fresh["d"].tolist(), fresh["vid"].tolist()))
        heapq.heapify(heap)
        better: dict[int, float] = {}
        while heap:
            d, v = heapq.heappop(heap)
            if d > best[v]:
                continue
            lo, hi = first[v - low : v - low + 2] if v - low + 1 < len(first) else (0, 0)
            for t, far in zip(dst[lo:hi].tolist(), (d + w[lo:hi]).tolist()):
                if far < best.get(t, float("inf")):
                    best[t] = better[t] = far
                    if t // span == part:
                        heapq.heappush(heap, (far, t))
        out.append(pd.DataFrame({"source": source, "vid": list(better), "d": list(better.values())}, columns=["source", "vid", "d"]))
    done = pd.concat(out) if out else pd.DataFrame({"source": [], "vid": [], "d": []})
    done = done.astype({"source": "int64", "vid": "int64", "d": "float64"})
    return done.assign(open=(done["vid"] // span) != part)


def shortest_paths(graph: DataFrame, sources: DataFrame, span: int | None = None) -> DataFrame:
    """Source, vid, d of every vertex that directed edges graph(src, dst, w), w >= 0, reach from sources(source); unreachable ones have no row.

    ``span`` consecutive vertex numbers are a part, by default so many that a part has about PART distances over all sources. A round settles
    parts within, all sources together, and hands distances over edges between parts; so there are as many rounds as parts that a path
    crosses, where numbers of neighbours lie close. Where they don't, a round is a step along edges, as before.
    """
    starts = stored(sources.select("source").where("source is not null").distinct())
    if span is None:
        span = max(1024, PART // max(1, starts.count()))
    part = lambda v: F.expr(f"{v} div {span}").alias("part")
    if graph.where("w < 0").limit(1).count():
        raise ValueError("an edge of negative length")
    edges = stored(graph.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("w").cast("double").alias("w")).where("src >= 0 and dst >= 0 and w is not null"))
    edges = edges.select(part("src"), "src", "dst", "w")
    known = stored(starts.select(F.col("source").cast("long").alias("source"), F.col("source").cast("long").alias("vid"), F.lit(0.0).alias("d"), F.lit(True).alias("open")))

    def settle(key, e: pd.DataFrame, k: pd.DataFrame) -> pd.DataFrame:
        return _within(int(key[0]), e, k, span)

    while True:
        parts = known.where("open").select(part("vid")).distinct()
        here = known.select(part("vid"), "source", "vid", "d", "open").join(parts, "part", "left_semi")
        out = edges.join(parts, "part", "left_semi").groupBy("part").cogroup(here.groupBy("part")).applyInPandas(settle, "source long, vid long, d double, open boolean")
        # of equal distances the one that was settled within its part: its own edges have been followed
        both = known.select("source", "vid", "d", F.lit(False).alias("open")).unionByName(out)
        known = stored(both.groupBy("source", "vid").agg(F.min(F.struct("d", "open")).alias("m")).select("source", "vid", "m.d", "m.open"))
        if known.where("open").limit(1).count() == 0:
            return known.select("source", "vid", "d")


def farthest_points(graph: DataFrame, first: int, n: int, weights: DataFrame | None = None) -> tuple[list[int], DataFrame]:
    """N seeds, each the vertex farthest from those before, and their distances (seed_rank, vid, d).

    weights(vid, w): distances count divided by w + 1e-8. Ties go to the lower vertex. The driver holds one seed a round.
    """
    seeds, all_d, nearest = [first], None, None
    graph = stored(graph)
    for rank in range(n):
        spark = graph.sparkSession
        d = shortest_paths(graph, spark.createDataFrame([(seeds[-1],)], "source long")).select(F.lit(rank).alias("seed_rank"), "vid", "d")
        all_d = d if all_d is None else all_d.unionByName(d)
        here = d.select("vid", F.col("d").alias("t"))
        nearest = stored(here.select("vid", F.col("t").alias("near")) if nearest is None else nearest.join(here, "vid", "full").select("vid", F.least("near", "t").alias("near")))
        if rank == n - 1:
            break
        score = nearest.where(~F.col("vid").isin(seeds))
        if weights is not None:
            score = score.join(weights, "vid").select("vid", (F.col("near") / (F.col("w") + 1e-8)).alias("near"))
        top = score.agg(F.max(F.struct("near", (-F.col("vid")).alias("minus"))).alias("m")).first().m
        if top is None:
            break
        seeds.append(-top.minus)
    return seeds, all_d


def radius_patches(dist: DataFrame, radius: float) -> DataFrame:
    """pid, vid with d <= radius; patches may overlap."""
    return dist.where(F.col("d") <= radius).select(F.col("seed_rank").alias("pid"), "vid")


def voronoi(dist: DataFrame) -> DataFrame:
    """Vid with its nearest seed, the lowest on ties; one partial aggregate instead of a window."""
    return dist.groupBy("vid").agg(F.min(F.struct("d", "seed_rank")).alias("m")).select(F.col("m.seed_rank").alias("pid"), "vid", F.col("m.d").alias("d"))


def patch_overlaps(patch: DataFrame) -> DataFrame:
    """I < j of patches that share vertices, the shared ones sorted, and how many they are."""
    a, b = patch.select(F.col("pid").alias("i"), "vid"), patch.select(F.col("pid").alias("j"), "vid")
    shared = a.join(b, "vid").where("i < j").groupBy("i", "j").agg(F.sort_array(F.collect_set("vid")).alias("overlap"))
    return shared.withColumn("n", F.size("overlap").cast("long"))


def degree_statistics(links: DataFrame) -> DataFrame:
    """Nodes, mean and largest degree of links(i, j)."""
    d = links.select(F.explode(F.array("i", "j")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    return d.agg(F.count("*").alias("n_nodes"), F.avg("degree").alias("mean_degree"), F.max("degree").alias("max_degree"))


def patch_sizes(patch: DataFrame) -> DataFrame:
    """A16."""
    return patch.groupBy("pid").agg(F.count("*").alias("n")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"))
