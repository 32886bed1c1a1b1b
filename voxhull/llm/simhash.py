"""SimHash near-duplicates: fingerprints, links within a Hamming radius by BK-trees, and components of links.

Texts become 64-bit fingerprints; equal ones collapse at once. Two fingerprints within radius r agree on at least one
of r + 1 bands of bits, so each (band, value) is a shard of fingerprints among which every link of that band lies.
Each shard is a BK-tree: children hang on their parent by their Hamming distance to it, and a query follows only edges
whose distance differs from its own by the radius at most. The trees of a shard's range go to its task by a shuffle
instead of a broadcast, as a broadcast of all fingerprints has no size bound; a shard is searched by its own members
alone. What leaves a shard is one link a member, to the smallest fingerprint it is linked to within the shard, so
groups of copies never become pairs. Components come from rounds of least labels over stored tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, lower_blanks_table, partitions, stored, values


def fingerprint(words: list[bytes], shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a word list: a bit is 1 if set in over half of the shingles' XXH64; no words: 0."""
    if not words:
        return 0
    text = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(lens + 1)[:-1]))
    k = min(shingle, len(words))
    begins, ends = starts[: len(words) - k + 1].tolist(), (starts + lens)[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(text[i:j], seed) for i, j in zip(begins, ends)], np.uint64)
    set_in = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 15):
        bits = np.unpackbits(h[lo : lo + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_in += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_in * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, keep_key: bool = False) -> DataFrame:
    """docs(doc_id, text) with fp, the fingerprint as a signed long. Null texts have no words. keep_key: with text_key too."""
    kept = ["doc_id", "text_key"] if keep_key else ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower = bytes(lower_blanks_table())
        for batch in batches:
            col = values(batch, "text")
            found = np.fromiter((fingerprint(x.translate(lower).split(), shingle, seed) for x in _each(col)), np.uint64, len(col))
            yield pa.RecordBatch.from_arrays([*(values(batch, c) for c in kept), pa.array(found.view(np.int64))], names=[*kept, "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *kept[1:], "text").mapInArrow(run, ", ".join(f"{c} long" for c in [*kept, "fp"]))


def _each(col: pa.Array) -> Iterator[bytes]:
    for x in col:
        s = x.as_py()
        yield b"" if s is None else s.encode("utf-8", "surrogatepass")


# ---------------------------------------------------------------------------------------------------- BK-trees

class BKTree:
    """Over distinct 64-bit values. Nodes are numbered by insertion; children[i] maps a distance to a node."""

    def __init__(self, items: np.ndarray):
        self.items = items
        self.children: list[dict[int, int]] = [{} for _ in items]
        todo = [(0, np.arange(1, len(items)))] if len(items) else []
        while todo:  # a node's descendants are dealt to its children by their distance, all at once
            node, rest = todo.pop()
            if not len(rest):
                continue
            d = np.bitwise_count(items[rest] ^ items[node])
            for k in np.unique(d):
                part = rest[d == k]
                self.children[node][int(k)] = int(part[0])
                todo.append((int(part[0]), part[1:]))

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, int]]:
        """(positions of queries, node) for each node within the radius of some queries; all queries walk together."""
        todo = [(0, np.arange(len(queries)))] if len(self.items) else []
        while todo:
            node, q = todo.pop()
            d = np.bitwise_count(queries[q] ^ self.items[node]).astype(np.int64)
            hit = q[d <= radius]
            if len(hit):
                yield hit, node
            for k, child in self.children[node].items():
                go = q[np.abs(d - k) <= radius]
                if len(go):
                    todo.append((child, go))


def shard_links(items: np.ndarray, radius: int) -> np.ndarray:
    """For each of a shard's distinct fingerprints the position of the first member of its component in the shard."""
    n = len(items)
    if n == 1:
        return np.zeros(1, np.int64)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    if n == 2:
        if int(items[0] ^ items[1]).bit_count() <= radius:
            root[1] = 0
        return root
    for hit, node in BKTree(items).within(items, radius):
        a = find(node)
        for i in hit.tolist():
            b = find(i)
            if a != b:
                root[max(a, b)] = min(a, b)
                a = min(a, b)
    return np.array([find(i) for i in range(n)])


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """fps(fp): distinct fingerprints. Links (a, b), a < b as signed longs, whose components are those of the radius."""
    bands = radius + 1
    edges = [round(64 * i / bands) for i in range(bands + 1)]
    keys = F.array(*[
        F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("value"))
        for i, (lo, hi) in enumerate(zip(edges, edges[1:]))
    ])
    rows = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.band", "k.value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(shard: np.ndarray) -> pa.RecordBatch | None:
            first = shard_links(shard.view(np.uint64), radius)
            own = np.flatnonzero(first != np.arange(len(shard)))
            if len(own):
                return pa.RecordBatch.from_arrays([pa.array(shard[first[own]]), pa.array(shard[own])], names=["a", "b"])
            return None

        band, value, held = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            b, v, f = (values(batch, c).to_numpy() for c in ("band", "value", "fp"))
            band, value, held = np.concatenate((band, b)), np.concatenate((value, v)), np.concatenate((held, f))
            cut = np.flatnonzero((np.diff(band) != 0) | (np.diff(value) != 0)) + 1
            whole = cut[-1] if len(cut) else 0  # the last shard may go on in the next batch
            yield from _several(held[:whole], cut, out)
            band, value, held = band[whole:], value[whole:], held[whole:]
        if len(held):
            yield from filter(None, [out(held)])

    n = partitions(fps.sparkSession)
    return rows.repartition(n, "band", "value").sortWithinPartitions("band", "value", "fp").mapInArrow(run, "a long, b long")


def _several(held: np.ndarray, cuts: np.ndarray, out) -> Iterator[pa.RecordBatch]:
    begins = np.concatenate(([0], cuts[:-1])) if len(cuts) else np.empty(0, np.int64)
    for lo, hi in zip(begins.tolist(), cuts.tolist()):
        if hi - lo > 1 and (got := out(held[lo:hi])) is not None:
            yield got


# -------------------------------------------------------------------------------------------------- components

def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of the links: the smallest node of its component.

    Each round links every node to the least of its neighbourhood, first among its larger, then among its smaller
    neighbours, which turns components into stars in a number of rounds about the logarithm of their width. Rounds are stored tables; the driver
    sees only one count a round. Nodes' neighbours are summed up by partial aggregates, so a hub is never collected.
    """
    edges = stored(pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = stored(both.where("b > a").join(least, "a").where("b <> m").select(F.col("m").alias("a"), "b").distinct(), "large-star")
        # now a < b in every link
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.explode(F.when(F.col("a") == F.col("m"), F.array(F.struct(F.col("m").alias("a"), F.col("b")))).otherwise(F.array(F.struct(F.col("m").alias("a"), F.col("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b"))))).alias("e")).select("e.a", "e.b").distinct()
        after = stored(small, "small-star")
        # stars: no node is both a centre and a leaf, and each leaf has one centre
        leaves = after.groupBy("b").agg(F.count("*").alias("n"))
        unsettled = leaves.where("n > 1").select(F.col("b").alias("x")).unionByName(after.select(F.col("a").alias("x")).distinct().join(leaves.select(F.col("b").alias("x")), "x", "left_semi")).limit(1).count()
        dropped(edges, large, shuffles=False)
        edges = after
        if not unsettled:
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links of fingerprints lead to, itself included.

    A row for each row of docs; further columns are ignored. Null and blank texts have fingerprint 0 and are linked
    like any other; a null doc_id is never a component's id unless the component has no other (then null).
    """
    held = stored(fingerprints(docs, shingle, seed), "fingerprints")
    distinct = stored(held.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    label = components(links(distinct.select("fp"), radius))
    named = distinct.join(label, distinct.fp == label.node, "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    by_fp = stored(named.join(least, "label").select("fp", "component_id"), "components")
    return held.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def rows_of(docs: DataFrame, first: DataFrame) -> DataFrame:
    """The rows of docs that first(doc_id, text_key) names, once each, and all without a doc_id; text_key: xxhash64 of the text.

    Rows that share a doc_id are told apart by their texts.
    """
    keyed = docs.where(F.col("doc_id").isNotNull()).withColumn("__text_key", F.xxhash64("text"))
    named = keyed.join(first.select("doc_id", F.col("text_key").alias("__text_key")), ["doc_id", "__text_key"], "left_semi")
    named = named.dropDuplicates(["doc_id", "__text_key"]).select(*docs.columns)
    return named.unionByName(docs.where(F.col("doc_id").isNull()))


def one_of_each(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """The rows of docs, all columns as they are, that stand for their group: those with its smallest doc_id, once each.

    Rows without a doc_id can't be told apart and all stay.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    held = stored(fingerprints(keyed, shingle, keep_key=True), "fingerprints")
    label = components(links(held.select("fp").distinct(), radius))
    named = held.where(F.col("doc_id").isNotNull()).join(label, held.fp == label.node, "left").withColumn("label", F.coalesce("label", "fp"))
    first = named.groupBy("label").agg(F.min(F.struct("doc_id", "text_key")).alias("r")).select("r.*").distinct()
    return rows_of(docs, stored(first, "first"))


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op5_simhash": op5_simhash}
