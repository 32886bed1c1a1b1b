"""Benchmark decontamination by winnowing.

Training and test texts keep the least hash of the k-word grams in each sliding window of words, so that any shared
run of a whole window is bound to share a kept hash. Hits are extended word by word in both directions, on the words
themselves, and count once the common run is a window long. Test items shorter than a window are looked up whole.

The test set is read in blocks of a bounded size; a block's index goes to the executors and every document is held
against it. A test set of one block, as usual, takes a single scan without a shuffle; more blocks take a scan each,
whose hits are merged by document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, alnum_table, stored, text_bytes, values, windows

RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def winnowed(h: np.ndarray, doc: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-grams kept: the least (each of them, on ties) of some whole window of its text."""
    grams = windows(h, k, salt=k)
    m = len(h) - window + 1
    if m <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    span = window - k + 1
    least = grams[:m].copy()
    for j in range(1, span):
        np.minimum(least, grams[j : j + m], out=least)
    whole = doc[:m] == doc[window - 1 :]
    keep = np.zeros(len(grams), bool)
    for j in range(span):
        keep[j : j + m] |= whole & (grams[j : j + m] == least)
    at = np.flatnonzero(keep)
    return at, grams[at]


class Index:
    """Of a block of test items: kept hashes, and where they stand. Plain arrays and lists, so it can be shipped."""

    def __init__(self, ids: list[str | None], texts: list[bytes], window: int, k: int):
        self.window, self.k = window, k
        w = Words(texts, alnum_table())
        h = w.hashes()
        lens = np.diff(w.first)
        self.ids = ids
        self.words = [[w.word(i) for i in range(w.first[d], w.first[d + 1])] for d in range(len(texts))]
        at, fp = winnowed(h, w.doc, window, k)
        self.tables = [(k, *self._sorted(fp, w.doc[at], at - w.first[w.doc[at]]))]
        for m in sorted({int(x) for x in lens if 0 < x < window}):  # short items, whole
            items = np.flatnonzero(lens == m)
            grams = windows(h, m, salt=64 + m)[w.first[items]]
            self.tables.append((m, *self._sorted(grams, items, np.zeros(len(items), np.int64))))

    @staticmethod
    def _sorted(fp, item, at):
        order = np.argsort(fp, kind="stable")
        return fp[order], item[order], at[order]

    def hits(self, w: Words) -> tuple[np.ndarray, list[set[int]]]:
        """Of the batch's words which are hit, and of each text the items that occur."""
        h, hit = w.hashes(), np.zeros(w.n, bool)
        found: list[set[int]] = [set() for _ in range(len(w.first) - 1)]
        for n, (size, fp, item, at) in enumerate(self.tables):
            if not len(fp):
                continue
            if n == 0:
                pos, got = winnowed(h, w.doc, self.window, self.k)
            else:
                got = windows(h, size, salt=64 + size)
                pos = np.arange(len(got))
            lo = np.searchsorted(fp, got, "left")
            known = np.flatnonzero(fp[np.minimum(lo, len(fp) - 1)] == got)
            lo, hi = lo[known], np.searchsorted(fp, got[known], "right")
            seen: dict[tuple[int, int], int] = {}
            for p, a, b in zip(pos[known].tolist(), lo.tolist(), hi.tolist()):
                d = int(w.doc[p])
                for j in range(a, b):
                    i, q = int(item[j]), int(at[j])
                    if seen.get((i, p - q), -1) > p:  # inside a run that is already followed
                        continue
                    start, end = self._run(w, d, p, self.words[i], q)
                    seen[i, p - q] = end
                    if end - start >= min(self.window, len(self.words[i])):
                        hit[start:end] = True
                        found[d].add(i)
        return hit, found

    @staticmethod
    def _run(w: Words, d: int, p: int, words: list[bytes], q: int) -> tuple[int, int]:
        """The longest common run around document word p and item word q; empty if these differ."""
        first, last = int(w.first[d]), int(w.first[d + 1])
        a, i = p, q
        while a > first and i > 0 and w.word(a - 1) == words[i - 1]:
            a, i = a - 1, i - 1
        b, i = p, q
        while b < last and i < len(words) and w.word(b) == words[i]:
            b, i = b + 1, i + 1
        return (a, b) if b > p else (p, p)


def _digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def test_blocks(tests: DataFrame, window: int, k: int, block_bytes: int):
    """How many blocks of about block_bytes the test texts take, and a function that reads the index of one."""
    size = tests.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    n_blocks = max(1, -(-int(size) // block_bytes))
    parts = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))

    def index_of(block: int) -> Index:
        rows = tests.where(parts == block).select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).collect()
        return Index([r.item_id for r in rows], [r.text.encode() for r in rows], window, k)

    return n_blocks, index_of


def uncontaminated(docs: DataFrame, tests: DataFrame, window: int = 10, k: int = 5, block_bytes: int = 16_000_000) -> DataFrame:
    """The rows of docs, all columns as they are, that no window of tests occurs in."""
    n_blocks, index_of = test_blocks(tests, window, k, block_bytes)
    for block in range(n_blocks):  # one, unless the test set is very large
        held = docs.sparkSession.sparkContext.broadcast(index_of(block))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index, table = held.value, alnum_table()
            for batch in batches:
                texts = text_bytes(values(batch, "text"))
                for lo, hi in batches_of(texts):
                    w = Words(texts[lo:hi], table)
                    sums = np.concatenate(([0], np.cumsum(index.hits(w)[0])))
                    yield batch.slice(lo, hi - lo).filter(pa.array(sums[w.first[1:]] == sums[w.first[:-1]]))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def decontaminate(docs: DataFrame, tests: DataFrame, window: int = 10, k: int = 5, block_bytes: int = 16_000_000) -> DataFrame:
    """For each row of docs(doc_id, text) its words, those inside any window of tests(item_id, text), and the items.

    Words: A-Z lower-cased, then [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+; a null or blank text has none, hits nothing and
    is hit by nothing. A test row without item_id marks words, but isn't counted or listed; rows of one item_id count
    once. Without test rows nothing is hit. block_bytes: how much test text one scan of docs is held against.
    """
    n_blocks, index_of = test_blocks(tests, window, k, block_bytes)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if n_blocks > 1:
        docs = stored(docs.withColumn("row", F.monotonically_increasing_id()), "documents")

    def scan(block: int) -> DataFrame:
        held = docs.sparkSession.sparkContext.broadcast(index_of(block))  # at most about block_bytes of text and its index

        def each(batch: pa.RecordBatch):
            index, table = held.value, alnum_table()
            texts = text_bytes(values(batch, "text"))
            for lo, hi in batches_of(texts):
                w = Words(texts[lo:hi], table)
                hit, found = index.hits(w)
                sums = np.concatenate(([0], np.cumsum(hit)))
                items = [{index.ids[i] for i in s if index.ids[i] is not None} for s in found]
                yield lo, hi, w, hit, sums, items

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = values(batch, "doc_id")
                for lo, hi, w, _, sums, items in each(batch):
                    n_hit = sums[w.first[1:]] - sums[w.first[:-1]]
                    yield pa.RecordBatch.from_arrays(
                        [keys[lo:hi], pa.array(np.diff(w.first)), pa.array(n_hit), pa.array([len(s) for s in items], pa.int64()), pa.array([_digest(s) for s in items]), pa.array(n_hit > 0)],
                        names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
                    )

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, row = values(batch, "doc_id"), values(batch, "row")
                for lo, hi, w, hit, _, items in each(batch):
                    marks = [np.flatnonzero(hit[a:b]).tolist() for a, b in zip(w.first[:-1], w.first[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [row[lo:hi], keys[lo:hi], pa.array(np.diff(w.first)), pa.array(marks, pa.list_(pa.int64())), pa.array([sorted(s) for s in items], pa.list_(pa.string()))],
                        names=["row", "doc_id", "n_words", "marks", "items"],
                    )

        if n_blocks == 1:
            return docs.mapInArrow(whole, RESULT)
        return docs.mapInArrow(partial, "row long, doc_id long, n_words long, marks array<long>, items array<string>")

    if n_blocks == 1:
        return scan(0)
    found = stored(scan(0), "hits")
    for i in range(1, n_blocks):
        found = found.unionByName(stored(scan(i), "hits"))
    # a document has one row for each block of the stated test set
    merged = found.groupBy("row", "doc_id", "n_words").agg(F.array_distinct(F.flatten(F.collect_list("marks"))).alias("m"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("i"))
    n_hit = F.size("m").cast("long")
    listed = F.array_join(F.array_sort("i"), ",")
    return merged.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("i").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def batches_of(texts: list[bytes], most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts with so many bytes together, unless one text has more."""
    lo, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= most or i == len(texts) - 1:
            yield lo, i + 1
            lo, n = i + 1, 0


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_W = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLES = {
    "op10_decontamination": f"""
WITH d AS (SELECT doc_id, {_W} AS w FROM documents),
b AS (SELECT item_id, {_W} AS w FROM benchmark),
i AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
v AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM i)),
l AS (SELECT DISTINCT n FROM v),
g AS (SELECT doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, l WHERE len(w) >= n)),
h AS (SELECT doc_id, item_id, g.n, p FROM g JOIN v ON g.n = v.n AND g.s = v.s),
m AS (SELECT doc_id, count(DISTINCT p + k) AS n_hit FROM (SELECT doc_id, p, unnest(range(0, n)) AS k FROM (SELECT DISTINCT doc_id, n, p FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN m ON d.doc_id = m.doc_id LEFT JOIN t ON d.doc_id = t.doc_id"""
}
QUERIES = {"op10_decontamination": op10_decontamination}
