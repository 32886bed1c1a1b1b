"""Quality classifier: nearest neighbours among labelled texts vote, weighted by cosine in a latent semantic space.

A text is counted whole into hashed character trigrams of its UTF-8 bytes (case, marks and line ends included), scaled
by sublinear counts and inverse document frequency, and projected by a truncated singular value decomposition of the
labelled sample. Beside these a vector has an angle: how far the text repeats itself beyond what is usual at its length,
which latent directions of trigrams cannot tell (a text twice over has the same direction). Every text's cosines to all
labelled vectors are one blocked matrix product; the nearest vote, each weighted by its similarity.

Sample: the fit uses at most ``sample`` labelled rows, those of least hash, a stated bound (default 4096). So what is
broadcast is bounded too: sample * rank + buckets * (rank + 1) floats. Scoring covers every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mixed, text_bytes, values

BUCKETS = 4096
_SLOT = (mixed(np.arange(1 << 16, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def counts(text: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """Hashed trigram counts of the whole text, in pieces so that long texts take little memory."""
    out = np.zeros(buckets, np.float32)
    a = np.frombuffer(text, np.uint8)
    step = 1 << 20
    for lo in range(0, max(0, len(a) - 2), step):
        b = a[lo : lo + step + 2].astype(np.uint32)
        pair = b[:-2] | (b[1:-1] << np.uint32(8))
        slot = (_SLOT[pair] + b[2:] * np.uint32(0x9E3779B1)) >> np.uint32(7)
        out += np.bincount(slot & np.uint32(buckets - 1), minlength=buckets).astype(np.float32)
    return out


def repetition(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the log of its trigrams, and of its trigrams per distinct one."""
    n = np.maximum(rows.sum(1), 1).astype(np.float64)
    return np.log(n), np.log(n / np.maximum((rows > 0).sum(1), 1))


@dataclass
class Voter:
    """A fitted model; its arrays are all it holds."""

    idf: np.ndarray  # of each bucket
    usual: np.ndarray  # polynomial: log of trigrams per distinct trigram, by log of trigrams
    basis: np.ndarray  # buckets x rank
    vectors: np.ndarray  # sample x rank, of length 1
    labels: np.ndarray  # 0.0 or 1.0
    prior: float
    neighbours: int

    def place(self, rows: np.ndarray) -> np.ndarray:
        """Unit vectors of rows of counts; zero where a row is. Two coordinates beside the latent ones are an angle: how
        far a text repeats itself beyond what is usual at its length."""
        x = np.log1p(rows)
        x *= self.idf
        v = x @ self.basis
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        v = np.divide(v, norm, out=np.zeros_like(v), where=norm > 1e-9)
        size, repeat = repetition(rows)
        turn = np.clip(1.5 * (repeat - np.polyval(self.usual, size)), -np.pi / 2, np.pi / 2)
        angle = np.stack([np.cos(turn), np.sin(turn)], 1) * (norm > 1e-9)
        return np.hstack([0.8 * v, 0.6 * angle]).astype(np.float32)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """The neighbours' mean label, each weighted by its similarity; the sample's mean where a text says nothing."""
        v = self.place(rows)
        k = min(self.neighbours, len(self.labels))
        cos = v @ self.vectors.T
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        tied = np.flatnonzero((cos >= np.take_along_axis(cos, near, 1).min(1, keepdims=True)).sum(1) > k)
        near[tied] = np.argsort(-cos[tied], axis=1, kind="stable")[:, :k]  # of equally near ones the first of the sample
        sim = np.maximum(np.take_along_axis(cos, near, 1), 0) + 1e-12
        out = (sim * self.labels[near]).sum(1) / sim.sum(1)
        return np.where(np.abs(v).sum(1) > 0, out, self.prior)


def fit(rows: np.ndarray, labels: np.ndarray, rank: int = 64, neighbours: int = 15, seed: int = 0) -> Voter:
    """A model of count rows and their labels 0 or 1. Randomised decomposition with a fixed seed: same rows, same model."""
    if not len(rows):
        return Voter(np.ones(BUCKETS, np.float32), np.zeros(1), np.zeros((BUCKETS, 1), np.float32), np.zeros((1, 3), np.float32), np.full(1, 0.5), 0.5, 1)
    df = (rows > 0).sum(0)
    idf = np.log((1 + len(rows)) / (1 + df)).astype(np.float32) + np.float32(0.1)
    x = np.log1p(rows) * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    r = min(rank, *x.shape)
    rng = np.random.default_rng(seed)
    q = rng.standard_normal((x.shape[1], r + 8)).astype(np.float32)
    for _ in range(3):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    u, s, vt = np.linalg.svd(x @ q, full_matrices=False)
    basis = (q @ vt.T[:, :r]).astype(np.float32)
    size, repeat = repetition(rows)
    usual = np.polyfit(size, repeat, 2) if len(rows) >= 16 and np.ptp(size) > 0 else np.array([float(np.median(repeat))])
    out = Voter(idf, usual, basis, np.empty(0), labels.astype(np.float32), float(labels.mean()), neighbours)
    out.vectors = out.place(rows)
    return out


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("long").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = 4096, rank: int = 64, neighbours: int = 15) -> Voter:
    """Fit on at most ``sample`` rows of labels(doc_id, quality) that aren't held out and have a text in docs.

    Rows with a null doc_id or a label other than 0 and 1 aren't used; a doc_id labelled more than once counts once, with its least label; of
    rows that share a doc_id the text of least hash counts. The rows are those of least hash of doc_id.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    once = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("label"))
    chosen = once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # at most sample rows, whatever repeats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [counts(t) for t in text_bytes(values(batch, "text"))]
            sparse = [np.flatnonzero(r) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [values(batch, "doc_id"), values(batch, "label"), pa.array([s.astype("<u2").tobytes() for s in sparse], pa.binary()), pa.array([r[s].tobytes() for r, s in zip(rows, sparse)], pa.binary())],
                names=["doc_id", "label", "slots", "counts"],
            )

    got = texts.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, slots binary, counts binary").toArrow().sort_by([("doc_id", "ascending"), ("slots", "ascending")])
    x = np.zeros((got.num_rows, BUCKETS), np.float32)
    for i, (s, c) in enumerate(zip(got["slots"].to_pylist(), got["counts"].to_pylist())):
        x[i, np.frombuffer(s, "<u2")] = np.frombuffer(c, np.float32)
    return fit(x, got["label"].to_numpy(), rank, neighbours)


def score(docs: DataFrame, model: Voter, block: int = 256) -> DataFrame:
    """docs(doc_id, text) with score. Null texts are empty; every row is scored for itself, doc_id null or repeated too."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for lo in range(0, batch.num_rows, block):
                part = batch.slice(lo, block)
                rows = np.stack([counts(t) for t in text_bytes(values(part, "text"))])
                yield pa.RecordBatch.from_arrays([values(part, "doc_id"), pa.array(model.score(rows).astype(np.float64))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, model: Voter, least: float = 0.3, block: int = 256) -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores ``least`` or more."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for lo in range(0, batch.num_rows, block):
                part = batch.slice(lo, block)
                rows = np.stack([counts(t) for t in text_bytes(values(part, "text"))])
                yield part.filter(pa.array(model.score(rows) >= least))

    return docs.mapInArrow(run, docs.schema)


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op8_quality_classifier": op8_quality_classifier}
