"""Packing by lexical retrieval: documents into sequences of one length, neighbours by BM25, without padding.

1. Every text is encoded once; its ids are stored, and with them in how many documents each term (a token id) occurs,
   summed up over the whole corpus. The driver gets one number a term of the vocabulary.
2. Documents are dealt into shards by their contents: by the ranges of (strongest terms, doc_id), where a document's strongest
   terms are those of the highest BM25 weight among the terms that at least a shard's worth of documents hold. So
   texts on one subject, copies above all, come together, and yet no subject is too frequent to be split.
3. A task holds one shard at a time: it inverts the shard's documents, takes the first unused document as seed, and fills the
   seed's window with the unused documents of highest BM25 score for the seed as query, document frequencies and mean
   length being the corpus's; the one that does not fit is cut and its rest seeds the next window.

A shard's last window goes on in the task's next shard. What a task has left at its end, under one window, is
cut into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, partitions, rows_per_batch, stored, trimmed, values
from .tokens import NO_ID, encoder, slices, with_end

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])
K1, B = 1.2, 0.75
STRONGEST = 3  # terms that a document is dealt by
SAMPLE = 100  # rows for each range of documents that say where it ends
PLACE = np.dtype([("key", "<i8"), ("doc_id", "<i8"), ("salt", "<u8")])


def terms_of(flat: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, document, occurrences) of documents' ids one after the other, by document, then term."""
    if not len(flat):
        return (np.empty(0, np.int64),) * 3
    wide = int(flat.max()) + 1
    kind = np.int32 if wide * len(lens) < 1 << 31 else np.int64
    keys = np.repeat(np.arange(len(lens), dtype=kind) * kind(wide), lens)
    keys += flat.astype(kind)
    keys.sort()
    new = np.flatnonzero(np.diff(keys, prepend=kind(-1)))
    doc, term = np.divmod(keys[new].astype(np.int64), wide)
    return term, doc, np.diff(new, append=len(keys))


@dataclass
class Corpus:
    """Of a whole corpus the number of documents that hold each term, the number of documents, and their mean length."""

    df: np.ndarray
    n: int
    mean: float
    width: int = 4  # bytes in which encoded() writes an id

    def weights(self, term: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        """BM25's weight of a term in a document; a term in half of the documents or more says nothing."""
        df = self.df[term]
        idf = np.maximum(np.log((self.n - df + 0.5) / (df + 0.5)), 0)
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(1.0, self.mean)))

    def strongest(self, flat: np.ndarray, lens: np.ndarray, least: int) -> np.ndarray:
        """Of each document the terms of the highest weights, those in ``least`` documents or more first; -1 where it has fewer."""
        term, doc, tf = terms_of(flat, lens)
        w = self.weights(term, tf, lens[doc])
        w[self.df[term] < least] *= 1e-6
        out = np.full((len(lens), STRONGEST), -1, np.int64)
        at = np.searchsorted(doc, np.arange(len(lens) + 1))
        some = np.flatnonzero(np.diff(at))
        for k in range(STRONGEST):
            top = np.maximum.reduceat(w, at[some]) if len(some) else w
            tops = np.repeat(top, np.diff(at)[some])
            first = np.flatnonzero((w == tops) & (w >= 0))  # the least of equals stands first
            first = first[np.diff(doc[first], prepend=-1) != 0]
            out[doc[first], k] = term[first]
            w[first] = -1
        return out


class Shard:
    """An inverted index of a shard's documents with BM25 weights. corpus: whose statistics hold; the shard's own without."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus | None = None):
        n = len(docs)
        lens = np.fromiter(map(len, docs), np.int64, n)
        flat = np.concatenate(docs)
        kind = np.int32 if (int(flat.max()) + 1) * n < 1 << 31 else np.int64
        keys = flat.astype(kind) * kind(n) + np.repeat(np.arange(n, dtype=kind), lens)  # by term, then document
        keys.sort()
        new = np.flatnonzero(np.diff(keys, prepend=kind(-1)))
        tf = np.diff(new, append=len(keys))
        term, self.doc = np.divmod(keys[new].astype(np.int64), n)
        at = np.flatnonzero(np.diff(term, prepend=-1))
        df = np.diff(at, append=len(term))
        if corpus is None:
            own = np.zeros(int(term[-1]) + 1, np.int64)
            own[term[at]] = df
            corpus = Corpus(own, n, float(lens.mean()))
        self.weight = corpus.weights(term, tf, lens[self.doc])
        self.n = n
        # the useful terms of each document, as numbers of posting lists
        number = np.repeat(np.arange(len(at)), df)
        says = np.flatnonzero((self.weight > 0) & (np.repeat(df, df) > 1))  # a term of one document leads to no other
        order = says[np.argsort(self.doc[says], kind="stable")]
        self.lists = number[order]
        self.of = np.concatenate(([0], np.cumsum(np.bincount(self.doc[says], minlength=n))))
        self.at, self.df = at, df

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document of the shard for the seed's distinct terms; the seed's own is of what it shares."""
        lists = self.lists[self.of[seed] : self.of[seed + 1]]
        lens = self.df[lists]
        total = int(lens.sum())
        if not total:
            return np.zeros(self.n)
        ends = np.cumsum(lens)
        where = np.arange(total) + np.repeat(self.at[lists] - (ends - lens), lens)
        return np.bincount(self.doc[where], self.weight[where], self.n)


class Filler:
    """Windows being filled; pieces are (document key, start, length, ids, sequence, offset, document length)."""

    def __init__(self, length: int, first: int):
        self.length, self.sequence = length, first
        self.window: list[tuple] = []
        self.used = 0
        self.done: list[tuple] = []

    def add(self, key, ids: np.ndarray) -> int:
        """Put a document in, over as many windows as it takes; how much of it the open window holds."""
        at, n, last = 0, len(ids), 0
        while at < n:
            last = min(n - at, self.length - self.used)
            self.window.append((key, at, last, ids, self.used))
            self.used += last
            at += last
            if self.used == self.length:
                self.close()
                last = 0
        return last

    def close(self) -> None:
        self.done += [(k, s, n, zlib.crc32(ids[s : s + n]), len(ids), self.sequence, o) for k, s, n, ids, o in self.window]
        self.window, self.used = [], 0
        self.sequence += 1

    def end(self) -> None:
        """Cut the open window into sequences of powers of two."""
        held, left = self.window, self.used
        self.window, self.used = [], 0
        i, skip = 0, 0
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            while self.used < size:
                key, s, n, ids, _ = held[i]
                take = min(n - skip, size - self.used)
                self.window.append((key, s + skip, take, ids, self.used))
                self.used += take
                skip += take
                if skip == n:
                    i, skip = i + 1, 0
            self.close()


def fill(docs: list[tuple], filler: Filler, corpus: Corpus | None = None) -> None:
    """Pack one shard's documents (key, ids)."""
    index = Shard([ids for _, ids in docs], corpus)
    free = np.ones(len(docs), bool)
    order: list[int] = []
    seed_scores = None
    for _ in range(len(docs)):
        if filler.used == 0:
            seed_scores = None
        if seed_scores is None or not order:
            pick = int(np.argmax(free))
            order = []
        else:
            pick = order.pop()
            while not free[pick]:
                pick = order.pop() if order else int(np.argmax(free))
        free[pick] = False
        before = filler.sequence
        held = filler.add(*docs[pick])
        if held and (seed_scores is None or filler.sequence != before):  # it opens a window: it is that window's seed
            seed_scores = index.scores(pick)
            left = np.flatnonzero(free)
            # the open window is full after (length - used) documents at the latest, as none is empty
            order = left[np.lexsort((left, -seed_scores[left]))][: filler.length - filler.used][::-1].tolist()


def encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """A stored table (doc_id, ids, n, df): a row for each row of docs, and one a task with its terms' document counts in df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        df = np.zeros(max(enc.vocabulary, end_id + 1), np.int64)
        for batch in slices(batches):
            flat, ends = with_end(*enc.encode_column(values(batch, "text")), end_id)
            lens = np.diff(ends, prepend=0)
            df += np.bincount(terms_of(flat, lens)[0], minlength=len(df))
            width = width_of(len(df))
            at = np.concatenate(([0], width * ends)).astype(np.int32)
            ids = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(at), pa.py_buffer(flat.astype(f"<u{width}"))])
            yield pa.RecordBatch.from_arrays([values(batch, "doc_id"), ids, pa.array(lens), pa.nulls(len(ends), pa.binary())], names=["doc_id", "ids", "n", "df"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([df.astype("<i8").tobytes()], pa.binary())], names=["doc_id", "ids", "n", "df"])

    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with rows_per_batch(docs.sparkSession, 2000):
        return stored(held.mapInArrow(run, "doc_id long, ids binary, n long, df binary"), "token-ids")


def width_of(vocabulary: int) -> int:
    return 2 if vocabulary <= 1 << 16 else 4


def corpus_of(held: DataFrame) -> Corpus:
    """The statistics of an encoded corpus. The tasks' counts are summed up by partial aggregates, a row a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column(0):
                df = np.frombuffer(x.as_py(), "<i8")
                total = np.pad(total, (0, max(0, len(df) - len(total))))
                total[: len(df)] += df
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "df"])

    rows = held.where("df is not null").select("df").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    term = rows["term"].to_numpy()
    df = np.zeros(int(term.max()) + 1 if len(term) else 1, np.int64)
    df[term] = rows["df"].to_numpy()
    sizes = held.where("n is not null").agg(F.count("n").alias("docs"), F.sum("n").alias("ids")).first()
    vocabulary = (held.agg(F.max(F.length("df")).alias("n")).first().n or 8) // 8
    return Corpus(df, sizes.docs, (sizes.ids or 0) / max(1, sizes.docs), width_of(vocabulary))


def flat_ids(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a column of encoded() one after the other, and how many each row has."""
    _, at, data = col.buffers()
    ends = np.frombuffer(at, np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) // width
    return np.frombuffer(data, f"<u{width}")[ends[0] : ends[-1]], np.diff(ends)


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, length: int = 2048, shard_docs: int = 512, shard_ids: int = 1 << 20) -> DataFrame:
    """Pieces of docs(doc_id, text) in sequences of ``length`` tokens, or of a power of two below it.

    Null texts are empty and hold the end id alone; rows with one doc_id are packed each for itself; a null doc_id
    stays null; further columns are ignored; no rows give no pieces. shard_docs, shard_ids: a shard is closed once it
    has so many documents or ids, which bounds a task's memory beside its longest document.
    """
    spark = docs.sparkSession
    held = encoded(docs, path, end_id)
    corpus = spark.sparkContext.broadcast(corpus_of(held))  # a number for each term of the vocabulary

    def placed(batch: pa.RecordBatch, row: int) -> np.ndarray:
        """What orders the rows of a batch: the strongest terms, doc_id, and for equal ones a number of the row."""
        strongest = corpus.value.strongest(*flat_ids(values(batch, "ids"), corpus.value.width), shard_docs) + 1
        out = np.empty(batch.num_rows, PLACE)
        out["key"] = (strongest << (21 * np.arange(STRONGEST)[::-1])).sum(1)  # a vocabulary has far fewer than 2**21 terms
        out["doc_id"] = values(batch, "doc_id").fill_null(NO_ID).to_numpy()
        out["salt"] = mixed(np.arange(row, row + batch.num_rows))
        return out

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in placed(batch, 0)], pa.binary())], names=["place"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0
        for batch in slices(batches):
            place = placed(batch, row)
            row += batch.num_rows
            part = np.searchsorted(bounds.value, place, "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(place["key"]), values(batch, "doc_id"), values(batch, "ids")], names=["part", "key", "doc_id", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        filler = Filler(length, TaskContext.get().partitionId() << 40)
        shard: list[tuple] = []
        n = 0

        def rows() -> Iterator[pa.RecordBatch]:
            done, filler.done = filler.done, []
            if done:
                k, s, m, crc, total, seq, off = zip(*done)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (k, s, m, crc, total, seq, off)], schema=_ARROW)

        for batch in batches:
            flat, lens = flat_ids(values(batch, "ids"), corpus.value.width)
            flat = flat.astype("<u4")
            ends = np.cumsum(lens)
            for key, a, b in zip(values(batch, "doc_id").to_pylist(), (ends - lens).tolist(), ends.tolist()):
                shard.append((key, flat[a:b]))
                n += b - a
                if len(shard) >= shard_docs or n >= shard_ids:
                    fill(shard, filler, corpus.value)
                    shard, n = [], 0
                    yield from rows()
        if shard:
            fill(shard, filler, corpus.value)
        filler.end()
        yield from rows()
        trimmed()

    rows = held.where("ids is not null").select("doc_id", "ids")
    parts = partitions(spark)
    # ranges as Spark's range partitioning finds them, by a sample of some rows a range, yet without the terms of all rows for it
    some = rows.sample(min(1.0, SAMPLE * parts / max(1, corpus.value.n)), seed=1).mapInArrow(sampled, "place binary").toArrow()
    order = np.sort(np.frombuffer(b"".join(some["place"].to_pylist()), PLACE))
    bounds = spark.sparkContext.broadcast(order[np.arange(1, parts) * len(order) // parts] if len(order) else order)
    ranged = rows.mapInArrow(dealt, "part int, key long, doc_id long, ids binary").repartitionById(parts, F.col("part"))
    return ranged.sortWithinPartitions("key", "doc_id", "ids").select("doc_id", "ids").mapInArrow(run, PIECES)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op7_packing": op7_packing}
