"""Substring dedup by repeated-phrase automata.

1. Recurring passages. In every run of ``window`` words some short phrase is kept by winnowing, the same one in each
   copy of the run. Chunks of documents ask each other which of these phrases other chunks hold too.
2. Automata. Each chunk compiles the recurring phrases among its own into an Aho-Corasick automaton (a shard, bounded by
   the chunk) and streams all its documents through it to locate every occurrence. A window of words
   without an occurrence cannot recur; the others ask whether an earlier chunk or document holds them.
3. Removal. A word goes if a window over it starts earlier, too: in an earlier document, or in its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ASKED, ASKED_ARROW, answered, answers, arrow_schema, ask, chunked, n_buckets, opened, order_ids, with_answers
from .common import Words, blanks_table, stored, text_bytes, windows
from .decontamination import winnowed

PHRASE = 5


def _words(table: pa.Table) -> Words:
    return Words([x for c in table["text"].chunks for x in text_bytes(c)], blanks_table())


def _phrases(w: Words, h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct kept phrases, one place of each, and which stand in several places here."""
    at, fp = winnowed(h, w.doc, window, PHRASE)
    keys, first, n = np.unique(fp, return_index=True, return_counts=True)
    return keys, at[first], n > 1


def located(w: Words, at: np.ndarray) -> np.ndarray:
    """Word positions where any of the phrases that start at the words ``at`` occurs, found by one automaton."""
    machine = ahocorasick.Automaton()
    buf, s, e = w.buf, w.starts, w.ends
    for p in at.tolist():
        words = b" ".join([buf[i:j] for i, j in zip(s[p : p + PHRASE].tolist(), e[p : p + PHRASE].tolist())])
        machine.add_word(" " + words.decode("latin-1") + " ", 1)
    machine.make_automaton()
    found = np.zeros(w.n, bool)
    for d in range(len(w.first) - 1):
        lo, hi = int(w.first[d]), int(w.first[d + 1])
        if hi - lo < PHRASE:
            continue
        text = " " + w.kept(d).decode("latin-1") + " "
        ends = np.fromiter((i for i, _ in machine.iter(text)), np.int64)
        if len(ends):
            blanks = np.cumsum(e[lo:hi] - s[lo:hi] + 1)  # of the blank after each word
            found[lo + np.searchsorted(blanks, ends) - (PHRASE - 1)] = True
    return found


def _candidates(w: Words, window: int, found: np.ndarray) -> np.ndarray:
    """Starts of windows, within one document, that hold a located phrase."""
    m = w.n - window + 1
    if m <= 0:
        return np.empty(0, np.int64)
    sums = np.concatenate(([0], np.cumsum(found)))
    i = np.arange(m)
    holds = sums[i + window - PHRASE + 1] > sums[i]
    return np.flatnonzero(holds & (w.doc[:m] == w.doc[window - 1 :]))


def remove_repeats(docs: DataFrame, window: int = 20, keep: tuple[str, ...] = (), untouched: bool = False) -> DataFrame:
    """doc_id, the columns keep, text without repeated words, n_words, n_removed; a row for each row of docs(doc_id, text).

    Words: [^\\x20\\x09-\\x0D]+; the words kept are joined by one blank. Null texts have no words and become empty.
    Documents stand in the order of doc_id, null first; rows of one doc_id in the order in which they are read.
    Texts shorter than a window lose nothing. untouched: a text that loses no word stays as it is, blanks and lines too.
    """
    names = [f"keep_{i}" for i in range(len(keep))]
    chunks = chunked(docs, [F.col(c).alias(n) for c, n in zip(keep, names)])
    buckets = n_buckets(chunks)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                w = _words(opened(data.as_py()))
                yield ask(chunk, _phrases(w, w.hashes(), window)[0], None, buckets)

    def locate(chunk: int, table: pa.Table, replies: pa.Table) -> pa.Table:
        w = _words(table)
        h = w.hashes()
        keys, at, here = _phrases(w, h, window)
        starts = _candidates(w, window, located(w, at[here | answers(keys, buckets, replies)])) if len(keys) else np.empty(0, np.int64)
        marks = np.zeros(w.n, bool)
        marks[starts] = True
        plan = pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([chunk], pa.int64()), pa.array([np.packbits(marks).tobytes()], pa.binary()), pa.array([b""], pa.binary())], schema=ASKED_ARROW)
        keys, first = np.unique(windows(h, window)[starts], return_index=True)
        rank = order_ids(table)[w.doc[starts[first]]]
        return pa.Table.from_batches([plan, ask(chunk, keys, rank, buckets)])

    out_ddl = ", ".join(["doc_id long", *(f"{n} {docs.select(c).dtypes[0][1].replace('bigint', 'long')}" for c, n in zip(keep, names)), "text string", "n_words long", "n_removed long"])

    def remove(chunk: int, table: pa.Table, replies: pa.Table) -> pa.Table:
        w = _words(table)
        plan = replies.filter(pa.compute.equal(replies["bucket"], -1))
        marks = np.unpackbits(np.frombuffer(plan["bits"][0].as_py(), np.uint8), count=w.n).astype(bool)
        starts = np.flatnonzero(marks)
        gone = np.zeros(w.n, bool)
        if len(starts):
            _, first, back = np.unique(windows(w.hashes(), window)[starts], return_index=True, return_inverse=True)
            keys = windows(w.hashes(), window)[starts][first]
            again = np.ones(len(starts), bool)
            again[first] = answers(keys, buckets, replies)
            cover = np.zeros(w.n + 1, np.int64)
            np.add.at(cover, starts[again], 1)
            np.add.at(cover, np.minimum(starts[again] + window, w.n), -1)
            gone = np.cumsum(cover[:-1]) > 0
        n_words = np.diff(w.first)
        removed = [int(gone[a:b].sum()) for a, b in zip(w.first[:-1], w.first[1:])]
        texts = [w.kept(d, ~gone[w.first[d] : w.first[d + 1]]).decode("utf-8", "replace") if n or not untouched else None for d, n in enumerate(removed)]
        if untouched:
            texts = pa.compute.if_else(pa.array([n > 0 for n in removed], pa.bool_()), pa.array(texts, pa.string()), table["text"].combine_chunks().fill_null(""))
        return pa.Table.from_arrays([table["doc_id"], *(table[n] for n in names), texts if untouched else pa.array(texts, pa.string()), pa.array(n_words), pa.array(removed, pa.int64())], schema=arrow_schema(out_ddl))

    import pyarrow.compute  # noqa: F401

    replies = answered(chunks.mapInArrow(phrases, ASKED), "shared")
    asked = stored(with_answers(chunks, replies, locate, ASKED), "windows", "uncompressed")
    bits = answered(asked.where("bucket >= 0"), "later").unionByName(asked.where("bucket < 0").select("bucket", "chunk", F.col("keys").alias("bits")))
    out = with_answers(chunks, bits, remove, out_ddl)
    return out.select("doc_id", *(F.col(n).alias(c) for c, n in zip(keep, names)), "text", "n_words", "n_removed")


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLES = {
    "op6_substring_dedup": """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda v: v <> '') AS w FROM documents),
g AS (SELECT doc_id, p, array_to_string(list_slice(w, p, p + 19), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM g) WHERE k > 1),
c AS (SELECT DISTINCT doc_id, p + k AS i FROM r, (SELECT unnest(range(0, 20)) AS k)),
m AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
k AS (SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN m ON d.doc_id = m.doc_id),
u AS (SELECT doc_id, w, gone, unnest(range(1, len(w) + 1)) AS i FROM k),
t AS (SELECT u.doc_id, string_agg(w[i], ' ' ORDER BY i) AS s FROM u ANTI JOIN c ON u.doc_id = c.doc_id AND u.i = c.i GROUP BY u.doc_id)
SELECT k.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed, sha256(coalesce(t.s, '')) AS kept_sha256
FROM k LEFT JOIN t ON k.doc_id = t.doc_id"""
}
QUERIES = {"op6_substring_dedup": op6_substring_dedup}
