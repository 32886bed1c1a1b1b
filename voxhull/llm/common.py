"""What the operators of this subpackage share: scratch tables, column handling and vectorised text kernels.

Scratch tables live in the folder the session names in ``spark.checkpoint.dir`` and are written by Spark, so
every executor reads them back from the shared store, and a lost executor costs a reread, not a recomputation.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII blanks of the word definition ``[^\x20\x09-\x0D]+``; bytes.split() cuts at the same six.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; where none is set, a temporary one on a single machine, as in tests. A cluster needs one."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    held = spark.conf.get("spark.voxhull.scratch", None)
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        held = "file://" + tempfile.mkdtemp(prefix="voxhull-")
        spark.conf.set("spark.voxhull.scratch", held)
    return held


def stored(df: DataFrame, what: str, compression: str = "zstd") -> DataFrame:
    """df written to a table of its own in the shared folder, and that table. It cuts lineage for good."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.scratch_path = path
    return out


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, queries that run send at most so many rows to Python at once: long texts in large batches fill memory on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def dropped(*tables: DataFrame, shuffles: bool = True) -> None:
    """Delete tables of stored() that later ones have replaced, and, with shuffles, let Spark clear the shuffle files of what made them.

    Spark clears these once the driver's JVM collects their owner, which a driver with a large heap may not do for hours.
    """
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if tables and shuffles:
        for _ in range(2):  # the first collection frees what the second one's queue of references then sees
            gc.collect()
            tables[0].sparkSession._jvm.System.gc()


def trimmed() -> None:
    """Give a Python worker's freed memory back to the machine, where its C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(col, UPPER, LOWER)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column without nulls as numpy values."""
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def values(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


# ---------------------------------------------------------------------------------------------- text kernels

def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _inverse(a: int) -> int:
    """Of an odd number modulo 2**64."""
    x = a
    for _ in range(6):
        x = x * (2 - a * x) & 0xFFFFFFFFFFFFFFFF
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[:1] = 1
    done, step = 1, base
    while done < n:  # doubling: out[done:2*done] = out[:done] * base**done
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(step)
        step = step * step & 0xFFFFFFFFFFFFFFFF
        done += take
    return out


def span_hashes(a: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """A 64-bit hash of each a[start:end]; starts ascending. step: spans at a time, which keeps arrays in cache."""
    out = np.empty(len(starts), np.uint64)
    inv = _inverse(_BASE)
    lo = 0
    while lo < len(starts):
        hi = min(len(starts), lo + step, max(lo + 1, int(np.searchsorted(starts, starts[lo] + (1 << 20)))))
        s0, s1 = int(starts[lo]), int(ends[lo:hi].max())
        piece = a[s0:s1]
        sums = np.empty(len(piece) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[piece] * _powers(_BASE, len(piece)), out=sums[1:])
        s, e = starts[lo:hi] - s0, ends[lo:hi] - s0
        out[lo:hi] = mixed((sums[e] - sums[s]) * _powers(inv, len(piece) + 1)[s] + (e - s).astype(np.uint64))
        lo = hi
    return out


class Words:
    """The words of a batch of texts, all in one buffer.

    buf: the bytes, texts separated by a blank. starts, ends: of each word in buf. doc: of each word, the text's
    number. first: of each text, its first word's number, and at the end the number of words.
    """

    def __init__(self, texts: list[bytes], table: bytes):
        """table: 256 bytes for bytes.translate; it turns what separates words into blanks (0x20)."""
        joined = b" ".join(texts) + b" "
        self.buf = joined.translate(table)
        a = np.frombuffer(self.buf, np.uint8)
        word = a != 32
        edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        self.starts, self.ends = edge[0::2], edge[1::2]
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        stops = np.cumsum(sizes)
        self.first = np.concatenate(([0], np.searchsorted(self.starts, stops)))
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.n = len(self.starts)
        self.bytes = a

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return span_hashes(self.bytes, self.starts, self.ends)

    def word(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]]

    def kept(self, d: int, keep: np.ndarray | None = None) -> bytes:
        """Of text d its words, or those that keep marks, joined by one blank."""
        lo, hi = int(self.first[d]), int(self.first[d + 1])
        s, e = self.starts[lo:hi], self.ends[lo:hi]
        if keep is not None:
            s, e = s[keep], e[keep]
        buf = self.buf
        return b" ".join([buf[i:j] for i, j in zip(s.tolist(), e.tolist())])


def blanks_table() -> bytes:
    """The words [^\x20\x09-\x0D]+, unchanged."""
    t = bytearray(range(256))
    for b in BLANKS.encode():
        t[b] = 32
    return bytes(t)


def alnum_table() -> bytes:
    """A-Z lower-cased; the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+."""
    t = bytearray(range(256))
    for b in range(128):
        c = chr(b).lower().encode()[0]
        t[b] = c if chr(c).isdigit() or "a" <= chr(c) <= "z" else 32
    return bytes(t)


def lower_blanks_table() -> bytes:
    """As blanks_table, with A-Z lower-cased."""
    t = bytearray(blanks_table())
    for a, b in zip(UPPER.encode(), LOWER.encode()):
        t[a] = b
    return bytes(t)


def windows(h: np.ndarray, n: int, salt: int = 1) -> np.ndarray:
    """For each i the hash of h[i:i+n]; len(h) - n + 1 of them, none if h is shorter."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    base = int(mixed(np.array([salt], np.uint64))[0]) | 1
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out += h[j : j + m]
        if j + 1 < n:
            out *= np.uint64(base)
    return mixed(out)


def text_bytes(col: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]
