"""Documents in chunks, and questions between chunks about 64-bit keys.

A chunk is one row: some megabytes of documents, ordered by doc_id, as a compressed Arrow stream. Chunks are a stored
table, so each pass over them sees the same chunks whatever becomes of an executor.

Questions. A chunk sends every key it holds once, dealt into buckets by the key's hash: one row for each bucket, with
the keys as one sorted array. So a key that a third of all rows hold comes from each chunk once, a bucket is a fair
share of the distinct keys, and a bucket's task answers with one bit a key. There are as many buckets as the chunks call for. Two answers exist: is the key held by
another chunk too (``shared``), and is there another chunk whose first holder comes earlier (``later``)?
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, partitions, stored, trimmed

NULL_ID = -(2**63)  # orders a null doc_id before all others
A_BUCKET = 6  # chunks whose keys, at most some ten megabytes each, make a bucket
ASKED = "bucket int, chunk long, keys binary, ranks binary"
ASKED_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("ranks", pa.binary())])


def chunked(docs: DataFrame, columns: list[str], most: int = 6_000_000) -> DataFrame:
    """docs in a stored table (chunk, data) of at most ``most`` bytes of text a row, unless one text has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 24, [], 0

        def close() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).sort_by([("doc_id", "ascending")])
            nulls = table.filter(table["doc_id"].is_null())
            table = pa.concat_tables([nulls, table.filter(table["doc_id"].is_valid())]).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "data"])

        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
            lo = 0
            for i, n in enumerate(sizes.tolist()):
                size += n
                if size >= most:
                    held.append(batch.slice(lo, i + 1 - lo))
                    yield close()
                    number, held, size, lo = number + 1, [], 0, i + 1
            if lo < batch.num_rows:
                held.append(batch.slice(lo))
        if held:
            yield close()

    import pyarrow.compute  # noqa: F401

    first = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *columns)
    return stored(first.mapInArrow(run, "chunk long, data binary"), "chunks", "uncompressed")


def opened(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def order_ids(table: pa.Table) -> np.ndarray:
    return table["doc_id"].fill_null(NULL_ID).to_numpy()


def ask(chunk: int, keys: np.ndarray, ranks: np.ndarray | None, buckets: int) -> pa.RecordBatch:
    """The rows in which a chunk sends its keys: distinct, in any order; ranks: what orders holders, smaller first."""
    bucket, order = dealt(keys, buckets)
    keys, bucket = keys[order], bucket[order]
    at = np.searchsorted(bucket, np.arange(buckets + 1))
    used = np.flatnonzero(np.diff(at))
    sent = None if ranks is None else ranks[order].astype("<i8")
    return pa.RecordBatch.from_arrays(
        [
            pa.array(used, pa.int32()),
            pa.array(np.full(len(used), chunk), pa.int64()),
            pa.array([keys[at[b] : at[b + 1]].tobytes() for b in used], pa.binary()),
            pa.array([b"" if sent is None else squeezed(sent[at[b] : at[b + 1]]) for b in used], pa.binary()),
        ],
        schema=ASKED_ARROW,
    )


def squeezed(ranks: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes each: width, least, differences to it."""
    least = int(ranks.min())
    span = ranks.astype(np.int64).view(np.uint64) - np.uint64(least & 0xFFFFFFFFFFFFFFFF)
    width = max(1, (int(span.max()).bit_length() + 7) // 8)
    body = span.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + least.to_bytes(8, "little", signed=True) + body.tobytes()


def spread(data: bytes) -> np.ndarray:
    width, least = data[0], int.from_bytes(data[1:9], "little", signed=True)
    body = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    out = np.zeros((len(body), 8), np.uint8)
    out[:, :width] = body
    return (out.view("<u8").ravel() + np.uint64(least & 0xFFFFFFFFFFFFFFFF)).view(np.int64)


def dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Each key's bucket, and the order by bucket and key in which ask() sends and answers() gives them back."""
    bucket = (mixed(keys ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(buckets)).astype(np.int64)
    return bucket, np.lexsort((keys, bucket))


def n_buckets(chunks: DataFrame) -> int:
    """As many that a bucket is a share of the keys of A_BUCKET chunks at most, so a task holds no more however much there is."""
    return max(2 * partitions(chunks.sparkSession), math.ceil(chunks.count() / A_BUCKET))


def answered(asked: DataFrame, kind: str) -> DataFrame:
    """(bucket, chunk, bits) for each row of asked. kind: shared, later, or flagged: has any holder the rank 1?"""

    def run(table: pa.Table) -> pa.Table:
        rows = [np.frombuffer(k.as_py(), "<u8") for c in table["keys"].chunks for k in c]
        chunks = table["chunk"].to_numpy()
        lens = np.fromiter(map(len, rows), np.int64, len(rows))
        keys, row = np.concatenate(rows), np.repeat(np.arange(len(rows)), lens)
        if kind == "later":
            ranks = np.concatenate([spread(k.as_py()) for c in table["ranks"].chunks for k in c])
            order = np.lexsort((chunks[row], ranks, keys))
        else:
            order = np.argsort(keys, kind="stable")
        same = np.diff(keys[order]) == 0
        bits = np.zeros(len(keys), bool)
        if kind == "flagged":
            group = np.concatenate(([0], np.cumsum(~same)))
            flags = np.concatenate([spread(k.as_py()) for c in table["ranks"].chunks for k in c])[order]
            bits[order] = np.bincount(group, flags)[group] > 0
        else:
            bits[order[1:]] = same  # not the first of its key
        if kind == "shared":
            bits[order[:-1]] |= same
        ends = np.cumsum(lens)
        return pa.table({
            "bucket": table["bucket"],
            "chunk": table["chunk"],
            "bits": pa.array([np.packbits(bits[e - n : e]).tobytes() for n, e in zip(lens, ends)], pa.binary()),
        })

    return asked.groupBy("bucket").applyInArrow(run, "bucket int, chunk long, bits binary")


def answers(keys: np.ndarray, buckets: int, table: pa.Table) -> np.ndarray:
    """Of each key, in the order given, the bit that answered() has for it."""
    bucket, order = dealt(keys, buckets)
    out = np.zeros(len(keys), bool)
    at = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b, bits in zip(table["bucket"].to_pylist(), table["bits"].to_pylist()):
        if b >= 0:
            n = int(at[b + 1] - at[b])
            out[order[at[b] : at[b + 1]]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
    return out


def with_answers(chunks: DataFrame, replies: DataFrame, run: Callable[[int, pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """run(chunk, documents, replies) for every chunk."""

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([], schema=EMPTY[0])
        out = run(left["chunk"][0].as_py(), opened(left["data"][0].as_py()), right)
        trimmed()
        return out

    EMPTY = [arrow_schema(schema)]
    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(each, schema)


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    return pa.schema([(c.split()[0].strip("`"), kinds[c.split()[1]]) for c in ddl.split(", ")])
