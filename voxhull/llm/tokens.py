"""Token ids of whole texts, and the bit-packed file format that holds them (Token-ID / binary output).

Encoding. A byte-level BPE cuts a text into pre-tokens and encodes each on its own. At some places a pre-token opens
whatever stands further away: at a single blank between two visible characters, at a mark behind a letter and others
(``cuts``). So a text can be cut there, and each distinct piece is encoded by the tokenizers library once for as
long as a worker remembers it; ids are the library's for the whole text.

File format. A table of blocks, each one binary value: a header (magic, version, bits, documents, ids), the document
ids, their running id counts (the block offsets), and the ids, each in ``bits`` bits, the fewest that hold the
vocabulary. Any document's ids are found by one shift of the offset, and numpy unpacks a span without a loop.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbers, partitions, rows_per_batch, stored, trimmed, values

MAGIC, VERSION = b"VXTK", 1
NO_ID = -(2**63)  # stands for a null document id
HEADER = struct.Struct("<4sHHqqq")


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of all spans, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


_KIND = np.zeros(256, np.uint8)  # of a byte: 1 ASCII letter, 2 digit, 3 mark, 4 apostrophe, 5 blank, 6 line end, 7 of a longer character; 0: other white space and controls
for _b in range(33, 127):
    _KIND[_b] = 1 if chr(_b).isalpha() else 2 if chr(_b).isdigit() else 4 if chr(_b) == "'" else 3
_KIND[32], _KIND[10], _KIND[128:] = 5, 6, 7
_KIND = _KIND.tobytes()


def cuts(data: bytes) -> np.ndarray:
    """Of each byte of UTF-8, whether the regular expression of byte-level BPE surely opens a pre-token there, whatever stands further away.

    Letters are those of ASCII and of U+00C0 to U+017F but for the two signs among them; longer characters that may be
    white space are never cut at.
    """
    n = len(data)
    a = np.frombuffer(data, np.uint8)
    k = np.frombuffer(data.translate(_KIND), np.uint8)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    shown = (k > 0) & (k < 5)  # visible ASCII
    # a two-byte letter, marked at its second byte
    pair = np.zeros(n, bool)
    pair[1:] = (a[:-1] >= 0xC3) & (a[:-1] <= 0xC5) & ~((a[:-1] == 0xC3) & ((a[1:] == 0x97) | (a[1:] == 0xB7)))
    opens = shown.copy()  # of a byte: a character that is surely no white space opens here
    opens[:-1] |= pair[1:]
    ends = shown | pair
    letter = k == 1
    letter_ends = letter | pair
    mark = k == 3
    # a blank or a line end, alone between two visible characters; what follows the line end; a mark behind a letter; a letter behind a mark
    lone = np.zeros(n, bool)
    lone[1:-1] = ends[:-2] & opens[2:]
    line = (k == 6) & lone
    out |= (k == 5) & lone
    out |= line
    out[1:] |= line[:-1]
    out[1:] |= letter_ends[:-1] & (mark | (k == 4))[1:]
    letter[:-1] |= pair[1:]
    out[1:] |= mark[:-1] & letter[1:]
    return out


class _Codes(dict):
    """Pieces numbered as they are first met."""

    def __missing__(self, piece: bytes) -> int:
        n = self[piece] = len(self)
        return n


class Encoder:
    """Ids of texts by a byte-level BPE file of the tokenizers library, add_special_tokens=False.

    remember: pieces held in memory; beyond it those met often stay. at_once: bytes of texts cut up together, unless
    one text has more. Both change memory and speed alone.
    """

    def __init__(self, path: str, remember: int = 600_000, at_once: int = 4_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.remember, self.at_once = remember, at_once
        self.vocabulary = self.tok.get_vocab_size()
        self.widths = np.zeros(self.vocabulary, np.int64)  # in the byte-level alphabet a token has a character for each byte
        for token, i in self.tok.get_vocab().items():
            self.widths[i] = len(token)
        self._reset()

    def _reset(self) -> None:
        self.codes = _Codes()
        self.flat, self.used = np.empty(1 << 20, np.uint32), 0
        self.start, self.size = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int32)  # of each code's ids in flat
        self.hits = np.zeros(1 << 18, np.int32)
        self.n = 0

    def _forget(self) -> None:
        """Keep what is met often; a corpus has many words that are met once."""
        keep = np.flatnonzero(self.hits[: self.n] >= 3)
        often = np.sort(keep[np.argsort(-self.hits[keep], kind="stable")[: self.remember // 2]])
        held, codes = list(self.codes), _Codes()
        for i, c in enumerate(often.tolist()):
            codes[held[c]] = i
        del held
        size, ids = self.size[often], self.flat[spans(self.start[often], self.size[often])]
        self._reset()
        self._room(len(often))
        self.start[: len(often)] = self._put(ids) + np.cumsum(size) - size
        self.size[: len(often)] = size
        self.codes, self.n = codes, len(often)

    def _ids(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(pieces, add_special_tokens=False)]

    def _put(self, ids: np.ndarray) -> int:
        at = self.used
        if at + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(max(len(ids), len(self.flat)), np.uint32)])
        self.flat[at : at + len(ids)] = ids
        self.used += len(ids)
        return at

    def _room(self, n: int) -> None:
        if n > len(self.start):
            more = max(n - len(self.start), len(self.start))
            self.start, self.size, self.hits = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.start, self.size, self.hits))

    def _learn(self, new: list[bytes]) -> None:
        """Hold the ids of pieces that got codes since the last time.

        Pieces that open with a blank are encoded together, as texts that can be cut between any two of them; as every
        token stands for a fixed number of bytes, their lengths say which ids are whose. The others go one by one.
        """
        n, k = self.n, len(new)
        self._room(n + k)
        sizes = np.fromiter(map(len, new), np.int64, k)
        ends = np.cumsum(sizes)
        data = b"".join(new)
        safe = cuts(data)
        begin = ends - sizes
        blank = np.frombuffer(data, np.uint8)[begin] == 32
        chained = blank & safe[begin]  # cut safely off what stands before it, and
        chained[:-1] &= blank[1:] & safe[begin[1:]]  # off what follows: it has visible characters at both ends
        chained[-1:] = False
        alone = np.flatnonzero(~chained)
        many = np.flatnonzero(chained)
        for lo in range(0, len(many), 2048):
            part = many[lo : lo + 2048]
            run = np.array(self._ids([b"".join([new[j] for j in part.tolist()]).decode()])[0], np.uint32)
            stops = np.searchsorted(np.cumsum(self.widths[run]), np.cumsum(sizes[part])) + 1
            count = np.diff(stops, prepend=0)
            self.start[n + part] = self._put(run) + stops - count
            self.size[n + part] = count
        if len(alone):
            got = self._ids([new[j].decode() for j in alone.tolist()])
            count = np.fromiter(map(len, got), np.int64, len(got))
            self.start[n + alone] = self._put(np.concatenate([np.array(x, np.uint32) for x in got])) + np.cumsum(count) - count
            self.size[n + alone] = count
        self.n += k

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text its ids as uint32; a null has none."""
        flat, ends = self.encode_column(pa.array(texts, pa.string()))
        return np.split(flat, ends[:-1]) if len(texts) else []

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column, one after the other, as uint32, and where each text's end."""
        sizes = pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        special = np.zeros(len(texts), bool)  # the file's added tokens in a text are no matter of the regular expression
        for t in self.special:
            special |= pa.compute.match_substring(texts, t).fill_null(False).to_numpy(zero_copy_only=False)
        flat, counts = [], []
        lo, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            held += n
            if held > self.at_once or i == len(sizes) - 1:
                ids, count = self._encode(texts.slice(lo, i + 1 - lo), sizes[lo : i + 1])
                if special[lo : i + 1].any():
                    ids, count = self._corrected(ids, count, texts.slice(lo, i + 1 - lo), special[lo : i + 1])
                flat.append(ids)
                counts.append(count)
                lo, held = i + 1, 0
        if not flat:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        return np.concatenate(flat), np.cumsum(np.concatenate(counts))

    def _encode(self, texts: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.codes) > self.remember:
            self._forget()
        data = b"".join([x.as_buffer() for x in texts.cast(pa.binary()) if x.is_valid]) if texts.null_count else _bytes_of(texts)
        stops = np.cumsum(sizes)
        opens = cuts(data)
        opens[(stops - sizes)[sizes > 0]] = True
        at = np.append(np.flatnonzero(opens), len(data)).astype(np.int32 if len(data) < 1 << 31 else np.int64)
        kind = pa.binary() if at.dtype == np.int32 else pa.large_binary()
        pieces = pa.Array.from_buffers(kind, len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
        known = pieces.dictionary.to_pylist()
        code = np.fromiter(map(self.codes.__getitem__, known), np.int64, len(known))
        if len(self.codes) > self.n:
            fresh = np.flatnonzero(code >= self.n)
            self._learn([known[j] for j in fresh.tolist()])
        del known
        which = pieces.indices.to_numpy(zero_copy_only=False)
        self.hits[code] += np.bincount(which, minlength=len(code)).astype(np.int32)
        got = code[which]
        lens = self.size[got]
        flat = self.flat[spans(self.start[got], lens)]
        ends = np.concatenate(([0], np.cumsum(lens, dtype=np.int64)))
        return flat, np.diff(ends[np.searchsorted(at[:-1], stops)], prepend=0)

    def _corrected(self, flat: np.ndarray, count: np.ndarray, texts: pa.Array, special: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = np.split(flat, np.cumsum(count)[:-1])
        for i in np.flatnonzero(special).tolist():
            parts[i] = np.array(self._ids([texts[i].as_py()])[0], np.uint32)
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))


def _bytes_of(texts: pa.Array) -> bytes:
    """The bytes of a column without nulls."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32)
    lo, hi = at[texts.offset], at[texts.offset + len(texts)]
    return data[int(lo) : int(hi)].to_pybytes() if data is not None else b""


def with_end(flat: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents' ids one after the other, and where each ends: with end_id behind every document."""
    stops = ends + np.arange(1, len(ends) + 1)
    out = np.empty(len(flat) + len(ends), np.uint32)
    own = np.ones(len(out), bool)
    own[stops - 1] = False
    out[own] = flat
    out[stops - 1] = end_id
    return out, stops


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows: ids take memory beside the batch that holds the texts."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
        trimmed()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder; one for each file, kept over tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# ------------------------------------------------------------------------------------------------ bit packing

def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids, each in ``bits`` bits, little-endian; the last byte is filled up with zeros."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, bits: int, start: int, n: int) -> np.ndarray:
    """n ids from the start-th on, without reading those before them."""
    if bits == 16:
        return np.frombuffer(data, "<u2", n, 2 * start).astype(np.uint32)
    first = start * bits // 8
    raw = np.frombuffer(data, np.uint8)[first : ((start + n) * bits + 7) // 8]
    spread = np.unpackbits(raw, bitorder="little")[start * bits - 8 * first :][: n * bits]
    return spread.reshape(n, bits).astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def write_block(doc_ids: list[int] | np.ndarray, docs: list[np.ndarray], bits: int) -> bytes:
    return block_of(doc_ids, np.fromiter(map(len, docs), np.int64, len(docs)), docs, bits)


def block_of(doc_ids: list[int] | np.ndarray, lens: np.ndarray, parts: list[np.ndarray], bits: int) -> bytes:
    """A block of documents of these lengths, whose ids are those of the parts, one after the other."""
    ends = np.concatenate(([0], np.cumsum(lens))).astype("<i8")
    flat = np.concatenate(parts) if parts else np.empty(0, np.uint32)
    head = HEADER.pack(MAGIC, VERSION, bits, len(lens), len(flat), 0)
    return b"".join((head, np.asarray(doc_ids, "<i8").tobytes(), ends.tobytes(), pack(flat, bits)))


class Block:
    """A block of the format, read in place."""

    def __init__(self, data: bytes):
        magic, version, self.bits, self.n, self.total, _ = HEADER.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token block")
        at = HEADER.size
        self.doc_ids = np.frombuffer(data, "<i8", self.n, at)
        self.offsets = np.frombuffer(data, "<i8", self.n + 1, at + 8 * self.n)
        self.payload = memoryview(data)[at + 16 * self.n + 8 :]

    def document(self, k: int) -> np.ndarray:
        """Ids of the block's k-th document alone."""
        a, b = int(self.offsets[k]), int(self.offsets[k + 1])
        return unpack(self.payload, self.bits, a, b - a)


BLOCKS = "part long, block long, start_in_part long, n_ids long, data binary"


def write_tokens(docs: DataFrame, path: str, end_id: int = 0, block_ids: int = 1 << 19) -> DataFrame:
    """The table of token blocks of docs(doc_id, text), in ascending order of doc_id over (part, block).

    docs: null texts are empty, rows with one doc_id stand in the order of their texts; further columns are ignored.
    Rows without a doc_id come first. path: the tokenizer's file, readable on every
    executor. block_ids: a block is closed once it holds so many ids. Texts are dealt by ranges of doc_id before they are encoded, so sampling
    for the ranges reads doc_id and nothing is encoded twice; a part's blocks are written by one task, in order.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(path)
        bits, block, before = bits_for(max(enc.vocabulary, end_id + 1)), 0, 0
        ids, lens, held, n = [], [], [], 0

        def close() -> pa.RecordBatch:
            data = block_of(np.concatenate(ids), np.concatenate(lens), held, bits)
            return pa.RecordBatch.from_pydict({"part": [part], "block": [block], "start_in_part": [before], "n_ids": [n], "data": [data]}, schema=BLOCK_ARROW)

        for batch in slices(batches):
            keys = values(batch, "doc_id").fill_null(NO_ID).to_numpy()
            flat, ends = with_end(*enc.encode_column(values(batch, "text")), end_id)
            at, lo = 0, 0  # documents and ids of the batch that are in blocks
            while at < len(ends):
                hi = min(int(np.searchsorted(ends, lo + block_ids - n)) + 1, len(ends))  # the document that fills the block is its last
                ids.append(keys[at:hi])
                lens.append(np.diff(ends[at:hi], prepend=lo))
                held.append(flat[lo : ends[hi - 1]])
                n += int(ends[hi - 1]) - lo
                at, lo = hi, int(ends[hi - 1])
                if n >= block_ids:
                    yield close()
                    block, before = block + 1, before + n
                    ids, lens, held, n = [], [], [], 0
        if n:
            yield close()

    n = partitions(docs.sparkSession)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    with rows_per_batch(docs.sparkSession, 2000):
        return stored(ordered.mapInArrow(encode, BLOCKS), "tokens", "uncompressed")


BLOCK_ARROW = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("start_in_part", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())])


def read_tokens(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the blocks as written.

    A part's ids before it are the sums over parts, of which there are as many as write tasks, so they are few.
    """
    spark = blocks.sparkSession
    sums = sorted((r.part, r.n) for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before, at = {}, 0
    for part, n in sums:
        before[part] = at
        at += n

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(numbers(batch, "part").tolist(), numbers(batch, "start_in_part").tolist(), values(batch, "data"))
            for part, start, data in rows:
                b = Block(data.as_py())
                flat = unpack(b.payload, b.bits, 0, b.total)
                cut = b.offsets.tolist()
                raw = flat.astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(b.doc_ids, mask=b.doc_ids == NO_ID),
                        pa.array(b.offsets[:-1] + (before[part] + start)),
                        pa.array(np.diff(b.offsets)),
                        pa.array([zlib.crc32(raw[i:j]) for i, j in zip(cut, cut[1:])], pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    del spark
    return blocks.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_binary(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_tokens(write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0))


QUERIES = {"op4_token_binary": op4_token_binary}
