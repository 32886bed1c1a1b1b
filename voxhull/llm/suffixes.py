"""Suffix-array dedup by a distributed difference-cover algorithm: bytes under any 400-byte string that recurs.

Names. Documents are cut into phrases where the hash of eight bytes is the least within some reach on either side, so a cut
is the same in every copy of the text around it; a phrase's name is a hash of its bytes with the surroundings of both cuts. Names held once in the corpus can't lie inside a
recurring string, so the suffixes that count are those that start at phrases in runs of recurring names.

Suffix order, over names, by the difference cover {1, 2} modulo 3 of positions in a run. Chunks send their distinct
triples of names at covered positions, each to the task of a range; it sorts them and answers with names of triples in
order. The covered positions, as a string of these, are ordered by recursion, which ends once a name spans all the
phrases that 400 bytes take. The remaining suffixes are merged: one is placed before or after covered ones by
(name, rank of the next) and (name, name, rank of the one after), two sorts by plain keys in ranges.
At last each suffix's names are compared with those of its neighbours in the order.

Bytes. The longest match at every cut settles nearly all windows of 400 bytes: those within it recur. Open are windows
that begin before a cut whose longest match begins at the cut, or end behind its last whole phrase. They and all windows
around the same phrases, and windows with too few cuts to tell, are asked for by hash.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ASKED, answered, answers, arrow_schema, ask, chunked, n_buckets, opened, with_answers
from .common import dropped, mixed, span_hashes, stored, text_bytes

REACH = 40
CUT = 2 * REACH + 8  # the bytes that decide on a cut
ROUND = "bucket int, chunk long, keys binary, n long"
_ROUND = arrow_schema(ROUND)
STATE, NAMES = -1, -2  # the buckets of a chunk's own state, and of the names that the suffix order needs


# ----------------------------------------------------------------------------------------------- cuts and runs

class Cuts:
    """The texts of a chunk in one buffer, the starts s of what decides on their cuts, and the phrases a[s:e]."""

    def __init__(self, table: pa.Table):
        texts = [x for c in table["text"].chunks for x in text_bytes(c)]
        self.buf = b"".join(texts)
        self.a = a = np.frombuffer(self.buf, np.uint8)
        self.doc_at = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        n = len(a) - 7
        if n > 2 * REACH:
            v = np.zeros(n, np.uint64)
            for j in range(8):
                v |= a[j : j + n].astype(np.uint64) << np.uint64(8 * j)
            v = mixed(v)
            m = n - 2 * REACH
            least = lowest(v, REACH)  # of v[i : i + REACH]
            here = v[REACH : REACH + m]
            s = np.flatnonzero((here < least[:m]) & (here <= least[REACH + 1 : REACH + 1 + m]))
            doc = np.searchsorted(self.doc_at, s, "right") - 1
            inside = s + CUT <= self.doc_at[doc + 1]
            s, doc = s[inside], doc[inside]
        else:
            s = doc = np.empty(0, np.int64)
        self.s, self.doc, m = s, doc, len(s)
        self.start, self.end = self.doc_at[doc], self.doc_at[doc + 1]
        follows = doc[1:] == doc[:-1]
        self.last = np.ones(m, bool)
        self.last[:-1] = ~follows
        self.prev = self.start - 1  # windows of a cut start after the cut before it
        self.prev[1:] = np.where(follows, s[:-1], self.prev[1:])
        self.next = self.end.copy()
        self.next[:-1] = np.where(follows, s[1:], self.next[:-1])
        self.e = np.where(self.last, self.end, self.next + CUT)
        self.name = span_hashes(a, s, self.e) | np.uint64(1)

    def bare(self, size: int) -> np.ndarray:
        """Starts of windows that don't hold a whole phrase between two cuts."""
        hi = np.minimum(self.s, self.end - size)  # the last window of a cut
        told = np.where(self.last, hi + 1, np.maximum(self.prev + 1, self.e - size))  # from here on it holds its phrase
        first = [self.prev + 1, np.where(self.last, self.s + 1, 0)]
        stop = [np.minimum(hi + 1, told), np.where(self.last, self.end - size + 1, 0)]
        alone = np.setdiff1d(np.arange(len(self.doc_at) - 1), self.doc)
        first.append(self.doc_at[alone])
        stop.append(self.doc_at[alone + 1] - size + 1)
        return np.sort(ranges(np.concatenate(first), np.concatenate(stop)))


def lowest(v: np.ndarray, n: int) -> np.ndarray:
    """The least of each v[i:i+n], by doubling."""
    out, done = v, 1
    while done < n:
        by = min(done, n - done)
        out = np.minimum(out[:-by], out[by:])
        done += by
    return out


def ranges(first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    n = np.maximum(stop - first, 0)
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - n), n)


def select_runs(c: Cuts, recurs: np.ndarray, size: int) -> np.ndarray:
    """Positions of the phrases in runs of recurring names that, with a phrase on either side, are long enough."""
    m = len(c.s)
    if not m:
        return np.empty(0, np.int64)
    head = recurs & ~np.concatenate(([False], recurs[:-1] & ~c.last[:-1]))
    tail = recurs & ~np.concatenate((recurs[1:] & ~c.last[:-1], [False]))
    first, last = np.flatnonzero(head), np.flatnonzero(tail)
    beyond = np.where(c.last[last], c.e[last], c.e[np.minimum(last + 1, m - 1)])
    long = beyond - (c.prev[first] + 1) >= size
    return ranges(first[long], last[long] + 1)


# ----------------------------------------------------------------------------------------- sorts of ranged keys

def rows_of(cols: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of columns, and of each row its number among them."""
    order = np.lexsort(cols[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in cols:
        new[1:] |= np.diff(c[order]) != 0
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    return [c[order[new]] for c in cols], back


def send(chunk: int, bucket: np.ndarray, cols: list[np.ndarray], tail: list[np.ndarray] | None = None) -> list[pa.RecordBatch]:
    """Rows of columns, ascending by bucket, a row for each bucket. tail: arrays that go after the columns, one a row."""
    out = []
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(bucket)]):
        data = np.concatenate([c[lo:hi] for c in cols]).astype("<u8").tobytes()
        if tail is not None:
            part = tail[lo:hi]
            data += np.fromiter(map(len, part), np.uint64, hi - lo).tobytes() + np.concatenate(part).tobytes()
        out.append((int(bucket[lo]), chunk, data, hi - lo))
    if not out:
        return []
    return [pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary(), pa.int64()))], schema=_ROUND)]


def state_row(chunk: int, state: dict, n: int = 0, bucket: int = STATE) -> pa.RecordBatch:
    data = zlib.compress(pickle.dumps({k: slim(v) for k, v in state.items()}), 1)
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([chunk], pa.int64()), pa.array([data], pa.binary()), pa.array([n], pa.int64())], schema=_ROUND)


def slim(v):
    """Whole numbers in 32 bits where they fit; positions in a chunk nearly always do."""
    if isinstance(v, np.ndarray) and v.dtype == np.int64 and (not v.size or (v.min() >= -(2**31) and v.max() < 2**31)):
        return v.astype(np.int32)
    return v


def state_of(data: bytes) -> dict:
    state = pickle.loads(zlib.decompress(data))
    return {k: v.astype(np.int64) if isinstance(v, np.ndarray) and v.dtype == np.int32 else v for k, v in state.items()}


def sorted_rows(asked: DataFrame, kind: str, width: int) -> DataFrame:
    """(bucket, chunk, keys, n): one 64-bit answer for each row sent; in n, for kind pred, the bucket's largest rank.

    name: the rows' order as ids, equal for equal rows. pred: the largest last column among rows up to this one.
    near: the number of leading names shared with the row before or behind in the order, which every row brings along.
    """

    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        lens = table["n"].to_numpy()
        blobs = [np.frombuffer(k.as_py(), "<u8") for c in table["keys"].chunks for k in c]
        cols = [np.concatenate([b[i * n : (i + 1) * n] for b, n in zip(blobs, lens)]) for i in range(width)]
        order = np.lexsort(cols[::-1])
        out, top = np.zeros(len(order), np.uint64), 0
        if kind == "name":
            new = np.zeros(len(order), bool)
            for c in cols:
                new[1:] |= np.diff(c[order]) != 0
            out[order] = (np.uint64(bucket) << np.uint64(40)) + np.cumsum(new).astype(np.uint64) + np.uint64(1)
        elif kind == "pred":
            best = np.maximum.accumulate(cols[-1][order])
            out[order], top = best, int(best[-1])
        else:
            size = np.concatenate([b[width * n : (width + 1) * n] for b, n in zip(blobs, lens)]).astype(np.int64)
            names = np.concatenate([b[(width + 1) * n :] for b, n in zip(blobs, lens)])
            begin = np.cumsum(size) - size
            a, b = order[:-1], order[1:]
            common, alive = np.zeros(len(a), np.int64), np.arange(len(a))
            while len(alive):
                alive = alive[(common[alive] < size[a[alive]]) & (common[alive] < size[b[alive]])]
                k = common[alive]
                alive = alive[names[begin[a[alive]] + k] == names[begin[b[alive]] + k]]
                common[alive] += 1
            most = np.zeros(len(order), np.int64)
            most[1:] = common
            most[:-1] = np.maximum(most[:-1], common)
            out[order] = most.astype(np.uint64)
        ends = np.cumsum(lens)
        return pa.table({
            "bucket": table["bucket"], "chunk": table["chunk"],
            "keys": pa.array([out[e - n : e].tobytes() for n, e in zip(lens, ends)], pa.binary()),
            "n": pa.array([top] * len(lens), pa.int64()),
        }, schema=_ROUND)

    return asked.where("bucket >= 0").groupBy("bucket").applyInArrow(run, ROUND)


def received(replies: pa.Table) -> np.ndarray:
    """The answers in the order of the rows sent; empty if none was."""
    got = sorted(zip(replies["bucket"].to_pylist(), replies["keys"].to_pylist()))
    return np.concatenate([np.frombuffer(k, "<u8") for b, k in got if b >= 0]) if len(got) else np.empty(0, np.uint64)


def next_round(before: DataFrame, replies: DataFrame, run: Callable[[int, dict, pa.Table], list[pa.RecordBatch]], what: str, done: tuple[DataFrame, ...] = (), bucket: int = STATE) -> DataFrame:
    """Each chunk's state (its row of that bucket) and replies become its next state and questions, a stored table.

    done: tables that go then.
    """

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([], schema=_ROUND)
        return pa.Table.from_batches(run(left["chunk"][0].as_py(), state_of(left["keys"][0].as_py()), right), schema=_ROUND)

    states = before.where(F.col("bucket") == bucket)
    out = stored(states.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(each, ROUND), what, "uncompressed")
    if done:
        dropped(*done)
    return out


# ------------------------------------------------------------------------------------------- difference covers

class Level:
    """A string of names in runs; its covered positions, in the order in which they are the next level's string."""

    def __init__(self, name: np.ndarray, run: np.ndarray):
        self.name, self.run = name, run
        n = len(name)
        head = np.flatnonzero(np.diff(run, prepend=-1))
        self.cls = (np.arange(n) - np.repeat(head, np.diff(head, append=n))) % 3
        at = np.flatnonzero(self.cls)
        self.cover = at[np.lexsort((at, self.cls[at], run[at]))]

    def ahead(self, x: np.ndarray, by: int) -> np.ndarray:
        """x at the position ``by`` further in the run; 0, before all else, behind its end."""
        out = np.zeros(len(x), np.uint64)
        if by < len(x):
            same = self.run[by:] == self.run[:-by]
            out[:-by][same] = x[by:][same]
        return out

    def below(self, names: np.ndarray) -> Level:
        """The string of the covered positions with their triples' names."""
        run = self.run[self.cover] * 2 + self.cls[self.cover] - 1
        return Level(names, run)

    def spread(self, ranks: np.ndarray) -> np.ndarray:
        """The next level's ranks at the positions here; 0 where not covered."""
        out = np.zeros(len(self.name), np.uint64)
        out[self.cover] = ranks
        return out


def ranged(x: np.ndarray, level: int, buckets: int) -> np.ndarray:
    """The bucket of a range of first keys: hashes at level 0, and ids that start with their bucket above."""
    if level:
        return (x >> np.uint64(40)).astype(np.int64)
    return (((x >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def sorted_by_bucket(bucket: np.ndarray, cols: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct rows in the order of buckets, and of each row its number among them."""
    (b, *kept), back = rows_of([bucket.astype(np.uint64), *cols])
    return b.astype(np.int64), kept, back


# -------------------------------------------------------------------------------------------------- the operator

def remove_recurring(docs: DataFrame, size: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary): a row for each row of docs(doc_id, text).

    Removed is each UTF-8 byte under a string of ``size`` bytes that starts anywhere else too, in the same document or
    another; rows that repeat a doc_id are documents of their own. Null texts are empty; shorter texts lose nothing.
    """
    chunks = chunked(docs, [])
    buckets = n_buckets(chunks)

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield ask(chunk, np.unique(Cuts(opened(data.as_py())).name), None, buckets)

    def select(chunk: int, table: pa.Table, replies: pa.Table) -> pa.Table:
        c = Cuts(table)
        keys, back, count = np.unique(c.name, return_inverse=True, return_counts=True)
        at = select_runs(c, ((count > 1) | answers(keys, buckets, replies))[back] if len(keys) else np.zeros(0, bool), size)
        # what all windows of the selected cuts lie in: their bytes, without gaps between runs
        lo = np.maximum(c.prev[at] + 1, 0)
        hi = np.maximum(c.s[at] + size, np.where(c.last[at], c.e[at], 0))
        held = np.zeros(len(c.a) + 1, np.int64)
        np.add.at(held, lo, 1)
        np.add.at(held, np.minimum(hi, c.end[at]), -1)
        keep = np.flatnonzero(np.cumsum(held[:-1]) > 0)
        bare = c.bare(size)
        runs = np.flatnonzero(np.diff(bare, prepend=-2) != 1)
        # phrases whose prefix of names decides: up to size bytes from the next cut on, or the run's end
        fresh = np.diff(at, prepend=-2) != 1
        fresh[1:] |= c.last[at[:-1]]  # a run ends with its document
        run = np.cumsum(fresh)
        run_stop = np.searchsorted(run, run, "right")
        reach = np.searchsorted(c.e[at], c.next[at] + size, "left") + 1
        n_names = np.minimum(reach, run_stop) - np.arange(len(at))
        after = np.where(c.last[at], c.e[at], c.e[np.minimum(at + 1, len(c.s) - 1)]) if len(at) else at
        state = {
            "bytes": c.a[keep].tobytes(), "keep": keep[np.diff(keep, prepend=-2) != 1], "stop": keep[np.diff(keep, append=len(c.a) + 2) != 1] + 1,
            "s": c.s[at], "e": c.e[at], "prev": c.prev[at], "next": c.next[at], "end": c.end[at], "last": c.last[at], "after": after,
            "run": run, "n_names": n_names, "name": c.name[at],
            "bare": np.stack([bare[runs], bare[np.append(runs[1:], len(bare)) - 1] + 1]) if len(bare) else np.zeros((2, 0), np.int64),
            "bare_keys": np.unique(span_hashes(c.a, bare, bare + size)),
        }
        light = {k: state[k] for k in ("name", "run", "n_names")}
        return pa.Table.from_batches([state_row(chunk, state, int(n_names.max(initial=1))), state_row(chunk, light, 0, NAMES)])

    first = stored(with_answers(chunks, answered(chunks.mapInArrow(names, ASKED), "shared"), select, ROUND), "cuts", "uncompressed")
    longest = first.agg(F.max("n").alias("n")).first().n or 1
    depth = 1
    while 3**depth < longest:
        depth += 1
    return removed(chunks, windows_of(first, suffix_order(first, buckets, depth), buckets, size), size, buckets)


def levels_of(state: dict) -> list[Level]:
    out = [Level(state["levels"][0], state["run"])]
    for names in state["levels"][1:]:
        out.append(out[-1].below(names))
    return out


def suffix_order(first: DataFrame, buckets: int, depth: int) -> DataFrame:
    """(bucket, chunk, keys, n): for each chunk, how many names each suffix shares with its nearest in the suffix order."""
    none = first.sparkSession.createDataFrame([], ROUND)

    def triples(chunk: int, state: dict, replies: pa.Table) -> list[pa.RecordBatch]:
        if "levels" not in state:
            state = {"levels": [state["name"]], "run": state["run"], "n_names": state["n_names"]}
        else:
            state["levels"].append(received(replies)[state.pop("sent")])
        levels = levels_of(state)
        top = levels[-1]
        if len(levels) <= depth:
            cols = [x[top.cover] for x in (top.name, top.ahead(top.name, 1), top.ahead(top.name, 2))]
            b, cols, state["sent"] = sorted_by_bucket(ranged(cols[0], len(levels) - 1, buckets), cols)
            return [state_row(chunk, state), *send(chunk, b, cols)]
        state["rank"] = top.name  # names that span enough are ranks
        return [state_row(chunk, state)]

    states, replies = first, none
    for level in range(depth + 1):
        states = next_round(states, replies, triples, "triples", (states,) if level else (), STATE if level else NAMES)
        replies = sorted_rows(states, "name", 3) if level < depth else none

    for level in range(depth - 1, -1, -1):

        def place(chunk: int, state: dict, replies: pa.Table, level: int = level) -> list[pa.RecordBatch]:
            here = levels_of(state)[level]
            r = here.spread(state["rank"])
            rest = here.cls == 0
            one, two = rest | (here.cls == 1), rest | (here.cls == 2)
            zero = np.zeros(len(r), np.uint64)
            sort_a = [here.name, here.ahead(r, 1), zero, r]
            sort_b = [here.name, here.ahead(here.name, 1), here.ahead(r, 2), r]
            at = np.concatenate((np.flatnonzero(one), np.flatnonzero(two)))
            tag = np.repeat([0, 1], [int(one.sum()), int(two.sum())])
            cols = [np.concatenate((x[one], y[two])) for x, y in zip(sort_a, sort_b)]
            b, cols, back = sorted_by_bucket(2 * ranged(cols[0], level, buckets) + tag, cols)
            state["sent"], state["tag"], state["at"] = back, tag, at
            return [state_row(chunk, state), *send(chunk, b, cols)]

        states = next_round(states, none, place, "merge", (states,))
        replies = stored(sorted_rows(states, "pred", 4), "merged", "uncompressed")
        tops = sorted((r.bucket, r.n) for r in replies.groupBy("bucket").agg(F.max("n").alias("n")).collect())  # one for each range
        carry = np.zeros((2, 2 * buckets + 4), np.uint64)
        for b, n in tops:
            carry[b % 2, b // 2 + 1] = n
        carry = np.maximum.accumulate(carry, axis=1)

        def settle(chunk: int, state: dict, replies: pa.Table, level: int = level, carry: np.ndarray = carry) -> list[pa.RecordBatch]:
            here = levels_of(state)[level]
            back, tag, at = state.pop("sent"), state.pop("tag"), state.pop("at")
            r = here.spread(state["rank"])
            key = r.copy()
            if len(at):
                got = np.maximum(received(replies)[back], carry[tag, ranged(here.name[at], level, buckets)])
                rest = here.cls[at] == 0
                np.maximum.at(key, at[rest], got[rest])  # the nearest covered suffix before it
            cols = [key, (here.cls == 0).astype(np.uint64), here.name, here.ahead(r, 1)]
            if level:
                b, cols, state["sent"] = sorted_by_bucket((key >> np.uint64(40)).astype(np.int64), cols)
                return [state_row(chunk, state), *send(chunk, b, cols)]
            b, cols, back = sorted_by_bucket(ranged(here.name, 0, buckets), cols)
            n, name = state["n_names"], here.name
            some = np.zeros(len(b), np.int64)
            some[back] = np.arange(len(back))
            tail = [name[i : i + n[i]] for i in some.tolist()]
            state["sent"], state["twice"] = back, np.bincount(back, minlength=len(b))[back] > 1
            return [state_row(chunk, state), *send(chunk, b, cols, tail)]

        states = next_round(states, replies, settle, "merge", (states, replies))
        if level:
            replies = sorted_rows(states, "name", 4)

            def ranks(chunk: int, state: dict, replies: pa.Table) -> list[pa.RecordBatch]:
                state["rank"] = received(replies)[state.pop("sent")]
                return [state_row(chunk, state)]

            states = next_round(states, replies, ranks, "ranks", (states,))

    def matched(chunk: int, state: dict, replies: pa.Table) -> list[pa.RecordBatch]:
        k = np.where(state["twice"], state["n_names"], received(replies)[state["sent"]].astype(np.int64))
        return [pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([chunk], pa.int64()), pa.array([k.astype("<i4").tobytes()], pa.binary()), pa.array([0], pa.int64())], schema=_ROUND)]

    return next_round(states, sorted_rows(states, "near", 4), matched, "matches", (states,))


def windows_of(first: DataFrame, matches: DataFrame, buckets: int, size: int) -> DataFrame:
    """States with "sure", ranges of starts that recur, and "open", starts whose windows' hashes are asked for."""

    def asks(chunk: int, keys: np.ndarray, n: int) -> list[pa.RecordBatch]:
        if not len(keys):
            return []
        out = ask(chunk, keys, None, buckets)
        return [pa.RecordBatch.from_arrays([*out.columns[:3], pa.array([n] * out.num_rows, pa.int64())], schema=_ROUND)]

    def judged(chunk: int, state: dict, replies: pa.Table) -> list[pa.RecordBatch]:
        s, e, n, run = state["s"], state["e"], state["n_names"], state["run"]
        k = np.frombuffer(replies["keys"][0].as_py(), "<i4").astype(np.int64)
        i, top = np.arange(len(s)), max(len(s) - 1, 0)
        run_stop = np.searchsorted(run, run, "right")
        length, most = np.zeros((2, len(s)), np.int64)
        if len(s):
            length = np.where(k > 0, e[np.maximum(i + k - 1, 0)] - s, 0)  # sure to match
            # what may match: the phrase behind the last shared name in part
            most = np.where(k < n, e[np.minimum(i + k, top)] - s, np.where(i + k >= run_stop, state["after"][run_stop - 1] - s, length))
        state["sure"] = np.stack([s, np.minimum(s + length - size + 1, state["next"])])
        follows = np.diff(run, prepend=-1) == 0
        settled = np.concatenate(([0], (s + length - size)[:-1])) if len(s) else s  # by the cut before
        lo = np.maximum.reduce([state["prev"] + 1, np.where(follows, settled + 1, 0), e - size])
        hi = np.minimum.reduce([s, s + most - size, state["end"] - size])
        hi = np.where(length >= size, np.minimum(hi, s - 1), hi)
        keys, back = np.unique(state["name"], return_inverse=True)
        flag = np.zeros(len(keys), bool)
        np.logical_or.at(flag, back, (lo <= hi) & ~state["last"])
        small = {"sure": state["sure"], "back": back, "flag": flag}
        return [state_row(chunk, small), *asks(chunk, keys[flag], 1), *asks(chunk, keys[~flag], 0)]

    def flagged(table: pa.Table) -> pa.Table:
        """For the keys that a chunk has no open window at: does another one have?"""
        n = table["n"].to_pylist()
        keys = [np.frombuffer(x.as_py(), "<u8") for c in table["keys"].chunks for x in c]
        wanted = np.unique(np.concatenate([np.empty(0, np.uint64), *(k for k, m in zip(keys, n) if m)]))
        bits = [np.packbits(np.isin(k, wanted)).tobytes() for k, m in zip(keys, n) if not m]
        rest = table.filter(pa.compute.equal(table["n"], 0))
        return pa.table({"bucket": rest["bucket"], "chunk": rest["chunk"], "bits": pa.array(bits, pa.binary())})

    def opened_windows(chunk: int, state: dict, replies: pa.Table) -> list[pa.RecordBatch]:
        own = replies.filter(pa.compute.equal(replies["bucket"], STATE))
        small = state_of(own["bits"][0].as_py())
        keys, flag = np.unique(state["name"]), small["flag"].copy()
        flag[~flag] = answers(keys[~flag], buckets, replies)
        use = flag[small["back"]] & ~state["last"] if len(keys) else np.empty(0, bool)
        s, e = state["s"][use], state["e"][use]
        lo, hi = np.maximum(state["prev"][use] + 1, e - size), np.minimum(s, state["end"][use] - size) + 1
        lo, hi = lo[lo < hi], hi[lo < hi]
        at = ranges(lo, hi)
        base = np.cumsum(state["stop"] - state["keep"]) - (state["stop"] - state["keep"])
        part = np.searchsorted(state["keep"], at, "right") - 1
        local = at - state["keep"][part] + base[part] if len(at) else at
        found = span_hashes(np.frombuffer(state["bytes"], np.uint8), local, local + size)
        keys = np.unique(np.concatenate((found, state["bare_keys"])))
        # the windows' hashes are found again where the texts are: their ranges say which
        return [state_row(chunk, {"sure": small["sure"], "open": np.stack([lo, hi]), "bare": state["bare"]}), *asks(chunk, keys, 0)]

    import pyarrow.compute  # noqa: F401

    small = next_round(first, matches, judged, "open", (matches,))
    flags = small.where("bucket >= 0").groupBy("bucket").applyInArrow(flagged, "bucket int, chunk long, bits binary")
    flags = flags.unionByName(small.where(F.col("bucket") == STATE).select("bucket", "chunk", F.col("keys").alias("bits")))
    return next_round(first, flags, opened_windows, "windows", (first, small))


def removed(chunks: DataFrame, states: DataFrame, size: int, buckets: int) -> DataFrame:
    asked = states.where("bucket >= 0").select("bucket", "chunk", "keys", F.lit(b"").alias("ranks"))
    replies = answered(asked, "shared").unionByName(states.where(F.col("bucket") == STATE).select("bucket", "chunk", F.col("keys").alias("bits")))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"

    def run(chunk: int, table: pa.Table, replies: pa.Table) -> pa.Table:
        texts = [x for c in table["text"].chunks for x in text_bytes(c)]
        at = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        kinds = replies["bucket"].to_pylist()
        state = state_of(replies["bits"][kinds.index(STATE)].as_py())
        a = np.frombuffer(b"".join(texts), np.uint8)
        open_at = [ranges(*state[k]) for k in ("open", "bare")]
        found = np.concatenate([span_hashes(a, x, x + size) for x in open_at])
        open_at = np.concatenate(open_at)
        keys, back, n = np.unique(found, return_inverse=True, return_counts=True)
        again = ((n > 1) | answers(keys, buckets, replies))[back] if len(keys) else np.empty(0, bool)
        lo, stop = state["sure"]
        lo, hi = np.concatenate((lo[stop > lo], open_at[again])), np.concatenate((stop[stop > lo] - 1, open_at[again])) + size
        cover = np.zeros(int(at[-1]) + 1, np.int32)
        np.add.at(cover, lo, 1)
        np.add.at(cover, hi, -1)
        gone = np.cumsum(cover[:-1]) > 0
        fresh = gone & ~np.concatenate(([False], gone[:-1]))
        fresh[at[:-1][at[:-1] < at[-1]]] |= gone[at[:-1][at[:-1] < at[-1]]]
        sums, spans = np.concatenate(([0], np.cumsum(gone))), np.concatenate(([0], np.cumsum(fresh)))
        kept = [t if sums[i] == sums[j] else a[i:j][~gone[i:j]].tobytes() for t, i, j in zip(texts, at[:-1], at[1:])]
        return pa.Table.from_arrays([table["doc_id"], pa.array(np.diff(at)), pa.array(np.diff(sums[at])), pa.array(np.diff(spans[at])), pa.array(kept, pa.binary())], schema=arrow_schema(schema))

    return with_answers(chunks, replies, run, schema)


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_recurring(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op9_suffix_dedup": op9_suffix_dedup}
