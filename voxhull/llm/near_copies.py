"""Near copies: all pairs of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Texts become sets of 64-bit shingle hashes; equal sets collapse to one node at once. The search has three steps, and
what any of them proposes is a link only after the exact similarity of both sets was computed:

1. Chunks of documents ask each other in how many texts each shingle occurs. A shingle of one text alone is in no
   intersection, so a text can only have a near copy if a share of 0.8 of its shingles occurs elsewhere. Most texts go.
2. Among the others SimHash fingerprints within the radius (BK-trees), and for each shingle of a text's prefix the
   first text that has it (of these the first of all), are compared. That settles clusters of many near copies without all their pairs.
3. The rest, exactly: of n shingles in one global order (rarest first), two texts of a similarity of 0.8 share one
   among their first n - ceil(0.8 n) + 1. All pairs that share such a shingle, could have the similarity by their
   sizes, by what follows it in both and by a sketch of their shingles, and are not in one component yet are compared.
   No pair is left out. Before that each text is compared with a few others of each of its shingles, turn by turn
   until that joins little more, so that what is left is pairs between components.
   Pairs meet by shingle and class of size; what lies in one component already is left out before the join, and a
   shingle of very many texts is dealt to several tasks.

Fingerprints only propose: texts whose fingerprints are equal but whose shingles are not alike stay apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .chunks import ask, chunked, dealt, n_buckets, spread, with_answers
from .common import Words, dropped, lower_blanks_table, stored, text_bytes, values, windows

SKETCH = [f"s{i}" for i in range(8)]
OF = ["label", "node", "n", "rest", *SKETCH]  # what pairs are judged by before their sets are compared
PART = 2000  # texts of one shingle and class of size that a task compares others with
NEXT = 8  # texts before it in a shingle's order that each is compared with in a turn
MOST = 255  # occurrences are counted up to here; more are as frequent


def shingle_sets(texts: list[bytes], shingle: int = 5) -> list[np.ndarray]:
    """Of each text its distinct shingles' hashes in ascending order; a shorter text is one shingle, a blank one has none."""
    w = Words(texts, lower_blanks_table())
    h = w.hashes()
    out = []
    for d in range(len(texts)):
        mine = h[w.first[d] : w.first[d + 1]]
        k = min(shingle, len(mine))
        out.append(np.unique(windows(mine, k, salt=k)) if k else np.empty(0, np.uint64))
    return out


def node(s: np.ndarray) -> int:
    """A set's name, as a signed long."""
    return int(np.array([xxhash.xxh64_intdigest(s.tobytes(), 7)], np.uint64).view(np.int64)[0])


def sketch(s: np.ndarray) -> list[int]:
    """512 bits, each whether an odd number of the set's shingles fall to it; two sets' sketches differ in no more bits than the sets in shingles."""
    odd = (np.bincount((s >> np.uint64(20)).astype(np.int64) & 511, minlength=512) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8").tolist()


def needed(n, tenths: int = 8):
    """The least number of common shingles a set of n has with one of a similarity of ``tenths`` tenths or more."""
    return -(-n * tenths // 10)


def _nodes(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_key, node, fp (SimHash over three words) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bytes(lower_blanks_table())
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = text_bytes(values(part, "text"))
                names = [node(s) for s in shingle_sets(texts, shingle)]
                fps = np.array([simhash.fingerprint(t.translate(table).split()) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([values(part, "doc_id"), values(part, "text_key"), pa.array(names, pa.int64()), pa.array(fps)], names=["doc_id", "text_key", "node", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, "doc_id long, text_key long, node long, fp long")


def _distinct(texts: list[bytes], shingle: int) -> dict[int, np.ndarray]:
    found: dict[int, np.ndarray] = {}
    for lo in range(0, len(texts), 500):
        for s in shingle_sets(texts[lo : lo + 500], shingle):
            if len(s):
                found.setdefault(node(s), s)
    return found


def _asked(chunks: DataFrame, shingle: int, buckets: int) -> DataFrame:
    """Each chunk's shingles once, with the number of its distinct sets that have them."""
    from .chunks import ASKED, opened

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, data in zip(values(batch, "chunk").to_pylist(), values(batch, "data")):
                sets = _distinct(text_bytes(opened(data.as_py())["text"].combine_chunks()), shingle)
                if sets:
                    keys, n = np.unique(np.concatenate(list(sets.values())), return_counts=True)
                    yield ask(c, keys, np.minimum(n, MOST), buckets)

    return chunks.mapInArrow(run, ASKED)


def _counted(asked: DataFrame) -> DataFrame:
    """(bucket, chunk, bits): for each row of asked one byte a key, the number of sets in all chunks that have it."""

    def run(table: pa.Table) -> pa.Table:
        rows = [np.frombuffer(k.as_py(), "<u8") for c in table["keys"].chunks for k in c]
        _, where = np.unique(np.concatenate(rows), return_inverse=True)
        n = np.concatenate([spread(k.as_py()) for c in table["ranks"].chunks for k in c])
        total = np.minimum(np.bincount(where, n), MOST).astype(np.uint8)[where]
        ends = np.cumsum([len(r) for r in rows])
        return pa.table({"bucket": table["bucket"], "chunk": table["chunk"], "bits": pa.array([total[e - len(r) : e].tobytes() for r, e in zip(rows, ends)], pa.binary())})

    return asked.groupBy("bucket").applyInArrow(run, "bucket int, chunk long, bits binary")


def _candidates(chunks: DataFrame, replies: DataFrame, shingle: int, tenths: int, buckets: int) -> DataFrame:
    """(node, n, shingles, prefix, sketch) of the sets that share enough with others; prefix: their rarest shared shingles."""
    from .chunks import arrow_schema

    schema = "node long, n long, shingles binary, prefix binary, " + ", ".join(f"{c} long" for c in SKETCH)

    def run(chunk: int, table: pa.Table, right: pa.Table) -> pa.Table:
        sets = _distinct(text_bytes(table["text"].combine_chunks()), shingle)
        out = []
        if sets:
            keys = np.unique(np.concatenate(list(sets.values())))
            bucket, order = dealt(keys, buckets)
            at = np.searchsorted(bucket[order], np.arange(buckets + 1))
            count = np.zeros(len(keys), np.uint8)
            for b, got in zip(right["bucket"].to_pylist(), right["bits"].to_pylist()):
                count[order[at[b] : at[b + 1]]] = np.frombuffer(got, np.uint8)
            for name, s in sets.items():
                n = count[np.searchsorted(keys, s)]
                common, least = s[n > 1], needed(len(s), tenths)
                if len(common) >= least:
                    rare = common[np.lexsort((common, n[n > 1]))][: len(common) - least + 1]
                    out.append((name, len(s), s.tobytes(), rare.tobytes(), *sketch(s)))
        cols = list(zip(*out)) or [()] * (4 + len(SKETCH))
        kinds = arrow_schema(schema)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kinds)], schema=kinds)

    return with_answers(chunks, replies, run, schema)


def _prefixes(sets: DataFrame, tenths: int) -> DataFrame:
    """(key, node, n, rest) for each shingle of the prefixes; rest: how many of the set's shared shingles do not come before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, n, prefix in zip(values(batch, "node").to_pylist(), values(batch, "n").to_pylist(), values(batch, "prefix").to_pylist()):
                keys = np.frombuffer(prefix, "<i8")
                rest = needed(n, tenths) + np.arange(len(keys))[::-1]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), name)), pa.array(np.full(len(keys), n)), pa.array(rest)], names=["key", "node", "n", "rest"])

    return sets.select("node", "n", "prefix").mapInArrow(run, "key long, node long, n long, rest long")


def _similar(pairs: DataFrame, sets: DataFrame, tenths: int) -> DataFrame:
    """Those of pairs(a, b) whose sets have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(values(batch, "x"), values(batch, "y")):
                u, v = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(10 * both >= tenths * (len(u) + len(v) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([values(batch, "a").filter(mask), values(batch, "b").filter(mask)], names=["a", "b"])

    held = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    held = held.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return held.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, nodes: DataFrame, shingle: int = 5, tenths: int = 8, radius: int = 2) -> DataFrame:
    """(node, label) of the components of all pairs of that similarity; nodes without a link are left out."""
    chunks = chunked(docs, [])
    buckets = n_buckets(chunks)
    replies = _counted(_asked(chunks, shingle, buckets))
    sets = stored(_candidates(chunks, replies, shingle, tenths, buckets).dropDuplicates(["node"]), "shingle-sets")
    dropped(chunks)
    rows = _prefixes(sets, tenths)
    heads = rows.groupBy("key").agg(F.min("node").alias("x"), F.count("*").alias("c")).where("c > 1").select("key", "x")
    rows = stored(rows.join(heads, "key"), "prefixes")

    by_fp = nodes.join(sets.select("node"), "node", "left_semi").groupBy("node").agg(F.min("fp").alias("fp"))
    first = stored(by_fp.groupBy("fp").agg(F.min("node").alias("first")), "distinct-fingerprints")
    near = simhash.links(first.select("fp"), radius)
    ends = near.join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b").select("x", "y")
    same = by_fp.join(first, "fp").select(F.col("first").alias("x"), F.col("node").alias("y"))
    star = rows.groupBy("node").agg(F.min("x").alias("x")).select("x", F.col("node").alias("y"))
    some = ends.unionByName(same).unionByName(star).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    found = stored(_similar(some, sets, tenths), "similar")

    # what two sets of the similarity do not share is at most a part (1 - t) / (1 + t) of both sizes, and each differing bit of the sketches is of such a shingle
    apart = " + ".join(f"bit_count(x.{c} ^ y.{c})" for c in SKETCH)
    may = f"10 * least(x.n, y.n) >= {tenths} * greatest(x.n, y.n) AND {10 + tenths} * ({apart}) <= {10 - tenths} * (x.n + y.n)"
    # of the shingles that both have the first in the order is in both prefixes, and the others come after it in both sets
    may += f" AND {10 + tenths} * least(x.rest, y.rest) >= {tenths} * (x.n + y.n)"
    label = stored(simhash.components(found), "labels")
    # each text with the next ones that have a shingle of its prefix, among all and where components meet, in another order for each shingle and turn, so that
    # it meets many. What is in one component isn't compared any more, so turns go on until they find little.
    turn = most = 0
    while True:
        named = _labelled(rows, sets, label)
        mixed, runs = (F.xxhash64(F.lit(turn), "key", c) for c in ("node", "label"))
        sizes = Window.partitionBy("key", _size_class(tenths))
        next_to = F.array(*[F.lag(F.struct(*OF), k + 1).over(sizes.orderBy(mixed, "node")) for k in range(NEXT)], F.lag(F.struct(*OF)).over(sizes.orderBy(runs, "label", mixed, "node")))
        some = named.select(F.struct(*OF).alias("x"), next_to.alias("ys")).select("x", F.explode("ys").alias("y")).where(F.expr(f"x.label <> y.label AND {may}"))
        some = some.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        links = stored(_similar(some, sets, tenths), "similar")
        n = links.count()
        before, label = label, extended(label, links)
        dropped(named, before, links)
        turn, most = turn + 1, max(most, n)
        if 20 * n <= most:
            break
    named = _labelled(rows, sets, label)
    rest = _met(named, tenths).where(F.expr(f"x.label <> y.label AND {may}"))
    rest = rest.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    out = extended(label, _similar(rest, sets, tenths))
    dropped(named, label, rows, sets, first, found)
    return out


def _labelled(rows: DataFrame, sets: DataFrame, label: DataFrame) -> DataFrame:
    """rows(key, node, rest) with each node's label, size and sketch, for keys of more than one label; stored."""
    about = sets.select("node", "n", *SKETCH).join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = rows.select("key", "node").join(about.select("node", "label"), "node").groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    return stored(rows.select("key", "node", "rest").join(several.select("key"), "key", "left_semi").join(about, "node"), "labelled-prefixes")


def _size_class(tenths: int) -> Column:
    """The power of 10 / tenths that n reaches; a little wider than the factor, so that rounding parts no pair."""
    return F.floor(F.log(F.col("n").cast("double")) / (F.log(F.lit(10.0 / tenths)) * (1 + 1e-9))).cast("int")


def _met(named: DataFrame, tenths: int) -> DataFrame:
    """Structs (x, y) of the rows of named that share a key and could be alike by size, each pair of a key once.

    Sizes of a similar pair lie within a factor 10 / tenths, so their classes by powers of it are equal or next to each other. Groups of a
    key and a class whose texts all have one label are left out; of large groups the x side is dealt to several tasks.
    """
    classed = named.withColumn("g", _size_class(tenths))
    # y goes to its own class and the one below, where it meets x
    y = classed.select("key", F.posexplode(F.array("g", F.col("g") - 1)).alias("larger", "g"), F.struct(*OF).alias("y"))
    groups = y.groupBy("key", "g").agg(F.min("y.label").alias("lo"), F.max("y.label").alias("hi"), F.count("*").alias("c")).where("lo < hi")
    groups = groups.select("key", "g", F.ceil(F.col("c") / PART).cast("int").alias("parts"))
    x = classed.join(groups, ["key", "g"]).select("key", "g", F.expr("pmod(xxhash64(node), parts)").cast("int").alias("part"), F.struct(*OF).alias("x"))
    y = y.join(groups, ["key", "g"]).select("key", "g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "larger", "y")
    return x.join(y, ["key", "g", "part"]).where("larger = 1 OR x.node < y.node")


def extended(label: DataFrame, pairs: DataFrame) -> DataFrame:
    """label(node, label) after further links pairs(a, b); stored. Only links between different components are worked on."""
    ends = pairs.join(label.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left").join(label.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
    ends = ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b").distinct()
    new = stored(ends, "new-links")
    if new.limit(1).count() == 0:
        dropped(new)
        return stored(label, "labels")
    over = simhash.components(new)  # of old labels
    moved = label.join(over.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    fresh = over.join(label, "node", "left_anti").select("node", "label")  # nodes that had no link before
    out = stored(moved.unionByName(fresh), "labels")
    dropped(new)
    return out


def one_of_each(docs: DataFrame, shingle: int = 5, tenths: int = 8) -> DataFrame:
    """The rows of docs, all columns as they are, that stand for their group: those with its smallest doc_id, once each.

    Groups are the components of all pairs of texts whose sets of shingles have a Jaccard similarity of ``tenths`` tenths
    or more; words are lower-cased. Texts of fewer words are one shingle. Null and blank texts are one group. Rows without a doc_id can't be told apart and all stay.
    """
    nodes = stored(_nodes(docs, shingle), "nodes")
    label = groups(docs, nodes, shingle, tenths)
    named = nodes.where(F.col("doc_id").isNotNull()).join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = stored(named.groupBy("label").agg(F.min(F.struct("doc_id", "text_key")).alias("r")).select("r.*").distinct(), "first")
    dropped(nodes, label)
    return simhash.rows_of(docs, first)
