"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds every substring of a sample of its labelled text. A text is parsed from left
to right into the longest phrases that the language's automaton knows; a symbol it doesn't know is a phrase by itself.
The language needing the fewest phrases, each weighted by the bits of a place in its sample, wins.

Symbols are the bytes of the lower-cased text, what is neither a letter of ASCII nor beyond ASCII being a blank, and
blanks side by side one. Whole texts are parsed, in stretches of ``STRETCH`` symbols that begin with a phrase of their own: so all
stretches of a batch, in all languages, take their steps together, as one lookup of a table.

Sample: the fit uses at most ``sample`` characters over all languages, a stated bound: of each language the same number of
labelled documents, those of least hash, and of each an excerpt at a place that its hash tells. So what is broadcast is
bounded too: an automaton has at most two states and three transitions a symbol. Every row is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, values

STRETCH = 1024
UNKNOWN = "und"
#: Bytes to bytes: ASCII letters, in lower case, and what is beyond ASCII stay, all else is a blank.
_SYMBOL = bytes(b if b >= 128 or chr(b) in LOWER else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of all texts in one array of bytes; of each text the place of its first, and at the end the number of symbols; has it a letter?

    A text's symbols begin and end with a blank. Null is empty.
    """
    low = pc.utf8_lower(texts.cast(pa.large_string()))
    raw = [x or b"" for x in low.cast(pa.large_binary()).to_pylist()]
    a = np.frombuffer(b"".join(b" " + x + b" " for x in raw).translate(_SYMBOL), np.uint8)
    starts = np.concatenate(([0], np.cumsum([len(x) + 2 for x in raw], dtype=np.int64)))
    blank = a == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    keep[starts[:-1]] = True
    first = np.concatenate(([0], np.cumsum(keep)))[starts]
    ascii_letters = np.concatenate(([0], np.cumsum((a > 32) & (a < 128))))[starts]
    letter = np.diff(ascii_letters) > 0
    for i in np.flatnonzero(~letter & np.fromiter((not x.isascii() for x in raw), bool, len(raw))):
        letter[i] = any(map(str.isalpha, raw[i].decode()))
    return a[keep], first, letter


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton, state 0 its start, that takes exactly the substrings of text."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] != length[p] + 1:  # q also ends longer substrings that new's suffixes don't: split it
                split = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = split
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = split
                    p = link[p]
                q = split
            link[new] = q
        last = new
    return step


@dataclass
class Languages:
    """A fitted model: automata side by side, and the bits of a phrase in each."""

    names: list[str]
    roots: np.ndarray  # of each language its automaton's first state
    origin: np.ndarray  # of each transition
    symbol: np.ndarray
    target: np.ndarray
    bits: np.ndarray  # of each language
    _table: tuple | None = field(default=None, repr=False)

    def table(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Each byte's column; for each state and column 4 * (columns * next state) + phrases that end there; columns.

        Where a state has no step, its phrase has ended and the symbol begins the next one, or is one by itself.
        """
        if self._table is None:
            known = np.unique(self.symbol)
            column = np.full(256, len(known), np.int32)  # the last column: symbols that no language has
            column[known] = np.arange(len(known))
            width, states = len(known) + 1, int(max(self.target.max(initial=0), self.roots.max(initial=0))) + 1
            owner = np.searchsorted(self.roots, np.arange(states), "right") - 1
            begins = np.full((len(self.roots), width), -1, np.int64)
            of = owner[self.origin]
            first = self.origin == self.roots[of]
            begins[of[first], column[self.symbol[first]]] = self.target[first]
            alone = begins < 0
            at_root = np.zeros(states, bool)
            at_root[self.roots] = True
            ends = np.where(alone, self.roots[:, None], begins)[owner] * width * 4
            ends += alone[owner]  # by itself
            ends += ~at_root[:, None]  # the phrase before it
            ends[self.origin, column[self.symbol]] = self.target.astype(np.int64) * width * 4
            self._table = column, ends.astype(np.int32).ravel(), width
        return self._table

    def phrases(self, a: np.ndarray, first: np.ndarray, stretches: int = 1 << 16) -> np.ndarray:
        """For each text a[first[i]:first[i+1]] and each language the number of phrases."""
        column, table, width = self.table()
        n, langs = len(first) - 1, len(self.names)
        out = np.zeros((n, langs), np.int64)
        sizes = np.diff(first)
        pieces = -(-sizes // STRETCH)
        text = np.repeat(np.arange(n), pieces)
        start = first[text] + (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * STRETCH
        size = np.minimum(start + STRETCH, first[text + 1]) - start
        order = np.argsort(-size, kind="stable")
        col, root = column[a], (self.roots * width).astype(np.int32)
        most = max(1, stretches // max(langs, 1))
        for lo in range(0, len(order), most):
            part = order[lo : lo + most]
            s, left = start[part], size[part]
            state = np.repeat(root[None, :], len(part), 0)
            count = np.zeros((len(part), langs), np.int32)
            active = np.searchsorted(-left, -np.arange(1, int(left[0]) + 1), "right")  # stretches with a k-th symbol
            for k, m in enumerate(active.tolist()):
                got = table.take(state[:m] + col[s[:m] + k][:, None])
                count[:m] += got & 3
                np.right_shift(got, 2, out=state[:m])
            count += state != root
            np.add.at(out, text[part], count)
        return out

    def judge(self, texts: pa.Array, together: int = 1 << 21) -> tuple[list[str], np.ndarray]:
        """The language of each text, and its share of 2 ** -bits over all languages, bits being those of the text's phrases.

        Texts pass in groups of about so many bytes; one longer text passes by itself. Of equal languages the first by name wins.
        """
        names, scores = [], np.zeros(len(texts))
        bytes_of = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)))
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(bytes_of, bytes_of[lo] + together, "right")) - 1)
            a, first, letter = symbols(texts.slice(lo, hi - lo))
            if not self.names:
                names += [UNKNOWN] * (hi - lo)
            else:
                bits = self.phrases(a, first) * self.bits
                best = bits.argmin(1)
                share = 1 / np.exp2(bits.min(1, keepdims=True) - bits).sum(1)
                scores[lo:hi] = np.where(letter, share, 0)
                names += [self.names[b] if x else UNKNOWN for b, x in zip(best.tolist(), letter.tolist())]
            lo = hi
        return names, scores


def fit(pieces: dict[str, list[str]]) -> Languages:
    """A model of each language's pieces of text; a language without a letter in them isn't learned."""
    names, roots, parts, bits, states = [], [], [], [], 0
    for name in sorted(pieces):
        a, first, letter = symbols(pa.array(pieces[name], pa.string()))
        stretches = sorted(a[first[i] : first[i + 1]].tobytes() for i in np.flatnonzero(letter))
        if not stretches:
            continue
        sample = b"\0".join(stretches)  # no text has this symbol, so no phrase runs from piece to piece
        step = suffix_automaton(sample)
        parts.append(np.array([(states + i, c, states + j) for i, to in enumerate(step) for c, j in to.items() if c], np.int32).reshape(-1, 3))
        names.append(name)
        roots.append(states)
        bits.append(np.log2(1 + len(sample)))
        states += len(step)
    t = np.concatenate(parts) if parts else np.zeros((0, 3), np.int32)
    return Languages(names, np.array(roots, np.int32), t[:, 0], t[:, 1].astype(np.uint8), t[:, 2], np.array(bits))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("long").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, sample: int = 1 << 17, piece: int = 256) -> Languages:
    """Fit on docs(doc_id, text, lang) with a lang and a doc_id that isn't held out.

    sample: characters over all languages; piece: most characters of one document. Each language has the same number of documents,
    sample / (piece * languages) and at least one; with more than sample / piece languages the pieces become shorter. Of rows that share
    a doc_id and a lang the text of least hash counts.
    """
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    usable = usable.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    langs = max(usable.agg(F.count_distinct("lang").alias("n")).first().n, 1)
    rows, size = max(1, sample // (piece * langs)), min(piece, max(1, sample // langs))
    chosen = usable.select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).distinct().withColumn("part", F.pmod("h", F.lit(64)))
    for by in (["lang", "part"], ["lang"]):  # the least of a frequent language are among the least of its parts
        chosen = chosen.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("h", "doc_id"))).where(F.col("k") <= rows)
    chosen = chosen.select("lang", "doc_id")  # at most sample / piece rows, or one a language
    place = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.length("text") - size + 1)).cast("int") + 1
    texts = usable.where(F.col("text").isNotNull()).join(F.broadcast(chosen), ["lang", "doc_id"])
    got = texts.groupBy("lang", "doc_id").agg(F.min_by(F.substring("text", place, F.lit(size)), F.xxhash64("text")).alias("piece")).toArrow()
    pieces: dict[str, list[str]] = {}
    for lang, text in zip(got["lang"].to_pylist(), got["piece"].to_pylist()):
        pieces.setdefault(lang, []).append(text)
    return fit(pieces)


def identify(docs: DataFrame, model: Languages) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) for every row of docs(doc_id, text), doc_id null or repeated too; further columns are ignored.

    A text that is null or has no letter is 'und' with score 0, and so is any text where no language was learned.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            names, scores = model.judge(values(batch, "text"))
            yield pa.RecordBatch.from_arrays([values(batch, "doc_id"), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op11_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op11_language_id": op11_language_id}
