"""Token counts by trie-shared dynamic programming over a unigram vocabulary.

A text's pre-tokens are its words, each after the mark that stands for a blank. A pre-token's tokens are those of the
segmentation with the highest sum of piece scores, found from the left: the best score of a prefix depends on that
prefix alone. So the distinct pre-tokens of a batch go into a trie, in sorted order, whose nodes hold the scores of shared
prefixes, found once; a pre-token's last node holds its count. A worker's trie goes on from batch to batch. Counts need no shuffle.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, blanks_table, text_bytes, values
from .decontamination import batches_of

MARK = "▁"


class Unigram:
    """Pieces with scores. A character that no piece covers costs ``unknown`` for each of its UTF-8 bytes, a token each.

    Ties go to the fewest tokens, then to the longer last piece.
    """

    def __init__(self, pieces: dict[str, float], unknown: float | None = None):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min(pieces.values(), default=0.0) - 10.0 if unknown is None else unknown

    @classmethod
    def from_file(cls, path: str) -> Unigram:
        """The normal pieces of a sentencepiece model. Scores: minus the logarithm of the rank by the model's scores."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        ranked = sorted(normal, key=lambda i: (-sp.get_score(i), i))
        return cls({sp.id_to_piece(i): -float(np.log(r + 2)) for r, i in enumerate(ranked)})

    def stream(self, word: str) -> int:
        """Tokens of one word, whatever its length: only the states that a piece can reach back to are held."""
        held = deque([(0.0, 0)], self.longest)  # best of the last prefixes: score, minus the tokens
        for j in range(1, len(word) + 1):
            size = len(word[j - 1].encode("utf-8", "surrogatepass"))
            s, k = held[-1]
            top = (s + self.unknown * size, k - size)
            for i, (s, k) in enumerate(held, j - len(held)):
                p = self.pieces.get(word[i:j])
                if p is not None and (s + p, k - 1) > top:
                    top = (s + p, k - 1)
            held.append(top)
        return -held[-1][1]


class Trie:
    """Pre-tokens by their characters. A node holds the best score and the tokens of the prefix that leads to it, both found
    when the node is made, and a pre-token's last node holds its count.

    most: nodes held, beyond which the trie starts anew; long: pre-tokens of more characters go through the model alone. Both
    bound memory and change no count.
    """

    def __init__(self, model: Unigram, most: int = 500_000, long: int = 1_000):
        self.model, self.most, self.long = model, most, long
        self._reset()

    def _reset(self) -> None:
        self.next: dict[int, int] = {}  # node and character to node
        self.score, self.tokens, self.terminal = [0.0], [0], {}

    def count(self, word: str) -> int:
        if len(word) > self.long:
            return self.model.stream(word)
        if len(self.score) > self.most:
            self._reset()
        model, score, tokens, children = self.model, self.score, self.tokens, self.next
        get, longest, unknown = model.pieces.get, model.longest, model.unknown
        node, path = 0, [0]
        for j, c in enumerate(word, 1):
            key = (node << 21) | ord(c)
            after = children.get(key)
            if after is None:
                size = len(c.encode("utf-8", "surrogatepass"))
                best, fewest = score[node] + unknown * size, tokens[node] + size
                for i in range(max(0, j - longest), j):
                    p = get(word[i:j])
                    if p is not None:
                        at = path[i]
                        s = score[at] + p
                        if s > best or (s == best and tokens[at] + 1 < fewest):
                            best, fewest = s, tokens[at] + 1
                after = children[key] = len(score)
                score.append(best)
                tokens.append(fewest)
            node = after
            path.append(node)
        if node not in self.terminal:
            self.terminal[node] = tokens[node]
        return self.terminal[node]


_TRIES: dict[str, Trie] = {}


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens for each row of docs(doc_id, text): tokens of the whole text by the vocabulary at path.

    A null or blank text has none. Repeated rows are counted each; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _TRIES:
            _TRIES[path] = Trie(Unigram.from_file(path))
        trie, table = _TRIES[path], blanks_table()
        for batch in batches:
            texts, keys = text_bytes(values(batch, "text")), values(batch, "doc_id")
            for lo, hi in batches_of(texts, 16_000_000):
                w = Words(texts[lo:hi], table)
                _, first, back = np.unique(w.hashes(), return_index=True, return_inverse=True)
                distinct = [MARK + w.word(i).decode("utf-8", "replace") for i in first.tolist()]
                order = sorted(range(len(distinct)), key=distinct.__getitem__)
                n = np.zeros(len(distinct), np.int64)
                n[order] = [trie.count(distinct[i]) for i in order]
                sums = np.concatenate(([0], np.cumsum(n[back]))) if w.n else np.zeros(1, np.int64)
                yield pa.RecordBatch.from_arrays([keys[lo:hi], pa.array(np.diff(w.first)), pa.array(sums[w.first[1:]] - sums[w.first[:-1]])], names=["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op3_token_counts": op3_token_counts}
