"""Language identification against plain substring search, and its accuracy on texts that the fit never saw."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from support import awkward, empty, frame

from voxhull.llm import language_id as L


def plain_symbols(text):
    low = "".join(c if c > "\x7f" or ("a" <= c <= "z") else " " for c in (text or "").lower())
    out = b""
    for b in b" " + low.encode() + b" ":
        if b != 32 or not out or out[-1] != 32:
            out += bytes([b])
    return out


def plain_phrases(s, sample):
    """Greedy parse by substring search, stretch by stretch."""
    n = 0
    for lo in range(0, len(s), L.STRETCH):
        part = s[lo : lo + L.STRETCH]
        i = 0
        while i < len(part):
            j = i + 1
            while j <= len(part) and part[i:j] in sample:
                j += 1
            i = max(i + 1, j - 1)
            n += 1
    return n


PIECES = {
    "ab": ["abba Baab abc", "bab abab!", "cab"],
    "é": ["éa èa éé aé", "aç é", "çà et là"],
    "x": ["x", "xyx zz", "   "],
    "none": ["12 34", "", " !! "],
}


def test_phrases_equal_substring_search():
    model = L.fit(PIECES)
    assert model.names == ["ab", "x", "é"]
    samples = [b"\0".join(sorted(plain_symbols(p) for p in PIECES[n] if any(c.isalpha() for c in p))) for n in model.names]
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abcxyzéèç ,A") for _ in range(rnd.randint(0, 300))) for _ in range(60)]
    texts += [None, "", " ", "1234 ..", "日本語 abba", "ÉÉ", "aba" * 1500, "x" * L.STRETCH, "x" * (L.STRETCH - 1), "x" * (2 * L.STRETCH - 2), "\0a\0", "a" * 40 + " " + "b"]
    a, first, letter = L.symbols(pa.array(texts))
    assert [a[first[i] : first[i + 1]].tobytes() for i in range(len(texts))] == [plain_symbols(t) for t in texts]
    assert letter.tolist() == [any(c.isalpha() for c in t or "") for t in texts]
    want = [[plain_phrases(plain_symbols(t), s) for s in samples] for t in texts]
    assert model.phrases(a, first).tolist() == want
    assert model.phrases(a, first, stretches=7).tolist() == want
    names, scores = model.judge(pa.array(texts))
    assert (names, scores.tolist()) == (lambda r: (r[0], r[1].tolist()))(model.judge(pa.array(texts), together=50))
    bits = np.array(want) * np.log2([1 + len(s) for s in samples])
    assert names == [model.names[b.argmin()] if x else "und" for b, x in zip(bits, letter)]
    assert all(0 < s <= 1 if x else s == 0 for s, x in zip(scores, letter))


@pytest.mark.parametrize("text", [b"", b"a", b"aaaa", b"abcabxabcd", b"mississippi"])
def test_automaton_takes_exactly_the_substrings(text):
    step = L.suffix_automaton(text)
    assert len(step) <= max(2 * len(text), 1)
    taken, stack = set(), [(0, b"")]
    while stack:
        s, w = stack.pop()
        taken.add(w)
        stack += [(t, w + bytes([c])) for c, t in step[s].items()]
    assert taken == {text[i:j] for i in range(len(text) + 1) for j in range(i, len(text) + 1)}


def test_held_out_accuracy(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = L.op11_language_id(spark, data).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 20 and (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()
    assert L.op11_language_id(spark, data).count() == docs.count()


def test_learns_from_no_row_that_is_held_out(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    spoiled = docs.withColumn("lang", F.when(L.held_out(F.col("doc_id")), F.lit("wrong")).otherwise(F.col("lang"))).withColumn("text", F.when(L.held_out(F.col("doc_id")), F.lit("zzz zz")).otherwise(F.col("text")))
    a, b = L.train(docs), L.train(spoiled)
    assert a.names == b.names and np.array_equal(a.target, b.target) and np.array_equal(a.bits, b.bits)


def test_awkward_rows(spark):
    docs = frame(spark, awkward(4, 40)).withColumn("lang_pred", F.lit("clash")).withColumn("score", F.lit("clash"))
    rows = docs.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 1, F.lit("")).otherwise("en"))
    rows = rows.unionByName(rows.limit(5)).unionByName(rows.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    model = L.train(rows)
    assert model.names == ["", "en"]
    got = L.identify(rows, model)
    assert got.columns == ["doc_id", "lang_pred", "score"] and got.count() == rows.count()
    by = {r.doc_id: (r.lang_pred, r.score) for r in got.collect()}
    assert all(by[i] == ("und", 0.0) for i in (2000, 2001, 2002)) and by[2003][0] != "und"


def test_no_labelled_rows_and_no_rows(spark):
    docs = frame(spark, [(1, "some text"), (2, None)]).withColumn("lang", F.lit(None).cast("string"))
    model = L.train(docs)
    assert model.names == [] and {tuple(r) for r in L.identify(docs, model).collect()} == {(1, "und", 0.0), (2, "und", 0.0)}
    assert L.identify(empty(spark), L.train(empty(spark))).count() == 0


def test_the_sample_is_bounded_with_many_languages(spark):
    docs = spark.createDataFrame([(i, "word " * 100, f"l{i % 50}") for i in range(400)], "doc_id long, text string, lang string")
    model = L.train(docs, sample=1000)
    assert len(model.names) == 50 and len(model.target) <= 3 * 50 * 24
