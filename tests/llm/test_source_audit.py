"""Source divergence against a plain computation over dense counts."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from support import awkward, empty

from voxhull.llm import source_audit

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, least, prior=5, top=50):
    """docs: (text, lang, source)."""
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        ts = TERM.findall((text or "").translate(LOWER))
        groups[lang].add(source)
        counts[lang, source].update(ts)
        df[lang].update(set(ts))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        v = len(kept)

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + prior) // (n + prior * v) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pair = [(s2, sum(abs(p[s][t] - p[s2][t]) for t in kept)) for s2 in sources - {s}]
            term = [(t, p[s][t] - whole[t]) for t in kept if counts[lang, s][t] and p[s][t] > whole[t]]
            for part, rows in (("pair", pair), ("term", term)):
                rows.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, x, i) for i, (item, x) in enumerate(rows, 1) if part == "pair" or i <= top]
    return sorted(out)


def rows(spark, least, docs, top=50):
    df = spark.createDataFrame([(i, *d, "x", 1) for i, d in enumerate(docs)], "doc_id long, text string, lang string, source string, term string, n long").repartition(3)
    return sorted(tuple(r) for r in source_audit.audit(df, least, top=top).select("lang", "source", "part", "item", "value", "rank").collect())


def corpus():
    texts = [t for _, t in awkward(3, 90)]
    langs, sources = ["en", "de", None, ""], ["a", "b", "é", None, "", "Z"]
    return [(t, langs[i % 7 % 4], sources[i * i % 11 % 6]) for i, t in enumerate(texts)] + [(None, "xx", "only null"), (None, "xx", "too"), ("ever so rare", "yy", "one")]


@pytest.mark.parametrize("least", [1, 4])
def test_equals_a_dense_computation(spark, least):
    docs = corpus()
    assert rows(spark, least, docs, top=7) == plain(docs, least, top=7)


def test_very_uneven_groups_and_ties(spark):
    """One source with a third of all rows and counts far above the others', one with none, repeated rows and equal terms."""
    docs = [("alpha beta beta gamma " * 200, "en", "big")] * 20 + [("Delta delta eps", "en", "small")] * 5 + [("alpha zeta", "en", "mid")] * 30 + [(" 12 !", "en", "bare")]
    assert rows(spark, 3, docs) == plain(docs, 3)


def test_a_lang_without_kept_terms_has_pairs_of_value_0(spark):
    docs = [("one two", "en", "a"), ("three", "en", "b"), (None, None, None)]
    assert rows(spark, 30, docs) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_no_rows(spark):
    assert source_audit.audit(empty(spark)).count() == 0


def test_shares_are_exact_where_products_pass_64_bits(spark):
    big = [(9_000_000_000_000, 9_100_000_000_007), (7, 8_999_999_999_999_999 // 2), (0, 5), (123_456_789_012, 4_000_000_000_000_001)]
    df = spark.createDataFrame(big, "n long, total long")
    got = [r.p for r in df.select(source_audit.share("n", "total", 5).alias("p")).collect()]
    assert got == [1 + 10**9 * (n + 5) // t for n, t in big]
    assert spark.range(1).select(source_audit.share(F.lit(0).cast("long"), F.lit(0).cast("long"), 5).alias("p")).first().p == 0
