"""Rows that no given table has: repeated and missing ids, texts longer than a chunk, columns whose names clash."""

import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from support import frame
from test_operators import BPE, check_packing, plain_components, plain_fingerprint, plain_hits, plain_recurring, words

from voxhull.llm import decontamination, packing, phrases, quality_classifier, quality_rules, simhash, suffixes, token_counts, tokens, url_filters

LONG = " ".join(f"w{i * 7919 % 400_009}" for i in range(900_000))  # over 6 MB; its words come round after 400,009
TEXT = " ".join(f"t{i}" for i in range(120))
ROWS = [(None, TEXT), (None, None), (5, TEXT), (5, TEXT), (5, "short one"), (7, LONG), (8, "tail " + LONG[:600])]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS, 2).cache()


def by_row(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_quality_and_token_counts(docs):
    got = by_row(quality_rules.judge(docs.where("doc_id is null or doc_id <> 7")), "doc_id", "n_words")
    assert got == Counter((i, len(words(t))) for i, t in ROWS if i != 7)
    model = token_counts.Unigram.from_file(__import__("public_tokenizers").path("piece_bpe_32k.model"))
    n = Counter(w for _, t in ROWS for w in words(t))
    one = {w: model.stream("▁" + w) for w in n}
    got = by_row(token_counts.token_counts(docs, __import__("public_tokenizers").path("piece_bpe_32k.model")), "doc_id", "n_words", "n_tokens")
    assert got == Counter((i, len(words(t)), sum(one[w] for w in words(t))) for i, t in ROWS)


def test_a_long_word_is_counted(spark):
    path = __import__("public_tokenizers").path("piece_bpe_32k.model")
    got = token_counts.token_counts(frame(spark, [(1, "ab" * 100_000)], 1), path).first()
    assert got.n_words == 1 and 0 < got.n_tokens <= 200_001


def test_tokens_and_packing(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    ids = {t: tok.encode(t or "", add_special_tokens=False).ids for t in {t for _, t in ROWS}}
    crc = lambda t: zlib.crc32(np.array(ids[t] + [0], "<u4").tobytes())
    got = by_row(tokens.read_tokens(tokens.write_tokens(docs, BPE)), "doc_id", "n_tokens", "ids_crc32")
    assert got == Counter((i, len(ids[t]) + 1, crc(t)) for i, t in ROWS)
    pieces = packing.pack_documents(docs, BPE).collect()
    check_packing(pieces, [(7, LONG), (8, ROWS[6][1])], tok, 2048)
    assert Counter(p.doc_id for p in pieces if p.start == 0) == Counter(i for i, _ in ROWS)


def test_simhash(docs):
    got = by_row(simhash.near_duplicates(docs), "doc_id", "fp", "component_id")
    fp = [plain_fingerprint(t) for _, t in ROWS]
    n = range(len(ROWS))
    label = plain_components(list(n), [(a, b) for a in n for b in n if a < b and (fp[a] ^ fp[b]).bit_count() <= 2])
    least = {c: min((ROWS[i][0] for i in n if label[i] == c and ROWS[i][0] is not None), default=None) for c in set(label.values())}
    assert got == Counter((ROWS[i][0], int(np.uint64(fp[i]).astype(np.int64)), least[label[i]]) for i in n)


def test_substrings(docs):
    got = by_row(phrases.remove_repeats(docs), "doc_id", "n_words", "n_removed")
    # in the order of doc_id, null first: the first TEXT stays, whichever row has it; 8 repeats the start of 7, but for a word cut short
    cut = len(words(ROWS[6][1]))
    own = sum(1 for a, b in zip(words(LONG), words(ROWS[6][1])[1:]) if a == b)
    assert got == Counter([(None, 120, 0), (None, 0, 0), (5, 120, 120), (5, 120, 120), (5, 2, 0), (7, 900_000, 900_000 - 400_009), (8, cut, own)])


def test_recurring_bytes(spark):
    some = [(None, TEXT), (None, None), (5, TEXT), (5, TEXT + "x"), (5, "short one"), (7, LONG[:30_000])]
    got = by_row(suffixes.remove_recurring(frame(spark, some, 2)), "doc_id", "n_bytes", "n_removed", "n_spans")
    want = plain_recurring([(k, t) for k, (_, t) in enumerate(some)], 400)
    assert got == Counter((some[k][0], *x[:3]) for k, x in want.items())


def test_recurring_bytes_of_a_text_longer_than_a_chunk(docs):
    got = by_row(suffixes.remove_recurring(docs.where("doc_id >= 7")), "doc_id", "n_bytes", "n_removed", "n_spans")
    # every string of LONG comes round; what 8 has of it, and the blank before it, stands before the second round too
    assert got == Counter([(7, len(LONG), len(LONG), 1), (8, 605, 601, 1)])


def test_leaks(spark, docs):
    items = [(1, " ".join(f"t{i}" for i in range(30, 50))), (2, " ".join(words(LONG)[500_000:500_020])), (None, "short one"), (1, "short one")]
    tests = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, doc_id int")
    got = by_row(decontamination.decontaminate(docs, tests), "doc_id", "n_words", "n_hit", "n_items", "contaminated")
    plain = plain_hits([(k, t) for k, (_, t) in enumerate(ROWS) if t is not LONG], items)
    want = Counter((ROWS[k][0], x[0], x[1], x[2], x[4]) for k, x in plain.items())
    want[7, 900_000, 40, 1, True] += 1  # the second item's words stand in two rounds
    assert got == want


def test_scores(spark, docs):
    labels = spark.createDataFrame([(5, 1, 0), (7, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_classifier.score(docs, quality_classifier.train(docs, labels)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in ROWS) and all(0 <= r.score <= 1 for r in got)
    kept = quality_classifier.accepted(docs, quality_classifier.train(docs, labels), 0.0)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)


def test_urls_of_repeated_and_missing_pages(spark):
    pages = spark.createDataFrame([(None, "http://a.org/x"), (None, None), (3, "http://b.com/de/x"), (3, "http://b.net/x"), (3, "http://b.net/x")], "page_id long, url string")
    labels = spark.createDataFrame([(3, 0, 0), (3, 1, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = by_row(url_filters.judge(pages, labels), "page_id", "host", "rule")
    assert got == Counter([(None, "a.org", "org/"), (None, "", None), (3, "b.com", "com/de/"), (3, "b.net", None), (3, "b.net", None)])


def test_pipeline_stages(spark, docs, data):
    base = docs.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id is null or doc_id < 7")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        base = stage(spark, base, data)
        assert base.columns == ["doc_id", "text", "lang", "source", "n_chars"]
