"""The pipeline's stages on their own, each against what its operator says of the same documents."""

import random
from collections import defaultdict

import corpus_pipeline
import pytest
from support import awkward, empty, frame
from test_operators import plain_components, plain_fingerprint, plain_hits, words

from voxhull.llm import near_copies, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, awkward(2)).select(*COLUMNS).cache()


def test_stages_are_named_and_keep_the_columns(spark, docs, data):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "simhash near-dedup", "substring dedup", "benchmark decontamination", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data)
        assert docs.columns == COLUMNS
    assert corpus_pipeline.STAGES[-1][1](spark, docs, data).count() > 0


def test_each_stage_takes_an_empty_table(spark, data):
    none = empty(spark).select(*COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, data).count() == 0


def lowered(text):
    return words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_near_duplicates_keep_one_of_each_group(spark, docs, data):
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, data).collect()}
    groups = defaultdict(list)
    for r in docs.collect():
        groups[tuple(lowered(r.text))].append(r.doc_id)
    assert kept <= {min(g) for g in groups.values()}


def test_texts_of_one_fingerprint_that_are_not_alike_stay(spark, data):
    own = lambda a: [f"{a}{j}" for j in range(90)]
    rows = [(1, " ".join(["so"] * 200 + own("a"))), (2, " ".join(["so"] * 200 + own("b"))), (3, " ".join(["SO"] * 200 + own("a")))]
    assert len({plain_fingerprint(t) for _, t in rows}) == 1
    kept = corpus_pipeline.near_duplicates(spark, frame(spark, rows).select(*COLUMNS), data)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]


def plain_near_copies(rows):
    """Kept doc_ids and pairs of different sets with five-word similarity >= 0.8, by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = lowered(t)
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    ids = sorted(sets)
    alike = [(a, b) for a in ids for b in ids if a < b and (sets[a] == sets[b] or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) > 0)]
    return set(plain_components(ids, alike).values()), [(a, b) for a, b in alike if sets[a] != sets[b]]


@pytest.mark.parametrize("part", [near_copies.PART, 2])
def test_near_copies_are_those_of_all_pairs(spark, data, part, monkeypatch):
    monkeypatch.setattr(near_copies, "PART", part)
    rnd = random.Random(4)
    rows = [(i, t) for i, t in awkward(3)]
    for c in range(12):
        base = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(30, 300))]
        for k in range(8):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 40))):
                w[rnd.randrange(len(w))] = f"z{rnd.randrange(5000)}"
            rows.append((3000 + 10 * c + k, " ".join(w)))
    shared = [f"q{i}" for i in range(40)]
    for k in range(30):  # a passage of all and an end of one's own: alike by less
        rows.append((4000 + k, " ".join(shared + [f"e{k}x{j}" for j in range(8 + k % 12)])))
    want, near = plain_near_copies(rows)
    assert sum((plain_fingerprint(dict(rows)[a]) ^ plain_fingerprint(dict(rows)[b])).bit_count() > 2 for a, b in near) > 20
    got = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame(spark, rows).select(*COLUMNS), data).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_rows_of_one_doc_id_with_different_texts_survive(spark, data):
    text = lambda a: " ".join(f"{a}{j}" for j in range(60))
    df = frame(spark, [(1, text("a")), (5, text("a")), (5, text("b")), (6, text("c")), (6, text("d")), (6, text("d"))]).select(*COLUMNS)
    for kept in (corpus_pipeline.near_duplicates(spark, df, data), simhash.one_of_each(df)):
        assert sorted((r.doc_id, r.text[0]) for r in kept.collect()) == [(1, "a"), (5, "b"), (6, "c"), (6, "d")]


def test_repeated_passages_leave_other_texts_alone(spark, docs, data):
    before = {r.doc_id: r for r in docs.collect()}
    for r in corpus_pipeline.repeated_passages(spark, docs, data).collect():
        assert r.n_chars == len(r.text) and r.lang == "en"
        if len(words(before[r.doc_id].text)) < 20:
            assert r.text == (before[r.doc_id].text or "")


def test_leaks_go_and_clean_documents_stay(spark, docs, data):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    leak = (5000, "intro " + items[0][1] + " outro")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [leak]
    kept = {r.doc_id for r in corpus_pipeline.benchmark_leaks(spark, frame(spark, rows).select(*COLUMNS), data).collect()}
    want = plain_hits(rows, items)
    assert kept == {i for i, x in want.items() if not x[4]} and 5000 not in kept


def test_run_packs_what_the_stages_keep(spark, data):
    out = corpus_pipeline.run(spark, data)
    assert out.count() > 0 and "sequence_id" in out.columns


def test_a_group_of_near_copies_is_joined_before_all_its_pairs_meet(spark, data, monkeypatch):
    draw = random.Random(5)
    rows = []
    for i in range(240):  # texts of one changed word are alike, and like those of two, which are not like each other
        w = [f"w{j}" for j in range(146)]
        for at in draw.sample(range(146), 1 + i % 2):
            w[at] = f"{i}x{at}"
        rows.append((i, " ".join(w)))
    compared = []
    similar = near_copies._similar
    monkeypatch.setattr(near_copies, "_similar", lambda pairs, *rest: (compared.append(pairs.count()), similar(pairs, *rest))[1])
    kept = near_copies.one_of_each(frame(spark, rows).select(*COLUMNS))
    assert [r.doc_id for r in kept.collect()] == [0]
    assert compared[-1] < 240, compared  # the last step compares what is left
