"""Each operator against a plain computation over the same documents, with nulls, ties, copies, blanks and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from support import awkward, empty, frame

from voxhull.llm import decontamination, packing, phrases, quality_classifier, quality_rules, simhash, suffixes, token_counts, tokens, url_filters

P = pytest.importorskip("public_tokenizers")
BPE = P.path("byte_bpe_50k.json")
DOCS = awkward(1)


def words(text):
    return [w for w in re.split("[ \t\n\x0b\x0c\r]+", text or "") if w]


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, DOCS).cache()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


# ------------------------------------------------------------------------------------------------ 1 URL filters

def test_url_rules_and_mined_verdicts(spark):
    urls = [
        "http://a.org/x", "http://x.example.org/es/1", "https://EXAMPLE.org/en/12?q=1", "http://example.org/en/2", "http://b.com/fr/x", "http://b.com/de/x",
        "http://notexample.net/", None, "no scheme", "http://", "http://org/es", "http://sub.com/fr", "ftp://c.net/de/a#b", "http://com/de/", "x://y.org?a=/b", "http://a.net\n/p",
    ]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(100 + i, f"http://bad.net/p/{i}", "") for i in range(40)] + [(200 + i, f"http://good.net/p/{i}", "") for i in range(40)], "page_id long, url string, rule string")
    labels = spark.createDataFrame([(100 + i, 0, 0) for i in range(30)] + [(200 + i, 1, 0) for i in range(30)] + [(None, 0, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    got = rows(url_filters.judge(pages, labels, support=0.05, confidence=0.7), "page_id")
    want = {0: ("org/", "allow"), 1: ("example.org/es/", "block"), 2: ("example.org/en/1", "block"), 3: ("org/", "allow"), 4: ("com/fr/", "allow"), 5: ("com/de/", "block")}
    for i, (rule, verdict) in want.items():
        assert (got[i].rule, got[i].verdict) == (rule, verdict)
    assert (got[2].host, got[2].path) == ("example.org", "/en/12")
    assert [(got[i].host, got[i].path, got[i].rule) for i in (7, 8, 9)] == [("", "", None)] * 3
    assert got[10].rule == "org/" and got[11].rule is None and got[13].rule == "com/de/" and got[14].rule is None
    assert all(got[100 + i].verdict == "block" for i in range(40)) and all(got[200 + i].verdict == "allow" for i in range(40))
    assert "bad.net" in got[135].mined_rule


def test_url_rules_see_all_of_a_url_and_all_sizes(spark):
    bad = [*(f"http://h{i}.spam.example.com/p{i}" for i in range(10)), *(f"http://a{i}.net/x{i}/casino/y" for i in range(10)), *(f"http://b{i}.net/z{i}?q=1&ref=2" for i in range(10))]
    good = [*(f"http://h{i}.fine.example.com/p{i}" for i in range(20)), *(f"http://g{i}.net/x{i}/news/y?q=1" for i in range(20))]
    four = ["c1", "c2", "c3", "c4"]
    bad += [f"ftp://k{i}.org/" + "/".join(four) for i in range(10)]  # each three of the four are good more often
    good += [f"ftp://l{i}.org/" + "/".join(c for c in four if c != left) for left in four for i in range(15)]
    urls = [(i, u) for i, u in enumerate(bad + good)]
    new = ["http://new.spam.example.com/", "http://new.net/q/casino/r", "http://new.net/?q=5&ref=5", "ftp://new.org/c1/c2/c3/c4", "http://new.fine.example.com/", "ftp://new.org/c1/c2/c3/u"]
    pages = spark.createDataFrame(urls + [(1000 + i, u) for i, u in enumerate(new)], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i >= len(bad)), 0) for i, _ in urls], "doc_id long, quality int, toxic int")
    got = rows(url_filters.judge(pages, labels, rules=(), support=0.05, confidence=0.7), "page_id")
    assert [got[1000 + i].verdict for i in range(6)] == ["block"] * 4 + ["allow"] * 2
    assert got[1003].mined_rule == "seg=c1 seg=c2 seg=c3 seg=c4"


def test_url_filters_without_labels_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert url_filters.judge(pages, labels).first().verdict == "allow"
    assert url_filters.judge(pages.limit(0), labels).count() == 0


# -------------------------------------------------------------------------------------------- 2 quality rules

def test_quality_figures(docs, spark):
    got = rows(quality_rules.judge(docs))
    for i, t in DOCS:
        w, r = words(t), got[i]
        grams = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        n = Counter(grams)
        hit = {j + k for j, g in enumerate(grams) if n[g] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), sum(c in quality_rules.SYMBOLS for c in t or ""), len(lines) - len(set(lines)), len(hit))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and (not r.kept or not r.base_failed)
    assert not got[2011].kept
    assert quality_rules.judge(empty(spark)).count() == 0


def test_quality_rules_run_without_python(docs):
    plan = quality_rules.judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange hashpartitioning" not in plan


# --------------------------------------------------------------------------------------------- 3 token counts

def test_token_counts_match_plain_viterbi(docs, spark):
    path = P.path("piece_bpe_32k.model")
    model = token_counts.Unigram.from_file(path)

    def plain(w):
        best = [(0.0, 0)] + [None] * len(w)
        for j in range(1, len(w) + 1):
            size = len(w[j - 1].encode())
            top = (best[j - 1][0] + model.unknown * size, best[j - 1][1] - size)
            for i in range(max(0, j - model.longest), j):
                if w[i:j] in model.pieces:
                    top = max(top, (best[i][0] + model.pieces[w[i:j]], best[i][1] - 1))
            best[j] = top
        return -best[-1][1]

    seen = {}
    got = rows(token_counts.token_counts(docs, path))
    for i, t in DOCS:
        for w in words(t):
            if w not in seen:
                seen[w] = plain("▁" + w)
        assert (got[i].n_words, got[i].n_tokens) == (len(words(t)), sum(seen[w] for w in words(t))), i
    assert token_counts.token_counts(empty(spark), path).count() == 0


def test_trie_and_stream_count_alike():
    model = token_counts.Unigram.from_file(P.path("piece_bpe_32k.model"))
    trie, small = token_counts.Trie(model), token_counts.Trie(model, most=50, long=12)
    some = sorted({"▁" + w for _, t in DOCS for w in words(t)})[:400] + ["", "▁", "▁日本語", "▁" + "ab" * 3000]
    assert [trie.count(w) for w in some] == [small.count(w) for w in some] == [model.stream(w) for w in some]


# ---------------------------------------------------------------------------------------------- 4 token files

def test_token_files_round_trip(docs, spark, tokenizer):
    got = rows(tokens.read_tokens(tokens.write_tokens(docs, BPE, block_ids=5000)))
    at = 0
    for i, t in sorted(DOCS):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
        at += len(ids)
    assert tokens.read_tokens(tokens.write_tokens(empty(spark), BPE)).count() == 0


def test_token_files_keep_rows_without_or_with_equal_ids(spark, tokenizer):
    df = frame(spark, [(None, "b"), (3, "x y"), (3, "x y"), (-5, None)])
    got = tokens.read_tokens(tokens.write_tokens(df, BPE)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, -5, 3, 3] and [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()


@pytest.mark.parametrize("bits", [1, 5, 13, 16, 17, 20])
def test_bit_packing_has_random_access(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001).astype(np.uint32)
    data = tokens.pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8)
    for a, n in ((0, 1001), (0, 0), (137, 501), (1000, 1), (7, 9)):
        assert (tokens.unpack(data, bits, a, n) == ids[a : a + n]).all()


def test_encoder_agrees_with_the_library_after_forgetting(tokenizer):
    enc = tokens.Encoder(BPE, remember=50, at_once=200)
    texts = [t or "" for _, t in DOCS]
    assert [x.tolist() for x in enc.encode(texts)] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_encoder_agrees_with_the_library_on_odd_texts(tokenizer):
    rnd = random.Random(6)
    atoms = [*" \n\t\r.,-_!?()'\"<|>#1é́ß×÷ŉſ—…日😀½²ª\u2003\u00a0\u3000\u0085\u200b\x1c\x00", "  ", "\n\n", "'s", "'ll", "a", "Word", "don't", "<|endoftext|>", "http://x.y/z?q=1"]
    texts = ["".join(rnd.choice(atoms) for _ in range(rnd.randint(0, 25))) for _ in range(4000)]
    enc = tokens.Encoder(BPE, remember=500, at_once=3000)
    assert [x.tolist() for x in enc.encode(texts)] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


# ------------------------------------------------------------------------------------------------- 5 SimHash

def plain_fingerprint(text, k=3):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(nodes, linked):
    root = {i: i for i in nodes}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in nodes}


def test_simhash_components(docs, spark):
    got = rows(simhash.near_duplicates(docs))
    fp = {i: plain_fingerprint(t) for i, t in DOCS}
    assert {i: r.fp & (2**64 - 1) for i, r in got.items()} == fp
    ids = sorted(fp)
    want = plain_components(ids, [(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 2])
    assert {i: r.component_id for i, r in got.items()} == want
    kept = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    assert kept == set(want.values())
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_bk_tree_links_are_those_of_all_pairs():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.integers(0, 64, rng.integers(0, 4))) for b in base for _ in range(30)]
    items = np.unique(np.array([*near, 0, 1, 2**64 - 1], np.uint64))
    want = plain_components(range(len(items)), [(a, b) for a in range(len(items)) for b in range(a + 1, len(items)) if int(items[a] ^ items[b]).bit_count() <= 2])
    assert simhash.shard_links(items, 2).tolist() == [want[i] for i in range(len(items))]


def test_simhash_chain_and_pairs_apart_in_every_band(spark):
    chain = [(1 << (2 * i)) - 1 for i in range(12)]  # each two bits from the next
    df = spark.createDataFrame([(x,) for x in chain], "fp long")
    label = {r.node: r.label for r in simhash.components(simhash.links(df)).collect()}
    assert set(label.values()) == {0} and set(label) == set(chain)


# ------------------------------------------------------------------------------------------ 6 repeated passages

def test_repeated_passages(docs, spark):
    seen, want = set(), {}
    for i, t in sorted(DOCS):
        w = words(t)
        gone = set()
        for p in range(len(w) - 19):
            k = tuple(w[p : p + 20])
            if k in seen:
                gone.update(range(p, p + 20))
            seen.add(k)
        want[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    got = rows(phrases.remove_repeats(docs, keep=("lang", "n_chars")))
    assert {i: (r.n_words, r.n_removed, r.text) for i, r in got.items()} == want
    assert got[5].lang == "en" and got[5].n_chars == len(dict(DOCS)[5])
    same = rows(phrases.remove_repeats(docs, untouched=True))
    assert all(same[i].text == (t or "") for i, t in DOCS if want[i][1] == 0)
    assert phrases.remove_repeats(empty(spark)).count() == 0


# --------------------------------------------------------------------------------------------------- 7 packing

def check_packing(pieces, docs, tokenizer, length):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    for i, t in docs:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids), i
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == length or (at < length and at & (at - 1) == 0)


def test_packing_covers_all_without_padding(docs, spark, tokenizer):
    check_packing(packing.pack_documents(docs, BPE).collect(), DOCS, tokenizer, 2048)
    check_packing(packing.pack_documents(docs, BPE, length=64, shard_docs=7).collect(), DOCS, tokenizer, 64)
    assert packing.pack_documents(empty(spark), BPE).count() == 0


def plain_fill(docs, corpus, length):
    """Documents in the order in which they are packed: a window's seed, then the unused ones of highest score for it."""
    index, free, order, used, seed = packing.Shard([x for _, x in docs], corpus), set(range(len(docs))), [], 0, None
    while free:
        if used == 0 or seed is None:
            pick = min(free)
            seed = None
        else:
            scores = index.scores(seed)
            pick = min(free, key=lambda i: (-scores[i], i))
        free.remove(pick)
        order.append(pick)
        crossed = used + len(docs[pick][1]) > length
        used = (used + len(docs[pick][1])) % length
        if used and (seed is None or crossed):
            seed = pick  # what is left of it opens the next window
        elif not used:
            seed = None
    return order


def test_packing_fills_windows_by_falling_score():
    rng = np.random.default_rng(8)
    docs = [(i, rng.integers(0, 40, rng.integers(3, 30)).astype(np.uint32)) for i in range(60)]
    df = np.bincount(np.concatenate([np.unique(x) for _, x in docs]), minlength=40) * 3  # of a larger corpus
    corpus = packing.Corpus(df, 400, 15.0)
    filler = packing.Filler(64, 0)
    packing.fill(docs, filler, corpus)
    filler.end()
    pieces = sorted((p for p in filler.done if p[1] == 0), key=lambda p: (p[5], p[6]))
    assert [p[0] for p in pieces] == plain_fill(docs, corpus, 64)


def test_packing_counts_the_whole_corpus(docs, tokenizer):
    got = packing.corpus_of(packing.encoded(docs, BPE, 1))
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for _, t in DOCS]
    want = Counter(x for d in ids for x in set(d))
    assert got.n == len(DOCS) and got.mean == pytest.approx(np.mean([len(d) for d in ids]))
    assert {i: n for i, n in enumerate(got.df.tolist()) if n} == dict(want)


def test_packing_deals_by_the_strongest_terms():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 12, rng.integers(0, 9)).astype(np.uint32) for _ in range(30)]
    corpus = packing.Corpus(rng.integers(1, 40, 12), 90, 4.0)
    got = corpus.strongest(np.concatenate(docs), np.array([len(d) for d in docs]), 20)
    for d, row in zip(docs, got.tolist()):
        n = Counter(d.tolist())
        w = {t: float(corpus.weights(np.array([t]), np.array([k]), np.array([len(d)]))[0]) * (1 if corpus.df[t] >= 20 else 1e-6) for t, k in n.items()}
        want = sorted(w, key=lambda t: (-w[t], t))[:3]
        assert row == want + [-1] * (3 - len(want))


def test_packing_scores_are_bm25():
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 30, rng.integers(1, 40)).astype(np.uint32) for _ in range(25)]
    index = packing.Shard(docs)
    n, avg = len(docs), np.mean([len(d) for d in docs])
    for s in (0, 7, 24):
        want = np.zeros(n)
        for t in set(docs[s].tolist()):
            df = sum(t in d for d in docs)
            idf = max(0.0, np.log((n - df + 0.5) / (df + 0.5)))
            for j, d in enumerate(docs):
                tf = int((d == t).sum())
                if tf:
                    want[j] += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / avg))
        assert np.allclose(index.scores(s), want)


# ---------------------------------------------------------------------------------------- 8 quality classifier

def test_classifier_on_held_out_rows(spark, data):
    docs, labels = spark.read.parquet(f"{data}/../sf0.01/documents.parquet"), spark.read.parquet(f"{data}/../sf0.01/labels.parquet")
    got = quality_classifier.op8_quality_classifier(spark, f"{data}/../sf0.01").join(labels, "doc_id").where("held_out").toPandas()
    assert docs.count() == 1000 and ((got.score >= 0) & (got.score <= 1)).all()
    assert (got.predicted == got.quality).mean() > 0.95


def test_classifier_votes_are_those_of_all_cosines():
    rng = np.random.default_rng(0)
    rows = rng.poisson(0.02, (60, quality_classifier.BUCKETS)).astype(np.float32)
    rows[10] = rows[11] = rows[12]  # ties
    labels = rng.integers(0, 2, 60)
    model = quality_classifier.fit(rows, labels, rank=8, neighbours=5)
    asked = np.vstack([rows[:20], rng.poisson(0.02, (10, quality_classifier.BUCKETS)), np.zeros((1, quality_classifier.BUCKETS))]).astype(np.float32)
    got = model.score(asked)
    for q, score in zip(model.place(asked), got):
        if not np.abs(q).sum():
            assert score == pytest.approx(labels.mean())
            continue
        cos = [float(np.dot(q, v)) for v in model.vectors]
        best = sorted(range(60), key=lambda i: (-round(cos[i], 6), i))[:5]
        weight = [max(cos[i], 0) + 1e-12 for i in best]
        assert score == pytest.approx(sum(w * labels[i] for w, i in zip(weight, best)) / sum(weight), abs=1e-4)


def test_classifier_takes_one_text_of_a_repeated_doc_id(spark):
    df = frame(spark, [(1, "some words here")] * 40 + [(1, "other words there")] + [(3, "and these are bad words")])
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert len(quality_classifier.train(df, labels).labels) == len({i for i in (1, 3) if zlib.crc32(str(i).encode()) % 5})


def test_classifier_without_labels_or_texts(spark):
    df = frame(spark, [(1, None), (2, ""), (3, "ab"), (None, "some text here")])
    labels = spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 7, 0)], "doc_id long, quality int, toxic int")
    model = quality_classifier.train(df, labels)
    assert {r.score for r in quality_classifier.score(df, model).collect()} == {0.5}
    assert quality_classifier.score(empty(spark), model).count() == 0


def test_classifier_is_blind_to_labels_of_held_out_rows(spark):
    ids = spark.range(1000).select("id", quality_classifier.held_out(__import__("pyspark").sql.functions.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in ids)


# -------------------------------------------------------------------------------------------- 9 suffix dedup

def plain_recurring(docs, size):
    n = Counter(b[p : p + size] for _, t in docs for b in [(t or "").encode()] for p in range(len(b) - size + 1))
    out = {}
    for i, t in docs:
        b = (t or "").encode()
        edge = np.zeros(len(b) + 1, int)
        for p in range(len(b) - size + 1):
            if n[b[p : p + size]] > 1:
                edge[p] += 1
                edge[p + size] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 5])
def test_recurring_bytes(spark, seed):
    these = awkward(seed)
    got = rows(suffixes.remove_recurring(frame(spark, these)))
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for i, r in got.items()} == plain_recurring(these, 400)


def test_recurring_bytes_never_span_two_documents(spark):
    rnd = random.Random(5)
    prose = lambda n: "".join(rnd.choice("abcdefghij klm") for _ in range(n))
    these = []
    for i in range(40):  # ends that agree over fewer than 400 bytes, each before one of two copies
        end, copy = prose(rnd.randint(150, 399)), prose(rnd.randint(500, 900))
        for k in (0, 1):
            these += [(1000 * k + 2 * i, prose(300) + end), (1000 * k + 2 * i + 1, copy)]
    got = rows(suffixes.remove_recurring(frame(spark, these, 1)))
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for i, r in got.items()} == plain_recurring(these, 400)


def test_recurring_bytes_of_nothing(spark):
    assert suffixes.remove_recurring(empty(spark)).count() == 0
    got = suffixes.remove_recurring(frame(spark, [(1, None), (None, "q" * 500), (None, "q" * 500)])).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans) for r in got) == [(0, 0, 0), (500, 500, 1), (500, 500, 1)]


# ------------------------------------------------------------------------------------------ 10 decontamination

def plain_hits(docs, items):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    out = {}
    for i, t in docs:
        w, hit, ids = norm(t), set(), set()
        for item, x in items:
            v = norm(x)
            m = min(10, len(v))
            if not m:
                continue
            wins = {tuple(v[p : p + m]) for p in range(len(v) - m + 1)}
            for p in range(len(w) - m + 1):
                if tuple(w[p : p + m]) in wins:
                    hit.update(range(p, p + m))
                    ids.add(item)
        ids = sorted(str(x) for x in ids if x is not None)
        out[i] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("block_bytes", [16_000_000, 400])
def test_decontamination(spark, docs, block_bytes):
    texts = dict(DOCS)
    cut = lambda i, a, b: " ".join(words(texts[i])[a:b])
    items = [(1, cut(2013, 5, 60)), (2, cut(2013, 50, 55)), (3, "One"), (4, None), (5, "..."), (6, "it's 's"), (7, "the of and to in is the of and to in"), (8, cut(2013, 100, 109) + " other words"), (None, cut(2013, 300, 330)), (1, cut(2013, 400, 412)), (9, "never seen words anywhere at all")]
    tests = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    got = rows(decontamination.decontaminate(docs, tests, block_bytes=block_bytes))
    want = plain_hits(DOCS, items)
    assert {i: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for i, r in got.items()} == want
    clean = {r.doc_id for r in decontamination.uncontaminated(docs, tests, block_bytes=block_bytes).collect()}
    assert clean == {i for i, x in want.items() if not x[4]}


def test_decontamination_of_nothing(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.decontaminate(docs, none).where("contaminated").count() == 0
    assert decontamination.decontaminate(empty(spark), none).count() == 0
