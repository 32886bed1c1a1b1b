"""Documents with the corner cases that every operator has to stand."""

import random

BLANKS = " \t\n\x0b\x0c\r"


def awkward(seed: int = 0, n: int = 120):
    """(doc_id, text): shared pieces of many lengths, exact and near copies, junk, blanks, non-ASCII, nulls, ties, long texts."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 7))) for _ in range(250)]
    para = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    pool = [para(rnd.randint(40, 300)) for _ in range(8)]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randint(0, 5)):
            x = rnd.random()
            if x < 0.35:
                p = rnd.choice(pool)
                a = rnd.randint(0, len(p) // 2)
                parts.append(p[a : rnd.randint(a, len(p))])
            elif x < 0.45:
                parts.append(rnd.choice(["a", "ab ", "xyz "]) * rnd.randint(1, 300))
            else:
                parts.append(para(rnd.randint(1, 100)))
        docs.append((i, rnd.choice([" ", "\n", "\t "]).join(parts)))
    docs += [(1000 + i, docs[i][1]) for i in range(0, 30, 3)]  # copies
    docs += [(1100 + i, docs[i][1] + " tail") for i in range(0, 30, 5)]  # near copies
    docs += [
        (2000, None), (2001, ""), (2002, " \n\t"), (2003, "é" * 500), (2004, "x" * 399), (2005, "y" * 400), (2006, "y" * 400), (2007, "z" * 401),
        (2008, "One."), (2009, "Déjà vu — ça va? 日本語 text. \u2003 wide\u00a0blank \u200b zero"), (2010, "it's 's don't!' (see) #tag# $5 <|endoftext|> a\x1c b"),
        (2011, "WORD!! " * 200), (2012, "the of and to in is " * 60), (2013, para(4000)),
    ]
    return docs


def frame(spark, docs, parts: int = 3):
    """docs as a table with further columns, some of which clash with names that operators use."""
    rows = [(i, t, "en", "src", 0 if t is None else len(t), -1, "x") for i, t in docs]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words long, chunk string").repartition(parts)


def empty(spark):
    return frame(spark, [(0, "x")], 1).where("doc_id < 0")
