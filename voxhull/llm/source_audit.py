"""Source divergence audit: how far the sources of a language differ in their use of terms, and by which terms.

Terms are counted for each (lang, source), and a language keeps those in at least ``least_docs`` of its documents. A kept
term's column of counts, one for each source in which it occurs, is a sparse vector; terms of identical vectors are one
vector with a multiplicity. Each pair of sources is evaluated once for each distinct vector in which both occur. Where
only one of two sources has a term, sums over that source alone suffice, since the other's share is then the same for
all such terms, so pairs in which a term doesn't occur cost nothing.

Shares are whole numbers, p = 1 + floor(scale * (count + prior) / (N + prior * V)), and all sums are of whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, stored

SCALE = 1_000_000_000


def terms(text: Column) -> Column:
    """Of a text the runs of letters and of characters beyond ASCII, A-Z lower-cased, in order; null has none."""
    runs = F.split(ascii_lower(F.coalesce(text, F.lit(""))), "[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
    return F.filter(runs, lambda t: t != "")


def share(count: Column | str, total: Column | str, prior: int) -> Column:
    """1 + floor(10**9 * (count + prior) / total), exact for totals below 9 * 10**15: three steps of long division.

    0 where total is 0, which is so where a language keeps no term.
    """
    count, total = (F.col(c) if isinstance(c, str) else c for c in (count, total))
    rest, out = count + F.lit(prior), F.lit(0).cast("long")
    whole = F.call_function("div", rest, total)
    rest, out = rest % total, whole
    for _ in range(3):
        rest = rest * F.lit(1000)
        out, rest = out * 1000 + F.call_function("div", rest, total), rest % total
    return F.when(total > 0, out + 1).otherwise(F.lit(0).cast("long"))


def kept_terms(docs: DataFrame, least_docs: int) -> DataFrame:
    """lang, term, v: its vector of (source, n), sources ascending, for terms in at least least_docs documents of the lang.

    A row of docs is a document, whatever its doc_id. A vector has as many entries as there are sources with the term.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    listed = docs.select(name("lang"), name("source"), terms(F.col("text")).alias("t"))
    mark = lambda n, df: lambda t: F.struct(t.alias("term"), F.lit(n).cast("long").alias("n"), F.lit(df).cast("long").alias("df"))
    each = listed.select("lang", "source", F.inline(F.concat(F.transform("t", mark(1, 0)), F.transform(F.array_distinct("t"), mark(0, 1)))))
    counted = each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    vector = F.array_sort(F.collect_list(F.struct("source", "n")))
    return counted.groupBy("lang", "term").agg(F.sum("df").alias("df"), vector.alias("v")).where(F.col("df") >= least_docs).drop("df")


def group_sizes(docs: DataFrame, kept: DataFrame, prior: int) -> DataFrame:
    """A row for each (lang, source) of docs: gid from 1 in the order of sources, v_lang kept terms of the lang, total = N + prior * v_lang,
    lang_total the same over the lang, p0 the share of a term that the source doesn't have."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    groups = docs.select(name("lang"), name("source")).distinct()
    n = kept.select("lang", F.inline("v")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    v = kept.groupBy("lang").agg(F.count("*").alias("v_lang"))
    zero = F.lit(0).cast("long")
    g = groups.join(n, ["lang", "source"], "left").join(v, "lang", "left").select("lang", "source", F.coalesce("n", zero).alias("n"), F.coalesce("v_lang", zero).alias("v_lang"))
    by_lang = Window.partitionBy("lang")
    base = F.col("v_lang") * F.lit(prior)
    g = g.select("lang", "source", F.row_number().over(by_lang.orderBy("source")).alias("gid"), "v_lang", (F.col("n") + base).alias("total"), (F.sum("n").over(by_lang) + base).alias("lang_total"))
    return g.withColumn("p0", share(F.lit(0).cast("long"), "total", prior))


def distances(kept: DataFrame, groups: DataFrame, prior: int) -> DataFrame:
    """lang, i < j (gids), value: the sum over all kept terms of the difference of the two sources' shares."""
    vectors = stored(kept.groupBy("lang", "v").agg(F.count("*").alias("m")).withColumn("vid", F.monotonically_increasing_id()), "vectors")
    g = groups.select("lang", "source", "gid", "total", "p0")
    cells = vectors.select("lang", "vid", "m", F.inline("v")).join(g, ["lang", "source"])
    cells = cells.select("lang", "vid", "m", "gid", share("n", "total", prior).alias("p"), "p0")

    # both sources have the term: what is added to the sums below
    rows = cells.groupBy("lang", "vid", "m").agg(F.array_sort(F.collect_list(F.struct("gid", "p", "p0"))).alias("w"))
    first = rows.select("lang", "m", "w", F.posexplode("w").alias("at", "a"))
    pairs = first.select("lang", "m", "a", F.explode(F.slice("w", F.col("at") + 2, F.size("w"))).alias("b"))
    far = lambda x, y: F.abs(F.col(x) - F.col(y))
    extra = far("a.p", "b.p") - far("a.p", "b.p0") - far("a.p0", "b.p") + far("a.p0", "b.p0")
    both = pairs.groupBy("lang", F.col("a.gid").alias("i"), F.col("b.gid").alias("j")).agg(F.sum(F.col("m") * extra).alias("both"))

    # one source has the term: |p - q| = p - q + 2 max(q - p, 0), and only the last needs more than the source's own sums
    shares = cells.groupBy("lang", "gid", "p").agg(F.sum("m").alias("k"))
    own = shares.groupBy("lang", "gid").agg(F.sum("k").alias("terms"), F.sum(F.col("k") * F.col("p")).alias("mass"))
    other = groups.select("lang", F.col("gid").alias("to"), F.col("p0").alias("q"))
    low = shares.withColumnRenamed("gid", "of").join(other, "lang").where((F.col("p") < F.col("q")) & (F.col("of") != F.col("to")))
    low = low.groupBy("lang", F.least("of", "to").alias("i"), F.greatest("of", "to").alias("j")).agg(F.sum(2 * F.col("k") * (F.col("q") - F.col("p"))).alias("low"))

    zero = F.lit(0).cast("long")
    sums = groups.select("lang", "gid", "p0", "v_lang").join(own, ["lang", "gid"], "left").select("lang", "gid", "p0", "v_lang", *[F.coalesce(c, zero).alias(c) for c in ("terms", "mass")])
    left = sums.select("lang", F.col("gid").alias("i"), "v_lang", F.struct("p0", "terms", "mass").alias("a"))
    right = sums.select("lang", F.col("gid").alias("j"), F.struct("p0", "terms", "mass").alias("b"))
    z = far("a.p0", "b.p0")
    one = lambda x, y: F.col(f"{x}.mass") - F.col(f"{x}.terms") * (F.col(f"{y}.p0") + z)
    every = left.join(right, "lang").where("i < j").join(low, ["lang", "i", "j"], "left").join(both, ["lang", "i", "j"], "left")
    return every.select("lang", "i", "j", (F.col("v_lang") * z + one("a", "b") + one("b", "a") + F.coalesce("low", zero) + F.coalesce("both", zero)).alias("value"))


def audit(docs: DataFrame, least_docs: int = 30, prior: int = 5, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank over docs(text, lang, source); null text, lang and source are ''. Further columns of docs are ignored.

    part 'pair': the group's distance to each other source of its lang. part 'term': of the terms that the group uses more than its lang
    does, the top ones by difference. Ranks are by value, descending, then by item. Repeated rows count each; without rows there is no result,
    and a lang that keeps no term has pairs of value 0.
    """
    kept = stored(kept_terms(docs, least_docs), "kept-terms")
    groups = stored(group_sizes(docs, kept, prior), "groups")
    d = distances(kept, groups, prior)
    names = lambda gid, name: groups.select("lang", F.col("gid").alias(gid), F.col("source").alias(name))
    d = d.join(names("i", "s"), ["lang", "i"]).join(names("j", "t"), ["lang", "j"])
    way = lambda a, b: F.struct(F.col(a).alias("source"), F.col(b).alias("item"))
    pair = d.select("lang", "value", F.inline(F.array(way("s", "t"), way("t", "s")))).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    in_lang = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    used = kept.select("lang", "term", in_lang.alias("n_lang"), F.inline("v")).join(groups.select("lang", "source", "total", "lang_total"), ["lang", "source"])
    term = used.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (share("n", "total", prior) - share("n_lang", "lang_total", prior)).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda x: x.withColumn("rank", F.row_number().over(order))
    return ranked(pair).unionByName(ranked(term.where("value > 0")).where(F.col("rank") <= top))


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op12_source_divergence": op12_source_divergence}

_P = "1 + CAST((1000000000::HUGEINT * ({n} + 5)) // ({N} + 5 * V) AS BIGINT)"
ORACLES = {
    "op12_source_divergence": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
w AS (SELECT rid, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
v AS (SELECT lang, count(*) AS V, CAST(sum(n) AS BIGINT) AS NL FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
t AS (SELECT lang, source, CAST(sum(n) AS BIGINT) AS N FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_P.format(n="coalesce(c.n, 0)", N="coalesce(t.N, 0)")} AS p, {_P.format(n="k.n", N="NL")} AS q
    FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN t USING (lang, source) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""
}
