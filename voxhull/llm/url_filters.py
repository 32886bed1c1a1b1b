"""URL filters: association rules mined from labelled URLs, and fixed host and path rules before them.

A URL becomes a set of tokens: every suffix of its host by whole labels, every path segment, the extension, every query
key and the scheme. FP-growth finds token sets of any size that are frequent among labelled URLs together with their label; those of enough confidence become rules. The
rules are an inverted index by token: a URL's tokens fetch the rules they occur in, and a rule fits once as many of
its tokens as it has came together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored


@dataclass(frozen=True)
class HostRule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of query op1; the longest that fits decides.
RULES = (
    HostRule("org", "/", "allow"),
    HostRule("example.org", "/es/", "block"),
    HostRule("example.org", "/en/1", "block"),
    HostRule("com", "/fr/", "allow"),
    HostRule("com", "/de/", "block"),
)
BAD = "label=bad"


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null: its host or a subdomain of it, and its path's start."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column, host: Column, path: Column) -> Column:
    """All of the URL's tokens, distinct: host suffixes, path segments, extension, query keys, scheme."""
    labels = F.split(host, r"\.")
    sites = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))
    keys = F.transform(F.split(query, "&"), lambda pair: F.substring_index(pair, "=", 1))
    parts = {
        "site": sites,
        "seg": F.split(path, "/"),
        "ext": F.array(ascii_lower(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})\z", 1))),
        "key": keys,
        "scheme": F.array(ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^(.*?)://", 1), F.lit("")))),
    }

    def named(kind: str, found: Column) -> Column:
        return F.transform(F.filter(found, lambda v: v != ""), lambda v: F.concat(F.lit(f"{kind}="), v))

    return F.array_distinct(F.concat(*[named(k, v) for k, v in parts.items()]))


def mine(labelled: DataFrame, support: float = 0.002, confidence: float = 0.5) -> DataFrame:
    """Rules (rule_id, tokens, size, support, confidence) for bad URLs from labelled(tokens, bad).

    A rule's tokens, of any number, occur in at least ``support`` of the labelled URLs together with a bad label, and of all URLs with
    these tokens at least ``confidence`` are bad. A rule that a smaller rule implies is left out. Support and
    confidence alone bound the work: a URL of t tokens that are frequent counts in up to 2 ** t sets. URLs without tokens don't count.
    """
    sets = labelled.where(F.size("tokens") > 0).select(F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items"))
    frequent = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(sets).freqItemsets
    held = stored(frequent.select(F.array_sort("items").alias("items"), "freq"), "item-sets")
    marked = F.array_contains("items", BAD)
    with_bad = held.where(marked).select(F.array_remove("items", BAD).alias("tokens"), F.col("freq").alias("n_bad")).where(F.size("tokens") > 0)
    alone = held.where(~marked).select(F.col("items").alias("tokens"), F.col("freq").alias("n"))
    rules = with_bad.join(alone, "tokens").where(F.col("n_bad") >= confidence * F.col("n"))
    rules = rules.select(F.array_join("tokens", " ").alias("rule_id"), "tokens", F.size("tokens").alias("size"), F.col("n_bad").alias("support"), (F.col("n_bad") / F.col("n")).alias("confidence"))
    small, token = rules.select(F.col("rule_id").alias("implied_by"), F.col("tokens").alias("few"), F.col("size").alias("fewer"), F.explode("tokens").alias("token")), rules.select("rule_id", "size", F.explode("tokens").alias("token"))
    implied = token.join(small, "token").where("fewer < size").groupBy("rule_id", "implied_by", "fewer").count().where(F.col("count") == F.col("fewer"))
    return stored(rules.join(implied, "rule_id", "left_anti"), "url-rules")


def matches(urls: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """(key, rule_id) for each rule that fits a row of urls(key, tokens); key is unique in urls.

    The index holds a rule under its token that the fewest rules share, so a frequent token fetches few rules, and
    a fetched rule is compared whole.
    """
    listed = rules.select("rule_id", "tokens", F.explode("tokens").alias("token"))
    shared = listed.groupBy("token").agg(F.count("*").alias("n"))
    index = listed.join(shared, "token").groupBy("rule_id").agg(F.min_by("token", F.struct("n", "token")).alias("token"), F.first("tokens").alias("rule_tokens"))
    fetched = urls.select(key, "tokens", F.explode("tokens").alias("token")).join(index, "token")
    return fetched.where(F.size(F.array_except("rule_tokens", "tokens")) == 0).select(key, "rule_id")


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, support: float = 0.002, confidence: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule for each row of pages(page_id, url).

    labels(doc_id, quality, toxic) label the page of the same number: bad if quality is 0 or toxic is 1. A page_id
    that repeats is judged by each of its URLs; null URLs have neither host nor path nor tokens and are allowed. Without labels
    nothing is mined and the method allows all.
    """
    u, h, p = F.col("url"), F.col("host"), F.col("path")
    cut = pages.select(F.col("page_id"), u, host(u).alias("host"), path(u).alias("path"))
    cut = cut.withColumn("tokens", F.when(h != "", tokens(u, h, p)).otherwise(F.array().cast("array<string>")))
    bad = labels.groupBy("doc_id").agg(F.max((F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int")).alias("bad"))
    labelled = cut.join(bad, cut.page_id == bad.doc_id).select("tokens", (F.col("bad") == 1).alias("bad"))
    mined = mine(labelled, support, confidence)
    # a URL's tokens decide, so each distinct token list is matched once and hot hosts collapse
    lists = cut.where(F.size("tokens") > 0).select(F.array_join("tokens", " ").alias("list"), "tokens").groupBy("list").agg(F.first("tokens").alias("tokens"))
    hit = stored(matches(lists, mined, "list").groupBy("list").agg(F.min("rule_id").alias("mined_rule")), "url-hits")
    out = cut.withColumn("list", F.array_join("tokens", " ")).join(hit, "list", "left")
    fixed = fixed_rule(h, p, rules)
    return out.select("page_id", "host", "path", fixed["rule"].alias("rule"), F.coalesce(fixed["verdict"], F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")).alias("verdict"), "mined_rule")


def op1_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_SQL_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TOKENS = {  # kind: values of a URL
    "site": "list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.'))",
    "seg": "string_split(path, '/')",
    "ext": "[" + _SQL_LOWER.format(r"regexp_extract(path, '\.([A-Za-z0-9]{1,8})\z', 1)") + "]",
    "key": r"list_transform(string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'), lambda pair: string_split(pair, '=')[1])",
    "scheme": "[" + _SQL_LOWER.format(r"regexp_extract(url, '(?s)^(.*?)://', 1)") + "]",
}
_CASE = "CASE " + " ".join(
    f"WHEN (host = '{r.host}' OR suffix(host, '.{r.host}')) AND prefix(path, '{r.path}') THEN '{{{r.verdict}|{r.text}}}'"
    for r in sorted(RULES, key=lambda r: (-len(r.text), r.text))
) + " END"
ORACLES = {
    "op1_url_filters": f"""
WITH u AS (SELECT page_id, url, {_SQL_LOWER.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
s AS ({" UNION ".join(f"SELECT page_id, '{k}=' || t AS t FROM (SELECT page_id, unnest({v}) AS t FROM u WHERE host <> '') WHERE t <> ''" for k, v in _TOKENS.items())}),
b AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
n AS (SELECT count(*) AS n FROM (SELECT DISTINCT page_id FROM s) p JOIN b ON p.page_id = b.page_id),
o AS (SELECT t FROM s JOIN b ON s.page_id = b.page_id, n GROUP BY t, n.n HAVING sum(bad) >= ceil(0.002 * n.n)),
p AS (SELECT s.page_id, list_sort(list(s.t)) AS all_ts FROM s JOIN o ON s.t = o.t GROUP BY s.page_id),
a AS (SELECT page_id, list_filter(all_ts, lambda x, i: (m >> (i - 1)) & 1 = 1) AS ts FROM (SELECT page_id, all_ts, unnest(range(1, 1 << len(all_ts))) AS m FROM p)),
f AS (SELECT ts, count(*) AS n, sum(bad) AS n_bad FROM a JOIN b ON a.page_id = b.page_id GROUP BY ts),
r AS (SELECT ts FROM f, n WHERE n_bad >= ceil(0.002 * n.n) AND n_bad >= 0.5 * f.n),
h AS (SELECT DISTINCT page_id FROM a JOIN r ON a.ts = r.ts),
m AS (SELECT page_id, min(array_to_string(a.ts, ' ')) AS mined_rule FROM a JOIN (
        SELECT ts FROM r WHERE NOT EXISTS (SELECT 1 FROM r q WHERE len(q.ts) < len(r.ts) AND list_has_all(r.ts, q.ts))) k ON a.ts = k.ts GROUP BY page_id),
v AS (SELECT u.page_id, host, path, {_CASE} AS fixed, h.page_id IS NOT NULL AS bad, mined_rule FROM u LEFT JOIN h ON u.page_id = h.page_id LEFT JOIN m ON u.page_id = m.page_id)
SELECT page_id, host, path, CASE WHEN fixed IS NOT NULL THEN substr(fixed, strpos(fixed, '|') + 1, length(fixed) - strpos(fixed, '|') - 1) END AS rule,
       coalesce(substr(fixed, 2, strpos(fixed, '|') - 2), CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict, mined_rule FROM v"""
}
QUERIES = {"op1_url_filters": op1_url_filters}
