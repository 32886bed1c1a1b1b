"""Quality rules: a threshold table compiled into one projection of ratios, evaluated without user functions.

Every figure comes from array and string expressions over the whole text, in three narrow projections: words and
lines, then hashed 3-word windows in sorted order, then counts. No row is exploded and nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower

SYMBOLS = "#*$%&|<>"

#: Frequent words of the four languages of the corpus; lower case, in alphabetical order.
STOP_WORDS = {
    "de": "an auf das dem den der des die ein eine für im in ist mit nicht sich und von zu".split(),
    "en": "a and are as at be by for from in is it of on or that the this to was with".split(),
    "es": "al con de del el en es esta la las los para por que se su un una y".split(),
    "fr": "au aux dans de des du en est et la le les ou par pour que qui sur un une".split(),
}


@dataclass(frozen=True)
class Rule:
    """A figure, and the range it may have in a text that is kept; None: no bound on that side."""

    figure: str
    least: float | None = None
    most: float | None = None


#: The method's table. Ratios are per word or per line that has a word.
RULES = (
    Rule("n_words", 50, None),
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbols_per_word", None, 0.3),
    Rule("bangs_per_word", None, 0.3),
    Rule("stop_words_per_word", 0.03, None),
    Rule("dup_line_ratio", None, 0.4),
    Rule("bullet_line_ratio", None, 0.9),
    Rule("ellipsis_line_ratio", None, 0.5),
)


def _without(col: Column, chars: str) -> Column:
    return F.translate(col, chars, "")


def figures(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with the figures the rules read; further columns of docs are not carried.

    A null text has no words and no lines: its counts are 0 and its ratios 0. Words are [^\\x20\\x09-\\x0D]+.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id"), text.alias("_t"))
    lists = base.select(
        "doc_id",
        F.filter(F.split("_t", "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "").alias("_w"),
        # a line without its blanks at the ends is empty if it has no word; equality is that of the whole line
        F.filter(F.split("_t", "\n"), lambda x: F.translate(x, BLANKS, "") != "").alias("_l"),
        F.length(_without(F.col("_t"), BLANKS)).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(_without(F.col("_t"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.length("_t") - F.length(_without(F.col("_t"), "!"))).cast("long").alias("n_bangs"),
    )
    stops = sorted({w for ws in STOP_WORDS.values() for w in ws})
    n = F.size("_w")
    counted = lists.select(
        "doc_id", "_w", "word_chars", "n_symbols", "n_bangs",
        n.cast("long").alias("n_words"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_l", lambda x: F.ltrim(x).substr(1, 1).isin("-", "*", "•"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("_l", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.filter("_w", lambda w: _without(ascii_lower(w), ".,;:!?").isin(stops))).cast("long").alias("n_stop_words"),
        # (window, start) in the windows' order: equal windows stand side by side, by start
        F.when(n >= 3, F.sort_array(F.arrays_zip(
            F.zip_with(F.zip_with(F.slice("_w", 1, n - 2), F.slice("_w", 2, n - 2), lambda a, b: F.concat(a, F.lit(" "), b)), F.slice("_w", 3, n - 2), lambda a, b: F.concat(a, F.lit(" "), b)).alias("g"),
            F.sequence(F.lit(0), n - 3).alias("i"),
        ))).alias("_s"),
    )
    windows = counted.drop("_w").withColumn("_g", F.col("_s")["g"]).withColumn("_i", F.col("_s")["i"]).drop("_s")
    m = F.size("_g")
    equal_next = F.zip_with(F.slice("_g", 1, m - 1), F.slice("_g", 2, m - 1), lambda a, b: a == b)
    marked = windows.withColumn("_e", F.when(m >= 2, equal_next)).drop("_g")
    after, before = F.concat("_e", F.array(F.lit(False))), F.concat(F.array(F.lit(False)), "_e")
    pairs = F.arrays_zip(F.zip_with(after, before, lambda a, b: a | b).alias("r"), F.col("_i").alias("i"))
    starts = F.sort_array(F.transform(F.filter(pairs, lambda p: p["r"]), lambda p: p["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("at"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(3), p - a["at"])).alias("n")),
        lambda a: a["n"],
    )
    repeats = F.when(F.col("_e").isNull() | ~F.exists("_e", lambda x: x), F.lit(0).cast("long")).otherwise(covered)
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return marked.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeats.alias("n_repeat_words"), "n_lines",
        ratio("word_chars", "n_words").alias("mean_word_chars"),
        ratio("n_symbols", "n_words").alias("symbols_per_word"),
        ratio("n_bangs", "n_words").alias("bangs_per_word"),
        ratio("n_stop_words", "n_words").alias("stop_words_per_word"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        ratio("n_bullet_lines", "n_lines").alias("bullet_line_ratio"),
        ratio("n_ellipsis_lines", "n_lines").alias("ellipsis_line_ratio"),
    )


def compiled(rules=RULES) -> Column:
    """The rules as one boolean column over figures()."""
    out = F.lit(True)
    for r in rules:
        if r.least is not None:
            out = out & (F.col(r.figure) >= r.least)
        if r.most is not None:
            out = out & (F.col(r.figure) <= r.most)
    return out


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    """figures() with base_failed and kept. A row for each row of docs; ties and repeats are judged each for itself."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return figures(docs).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compiled(rules))


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_SQL_STOPS = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))
_SQL_RULES = " AND ".join(
    f"{r.figure} {op} {v}" for r in RULES for op, v in ((">=", r.least), ("<=", r.most)) if v is not None
)
_CR = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLES = {
    "op2_quality_rules": f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, x, list_filter(regexp_split_to_array(x, '[ \\t\\n\\x0B\\f\\r]+'), lambda v: v <> '') AS ws,
             list_filter(string_split(x, chr(10)), lambda v: length(translate(v, {_CR}, '')) > 0) AS ls FROM t),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g) WHERE c > 1),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
f AS (SELECT w.doc_id, len(ws) AS n_words, length(translate(x, {_CR}, '')) AS word_chars,
             length(x) - length(translate(x, '{SYMBOLS}', '')) AS n_symbols, length(x) - length(translate(x, '!', '')) AS n_bangs,
             len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words,
             len(list_filter(ls, lambda v: substr(ltrim(v), 1, 1) IN ('-', '*', '•'))) AS n_bullet_lines,
             len(list_filter(ls, lambda v: rtrim(v) LIKE '%...' OR rtrim(v) LIKE '%…')) AS n_ellipsis_lines,
             len(list_filter(ws, lambda v: translate(translate(v, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '.,;:!?', '') IN ({_SQL_STOPS}))) AS n_stop_words
      FROM w LEFT JOIN p ON w.doc_id = p.doc_id),
q AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
             CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbols_per_word,
             CASE WHEN n_words > 0 THEN n_bangs / n_words ELSE 0 END AS bangs_per_word,
             CASE WHEN n_words > 0 THEN n_stop_words / n_words ELSE 0 END AS stop_words_per_word,
             CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio,
             CASE WHEN n_lines > 0 THEN n_bullet_lines / n_lines ELSE 0 END AS bullet_line_ratio,
             CASE WHEN n_lines > 0 THEN n_ellipsis_lines / n_lines ELSE 0 END AS ellipsis_line_ratio,
             (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       (NOT base_failed AND {_SQL_RULES}) AS kept FROM q"""
}
QUERIES = {"op2_quality_rules": op2_quality_rules}
