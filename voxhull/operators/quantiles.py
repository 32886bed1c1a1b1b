"""Exact percentiles of groups of any size (A4, A5): no task holds a group's values.

A wanted rank lies in a range of values; the range is cut into buckets, which one partial aggregate counts, and the bucket that holds the rank is the
next range. A few thousand buckets a round leave a few rows of any group after two or three rounds, and these are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored


def percentiles(rows: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float], buckets: int = 4096, few: int = 4096) -> DataFrame:
    """keys and, for each name of ``wanted``, that share's percentile (0 to 1) of the group's values, linear between neighbours.

    Null, NaN and infinite values are left out; a group without others has no row. Keys that are null are a group like any other.
    """
    given, keys = list(keys), [f"_key{i}" for i in range(len(keys))]
    v = F.col("_v")
    rows = rows.select(*[F.col(g).alias(k) for g, k in zip(given, keys)], F.col(value).cast("double").alias("_v")).where(v.isNotNull() & ~F.isnan("_v") & (F.abs(v) < float("inf")))
    rows = stored(rows)
    size = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    rank = lambda q: (F.col("n") - 1) * q
    spots = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(end).alias("end"), f(rank(q)).cast("long").alias("k"), (rank(q) - F.floor(rank(q))).alias("part")) for name, q in wanted.items() for end, f in ((0, F.floor), (1, F.ceil))])
    spot = stored(size.select(*keys, "lo", "hi", F.col("n").alias("left"), F.inline(spots)))
    names = [*keys, "name", "end", "part"]

    def meets(range_: DataFrame) -> DataFrame:
        renamed = range_.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], *[c for c in range_.columns if c not in keys])
        on = [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)] or [F.lit(True)]
        return rows.join(renamed, on).where((v >= F.col("lo")) & (v <= F.col("hi"))).drop(*[f"_{i}" for i in range(len(keys))])

    narrow = (F.col("left") <= few) | (F.col("lo") == F.col("hi"))
    while spot.where(~narrow).limit(1).count():
        at = F.least(F.floor((v - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets), F.lit(buckets - 1))
        counted = meets(spot.where(~narrow)).groupBy(*names, "k", at.alias("bucket")).agg(F.count("*").alias("left"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        upto = F.sum("left").over(Window.partitionBy(*names).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        held = counted.withColumn("upto", upto).where((F.col("k") < F.col("upto")) & (F.col("k") >= F.col("upto") - F.col("left")))
        found = held.withColumn("k", F.col("k") - (F.col("upto") - F.col("left"))).select(spot.columns)
        spot = stored(spot.where(narrow).unionByName(found))
    sure = spot.where("lo = hi").select(*names, F.col("lo").alias("value"))
    order = Window.partitionBy(*names).orderBy("_v")
    sorted_ = meets(spot.where("lo < hi")).withColumn("i", F.row_number().over(order) - 1).where(F.col("i") == F.col("k"))
    ends = sure.unionByName(sorted_.select(*names, v.alias("value")))
    both = ends.groupBy(*keys, "name", "part").agg(F.max(F.when(F.col("end") == 0, F.col("value"))).alias("a"), F.max(F.when(F.col("end") == 1, F.col("value"))).alias("b"))
    between = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") * (1 - F.col("part")) + F.col("b") * F.col("part"))
    out = both.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, between)).alias(name) for name in wanted])
    return out.select(*[F.col(k).alias(g) for g, k in zip(given, keys)], *wanted)
