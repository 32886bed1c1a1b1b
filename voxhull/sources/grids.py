"""Grid sources (S5, S6, D17): regular points over bounds, made where they are used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(spark: SparkSession, bounds: DataFrame, resolution: int, margin: float = 0.1) -> DataFrame:
    """pt_id, x0, x1, x2 of resolution^3 points; x0 runs slowest. bounds: one row lo0..hi2; margin: of its extent, on
    each side. S6 is margin 0. An axis without extent gets its one coordinate."""
    n = resolution
    index = (F.expr(f"id div {n * n}"), F.expr(f"id div {n} % {n}"), F.expr(f"id % {n}"))
    out = [F.col("id").alias("pt_id")]
    for i, k in enumerate(index):
        lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        pad = (hi - lo) * margin
        out.append((lo - pad + (hi - lo + pad * 2) * k / max(1, n - 1)).alias(f"x{i}"))
    return spark.range(n**3).join(F.broadcast(bounds), F.lit(True)).select(*out)  # bounds: an ungrouped aggregate's one row
