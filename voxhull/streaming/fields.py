"""Fields over a stream: the same Columns as for a table, in append mode, and coverage by time window with a watermark."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sdf
from ..functions.vectors import vec


def distances(points: DataFrame, primitives: Sequence[Mapping], epsilon: float = 0.02) -> DataFrame:
    """Each arriving point's distance to the smooth union, and whether it is covered."""
    d = points.withColumn("distance", sdf.smooth_union(vec("x0", "x1", "x2"), primitives))
    return d.withColumn("covered", sdf.covered(F.col("distance"), epsilon))


def coverage_by_window(points: DataFrame, primitives: Sequence[Mapping], time: str = "ts", window: str = "10 minutes", late: str = "5 minutes", epsilon: float = 0.02) -> DataFrame:
    """Coverage for each window of event time; points later than ``late`` behind the newest are left out."""
    d = distances(points.withWatermark(time, late), primitives, epsilon)
    g = d.groupBy(F.window(time, window).alias("w")).agg(F.count("*").alias("n"), F.sum(F.col("covered").cast("long")).alias("n_covered"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "n_covered")
