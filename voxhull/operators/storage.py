"""Tables between rounds of an iteration, in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where none is named, as in tests, a temporary one on a single machine; a cluster needs one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.voxhull.rounds", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="voxhull-")
        spark.conf.set("spark.voxhull.rounds", root)
    return root.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df written by Spark to the shared folder, and read back: lineage ends here, and lost executors lose nothing."""
    spark = df.sparkSession
    path, schema = f"{shared_dir(spark)}/round-{uuid.uuid4().hex}", df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def shuffled(table: DataFrame) -> DataFrame:
    """The table, to be joined by a shuffle. Spark takes a stored table's size from its files, which are compressed and hold one row for the several that
    become of it, and so would gather millions of rows on the driver to broadcast them. For tables that grow with the input, on keys of few rows each."""
    return table.hint("merge")


#: Rows that may be broadcast, where a table may have few or many.
FEW = 1 << 16


def sent(table: DataFrame, rows: int) -> DataFrame:
    """The table, of at most so many rows by a count: broadcast if they are few, else joined by a shuffle."""
    return F.broadcast(table) if rows <= FEW else shuffled(table)
