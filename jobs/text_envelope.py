"""New text assets against an implicit envelope: incremental, by a stream that takes what has arrived and ends.

A text is described by a point: x0 = log10(1 + words) / 4, x1 = mean characters of a word / 10, x2 = distinct words / words. The
envelope is a smooth union of primitives over that space, as compiled from texts that are known to be good. The job tells
each text's signed distance to the envelope's surface, whether it lies inside and whether it lies near the surface, within epsilon,
where a closer look pays; and, for each language and source, how many do.

    python -m jobs.text_envelope --input /data/documents.parquet --output /data/envelope [--checkpoint ...] [--config ...]

Two tables lie under the output folder. ``points`` has a row for each text, partitioned by batch and lang; ``coverage`` has the counts of each
batch, language and source, partitioned by batch. The checkpoint remembers which files were taken, so a run takes new files only; without new
ones it changes nothing. A batch that was interrupted is taken again with the same number and the same files, and replaces
its own partitions. Output and checkpoint belong together: remove both to start anew.
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields
from pathlib import Path

if __package__ in (None, ""):
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import Column, DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from voxhull.streaming import fields as streams  # noqa: E402

log = logging.getLogger("jobs.text_envelope")

POINTS = "doc_id long, source string, n_words long, x0 double, x1 double, x2 double, distance double, covered boolean, inside boolean, lang string, batch long"
COVERAGE = "lang string, source string, n long, n_covered long, n_inside long, n_words long, batch long"


@dataclass(frozen=True)
class Config:
    """The envelope's primitives in the order of their union, the width of its surface, and how many files make a batch at most."""

    primitives: list[Mapping]
    epsilon: float = 0.02
    max_files: int = 1000

    @classmethod
    def read(cls, path: str | Path = Path(__file__).with_suffix(".json")) -> Config:
        given = json.loads(Path(path).read_text())
        if unknown := set(given) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**given)


def words(text: Column) -> Column:
    """Runs of characters that are no ASCII blank; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")


def described(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, x0, x1, x2 of each text; null and empty lang and source are 'unknown', a text without words is at the origin."""
    name = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("unknown")).alias(c)
    listed = docs.select("doc_id", name("lang"), name("source"), words(F.col("text")).alias("w"))
    counts = listed.select("doc_id", "lang", "source", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).alias("n_distinct"), F.length(F.array_join("w", "")).alias("n_chars"))
    share = lambda a: F.when(F.col("n_words") > 0, a / F.col("n_words")).otherwise(F.lit(0.0))
    return counts.select(
        "doc_id", "lang", "source", "n_words",
        (F.log10(F.col("n_words") + 1.0) / 4).alias("x0"), share(F.col("n_chars") / F.lit(10.0)).alias("x1"), share(F.col("n_distinct").cast("double")).alias("x2"),
    )


def placed(docs: DataFrame, config: Config) -> DataFrame:
    """described() with distance, covered and inside."""
    out = streams.distances(described(docs), config.primitives, config.epsilon)
    return out.withColumn("inside", F.col("distance") <= 0)


def coverage(points: DataFrame) -> DataFrame:
    """Counts that add up over batches."""
    n = lambda c: F.sum(F.col(c).cast("long")).alias(f"n_{c}")
    return points.groupBy("lang", "source").agg(F.count("*").alias("n"), n("covered"), n("inside"), F.sum("n_words").alias("n_words"))


def pattern(path: str) -> str:
    """The path as a pattern that only it fits: a file stream takes folders and patterns, a table may be a single file."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, source: str, output: str, checkpoint: str, config: Config) -> dict[str, int]:
    """Take what is new under source and add it to the tables under output; batches and rows taken."""
    output = output.rstrip("/")
    done = {"batches": 0, "rows": 0}
    schema = spark.read.parquet(source).schema

    def write(df: DataFrame, name: str, batch: int, *by: str) -> None:
        path = f"{output}/{name}"
        df.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", *by).parquet(path)
        log.info("batch %d: wrote %s", batch, path)

    def take(docs: DataFrame, batch: int) -> None:
        write(placed(docs, config), "points", batch, "lang")
        mine = docs.sparkSession.read.schema(POINTS).parquet(f"{output}/points").where(F.col("batch") == batch)
        n = mine.count()  # a point for each text; from the files' footers
        log.info("batch %d: read %d rows from %s", batch, n, source)
        write(coverage(mine), "coverage", batch)
        done["batches"] += 1
        done["rows"] += n

    log.info("settings: %s", asdict(config))
    new = spark.readStream.schema(schema).option("maxFilesPerTrigger", config.max_files).parquet(pattern(source))
    stream = new.writeStream.foreachBatch(take).trigger(availableNow=True).option("checkpointLocation", checkpoint).start()
    stream.awaitTermination()
    log.info("took %d rows in %d batches", done["rows"], done["batches"])
    return done


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="text_envelope", description=__doc__.splitlines()[0])
    parser.add_argument("--input", required=True, help="a folder of Parquet files (doc_id, text, lang, source) that grows")
    parser.add_argument("--output", required=True, help="the folder of the two tables")
    parser.add_argument("--checkpoint", help="the stream's checkpoint; by default beside the tables")
    parser.add_argument("--config", default=str(Path(__file__).with_suffix(".json")), help="settings, a JSON file")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("text_envelope").getOrCreate()
    try:
        run(spark, args.input, args.output, args.checkpoint or f"{args.output.rstrip('/')}/_checkpoint", Config.read(args.config))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
