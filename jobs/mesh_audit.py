"""Survey meshes from measurements, and an audit of each mesh.

Measurements (mesh, row, column, value) lie on a lattice; their mean is the height of a vertex. The job writes three tables under
the output folder, each partitioned by mesh_id: ``vertices``, ``faces`` with area, unit normal and centre, and ``report`` with what
decides whether a mesh can be compiled: is it closed, is its winding consistent, how many of its edges are open, its
Euler characteristic, area, bounds and the offset that training data takes from its size.

    python -m jobs.mesh_audit --input /data/lineitem.parquet --output /data/audit [--config jobs/mesh_audit.json] [--mesh A --mesh N]

Heights are sums of decimals, so a rerun gives the same rows. A run over all meshes replaces the tables; a run over some, named by
``meshes`` in the config or by --mesh, replaces their partitions only and leaves those of others.
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
from dataclasses import asdict, dataclass, fields
from pathlib import Path

if __package__ in (None, ""):
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from voxhull.operators import mesh  # noqa: E402
from voxhull.sources import meshes  # noqa: E402

log = logging.getLogger("jobs.mesh_audit")


@dataclass(frozen=True)
class Config:
    """Columns of the measurements; lattice positions are whole numbers, 0 <= column < width; steps are lengths of one unit on each axis."""

    mesh: str
    row: str
    column: str
    value: str
    width: int
    row_step: float
    column_step: float
    value_step: float
    meshes: list[str] | None = None

    @classmethod
    def read(cls, path: str | Path = Path(__file__).with_suffix(".json")) -> Config:
        given = json.loads(Path(path).read_text())
        if unknown := set(given) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**given)


def lattice(measured: DataFrame, config: Config) -> DataFrame:
    """mesh_id, i, j, x0, x1, x2, n: a vertex for each place with a value; rows without a mesh, place or value are left out."""
    i, j = F.col(config.row).cast("long"), F.col(config.column).cast("long")
    cells = measured.select(F.col(config.mesh).cast("string").alias("mesh_id"), i.alias("i"), j.alias("j"), F.col(config.value).cast("decimal(18,4)").alias("v"))
    cells = cells.where((F.col("mesh_id") != "") & F.col("v").isNotNull() & (F.col("i") >= 0) & F.col("j").between(0, config.width - 1))
    mean = F.sum("v").cast("double") / F.count("*")
    g = cells.groupBy("mesh_id", "i", "j").agg((mean * config.value_step).alias("x2"), F.count("*").alias("n"))
    return g.select("mesh_id", "i", "j", (F.col("i") * config.row_step).alias("x0"), (F.col("j") * config.column_step).alias("x1"), "x2", "n")


def report(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """One row a mesh. A mesh of vertices without a face is closed only in name: its counts are 0 and its checks null."""
    v = mesh.bounds(vertices, "mesh_id").join(vertices.groupBy("mesh_id").agg(F.count("*").alias("n_vertices"), F.sum("n").alias("n_measured")), "mesh_id")
    used = faces.select("mesh_id", F.explode(F.array("v0", "v1", "v2")).alias("vid")).distinct().groupBy("mesh_id").agg(F.count("*").alias("n_used"))
    f = faces.groupBy("mesh_id").agg(F.count("*").alias("n_faces"), F.sum("area").alias("area"))
    out = v.join(f, "mesh_id", "left").join(used, "mesh_id", "left").join(mesh.watertight(faces), "mesh_id", "left")
    zero = F.lit(0).cast("long")
    out = out.select(
        "mesh_id", "n_measured", "n_vertices", *[F.coalesce(c, zero).alias(c) for c in ("n_used", "n_faces", "n_edges")], "watertight", "winding_consistent",
        F.coalesce("area", F.lit(0.0)).alias("area"), *[f"{e}{k}" for e in ("lo", "hi") for k in range(3)], "diagonal", "epsilon",
    )
    return out.withColumn("n_open_edges", 2 * F.col("n_edges") - 3 * F.col("n_faces")).withColumn("euler", F.col("n_used") - F.col("n_edges") + F.col("n_faces"))


def run(spark: SparkSession, source: str, output: str, config: Config) -> dict[str, int]:
    """Read measurements from source, write the three tables under output; rows read and written, by table."""
    output = output.rstrip("/")
    overwrite = "static" if config.meshes is None else "dynamic"

    def write(df: DataFrame, name: str) -> tuple[DataFrame, int]:
        path = f"{output}/{name}"
        df.write.mode("overwrite").option("partitionOverwriteMode", overwrite).partitionBy("mesh_id").parquet(path)
        back = spark.read.schema(df.schema).parquet(path)
        back = back if config.meshes is None else back.where(F.col("mesh_id").isin(config.meshes))
        n = back.count()  # from the files' footers
        log.info("wrote %d rows to %s", n, path)
        return back, n

    log.info("settings: %s", asdict(config))
    measured = spark.read.parquet(source)
    n_read = measured.count()  # from the files' footers
    log.info("read %d rows from %s", n_read, source)
    cells = lattice(measured, config)
    if config.meshes is not None:
        cells = cells.where(F.col("mesh_id").isin(config.meshes))
    vid = F.col("i") * config.width + F.col("j")
    vertices, n_vertices = write(cells.select("mesh_id", vid.alias("vid"), "i", "j", "x0", "x1", "x2", "n"), "vertices")
    points, triangles = meshes.height_field(vertices, config.width)
    geometry = mesh.face_geometry(points, triangles).select("mesh_id", "fid", "v0", "v1", "v2", "area", "n0", "n1", "n2", "g0", "g1", "g2")
    faces, n_faces = write(geometry, "faces")
    _, n_reports = write(report(vertices, faces), "report")
    return {"read": n_read, "vertices": n_vertices, "faces": n_faces, "report": n_reports}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="mesh_audit", description=__doc__.splitlines()[0])
    parser.add_argument("--input", required=True, help="a Parquet table of measurements")
    parser.add_argument("--output", required=True, help="the folder of the three tables")
    parser.add_argument("--config", default=str(Path(__file__).with_suffix(".json")), help="settings, a JSON file")
    parser.add_argument("--mesh", action="append", help="only this mesh; may be given more than once")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config = Config.read(args.config)
    if args.mesh:
        config = Config(**{**asdict(config), "meshes": args.mesh})
    spark = SparkSession.builder.appName("mesh_audit").getOrCreate()
    try:
        run(spark, args.input, args.output, config)
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
