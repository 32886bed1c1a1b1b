"""The jobs as named queries: each runs its job twice into a new folder under the shared one and reads back what then stands there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxhull.operators.storage import shared_dir
from voxhull.plans.catalogue import R, r, sql_field

from . import mesh_audit, text_envelope


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_mesh_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every face of every mesh, with its mesh's report."""
    out, config = _folder(spark, "job1_mesh_audit"), mesh_audit.Config.read()
    for _ in range(2):
        mesh_audit.run(spark, f"{sf_dir}/lineitem.parquet", out, config)
    faces, report, vertices = (spark.read.parquet(f"{out}/{t}") for t in ("faces", "report", "vertices"))
    heights = vertices.select("mesh_id", F.col("vid").alias("v0"), F.col("x2").alias("height"), F.col("n").alias("n_at"))
    shown = report.select(
        "mesh_id", "n_measured", "n_vertices", "n_used", "n_faces", "n_edges", "n_open_edges", "euler", "watertight", "winding_consistent",
        r("area", 4).alias("mesh_area"), *[r(f"{e}{k}").alias(f"{e}{k}") for e in ("lo", "hi") for k in range(3)], r("epsilon").alias("epsilon"),
    )
    one = faces.select("mesh_id", "fid", "v0", "v1", "v2", r("area").alias("area"), *[r(f"{c}{k}").alias(f"{c}{k}") for c in "ng" for k in range(3)])
    return one.join(heights.withColumn("height", r("height")), ["mesh_id", "v0"]).join(shown, "mesh_id")


def job2_text_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's point, with the counts of its language and source over all batches."""
    out, config = _folder(spark, "job2_text_envelope"), text_envelope.Config.read()
    for _ in range(2):
        text_envelope.run(spark, f"{sf_dir}/documents.parquet", out, f"{out}/_checkpoint", config)
    points, counts = spark.read.schema(text_envelope.POINTS).parquet(f"{out}/points"), spark.read.schema(text_envelope.COVERAGE).parquet(f"{out}/coverage")
    total = counts.groupBy("lang", "source").agg(*[F.sum(c).alias(f"group_{c}") for c in ("n", "n_covered", "n_inside", "n_words")])
    one = points.select("doc_id", "lang", "source", "n_words", *[r(c).alias(c) for c in ("x0", "x1", "x2", "distance")], "covered", "inside")
    return one.join(total, ["lang", "source"])


QUERIES = {"job1_mesh_audit": job1_mesh_audit, "job2_text_envelope": job2_text_envelope}


def _audit_sql(c: mesh_audit.Config) -> str:
    w = c.width
    cross = "[uy * vz - uz * vy, uz * vx - ux * vz, ux * vy - uy * vx]"
    return f"""
WITH v AS (SELECT {c.mesh} AS mesh_id, CAST({c.row} AS BIGINT) AS i, CAST({c.column} AS BIGINT) AS j, CAST(sum(CAST({c.value} AS DECIMAL(18, 4))) AS DOUBLE) / count(*) * {c.value_step!r} AS x2, count(*) AS n
    FROM lineitem WHERE {c.mesh} <> '' AND {c.value} IS NOT NULL AND CAST({c.row} AS BIGINT) >= 0 AND CAST({c.column} AS BIGINT) BETWEEN 0 AND {w - 1} GROUP BY 1, 2, 3),
p AS (SELECT mesh_id, i, j, i * {w} + j AS vid, i * {c.row_step!r} AS x0, j * {c.column_step!r} AS x1, x2, n FROM v),
q AS (SELECT a.mesh_id, a.vid AS v0 FROM p a JOIN p b ON b.mesh_id = a.mesh_id AND b.i = a.i + 1 AND b.j = a.j JOIN p c ON c.mesh_id = a.mesh_id AND c.i = a.i AND c.j = a.j + 1 JOIN p d ON d.mesh_id = a.mesh_id AND d.i = a.i + 1 AND d.j = a.j + 1),
f AS (SELECT mesh_id, v0 * 2 AS fid, v0, v0 + {w} AS v1, v0 + {w + 1} AS v2 FROM q UNION ALL SELECT mesh_id, v0 * 2 + 1, v0, v0 + {w + 1}, v0 + 1 FROM q),
c AS (SELECT f.*, a.x2 AS height, a.n AS n_at, b.x0 - a.x0 AS ux, b.x1 - a.x1 AS uy, b.x2 - a.x2 AS uz, d.x0 - a.x0 AS vx, d.x1 - a.x1 AS vy, d.x2 - a.x2 AS vz,
    (a.x0 + b.x0 + d.x0) / 3 AS g0, (a.x1 + b.x1 + d.x1) / 3 AS g1, (a.x2 + b.x2 + d.x2) / 3 AS g2
    FROM f JOIN p a ON a.mesh_id = f.mesh_id AND a.vid = v0 JOIN p b ON b.mesh_id = f.mesh_id AND b.vid = v1 JOIN p d ON d.mesh_id = f.mesh_id AND d.vid = v2),
g AS (SELECT *, {cross} AS k, sqrt(list_sum(list_transform({cross}, lambda z: z * z))) AS l FROM c),
e AS (SELECT mesh_id, least(a, b) AS lo, greatest(a, b) AS hi, count(*) AS n, count(DISTINCT a) AS ways FROM
    (SELECT mesh_id, v0 AS a, v1 AS b FROM f UNION ALL SELECT mesh_id, v1, v2 FROM f UNION ALL SELECT mesh_id, v2, v0 FROM f) GROUP BY ALL),
es AS (SELECT mesh_id, count(*) AS n_edges, CAST(count(*) FILTER (n = 1) AS BIGINT) AS n_open_edges, bool_and(n = 2) AS watertight, bool_and(n = ways) AS winding_consistent FROM e GROUP BY mesh_id),
fs AS (SELECT mesh_id, count(*) AS n_faces, sum(l / 2) AS area FROM g GROUP BY mesh_id),
us AS (SELECT mesh_id, count(*) AS n_used FROM (SELECT DISTINCT mesh_id, unnest([v0, v1, v2]) AS x FROM f) GROUP BY mesh_id),
vs AS (SELECT mesh_id, CAST(sum(n) AS BIGINT) AS n_measured, count(*) AS n_vertices, {', '.join(f'{m}(x{k}) AS {e}{k}' for e, m in (('lo', 'min'), ('hi', 'max')) for k in range(3))} FROM p GROUP BY mesh_id)
SELECT g.mesh_id, fid, v0, v1, v2, {R('l / 2')} AS area, {', '.join(f"{R(f'k[{k + 1}] / l')} AS n{k}, {R(f'g{k}')} AS g{k}" for k in range(3))}, {R('height')} AS height, n_at,
    n_measured, n_vertices, n_used, n_faces, n_edges, n_open_edges, n_used - n_edges + n_faces AS euler, watertight, winding_consistent, {R('area', 4)} AS mesh_area,
    {', '.join(f"{R(f'{e}{k}')} AS {e}{k}" for e in ('lo', 'hi') for k in range(3))}, {R('0.005 * sqrt(pow(hi0 - lo0, 2) + pow(hi1 - lo1, 2) + pow(hi2 - lo2, 2))')} AS epsilon
FROM g JOIN vs USING (mesh_id) JOIN fs USING (mesh_id) JOIN us USING (mesh_id) JOIN es USING (mesh_id)"""


def _envelope_sql(c: text_envelope.Config) -> str:
    d1, d2 = (sql_field(q) for q in c.primitives)
    h = "least(greatest(0.5 + 0.5 * (d2 - d1) * 32.0, 0.0), 1.0)"
    return f"""
WITH w AS (SELECT doc_id, coalesce(nullif(lang, ''), 'unknown') AS lang, coalesce(nullif(source, ''), 'unknown') AS source, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
n AS (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, len(list_distinct(w)) AS n_distinct, length(array_to_string(w, '')) AS n_chars FROM w),
p AS (SELECT doc_id, lang, source, n_words, log10(n_words + 1.0) / 4 AS x0, CASE WHEN n_words > 0 THEN n_chars / 10.0 / n_words ELSE 0 END AS x1, CASE WHEN n_words > 0 THEN n_distinct / n_words ELSE 0 END AS x2 FROM n),
d AS (SELECT *, {d1} AS d1, {d2} AS d2 FROM p),
u AS (SELECT *, d2 * (1 - {h}) + d1 * {h} - {h} * (1 - {h}) / 32.0 AS distance FROM d),
z AS (SELECT *, abs(distance) <= {c.epsilon!r} AS covered, distance <= 0 AS inside FROM u)
SELECT doc_id, lang, source, n_words, {', '.join(f'{R(x)} AS {x}' for x in ('x0', 'x1', 'x2', 'distance'))}, covered, inside, count(*) OVER g AS group_n, CAST(sum(CAST(covered AS INT)) OVER g AS BIGINT) AS group_n_covered,
    CAST(sum(CAST(inside AS INT)) OVER g AS BIGINT) AS group_n_inside, CAST(sum(n_words) OVER g AS BIGINT) AS group_n_words FROM z WINDOW g AS (PARTITION BY lang, source)"""


ORACLES = {"job1_mesh_audit": _audit_sql(mesh_audit.Config.read()), "job2_text_envelope": _envelope_sql(text_envelope.Config.read())}
