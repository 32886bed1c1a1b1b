"""The jobs on copies of small tables: repeated, partial, interrupted and growing runs, and their command lines."""

import os
import subprocess
import sys
from dataclasses import replace
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_catalogue import con, table  # noqa: F401

from jobs import mesh_audit, queries, text_envelope

ROOT = Path(__file__).resolve().parent.parent


def rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(r) for r in df.select(cols).collect()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, data, con, name):  # noqa: F811
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions")}
    cols, got = table(queries.QUERIES[name](spark, data).toPandas())
    want_cols, want = table(con.execute(queries.ORACLES[name]).df())
    assert cols == want_cols and len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, float) and abs(x - y) < 3e-5) for x, y in zip(a, b)), (a, b)
    assert before == {k: spark.conf.get(k, None) for k in before}


# -------------------------------------------------------------------------------------------------- mesh_audit

CONFIG = mesh_audit.Config(mesh="m", row="i", column="j", value="v", width=4, row_step=1.0, column_step=1.0, value_step=1.0)
SCHEMA = "m string, i long, j double, v double, fid string"


def survey():
    """Mesh a: 3 x 4 vertices without a corner; b: a single vertex; and rows that no mesh can use."""
    a = [("a", i, float(j), float(i * j), "x") for i in range(3) for j in range(4) if (i, j) != (2, 3)]
    return a + [("a", 0, 0.0, 4.0, "x"), ("b", 7, 1.0, 2.5, None), (None, 0, 0.0, 1.0, "x"), ("", 0, 0.0, 1.0, "x"), ("a", None, 0.0, 1.0, "x"), ("a", 0, None, 1.0, "x"), ("a", 0, 0.0, None, "x"), ("a", -1, 0.0, 1.0, "x"), ("a", 0, 4.0, 1.0, "x")]


def written(spark, out, what):
    return rows(spark.read.parquet(f"{out}/{what}"))


def test_mesh_audit_writes_meshes_and_reports(spark, tmp_path):
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    spark.createDataFrame(survey(), SCHEMA).repartition(3).write.parquet(source)
    counts = mesh_audit.run(spark, source, out, CONFIG)
    assert counts == {"read": len(survey()), "vertices": 12, "faces": 10, "report": 2}
    first = {t: written(spark, out, t) for t in ("vertices", "faces", "report")}
    assert mesh_audit.run(spark, source, out, CONFIG) == counts
    assert {t: written(spark, out, t) for t in first} == first
    a, b = (spark.read.parquet(f"{out}/report").where(F.col("mesh_id") == m).first() for m in "ab")
    assert (a.n_vertices, a.n_used, a.n_faces, a.n_edges, a.n_open_edges, a.euler) == (11, 11, 10, 20, 10, 1) and (a.watertight, a.winding_consistent) == (False, True)
    assert (b.n_vertices, b.n_used, b.n_faces, b.n_edges, b.watertight, b.area) == (1, 0, 0, 0, None, 0.0)
    assert spark.read.parquet(f"{out}/vertices").where("mesh_id = 'a' and vid = 0").first().x2 == 2.0  # the mean of 0 and 4
    assert sorted(p.name for p in (tmp_path / "out" / "faces").iterdir() if p.is_dir()) == ["mesh_id=a"]


def test_mesh_audit_of_one_mesh_leaves_the_others(spark, tmp_path):
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    spark.createDataFrame(survey(), SCHEMA).write.parquet(source)
    mesh_audit.run(spark, source, out, CONFIG)
    changed = spark.createDataFrame(survey(), SCHEMA).withColumn("v", F.col("v") + 1).write.mode("overwrite")
    before = written(spark, out, "vertices")
    changed.parquet(source)
    mesh_audit.run(spark, source, out, replace(CONFIG, meshes=["b"]))
    after = written(spark, out, "vertices")
    column = sorted(spark.read.parquet(f"{out}/vertices").columns).index("mesh_id")
    of = lambda rs, m: [r for r in rs if r[column] == m]
    assert of(before, "a") == of(after, "a") and of(before, "b") != of(after, "b")
    assert spark.read.parquet(f"{out}/report").count() == 2


def test_mesh_audit_of_no_rows(spark, tmp_path):
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    spark.createDataFrame([], SCHEMA).write.parquet(source)
    assert mesh_audit.run(spark, source, out, CONFIG) == {"read": 0, "vertices": 0, "faces": 0, "report": 0}


def test_mesh_audit_heights_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    values = [("a", 0, 0.0, float(Decimal(k) / 100), "x") for k in range(0, 100_000, 7)]
    got = []
    for parts in (1, 5):
        lattice = mesh_audit.lattice(spark.createDataFrame(values, SCHEMA).repartition(parts), CONFIG)
        got.append(lattice.first().x2)
    assert got[0] == got[1]


@pytest.mark.parametrize("job", [mesh_audit, text_envelope])
def test_unknown_settings_are_refused(tmp_path, job):
    path = tmp_path / "c.json"
    path.write_text('{"no_such_setting": 1}')
    with pytest.raises(ValueError, match="no_such_setting"):
        job.Config.read(path)


# ----------------------------------------------------------------------------------------------- text_envelope

ENVELOPE = text_envelope.Config.read()
DOCS = "doc_id long, text string, lang string, source string, distance string"


def texts(lo, hi):
    words = "the quick brown fox jumps over a lazy dog and runs far away from here".split()
    return [(i, " ".join(words[(i * k) % len(words)] for k in range(i * 13 % 90 + 1)), "en" if i % 3 else "de", f"s{i % 2}", "x") for i in range(lo, hi)]


def add(spark, source, docs, parts=2):
    spark.createDataFrame(docs, DOCS).repartition(parts).write.mode("append").parquet(source)


def stands(spark, out):
    points = spark.read.schema(text_envelope.POINTS).parquet(f"{out}/points").drop("batch")
    total = spark.read.schema(text_envelope.COVERAGE).parquet(f"{out}/coverage").groupBy("lang", "source").agg(*[F.sum(c).alias(c) for c in ("n", "n_covered", "n_inside", "n_words")])
    return rows(points), rows(total)


def whole(spark, docs):
    points = text_envelope.placed(spark.createDataFrame(docs, DOCS), ENVELOPE)
    return rows(points), rows(text_envelope.coverage(points))


def test_text_envelope_takes_only_what_is_new(spark, tmp_path):
    source, out, mark = (f"file://{tmp_path}/{x}" for x in ("in", "out", "mark"))
    early = [*texts(0, 40), (900, None, None, None, None), (901, "", "", "s0", "x"), (902, " \n\t", "en", None, "x"), (903, "word " * 20_000, "en", "s1", "x"), (None, "no id", "de", "s1", "x"), *texts(3, 5)]
    add(spark, source, early)
    assert text_envelope.run(spark, source, out, mark, ENVELOPE)["rows"] == len(early)
    assert stands(spark, out) == whole(spark, early)
    assert text_envelope.run(spark, source, out, mark, ENVELOPE) == {"batches": 0, "rows": 0}
    late = [*texts(40, 70), (904, "neu", "a lang of its own", "s9", "x")]
    add(spark, source, late)
    assert text_envelope.run(spark, source, out, mark, replace(ENVELOPE, max_files=1))["rows"] == len(late)
    assert stands(spark, out) == whole(spark, early + late)
    assert text_envelope.run(spark, source, out, mark, ENVELOPE)["rows"] == 0
    assert stands(spark, out) == whole(spark, early + late)


def test_text_envelope_takes_an_interrupted_batch_again(spark, tmp_path, monkeypatch):
    source, out, mark = (f"file://{tmp_path}/{x}" for x in ("in", "out", "mark"))
    add(spark, source, texts(0, 30))
    with monkeypatch.context() as m:  # the points are written, the counts aren't
        m.setattr(text_envelope, "coverage", lambda points: 1 / 0)
        with pytest.raises(Exception, match="division by zero"):
            text_envelope.run(spark, source, out, mark, ENVELOPE)
    add(spark, source, texts(30, 35))
    text_envelope.run(spark, source, out, mark, ENVELOPE)
    assert stands(spark, out) == whole(spark, texts(0, 35))


def test_text_envelope_of_a_single_file_and_of_no_rows(spark, tmp_path):
    spark.createDataFrame(texts(0, 5), DOCS).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    (file,) = (tmp_path / "in").glob("part-*.parquet")
    assert text_envelope.run(spark, f"file://{file}", f"file://{tmp_path}/out", f"file://{tmp_path}/mark", ENVELOPE)["rows"] == 5
    add(spark, f"file://{tmp_path}/none", [])
    assert text_envelope.run(spark, f"file://{tmp_path}/none", f"file://{tmp_path}/out2", f"file://{tmp_path}/mark2", ENVELOPE)["rows"] == 0


@pytest.mark.parametrize("job, name, tables", [("mesh_audit", "lineitem", ("vertices", "faces", "report")), ("text_envelope", "documents", ("points", "coverage"))])
def test_command_line(spark, data, tmp_path, job, name, tables):
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --driver-memory 1g --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    for k in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET"):
        env.pop(k, None)
    done = subprocess.run([sys.executable, str(ROOT / "jobs" / f"{job}.py"), "--input", f"{data}/{name}.parquet", "--output", f"{tmp_path}/out"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    n = spark.read.parquet(f"{data}/{name}.parquet").count()
    assert f"read {n} rows" in done.stderr and "wrote" in done.stderr
    assert all(spark.read.parquet(f"{tmp_path}/out/{t}").count() for t in tables)
