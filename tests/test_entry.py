"""The driver's contract, with and without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_stands_without_the_optional_parts(tmp_path):
    for p in ROOT.iterdir():
        if p.name not in (".git", "corpus_pipeline.py", "voxhull", "tests"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "voxhull").mkdir()
    for p in (ROOT / "voxhull").iterdir():
        if p.name != "llm":
            (tmp_path / "voxhull" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""})
