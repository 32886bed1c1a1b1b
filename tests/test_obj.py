"""OBJ files in many splits against reading them line by line."""

import random

import pytest
from voxhull.sources import meshes


def plain(text):
    v, f, line = [], [], 0
    for words in (x.split() for x in text.splitlines()):
        if len(words) > 3 and words[0] == "v":
            v.append(tuple(map(float, words[1:4])))
        elif len(words) > 3 and words[0] == "f":
            ids = [int(w.split("/")[0]) for w in words[1:]]
            ids = [len(v) + i if i < 0 else i - 1 for i in ids]
            f += [((line << 20) + k, ids[0], ids[k], ids[k + 1]) for k in range(1, len(ids) - 1)]
            line += 1
    return v, f


def write(rnd, n, negative):
    out, v = ["# a mesh", "o thing", ""], 0
    for _ in range(n):
        if v < 5 or rnd.random() < 0.5:
            v += 1
            out.append(f"{rnd.choice(['', '  '])}v {rnd.random():.6f}\t{rnd.random():.4f} {rnd.randint(-3, 3)}" + rnd.choice(["", " 1.0", "  "]))
        elif rnd.random() < 0.1:
            out.append(rnd.choice(["vn 0 0 1", "vt 0.5 0.5 0", "# v 1 2 3", "f 1 2", "s off"]))
        else:
            ids = [rnd.randint(1, v) for _ in range(rnd.choice([3, 3, 4, 5]))]
            if negative and rnd.random() < 0.3:
                ids = [i - v - 1 for i in ids]
            out.append("f " + " ".join(str(i) + rnd.choice(["", "/7", "//3", "/1/2"]) for i in ids))
    return rnd.choice(["\n", "\r\n"]).join(out) + "\n"


@pytest.mark.parametrize("split", [None, "1500b"])
def test_splits_do_not_change_the_mesh(spark, tmp_path, split):
    rnd = random.Random(31)
    texts = {f"m{k}.obj": write(rnd, n, k % 2) for k, n in enumerate((400, 900, 5, 300, 700))} | {"empty.obj": ""}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        if split:
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            spark.conf.set("spark.sql.files.openCostInBytes", "10b")
            assert spark.read.text(f"file://{tmp_path}").select("_metadata.file_path", "_metadata.file_block_start").distinct().count() > 20
        v, f = meshes.read_obj(spark, f"file://{tmp_path}")
        got_v, got_f = v.collect(), f.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, text in texts.items():
        want_v, want_f = plain(text)
        assert sorted((r.vid, r.x0, r.x1, r.x2) for r in got_v if r.mesh_id == name) == [(i, *x) for i, x in enumerate(want_v)]
        assert sorted((r.fid, r.v0, r.v1, r.v2) for r in got_f if r.mesh_id == name) == sorted(want_f)
