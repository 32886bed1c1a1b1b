"""Tables that grow with a mesh are joined by shuffles, however small Spark takes their files to be: a broadcast passes through the driver."""

import pytest

from voxhull.operators import graphs, mesh, outline, rays, repair, sampling, segment, slabs, storage
from voxhull.operators.storage import stored
from voxhull.sources import meshes


@pytest.fixture(scope="module")
def torus(spark):
    v, f = meshes.torus(spark, around=12, across=6)
    return stored(v), stored(f)


def broadcasts(df) -> int:
    """Of the plan as it stands before the run, when Spark knows files' sizes alone; not of how its cached tables were made."""
    n, cached = 0, None
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        depth = len(line) - len(line.lstrip(" :+-"))
        if cached is None or depth <= cached:
            cached = depth if "InMemoryRelation" in line else None
            n += "BroadcastExchange" in line
    return n



def test_corners_edges_and_curvature_by_shuffles(torus):
    v, f = torus
    assert broadcasts(mesh.face_geometry(v, f)) == 0 and broadcasts(mesh.edges(v, f)) == 0
    assert broadcasts(segment.vertex_curvature(stored(mesh.face_geometry(v, f)), v)) == 0
    assert mesh.face_geometry(v, f).count() == 144 and mesh.edges(v, f).count() == 216


def test_bends_by_shuffles(torus):
    v, f = torus
    g = stored(mesh.face_geometry(v, f))
    bend = mesh.dihedral_bend(g, stored(mesh.face_adjacency(f)))
    assert broadcasts(bend) == 0 and bend.count() == 216


def test_summaries_of_regions_broadcast_one_row_alone(torus):
    v, f = torus
    g, regions = stored(mesh.face_geometry(v, f)), f.selectExpr("fid", "fid div 24 AS region")
    s = mesh.region_summary(g, regions)
    assert broadcasts(s) == 1 and s.count() == 6  # the sum of all area
    assert broadcasts(mesh.region_edge_length(v, f, regions)) == 0
    assert broadcasts(mesh.patch_faces(f, v.selectExpr("vid", "vid div 24 AS pid"))) == 0


def test_surface_samples_and_normals_by_shuffles(torus):
    v, f = torus
    g = mesh.face_geometry(v, f)
    assert broadcasts(mesh.vertex_normals(g)) == 0
    s = sampling.sample_surface(g, 50, vertex_normals=mesh.vertex_normals(g))
    assert s.count() == 50
    assert s.selectExpr("max(abs(n0 * n0 + n1 * n1 + n2 * n2 - 1)) < 1e-9").first()[0]


@pytest.fixture
def seen(monkeypatch):
    """Broadcasts of all that is stored on the way, where no table counts as few."""
    found = []

    def record(df):
        found.append(broadcasts(df))
        return stored(df)

    for module in (graphs, outline, rays, repair, segment):
        monkeypatch.setattr(module, "stored", record)
    monkeypatch.setattr(storage, "FEW", -1, raising=False)
    return found


@pytest.fixture(scope="module")
def crates(spark):
    rows = spark.range(30).selectExpr("'crates' AS mesh_id", "id AS box", "1.0D + id / 100 AS e0", "0.6D AS e1", "0.4D AS e2", "id * 5.0D AS o0", "0.0D AS o1", "0.0D AS o2")
    return meshes.boxes(stored(rows))


def test_regions_and_rays_by_shuffles(spark, crates, seen):
    v, f = crates
    g = stored(mesh.face_geometry(v, f))
    regions = stored(segment.grow_regions(g, mesh.face_adjacency(f)).selectExpr("fid", "region div 2 AS region"))
    assert sum(seen) == 1 and regions.select("region").distinct().count() == 180  # sizes of the sets that are not small
    seen.clear()
    rows = g.where("fid % 2 = 0").selectExpr("fid AS id", *[f"g{i} - 0.01D * n{i} AS x{i}" for i in range(3)], *[f"-n{i} AS d{i}" for i in range(3)])
    found = rays.nearest_hits(stored(rows), g)
    assert sum(seen) == 0 and found.selectExpr("count(*) = 180 AND min(t) BETWEEN 0.389 AND 0.391 AND max(t) BETWEEN 1.279 AND 1.281").first()[0]


def test_slabs_by_shuffles(crates, seen):
    v, f = crates
    s = slabs.slabs(v, f, least_share=0.0)
    got = s.selectExpr("count(*) AS n", "max(size(hull)) AS most", "max(abs(area - hull_area)) AS off").first()
    assert sum(seen) == 1 and (got.n, got.most) == (180, 4) and got.off < 1e-9  # sizes of the sets that are not small
