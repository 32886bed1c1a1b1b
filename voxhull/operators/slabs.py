"""Flat slabs of a mesh (step 0 of the primitive decomposition: G4, F5, A11 to A13, P27, G11, G12, D13), and hulls of few points on one machine."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, named, plane_basis, sub, vec
from . import mesh, outline, rays, segment
from .storage import sent, shuffled


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners counterclockwise, by the monotone chain; points on a side are left out."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def chain(rows):
        out: list[np.ndarray] = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def triangulate(points: np.ndarray) -> np.ndarray:
    """Delaunay triangles (rows of three positions): each point is put in by removing the triangles whose circle holds it."""
    n, lo, hi = len(points), points.min(0), points.max(0)
    mid, far = (lo + hi) / 2, 20 * max(1e-9, float((hi - lo).max()))
    p = np.vstack([points, mid + [-far, -far], mid + [far, -far], mid + [0, far]])

    def circle(t):
        a, b, c = p[t[0]], p[t[1]], p[t[2]]
        d = 2 * (a[0] * (b[1] - c[1]) + b[0] * (c[1] - a[1]) + c[0] * (a[1] - b[1]))
        if abs(d) < 1e-300:
            return (0.0, 0.0, math.inf)
        sa, sb, sc = a @ a, b @ b, c @ c
        x = (sa * (b[1] - c[1]) + sb * (c[1] - a[1]) + sc * (a[1] - b[1])) / d
        y = (sa * (c[0] - b[0]) + sb * (a[0] - c[0]) + sc * (b[0] - a[0])) / d
        return (x, y, (a[0] - x) ** 2 + (a[1] - y) ** 2)

    tris = {(n, n + 1, n + 2): circle((n, n + 1, n + 2))}
    for i in range(n):
        bad = [t for t, (x, y, r) in tris.items() if (p[i][0] - x) ** 2 + (p[i][1] - y) ** 2 < r * (1 + 1e-12)]
        sides: dict[tuple[int, int], int] = {}
        for t in bad:
            del tris[t]
            for a, b in ((0, 1), (1, 2), (2, 0)):
                k = (min(t[a], t[b]), max(t[a], t[b]))
                sides[k] = sides.get(k, 0) + 1
        for (a, b), m in sides.items():
            if m == 1:
                tris[a, b, i] = circle((a, b, i))
    return np.array([t for t in tris if max(t) < n], int).reshape(-1, 3)


def concave_hull(points: np.ndarray, alpha: float) -> np.ndarray:
    """The largest outline of the Delaunay triangles whose circumradius is under 1 / alpha; convex where none is or alpha is 0."""
    p = np.unique(np.round(points, 12), axis=0)
    if alpha <= 0 or len(p) < 4:
        return convex_hull(p)
    sides: dict[tuple[int, int], int] = {}
    for t in triangulate(p):
        a, b, c = p[t[0]], p[t[1]], p[t[2]]
        area = abs((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])) / 2
        if area < 1e-15 or np.linalg.norm(a - b) * np.linalg.norm(b - c) * np.linalg.norm(c - a) / (4 * area) >= 1 / alpha:
            continue
        for i, j in ((0, 1), (1, 2), (2, 0)):
            k = (min(t[i], t[j]), max(t[i], t[j]))
            sides[k] = sides.get(k, 0) + 1
    near: dict[int, list[int]] = {}
    for (a, b), m in sides.items():
        if m == 1:
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
    loops = []
    while any(near.values()):
        start = at = min(k for k, v in near.items() if v)
        loop = [start]
        while near[at]:
            to = near[at].pop()
            near[to].remove(at)
            at = to
            if at == start:
                break
            loop.append(at)
        loops.append(p[loop])
    best = max(loops, key=lambda q: abs(signed_area(q)), default=None)
    if best is None or len(best) < 3:
        return convex_hull(p)
    return best if signed_area(best) > 0 else best[::-1]


def signed_area(q: np.ndarray) -> float:
    nxt = np.roll(q, -1, axis=0)
    return float((q[:, 0] * nxt[:, 1] - q[:, 1] * nxt[:, 0]).sum() / 2)


def slabs(vertices: DataFrame, faces: DataFrame, least_share: float = 0.01, flat: float = 0.998) -> DataFrame:
    """Region, area, centre c0..c2, normal n0..n2, axes u0..u2 and v0..v2, hull in (u, v) about the centre, thickness.

    Regions of faces with one normal (G4) of at least a share of all area (F5); the plane's axes (P27); the concave hull of the
    region's corners with alpha = 1 / (2 mean edge) (G12, A13); the distance to the next face (G11). Without a next face a region is no slab.
    """
    geometry = mesh.face_geometry(vertices, faces).persist()
    regions = segment.grow_regions(geometry, mesh.face_adjacency(faces), flat).select("fid", "region").persist()
    kept = mesh.region_summary(geometry, regions).where(F.col("share") >= least_share)
    corner = geometry.join(shuffled(regions), "fid").select("region", F.explode(F.array(*[F.struct(F.col(f"v{k}").alias("vid"), *[F.col(f"{p}{i}").alias(f"x{i}") for i in range(3)]) for k, p in enumerate("abc")])).alias("s")).select("region", "s.*").distinct()
    centre = corner.groupBy("region").agg(*[F.avg(f"x{i}").alias(f"c{i}") for i in range(3)])
    n = vec("n0", "n1", "n2")
    u, v = plane_basis(n)
    frame = kept.join(centre, "region").select("region", "area", "c0", "c1", "c2", "n0", "n1", "n2", *named(u, ("u0", "u1", "u2")), *named(v, ("v0", "v1", "v2"))).persist()
    edge = mesh.region_edge_length(vertices, faces, regions).select("region", "alpha")
    d = sub(vec("x0", "x1", "x2"), vec("c0", "c1", "c2"))
    flat_points = corner.join(frame, "region").join(edge, "region").select("region", F.col("vid").alias("id"), "alpha", dot(d, vec("u0", "u1", "u2")).alias("u"), dot(d, vec("v0", "v1", "v2")).alias("v"))

    hulls = outline.widened(flat_points.withColumn("radius", 1 / F.col("alpha")))
    # rays start a little off the centre, which may lie on the sides of triangles
    start = frame.select("region", *[(F.col(f"c{i}") + F.col(f"u{i}") * 1.3e-3 + F.col(f"v{i}") * 0.7e-3).alias(f"c{i}") for i in range(3)], "n0", "n1", "n2")
    return frame.join(sent(hulls, hulls.count()), "region").join(shuffled(rays.thickness(start, geometry)), "region")


def primitive(row) -> dict:
    """A slab's row as a literal primitive for the fields."""
    three = lambda p: tuple(row[f"{p}{i}"] for i in range(3))
    return {"type": "extruded_polygon", "center": three("c"), "normal": three("n"), "u_axis": three("u"), "v_axis": three("v"), "hull": [(q["u"], q["v"]) for q in row["hull"]], "thickness": row["thickness"]}
