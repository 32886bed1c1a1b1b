"""Signed distance fields as Columns (P1 to P11, F3), and their ordered smooth union.

A primitive is a dict or a struct column: type, center, radius, axis, half_height, axes, half_extents, major_radius,
r_top, r_bottom, hull, thickness, u_axis, v_axis, normal. ``Shape`` reads its parameters from either, so the same
builders serve literal primitives (no shuffle at all) and a table of primitives.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import Vec, clip, dot, items, lit, norm, sub


class Shape:
    """Parameters of a primitive, from a mapping of values or from a struct column."""

    def __init__(self, source: Mapping | Column):
        self.source = source

    def number(self, name: str) -> Column:
        return F.lit(float(self.source[name])) if isinstance(self.source, Mapping) else self.source[name]

    def vector(self, name: str) -> Vec:
        return lit(self.source[name]) if isinstance(self.source, Mapping) else items(self.source[name])

    def frame(self, name: str = "axes") -> list[Vec]:
        if isinstance(self.source, Mapping):
            return [lit(row) for row in self.source[name]]
        return [items(self.source[name].getItem(i)) for i in range(3)]


def sphere(p: Vec, s: Shape) -> Column:
    return norm(sub(p, s.vector("center"))) - s.number("radius")


def _axial(p: Vec, s: Shape) -> tuple[Column, Column, Vec]:
    """Height along the axis, distance from it, and the offset to the centre."""
    d = sub(p, s.vector("center"))
    h = dot(d, s.vector("axis"))
    return h, F.sqrt(F.greatest(dot(d, d) - h * h, F.lit(0.0))), d


def capsule(p: Vec, s: Shape) -> Column:
    h, _, d = _axial(p, s)
    hh = s.number("half_height")
    t = clip(h, -hh, hh)
    return norm(tuple(x - t * a for x, a in zip(d, s.vector("axis")))) - s.number("radius")


def _capped(a: Column, b: Column) -> Column:
    """Distance to a corner of two half planes: outside norm plus inside maximum."""
    zero = F.lit(0.0)
    pa, pb = F.greatest(a, zero), F.greatest(b, zero)
    return F.sqrt(pa * pa + pb * pb) + F.least(F.greatest(a, b), zero)


def cylinder(p: Vec, s: Shape) -> Column:
    h, rho, _ = _axial(p, s)
    return _capped(rho - s.number("radius"), F.abs(h) - s.number("half_height"))


def box(p: Vec, s: Shape) -> Column:
    d = sub(p, s.vector("center"))
    q = [F.abs(dot(d, axis)) - e for axis, e in zip(s.frame(), s.vector("half_extents"))]
    out = [F.greatest(x, F.lit(0.0)) for x in q]
    return norm(tuple(out)) + F.least(F.greatest(*q), F.lit(0.0))


def torus(p: Vec, s: Shape) -> Column:
    """Also stands for a capped torus, whose cap the field leaves out."""
    h, rho, _ = _axial(p, s)
    ring = rho - s.number("major_radius")
    return F.sqrt(ring * ring + h * h) - s.number("radius")


def cone(p: Vec, s: Shape) -> Column:
    """Distance to the nearest axis point minus the radius there; no caps, so no true distance. r_bottom stands at the axis' minus end."""
    h, _, d = _axial(p, s)
    hh = s.number("half_height")
    t = clip((h + hh) / F.greatest(hh * 2, F.lit(1e-300)), 0, 1)
    off = norm(tuple(x - (t * 2 * hh - hh) * a for x, a in zip(d, s.vector("axis"))))
    return off - (s.number("r_bottom") + (s.number("r_top") - s.number("r_bottom")) * t)


def polygon(u: Column, v: Column, hull: Sequence[Sequence[float]]) -> Column:
    """Signed distance to a closed polygon, concave ones too; negative inside by the even-odd rule."""
    edges = list(zip(hull, [*hull[1:], hull[0]]))
    least, odd = [], F.lit(False)
    for (ax, ay), (bx, by) in edges:
        ex, ey = bx - ax, by - ay
        t = clip(((u - ax) * ex + (v - ay) * ey) / F.lit(max(ex * ex + ey * ey, 1e-300)), 0, 1)
        dx, dy = u - ax - t * ex, v - ay - t * ey
        least.append(dx * dx + dy * dy)
        if ey:
            odd = odd != ((F.lit(ay) > v) != (F.lit(by) > v)) & (u < (v - ay) * (ex / ey) + ax)
    d = F.sqrt(F.least(*least) if len(least) > 1 else least[0])
    return F.when(odd, -d).otherwise(d)


def extruded_polygon(p: Vec, s: Shape) -> Column:
    """A polygon in the plane of u_axis and v_axis, thickness long along normal. Its hull must be a literal."""
    d = sub(p, s.vector("center"))
    flat = polygon(dot(d, s.vector("u_axis")), dot(d, s.vector("v_axis")), s.source["hull"])
    return _capped(flat, F.abs(dot(d, s.vector("normal"))) - s.number("thickness") / 2)


#: P9. Own types are added with register_primitive.
PRIMITIVES: dict[str, Callable[[Vec, Shape], Column]] = {
    "sphere": sphere, "capsule": capsule, "cylinder": cylinder, "box": box, "torus": torus, "capped_torus": torus,
    "cone": cone, "extruded_polygon": extruded_polygon,
}


def register_primitive(name: str, field: Callable[[Vec, Shape], Column]) -> None:
    PRIMITIVES[name] = field


def primitive(p: Vec, source: Mapping) -> Column:
    """P9 for a literal primitive; an unknown type raises ValueError when the plan is built."""
    if source["type"] not in PRIMITIVES:
        raise ValueError(f"unknown primitive: {source['type']}")
    return PRIMITIVES[source["type"]](p, Shape(source))


def primitive_of(p: Vec, struct: Column) -> Column:
    """P9 for a struct column; an unknown type raises when the row is met."""
    out = None
    for name, field in PRIMITIVES.items():
        if name != "extruded_polygon":
            value = field(p, Shape(struct))
            out = F.when(struct["type"] == name, value) if out is None else out.when(struct["type"] == name, value)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown primitive: "), struct["type"])).cast("double"))


def smooth_fold(distances: Column, k: float = 32.0) -> Column:
    """P10 over an array of distances in order: h = clip(.5 + .5 (d2 - d1) k), d = d2 (1 - h) + d1 h - h (1 - h) / k.

    The fold's step is written once whatever the number of primitives; an empty array gives infinity.
    """
    def step(acc: Column, d: Column) -> Column:
        mix = lambda h: d * (1 - h) + acc * h - h * (1 - h) / k
        return F.transform(F.array(clip((d - acc) * (0.5 * k) + 0.5, 0, 1)), mix).getItem(0)

    rest = F.slice(distances, 2, F.greatest(F.size(distances) - 1, F.lit(0)))
    return F.when(F.size(distances) == 0, F.lit(float("inf"))).otherwise(F.aggregate(rest, distances.getItem(0), step))


def smooth_union(p: Vec, primitives: Sequence[Mapping], k: float = 32.0) -> Column:
    """P10 for literal primitives in their order."""
    if not primitives:
        return F.lit(float("inf"))
    return smooth_fold(F.array(*[primitive(p, q) for q in primitives]), k)


def covered(distance: Column, epsilon: float = 0.02) -> Column:
    """a point is covered where the union's surface is near; infinity covers nothing."""
    return F.abs(distance) <= epsilon


def union_over_table(points: DataFrame, primitives: DataFrame, key: str, k: float = 32.0) -> DataFrame:
    """points with ``distance``, the smooth union of a table primitives(ord, prim struct), in the order of ord.

    The primitives are folded into one array row first, a scene of at most some thousands, checked before it is sent.
    """
    n = primitives.count()
    if n > 10_000:
        raise ValueError("a scene of over 10000 primitives is evaluated in parts")
    scene = primitives.agg(F.array_sort(F.collect_list(F.struct("ord", "prim"))).alias("scene"))
    p = tuple(F.col(c) for c in ("x0", "x1", "x2"))
    both = points.join(F.broadcast(scene), F.lit(True))
    return both.withColumn("distance", smooth_fold(F.transform("scene", lambda s: primitive_of(p, s["prim"])), k)).drop("scene")
