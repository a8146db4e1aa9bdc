"""Geometries as one value: struct(type, srid, parts), and column functions on them.

A part is a point, line or polygon: struct(type, rings), a ring an array of struct(x, y). Points have one ring of one
vertex, lines one ring, polygons the exterior and then the holes. Multi-types and collections have several
parts; a collection inside a collection gives its parts to the outer one. Null stands for what is no geometry. These
functions work inside the row and suit geometries that fit there well; ``operators.measures`` and
``operators.spatial`` take vertices as rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import RADIUS, geohash, geohash_bounds, great_circle

RING = "array<struct<x:double,y:double>>"
PART = f"struct<type:string,rings:array<{RING}>>"
GEOMETRY = f"struct<type:string,srid:int,parts:array<{PART}>>"
SIMPLE = ("Point", "LineString", "Polygon")
TYPES = (*SIMPLE, "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection")


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` the value, which is computed and written into the plan once however often ``of`` uses it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def bound(f: Callable[..., Column]) -> Callable[..., Column]:
    """A function whose first column is bound by ``let``."""

    @wraps(f)
    def call(first: Column, *rest, **more) -> Column:
        return let(first, lambda v: f(v, *rest, **more))

    return call


def both(f: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    """The same for a function of two geometries."""

    @wraps(f)
    def call(a: Column, b: Column) -> Column:
        return let(a, lambda v: let(b, lambda w: f(v, w)))

    return call


def vertex(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def part(kind: Column | str, rings: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("type"), rings.cast(f"array<{RING}>").alias("rings"))


def no_parts() -> Column:
    return F.array().cast(f"array<{PART}>")


def sound(parts: Column) -> Column:
    """Whether every part can stand: no missing coordinate, and no line of a single vertex."""
    bad = lambda p: (p["type"] == "LineString") & (F.size(p["rings"][0]) == 1) | F.exists(p["rings"], lambda r: F.exists(r, lambda v: v["x"].isNull() | v["y"].isNull()))
    return F.coalesce(~F.exists(parts, bad), F.lit(False))


def geometry(kind: Column, parts: Column, srid: Column | None = None) -> Column:
    """A geometry of known type; null if its parts cannot stand, and for a point without a vertex."""
    srid = F.lit(None).cast("int") if srid is None else srid.cast("int")

    def made(g: Column) -> Column:
        return F.when(g["type"].isNotNull() & sound(g["parts"]) & ~((g["type"] == "Point") & (F.size(g["parts"]) == 0)), g)

    return let(F.struct(kind.alias("type"), srid.alias("srid"), parts.alias("parts")), made)


def lowest_type(parts: Column) -> Column:
    """One part is itself, several of one type are its multi-type, others a collection."""
    first = parts[0]["type"]
    same = F.size(F.array_distinct(F.transform(parts, lambda p: p["type"]))) == 1
    return F.when(F.size(parts) == 1, first).when(same, F.concat(F.lit("Multi"), first)).otherwise("GeometryCollection")


def reduced(parts: Column, srid: Column | None = None) -> Column:
    """The geometry of the lowest common type of the parts; null if there are none."""
    return let(parts, lambda p: F.when(F.size(p) > 0, geometry(lowest_type(p), p, srid)))


def point(x: Column, y: Column, srid: Column | None = None) -> Column:
    return geometry(F.lit("Point"), F.array(part("Point", F.array(F.array(vertex(x, y))))), srid)


def line(vertices: Column, srid: Column | None = None) -> Column:
    return geometry(F.lit("LineString"), F.array(part("LineString", F.array(vertices))), srid)


def polygon(rings: Column, srid: Column | None = None) -> Column:
    return geometry(F.lit("Polygon"), F.array(part("Polygon", rings)), srid)


# accessors


def vertices(g: Column) -> Column:
    return F.flatten(F.flatten(F.transform(g["parts"], lambda p: p["rings"])))


@bound
def is_empty(g: Column) -> Column:
    return F.size(vertices(g)) == 0


@bound
def with_srid(g: Column, srid: Column) -> Column:
    return F.when(g.isNotNull(), F.struct(g["type"].alias("type"), srid.cast("int").alias("srid"), g["parts"].alias("parts")))


@bound
def x(g: Column) -> Column:
    return F.when(g["type"] == "Point", F.get(vertices(g), F.lit(0))["x"])


@bound
def y(g: Column) -> Column:
    return F.when(g["type"] == "Point", F.get(vertices(g), F.lit(0))["y"])


@bound
def num_geometries(g: Column) -> Column:
    """Vertices of a line, rings of a polygon, else parts."""
    first = F.get(g["parts"], F.lit(0))["rings"]
    return F.when(g["type"] == "LineString", F.coalesce(F.size(F.get(first, F.lit(0))), F.lit(0))).when(g["type"] == "Polygon", F.coalesce(F.size(first), F.lit(0))).otherwise(F.size(g["parts"]))


def num_points(g: Column) -> Column:
    return F.size(vertices(g))


@bound
def geometry_n(g: Column, n: Column) -> Column:
    """The n-th part (from 1) as a geometry; null out of range."""
    one = F.get(g["parts"], n.cast("int") - 1)
    return F.when(one.isNotNull(), geometry(one["type"], F.array(one), g["srid"]))


def _rings_as_lines(parts: Column) -> Column:
    return F.flatten(F.transform(parts, lambda p: F.when(p["type"] == "Polygon", F.transform(p["rings"], lambda r: part("LineString", F.array(r)))).otherwise(F.array(p))))


@bound
def boundary(g: Column) -> Column:
    """Points and lines are their own; polygons and multi-types give what their rings reduce to; collections null."""
    return F.when(g["type"].isin("Point", "LineString"), g).when(g["type"] != "GeometryCollection", reduced(_rings_as_lines(g["parts"]), g["srid"]))


@bound
def ring(g: Column, n: Column) -> Column:
    """Ring n of a polygon as a line: 0 the exterior, then the holes; null out of range or for other types."""
    found = F.get(F.get(g["parts"], F.lit(0))["rings"], n.cast("int"))
    return F.when((g["type"] == "Polygon") & found.isNotNull(), line(found, g["srid"]))


@bound
def exterior_ring(g: Column) -> Column:
    return ring(g, F.lit(0))


@bound
def num_interior_rings(g: Column) -> Column:
    return F.when(g["type"] == "Polygon", F.greatest(F.size(F.get(g["parts"], F.lit(0))["rings"]) - 1, F.lit(0)))


def dimension(g: Column) -> Column:
    """0, 1 or 2: the largest of the parts."""
    rank = F.transform(g["parts"], lambda p: F.when(p["type"] == "Polygon", 2).when(p["type"] == "LineString", 1).otherwise(0))
    return F.coalesce(F.array_max(rank), F.lit(0))


# measures


def _pairs(r: Column) -> Column:
    """Consecutive vertices of a ring: struct(a, b)."""
    n = F.greatest(F.size(r) - 1, F.lit(0))
    return F.zip_with(F.slice(r, F.lit(1), n), F.slice(r, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


@bound
def _line_sum(g: Column, of) -> Column:
    lines = F.filter(g["parts"], lambda p: p["type"] == "LineString")
    total = _sum(F.transform(lines, lambda p: _sum(F.transform(_pairs(p["rings"][0]), lambda s: of(s["a"], s["b"])))))
    return F.when(g["type"] == "Polygon", F.lit(None).cast("double")).otherwise(total)


@bound
def length(g: Column) -> Column:
    """Planar length; null for a polygon, the sum of the lines for what has parts, 0 for points."""
    return _line_sum(g, lambda a, b: F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"])))


@bound
def metres(g: Column, radius: float = RADIUS) -> Column:
    return _line_sum(g, lambda a, b: great_circle(a["x"], a["y"], b["x"], b["y"], radius))


def _shoelace(r: Column) -> Column:
    return _sum(F.transform(_pairs(r), lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"])) / 2


@bound
def area(g: Column, exterior_only: bool = False, signed: bool = False) -> Column:
    """Sum over the polygons of their exterior's area less that of the holes."""
    value = lambda r: _shoelace(r) if signed else F.abs(_shoelace(r))
    outer = lambda p: value(p["rings"][0])
    holes = lambda p: _sum(F.transform(F.slice(p["rings"], F.lit(2), F.greatest(F.size(p["rings"]) - 1, F.lit(0))), lambda r: F.abs(_shoelace(r))))
    return _sum(F.transform(F.filter(g["parts"], lambda p: p["type"] == "Polygon"), lambda p: outer(p) if exterior_only or signed else outer(p) - holes(p)))


@bound
def bounds(g: Column) -> Column:
    """struct(minx, miny, maxx, maxy); null for an empty geometry."""

    def box(v: Column) -> Column:
        xs, ys = F.transform(v, lambda p: p["x"]), F.transform(v, lambda p: p["y"])
        return F.when(F.size(v) > 0, F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy")))

    return let(vertices(g), box)


@bound
def envelope(g: Column) -> Column:
    """The bounds as a polygon, from the lower right corner on."""

    def box(b: Column) -> Column:
        corner = lambda a, c: vertex(b[a], b[c])
        r = F.array(corner("maxx", "miny"), corner("maxx", "maxy"), corner("minx", "maxy"), corner("minx", "miny"), corner("maxx", "miny"))
        return F.when(b.isNotNull(), polygon(F.array(r), g["srid"]))

    return let(bounds(g), box)


@bound
def _ring_centroid(r: Column) -> Column:
    moment = lambda k: _sum(F.transform(_pairs(r), lambda s: (s["a"][k] + s["b"][k]) * (s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"])))
    return let(_shoelace(r) * 6, lambda six: F.when(six == 0, r[0]).otherwise(vertex(moment("x") / six, moment("y") / six)))


@bound
def centroid(g: Column) -> Column:
    """struct(x, y): of a polygon that of its exterior ring, of a point itself, else that of the bounds."""
    middle = let(bounds(g), lambda b: vertex((b["minx"] + b["maxx"]) / 2, (b["miny"] + b["maxy"]) / 2))
    own = F.when(g["type"] == "Point", vertices(g)[0]).when(g["type"] == "Polygon", _ring_centroid(g["parts"][0]["rings"][0])).otherwise(middle)
    return F.when(~is_empty(g), own)


@bound
def is_closed(g: Column) -> Column:
    """Whether every line of the geometry ends where it starts; false without a line."""
    lines = F.filter(g["parts"], lambda p: p["type"] == "LineString")
    ends = lambda p: F.get(p["rings"][0], F.lit(0)) == F.element_at(p["rings"][0], -1)
    return F.when(F.size(lines) > 0, F.forall(lines, ends)).otherwise(False)


@both
def same_vertices(a: Column, b: Column) -> Column:
    """Equality as multisets of vertices, whatever their order."""
    return F.array_sort(vertices(a)) == F.array_sort(vertices(b))


@bound
def invalid_because(g: Column) -> Column:
    """Reasons against the rings of a geometry's polygons: under four vertices, not closed, not finite; none if sound."""
    rings = F.flatten(F.transform(F.filter(g["parts"], lambda p: p["type"] == "Polygon"), lambda p: p["rings"]))
    finite = lambda v: ~F.isnan(v["x"]) & ~F.isnan(v["y"]) & (F.abs(v["x"]) < float("inf")) & (F.abs(v["y"]) < float("inf"))
    few = F.exists(rings, lambda r: F.size(r) < 4)
    loose = F.exists(rings, lambda r: F.get(r, F.lit(0)) != F.try_element_at(r, F.lit(-1)))
    odd = F.exists(vertices(g), lambda v: ~finite(v))
    return F.array_compact(F.array(F.when(few, "few vertices"), F.when(loose, "not closed"), F.when(odd, "not finite")))


@both
def hausdorff(a: Column, b: Column) -> Column:
    """Discrete Hausdorff distance of the vertex sets."""
    apart = lambda p, q: F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]))
    one_way = lambda u, v: F.array_max(F.transform(u, lambda p: F.array_min(F.transform(v, lambda q: apart(p, q)))))
    return F.greatest(one_way(vertices(a), vertices(b)), one_way(vertices(b), vertices(a)))


@bound
def project(g: Column, px: Column, py: Column, normalised: bool = False) -> Column:
    """Distance along a line of the place nearest to (px, py), the first of equals; of its length with ``normalised``."""

    def step(acc: Column, s: Column) -> Column:
        dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
        square = dx * dx + dy * dy
        t = F.when(square == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - s["a"]["x"]) * dx + (py - s["a"]["y"]) * dy) / square)))
        ex, ey = s["a"]["x"] + t * dx - px, s["a"]["y"] + t * dy - py
        away, size = ex * ex + ey * ey, F.sqrt(square)
        nearer = away < acc["best"]
        return F.struct((acc["run"] + size).alias("run"), F.when(nearer, away).otherwise(acc["best"]).alias("best"), F.when(nearer, acc["run"] + t * size).otherwise(acc["at"]).alias("at"))

    start = F.struct(F.lit(0.0).alias("run"), F.lit(float("inf")).alias("best"), F.lit(0.0).alias("at"))
    found = F.aggregate(_pairs(g["parts"][0]["rings"][0]), start, step, lambda acc: F.try_divide(acc["at"], acc["run"]) if normalised else acc["at"])
    return F.when(g["type"] == "LineString", found)


# points and polygons


def _crossings(rings: Column, px: Column, py: Column) -> Column:
    """x of the edges of all rings that a horizontal line at py meets."""
    edges = F.flatten(F.transform(rings, _pairs))
    met = F.filter(edges, lambda s: (s["a"]["y"] < py) & (s["b"]["y"] >= py) | (s["b"]["y"] < py) & (s["a"]["y"] >= py))
    return F.transform(met, lambda s: s["a"]["x"] + (py - s["a"]["y"]) / (s["b"]["y"] - s["a"]["y"]) * (s["b"]["x"] - s["a"]["x"]))


@bound
def contains_point(g: Column, px: Column, py: Column) -> Column:
    """Whether a polygon of the geometry holds the point, by the crossing-number rule."""
    polygons = F.filter(g["parts"], lambda p: p["type"] == "Polygon")
    return F.exists(polygons, lambda p: F.size(F.filter(_crossings(p["rings"], px, py), lambda c: c < px)) % 2 == 1)


@bound
def point_on_surface(g: Column) -> Column:
    """struct(x, y) inside a polygon: its centroid if that is inside, else the middle of the widest span at mid height."""

    def widest(cuts: Column, mid: Column, c: Column) -> Column:
        spans = F.transform(F.sequence(F.lit(0), F.floor(F.size(cuts) / 2).cast("int") - 1), lambda i: F.struct((F.get(cuts, i * 2 + 1) - F.get(cuts, i * 2)).alias("w"), (-i).alias("i"), ((F.get(cuts, i * 2 + 1) + F.get(cuts, i * 2)) / 2).alias("x")))
        return F.when(F.size(cuts) >= 2, vertex(F.array_max(spans)["x"], mid)).otherwise(c)

    def chosen(c: Column) -> Column:
        inside = let(bounds(g), lambda b: let((b["miny"] + b["maxy"]) / 2, lambda mid: let(F.array_sort(_crossings(g["parts"][0]["rings"], F.lit(0.0), mid)), lambda cuts: widest(cuts, mid, c))))
        return F.when(contains_point(g, c["x"], c["y"]), c).otherwise(inside)

    return F.when((g["type"] == "Polygon") & ~is_empty(g), let(centroid(g), chosen))


@both
def meeting(a: Column, b: Column) -> Column:
    """How two segments (struct(a, b)) meet, ends included: struct(status, x, y).

    Status is Intersection with the point, Coincident or Parallel for parallel ones, or null.
    """
    dx, dy, ex, ey = a["b"]["x"] - a["a"]["x"], a["b"]["y"] - a["a"]["y"], b["b"]["x"] - b["a"]["x"], b["b"]["y"] - b["a"]["y"]
    fx, fy = a["a"]["x"] - b["a"]["x"], a["a"]["y"] - b["a"]["y"]
    det, ta, tb = ey * dx - ex * dy, ex * fy - ey * fx, dx * fy - dy * fx
    u, v = F.try_divide(ta, det), F.try_divide(tb, det)
    hit = (det != 0) & u.between(0, 1) & v.between(0, 1)
    status = F.when(hit, "Intersection").when((det == 0) & ((ta == 0) | (tb == 0)), "Coincident").when(det == 0, "Parallel")
    return F.struct(status.alias("status"), F.when(hit, a["a"]["x"] + u * dx).alias("x"), F.when(hit, a["a"]["y"] + u * dy).alias("y"))


def edges(g: Column) -> Column:
    """All segments of lines and rings."""
    return F.flatten(F.transform(F.flatten(F.transform(g["parts"], lambda p: p["rings"])), _pairs))


def _side(a: Column, b: Column, p: Column) -> Column:
    return F.signum((b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"]))


def _on(s: Column, p: Column) -> Column:
    return (_side(s["a"], s["b"], p) == 0) & p["x"].between(F.least(s["a"]["x"], s["b"]["x"]), F.greatest(s["a"]["x"], s["b"]["x"])) & p["y"].between(F.least(s["a"]["y"], s["b"]["y"]), F.greatest(s["a"]["y"], s["b"]["y"]))


@both
def _touch(s: Column, t: Column) -> Column:
    """Segments with a point in common."""
    cross = (_side(s["a"], s["b"], t["a"]) * _side(s["a"], s["b"], t["b"]) < 0) & (_side(t["a"], t["b"], s["a"]) * _side(t["a"], t["b"], s["b"]) < 0)
    return cross | _on(s, t["a"]) | _on(s, t["b"]) | _on(t, s["a"]) | _on(t, s["b"])


@both
def _cross(s: Column, t: Column) -> Column:
    """Segments that cross inside both."""
    return (_side(s["a"], s["b"], t["a"]) * _side(s["a"], s["b"], t["b"]) < 0) & (_side(t["a"], t["b"], s["a"]) * _side(t["a"], t["b"], s["b"]) < 0)


def _any_edges(a: Column, b: Column, test) -> Column:
    return F.exists(edges(a), lambda s: F.exists(edges(b), lambda t: test(s, t)))


def _on_edges(g: Column, p: Column) -> Column:
    return F.exists(edges(g), lambda s: _on(s, p))


@bound
def _inside(g: Column, p: Column) -> Column:
    """Strictly inside a polygon of the geometry."""
    return contains_point(g, p["x"], p["y"]) & ~_on_edges(g, p)


@bound
def _middles(g: Column) -> Column:
    return F.transform(edges(g), lambda s: vertex((s["a"]["x"] + s["b"]["x"]) / 2, (s["a"]["y"] + s["b"]["y"]) / 2))


@both
def intersects(a: Column, b: Column) -> Column:
    """Lines and polygons with a point in common."""
    held = F.exists(vertices(b), lambda p: contains_point(a, p["x"], p["y"])) | F.exists(vertices(a), lambda p: contains_point(b, p["x"], p["y"]))
    return _any_edges(a, b, _touch) | held


@both
def disjoint(a: Column, b: Column) -> Column:
    return ~intersects(a, b)


@both
def interiors_meet(a: Column, b: Column) -> Column:
    """Whether the interiors of two polygons, or of a line and a polygon, have a point in common, as far as crossings of
    edges, vertices and middles of edges show it."""
    seen = F.exists(F.concat(vertices(b), _middles(b)), lambda p: _inside(a, p)) | F.exists(F.concat(vertices(a), _middles(a)), lambda p: _inside(b, p))
    return _any_edges(a, b, _cross) | seen | ((dimension(a) == 2) & (dimension(b) == 2) & same_vertices(a, b))


@both
def touches(a: Column, b: Column) -> Column:
    """Points in common, but none of both interiors."""
    return intersects(a, b) & ~interiors_meet(a, b)


@both
def within(a: Column, b: Column) -> Column:
    """Whether no vertex and no middle of an edge of a is outside of b, and no edges cross."""
    covered = F.forall(F.concat(vertices(a), _middles(a)), lambda p: contains_point(b, p["x"], p["y"]) | _on_edges(b, p))
    return covered & ~_any_edges(a, b, _cross)


@both
def overlaps(a: Column, b: Column) -> Column:
    """Polygons whose interiors meet and of which neither is within the other."""
    return (dimension(a) == dimension(b)) & interiors_meet(a, b) & ~within(a, b) & ~within(b, a)


# geohash


@bound
def geohash_of(g: Column, length: int = 12) -> Column:
    """Geohash of a point; of other geometries the longest common start of those of the bounds' corners."""

    def shared(codes: Column) -> Column:
        same = F.filter(F.sequence(F.lit(0), F.lit(length)), lambda n: F.size(F.array_distinct(F.transform(codes, lambda c: F.substr(c, F.lit(1), n)))) == 1)
        return F.substr(codes[0], F.lit(1), F.array_max(same))

    corners = lambda b: F.array(*[vertex(b[i], b[j]) for i in ("minx", "maxx") for j in ("miny", "maxy")])
    return let(bounds(g), lambda b: F.when(b.isNotNull(), let(F.transform(corners(b), lambda v: geohash(v["x"], v["y"], length)), shared)))


@bound
def geohash_centre(code: Column) -> Column:
    """struct(x, y): the middle of a cell, rounded to as many decimals as its size tells apart."""
    b = geohash_bounds(code)
    digits = lambda lo, hi: F.greatest(F.lit(1), -F.round(F.log10((hi - lo) / 2)).cast("int")) - 1
    near = lambda lo, hi: F.round((lo + hi) / 2 * F.pow(F.lit(10.0), digits(lo, hi))) / F.pow(F.lit(10.0), digits(lo, hi))
    return let(b, lambda c: vertex(near(c["x0"], c["x1"]), near(c["y0"], c["y1"])))


@bound
def geohash_polygon(code: Column) -> Column:
    """The cell as a polygon from the north-west corner clockwise."""
    corners = lambda c: F.array(vertex(c["x0"], c["y1"]), vertex(c["x1"], c["y1"]), vertex(c["x1"], c["y0"]), vertex(c["x0"], c["y0"]), vertex(c["x0"], c["y1"]))
    return polygon(F.array(let(geohash_bounds(code), corners)))
