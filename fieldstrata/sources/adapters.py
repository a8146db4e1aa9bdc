"""Geometry formats: readers and writers between texts or bytes and geometry values, and a register of them.

Readers give null for input that is no geometry of the format, so that such rows can go to a reject table; writers
give null for null. A third dimension is read over and dropped. Formats of which a document holds several geometries
give the lowest common type of all of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import geometry as g
from ..functions import shapes
from ..functions.geo import number_text as n

_FLAT, _RING = r"\([^()]*\)", r"\([^()]*\)"
_NEST2 = rf"\((?:[^()]|{_FLAT})*\)"
_NEST3 = rf"\((?:[^()]|{_NEST2})*\)"
_COMPONENT = rf"(?i)(?:MULTI)?(?:POINT|LINESTRING|POLYGON)\s*(?:ZM|Z|M)?\s*(?:EMPTY|{_NEST3})"


def _names(*keys: str) -> Column:
    return F.create_map(*[F.lit(x) for k in keys for x in (k.lower(), k)])


def _vertices(text: Column, between: str, within: str, swapped: bool = False) -> Column:
    """Vertices of a list of tuples; what is no number gives a null coordinate."""
    tuples = F.filter(F.split(F.trim(text), between), lambda t: F.trim(t) != "")
    number = lambda t, i: F.get(F.split(F.trim(t), within), F.lit(i)).try_cast("double")
    return F.transform(tuples, lambda t: g.vertex(number(t, 1), number(t, 0)) if swapped else g.vertex(number(t, 0), number(t, 1)))


# WKT and EWKT


@g.bound
def _wkt_parts(component: Column) -> Column:
    """Parts of a text of one of the six types that hold no others."""
    kind = F.lower(F.regexp_extract(component, r"^([A-Za-z]+)", 1))
    empty = component.rlike(r"(?i)EMPTY\s*$")
    body = F.regexp_extract(component, r"(?s)^[^(]*\((.*)\)\s*$", 1)
    rings = lambda t: F.transform(F.regexp_extract_all(t, F.lit(r"\(([^()]*)\)"), F.lit(1)), lambda r: _vertices(r, ",", r"\s+"))
    flat = F.regexp_replace(body, r"[()]", " ")
    made = (
        F.when(kind == "point", F.array(g.part("Point", F.array(_vertices(flat, ",", r"\s+")))))
        .when(kind == "linestring", F.array(g.part("LineString", F.array(_vertices(flat, ",", r"\s+")))))
        .when(kind == "polygon", F.array(g.part("Polygon", rings(body))))
        .when(kind == "multipoint", F.transform(_vertices(flat, ",", r"\s+"), lambda v: g.part("Point", F.array(F.array(v)))))
        .when(kind == "multilinestring", F.transform(rings(body), lambda r: g.part("LineString", F.array(r))))
        .when(kind == "multipolygon", F.transform(F.regexp_extract_all(body, F.lit(rf"\(\s*{_RING}(?:\s*,\s*{_RING})*\s*\)"), F.lit(0)), lambda p: g.part("Polygon", rings(p))))
    )
    return F.when(empty, g.no_parts()).otherwise(made)


@g.bound
def read_ewkt(text: Column) -> Column:
    """WKT of the seven types, with or without an SRID in front, keywords in any case; EMPTY has no parts."""
    srid = F.regexp_extract(text, r"(?i)^\s*SRID\s*=\s*(\d+)\s*;", 1).try_cast("int")
    return g.let(F.trim(F.regexp_replace(text, r"(?i)^\s*SRID\s*=\s*\d+\s*;", "")), lambda body: _wkt_body_read(body, srid))


def _wkt_body_read(body: Column, srid: Column) -> Column:
    kind = F.try_element_at(_names(*g.TYPES), F.lower(F.regexp_extract(body, r"^([A-Za-z]+)", 1)))
    whole = body.rlike(rf"^{_COMPONENT}\s*$")
    collected = F.flatten(F.transform(F.regexp_extract_all(body, F.lit(_COMPONENT), F.lit(0)), lambda c: _wkt_parts(c)))
    closed = F.length(F.regexp_replace(body, r"[^(]", "")) == F.length(F.regexp_replace(body, r"[^)]", ""))
    parts = F.when(kind == "GeometryCollection", F.when(closed & body.rlike(r"(?i)^GEOMETRYCOLLECTION\s*(?:EMPTY|\()"), collected)).when(whole, _wkt_parts(body))
    return g.geometry(kind, parts, srid)


def _tuples(ring: Column, between: str, within: str, swapped: bool = False) -> Column:
    pair = lambda v: F.concat(n(v["y"]), F.lit(within), n(v["x"])) if swapped else F.concat(n(v["x"]), F.lit(within), n(v["y"]))
    return F.array_join(F.transform(ring, pair), between)


def _bracketed(items: Column, left: str = "(", right: str = ")", between: str = ", ") -> Column:
    return F.concat(F.lit(left), F.array_join(items, between), F.lit(right))


def _wkt_body(kind: Column, parts: Column) -> Column:
    ring = lambda r: F.concat(F.lit("("), _tuples(r, ", ", " "), F.lit(")"))
    rings = lambda p: _bracketed(F.transform(p["rings"], ring))
    one = parts[0]
    plain = _tuples(one["rings"][0], ", ", " ")
    return (
        F.when(kind.isin("Point", "LineString"), F.concat(F.lit("("), plain, F.lit(")")))
        .when(kind == "Polygon", rings(one))
        .when(kind.isin("MultiPoint", "MultiLineString"), _bracketed(F.transform(parts, lambda p: ring(p["rings"][0]))))
        .when(kind == "MultiPolygon", _bracketed(F.transform(parts, rings)))
    )


@g.bound
def write_wkt(geom: Column) -> Column:
    """``TYPE (x y, x y)``, ``TYPE EMPTY``; whole numbers without a decimal point."""
    kind, parts = geom["type"], geom["parts"]
    inner = _bracketed(F.transform(parts, lambda p: F.concat(F.upper(p["type"]), F.lit(" "), _wkt_body(p["type"], F.array(p)))))
    body = F.when(kind == "GeometryCollection", inner).otherwise(_wkt_body(kind, parts))
    return F.when(geom.isNotNull(), F.concat(F.upper(kind), F.lit(" "), F.when(g.is_empty(geom), "EMPTY").otherwise(body)))


@g.bound
def write_ewkt(geom: Column) -> Column:
    """WKT with an SRID prefix if there is an SRID."""
    return F.concat(F.when(geom["srid"].isNotNull(), F.concat(F.lit("SRID="), geom["srid"].cast("string"), F.lit(";"))).otherwise(""), write_wkt(geom))


# GeoJSON

_JSON = "type string, coordinates string, geometries array<string>, geometry string, features array<string>"


@g.bound
def _json_parts(j: Column) -> Column:
    kind, c = j["type"], j["coordinates"]
    at = lambda depth: F.from_json(c, "array<" * depth + "double" + ">" * depth)
    v = lambda a: g.vertex(F.get(a, F.lit(0)), F.get(a, F.lit(1)))
    ring = lambda r: F.transform(r, v)
    return (
        F.when(kind == "Point", F.transform(F.filter(F.array(at(1)), lambda a: F.size(a) > 0), lambda a: g.part("Point", F.array(F.array(v(a))))))
        .when(kind == "LineString", F.transform(F.filter(F.array(at(2)), lambda a: F.size(a) > 0), lambda a: g.part("LineString", F.array(ring(a)))))
        .when(kind == "Polygon", F.transform(F.filter(F.array(at(3)), lambda a: F.size(a) > 0), lambda a: g.part("Polygon", F.transform(a, ring))))
        .when(kind == "MultiPoint", F.transform(at(2), lambda a: g.part("Point", F.array(F.array(v(a))))))
        .when(kind == "MultiLineString", F.transform(at(3), lambda a: g.part("LineString", F.array(ring(a)))))
        .when(kind == "MultiPolygon", F.transform(at(4), lambda a: g.part("Polygon", F.transform(a, ring))))
    )


@g.bound
def read_geojson(text: Column) -> Column:
    """Geometries, Features and FeatureCollections; properties are dropped, the features of a collection merged."""
    j = F.from_json(text, _JSON)
    members = F.when(j["type"] == "FeatureCollection", F.transform(j["features"], lambda f: F.get_json_object(f, "$.geometry"))).when(j["type"] == "Feature", F.array(j["geometry"])).otherwise(F.array(text))
    return g.let(F.transform(F.array_compact(members), lambda m: F.from_json(m, _JSON)), _json_merged)


def _json_merged(parsed: Column) -> Column:
    # a collection among them gives its own members
    flat = F.flatten(F.transform(parsed, lambda m: F.when(m["type"] == "GeometryCollection", F.transform(m["geometries"], lambda s: F.from_json(s, _JSON))).otherwise(F.array(m))))
    parts = F.flatten(F.transform(flat, lambda m: _json_parts(m)))
    only = F.get(parsed, F.lit(0))["type"]
    known = F.array_contains(F.array(*[F.lit(t) for t in g.TYPES]), only)
    return g.let(parts, lambda p: F.when((F.size(parsed) == 1) & known, g.geometry(only, p)).otherwise(g.reduced(p)))


def _json_coordinates(kind: Column, parts: Column) -> Column:
    list_ = lambda items: _bracketed(items, "[", "]", ",")
    v = lambda p: F.concat(F.lit("["), n(p["x"]), F.lit(","), n(p["y"]), F.lit("]"))
    ring = lambda r: list_(F.transform(r, v))
    rings = lambda p: list_(F.transform(p["rings"], ring))
    one = parts[0]
    made = (
        F.when(kind == "Point", v(one["rings"][0][0]))
        .when(kind == "LineString", ring(one["rings"][0]))
        .when(kind == "Polygon", rings(one))
        .when(kind == "MultiPoint", list_(F.transform(parts, lambda p: v(p["rings"][0][0]))))
        .when(kind == "MultiLineString", list_(F.transform(parts, lambda p: ring(p["rings"][0]))))
        .when(kind == "MultiPolygon", list_(F.transform(parts, rings)))
    )
    return F.when(F.size(parts) == 0, "[]").otherwise(made)


@g.bound
def write_geojson(geom: Column) -> Column:
    kind, parts = geom["type"], geom["parts"]
    simple = lambda k, p: F.concat(F.lit('{"type":"'), k, F.lit('","coordinates":'), _json_coordinates(k, p), F.lit("}"))
    inner = F.concat(F.lit('{"type":"GeometryCollection","geometries":'), _bracketed(F.transform(parts, lambda p: simple(p["type"], F.array(p))), "[", "]", ","), F.lit("}"))
    return F.when(geom.isNotNull(), F.when(kind == "GeometryCollection", inner).otherwise(simple(kind, parts)))


# XML formats


@g.bound
def well_formed(text: Column) -> Column:
    """The text without CDATA marks and comments, null if it is no well-formed XML."""
    plain = F.regexp_replace(text, r"(?s)<!\[CDATA\[.*?\]\]>|<!--.*?-->", "")
    return g.let(plain, _if_well_formed)


def _if_well_formed(plain: Column) -> Column:
    bad = F.from_xml(plain, "_corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})["_corrupt_record"]
    return F.when(plain.rlike("<") & bad.isNull(), plain)


@g.bound
def _elements(text: Column, names: str) -> Column:
    """The elements of these names with what they hold, in the order of the document, whatever their prefix."""
    return F.regexp_extract_all(text, F.lit(rf"(?is)<((?:\w+:)?(?:{names}))(?:\s[^>]*)?>.*?</\1\s*>"), F.lit(0))


def _name(element: Column) -> Column:
    return F.lower(F.regexp_extract(element, r"(?is)^<(?:\w+:)?(\w+)", 1))


def _content(element: Column) -> Column:
    return F.regexp_extract(element, r"(?is)^<[^>]*>(.*)</[^>]*>$", 1)


@g.bound
def read_kml(text: Column) -> Column:
    """Points, lines and polygons of all placemarks and multi-geometries; altitudes are dropped."""
    coordinates = lambda t: F.transform(_elements(t, "coordinates"), lambda c: _vertices(_content(c), r"\s+", ","))

    def parts(e: Column) -> Column:
        rings = F.concat(F.flatten(F.transform(_elements(e, "outerBoundaryIs"), coordinates)), F.flatten(F.transform(_elements(e, "innerBoundaryIs"), coordinates)))
        kind = F.element_at(_names(*g.SIMPLE), _name(e))
        return g.part(kind, F.when(kind == "Polygon", rings).otherwise(coordinates(e)))

    found = F.transform(_elements(well_formed(text), "Point|LineString|Polygon"), parts)
    return g.reduced(F.filter(found, lambda p: F.size(p["rings"]) > 0))


@g.bound
def write_kml(geom: Column) -> Column:
    """Holes are linear rings, as exteriors are."""
    coordinates = lambda r: F.concat(F.lit("<coordinates>"), _tuples(r, " ", ","), F.lit("</coordinates>"))
    linear = lambda r: F.concat(F.lit("<LinearRing>"), coordinates(r), F.lit("</LinearRing>"))
    bound = lambda r, i: F.concat(F.when(i == 0, "<outerBoundaryIs>").otherwise("<innerBoundaryIs>"), linear(r), F.when(i == 0, "</outerBoundaryIs>").otherwise("</innerBoundaryIs>"))
    inner = lambda p: F.when(p["type"] == "Polygon", F.array_join(F.transform(p["rings"], bound), "")).otherwise(coordinates(p["rings"][0]))
    each = F.transform(geom["parts"], lambda p: F.concat(F.lit("<"), p["type"], F.lit(">"), inner(p), F.lit("</"), p["type"], F.lit(">")))
    body = F.when(geom["type"].isin(*g.SIMPLE), F.get(each, F.lit(0))).otherwise(F.concat(F.lit("<MultiGeometry>"), F.array_join(each, ""), F.lit("</MultiGeometry>")))
    return F.when(geom.isNotNull(), F.concat(F.lit("<kml><Placemark>"), F.coalesce(body, F.lit("")), F.lit("</Placemark></kml>")))


_GPX = "wpt array<struct<_lat:double,_lon:double>>, trk array<struct<trkseg:array<struct<trkpt:array<struct<_lat:double,_lon:double>>>>>>, rte array<struct<rtept:array<struct<_lat:double,_lon:double>>>>"


@g.bound
def read_gpx(text: Column) -> Column:
    """Way points as points, every track as one line over its segments, every route as a line."""
    d = F.from_xml(text, _GPX)
    v = lambda p: g.vertex(p["_lon"], p["_lat"])
    list_ = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    line = lambda r: g.part("LineString", F.array(r))
    way = F.transform(list_(d["wpt"], "array<struct<_lat:double,_lon:double>>"), lambda p: g.part("Point", F.array(F.array(v(p)))))
    tracks = F.transform(d["trk"], lambda t: line(F.transform(F.flatten(F.transform(t["trkseg"], lambda s: s["trkpt"])), v)))
    routes = F.transform(d["rte"], lambda r: line(F.transform(r["rtept"], v)))
    none = g.no_parts()
    return g.reduced(F.filter(F.concat(way, F.coalesce(tracks, none), F.coalesce(routes, none)), lambda p: F.size(p["rings"][0]) > 0))


@g.bound
def write_gpx(geom: Column) -> Column:
    """Points as way points; lines, and the rings of polygons, as tracks of one segment."""
    at = lambda tag, v: F.concat(F.lit(f'<{tag} lat="'), n(v["y"]), F.lit('" lon="'), n(v["x"]), F.lit('" />'))
    track = lambda r: F.concat(F.lit("<trk><trkseg>"), F.array_join(F.transform(r, lambda v: at("trkpt", v)), ""), F.lit("</trkseg></trk>"))
    one = lambda p: F.when(p["type"] == "Point", at("wpt", p["rings"][0][0])).otherwise(F.array_join(F.transform(p["rings"], track), ""))
    return F.when(geom.isNotNull(), F.concat(F.lit('<gpx version="1.0">'), F.array_join(F.transform(geom["parts"], one), ""), F.lit("</gpx>")))


def read_georss(text: Column) -> Column:
    """Points, lines, polygons, boxes (as polygons) and circles (as centres) of all entries, latitude first."""
    return g.let(well_formed(text), _georss_geometry)


def _georss_geometry(plain: Column) -> Column:
    def flat(e: Column) -> Column:
        return g.let(F.filter(F.split(F.trim(_content(e)), r"[\s,]+"), lambda t: t != ""), pairs_of)

    def pairs_of(tokens: Column) -> Column:
        pairs = F.filter(F.transform(tokens, lambda t, i: F.struct(i.alias("i"), t.alias("t"), F.get(tokens, i + 1).alias("u"))), lambda s: (s["i"] % 2 == 0) & s["u"].isNotNull())
        return F.transform(pairs, lambda s: g.vertex(s["u"].try_cast("double"), s["t"].try_cast("double")))

    def corners(v: Column) -> Column:
        a, b = F.get(v, F.lit(0)), F.get(v, F.lit(1))  # a box without two pairs has corners without coordinates, so no geometry is made
        return F.array(*[g.vertex(p["x"], q["y"]) for p, q in ((a, a), (b, a), (b, b), (a, b), (a, a))])

    some = lambda found: F.filter(found, lambda p: F.size(p["rings"][0]) > 0)
    points = F.transform(_elements(plain, "point"), lambda e: g.part("Point", F.array(F.slice(flat(e), 1, 1))))
    lines = F.transform(_elements(plain, "line"), lambda e: g.part("LineString", F.array(flat(e))))
    polygons = F.transform(_elements(plain, "polygon"), lambda e: g.part("Polygon", F.array(flat(e))))
    boxes = F.transform(_elements(plain, "box"), lambda e: g.part("Polygon", F.array(g.let(flat(e), corners))))
    circles = F.transform(_elements(plain, "circle"), lambda e: g.part("Point", F.array(F.slice(flat(e), 1, 1))))
    return g.reduced(some(F.concat(points, lines, polygons, boxes, circles)))


@g.bound
def georss_radii(text: Column) -> Column:
    """Radii of the circles of a document, which the geometry does not keep."""
    return F.transform(_elements(well_formed(text), "circle"), lambda e: F.element_at(F.split(F.trim(_content(e)), r"[\s,]+"), -1).try_cast("double"))


@g.bound
def write_georss(geom: Column) -> Column:
    """Latitude first; of a polygon the exterior."""
    tag = lambda p: F.element_at(F.create_map(*[F.lit(x) for k, t in zip(g.SIMPLE, ("point", "line", "polygon"), strict=True) for x in (k, t)]), p["type"])
    each = F.transform(geom["parts"], lambda p: F.concat(F.lit("<"), tag(p), F.lit(">"), _tuples(p["rings"][0], " ", " ", True), F.lit("</"), tag(p), F.lit(">")))
    body = F.array_join(each, "")
    body = F.when(geom["type"].isin(*g.SIMPLE), body).otherwise(F.concat(F.lit("<where>"), body, F.lit("</where>")))
    return F.when(geom.isNotNull(), F.concat(F.lit("<entry>"), body, F.lit("</entry>")))


# WKB: Arrow batches


_POINTS = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
_PARTS = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("rings", T.ArrayType(_POINTS))]))
_GEOMETRY = T.StructType([T.StructField("type", T.StringType()), T.StructField("srid", T.IntegerType()), T.StructField("parts", _PARTS)])


def _with_column(rows: DataFrame, column: str, of: Callable[[pa.Array], list], kind: T.DataType) -> DataFrame:
    """``rows`` with one column made anew batch by batch; the others go through as they are."""
    schema, arrow = T.StructType([T.StructField(f.name, kind if f.name == column else f.dataType) for f in rows.schema]), to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [pa.array(of(c), arrow) if name == column else c for name, c in zip(b.schema.names, b.columns, strict=True)]
            yield pa.RecordBatch.from_arrays(made, names=b.schema.names)

    return rows.mapInArrow(run, schema)


def wkb_to_geometry(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with a column of little-endian WKB or EWKB as geometries; other bytes, big-endian ones too, give null."""
    return _with_column(rows, column, shapes.from_wkb_batch, _GEOMETRY)


def geometry_to_wkb(rows: DataFrame, column: str, extended: bool = False) -> DataFrame:
    """``rows`` with a column of geometries as little-endian WKB, or EWKB with the SRID in its head."""
    return _with_column(rows, column, lambda c: shapes.to_wkb_batch(c, extended), T.BinaryType())


# geohash


def read_geohash(code: Column) -> Column:
    """The rounded middle of the cell."""
    return F.when(code.rlike("^[0-9b-hjkmnp-zB-HJKMNP-Z]+$"), g.let(g.geohash_centre(code), lambda c: g.point(c["x"], c["y"])))


# register and dispatch

Reader = Callable[[Column], Column]
Writer = Callable[[Column], Column]
FORMATS: dict[str, tuple[Reader | None, Writer | None]] = {}
#: Formats that work on tables, batch by batch: whether extended, whether as hexadecimal text.
BINARY = {"wkb": (False, False), "ewkb": (True, False), "wkb_hex": (False, True), "ewkb_hex": (True, True)}


#: Tests by which ``convert`` knows the texts of formats that were registered with one.
LOOKS: dict[str, Reader] = {}


def register(name: str, read: Reader | None, write: Writer | None, looks: Reader | None = None) -> None:
    """Adds a format, or puts another reader or writer in the place of one: functions of a column.

    ``looks`` tells of a text whether it is of this format, so that ``convert`` finds it where no format is named.
    """
    FORMATS[name] = (read, write)
    LOOKS.pop(name, None)
    if looks is not None:
        LOOKS[name] = looks


register("wkt", read_ewkt, write_wkt)
register("ewkt", read_ewkt, write_ewkt)
register("geojson", read_geojson, write_geojson)
register("kml", read_kml, write_kml)
register("gpx", read_gpx, write_gpx)
register("georss", read_georss, write_georss)
register("geohash", read_geohash, g.geohash_of)


def load(rows: DataFrame, column: str, kind: str) -> DataFrame:
    """``rows`` with a column of a registered format as geometries."""
    if kind in BINARY:
        return wkb_to_geometry(rows.withColumn(column, F.unhex(column)) if BINARY[kind][1] else rows, column)
    read = FORMATS[kind][0]
    if read is None:
        raise ValueError(f"{kind} has no reader")
    return rows.withColumn(column, read(F.col(column)))


def out(rows: DataFrame, column: str, kind: str) -> DataFrame:
    """``rows`` with a column of geometries in a registered format."""
    if kind in BINARY:
        made = geometry_to_wkb(rows, column, BINARY[kind][0])
        return made.withColumn(column, F.hex(column)) if BINARY[kind][1] else made
    write = FORMATS[kind][1]
    if write is None:
        raise ValueError(f"{kind} has no writer")
    return rows.withColumn(column, write(F.col(column)))


@g.bound
def detect(text: Column) -> Column:
    """The format of a text by its looks: geojson, kml, gpx, georss, ewkt, wkt, wkb_hex or geohash; null if none."""
    t = F.trim(text)
    return (
        F.when(t.rlike(r"^\{"), "geojson")
        .when(t.rlike(r"(?is)^<.*<(?:\w+:)?(?:wpt|trk|rte)\b"), "gpx")
        .when(t.rlike(r"(?is)<(?:\w+:)?coordinates\b"), "kml")
        .when(t.rlike(r"^<"), "georss")
        .when(t.rlike(r"(?i)^SRID\s*="), "ewkt")
        .when(t.rlike(r"(?i)^(?:MULTI)?(?:POINT|LINESTRING|POLYGON|GEOMETRYCOLLECTION)"), "wkt")
        .when(t.rlike(r"(?i)^01[0-9a-f]{8,}$"), "wkb_hex")
        .when(t.rlike(r"(?i)^[0-9b-hjkmnp-z]+$"), "geohash")
    )


def convert(rows: DataFrame, column: str, source: str | None, target: str) -> DataFrame:
    """``rows`` with the column in another format; ``source`` None takes each row's format by its looks."""
    if source is not None:
        return out(load(rows, column, source), column, target)
    text, kind, wkb = F.col(column), f"_kind_{uuid.uuid4().hex}", f"_wkb_{uuid.uuid4().hex}"
    told = detect(text)
    for k, test in LOOKS.items():  # formats of the user come before those known by their looks
        told = F.when(test(text), k).otherwise(told)
    rows, geom = rows.withColumn(kind, told), F.lit(None).cast(g.GEOMETRY)
    for k, (read, _) in FORMATS.items():
        if read is not None:
            geom = F.when(F.col(kind) == k, read(F.when(F.col(kind) == k, text))).otherwise(geom)
    both = wkb_to_geometry(rows.withColumn(wkb, F.when(F.col(kind) == "wkb_hex", F.unhex(text))), wkb)
    return out(both.withColumn(column, F.coalesce(wkb, geom)).drop(wkb, kind), column, target)
