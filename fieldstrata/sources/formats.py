"""Readers and writers of geometry texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import number_text as n


def wkt_point(x: Column, y: Column) -> Column:
    return F.concat(F.lit("POINT ("), n(x), F.lit(" "), n(y), F.lit(")"))


def ewkt(wkt: Column, srid: Column) -> Column:
    """WKT with an SRID prefix if there is an SRID."""
    return F.when(srid.isNotNull(), F.concat(F.lit("SRID="), srid.cast("string"), F.lit(";"), wkt)).otherwise(wkt)


def polygon_text(v: DataFrame) -> DataFrame:
    """POLYGON texts of ring vertices (geom, ring, seq, x, y)."""
    p = F.sort_array(F.collect_list(F.struct("seq", "x", "y")))
    ring = F.concat(F.lit("("), F.array_join(F.transform(p, lambda q: F.concat(n(q["x"]), F.lit(" "), n(q["y"]))), ", "), F.lit(")"))
    rings = v.groupBy("geom", "ring").agg(ring.alias("t"))
    return rings.groupBy("geom").agg(F.concat(F.lit("POLYGON ("), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ring", "t"))), lambda r: r["t"]), ", "), F.lit(")")).alias("wkt"))


def read_wkt(text: Column) -> Column:
    """struct(type, srid, rings) of a point, line or polygon text, with or without SRID; EMPTY has no rings.

    Keywords count in any case; further ordinates of a vertex are dropped. Texts that are none of these
    give null.
    """
    srid = F.regexp_extract(text, r"(?i)^\s*SRID=(\d+);", 1)
    body = F.trim(F.regexp_replace(text, r"(?i)^\s*SRID=\d+;", ""))
    word = F.lower(F.regexp_extract(body, r"^([A-Za-z]+)", 1))
    kind = F.element_at(F.create_map(*[F.lit(x) for k in ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon") for x in (k.lower(), k)]), word)
    inner = F.regexp_extract_all(body, F.lit(r"\(([^()]*)\)"), F.lit(1))
    vertex = lambda p: F.struct(F.split(F.trim(p), r"\s+")[0].cast("double").alias("x"), F.split(F.trim(p), r"\s+")[1].cast("double").alias("y"))
    rings = F.transform(inner, lambda r: F.transform(F.split(r, ","), vertex))
    return F.when(kind.isNotNull(), F.struct(kind.alias("type"), F.when(srid != "", srid.cast("int")).alias("srid"), rings.alias("rings")))


def geojson_point(x: Column, y: Column) -> Column:
    return F.to_json(F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates")))


def read_geojson_point(text: Column) -> Column:
    """Coordinates of a Point, or of the Point of a Feature; properties are dropped."""
    j = F.from_json(text, "type string, coordinates array<double>, geometry struct<type: string, coordinates: array<double>>")
    return F.coalesce(j["coordinates"], j["geometry"]["coordinates"])


def gpx_documents(points: DataFrame) -> DataFrame:
    """One GPX document a track from (track, seq, lon, lat, ele, ts)."""
    p = F.format_string('<trkpt lat="%s" lon="%s"><ele>%s</ele><time>%s</time></trkpt>', F.col("lat").cast("string"), F.col("lon").cast("string"), F.col("ele").cast("string"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", p.alias("p")))), lambda q: q["p"]), "")
    return points.groupBy("track").agg(F.concat(F.lit('<gpx version="1.1"><trk><trkseg>'), body, F.lit("</trkseg></trk></gpx>")).alias("gpx"))


GPX = "trk array<struct<name: string, trkseg: array<struct<trkpt: array<struct<_lat: double, _lon: double, ele: double, time: timestamp>>>>>>"


def read_gpx(docs: DataFrame, key: str, column: str = "gpx") -> DataFrame:
    """Points of all tracks and segments: (key, seq, lon, lat, ele, time); malformed documents give none."""
    d = docs.select(key, F.from_xml(column, GPX).alias("g"))
    pts = F.flatten(F.transform("g.trk", lambda t: F.flatten(F.transform(t["trkseg"], lambda s: s["trkpt"]))))
    return d.select(key, F.posexplode(pts).alias("seq", "p")).select(key, "seq", F.col("p._lon").alias("lon"), F.col("p._lat").alias("lat"), "p.ele", "p.time")


def kml_point(x: Column, y: Column) -> Column:
    return F.concat(F.lit("<kml><Placemark><Point><coordinates>"), n(x), F.lit(","), n(y), F.lit("</coordinates></Point></Placemark></kml>"))


def read_kml_points(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    k = docs.select(key, F.from_xml(column, "Placemark array<struct<Point: struct<coordinates: string>>>").alias("k"))
    c = k.select(key, F.explode("k.Placemark").alias("p")).select(key, F.split(F.trim("p.Point.coordinates"), ",").alias("c"))
    return c.select(key, F.col("c")[0].cast("double").alias("x"), F.col("c")[1].cast("double").alias("y"))


def georss_point(x: Column, y: Column) -> Column:
    return F.concat(F.lit("<entry><point>"), n(y), F.lit(" "), n(x), F.lit("</point></entry>"))


def read_georss_points(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """Points of feed entries, latitude first."""
    c = docs.select(key, F.split(F.trim(F.from_xml(column, "point string")["point"]), r"\s+").alias("c"))
    return c.select(key, F.col("c")[1].cast("double").alias("x"), F.col("c")[0].cast("double").alias("y"))
