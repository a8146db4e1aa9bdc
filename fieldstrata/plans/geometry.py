"""Queries on geometry: measures, accessors, geohashes, text formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import measures as m
from ..sources import datasets as d
from ..sources import formats as fm
from .registry import query

SEGS = d.TRACKS + ", s AS (SELECT track AS geom, seq, lon AS x, lat AS y, lead(lon) OVER w AS x2, lead(lat) OVER w AS y2 FROM points WINDOW w AS (PARTITION BY track ORDER BY seq))"
RINGS = d.POLYGONS + ", s AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM polygons WINDOW w AS (PARTITION BY geom, ring ORDER BY seq)), r AS (SELECT geom, ring, sum(x * y2 - x2 * y) / 2 AS signed, sum((x + x2) * (x * y2 - x2 * y)) AS mx, sum((y + y2) * (x * y2 - x2 * y)) AS my FROM s WHERE x2 IS NOT NULL GROUP BY geom, ring)"
METRES = "6378137 * atan2(sqrt(pow(cos(radians(y2)) * sin(radians(x2 - x)), 2) + pow(cos(radians(y)) * sin(radians(y2)) - sin(radians(y)) * cos(radians(y2)) * cos(radians(x2 - x)), 2)), sin(radians(y)) * sin(radians(y2)) + cos(radians(y)) * cos(radians(y2)) * cos(radians(x2 - x)))"
TEXT = lambda c: f"regexp_replace({c}::VARCHAR, '\\.0$', '')"


def rounded(df, n=6):
    return df.select(*[F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"WITH {SEGS}, g AS (SELECT geom, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM s GROUP BY geom) SELECT geom, minx, miny, maxx, maxy, round(l, 3) AS metres FROM g JOIN (SELECT geom, sum({METRES}) AS l FROM s WHERE x2 IS NOT NULL GROUP BY geom) USING (geom)")
def track_lengths(spark, sf_dir):
    v = d.track_vertices(spark, sf_dir)
    return m.bounding_box(v).join(m.lengths(v).select("geom", F.round("metres", 3).alias("metres")), "geom")


@query(f"WITH {SEGS} SELECT geom, seq, x, y, x2, y2 FROM s WHERE x2 IS NOT NULL")
def w01_segments(spark, sf_dir):
    return m.segments(d.track_vertices(spark, sf_dir)).drop("ring")


@query(f"WITH {d.POLYGONS} SELECT geom, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM polygons GROUP BY geom")
def a01_bounding_box(spark, sf_dir):
    return m.bounding_box(d.polygons(spark, sf_dir))


@query(f"WITH {d.POLYGONS}, b AS (SELECT geom, min(x) AS a, min(y) AS b, max(x) AS c, max(y) AS d FROM polygons GROUP BY geom), t AS (SELECT geom, {TEXT('a')} AS a, {TEXT('b')} AS b, {TEXT('c')} AS c, {TEXT('d')} AS d FROM b) SELECT geom, concat('POLYGON ((', c, ' ', b, ', ', c, ' ', d, ', ', a, ' ', d, ', ', a, ' ', b, ', ', c, ' ', b, '))') AS wkt FROM t")
def a02_envelope(spark, sf_dir):
    return m.envelope(d.polygons(spark, sf_dir))


@query(f"WITH {d.POLYGONS} SELECT geom, count(DISTINCT ring) AS rings, count(*) AS points FROM polygons GROUP BY geom")
def a03_counts(spark, sf_dir):
    return d.polygons(spark, sf_dir).groupBy("geom").agg(F.countDistinct("ring").alias("rings"), F.count("*").alias("points"))


@query(f"WITH {SEGS} SELECT geom, round(sum(sqrt(pow(x2 - x, 2) + pow(y2 - y, 2))), 6) AS planar, round(sum(degrees(acos(greatest(least(sin(radians(y)) * sin(radians(y2)) + cos(radians(y)) * cos(radians(y2)) * cos(radians(x - x2)), 1), -1)))), 5) AS degrees FROM s WHERE x2 IS NOT NULL GROUP BY geom")
def a04_a06_lengths(spark, sf_dir):
    return m.lengths(d.track_vertices(spark, sf_dir)).select("geom", F.round("planar", 6).alias("planar"), F.round("degrees", 5).alias("degrees"))


@query(f"WITH {SEGS} SELECT geom, round(sum({METRES}), 3) AS metres FROM s WHERE x2 IS NOT NULL GROUP BY geom")
def a05_great_circle_length(spark, sf_dir):
    return m.lengths(d.track_vertices(spark, sf_dir)).select("geom", F.round("metres", 3).alias("metres"))


@query(f"WITH {RINGS} SELECT geom, sum(CASE WHEN ring = 0 THEN abs(signed) ELSE -abs(signed) END) AS area, sum(CASE WHEN ring = 0 THEN abs(signed) END) AS exterior, sum(CASE WHEN ring = 0 THEN signed END) AS signed FROM r GROUP BY geom")
def a07_area(spark, sf_dir):
    return m.area(d.polygons(spark, sf_dir))


@query(f"WITH {RINGS} SELECT geom, round(mx / (6 * signed), 6) AS cx, round(my / (6 * signed), 6) AS cy FROM r WHERE ring = 0")
def a08_centroid(spark, sf_dir):
    return rounded(m.centroid(d.polygons(spark, sf_dir)))


@query("SELECT (p_partkey % 500)::INT AS geom, max(CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END)::INT AS dimension FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 2 GROUP BY 1")
def a09_dimension(spark, sf_dir):
    kind = F.when(F.col("p_partkey") % 3 == 0, "Polygon").when(F.col("p_partkey") % 3 == 1, "MultiLineString").otherwise("Point")
    p = d.table(spark, sf_dir, "part").where("p_partkey % 2 = 0 or p_partkey % 3 = 2")
    return m.dimension(p.select((F.col("p_partkey") % 500).cast("int").alias("geom"), kind.alias("type")))


@query(f"WITH {d.TRACKS} SELECT track AS geom, concat('LINESTRING (', string_agg({TEXT('lon')} || ' ' || {TEXT('lat')}, ', ' ORDER BY seq), ')') AS wkt FROM points GROUP BY track")
def a11_build_line(spark, sf_dir):
    return m.line_text(d.track_vertices(spark, sf_dir))


@query(f"WITH {RINGS}, c AS (SELECT geom, mx / (6 * signed) AS cx, my / (6 * signed) AS cy FROM r WHERE ring = 0), o AS (SELECT p.geom, seq, x, y, sqrt(pow(x - cx, 2) + pow(y - cy, 2)) AS distance FROM polygons p JOIN c USING (geom) WHERE ring = 0) SELECT geom, seq, x, y, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY geom ORDER BY round(distance, 9) DESC, seq) AS k FROM o) WHERE k = 1")
def a18_outermost(spark, sf_dir):
    return rounded(m.outermost(d.polygons(spark, sf_dir)))


@query(f"WITH {d.TRACKS}, e AS (SELECT track AS geom, arg_min(lon, seq) AS start_x, arg_min(lat, seq) AS start_y, arg_max(lon, seq) AS end_x, arg_max(lat, seq) AS end_y, max(CASE WHEN seq = 2 THEN lon END) AS n_x, max(CASE WHEN seq = 2 THEN lat END) AS n_y, count(*) AS points FROM points GROUP BY track) SELECT *, start_x = end_x AND start_y = end_y AS closed FROM e")
def w03_w04_end_points(spark, sf_dir):
    return m.end_points(d.track_vertices(spark, sf_dir))


@query(
    "WITH RECURSIVE " + d.SPRINGS + ", b(upload, n, x0, x1, y0, y1, v, code, lon, lat) AS ("
    "SELECT upload, 0, -180e0, 180e0, -90e0, 90e0, 0, '', lon, lat FROM springs UNION ALL "
    "SELECT upload, n + 1, CASE WHEN n % 2 = 0 AND lon > (x0 + x1) / 2 THEN (x0 + x1) / 2 ELSE x0 END, CASE WHEN n % 2 = 0 AND NOT lon > (x0 + x1) / 2 THEN (x0 + x1) / 2 ELSE x1 END, "
    "CASE WHEN n % 2 = 1 AND lat > (y0 + y1) / 2 THEN (y0 + y1) / 2 ELSE y0 END, CASE WHEN n % 2 = 1 AND NOT lat > (y0 + y1) / 2 THEN (y0 + y1) / 2 ELSE y1 END, "
    "CASE WHEN n % 5 = 4 THEN 0 ELSE v * 2 + bit END, CASE WHEN n % 5 = 4 THEN code || substr('0123456789bcdefghjkmnpqrstuvwxyz', (v * 2 + bit) + 1, 1) ELSE code END, lon, lat "
    "FROM (SELECT *, CASE WHEN (n % 2 = 0 AND lon > (x0 + x1) / 2) OR (n % 2 = 1 AND lat > (y0 + y1) / 2) THEN 1 ELSE 0 END AS bit FROM b WHERE n < 30)) "
    "SELECT upload, code, x0, x1, y0, y1 FROM b WHERE n = 30"
)
def g05_g07_geohash(spark, sf_dir):
    s = d.springs(spark, sf_dir).select("upload", geo.geohash(F.col("lon"), F.col("lat"), 6).alias("code"))
    return s.withColumn("b", geo.geohash_bounds(F.col("code"))).select("upload", "code", "b.x0", "b.x1", "b.y0", "b.y1")


@query(f"WITH {d.SPRINGS}, p AS (SELECT upload, radians(lon) * 6378137 AS mx, ln(tan(radians(lat) / 2 + 0.7853981633974483)) * 6378137 AS my FROM springs) SELECT upload, round(mx, 4) AS mx, round(my, 4) AS my, round(degrees(mx / 6378137), 6) AS lon, round(degrees(atan(exp(my / 6378137)) * 2 - 1.5707963267948966), 6) AS lat FROM p")
def g12_mercator(spark, sf_dir):
    s = d.springs(spark, sf_dir)
    mx, my = geo.mercator(F.col("lon"), F.col("lat"))
    s = s.select("upload", mx.alias("mx"), my.alias("my"))
    lon, lat = geo.from_mercator(F.col("mx"), F.col("my"))
    return s.select("upload", F.round("mx", 4).alias("mx"), F.round("my", 4).alias("my"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query(f"WITH {d.SPRINGS} SELECT upload, lon AS x, lat AS y, 4326 AS srid, 'Point' AS type FROM springs")
def s01_s04_wkt_round_trip(spark, sf_dir):
    """Points written as EWKT and read again."""
    s = d.springs(spark, sf_dir).select("upload", fm.ewkt(fm.wkt_point(F.col("lon"), F.col("lat")), F.lit(4326)).alias("text"))
    p = fm.read_wkt(F.col("text"))
    return s.select("upload", p["rings"][0][0]["x"].alias("x"), p["rings"][0][0]["y"].alias("y"), p["srid"].alias("srid"), p["type"].alias("type"))


@query(f"WITH {d.POLYGONS} SELECT geom, ring, seq, x, y FROM polygons")
def s01_s03_polygon_round_trip(spark, sf_dir):
    """Polygons written as WKT, read again and exploded to vertices."""
    t = fm.polygon_text(d.polygons(spark, sf_dir))
    r = t.select("geom", F.posexplode(fm.read_wkt(F.col("wkt"))["rings"]).alias("ring", "v"))
    return r.select("geom", "ring", F.posexplode("v").alias("k", "p")).select("geom", "ring", (F.col("k") + 1).alias("seq"), "p.x", "p.y")


@query(f"WITH {d.SPRINGS} SELECT upload, lon AS x, lat AS y FROM springs")
def s08_s09_geojson_round_trip(spark, sf_dir):
    s = d.springs(spark, sf_dir).select("upload", fm.geojson_point(F.col("lon"), F.col("lat")).alias("text"))
    p = fm.read_geojson_point(F.col("text"))
    return s.select("upload", p[0].alias("x"), p[1].alias("y"))


@query(f"WITH {d.TRACKS} SELECT track, seq - 1 AS seq, lon, lat, ele, ts AS time FROM points")
def s12_s16_gpx_round_trip(spark, sf_dir):
    """Track points written as GPX, one document a track, and read again with elevation and time."""
    g = fm.gpx_documents(d.track_points(spark, sf_dir))
    return fm.read_gpx(g, "track")


@query(f"WITH {d.SPRINGS} SELECT upload, lon AS x, lat AS y FROM springs")
def s10_s11_kml_round_trip(spark, sf_dir):
    s = d.springs(spark, sf_dir).select("upload", fm.kml_point(F.col("lon"), F.col("lat")).alias("text"))
    return fm.read_kml_points(s, "upload")


@query(f"WITH {d.SPRINGS} SELECT upload, lon AS x, lat AS y FROM springs")
def s14_s15_georss_round_trip(spark, sf_dir):
    s = d.springs(spark, sf_dir).select("upload", fm.georss_point(F.col("lon"), F.col("lat")).alias("text"))
    return fm.read_georss_points(s, "upload")


@query()
def a19_convex_hull(spark, sf_dir):
    from ..functions import shapes

    return shapes.convex_hulls(d.track_vertices(spark, sf_dir))


@query()
def g10_simplify(spark, sf_dir):
    from ..functions import shapes

    return shapes.simplify(d.track_vertices(spark, sf_dir), 20.0)
