"""Queries on geometries as values: every type in every format, accessors, measures, predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources import adapters as a
from ..sources import datasets as d
from ..operators.values import equality_classes
from .registry import query

TEXTS = f"WITH {d.SHAPES} SELECT id, t FROM shapes"


def _round_trip(spark, sf_dir, kind):
    rows = a.out(d.shape_values(spark, sf_dir), "g", kind)
    return a.load(rows, "g", kind).select("id", a.write_wkt(F.col("g")).alias("t"))


@query(TEXTS)
def s01_s03_wkt_all_types(spark, sf_dir):
    """Texts of the seven types read and written again."""
    return d.shape_values(spark, sf_dir).select("id", a.write_wkt(F.col("g")).alias("t"))


@query(f"WITH {d.SHAPES} SELECT id, 'SRID=4326;' || t AS t, 4326 AS srid FROM shapes")
def s02_s04_ewkt_all_types(spark, sf_dir):
    s = d.shapes(spark, sf_dir).select("id", a.read_ewkt(F.concat(F.lit("srid=4326;"), F.lower("t"))).alias("g"))
    return s.select("id", a.write_ewkt(F.col("g")).alias("t"), F.col("g.srid").alias("srid"))


@query(f"WITH {d.SHAPES} SELECT id, 'SRID=4326;' || t AS t FROM shapes")
def s05_s07_wkb_all_types(spark, sf_dir):
    """Written as EWKB in hexadecimal and read again, with the SRID."""
    s = d.shape_values(spark, sf_dir).select("id", g.with_srid(F.col("g"), F.lit(4326)).alias("g"))
    return a.load(a.out(s, "g", "ewkb_hex"), "g", "ewkb_hex").select("id", a.write_ewkt(F.col("g")).alias("t"))


@query(TEXTS)
def s08_s09_geojson_all_types(spark, sf_dir):
    return _round_trip(spark, sf_dir, "geojson")


@query(f"WITH {d.SHAPES}, f AS (SELECT p_partkey % 50 AS doc, count(*) AS n, string_agg(DISTINCT CASE WHEN p_partkey % 7 IN (0, 3) THEN 'POINT' WHEN p_partkey % 7 IN (1, 4) THEN 'LINESTRING' WHEN p_partkey % 7 IN (2, 5) THEN 'POLYGON' END, ',') AS k FROM part WHERE p_partkey % 7 IN (0, 1) GROUP BY 1) SELECT doc, CASE WHEN n = 1 THEN k WHEN k NOT LIKE '%,%' THEN 'MULTI' || k ELSE 'GEOMETRYCOLLECTION' END AS type, n AS parts FROM f")
def s08_a10_feature_collections(spark, sf_dir):
    """Features of a document merged to their lowest common type."""
    one = d.shape_values(spark, sf_dir).where("id % 7 in (0, 1)").select("id", a.write_geojson(F.col("g")).alias("j"))
    feature = F.concat(F.lit('{"type":"Feature","properties":{"a":1},"geometry":'), "j", F.lit("}"))
    docs = one.groupBy((F.col("id") % 50).alias("doc")).agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list(feature), ","), F.lit("]}")).alias("j"))
    return docs.select("doc", a.read_geojson(F.col("j")).alias("g")).select("doc", F.upper("g.type").alias("type"), F.size("g.parts").cast("long").alias("parts"))


@query(TEXTS)
def s10_s11_kml_all_types(spark, sf_dir):
    return _round_trip(spark, sf_dir, "kml")


#: What is left of the shapes where rings become tracks, and where only exteriors are written.
_TRACKS = [*d.SHAPE_TEXTS[:2], "MULTILINESTRING ((@0,0, @6,0, @6,6, @0,6, @0,0), (@1,1, @2,1, @2,2, @1,1))", *d.SHAPE_TEXTS[3:5], "MULTILINESTRING ((@0,0, @2,0, @0,2, @0,0), (@4,4, @8,4, @8,8, @4,4), (@6,5, @7,5, @7,6, @6,5))", d.SHAPE_TEXTS[6]]
_EXTERIORS = [*d.SHAPE_TEXTS[:2], "POLYGON ((@0,0, @6,0, @6,6, @0,6, @0,0))", *d.SHAPE_TEXTS[3:5], "MULTIPOLYGON (((@0,0, @2,0, @0,2, @0,0)), ((@4,4, @8,4, @8,8, @4,4)))", d.SHAPE_TEXTS[6]]
_KEPT = lambda texts: "SELECT p_partkey AS id, " + d.by_kind([d.filled_sql(t, "p_partkey") for t in texts], "p_partkey") + " AS t FROM part"


@query(_KEPT(_TRACKS))
def s12_s13_gpx_all_types(spark, sf_dir):
    return _round_trip(spark, sf_dir, "gpx")


@query("SELECT p_partkey AS id, " + d.filled_sql("GEOMETRYCOLLECTION (POINT (@1,2), LINESTRING (@0,0, @1,1), LINESTRING (@4,4, @5,6))", "p_partkey") + " AS t FROM part")
def s12_x01_gpx_document(spark, sf_dir):
    """Way point, track of two segments and route of one document, in this order."""
    p = d.dealt(d.table(spark, sf_dir, "part"), "p_partkey")
    x, y = F.col("p_partkey") % 1000 - 500, F.col("p_partkey") * 7 % 160 - 80
    at = lambda tag, i, j: F.concat(F.lit(f'<{tag} lat="'), (y + j).cast("string"), F.lit('" lon="'), (x + i).cast("string"), F.lit('"/>'))
    text = F.concat(F.lit("<gpx><rte>"), at("rtept", 4, 4), at("rtept", 5, 6), F.lit("</rte>"), at("wpt", 1, 2), F.lit("<trk><trkseg>"), at("trkpt", 0, 0), F.lit("</trkseg><trkseg>"), at("trkpt", 1, 1), F.lit("</trkseg></trk></gpx>"))
    return p.select(F.col("p_partkey").alias("id"), a.write_wkt(a.read_gpx(text)).alias("t"))


@query(_KEPT(_EXTERIORS))
def s14_s15_georss_all_types(spark, sf_dir):
    return _round_trip(spark, sf_dir, "georss")


@query("SELECT p_partkey AS id, " + d.filled_sql("GEOMETRYCOLLECTION (POLYGON ((@0,0, @2,0, @2,3, @0,3, @0,0)), POINT (@1,1))", "p_partkey") + " AS t, 500e0 AS radius FROM part")
def s14_boxes_and_circles(spark, sf_dir):
    """Boxes are polygons, circles their centres, with the radius beside them."""
    x, y = F.col("p_partkey") % 1000 - 500, F.col("p_partkey") * 7 % 160 - 80
    pair = lambda i, j: F.concat((y + j).cast("string"), F.lit(" "), (x + i).cast("string"))
    text = F.concat(F.lit("<feed><circle>"), pair(1, 1), F.lit(" 500</circle><box>"), pair(0, 0), F.lit(" "), pair(2, 3), F.lit("</box></feed>"))
    p = d.dealt(d.table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("id"), text.alias("x"))
    return p.select("id", a.write_wkt(a.read_georss(F.col("x"))).alias("t"), a.georss_radii(F.col("x"))[0].alias("radius"))


@query(f"WITH {d.SHAPES} SELECT id, t FROM shapes WHERE id % 7 NOT IN (2, 5)")
def s17_u08_convert_by_looks(spark, sf_dir):
    """Texts of five formats, told apart by their looks, as WKT."""
    s = d.shape_values(spark, sf_dir).where("id % 7 not in (2, 5)")
    mixed, kinds = None, ("wkt", "geojson", "kml", "gpx", "georss")
    for i, k in enumerate(kinds):
        part = a.out(s.where(F.floor(F.col("id") / 7) % len(kinds) == i), "g", k)
        mixed = part if mixed is None else mixed.unionByName(part)
    return a.convert(mixed, "g", None, "wkt").select("id", F.col("g").alias("t"))


@query("SELECT p_partkey AS id, p_partkey % 4 = 1 AS empty, p_partkey % 4 IN (2, 3) AS rejected FROM part")
def f09_empty_and_rejected(spark, sf_dir):
    """Empty geometries, and texts that are none: a line of one vertex, an empty point."""
    t = F.element_at(F.array(*[F.lit(x) for x in ("POINT (1 2)", "POLYGON EMPTY", "LINESTRING (1 2)", "POINT EMPTY")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    p = d.dealt(d.table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("id"), a.read_ewkt(t).alias("g"))
    return p.select("id", F.coalesce(g.is_empty(F.col("g")), F.lit(False)).alias("empty"), F.col("g").isNull().alias("rejected"))


KINDS = ["'Point'", "'LineString'", "'Polygon'", "'MultiPoint'", "'MultiLineString'", "'MultiPolygon'", "'GeometryCollection'"]


@query(f"SELECT p_partkey AS id, {d.by_kind(KINDS, 'p_partkey')} AS type, 4326 AS srid, CASE WHEN p_partkey % 7 = 0 THEN (p_partkey % 1000 - 500)::DOUBLE END AS x, CASE WHEN p_partkey % 7 = 0 THEN (p_partkey * 7 % 160 - 80)::DOUBLE END AS y FROM part")
def g01_accessors(spark, sf_dir):
    s = d.shape_values(spark, sf_dir).select("id", g.with_srid(F.col("g"), F.lit(4326)).alias("g"))
    return s.select("id", F.col("g.type").alias("type"), F.col("g.srid").alias("srid"), g.x(F.col("g")).alias("x"), g.y(F.col("g")).alias("y"))


_BOUNDARIES = [*d.SHAPE_TEXTS[:2], _TRACKS[2], *d.SHAPE_TEXTS[3:5], _TRACKS[5]]


@query("SELECT p_partkey AS id, " + d.by_kind([d.filled_sql(t, "p_partkey") for t in _BOUNDARIES] + ["NULL"], "p_partkey") + " AS t FROM part")
def g02_boundary(spark, sf_dir):
    return d.shape_values(spark, sf_dir).select("id", a.write_wkt(g.boundary(F.col("g"))).alias("t"))


@query("SELECT p_partkey AS id, " + d.filled_sql("LINESTRING (@0,0, @6,0, @6,6, @0,6, @0,0)", "p_partkey") + " AS exterior, 1 AS holes, " + d.filled_sql("LINESTRING (@1,1, @2,1, @2,2, @1,1)", "p_partkey") + " AS hole, NULL::VARCHAR AS second FROM part WHERE p_partkey % 7 = 2")
def g03_rings(spark, sf_dir):
    s = d.shape_values(spark, sf_dir).where("id % 7 = 2")
    ring = lambda n: a.write_wkt(g.ring(F.col("g"), F.lit(n)))
    return s.select("id", ring(0).alias("exterior"), g.num_interior_rings(F.col("g")).alias("holes"), ring(1).alias("hole"), ring(2).alias("second"))


@query(f"SELECT p_partkey AS id, {d.by_kind([1, 3, 2, 2, 2, 2, 2], 'p_partkey')} AS geometries, {d.by_kind([1, 3, 9, 2, 5, 12, 3], 'p_partkey')} AS points, (p_partkey % 1000 - 500)::DOUBLE AS first_x, {d.by_kind([0, 3, 1, 5, 5, 6, 3], 'p_partkey')} + p_partkey % 1000 - 500e0 AS last_x FROM part")
def g04_a03_points(spark, sf_dir):
    """Numbers of components and vertices, and the first and last vertex as an array holds them."""
    s = d.shape_values(spark, sf_dir).select("id", "g", g.vertices(F.col("g")).alias("v"))
    return s.select("id", g.num_geometries(F.col("g")).alias("geometries"), g.num_points(F.col("g")).alias("points"), F.col("v")[0]["x"].alias("first_x"), F.element_at("v", -1)["x"].alias("last_x"))


@query(f"SELECT p_partkey AS id, {d.by_kind(['0e0', '11e0', 'NULL', '0e0', 'round(2 * sqrt(2e0) + 5, 6)', '0e0', '5e0'], 'p_partkey')}::DOUBLE AS length, {d.by_kind([0, 0, 35.5, 0, 0, 9.5, 0], 'p_partkey')}::DOUBLE AS area, {d.by_kind([0, 0, 36, 0, 0, 10, 0], 'p_partkey')}::DOUBLE AS exterior, {d.by_kind([0, 1, 2, 0, 1, 2, 1], 'p_partkey')} AS dimension FROM part")
def a04_a07_a09_measures(spark, sf_dir):
    """Length (null for polygons), areas and dimension of all types."""
    c = F.col("g")
    return d.shape_values(spark, sf_dir).select("id", F.round(g.length(c), 6).alias("length"), F.round(g.area(c), 6).alias("area"), F.round(g.area(c, exterior_only=True), 6).alias("exterior"), g.dimension(c).alias("dimension"))


_CX, _CY = ["0e0", "1.5e0", "3e0", "2.5e0", "2.5e0", "4e0", "1.5e0"], ["0e0", "5e0", "3e0", "2.5e0", "2e0", "4e0", "2e0"]


@query(f"SELECT p_partkey AS id, {d.by_kind(_CX, 'p_partkey')} + p_partkey % 1000 - 500 AS cx, {d.by_kind(_CY, 'p_partkey')} + p_partkey * 7 % 160 - 80 AS cy FROM part")
def a08_centroid_all_types(spark, sf_dir):
    """Of polygons that of the exterior ring, of other types that of the bounds."""
    s = d.shape_values(spark, sf_dir).select("id", g.centroid(F.col("g")).alias("c"))
    return s.select("id", F.round("c.x", 6).alias("cx"), F.round("c.y", 6).alias("cy"))


@query("SELECT p_partkey % 300 AS upload, CASE WHEN count(*) = 1 THEN min(k) WHEN count(DISTINCT k) = 1 THEN 'Multi' || min(k) ELSE 'GeometryCollection' END AS type, sum(n)::BIGINT AS points FROM (SELECT p_partkey, CASE WHEN p_partkey % 300 < 100 OR p_partkey % 7 = 0 THEN 'Point' ELSE 'LineString' END AS k, CASE WHEN p_partkey % 300 < 100 OR p_partkey % 7 = 0 THEN 1 ELSE 3 END AS n FROM part WHERE p_partkey % 7 < 2) GROUP BY 1")
def a10_reduce_geometries(spark, sf_dir):
    """The geometries of an upload reduced to one of their lowest common type."""
    s = d.shape_values(spark, sf_dir).where("id % 7 < 2").select("id", F.when(F.col("id") % 300 < 100, g.point(F.lit(1.0), F.lit(2.0))).otherwise(F.col("g")).alias("g"))
    r = s.groupBy((F.col("id") % 300).alias("upload")).agg(g.reduced(F.flatten(F.collect_list("g.parts"))).alias("g"))
    return r.select("upload", F.col("g.type").alias("type"), g.num_points(F.col("g")).cast("long").alias("points"))


@query("SELECT p_partkey AS id, p_partkey % 7 = 4 AND p_partkey % 2 = 0 AS all_closed FROM part WHERE p_partkey % 7 IN (1, 4)")
def a21_all_closed(spark, sf_dir):
    t = F.when((F.col("p_partkey") % 7 == 4) & (F.col("p_partkey") % 2 == 0), d.filled("MULTILINESTRING ((@0,0, @1,1, @0,0), (@2,0, @5,4, @2,0))", "p_partkey")).when(F.col("p_partkey") % 7 == 4, d.filled(d.SHAPE_TEXTS[4], "p_partkey")).otherwise(d.filled(d.SHAPE_TEXTS[1], "p_partkey"))
    p = d.dealt(d.table(spark, sf_dir, "part"), "p_partkey").where("p_partkey % 7 in (1, 4)")
    return p.select(F.col("p_partkey").alias("id"), g.is_closed(a.read_ewkt(t)).alias("all_closed"))


@query(f"WITH {d.SHAPES}, p AS (SELECT id, id * 7 % 160 AS y, id % 3 AS turned FROM shapes WHERE id % 7 = 2) SELECT a.id AS first, count(*) AS equal FROM p a JOIN p b ON (a.id - b.id) % 1000 = 0 AND a.y = b.y GROUP BY a.id")
def x03_equal_geometries(spark, sf_dir):
    """Polygons with the same vertices: found by a hash of them in order, rings begun at another vertex or turned round."""
    texts = [d.SHAPE_TEXTS[2], "POLYGON ((@6,0, @6,6, @0,6, @0,0, @0,0), (@1,1, @2,1, @2,2, @1,1))", "POLYGON ((@0,0, @0,6, @6,6, @6,0, @0,0), (@1,1, @2,2, @2,1, @1,1))"]
    t = F.lit(None).cast("string")
    for i, x in enumerate(texts):
        t = F.when(F.col("p_partkey") % 3 == i, d.filled(x, "p_partkey")).otherwise(t)
    p = d.dealt(d.table(spark, sf_dir, "part"), "p_partkey").where("p_partkey % 7 = 2").select(F.col("p_partkey").alias("id"), a.read_ewkt(t).alias("g"))
    p = p.withColumn("k", F.xxhash64(F.array_sort(g.vertices(F.col("g")))))
    q = p.select(F.col("id").alias("id_"), F.col("g").alias("g_"), "k")
    return p.join(q, "k").where(g.same_vertices(F.col("g"), F.col("g_"))).groupBy(F.col("id").alias("first")).agg(F.count("*").alias("equal"))


@query(f"WITH {d.SHAPES}, p AS (SELECT id, id % 1000 AS x, id * 7 % 160 AS y FROM shapes WHERE id % 7 = 2) SELECT id, min(id) OVER w AS class, count(*) OVER w AS size FROM p WINDOW w AS (PARTITION BY x, y)")
def x03_equality_classes(spark, sf_dir):
    """Of each polygon the class of those with the same vertices: met by hash, each held against one of the class, no pairs."""
    texts = [d.SHAPE_TEXTS[2], "POLYGON ((@6,0, @6,6, @0,6, @0,0, @0,0), (@1,1, @2,1, @2,2, @1,1))", "POLYGON ((@0,0, @0,6, @6,6, @6,0, @0,0), (@1,1, @2,2, @2,1, @1,1))"]
    t = F.lit(None).cast("string")
    for i, x in enumerate(texts):
        t = F.when(F.col("p_partkey") % 3 == i, d.filled(x, "p_partkey")).otherwise(t)
    p = d.dealt(d.table(spark, sf_dir, "part"), "p_partkey").where("p_partkey % 7 = 2").select(F.col("p_partkey").alias("id"), a.read_ewkt(t).alias("g"))
    return equality_classes(p)


@query("SELECT c_custkey AS upload, round(sqrt(greatest(pow((c_custkey % 5), 2) + 9, pow(5 - c_custkey % 5, 2) + 9)), 6) AS hausdorff FROM customer")
def a20_hausdorff(spark, sf_dir):
    k = F.col("c_custkey") % 5
    c = d.dealt(d.table(spark, sf_dir, "customer"), "c_custkey")
    one = g.line(F.array(g.vertex(F.lit(0), F.lit(0)), g.vertex(F.lit(5), F.lit(0))))
    two = g.line(F.array(g.vertex(k, F.lit(3)), g.vertex(k, F.lit(3))))
    return c.select(F.col("c_custkey").alias("upload"), F.round(g.hausdorff(one, two), 6).alias("hausdorff"))


@query("SELECT c_custkey AS upload, CASE WHEN c_custkey % 30 <= 10 THEN c_custkey % 30 ELSE least(20, c_custkey % 30) END::DOUBLE AS at, round(least(20, c_custkey % 30) / 20e0, 6) AS share FROM customer")
def w09_project(spark, sf_dir):
    """How far along a line with one corner the nearest place to a point lies."""
    k = F.col("c_custkey") % 30
    line = g.line(F.array(g.vertex(F.lit(0), F.lit(0)), g.vertex(F.lit(10), F.lit(0)), g.vertex(F.lit(10), F.lit(10))))
    x, y = F.when(k <= 10, k).otherwise(10.5).cast("double"), F.when(k <= 10, -1).otherwise(k - 10).cast("double")
    return d.dealt(d.table(spark, sf_dir, "customer"), "c_custkey").select(F.col("c_custkey").alias("upload"), F.round(g.project(line, x, y), 6).alias("at"), F.round(g.project(line, x, y, True), 6).alias("share"))


@query("SELECT c_custkey AS upload, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'few vertices' WHEN 2 THEN 'not closed' ELSE 'few vertices,not closed' END AS reasons FROM customer")
def g09_validity(spark, sf_dir):
    """Reasons why polygons are not valid."""
    texts = ["POLYGON ((@0,0, @1,0, @1,1, @0,0))", "POLYGON ((@0,0, @1,0, @0,0))", "POLYGON ((@0,0, @1,0, @1,1, @0,1))", "POLYGON ((@0,0, @1,0, @1,1))"]
    t = F.lit(None).cast("string")
    for i, x in enumerate(texts):
        t = F.when(F.col("c_custkey") % 4 == i, d.filled(x, "c_custkey")).otherwise(t)
    return d.dealt(d.table(spark, sf_dir, "customer"), "c_custkey").select(F.col("c_custkey").alias("upload"), F.array_join(g.invalid_because(a.read_ewkt(t)), ",").alias("reasons"))


@query("SELECT c_custkey AS upload, c_custkey % 1000 - 500 + CASE WHEN c_custkey % 2 = 0 THEN 0.5 ELSE 3 END::DOUBLE AS x, c_custkey * 7 % 160 - 80 + CASE WHEN c_custkey % 2 = 0 THEN 5 ELSE 3 END::DOUBLE AS y FROM customer")
def g11_point_on_surface(spark, sf_dir):
    """The centroid of a square, and a point in the back of a C, whose centroid lies outside."""
    t = F.when(F.col("c_custkey") % 2 == 0, d.filled("POLYGON ((@0,0, @10,0, @10,1, @1,1, @1,9, @10,9, @10,10, @0,10, @0,0))", "c_custkey")).otherwise(d.filled("POLYGON ((@0,0, @6,0, @6,6, @0,6, @0,0))", "c_custkey"))
    s = d.dealt(d.table(spark, sf_dir, "customer"), "c_custkey").select(F.col("c_custkey").alias("upload"), g.point_on_surface(a.read_ewkt(t)).alias("p"))
    return s.select("upload", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


_BITS = "(SELECT string_agg(substr('0123456789bcdefghjkmnpqrstuvwxyz', (list_sum(list_transform(range(0, 5), lambda b: (CASE WHEN (5 * i + b) % 2 = 0 THEN ({x} >> (19 - (5 * i + b) // 2)) & 1 ELSE ({y} >> (19 - (5 * i + b) // 2)) & 1 END) << (4 - b)))::INT) + 1, 1), '' ORDER BY i) FROM range(0, 8) t(i))"


@query(
    "WITH c AS (SELECT c_custkey AS upload, (c_custkey * 7919 % 36000) / 100e0 - 180 AS x, (c_custkey * 104729 % 17000) / 100e0 - 85 AS y FROM customer), "
    "e AS (SELECT upload, greatest(ceil((x + 180) / 360 * 1048576) - 1, 0)::BIGINT AS x0, greatest(ceil((x + 0.01e0 + 180) / 360 * 1048576) - 1, 0)::BIGINT AS x1, greatest(ceil((y + 90) / 180 * 1048576) - 1, 0)::BIGINT AS y0, greatest(ceil((y + 0.01e0 + 90) / 180 * 1048576) - 1, 0)::BIGINT AS y1 FROM c), "
    f"h AS (SELECT upload, {_BITS.format(x='x0', y='y0')} AS a, {_BITS.format(x='x1', y='y1')} AS b, {_BITS.format(x='x0', y='y1')} AS c, {_BITS.format(x='x1', y='y0')} AS d FROM e) "
    "SELECT upload, substr(a, 1, coalesce(list_max(list_filter(range(0, 9), lambda n: substr(a, 1, n) = substr(b, 1, n) AND substr(a, 1, n) = substr(c, 1, n) AND substr(a, 1, n) = substr(d, 1, n))), 0)::INT) AS code FROM h"
)
def g06_geohash_of_lines(spark, sf_dir):
    """Of a short line the common start of the geohashes of its bounds' corners."""
    s = d.springs(spark, sf_dir)
    line = g.line(F.array(g.vertex(F.col("lon"), F.col("lat")), g.vertex(F.col("lon") + 0.01, F.col("lat") + 0.01)))
    return s.select("upload", g.geohash_of(line, 8).alias("code"))


@query(f"WITH {d.SPRINGS}, c AS (SELECT upload, greatest(ceil((lon + 180) / 360 * 1024) - 1, 0) AS i, greatest(ceil((lat + 90) / 180 * 1024) - 1, 0) AS j FROM springs), b AS (SELECT upload, i * 360 / 1024 - 180 AS x0, (i + 1) * 360 / 1024 - 180 AS x1, j * 180 / 1024 - 90 AS y0, (j + 1) * 180 / 1024 - 90 AS y1 FROM c) SELECT upload, round((x0 + x1) / 2, 0) + 0 AS cx, round((y0 + y1) / 2, 0) + 0 AS cy, x0 AS west, y1 AS north, (x1 - x0) * (y1 - y0) AS area FROM b")
def g07_geohash_cells(spark, sf_dir):
    """A cell's rounded middle, and the cell as a polygon."""
    from ..functions import geo

    s = d.springs(spark, sf_dir).select("upload", geo.geohash(F.col("lon"), F.col("lat"), 4).alias("code"))
    s = s.select("upload", g.geohash_centre(F.col("code")).alias("c"), g.geohash_polygon(F.col("code")).alias("g"))
    return s.select("upload", (F.round("c.x", 0) + 0).alias("cx"), (F.round("c.y", 0) + 0).alias("cy"), g.vertices(F.col("g"))[0]["x"].alias("west"), g.vertices(F.col("g"))[0]["y"].alias("north"), g.area(F.col("g")).alias("area"))


@query("SELECT a AS k, CASE a % 4 WHEN 0 THEN 'Intersection' WHEN 1 THEN 'Coincident' WHEN 2 THEN 'Parallel' END AS status, CASE WHEN a % 4 = 0 THEN 2e0 END AS x, CASE WHEN a % 4 = 0 THEN 2e0 END AS y FROM (SELECT c_custkey AS a FROM customer)")
def j11_segment_meetings(spark, sf_dir):
    """How two segments meet, and where."""
    seg = lambda *v: F.struct(g.vertex(F.lit(v[0]), F.lit(v[1])).alias("a"), g.vertex(F.lit(v[2]), F.lit(v[3])).alias("b"))
    k = F.col("c_custkey") % 4
    other = F.when(k == 0, seg(0, 4, 4, 0)).when(k == 1, seg(1, 1, 6, 6)).when(k == 2, seg(0, 1, 4, 5)).otherwise(seg(9, 0, 9, 4))
    s = d.dealt(d.table(spark, sf_dir, "customer"), "c_custkey").select(F.col("c_custkey").alias("k"), g.meeting(seg(0, 0, 4, 4), other).alias("m"))
    return s.select("k", "m.status", "m.x", "m.y")


@query("WITH p AS (SELECT p_partkey AS id, p_partkey * 3 % 200 + p_partkey // 2000 * 200 AS x, p_partkey * 7 % 160 AS y FROM part) SELECT a.id AS first, b.id AS second, TRUE AS intersects, greatest(abs(a.x - b.x), abs(a.y - b.y)) = 6 AS touches, greatest(abs(a.x - b.x), abs(a.y - b.y)) < 6 AND (a.x <> b.x OR a.y <> b.y) AS overlaps FROM p a JOIN p b ON a.id < b.id AND abs(a.x - b.x) <= 6 AND abs(a.y - b.y) <= 6")
def j15_predicates(spark, sf_dir):
    """Pairs of squares that meet, and how: candidates by the cells of their bounds, then the matrix of each pair."""
    from ..functions import relations as r
    from ..operators import spatial

    x, y = F.col("p_partkey") * 3 % 200 + F.floor(F.col("p_partkey") / 2000) * 200, F.col("p_partkey") * 7 % 160
    square = g.polygon(F.array(F.array(*[g.vertex(x + i, y + j) for i, j in ((0, 0), (6, 0), (6, 6), (0, 6), (0, 0))])))
    s = d.dealt(d.table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("id"), square.alias("g"))
    p = spatial.box_pairs(s, 8.0).select(F.col("id").alias("first"), F.col("id_").alias("second"), r.matrix(F.col("g"), F.col("g_")).alias("m"))
    p = p.where(r.predicate("intersects", F.col("m")))
    return p.select("first", "second", F.lit(True).alias("intersects"), r.predicate("touches", F.col("m")).alias("touches"), r.overlaps(F.col("m"), 2, 2).alias("overlaps"))
