"""Geometry formats: every type written, read and written again in every format; odd input."""

import pytest
from pyspark.sql import functions as F

from fieldstrata.functions import geometry as g
from fieldstrata.sources import adapters as a

SHAPES = {
    "point": "POINT (30 10)",
    "line": "LINESTRING (30 10, 10 30, 40 40.5)",
    "polygon": "POLYGON ((30 10, 10 20, 20 40, 40 40, 30 10))",
    "hole": "POLYGON ((35 10, 10 20, 15 40, 45 45, 35 10), (20 30, 35 35, 30 20, 20 30))",
    "points": "MULTIPOINT ((10 40), (40 30), (20 20))",
    "lines": "MULTILINESTRING ((10 10, 20 20, 10 40), (40 40, 30 30, 40 20, 30 10))",
    "polygons": "MULTIPOLYGON (((30 20, 10 40, 45 40, 30 20)), ((15 5, 40 10, 10 20, 5 10, 15 5), (12 8, 13 9, 11 9, 12 8)))",
    "mixed": "GEOMETRYCOLLECTION (POINT (4 6), LINESTRING (4 6, 7 10), POLYGON ((0 0, 1 0, 1 1, 0 0)))",
}


def texts(spark, rows):
    return spark.createDataFrame(list(rows.items()), "name string, t string")


def test_text_is_stable(spark):
    df = texts(spark, SHAPES).select("name", "t", a.write_wkt(a.read_ewkt(F.col("t"))).alias("again"))
    assert all(r.t == r.again for r in df.collect())
    df = texts(spark, {k: "SRID=4326;" + v for k, v in SHAPES.items()}).select("t", a.write_ewkt(a.read_ewkt(F.col("t"))).alias("again"))
    assert all(r.t == r.again for r in df.collect())


@pytest.mark.parametrize("kind", ["geojson", "kml", "gpx", "georss", "wkb", "ewkb", "wkb_hex", "ewkb_hex"])
def test_formats_are_stable(spark, kind):
    """What a format keeps of a geometry comes back; a second round changes nothing."""
    df = a.out(texts(spark, SHAPES).select("name", "t", a.read_ewkt(F.col("t")).alias("w")), "w", kind)
    df = a.load(df.withColumn("g", F.col("w")), "g", kind).withColumn("again", a.write_wkt(F.col("g")))
    df = a.out(df, "g", kind).withColumnRenamed("g", "w2")
    for r in df.collect():
        if kind == "georss" and r.name == "hole":  # of a polygon the exterior
            assert r.again == "POLYGON ((35 10, 10 20, 15 40, 45 45, 35 10))"
        elif kind == "georss" and r.name in ("polygons", "mixed"):
            assert r.again.startswith(("MULTIPOLYGON", "GEOMETRYCOLLECTION"))
        elif kind == "gpx" and r.name in ("polygon", "hole", "polygons", "mixed"):  # rings become tracks
            assert "LINESTRING" in r.again
        else:
            assert r.again == r.t, r.name
        assert r.w == r.w2


def test_empty_odd_and_upper_case(spark):
    rows = {"e": "POLYGON EMPTY", "pe": "POINT EMPTY", "ce": "GEOMETRYCOLLECTION EMPTY", "one": "LINESTRING (1 2)", "bad": "POINT (a b)", "none": "hello", "open": "POLYGON ((1 2, 3 4", "low": "multipoint (1 2, 3 4)", "z": "POINT Z (1 2 3)", "tiny": "POINT (0.00001 12345678)"}
    r = {x.name: x for x in texts(spark, rows).withColumn("g", a.read_ewkt(F.col("t"))).select("name", a.write_wkt(F.col("g")).alias("w"), g.is_empty(F.col("g")).alias("e")).collect()}
    assert r["e"].w == "POLYGON EMPTY" and r["e"].e and r["ce"].w == "GEOMETRYCOLLECTION EMPTY"
    assert [r[k].w for k in ("pe", "one", "bad", "none", "open")] == [None] * 5
    assert r["low"].w == "MULTIPOINT ((1 2), (3 4))" and r["z"].w == "POINT (1 2)" and r["tiny"].w == "POINT (0.00001 12345678)"


def test_json_features_merge(spark):
    rows = {
        "feature": '{"type":"Feature","properties":{"a":1},"geometry":{"type":"LineString","coordinates":[[1,2],[3,4,9]]}}',
        "many": '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]}},{"type":"Feature","geometry":{"type":"Point","coordinates":[3,4]}}]}',
        "mixed": '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]}},{"type":"Feature","geometry":{"type":"LineString","coordinates":[[1,2],[3,4]]}}]}',
        "bad": "{nope", "other": '{"type":"Circle"}',
    }
    r = {x.name: x.w for x in texts(spark, rows).select("name", a.write_wkt(a.read_geojson(F.col("t"))).alias("w")).collect()}
    assert r == {"feature": "LINESTRING (1 2, 3 4)", "many": "MULTIPOINT ((1 2), (3 4))", "mixed": "GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (1 2, 3 4))", "bad": None, "other": None}


def test_xml_documents(spark):
    kml = '<kml xmlns="http://earth.google.com/kml/2.0"><Placemark><description><![CDATA[<Point> x]]></description><MultiGeometry><Point><coordinates>1,2,0</coordinates></Point><LineString><coordinates> 1,2 3,4,5\n </coordinates></LineString></MultiGeometry></Placemark></kml>'
    gpx = '<gpx><wpt lat="1" lon="2"><name>a</name></wpt><trk><trkseg><trkpt lat="1" lon="1"/></trkseg><trkseg><trkpt lat="2" lon="2"/></trkseg></trk><rte><rtept lat="5" lon="6"/><rtept lat="7" lon="8"/></rte></gpx>'
    rss = '<feed xmlns:georss="http://www.georss.org/georss"><entry><georss:point>45.256 -71.92</georss:point></entry><entry><georss:box>42.943 -71.032 43.039 -69.856</georss:box></entry><entry><georss:circle>42.9 -71.0 500</georss:circle></entry></feed>'
    df = texts(spark, {"kml": kml, "gpx": gpx, "rss": rss, "bad": "<kml><Point>"})
    r = {x.name: x for x in df.select("name", a.write_wkt(a.read_kml(F.col("t"))).alias("k"), a.write_wkt(a.read_gpx(F.col("t"))).alias("x"), a.write_wkt(a.read_georss(F.col("t"))).alias("r"), a.georss_radii(F.col("t")).alias("radii")).collect()}
    assert r["kml"].k == "GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (1 2, 3 4))"
    assert r["gpx"].x == "GEOMETRYCOLLECTION (POINT (2 1), LINESTRING (1 1, 2 2), LINESTRING (6 5, 8 7))"
    assert r["rss"].r == "GEOMETRYCOLLECTION (POINT (-71.92 45.256), POLYGON ((-71.032 42.943, -69.856 42.943, -69.856 43.039, -71.032 43.039, -71.032 42.943)), POINT (-71 42.9))"
    assert r["rss"].radii == [500.0] and r["bad"].k is None and r["bad"].r is None


def test_bytes_that_are_no_geometry(spark):
    df = spark.createDataFrame([("be", bytes.fromhex("0000000001") + bytes(16)), ("short", b"\x01\x01"), ("null", None), ("z", bytes.fromhex("0101000080") + bytes(24))], "name string, b binary")
    r = {x.name: x.w for x in a.wkb_to_geometry(df, "b").select("name", a.write_wkt(F.col("b")).alias("w")).collect()}
    assert r == {"be": None, "short": None, "null": None, "z": "POINT (0 0)"}


def test_convert_by_looks(spark):
    rows = {"wkt": "POINT (1 2)", "ewkt": "SRID=4326;POINT (1 2)", "json": '{"type":"Point","coordinates":[1,2]}', "kml": "<Point><coordinates>1,2</coordinates></Point>", "gpx": '<gpx><wpt lat="2" lon="1"/></gpx>', "rss": "<e><point>2 1</point></e>", "hex": "0101000000000000000000F03F0000000000000040"}
    got = {x.name: x.t for x in a.convert(texts(spark, rows), "t", None, "wkt").collect()}
    assert set(got.values()) == {"POINT (1 2)"}
    code = a.convert(texts(spark, {"h": "xpssc0"}), "t", "geohash", "wkt").first().t
    assert code == "POINT (141.4 43.03)"
    a.register("plain", None, lambda c: F.concat_ws(" ", g.x(c), g.y(c)))
    assert a.convert(texts(spark, {"p": "POINT (1 2)"}), "t", "wkt", "plain").first().t == "1.0 2.0"


def one(spark, wkt, of):
    return spark.createDataFrame([(wkt,)], "t string").select(of(a.read_ewkt(F.col("t"))).alias("v")).first().v


def test_accessors(spark):
    wkt = lambda f: lambda c: a.write_wkt(f(c))
    assert one(spark, SHAPES["hole"], wkt(g.boundary)) == "MULTILINESTRING ((35 10, 10 20, 15 40, 45 45, 35 10), (20 30, 35 35, 30 20, 20 30))"
    assert one(spark, SHAPES["polygon"], wkt(g.boundary)).startswith("LINESTRING (30 10") and one(spark, SHAPES["mixed"], wkt(g.boundary)) is None
    assert one(spark, SHAPES["hole"], wkt(lambda c: g.ring(c, F.lit(1)))) == "LINESTRING (20 30, 35 35, 30 20, 20 30)"
    assert one(spark, SHAPES["hole"], g.num_interior_rings) == 1 and one(spark, SHAPES["line"], g.num_geometries) == 3
    assert one(spark, SHAPES["lines"], g.num_points) == 7 and one(spark, SHAPES["lines"], g.num_geometries) == 2
    assert one(spark, SHAPES["lines"], g.length) == pytest.approx(78.929222, abs=1e-6) and one(spark, SHAPES["polygon"], g.length) is None
    assert one(spark, "LINESTRING (30 10, 10 30, 40 40)", g.metres) == pytest.approx(5979752.540206, abs=1e-3)
    assert one(spark, SHAPES["hole"], g.area) == 675 and one(spark, SHAPES["polygon"], lambda c: g.area(c, signed=True)) == -550
    assert one(spark, "MULTIPOLYGON (((30 20, 10 40, 45 40, 30 20)), ((15 5, 40 10, 10 20, 5 10, 15 5)))", g.area) == 612.5
    c = one(spark, SHAPES["hole"], g.centroid)
    assert (c.x, c.y) == (pytest.approx(27.526882, abs=1e-6), pytest.approx(28.709677, abs=1e-6))
    c = one(spark, SHAPES["points"], g.centroid)
    assert (c.x, c.y) == (25, 30)
    assert one(spark, "POLYGON ((0 0, 1 0, 1 1))", g.invalid_because) == ["few vertices", "not closed"]
    assert one(spark, "LINESTRING (0 0, 10 0, 10 10)", lambda c: g.project(c, F.lit(12.0), F.lit(5.0))) == 15
    assert one(spark, "LINESTRING (0 0, 10 0, 10 10)", lambda c: g.project(c, F.lit(12.0), F.lit(5.0), True)) == 0.75
    p = one(spark, "POLYGON ((0 0, 10 0, 10 1, 1 1, 1 9, 10 9, 10 10, 0 10, 0 0))", g.point_on_surface)
    assert (p.x, p.y) == (0.5, 5)
    assert one(spark, "LINESTRING (141.373 43.023, 141.38 43.027)", g.geohash_of) == "xpssc0"
    assert one(spark, "MULTILINESTRING ((0 0, 1 1, 0 0), (2 2, 3 3, 2 2))", g.is_closed) and not one(spark, SHAPES["lines"], g.is_closed)


def test_predicates(spark):
    square = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))"
    cases = [
        ("POLYGON ((2 2, 6 2, 6 6, 2 6, 2 2))", "intersects overlaps"), ("POLYGON ((4 0, 8 0, 8 4, 4 4, 4 0))", "intersects touches"), ("POLYGON ((5 5, 6 5, 6 6, 5 5))", "disjoint"),
        ("POLYGON ((1 1, 2 1, 2 2, 1 1))", "intersects"), ("LINESTRING (4 4, 6 6)", "intersects touches"), ("LINESTRING (-1 2, 6 2)", "intersects"), ("LINESTRING (0 0, 4 4)", "intersects"), (square, "intersects"),
    ]
    df = spark.createDataFrame([(t, w) for t, w in cases], "t string, want string").withColumn("a", a.read_ewkt(F.lit(square))).withColumn("b", a.read_ewkt(F.col("t")))
    for r in df.select("t", "want", *[f(F.col("a"), F.col("b")).alias(n) for n, f in (("intersects", g.intersects), ("disjoint", g.disjoint), ("touches", g.touches), ("overlaps", g.overlaps))]).collect():
        assert " ".join(k for k in ("disjoint", "intersects", "overlaps", "touches") if r[k]) == r.want, r.t
