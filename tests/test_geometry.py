import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldstrata.functions import geo, images, ingest, shapes
from fieldstrata.operators import catalog, measures
from fieldstrata.sources import formats
from fieldstrata.streaming import ingest as streams


def vertices(spark, *rings):
    return spark.createDataFrame([(1, r, i, float(x), float(y)) for r, ring in enumerate(rings) for i, (x, y) in enumerate(ring, 1)], "geom int, ring int, seq int, x double, y double")


def test_lengths(spark):
    r = measures.lengths(vertices(spark, [(30, 10), (10, 30), (40, 40)])).first()
    assert r.planar == pytest.approx(59.907048, abs=1e-6)
    assert r.metres == pytest.approx(5979752.540206, abs=1e-3)


def test_area_and_centroid_with_hole(spark):
    v = vertices(spark, [(35, 10), (10, 20), (15, 40), (45, 45), (35, 10)], [(20, 30), (35, 35), (30, 20), (20, 30)])
    assert measures.area(v).first().area == pytest.approx(675)
    c = measures.centroid(v).first()
    assert (c.cx, c.cy) == (pytest.approx(27.526882, abs=1e-6), pytest.approx(28.709677, abs=1e-6))


def test_opposite_points_and_equal_points(spark):
    a = vertices(spark, [(3.95626, 50.45409), (-176.04374, -50.45409)])
    assert measures.lengths(a).first().metres == pytest.approx(20037508.342789, abs=1e-3)
    b = measures.lengths(vertices(spark, [(1, 2), (1, 2), (1, 2)])).first()
    assert (b.metres, b.degrees) == (0.0, pytest.approx(0.0, abs=1e-6))


def test_geohash_cell(spark):
    b = spark.range(1).select(geo.geohash_bounds(F.lit("xpssc0")).alias("b")).first().b
    assert (b.x0, b.x1, b.y0, b.y1) == (141.3720703125, 141.383056640625, 43.0224609375, 43.0279541015625)
    assert spark.range(1).select(geo.geohash(F.lit(141.375), F.lit(43.025), 6)).first()[0] == "xpssc0"


def test_name_uuid(spark):
    u = spark.range(1).select(ingest.name_uuid("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.lit("www.example.com"))).first()[0]
    assert u == "2ed6657d-e927-568b-95e1-2665a8aea6a2"


@pytest.mark.parametrize("box, size", [((120, 30), (60, 30)), ((20, 30), (20, 10)), ((20, 100), (20, 10))])
def test_fit_inside(spark, box, size):
    w, h = images.fit_inside(F.lit(100), F.lit(50), F.lit(box[0]), F.lit(box[1]))
    assert tuple(spark.range(1).select(w, h).first()) == size


@pytest.mark.parametrize("box, size", [((120, 30), (120, 60)), ((20, 30), (60, 30)), ((20, 100), (200, 100))])
def test_fit_outside(spark, box, size):
    w, h = images.fit_outside(F.lit(100), F.lit(50), F.lit(box[0]), F.lit(box[1]))
    assert tuple(spark.range(1).select(w, h).first()) == size


def test_wkt_reader(spark):
    texts = ["point(1 2)", "SRID=4326;LINESTRING (1 2, 3 4)", "POLYGON EMPTY", "nothing", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(formats.read_wkt(F.col("t"))).collect()]
    assert (got[0].type, got[0].srid, got[0].rings[0][0].x) == ("Point", None, 1.0)
    assert (got[1].srid, len(got[1].rings[0])) == (4326, 2)
    assert got[2].rings == [] and got[3] is None and got[4] is None


def test_hull_and_simplify():
    g = np.random.default_rng(1).random((200, 2))
    h = shapes.hull(g)
    nxt = np.roll(h, -1, axis=0)
    for p in g:
        assert ((nxt[:, 0] - h[:, 0]) * (p[1] - h[:, 1]) - (nxt[:, 1] - h[:, 1]) * (p[0] - h[:, 0]) >= -1e-12).all()
    line = np.array([(x, 0.0) for x in range(10)])
    assert shapes.keep_simple(line, 0.1).sum() == 2


def test_mercator_round_trip(spark):
    x, y = geo.mercator(F.lit(12.5), F.lit(-33.25))
    lon, lat = geo.from_mercator(x, y)
    assert tuple(spark.range(1).select(lon, lat).first()) == (pytest.approx(12.5), pytest.approx(-33.25))
    assert math.isclose(spark.range(1).select(x).first()[0], 1391493.6, abs_tol=1)


def test_sequential_ids(spark):
    ids = catalog.append_ids(spark, spark.range(1000).withColumnRenamed("id", "k"), ["k"], 7).orderBy("k").collect()
    assert [r.id for r in ids] == list(range(7, 1007))


def test_track_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    gpx = '<gpx><trk><trkseg><trkpt lat="1.5" lon="2.5"><ele>3.0</ele><time>2024-01-01T00:00:00Z</time></trkpt></trkseg></trk></gpx>'
    for name in ("t1.gpx", "t2.gpx"):
        (src / name).write_text(gpx)
        streams.track_stream(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("track").collect()
    assert [(r.track, r.lon, r.lat, r.ele) for r in got] == [("t1", 2.5, 1.5, 3.0), ("t2", 2.5, 1.5, 3.0)]
