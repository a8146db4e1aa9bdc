"""Image plans and annotations against known values."""

import pytest
from pyspark.sql import functions as F

from fieldstrata.functions import annotations as an
from fieldstrata.functions import images as g

SIZES = [
    ("inside", "any", 120, 30, 60, 30), ("inside", "any", 20, 30, 20, 10), ("inside", "any", 20, 100, 20, 10), ("outside", "any", 120, 30, 120, 60), ("outside", "any", 20, 30, 60, 30), ("outside", "any", 20, 100, 200, 100),
    ("inside", "down", 120, 60, 100, 50), ("inside", "down", 120, 40, 80, 40), ("inside", "down", 90, 60, 90, 45), ("outside", "down", 90, 60, 100, 50), ("outside", "down", 90, 30, 90, 45), ("inside", "up", 120, 60, 120, 60),
    ("inside", "up", 120, 40, 100, 50), ("outside", "up", 120, 40, 120, 60), ("outside", "up", 90, 60, 120, 60), ("fill", "any", 30, 90, 30, 90), ("fill", "down", 300, 90, 100, 50),
]


def test_resize(spark):
    cols = [F.struct(*g.resized(F.lit(100), F.lit(50), F.lit(bw), F.lit(bh), fit, scale)).alias(f"c{i}") for i, (fit, scale, bw, bh, _, _) in enumerate(SIZES)]
    assert [tuple(v) for v in spark.range(1).select(*cols).first()] == [s[4:] for s in SIZES]
    w, h = g.resized(F.lit(100), F.lit(50), F.lit(60), F.lit(None).cast("int"))
    assert tuple(spark.range(1).select(w, h).first()) == (60, 30)


COORDINATES = [("100%-50%", 200, None, 100), ("50%     -20", 300, None, 130), ("center", 300, 120, 90), ("bottom+20", 300, 120, 200), ("100--++++-10", 200, None, 90), ("5+2+", 200, None, None), ("", 200, None, None), (None, 200, None, None), ("-10", 200, None, -10), ("right - center", 200, None, 100), ("no place", 200, None, None)]


def test_coordinates(spark):
    rows = spark.createDataFrame(COORDINATES, "t string, n int, o int, want int")
    plain, other = g.coordinate(F.col("t"), F.col("n")), g.coordinate(F.col("t"), F.col("n"), F.col("o"))
    for r in rows.select("t", "want", F.when(F.col("o").isNull(), plain).otherwise(other).alias("got")).collect():
        assert r.got == r.want, r.t


def test_affine_inverse(spark):
    m = (2.0, 1.0, -1.0, 2.0, 10.0, -5.0)
    x, y = g.affine(*g.affine(F.lit(3.0), F.lit(4.0), m), g.inverse(m))
    assert tuple(spark.range(1).select(x, y).first()) == pytest.approx((3, 4))
    with pytest.raises(ValueError):
        g.inverse((1.0, 2.0, 2.0, 4.0, 0.0, 0.0))


XML = '<doc><image><gobject type="poly" name="a &amp; b"><vertex x="1" y="2" index="1"/><vertex x="3" index="0"/><tag name="k" value="v"/><gobject type="dot"><vertex x="9" y="9"/></gobject></gobject></image></doc>'


def test_annotations_inside_a_wrapper(spark):
    docs = spark.createDataFrame([(1, XML), (2, "<broken"), (3, None)], "doc long, xml string")
    rows = {r.path: r for r in an.flatten_annotations(docs).collect()}
    assert set(rows) == {"/0", "/0/0", "/0/0/0"} and rows["/0/0"].tags == {"k": "v"} and rows["/0/0"].name == "a & b"
    assert [(v.x, v.y, v["index"]) for v in rows["/0/0"].vertices] == [(3, None, 0), (1, 2, 1)]
    assert sorted(r.doc for r in an.malformed(docs).collect()) == [2, 3]
    lines = [r.line for r in an.csv_lines(an.flatten_annotations(docs)).orderBy("path", "n").collect()]
    assert lines == ["image,,", "poly,a & b, 3,,,,,0", " 1,2,,,,1", "dot,, 9,9,,,,"]
    again = an.flatten_annotations(an.to_xml(an.flatten_annotations(docs)))
    assert again.count() == 3
