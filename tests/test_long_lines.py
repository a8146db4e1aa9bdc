"""Lines in slices against plain loops, and a line of a million places over many tasks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fieldstrata.functions.images import image_tiles, pyramid_levels, tiles
from fieldstrata.operators import long_lines as ll
from fieldstrata.operators import measures


def lines(rand):
    out = {0: [(float(i % 7), float(i)) for i in range(40)], 1: [(5.0, 5.0)], 2: [(1.0, 1.0)] * 5, 3: [(0.0, 0.0), (1000.0, 0.0), (1000.0, 1.0)]}
    return out | {k: [(rand.uniform(0, 30), rand.uniform(0, 30)) for _ in range(30)] for k in (4, 5)}


def test_running_lengths_and_places_equal_loops(spark):
    rand = random.Random(1)
    v = lines(rand)
    rows = [(k, 3 * i + i % 2, x, y) for k, ps in v.items() for i, (x, y) in enumerate(ps)]  # numbers with gaps
    df = spark.createDataFrame(rows, "geom int, seq int, x double, y double")
    got = {(r.geom, r.seq): (r.length, r.run) for r in ll.running_lengths(ll.sliced_segments(df, 7)).collect()}
    want, total, run_of = {}, {}, {}
    for k, ps in v.items():
        run = 0.0
        for i, (p, q) in enumerate(zip(ps, ps[1:], strict=False)):
            want[k, 3 * i + i % 2] = (math.dist(p, q), run)
            run_of[k, i] = run
            run += math.dist(p, q)
        total[k] = run
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    plain = measures.segments(df.withColumn("ring", F.lit(0)))
    assert plain.select("geom", "seq", "x2", "y2").exceptAll(ll.sliced_segments(df, 7).select("geom", F.col("seq").cast("int"), "x2", "y2")).count() == 0
    points = [(100 * k + j, k, rand.uniform(-50, 60) if j else 5000.0, rand.uniform(-50, 60)) for k in v for j in range(8)]
    found = {r.item: r for r in ll.project_points(spark.createDataFrame(points, "item int, geom int, px double, py double"), df, 7).collect()}
    for item, k, px, py in points:
        best = None
        for i, ((x, y), (u, w)) in enumerate(zip(v[k], v[k][1:], strict=False)):
            size = math.dist((x, y), (u, w))
            t = max(0.0, min(1.0, ((px - x) * (u - x) + (py - y) * (w - y)) / size**2)) if size else 0.0
            away = math.dist((x + t * (u - x), y + t * (w - y)), (px, py))
            if best is None or away < best[0] - 1e-12:
                best = (away, run_of[k, i] + t * size)
        if best is None:
            assert item not in found
        else:
            assert found[item].away == pytest.approx(best[0]) and found[item].at == pytest.approx(best[1])
            assert found[item].share == (pytest.approx(best[1] / total[k]) if total[k] else None)


def test_empty_lines(spark):
    v = spark.createDataFrame([], "geom int, seq int, x double, y double")
    p = spark.createDataFrame([(1, 1, 0.0, 0.0)], "item int, geom int, px double, py double")
    assert ll.running_lengths(ll.sliced_segments(v)).count() == 0 and ll.project_points(p, v).count() == 0


def test_a_line_of_a_million_places(spark):
    n = 1_000_000
    v = spark.range(n).select(F.lit(1).alias("geom"), F.col("id").cast("int").alias("seq"), (F.col("id") % 2).cast("double").alias("x"), (F.col("id") / 100).alias("y"))
    s = ll.running_lengths(ll.sliced_segments(v))
    step = math.hypot(1, 0.01)
    last, count, slices = s.agg(F.max(F.col("run") + F.col("length")), F.count("*"), F.count_distinct("slice")).first()
    assert (count, slices) == (n - 1, -(-n // ll.SLICE)) and last == pytest.approx(step * (n - 1), rel=1e-9)


def test_tiles_of_a_row_are_those_of_levels(spark):
    images = spark.createDataFrame([(1, 4000, 300), (2, 1, 1), (3, 257, 256), (4, 300_000, 70)], "image int, width int, height int")
    assert image_tiles(images).exceptAll(tiles(pyramid_levels(images))).count() == 0 and image_tiles(images).count() == tiles(pyramid_levels(images)).count()
