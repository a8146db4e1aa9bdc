"""Jobs beyond one batch or partition: ids, streams, distances over the sphere's edges, long lines, positions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldstrata.functions import shapes
from fieldstrata.operators import catalog, spatial
from fieldstrata.streaming import ingest


def test_ids_are_dense_over_many_partitions(spark):
    rows = spark.range(0, 3_000_000, 1, 16).select(F.xxhash64("id").alias("k"))
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = catalog.append_ids(spark, rows, ["k"], 11).agg(F.count("*").alias("n"), F.count_distinct("id").alias("d"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.corr(F.col("id").cast("double"), F.col("k").cast("double")).alias("c")).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert (got.n, got.d, got.lo, got.hi) == (3_000_000, 3_000_000, 11, 3_000_010) and got.c > 0.99


OPS = [(1, 1, "insert"), (1, 2, "delete"), (1, 3, "update"), (2, 1, "update"), (2, 2, "insert"), (2, 3, "update"), (3, 1, "insert"), (3, 2, "delete"), (3, 3, "insert"), (4, 1, "delete"), (5, 1, "insert"), (5, 2, "delete"), (5, 3, "delete")]
STATE, REFUSED = {(2, 3), (3, 3)}, {(1, 3), (2, 1), (4, 1), (5, 3)}


@pytest.mark.parametrize("cuts", [(), (1,), (2,), (1, 2)])
def test_operations_in_any_batches(spark, cuts):
    """An update after a delete is refused, whether they come together or apart."""
    log = spark.createDataFrame(OPS, "k long, n long, op string")
    state, refused, edges = None, set(), [0, *cuts, 9]
    for a, b in zip(edges, edges[1:], strict=False):
        state, bad = ingest.apply_operations(state, log.where(f"n > {a} and n <= {b}"), ["k"], "n")
        state = spark.createDataFrame(state.collect(), "k long, n long, op string")
        refused |= {(r.k, r.n) for r in bad.collect()}
    assert {(r.k, r.n) for r in state.collect()} == STATE and refused == REFUSED


def test_distance_at_poles_and_antimeridian(spark):
    p = spark.createDataFrame([(1, 0.0, 80.0), (2, 3.0, 80.0), (3, 179.9, 0.0), (4, -179.9, 0.0), (5, 10.0, 89.9), (6, -170.0, 89.9), (7, 50.0, 10.0)], "site long, x double, y double")
    got = {(r.left, r.right) for r in spatial.within_distance(p, p, 60_000.0).where("left < right").collect()}
    assert got == {(1, 2), (3, 4), (5, 6)}


def test_distance_equals_brute_force(spark):
    g = np.random.default_rng(3)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(g.uniform(-180, 180, 300), g.uniform(-90, 90, 300), strict=True))]
    p = spark.createDataFrame(rows, "site long, x double, y double")
    got = {(r.left, r.right) for r in spatial.within_distance(p, p, 900_000.0).where("left < right").collect()}
    r = np.radians(np.array([q[1:] for q in rows]))
    v = np.stack([np.cos(r[:, 1]) * np.cos(r[:, 0]), np.cos(r[:, 1]) * np.sin(r[:, 0]), np.sin(r[:, 1])], axis=1)
    near = np.arccos(np.clip(v @ v.T, -1, 1)) * 6378137.0 <= 900_000
    assert got == {(i, j) for i in range(300) for j in range(i + 1, 300) if near[i, j]} and got


def test_crossings_equal_brute_force(spark):
    g = np.random.default_rng(5)
    pts = np.round(g.uniform(0, 50, (2, 60, 2)), 1)
    rows = [(k, 0, i, float(x), float(y)) for k in range(2) for i, (x, y) in enumerate(pts[k])]
    v = spark.createDataFrame(rows, "geom long, ring int, seq int, x double, y double")
    side = lambda a, b, c: np.sign((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
    want = {k: sum(side(p[i], p[i + 1], p[j]) * side(p[i], p[i + 1], p[j + 1]) < 0 and side(p[j], p[j + 1], p[i]) * side(p[j], p[j + 1], p[i + 1]) < 0 for i in range(59) for j in range(i + 1, 59)) for k, p in enumerate(pts)}
    for size in (None, 3.0, 100.0):
        assert {r.geom: r.crossings for r in spatial.crossing_counts(v, size).collect()} == want


def test_long_lines_simplify_alike(spark):
    g = np.random.default_rng(2)
    rows = [(k, i, float(x), float(y)) for k in range(2) for i, (x, y) in enumerate(np.cumsum(g.normal(0, 1, (400, 2)), axis=0))]
    v = spark.createDataFrame(rows, "geom long, seq int, x double, y double")
    whole = {(r.geom, r.seq) for r in shapes.simplify(v, 1.5).collect()}
    assert whole == {(r.geom, r.seq) for r in shapes.simplify(v, 1.5, limit=60).collect()} and 10 < len(whole) < 700


def test_position_is_carried_over_days(spark):
    t = spark.createDataFrame([(1, "2024-01-01 10:00:00", 1.0, 2.0), (1, "2024-01-03 10:00:00", 3.0, 4.0)], "track long, ts string, lon double, lat double").withColumn("ts", F.to_timestamp("ts"))
    i = spark.createDataFrame([(1, "2024-01-01 09:00:00", 1), (1, "2024-01-02 09:00:00", 2), (1, "2024-01-03 09:00:00", 3), (1, "2024-01-03 10:00:00", 4), (1, "2024-02-03 10:00:00", 5)], "track long, ts string, item long").withColumn("ts", F.to_timestamp("ts"))
    assert {r.item: r.lon for r in spatial.position_at(t, i).collect()} == {1: None, 2: 1.0, 3: 1.0, 4: 3.0, 5: 3.0}
