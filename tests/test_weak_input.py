"""Faulty and empty input, natural order, zones, classes and streams with several batches."""

import random
import re

import pytest
from pyspark.sql import functions as F

from fieldstrata.functions import annotations as an
from fieldstrata.functions import geometry as g
from fieldstrata.functions import images
from fieldstrata.operators import catalog, zones
from fieldstrata.operators.values import equality_classes
from fieldstrata.sources import adapters as a
from fieldstrata.streaming import ingest

FAULTY = ["", " ", "<", "<a>", "{", "{}", "[]", "POINT", "POINT (1)", "LINESTRING (1 1)", "<feed><box>1 2</box></feed>", "<feed><box></box></feed>", "<feed><box>1 2 3</box></feed>", "<feed><point>x y</point></feed>", "<kml><Point><coordinates>1</coordinates></Point></kml>", "<gpx><wpt lat='x'/></gpx>", '{"type":"Point"}', '{"type":"Point","coordinates":[1]}', "0101", "ail", None]


@pytest.mark.parametrize("kind", [*a.FORMATS, "wkb_hex"])
def test_readers_give_null_for_faulty_texts(spark, kind):
    df = spark.createDataFrame([(t,) for t in FAULTY], "g string")
    got = [r.g for r in a.load(df, "g", kind).select("g").collect()]
    assert len(got) == len(FAULTY) and all(x is None or x.type in g.TYPES for x in got)
    assert all(x is None for x, t in zip(got, FAULTY, strict=True) if t in (None, "", " ") or (t.startswith("<feed><box>") and kind == "georss"))
    assert a.load(df.limit(0), "g", kind).count() == 0


@pytest.mark.parametrize("kind", [*a.FORMATS, "wkb", "ewkb_hex"])
def test_writers_on_null_and_empty_tables(spark, kind):
    df = spark.createDataFrame([("POLYGON EMPTY",), (None,)], "t string").select(a.read_ewkt(F.col("t")).alias("g"))
    assert a.out(df, "g", kind).collect()[1].g is None and a.out(df.limit(0), "g", kind).count() == 0


def test_georss_boxes(spark):
    df = spark.createDataFrame([("<feed><box>1 2 3 5</box></feed>",), ("<feed><box>1 2</box><point>3 4</point></feed>",)], "t string")
    assert [r[0] for r in df.select(a.write_wkt(a.read_georss(F.col("t")))).collect()] == ["POLYGON ((2 1, 5 1, 5 3, 2 3, 2 1))", None]


def test_annotations_without_rows(spark):
    docs = spark.createDataFrame([], "doc string, xml string")
    rows = an.flatten_annotations(docs)
    assert rows.count() == 0 and an.to_xml(rows).columns == ["doc", "xml"] and an.to_xml(rows).count() == 0 and an.csv_lines(rows).count() == 0


def test_formats_of_the_user_are_found(spark):
    pair = lambda t: g.point(F.split_part(t, F.lit("|"), F.lit(2)).try_cast("double"), F.split_part(t, F.lit("|"), F.lit(3)).try_cast("double"))
    a.register("bars", pair, None, lambda t: t.startswith("|"))
    try:
        df = spark.createDataFrame([("|3|4", 1), ("POINT (1 2)", 2), ("?", 3), (None, 4)], "t string, _wkb int")
        got = a.convert(df, "t", None, "wkt").orderBy("_wkb").collect()
        assert [(r.t, r._wkb) for r in got] == [("POINT (3 4)", 1), ("POINT (1 2)", 2), (None, 3), (None, 4)]
    finally:
        del a.FORMATS["bars"], a.LOOKS["bars"]


def test_natural_order_sorts_block_by_block(spark):
    rand = random.Random(1)
    names = sorted({f"a{rand.randrange(12):0{rand.randrange(1, 4)}d}_b{rand.randrange(10**rand.randrange(1, 30))}" + (f"_c{rand.randrange(9)}" if rand.random() < 0.5 else "") for _ in range(200)} | {"a1_b2", "a2_b1", "a1_b" + "9" * 24, "a1_b1" + "0" * 20})
    blocks = {n: [(0, int(x)) if x.isdigit() else (1, x.strip()) for x in re.findall(r"\d+|\D+", n)] for n in names}
    want = list(names)
    for i in range(min(map(len, blocks.values()))):
        want.sort(key=lambda n, i=i: blocks[n][i])
    df = spark.createDataFrame([("d", n) for n in names] + [("other", "x"), (None, "y10"), (None, "y9")], "dir string, name string")
    got = {(r.dir, r.name): (r.z, r.t) for r in catalog.stack_order(df, "dir", "name", 3).collect()}
    assert [got["d", n] for n in want] == [(k % 3, k // 3) for k in range(len(want))] and got[None, "y9"] == (0, 0)


def test_zone_by_place_and_hours_that_the_clock_skips_or_repeats(spark):
    rows = [
        (1, -74.0, 40.7, "2024-07-01 12:00:00", "America/New_York", "2024-07-01 16:00:00"),
        (2, -74.0, 40.7, "2024-01-01 12:00:00", "America/New_York", "2024-01-01 17:00:00"),
        (3, -74.0, 10.0, "2024-07-01 12:00:00", "UTC", "2024-07-01 12:00:00"),  # the same longitude, another latitude
        (4, -112.0, 34.0, "2024-07-01 12:00:00", "America/Phoenix", "2024-07-01 19:00:00"),  # inside of Denver's box too
        (5, -74.0, 40.7, "2024-11-03 01:30:00", "America/New_York", "2024-11-03 05:30:00"),  # repeated: the first
        (6, -74.0, 40.7, "2024-03-10 02:30:00", "America/New_York", "2024-03-10 07:30:00"),  # skipped
        (7, None, 40.7, "2024-03-10 02:30:00", None, None),
        (8, 200.0, 0.0, "2024-03-10 02:30:00", None, None),
    ]
    df = spark.createDataFrame([r[:4] for r in rows], "id int, lon double, lat double, local string").withColumn("local", F.col("local").cast("timestamp_ntz"))
    got = zones.with_utc(zones.with_zone(df, "id", zones.zone_boxes(spark)), "local").orderBy("id").select("id", "zone", F.col("utc").cast("string")).collect()
    assert [tuple(r) for r in got] == [(r[0], *r[4:]) for r in rows]


def test_volume_region(spark):
    sides = [F.lit(x) for x in (10, 10, 4)]
    got = images.volume_region(sides, [F.lit(x) for x in (3, 12, -1)], [F.lit(x) for x in (0, 20, 9)])
    assert [tuple(r) for r in spark.range(1).select(*[c for p in got for c in p]).collect()] == [(3, 7, 0, 10, 0, 4)]


def test_equality_classes_take_no_pairs(spark):
    rows = [(1, "POINT (1 2)"), (2, "POINT (1 2)"), (3, "POINT (2 1)"), (4, "LINESTRING (1 2, 2 1)"), (5, "LINESTRING (2 1, 1 2)"), (6, None)]
    df = spark.createDataFrame(rows, "id int, t string").select("id", a.read_ewkt(F.col("t")).alias("g"))
    got = {r.id: (r["class"], r.size) for r in equality_classes(df.where("g is not null")).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 1), 4: (4, 2), 5: (4, 2)}


def test_markups_over_batches_restarts_and_empty_runs(spark, tmp_path):
    """However operations are dealt to runs and batches, state and refusals are those of the plain log."""
    rand = random.Random(2)
    ops = [(rand.randrange(6), n, rand.choice(["insert", "update", "update", "delete"]), f"doc{n}") for n in range(120)]
    schema = "k int, n int, op string, doc string"
    log = spark.createDataFrame(ops, schema)
    run = lambda: ingest.markup_stream(spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"), ["k"], "n", f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    (tmp_path / "in").mkdir()
    run()  # nothing there yet
    assert ingest.changes(spark, log.schema, f"{tmp_path}/out").count() == 0
    at = 0
    for step in (1, 30, 0, 50, 39):
        if step:
            log.where(f"n >= {at} and n < {at + step}").coalesce(1).write.parquet(f"{tmp_path}/in/{at}")
            at += step
        run()
        found = ingest.changes(spark, log.schema, f"{tmp_path}/out")
        state, bad = ingest.apply_operations(None, log.where(f"n < {at}"), ["k"], "n")
        assert sorted(map(tuple, ingest.current_markups(found, ["k"], "n").select("k", "n", "op", "doc").collect())) == sorted(map(tuple, state.select("k", "n", "op", "doc").collect()))
        assert sorted(map(tuple, ingest.refused(found).collect())) == sorted(map(tuple, bad.collect()))
    per_batch = [r["count"] for r in found.where("message is null").groupBy("batch").count().collect()]
    assert max(per_batch) <= 6  # a batch writes one row a key at most
