"""Work that grows with the rows: matrices of whole batches, copies of shapes, buckets of stream state, ties."""

import random
import time

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from fieldstrata.functions import annotations, images
from fieldstrata.functions import noding as nd
from fieldstrata.functions import noding_batches as nb
from fieldstrata.operators import long_lines, spatial
from fieldstrata.plans import registry
from fieldstrata.sources import stores
from fieldstrata.streaming import ingest
from test_relations import box, line, metres, points, polygon, star

PARTS = pa.list_(pa.struct([("type", pa.string()), ("rings", pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))]))
COLUMN = pa.struct([("type", pa.string()), ("srid", pa.int32()), ("parts", PARTS)])


def column(shapes):
    return pa.array([None if s is None else {"type": "", "srid": 0, "parts": s} for s in shapes], COLUMN)


def some_shape(rand):
    kind, x, y = rand.randrange(8), rand.randrange(-5, 6), rand.randrange(-5, 6)
    few = [(rand.randrange(-3, 4), rand.randrange(-3, 4)) for _ in range(rand.randrange(1, 5))]
    if kind < 3:
        return polygon(star(rand, x, y, kind % 2))
    odd = [None, [], polygon([]), polygon(box(0, 0, 1)) + line((0, 0), (1, 1)), polygon([(0, 0), (1, 0), (float("nan"), 1), (0, 0)]), line((0, 0), (1, 0)) + line((1, 0), (1, 5))]
    return [polygon(box(x, y, 6), box(x + 1, y + 1, rand.randrange(1, 4))), points(*few), line(*few), polygon(box(x / 4, y / 4, 2)) + polygon(box(x / 4 + 9, y / 4, 2)), rand.choice(odd)][kind - 3]


def test_batches_equal_single_pairs():
    rand = random.Random(11)
    a, b = ([some_shape(rand) for _ in range(1500)] for _ in range(2))
    assert nb.relate_all(column(a), column(b)).to_pylist() == [nd.relate(v, w) for v, w in zip(a, b, strict=True)]
    assert nb.relate_all(column(a).slice(7, 20), column(b).slice(7, 20)).to_pylist() == [nd.relate(v, w) for v, w in zip(a[7:27], b[7:27], strict=True)]
    assert nb.relate_all(column([]), column([])).to_pylist() == []


def test_many_pairs_in_short_time():
    a = [polygon(box(i % 9, i % 7, 6), box(i % 9 + 1, i % 7 + 1, 3)) for i in range(20_000)]
    b = [polygon(box(i % 8, i % 5, 4)) for i in range(20_000)]
    a, b = column(a), column(b)
    start = time.time()
    nb.relate_all(a, b)
    assert time.time() - start < 8


def test_copies_of_shapes_are_worked_out_once(spark):
    ring = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
    rows = [(i, 0, n, float(x + i % 2), float(y)) for i in range(40) for n, (x, y) in enumerate(ring)]
    v = spark.createDataFrame(rows, "geom int, ring int, seq int, x double, y double")
    one, of = spatial.classes(v, "ring", "seq", "x", "y")
    assert one.select("geom").distinct().count() == 2 and of.count() == 40
    p = spark.createDataFrame([(1, 0.5, 1.0), (2, 2.0, 2.0), (3, 4.5, 1.0)], "site int, x double, y double")
    found = spatial.points_in_polygons(p, v).groupBy("site").count().collect()
    assert {r["site"]: r["count"] for r in found} == {1: 20, 2: 40, 3: 20}


class State:
    def __init__(self):
        self.value = None

    exists = property(lambda s: s.value is not None)
    get = property(lambda s: s.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None


def test_a_bucket_of_keys_equals_one_key_after_the_other():
    rand = random.Random(3)
    step, state, stands = ingest._keyed(["k", "n", "op"], "n"), State(), set()
    for batch in range(30):
        rows = pd.DataFrame([(rand.randrange(12), n + batch * 100, rand.choice(["insert", "update", "delete"])) for n in range(rand.randrange(1, 25))], columns=["k", "n", "op"])
        rows["_key"] = rows["k"].map(lambda k: f'{{"k":{k}}}')
        got = pd.concat(step((0,), iter([rows.sample(frac=1, random_state=batch)]), state))
        refused, last = set(), {}
        for k, n, op in rows[["k", "n", "op"]].itertuples(index=False):
            if op == "insert" or k in stands:
                (stands.discard if op == "delete" else stands.add)(k)
                last[k] = n
            else:
                refused.add(n)
        assert set(got["n"][got["message"].notna()]) == refused and set(got["n"][got["message"].isna()]) == set(last.values())
        assert set(state.value[0].split("\n") if state.exists else []) == {f'{{"k":{k}}}' for k in stands}


def test_of_segments_that_meet_in_the_nearest_place_the_first_counts(spark):
    # a tenth of a degree is no whole number: ends of segments and beginnings of the next ones differ in the last bits
    rand = random.Random(2)
    stops = [(rand.randrange(-1800, 1800) / 10, rand.randrange(-850, 850) / 10) for _ in range(6)]
    rows = [(t, n, *stops[(n * (t % 5 + 1) + t) % 6 if n % 3 else t % 6]) for t in range(60) for n in range(24)]
    v = spark.createDataFrame(rows, "geom int, seq int, x double, y double")
    items = [(t * 10 + k, t, stops[(t + k) % 6][0] * 1.3, stops[(t + k) % 6][1] * 1.2) for t in range(60) for k in range(6)]
    found = long_lines.project_points(spark.createDataFrame(items, "item int, geom int, px double, py double"), v).collect()
    lines = {t: [(x, y) for g, _, x, y in rows if g == t] for t in range(60)}
    spots = {i: (t, px, py) for i, t, px, py in items}
    assert len(found) == len({r["item"] for r in found}) > 300
    for r in found:
        t, px, py = spots[r["item"]]
        run, best = 0.0, []
        for (a, b), (c, d) in zip(lines[t], lines[t][1:], strict=False):
            size = ((c - a) ** 2 + (d - b) ** 2) ** 0.5
            s = max(0.0, min(1.0, ((px - a) * (c - a) + (py - b) * (d - b)) / size**2)) if size else 0.0
            best.append((((a + s * (c - a) - px) ** 2 + (b + s * (d - b) - py) ** 2) ** 0.5, run + s * size))
            run += size
        near = min(x for x, _ in best)
        assert abs(r["away"] - near) < 1e-8 and abs(r["at"] - next(at for x, at in best if x < near + 1e-9)) < 1e-6


def test_hours_that_a_clock_repeats(spark, tmp_path):
    c = duckdb.connect()
    c.execute(f"copy (select i as c_custkey, i % 25 as c_nationkey, 'x' as c_mktsegment from range(2000) t(i)) to '{tmp_path}/customer.parquet'")
    c.execute(f"copy (select i as o_orderkey, i % 2000 as o_custkey, DATE '1995-10-29' - (i % 2)::INT * 35 as o_orderdate from range(20000) t(i)) to '{tmp_path}/orders.parquet'")
    for name in ("customer", "orders"):
        c.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    want = c.execute(registry.ORACLES["j07_zone_by_place_and_time"]).fetchall()
    got = registry.QUERIES["j07_zone_by_place_and_time"](spark, str(tmp_path)).select("image", "zone", F.col("utc").cast("timestamp_ntz").alias("utc")).collect()
    assert sorted(want) == sorted(tuple(r) for r in got)


def test_nearest_of_far_and_crowded_places(spark, monkeypatch):
    # all queries far from a crowd, whose edge lies at nearly one distance, and more of them than a task takes of a block
    monkeypatch.setattr(spatial, "CROWD", 8)
    monkeypatch.setattr(spatial, "QUERIES", 2)
    rand = random.Random(6)
    b = [(i, rand.uniform(0, 20), rand.uniform(0, 20)) for i in range(3000)] + [(3000 + i, 5.0, 5.0) for i in range(50)]
    a = [(i, rand.uniform(-180, -100), rand.uniform(-85, 85)) for i in range(400)] + [(400, float("nan"), 1.0), (401, None, 1.0), (402, 0.0, -0.0), (403, 5.0, 5.0)]
    sites = spark.createDataFrame(b, "site long, x double, y double")
    got = {(r.left, r.rank): (r.right, r.metres) for r in spatial.nearest_sites(spark.createDataFrame(a, "site long, x double, y double"), sites, 3).collect()}
    wanted = {}
    for i, x, y in a[:400] + a[402:]:
        for n, (m, j) in enumerate(sorted((round(metres((x, y), (u, v)), 6), j) for j, u, v in b)[:3]):
            wanted[i, n + 1] = j, m
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in wanted.items()}
    assert all(abs(got[k][1] - m) < 1e-5 for k, (_, m) in wanted.items())


def test_few_blocks_are_asked_from_far_away():
    # 16,384 blocks side by side: from far away only those that can be nearest are left
    side = np.arange(128) / 128
    low = np.array([(x, y, 0.0) for x in side for y in side])
    z = np.array([sum((int(v * 128) >> b & 1) << (2 * b + n) for n, v in enumerate(p[:2]) for b in range(7)) for p in low])
    low = low[np.argsort(z)]
    levels = spatial._block_levels((low, low + 1 / 128, np.full(len(low), 256)))
    at = np.array([(-50.0, 0.3, 0.0), (0.5001, 0.5001, 0.0), (9.0, 9.0, 9.0)])
    q, node, _ = spatial._reached(levels, at, np.full(3, np.inf), 3)
    least = np.sqrt((np.maximum(np.maximum(low - at[:, None], at[:, None] - low - 1 / 128), 0) ** 2).sum(2))
    most = np.sqrt((np.maximum(at[:, None] - low, low + 1 / 128 - at[:, None]) ** 2).sum(2))
    for i in range(3):
        assert set(np.flatnonzero(least[i] <= most[i].min())) == set(node[q == i]) and (q == i).sum() < 300


def test_work_on_shapes_is_dealt_over_all_tasks(spark, tmp_path):
    # one small file, read by one task
    spark.range(400).selectExpr("id as p_partkey", "id as c_custkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(400).selectExpr("id as p_partkey", "id as c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    for name in ("s08_s09_geojson_all_types", "s10_s11_kml_all_types", "s12_s13_gpx_all_types", "s14_s15_georss_all_types", "g02_boundary", "w09_project"):
        df = registry.QUERIES[name](spark, str(tmp_path))
        assert df.select(F.spark_partition_id().alias("n")).distinct().count() >= spark.sparkContext.defaultParallelism, name


def test_ends_of_zoomify_levels_equal_their_tiles(spark):
    rows = [(i, (i * 7919) % 5000 + 1, (i * 104729) % 3000 + 1) for i in range(300)] + [(300, 256, 256), (301, 257, 1), (302, None, 5), (303, 100000, 3)]
    df = spark.createDataFrame(rows, "image long, width int, height int")
    levels = images.zoomify_levels(df)
    ends = images.tiles(levels).groupBy("image", "level").agg(F.min("tile").alias("first_tile"), F.max_by(F.struct("tile", "x", "y"), "tile").alias("z"))
    name = images.zoomify_name(F.col("z.tile"), F.col("level"), F.col("z.x"), F.col("z.y")).alias("last_name")
    want = levels.select("image", "level", "w", "h").join(ends, ["image", "level"]).select("image", "level", "w", "h", "first_tile", name)
    got = images.zoomify_ends(df)
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect()) and got.count() > 900
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_small_and_large_geometries_give_the_same_distances_and_crossings(spark, monkeypatch):
    rand = random.Random(4)
    rows = [(g, 0, n, rand.uniform(0, 9), rand.uniform(0, 9)) for g in range(12) for n in range(5 + 5 * g)]
    v = spark.createDataFrame(rows, "geom int, ring int, seq int, x double, y double")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(11)] + [(3, 3), (2, 77)], "left int, right int")
    at = {g: [(x, y) for h, _, _, x, y in rows if h == g] for g in range(12)}
    one_way = lambda a, b: max(min(((x - u) ** 2 + (y - w) ** 2) ** 0.5 for u, w in b) for x, y in a)
    far = {(i, j): max(one_way(at[i], at[j]), one_way(at[j], at[i])) for i, j in [*[(i, i + 1) for i in range(11)], (3, 3)]}
    side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    cross = lambda a, b, c, d: side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0
    met = {g: sum(cross(p[i], p[i + 1], p[j], p[j + 1]) for i in range(len(p) - 1) for j in range(i)) for g, p in at.items()}
    for whole in (256, 20, 0):
        monkeypatch.setattr(spatial, "WHOLE", whole)
        got = {(r.left, r.right): r.hausdorff for r in spatial.hausdorff_distances(pairs, v).collect()}
        assert got.keys() == far.keys() and all(abs(got[k] - far[k]) < 1e-9 for k in far)
        assert {r.geom: r.crossings for r in spatial.crossing_counts(v).collect()} == {g: n for g, n in met.items() if n}


def test_small_geometries_are_shuffled_once_a_vertex_not_once_a_cell(spark):
    v = spark.createDataFrame([(g, 0, n, float(n * 37 % 100), float(n * 53 % 100)) for g in range(20) for n in range(30)], "geom int, ring int, seq int, x double, y double")
    assert "Generate" not in spatial.crossing_counts(v)._jdf.queryExecution().executedPlan().toString()


def test_manifest_is_listed_in_tasks(spark, tmp_path):
    files = {"1/a+b.jpg": 3, "1/empty.gpx": 0, "2/c d%20.mp4": 5, "3/deep/e.txt": 1, "_SUCCESS": 1, "2/.hidden": 4}
    for name, size in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    (tmp_path / "none").mkdir()
    for folder in (str(tmp_path), f"file://{tmp_path}"):
        m = stores.manifest(spark, folder)
        got = {(r.upload, r.name): (r.type, r.size) for r in m.collect()}
        assert got == {("1", "a+b.jpg"): ("photo", 3), ("1", "empty.gpx"): ("track", 0), ("2", "c d%20.mp4"): ("video", 5), ("deep", "e.txt"): ("other", 1)}
        assert all(abs(r.modified.timestamp() - time.time()) < 600 for r in m.select(F.expr("modified")).collect()) and m.where("id is null").count() == 0
    assert stores.manifest(spark, str(tmp_path / "none")).count() == 0


def test_annotations_are_flattened_into_columns(spark):
    texts = ["<a", None, "<a><o type='r' name='n'><vertex x='1' y='z' index='2'/><vertex x='nan' index='--1'/><vertex y='2' index='99999999999'/><tag name='p' value='q'/><tag name='p' value='r'/><i/></o><k/></a>"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "<a><b/></a>")], "doc long, xml string")
    got = {(r.doc, r.path): (r.depth, r.type, r.name, r.tags, [(v.x, v.y, v["index"]) for v in r.vertices]) for r in annotations.flatten_annotations(docs).collect()}
    vertices = [(1.0, None, 2), (None, None, None), (None, 2.0, None)]
    assert got == {(2, "/0"): (0, "r", "n", {"p": "r"}, vertices), (2, "/0/0"): (1, "i", None, {}, []), (2, "/1"): (0, "k", None, {}, []), (None, "/0"): (0, "b", None, {}, [])}


def test_credits_of_odd_keys_and_in_small_files(spark, tmp_path):
    from fieldstrata.plans.joins import j03_credits

    odd = [(-7, 1), (-1, 1), (0, 1), (2, None), (None, 1), (2, 1), (2, 1), (90_001, 2), (5, 3)]
    people = [(-2, 1, "a"), (1, 1, "b"), (1, 1, "b"), (None, 1, "c"), (4, None, "d"), (5, 2, None)]
    spark.createDataFrame(odd, "c_custkey long, c_nationkey long").write.parquet(f"{tmp_path}/odd/customer.parquet")
    spark.createDataFrame(people, "s_suppkey long, s_nationkey long, s_name string").write.parquet(f"{tmp_path}/odd/supplier.parquet")
    want = sorted(((c, s, x) for c, n in odd for s, m, x in people if None not in (c, n, s, m) and n == m and (c + s) % 3 == 0), key=repr)
    assert sorted(map(tuple, j03_credits(spark, f"{tmp_path}/odd").collect()), key=repr) == want and len(want) == 13
    # the pairs of a nation are many, but what is written of them is little
    spark.range(6000).select((F.col("id") * 5).alias("c_custkey"), F.lit(4).alias("c_nationkey")).write.parquet(f"{tmp_path}/large/customer.parquet")
    spark.range(1500).select(F.col("id").alias("s_suppkey"), F.lit(4).alias("s_nationkey"), F.concat(F.lit("Person "), F.col("id").cast("string")).alias("s_name")).write.parquet(f"{tmp_path}/large/supplier.parquet")
    j03_credits(spark, f"{tmp_path}/large").write.parquet(f"{tmp_path}/large/out")
    size = sum(f.stat().st_size for f in (tmp_path / "large" / "out").glob("*.parquet"))
    assert spark.read.parquet(f"{tmp_path}/large/out").distinct().count() == 3_000_000
    assert size < 0.3 * 3_000_000
