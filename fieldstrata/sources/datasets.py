"""Domain tables derived from the warehouse tables, and the same as SQL for the oracle."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import adapters


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """The rows dealt over all tasks by their key, however few files they come from: for work that costs far more than a row."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, key)


def springs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported springs over the globe, one a customer."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("upload"), ((F.col("c_custkey") * 7919 % 36000) / 100.0 - 180).alias("lon"), ((F.col("c_custkey") * 104729 % 17000) / 100.0 - 85).alias("lat"), F.col("c_nationkey").cast("int").alias("type"), F.col("c_mktsegment").alias("device"))


SPRINGS = "springs AS (SELECT c_custkey AS upload, (c_custkey * 7919 % 36000) / 100e0 - 180 AS lon, (c_custkey * 104729 % 17000) / 100e0 - 85 AS lat, c_nationkey::INT AS type, c_mktsegment AS device FROM customer)"


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same springs in windows of 20 by 20 degrees for 1,500 of them each, so that they have neighbours."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("site"), (F.col("c_custkey") * 7919 % 2000 / 100.0 + F.floor(F.col("c_custkey") / 1500) * 20 % 340 - 170).alias("x"), ((F.col("c_custkey") * 104729 % 1999) / 100.0).alias("y"))


SITES = "sites AS (SELECT c_custkey AS site, (c_custkey * 7919 % 2000) / 100e0 + c_custkey // 1500 * 20 % 340 - 170 AS x, (c_custkey * 104729 % 1999) / 100e0 AS y FROM customer)"


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("image"), F.col("o_custkey").alias("upload"), F.col("o_orderdate").alias("taken"), (F.col("o_orderkey") % 4000 + 200).cast("int").alias("width"), (F.col("o_orderkey") * 7 % 3000 + 200).cast("int").alias("height"), F.col("o_orderpriority").alias("priority"))


IMAGES = "images AS (SELECT o_orderkey AS image, o_custkey AS upload, o_orderdate AS taken, (o_orderkey % 4000 + 200)::INT AS width, (o_orderkey * 7 % 3000 + 200)::INT AS height, o_orderpriority AS priority FROM orders)"


def track_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track points, one an event: the track is the user, the segment the day, seq the order in time."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("track"), F.to_date("ts").alias("day"), F.row_number().over(w).alias("seq"), ((F.col("event_id") * 37 % 3600) / 10.0 - 180).alias("lon"), ((F.col("event_id") * 53 % 1700) / 10.0 - 85).alias("lat"), F.col("value").alias("ele"), "ts", F.col("event_id").alias("event"), F.col("event_type").alias("kind"))


TRACKS = "points AS (SELECT user_id AS track, ts::DATE AS day, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS seq, (event_id * 37 % 3600) / 10e0 - 180 AS lon, (event_id * 53 % 1700) / 10e0 - 85 AS lat, value AS ele, ts, event_id AS event, event_type AS kind FROM events)"


def track_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track_points(spark, sf_dir).select(F.col("track").alias("geom"), F.lit(0).alias("ring"), "seq", F.col("lon").alias("x"), F.col("lat").alias("y"))


#: One text for each geometry type; @a,b stands for the vertex (x + a, y + b).
SHAPE_TEXTS = [
    "POINT (@0,0)",
    "LINESTRING (@0,0, @3,4, @3,10)",
    "POLYGON ((@0,0, @6,0, @6,6, @0,6, @0,0), (@1,1, @2,1, @2,2, @1,1))",
    "MULTIPOINT ((@0,0), (@5,5))",
    "MULTILINESTRING ((@0,0, @1,1, @0,0), (@2,0, @5,4))",
    "MULTIPOLYGON (((@0,0, @2,0, @0,2, @0,0)), ((@4,4, @8,4, @8,8, @4,4), (@6,5, @7,5, @7,6, @6,5)))",
    "GEOMETRYCOLLECTION (POINT (@0,0), LINESTRING (@0,0, @3,4))",
]


def filled(text: str, k: str) -> Column:
    """A text with its vertices put in, for the shape of key column ``k``."""
    x, y = F.col(k) % 1000 - 500, F.col(k) * 7 % 160 - 80
    pieces = []
    for i, piece in enumerate(re.split(r"@(\d+),(\d+)", text)):
        pieces.append(F.lit(piece) if i % 3 == 0 else (x + int(piece)).cast("string") if i % 3 == 1 else F.concat(F.lit(" "), (y + int(piece)).cast("string")))
    return F.concat(*pieces)


def filled_sql(text: str, k: str) -> str:
    """The same in SQL."""
    text = re.sub(r"@(\d+),(\d+)", rf"' || ({k} % 1000 - 500 + \1) || ' ' || ({k} * 7 % 160 - 80 + \2) || '", text)
    return f"('{text}')"


def by_kind(values: list, k: str) -> str:
    """SQL for a value by the shape's type: 0 to 6 in the order of SHAPE_TEXTS."""
    return f"CASE {k} % 7 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, t): a geometry text for every part, in turn of the seven types."""
    texts = F.lit(None).cast("string")
    for i, t in enumerate(SHAPE_TEXTS):
        texts = F.when(F.col("p_partkey") % 7 == i, filled(t, "p_partkey")).otherwise(texts)
    return dealt(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(F.col("p_partkey").alias("id"), texts.alias("t"))


def shape_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, g): the same as geometries."""
    return shapes(spark, sf_dir).select("id", adapters.read_ewkt(F.col("t")).alias("g"))


SHAPES = "shapes AS (SELECT p_partkey AS id, " + by_kind([filled_sql(t, "p_partkey") for t in SHAPE_TEXTS], "p_partkey") + " AS t FROM part)"


#: Offsets of the ring vertices of every polygon; even ones have the hole too.
OUTER, HOLE = [(0, 0), (3, 0), (3, 3), (1, 3), (0, 2), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ring vertices (geom, ring, seq, x, y) of one polygon a supplier, in 5 by 5 grids of 4-degree cells.

    A hundred polygons lie over one window of the sites, in four layers.
    """
    rows = [(0, i, x, y) for i, (x, y) in enumerate(OUTER, 1)] + [(1, i, x, y) for i, (x, y) in enumerate(HOLE, 1)]
    shape = F.array(*[F.struct(F.lit(r).alias("ring"), F.lit(i).alias("seq"), F.lit(float(x)).alias("dx"), F.lit(float(y)).alias("dy")) for r, i, x, y in rows])
    n = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("geom"), F.explode(shape).alias("v")).where("v.ring = 0 or geom % 2 = 0")
    x = F.col("geom") % 5 * 4 + F.floor(F.col("geom") % 100 / 25) * 0.25 + F.floor(F.col("geom") / 100) * 20 % 340 - 170
    return n.select("geom", "v.ring", "v.seq", (x + F.col("v.dx")).alias("x"), (F.floor(F.col("geom") % 25 / 5) * 4 + F.col("v.dy")).alias("y"))


POLYGONS = (
    "shape(ring, seq, dx, dy) AS (VALUES " + ", ".join(f"({r}, {i}, {x}e0, {y}e0)" for r, ring in enumerate((OUTER, HOLE)) for i, (x, y) in enumerate(ring, 1)) + "), "
    "polygons AS (SELECT s_suppkey::INT AS geom, ring, seq, s_suppkey % 5 * 4 + s_suppkey % 100 // 25 * 0.25e0 + s_suppkey // 100 * 20 % 340 - 170 + dx AS x, s_suppkey % 25 // 5 * 4 + dy AS y FROM supplier, shape WHERE ring = 0 OR s_suppkey % 2 = 0)"
)


def markup_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations on photo markups in the order of ``op_no``: key (image, number), insert, update or delete, and a box."""
    li = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    op = F.when(F.col("l_returnflag") == "A", "insert").when(F.col("l_returnflag") == "R", "delete").otherwise("update")
    return li.select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").cast("int").alias("number"), F.row_number().over(w).alias("op_no"), op.alias("op"), (F.col("l_partkey") % 100).cast("double").alias("x"), (F.col("l_suppkey") % 100).cast("double").alias("y"), F.col("l_quantity").alias("w"), (F.col("l_quantity") / 2).alias("h"))


MARKUPS = "markups AS (SELECT l_orderkey AS image, l_linenumber::INT AS number, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice)::INT AS op_no, CASE l_returnflag WHEN 'A' THEN 'insert' WHEN 'R' THEN 'delete' ELSE 'update' END AS op, (l_partkey % 100)::DOUBLE AS x, (l_suppkey % 100)::DOUBLE AS y, l_quantity AS w, l_quantity / 2 AS h FROM lineitem)"
