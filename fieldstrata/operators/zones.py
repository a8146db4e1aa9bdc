"""Time zones of places, and local times as UTC by zone and instant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .spatial import box_cells, cell

#: Boxes (zone, rank, west, south, east, north) of half-open sides; where they overlap the lowest rank counts. Coarse on
#: purpose: a table of finer boxes can be given instead.
ZONES = [
    ("America/Los_Angeles", 1, -125.0, 32.0, -114.0, 49.0),
    ("America/Phoenix", 0, -115.0, 31.0, -109.0, 37.0),
    ("America/Denver", 2, -115.0, 31.0, -102.0, 49.0),
    ("America/Chicago", 3, -102.0, 25.0, -85.0, 49.0),
    ("America/New_York", 4, -88.0, 24.0, -67.0, 48.0),
    ("America/Sao_Paulo", 5, -54.0, -34.0, -34.0, 5.0),
    ("Europe/London", 6, -9.0, 49.0, 2.0, 61.0),
    ("Europe/Berlin", 7, -5.0, 36.0, 24.0, 71.0),
    ("Asia/Kolkata", 8, 68.0, 6.0, 97.0, 36.0),
    ("Asia/Tokyo", 9, 129.0, 30.0, 146.0, 46.0),
    ("Australia/Sydney", 10, 141.0, -44.0, 154.0, -28.0),
    ("UTC", 99, -180.0, -90.0, 180.0, 90.0),
]


def zone_boxes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ZONES, "zone string, rank int, west double, south double, east double, north double")


def with_zone(rows: DataFrame, key: str, boxes: DataFrame, size: float = 5.0) -> DataFrame:
    """Adds the zone of each row's (lon, lat): of the boxes that hold the place the one of the lowest rank; null outside of all.

    Boxes are dealt to the cells they touch, and for each cell only those up to the first box that fills it can count, so a
    place meets few boxes however many there are. ``key`` tells rows apart.
    """
    dealt = boxes.withColumn("k", F.explode(box_cells(F.col("west"), F.col("south"), F.col("east"), F.col("north"), size)))
    full = (F.col("west") <= F.col("k.cx") * size) & (F.col("east") >= (F.col("k.cx") + 1) * size) & (F.col("south") <= F.col("k.cy") * size) & (F.col("north") >= (F.col("k.cy") + 1) * size)
    dealt = dealt.withColumn("last", F.min(F.when(full, F.col("rank"))).over(Window.partitionBy("k")))
    dealt = dealt.where("last is null or rank <= last").select("k", "zone", "rank", "west", "south", "east", "north")
    placed = rows.withColumn("k", F.struct(cell(F.col("lon"), size).alias("cx"), cell(F.col("lat"), size).alias("cy")))
    inside = (F.col("lon") >= F.col("west")) & (F.col("lon") < F.col("east")) & (F.col("lat") >= F.col("south")) & (F.col("lat") < F.col("north"))
    found = placed.select(F.col(key).alias("_key"), "lon", "lat", "k").join(dealt, "k").where(inside).groupBy("_key").agg(F.min_by("zone", "rank").alias("zone"))
    return rows.join(found, F.col(key) == F.col("_key"), "left").drop("_key")


def with_utc(rows: DataFrame, local: str) -> DataFrame:
    """Adds utc: the local time (without zone) of each row at the offset that its zone has at that moment.

    Hours that the clock skips in spring count on from before, hours that it repeats in autumn are taken as the first.
    """
    return rows.withColumn("utc", F.convert_timezone(F.col("zone"), F.lit("UTC"), F.col(local).cast("timestamp_ntz")))
