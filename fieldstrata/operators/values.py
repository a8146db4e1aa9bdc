"""Jobs on tables of geometries as values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g


def equality_classes(shapes: DataFrame) -> DataFrame:
    """(id, class, size) of geometries (id, g) with the same vertices: the class is its smallest id.

    Counts by hash of the vertices in order come first, then every geometry meets one row of its hash and is held against
    the vertices of the first of it; those that only share the hash form classes by their vertices.
    """
    keyed = shapes.select("id", F.array_sort(g.vertices(F.col("g"))).alias("v")).withColumn("h", F.xxhash64("v"))
    first = keyed.groupBy("h").agg(F.min("id").alias("class"), F.min_by("v", "id").alias("v0"), F.count("*").alias("size"), F.count_distinct(F.md5(F.to_json("v"))).alias("kinds"))
    j = keyed.join(first, "h")
    same = j.where("kinds = 1 and v = v0").select("id", "class", "size")
    w = Window.partitionBy("v")
    rest = j.where("kinds > 1").select("id", F.min("id").over(w).alias("class"), F.count("*").over(w).alias("size"))
    return same.unionByName(rest)
