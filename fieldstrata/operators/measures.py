"""Measures on vertices in long form: (geom, ring, seq, x, y), ring 0 the exterior."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import RADIUS, arc_degrees, great_circle, number_text


def segments(v: DataFrame) -> DataFrame:
    """Consecutive pairs of vertices of each ring: adds x2, y2; the last vertex has none."""
    w = Window.partitionBy("geom", "ring").orderBy("seq")
    return v.withColumn("x2", F.lead("x").over(w)).withColumn("y2", F.lead("y").over(w)).where("x2 is not null")


def bounding_box(v: DataFrame) -> DataFrame:
    return v.groupBy("geom").agg(F.min("x").alias("minx"), F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy"))


def envelope(v: DataFrame) -> DataFrame:
    """The bounding box as a polygon text, from the lower right corner on."""
    t = lambda a, b: F.concat(number_text(F.col(a)), F.lit(" "), number_text(F.col(b)))
    ring = F.concat_ws(", ", t("maxx", "miny"), t("maxx", "maxy"), t("minx", "maxy"), t("minx", "miny"), t("maxx", "miny"))
    return bounding_box(v).select("geom", F.concat(F.lit("POLYGON (("), ring, F.lit("))")).alias("wkt"))


def lengths(v: DataFrame, radius: float = RADIUS) -> DataFrame:
    """Planar, great-circle and angular length of each line."""
    x = [F.col(c) for c in ("x", "y", "x2", "y2")]
    planar = F.sqrt(F.pow(x[2] - x[0], F.lit(2)) + F.pow(x[3] - x[1], F.lit(2)))
    return segments(v).groupBy("geom").agg(F.sum(planar).alias("planar"), F.sum(great_circle(*x, radius)).alias("metres"), F.sum(arc_degrees(*x)).alias("degrees"))


def ring_areas(v: DataFrame) -> DataFrame:
    """Signed shoelace area and centroid moments of each ring."""
    cross = F.col("x") * F.col("y2") - F.col("x2") * F.col("y")
    return segments(v).groupBy("geom", "ring").agg((F.sum(cross) / 2).alias("signed"), F.sum((F.col("x") + F.col("x2")) * cross).alias("mx"), F.sum((F.col("y") + F.col("y2")) * cross).alias("my"))


def area(v: DataFrame) -> DataFrame:
    """Exterior area less that of the holes; also the exterior's alone, and with its sign."""
    r = ring_areas(v)
    outer = F.col("ring") == 0
    return r.groupBy("geom").agg(F.sum(F.when(outer, F.abs("signed")).otherwise(-F.abs("signed"))).alias("area"), F.sum(F.when(outer, F.abs("signed"))).alias("exterior"), F.sum(F.when(outer, F.col("signed"))).alias("signed"))


def centroid(v: DataFrame) -> DataFrame:
    """Area centroid of the exterior ring; of a ring without area its first vertex."""
    r = ring_areas(v.where("ring = 0"))
    first = v.where("ring = 0").groupBy("geom").agg(F.min_by(F.struct("x", "y"), "seq").alias("f"))
    j = r.join(first, "geom")
    c = lambda m, k: F.when(F.col("signed") == 0, F.col(f"f.{k}")).otherwise(F.col(m) / (6 * F.col("signed")))
    return j.select("geom", c("mx", "x").alias("cx"), c("my", "y").alias("cy"))


def outermost(v: DataFrame) -> DataFrame:
    """The exterior vertex farthest from the centroid, the first of equals; none if all lie on it."""
    d = v.where("ring = 0").join(centroid(v), "geom").withColumn("distance", F.sqrt(F.pow(F.col("x") - F.col("cx"), F.lit(2)) + F.pow(F.col("y") - F.col("cy"), F.lit(2))))
    d = d.where("distance > 0").groupBy("geom").agg(F.max_by(F.struct("seq", "x", "y", "distance"), F.struct(F.round("distance", 9), -F.col("seq"))).alias("b"))
    return d.select("geom", "b.seq", "b.x", "b.y", "b.distance")


def end_points(v: DataFrame, n: int = 2) -> DataFrame:
    """First, last and n-th vertex of each line (null out of range), and whether it is closed."""
    p = F.struct("x", "y")
    e = v.where("ring = 0").groupBy("geom").agg(F.min_by(p, "seq").alias("a"), F.max_by(p, "seq").alias("b"), F.max(F.when(F.col("seq") == n, p)).alias("n"), F.count("*").alias("points"))
    return e.select("geom", F.col("a.x").alias("start_x"), F.col("a.y").alias("start_y"), F.col("b.x").alias("end_x"), F.col("b.y").alias("end_y"), F.col("n.x").alias("n_x"), F.col("n.y").alias("n_y"), "points", (F.col("a") == F.col("b")).alias("closed"))


def line_text(v: DataFrame) -> DataFrame:
    """Each geometry's exterior vertices in order as a LINESTRING text."""
    p = F.sort_array(F.collect_list(F.struct("seq", "x", "y")))
    text = F.array_join(F.transform(p, lambda q: F.concat(number_text(q["x"]), F.lit(" "), number_text(q["y"]))), ", ")
    return v.where("ring = 0").groupBy("geom").agg(F.concat(F.lit("LINESTRING ("), text, F.lit(")")).alias("wkt"))


def dimension(shapes: DataFrame) -> DataFrame:
    """0, 1 or 2 by the geometry types (geom, type) of the components."""
    d = F.when(F.col("type").endswith("Polygon"), 2).when(F.col("type").endswith("LineString"), 1).otherwise(0)
    return shapes.groupBy("geom").agg(F.max(d).alias("dimension"))
