"""Lengths along lines and places on them, for lines too long for one task: slices of vertices, then one row a slice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import great_circle
from ..sources.store import stored
from .spatial import cell, line_cells

#: Vertices of a slice, by their numbers.
SLICE = 4096


def sliced_segments(v: DataFrame, size: int = SLICE) -> DataFrame:
    """Segments (geom, seq, slice, x, y, x2, y2) of lines (geom, seq, x, y), as ``measures.segments`` has them.

    Vertices meet their next one inside a slice of ``size`` numbers; the last of a slice gets the first of the next slice there
    is, over one row a slice. No window goes over a whole line. Numbers are distinct in a line; gaps do no harm.
    """
    s = v.select("geom", F.col("seq").cast("long").alias("seq"), F.floor(F.col("seq") / size).alias("slice"), F.struct("x", "y").alias("p"))
    heads = s.groupBy("geom", "slice").agg(F.min_by("p", "seq").alias("head"))
    nexts = heads.select("geom", "slice", F.lead("head").over(Window.partitionBy("geom").orderBy("slice")).alias("after"))
    inside = F.lead("p").over(Window.partitionBy("geom", "slice").orderBy("seq"))
    d = s.withColumn("q", inside).join(nexts, ["geom", "slice"]).withColumn("q", F.coalesce("q", "after")).where("q is not null")
    return d.select("geom", "seq", "slice", F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("q.x").alias("x2"), F.col("q.y").alias("y2"))


def planar() -> Column:
    return F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))


def metres() -> Column:
    return great_circle(F.col("x"), F.col("y"), F.col("x2"), F.col("y2"))


def running_lengths(segments: DataFrame, length: Column | None = None) -> DataFrame:
    """``sliced_segments`` with the length of each and ``run``, the length of its line before it: sums inside a slice on top
    of the sums of the slices before."""
    s = segments.withColumn("length", planar() if length is None else length)
    sums = s.groupBy("geom", "slice").agg(F.sum("length").alias("sum"))
    before = Window.partitionBy("geom").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("geom", "slice", F.coalesce(F.sum("sum").over(before), F.lit(0.0)).alias("base"))
    own = Window.partitionBy("geom", "slice").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return s.withColumn("run", F.coalesce(F.sum("length").over(own), F.lit(0.0))).join(sums, ["geom", "slice"]).withColumn("run", F.col("base") + F.col("run")).drop("base")


def project_points(points: DataFrame, v: DataFrame, size: int = SLICE) -> DataFrame:
    """(item, geom, at, share, away) of points (item, geom, px, py), items distinct: how far along its line (geom, seq, x, y) the
    nearest place to a point lies, as a length and a share of the line, and how far off that is; of equally near
    segments (to a billionth) the first. Points of lines without a segment are left out.

    Segments lie in the cells along them. Points look into the nine cells around them; those that find a segment no farther
    than a cell's side are done, the others look again among cells four times as wide.
    """
    spark = v.sparkSession
    s = stored(spark, running_lengths(sliced_segments(v, size)), "segments")
    total = s.groupBy("geom").agg(F.sum("length").alias("total"))
    side, low, high = s.agg(F.avg(F.greatest(F.abs(F.col("x2") - F.col("x")), F.abs(F.col("y2") - F.col("y")))), F.least(F.min("x"), F.min("y"), F.min("x2"), F.min("y2")), F.greatest(F.max("x"), F.max("y"), F.max("x2"), F.max("y2"))).first()
    open_ = stored(spark, points.select("item", "geom", "px", "py").join(total.select("geom"), "geom", "left_semi"), "points")
    if side is None:
        return open_.select("item", "geom", *[F.lit(None).cast("double").alias(c) for c in ("at", "share", "away")])
    lo, hi = open_.agg(F.least(F.min("px"), F.min("py")), F.greatest(F.max("px"), F.max("py"))).first()
    widest = max(high, hi if hi is not None else high) - min(low, lo if lo is not None else low)
    side = max(side, widest * 1e-6, 1e-12)
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    dx, dy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    t = F.when(F.col("length") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("px") - F.col("x")) * dx + (F.col("py") - F.col("y")) * dy) / (dx * dx + dy * dy))))
    # the end of a segment is the beginning of the next one to the last bit
    off = lambda c, d: F.when(F.col("t") == 1, F.col(f"{c}2")).otherwise(F.col(c) + F.col("t") * d) - F.col(f"p{c}")
    done = None
    while True:
        held = s.withColumn("k", F.explode(line_cells(side)))
        asked = open_.withColumn("o", F.explode(around)).select("item", "geom", "px", "py", F.struct((cell(F.col("px"), side) + F.col("o.i")).alias("cx"), (cell(F.col("py"), side) + F.col("o.j")).alias("cy")).alias("k"))
        met = asked.join(held, ["geom", "k"]).withColumn("t", t)
        met = met.withColumn("away", F.sqrt(off("x", dx) * off("x", dx) + off("y", dy) * off("y", dy)))
        best = met.groupBy("item", "geom").agg(F.min(F.struct(F.round("away", 9).alias("near"), "seq", "away", (F.col("run") + F.col("t") * F.col("length")).alias("at"))).alias("b"))
        best = stored(spark, best.select("item", "geom", "b.away", "b.at"), "nearest")
        last = side > widest
        settled = best if last else best.where(F.col("away") <= side * 0.999999)
        done = settled if done is None else done.unionByName(settled)
        open_ = stored(spark, open_.join(settled.select("item"), "item", "left_anti"), "points")
        if last or open_.isEmpty():
            return done.join(total, "geom").select("item", "geom", "at", F.try_divide("at", "total").alias("share"), "away")
        side *= 4
