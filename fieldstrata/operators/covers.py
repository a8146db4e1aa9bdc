"""Areas as sets of geohash cells: quadtree covers of polygons, and union, intersection and differences of ranges of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .measures import segments
from .spatial import cell, line_cells

#: Levels between the cells that partition the work and the finest ones: a partition holds 4 ** FINER finest cells at most.
FINER = 6


def _spread(v: Column) -> Column:
    """The lower 32 bits of a number with a 0 before each."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v.bitwiseOR(F.shiftleft(v, shift))).bitwiseAND(F.lit(mask))
    return v


def z_order(cx: Column, cy: Column) -> Column:
    """Number of a cell in the order of geohashes: bits of the longitude and latitude in turn."""
    return F.shiftleft(_spread(cx.cast("long")), 1).bitwiseOR(_spread(cy.cast("long")))


def polygon_cover(v: DataFrame, levels: int = 12) -> DataFrame:
    """(geom, lo, hi, inside): cells of a quadtree over the globe that cover each polygon, as ranges [lo, hi) of finest cells.

    ``v`` has ring vertices (geom, ring, seq, x, y). Cells that an edge meets are split down to ``levels`` halvings of both axes, where
    they stay as ``inside`` = false; of the quarters that no edge meets those with their middle in the polygon (holes taken out) are
    kept whole. Rows follow the length of the edges in finest cells, not the area. Parts beyond the globe are not covered.
    """
    n = 1 << levels
    scaled = v.select("geom", "ring", "seq", ((F.col("x") + 180) / 360 * n).alias("x"), ((F.col("y") + 90) / 180 * n).alias("y"))
    e = segments(scaled).select("geom", "x", "y", "x2", "y2")
    met = e.select("geom", F.explode(line_cells(1.0)).alias("k")).where(f"k.cx between 0 and {n - 1} and k.cy between 0 and {n - 1}").select("geom", "k.cx", "k.cy").distinct()
    up = met.select("geom", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("up"), "cx", "cy")
    tree = up.select("geom", (F.lit(levels) - F.col("up")).alias("level"), F.expr("shiftright(cx, up)").alias("cx"), F.expr("shiftright(cy, up)").alias("cy")).distinct()
    quarters = F.explode(F.array(*[F.struct((F.col("cx") * 2 + i).alias("cx"), (F.col("cy") * 2 + j).alias("cy")) for i in (0, 1) for j in (0, 1)])).alias("q")
    rest = tree.where(F.col("level") < levels).select("geom", (F.col("level") + 1).alias("level"), quarters).select("geom", "level", "q.cx", "q.cy")
    rest = rest.join(tree, ["geom", "level", "cx", "cy"], "left_anti")
    middle = lambda c: (F.col(c) + 0.5) * F.expr(f"shiftleft(1L, {levels} - level)")
    rest = rest.select("*", middle("cx").alias("px"), middle("cy").alias("py")).withColumn("row", cell(F.col("py"), 1.0))
    rows = e.withColumn("row", F.explode(F.sequence(cell(F.least("y", "y2"), 1.0), cell(F.greatest("y", "y2"), 1.0))))
    below = (F.col("y") < F.col("py")) & (F.col("y2") >= F.col("py")) | (F.col("y2") < F.col("py")) & (F.col("y") >= F.col("py"))
    left_of = F.col("x") + (F.col("py") - F.col("y")) / (F.col("y2") - F.col("y")) * (F.col("x2") - F.col("x")) < F.col("px")
    hit = rest.join(rows, ["geom", "row"]).where(below).where(left_of)
    whole = hit.groupBy("geom", "level", "cx", "cy").agg((F.count("*") % 2).alias("odd")).where("odd = 1").select("geom", "level", "cx", "cy", F.lit(True).alias("inside"))
    cells = whole.unionByName(met.select("geom", F.lit(levels).alias("level"), "cx", "cy", F.lit(False).alias("inside")))
    z, size = z_order(F.col("cx"), F.col("cy")), F.expr(f"shiftleft(1L, 2 * ({levels} - level))")
    return cells.select("geom", (z * size).alias("lo"), ((z + 1) * size).alias("hi"), "inside")


def cut(ranges: DataFrame, levels: int) -> DataFrame:
    """The ranges, cut at the borders of coarse cells: with a column ``block`` for the coarse cell that each lies in."""
    coarse = F.lit(1 << 2 * min(FINER, levels)).cast("long")
    blocks = F.sequence(F.floor(F.col("lo") / coarse), F.floor((F.col("hi") - 1) / coarse))
    d = ranges.withColumn("block", F.explode(blocks))
    return d.withColumn("lo", F.greatest("lo", F.col("block") * coarse)).withColumn("hi", F.least("hi", (F.col("block") + 1) * coarse))


def overlay(left: DataFrame, right: DataFrame, levels: int = 12) -> DataFrame:
    """(lo, hi, in_left, in_right) of the pieces of two areas, each a set of ranges that may overlap and repeat.

    Begins and ends of ranges are counted by block and place first; the running counts of a block tell which areas
    stand over a piece. A block has no more places than finest cells, whatever the number of ranges.
    """
    marks = []
    for df, side in ((left, "l"), (right, "r")):
        d = cut(df.select("lo", "hi"), levels)
        ends = F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("by")), F.struct(F.col("hi").alias("at"), F.lit(-1).alias("by")))).alias("e")
        m = d.select("block", ends).groupBy("block", "e.at").agg(F.sum("e.by").alias("by"))
        marks.append(m.select("block", "at", *[(F.col("by") if s == side else F.lit(0).cast("long")).alias(s) for s in "lr"]))
    m = marks[0].unionByName(marks[1]).groupBy("block", "at").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    w = Window.partitionBy("block").orderBy("at")
    m = m.select("at", F.lead("at").over(w).alias("hi"), F.sum("l").over(w).alias("l"), F.sum("r").over(w).alias("r"))
    return m.where("hi is not null and (l > 0 or r > 0)").select(F.col("at").alias("lo"), "hi", (F.col("l") > 0).alias("in_left"), (F.col("r") > 0).alias("in_right"))


OPERATIONS = {"union": "true", "intersection": "in_left and in_right", "difference": "in_left and not in_right", "symmetric difference": "in_left != in_right"}


def merged(pieces: DataFrame, levels: int = 12) -> DataFrame:
    """Ranges of an area without overlaps and without two that touch inside a block."""
    d = cut(pieces.select("lo", "hi"), levels)
    w = Window.partitionBy("block").orderBy("lo", "hi")
    d = d.distinct().withColumn("before", F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    d = d.withColumn("part", F.sum(F.when(F.col("lo") <= F.col("before"), 0).otherwise(1)).over(w))
    return d.groupBy("block", "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("lo", "hi")
