"""Queries on images: sizes, tiles, histograms, boxes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import images as g
from ..sources import datasets as d
from .registry import query

FIT = "SELECT image, bw, bh, CASE WHEN width::DOUBLE / bw > height::DOUBLE / bh THEN bw ELSE greatest(round(width * bh::DOUBLE / height), 1) END::INT AS w, CASE WHEN width::DOUBLE / bw > height::DOUBLE / bh THEN greatest(round(height * bw::DOUBLE / width), 1) ELSE bh END::INT AS h FROM images"
BOXES = "(VALUES (100, 75), (200, 150), (400, 300), (1280, 960)) b(bw, bh)"


@query(f"WITH {d.IMAGES} {FIT}, {BOXES}")
def i02_i04_thumbnails(spark, sf_dir):
    """Sizes of the four thumbnails of every image, fitted inside their boxes."""
    i = d.images(spark, sf_dir).select("image", "width", "height", F.explode(F.array(*[F.struct(F.lit(a).alias("bw"), F.lit(b).alias("bh")) for a, b in g.THUMBNAILS])).alias("b"))
    w, h = g.fit_inside(F.col("width"), F.col("height"), F.col("b.bw"), F.col("b.bh"))
    return i.select("image", "b.bw", "b.bh", w.alias("w"), h.alias("h"))


@query(f"WITH {d.IMAGES}, c AS (SELECT image, greatest(0, image % 700 - 100)::INT AS x0, greatest(0, image % 300 - 50)::INT AS y0, least(width, image % 700 + 400)::INT AS x1, least(height, image % 300 + 350)::INT AS y1 FROM images) SELECT image, x0 AS x, y0 AS y, x1 - x0 AS w, y1 - y0 AS h FROM c WHERE x1 > x0 AND y1 > y0")
def i03_crop(spark, sf_dir):
    """Crop rectangles held inside the image; empty ones are left out."""
    i = d.images(spark, sf_dir)
    x, y, w, h = g.crop(F.col("width"), F.col("height"), F.col("image") % 700 - 100, F.col("image") % 300 - 50, F.lit(500), F.lit(400))
    return i.select("image", x.cast("int").alias("x"), y.cast("int").alias("y"), w.cast("int").alias("w"), h.cast("int").alias("h")).where("w > 0 and h > 0")


@query("SELECT vec_id AS image, i - 1 AS pos, embedding[i]::DOUBLE AS value FROM embeddings, range(1, 65) t(i) WHERE i - 1 >= CASE WHEN vec_id % 80 > 63 THEN 0 ELSE vec_id % 80 END AND i - 1 < CASE WHEN vec_id % 80 > 63 THEN 64 ELSE least(64, vec_id % 80 + 16) END")
def i06_region(spark, sf_dir):
    """Region of interest: an origin out of range is 0, the size the remainder then."""
    e = d.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.posexplode("embedding").alias("pos", "value"))
    first, n = g.region(F.lit(64), F.col("image") % 80, F.lit(16))
    return e.where((F.col("pos") >= first) & (F.col("pos") < first + n)).select("image", F.col("pos").cast("long").alias("pos"), F.col("value").cast("double").alias("value"))


@query(
    "WITH e AS (SELECT vec_id AS image, label, unnest(embedding)::DOUBLE AS value, unnest(range(0, 64)) AS pos FROM embeddings), "
    "r AS (SELECT image, pos % 4 AS x, pos // 4 % 4 AS y, pos // 16 AS z, value, CASE WHEN image % 6 < 4 THEN image % 6 ELSE 0 END AS ox, CASE WHEN image % 5 < 4 THEN image % 5 ELSE 0 END AS oy, CASE WHEN label % 5 < 4 THEN label % 5 ELSE 0 END AS oz, CASE WHEN image % 3 = 0 THEN 4 ELSE image % 3 END AS w, 2 AS h, 3 AS n FROM e) "
    "SELECT image, x, y, z, value FROM r WHERE x >= ox AND x < ox + w AND y >= oy AND y < oy + h AND z >= oz AND z < oz + n"
)
def i06_volume_region(spark, sf_dir):
    """A region in x, y and z of every image taken as a stack of four planes of 4 by 4."""
    e = d.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), "label", F.posexplode("embedding").alias("pos", "value"))
    at = [F.col("pos") % 4, F.floor(F.col("pos") / 4) % 4, F.floor(F.col("pos") / 16)]
    i = F.col("image")
    found = g.volume_region([F.lit(4)] * 3, [i % 6, i % 5, F.col("label") % 5], [i % 3, F.lit(2), F.lit(3)])
    for p, (first, n) in zip(at, found, strict=True):
        e = e.where((p >= first) & (p < first + n))
    return e.select("image", *[p.cast("long").alias(a) for p, a in zip(at, "xyz", strict=True)], F.col("value").cast("double").alias("value"))


LEVELS = "lv AS (SELECT image, width, height, k, (width >> k) AS w, (height >> k) AS h FROM images, range(0, 13) t(k)), stop AS (SELECT image, min(k) AS last FROM lv WHERE w <= 129 AND h <= 129 GROUP BY image)"


@query(f"WITH {d.IMAGES}, {LEVELS} SELECT lv.image, last - k AS level, w, h FROM lv JOIN stop USING (image) WHERE k <= last")
def u02_pyramid_levels(spark, sf_dir):
    return g.pyramid_levels(d.images(spark, sf_dir)).select("image", "level", "w", "h")


@query(f"WITH {d.IMAGES}, {LEVELS}, l AS (SELECT lv.image, last - k AS level, w, h, greatest(ceil(w / 256e0), 1)::BIGINT AS tx, greatest(ceil(h / 256e0), 1)::BIGINT AS ty FROM lv JOIN stop USING (image) WHERE k <= last), b AS (SELECT *, coalesce(sum(tx * ty) OVER (PARTITION BY image ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM l) SELECT image, level, x, y, base + x + y * tx AS tile, printf('%03d_%03d_%03d.jpg', level, x, y) AS name FROM b, LATERAL (SELECT unnest(range(tx)) AS x) p, LATERAL (SELECT unnest(range(ty)) AS y) q")
def u04_tiles(spark, sf_dir):
    """All tiles of every image, numbered from the smallest level on."""
    return g.image_tiles(d.images(spark, sf_dir), 256)


@query(f"WITH {d.IMAGES}, s AS (SELECT image, pow(2, ceil(log2(greatest(width, height))))::BIGINT AS side FROM images) SELECT image, side, k AS level, (side >> k) AS box, (1 << k)::BIGINT AS across FROM s, range(0, 5) t(k)")
def u06_quad_levels(spark, sf_dir):
    i = d.images(spark, sf_dir).select("image", F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest("width", "height")))).cast("long").alias("side"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    return i.select("image", "side", F.col("k").cast("long").alias("level"), F.expr("shiftright(side, k)").alias("box"), F.expr("shiftleft(1L, k)").alias("across"))


PIX = "px AS (SELECT label AS channel, unnest(embedding)::DOUBLE AS v FROM embeddings), mm AS (SELECT channel, min(v) AS lo, max(v) AS hi FROM px GROUP BY channel), hist AS (SELECT channel, least(floor((v - lo) / (hi - lo) * 256), 255)::INT AS bin, count(*) AS n FROM px JOIN mm USING (channel) GROUP BY ALL)"


@query(f"WITH {PIX} SELECT channel, bin, n, sum(n) OVER (PARTITION BY channel ORDER BY bin)::BIGINT AS cumulative FROM hist")
def a16_w06_histogram(spark, sf_dir):
    px = d.table(spark, sf_dir, "embeddings").select(F.col("label").alias("channel"), F.explode(F.col("embedding").cast("array<double>")).alias("v"))
    h = g.histogram(px, "channel", "v", 256)
    return h.withColumn("cumulative", F.sum("n").over(Window.partitionBy("channel").orderBy("bin")))


@query(f"WITH {PIX}, cu AS (SELECT channel, bin, sum(n) OVER (PARTITION BY channel ORDER BY bin) / sum(n) OVER (PARTITION BY channel) AS share FROM hist) SELECT channel, bin, floor(share * 255)::INT AS level FROM cu")
def i05_equalise(spark, sf_dir):
    """Look-up table of histogram equalisation to 0..255 for each channel."""
    px = d.table(spark, sf_dir, "embeddings").select(F.col("label").alias("channel"), F.explode(F.col("embedding").cast("array<double>")).alias("v"))
    h = g.histogram(px, "channel", "v", 256)
    w = Window.partitionBy("channel")
    share = F.sum("n").over(w.orderBy("bin")) / F.sum("n").over(w)
    return h.select("channel", "bin", F.floor(share * 255).cast("int").alias("level"))


@query("SELECT label AS channel, i - 1 AS pos, max(embedding[i])::DOUBLE AS hi, min(embedding[i])::DOUBLE AS lo FROM embeddings, range(1, 65) t(i) GROUP BY label, i")
def a17_projection(spark, sf_dir):
    p = d.table(spark, sf_dir, "embeddings").select(F.col("label").alias("channel"), F.posexplode("embedding").alias("pos", "v"))
    return p.groupBy("channel", F.col("pos").cast("long").alias("pos")).agg(F.max("v").cast("double").alias("hi"), F.min("v").cast("double").alias("lo"))


@query(f"WITH {d.MARKUPS}, c AS (SELECT image, number, op_no, x, y, w, h, radians((image % 360)::DOUBLE) AS a FROM markups), k AS (SELECT *, abs(w / 2 * cos(a)) + abs(h / 2 * sin(a)) AS ex, abs(w / 2 * sin(a)) + abs(h / 2 * cos(a)) AS ey FROM c) SELECT image, number, op_no, round(x - ex, 6) + 0 AS left, round(y - ey, 6) + 0 AS top, round(2 * ex, 6) AS width, round(2 * ey, 6) AS height FROM k")
def m02_oriented_boxes(spark, sf_dir):
    """Axis-aligned bounds of boxes turned about their centres; adding 0 makes a negative zero positive."""
    m = d.markup_log(spark, sf_dir)
    left, top, w, h = g.turned_bounds(F.col("x"), F.col("y"), F.col("w"), F.col("h"), (F.col("image") % 360).cast("double"))
    return m.select("image", "number", "op_no", (F.round(left, 6) + 0).alias("left"), (F.round(top, 6) + 0).alias("top"), F.round(w, 6).alias("width"), F.round(h, 6).alias("height"))


@query(f"WITH {d.MARKUPS} SELECT image, number, op_no, (x - 10) / 0.5e0 AS px, (y - 20) / 0.5e0 AS py, w / 0.5e0 AS pw FROM markups")
def m05_canvas_to_image(spark, sf_dir):
    m = d.markup_log(spark, sf_dir)
    px, py = g.to_image(F.col("x"), F.col("y"), F.lit(10), F.lit(20), F.lit(0.5))
    return m.select("image", "number", "op_no", px.alias("px"), py.alias("py"), (F.col("w") / 0.5).alias("pw"))


@query(f"WITH {d.SITES} SELECT site, round(x * cos(radians(30e0)) - y * sin(radians(30e0)), 6) AS rx, round(x * sin(radians(30e0)) + y * cos(radians(30e0)), 6) AS ry, x + 2 AS sx, (x + y) / 2 AS mid FROM sites")
def m01_m03_points(spark, sf_dir):
    rx, ry = g.rotate(F.col("x"), F.col("y"), 30.0)
    return d.sites(spark, sf_dir).select("site", F.round(rx, 6).alias("rx"), F.round(ry, 6).alias("ry"), (F.col("x") + 2).alias("sx"), ((F.col("x") + F.col("y")) / 2).alias("mid"))


@query("SELECT p_partkey, round(p_size * CASE p_partkey % 5 WHEN 0 THEN 96 / 25.4e0 WHEN 1 THEN 96 / 2.54e0 WHEN 2 THEN 96e0 WHEN 3 THEN 96 / 72e0 ELSE 1e0 END, 4) AS px FROM part")
def m07_unit_pixels(spark, sf_dir):
    unit = F.element_at(F.array(*[F.lit(u) for u in ("mm", "cm", "in", "pt", "")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return d.table(spark, sf_dir, "part").select("p_partkey", F.round(g.unit_pixels(F.concat(F.col("p_size").cast("string"), unit)), 4).alias("px"))


@query("SELECT l_orderkey, arg_max(l_partkey, (l_extendedprice, l_linenumber, l_partkey)) AS dearest FROM lineitem GROUP BY l_orderkey")
def m08_max_by_property(spark, sf_dir):
    return d.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_partkey", F.struct("l_extendedprice", "l_linenumber", "l_partkey")).alias("dearest"))
