"""Queries on image plans, annotations, uploads and stores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import annotations as an
from ..functions import images as g
from ..functions import ingest as ing
from ..operators import catalog as c
from ..sources import datasets as d
from ..sources import stores
from .registry import query

# image plans


@query(f"WITH {d.IMAGES}, l AS (SELECT image, width, height, k, width >> k AS w, height >> k AS h FROM images, range(0, 14) t(k)), s AS (SELECT image, min(k) AS last FROM l WHERE w <= 256 AND h <= 256 GROUP BY image), v AS (SELECT l.image, last - k AS level, w, h, greatest(ceil(w / 256e0), 1)::BIGINT AS tx, greatest(ceil(h / 256e0), 1)::BIGINT AS ty FROM l JOIN s USING (image) WHERE k <= last), b AS (SELECT *, coalesce(sum(tx * ty) OVER (PARTITION BY image ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM v) SELECT image, level, w, h, base AS first_tile, printf('TileGroup%d/%d-%d-%d.jpg', (base + tx * ty - 1) // 256, level, tx - 1, ty - 1) AS last_name FROM b")
def u03_u04_zoomify_levels(spark, sf_dir):
    """Levels in the form that keeps halving until one tile is enough, with the first tile's number and the last one's name."""
    return g.zoomify_ends(d.images(spark, sf_dir))


@query(f"WITH {d.IMAGES}, i AS (SELECT image, width % 300 + 20 AS width, height % 300 + 20 AS height FROM images), l AS (SELECT image, k, width >> k AS w, height >> k AS h FROM i, range(0, 6) t(k)), s AS (SELECT image, greatest(min(k) - 1, 0) AS last FROM l WHERE w <= 129 AND h <= 129 GROUP BY image) SELECT l.image, last - k AS level, w, h, printf('tile=%d,%d,%d,%d', last - k, 0, 0, 256) AS name FROM l JOIN s USING (image) WHERE k <= last")
def u03_service_levels(spark, sf_dir):
    """Levels of small images in the form that always keeps the full size."""
    i = d.images(spark, sf_dir).withColumn("width", F.col("width") % 300 + 20).withColumn("height", F.col("height") % 300 + 20)
    zero = F.lit(0)
    return g.service_levels(i).select("image", "level", "w", "h", g.service_name(F.col("level"), zero, zero).alias("name"))


@query(f"WITH {d.IMAGES}, z AS (SELECT image, z AS zoom, width, height, (1 << z) * 256 AS side FROM images, range(0, 9) t(z)), k AS (SELECT image, zoom, greatest(width::DOUBLE / side, height::DOUBLE / side) AS r, width, height FROM z WHERE NOT (side > width AND side > height)), s AS (SELECT image, zoom, greatest(round(width / r), 1)::INT AS w, greatest(round(height / r), 1)::INT AS h FROM k) SELECT image, zoom::INT AS zoom, x::INT AS x, y::INT AS y, (x * 256)::INT AS left, (h - (y + 1) * 256)::INT AS top, zoom || '/' || x || '/' || y || '.jpg' AS path FROM s, LATERAL (SELECT unnest(range(ceil(w / 256e0)::INT)) AS x) p, LATERAL (SELECT unnest(range(ceil(h / 256e0)::INT)) AS y) q")
def u05_map_tiles(spark, sf_dir):
    return g.map_tiles(d.images(spark, sf_dir))


@query(f"WITH {d.IMAGES}, s AS (SELECT image, pow(2, ceil(log2(greatest(width, height))))::BIGINT AS side FROM images), l AS (SELECT image, side, k AS level, side >> k AS box, 1 << k AS n FROM s, range(0, 8) t(k) WHERE k = 0 OR side >> k >= 512) SELECT image, side, level::INT AS level, x::INT AS column, y::INT AS row, (x * box)::BIGINT AS left, (y * box)::BIGINT AS top, ((x + 1) * box)::BIGINT AS right, ((y + 1) * box)::BIGINT AS bottom FROM l, LATERAL (SELECT unnest(range(n)) AS x) p, LATERAL (SELECT unnest(range(n)) AS y) q")
def u06_quad_boxes(spark, sf_dir):
    return g.quad_boxes(d.images(spark, sf_dir))


@query("SELECT o_orderkey AS image, CASE o_orderkey % 7 WHEN 0 THEN n - n // 2 WHEN 1 THEN n // 2 - 20 WHEN 2 THEN (n - 120) // 2 WHEN 3 THEN n - 120 + 20 WHEN 4 THEN 90 WHEN 5 THEN -1 ELSE 0 END::INT AS at FROM (SELECT o_orderkey, 2 * (o_orderkey % 500) + 200 AS n FROM orders)")
def i01_smart_coordinates(spark, sf_dir):
    """Written coordinates as pixels; -1 for what cannot be read."""
    texts = ["100%-50%", "50%     -20", "center", "bottom+20", "100--++++-10", "5+2+", "left"]
    size = (F.col("o_orderkey") % 500 * 2 + 200).cast("int")
    o = d.table(spark, sf_dir, "orders")
    k = o.select(F.col("o_orderkey").alias("image"), size.alias("n"), F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("o_orderkey") % 7 + 1).cast("int")).alias("t"))
    return k.select("image", g.coordinate(F.col("t"), F.col("n"), F.when(F.col("t").rlike("center|bottom"), F.lit(120)).otherwise(0)).alias("at")).select("image", F.coalesce("at", F.lit(-1)).alias("at"))


RATIO = {"inside": "greatest", "outside": "least"}


def _fits() -> str:
    parts = []
    for fit in ("inside", "outside", "fill"):
        w, h = ("bw::DOUBLE", "bh::DOUBLE") if fit == "fill" else (f"round(width / {RATIO[fit]}(width::DOUBLE / bw, height::DOUBLE / bh))", f"round(height / {RATIO[fit]}(width::DOUBLE / bw, height::DOUBLE / bh))")
        for scale, same in (("any", "FALSE"), ("down", "nw >= width AND nh >= height"), ("up", "nw <= width AND nh <= height")):
            parts.append(f"SELECT image, '{fit}' AS fit, '{scale}' AS scale, CASE WHEN {same} THEN width ELSE nw END::INT AS w, CASE WHEN {same} THEN height ELSE nh END::INT AS h FROM (SELECT *, {w} AS nw, {h} AS nh FROM b)")
    return " UNION ALL ".join(parts)


@query(f"WITH {d.IMAGES}, b AS (SELECT image, width, height, image % 900 + 100 AS bw, CASE WHEN image % 5 = 0 THEN floor(height * (image % 900 + 100) / width) ELSE image % 700 + 100 END AS bh FROM images) {_fits()}")
def i02_resize(spark, sf_dir):
    """Sizes by the three fits and the three directions; every fifth box has no height of its own."""
    i = d.images(spark, sf_dir)
    bw, bh = (F.col("image") % 900 + 100).cast("int"), F.when(F.col("image") % 5 != 0, (F.col("image") % 700 + 100).cast("int"))
    sizes = []
    for fit in ("inside", "outside", "fill"):
        for scale in ("any", "down", "up"):
            w, h = g.resized(F.col("width"), F.col("height"), bw, bh, fit, scale)
            sizes.append(F.struct(F.lit(fit).alias("fit"), F.lit(scale).alias("scale"), w.alias("w"), h.alias("h")))
    return i.select("image", F.explode(F.array(*sizes)).alias("s")).select("image", "s.*")


@query(f"WITH {d.IMAGES} SELECT image, 'IMG' || image || n || '.jpg' AS name FROM images, (VALUES ('_thumb'), ('_small'), ('_medium'), ('_large')) b(n)")
def i04_thumbnail_names(spark, sf_dir):
    i = d.images(spark, sf_dir).select("image", F.concat(F.lit("IMG"), F.col("image").cast("string"), F.lit(".JPG")).alias("file"), F.explode(F.array(*[F.lit(n) for n in g.THUMBNAIL_NAMES])).alias("n"))
    return i.select("image", g.thumbnail_name(F.col("file"), F.col("n")).alias("name"))


PIX = "px AS (SELECT vec_id, label AS channel, unnest(embedding)::DOUBLE AS v FROM embeddings), mm AS (SELECT channel, min(v) AS lo, max(v) AS hi FROM px GROUP BY channel)"


def _pixels(spark, sf_dir):
    return d.table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("channel"), F.explode(F.col("embedding").cast("array<double>")).alias("v"))


@query(f"WITH {PIX.replace('FROM embeddings)', 'FROM embeddings WHERE vec_id % 3 <> 0)')}, hist AS (SELECT channel, least(floor((v - lo) / (hi - lo) * 64), 63)::INT AS bin, count(*) AS n FROM px JOIN mm USING (channel) GROUP BY ALL), s AS (SELECT channel, round(avg(v), 9) AS average, round(stddev_pop(v), 9) AS deviation FROM px GROUP BY channel) SELECT s.*, first_bin, last_bin, full_bins, fullest, emptiest FROM s JOIN (SELECT channel, min(bin) AS first_bin, max(bin) AS last_bin, count(*) AS full_bins, arg_max(bin, (n, -bin)) AS fullest, arg_min(bin, (n, bin)) AS emptiest FROM hist GROUP BY channel) USING (channel)")
def a16_histogram_statistics(spark, sf_dir):
    """Statistics of histograms under a mask."""
    s = g.histogram_statistics(_pixels(spark, sf_dir), "channel", "v", 64, F.col("vec_id") % 3 != 0)
    return s.withColumn("average", F.round("average", 9)).withColumn("deviation", F.round("deviation", 9))


@query(f"WITH {PIX} SELECT channel, least(greatest(round((v - lo) / (hi - lo) * 255), 0), 255)::INT AS normalised, least(greatest(round((v + 1) / 2 * 255), 0), 255)::INT AS linear, count(*) AS n FROM px JOIN mm USING (channel) GROUP BY ALL")
def i05_linear_levels(spark, sf_dir):
    """Values on a linear scale over the range of the data of their channel, and over the range of the type (-1 to 1)."""
    px = _pixels(spark, sf_dir)
    mm = px.groupBy(F.col("channel").alias("k")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    j = px.join(mm, F.col("channel") == F.col("k"))
    one = F.lit(1.0)
    return j.groupBy("channel", g.linear_levels(F.col("v"), F.col("lo"), F.col("hi")).alias("normalised"), g.linear_levels(F.col("v"), -one, one).alias("linear")).agg(F.count("*").alias("n"))


MATRIX = (2.0, 1.0, -1.0, 2.0, 10.0, -5.0)


@query(f"WITH {d.SITES} SELECT site, 2 * x - y + 10 AS ax, x + 2 * y - 5 AS ay, round(x, 6) AS bx, round(y, 6) AS by FROM sites")
def m01_affine(spark, sf_dir):
    """Points through a matrix and back."""
    a = g.affine(F.col("x"), F.col("y"), MATRIX)
    s = d.sites(spark, sf_dir).select("site", a[0].alias("ax"), a[1].alias("ay"))
    b = g.affine(F.col("ax"), F.col("ay"), g.inverse(MATRIX))
    return s.select("site", "ax", "ay", F.round(b[0], 6).alias("bx"), F.round(b[1], 6).alias("by"))


@query(f"WITH {d.SITES}, p AS (SELECT site, x AS p, y AS q, y AS r, x AS t FROM sites) SELECT site, p + r AS add_x, q + t AS add_y, p - r AS sub_x, q - t AS sub_y, least(p, r) AS min_x, least(q, t) AS min_y, greatest(p, r) AS max_x, greatest(q, t) AS max_y, p = r AND q = t AS eq, p < r AND q < t AS lt, p <= r AND q <= t AS lte, round(sqrt(pow(r - p, 2) + pow(t - q, 2)), 6) AS distance, round(p + (r - p) * 0.25e0, 6) AS quarter_x, round(q + (t - q) * 0.25e0, 6) AS quarter_y FROM p")
def m03_points(spark, sf_dir):
    a, b = (F.col("x"), F.col("y")), (F.col("y"), F.col("x"))
    q = g.between(a, b, 0.25)
    return d.sites(spark, sf_dir).select("site", *[v.alias(k) for k, v in g.componentwise(a, b).items()], F.round(g.distance(a, b), 6).alias("distance"), F.round(q[0], 6).alias("quarter_x"), F.round(q[1], 6).alias("quarter_y"))


@query(f"WITH {d.MARKUPS} SELECT image, min(x) AS left, min(y) AS top, CASE WHEN max(x) = min(x) THEN 1 ELSE max(x) - min(x) END::DOUBLE AS width, CASE WHEN max(y) = min(y) THEN 1 ELSE max(y) - min(y) END::DOUBLE AS height FROM markups GROUP BY image")
def m04_local_bounds(spark, sf_dir):
    """Bounds of the polygon of an image's markup corners."""
    p = d.markup_log(spark, sf_dir).groupBy("image").agg(F.collect_list("x").alias("xs"), F.collect_list("y").alias("ys"))
    left, top, w, h = g.local_bounds(F.col("xs"), F.col("ys"))
    return p.select("image", left.alias("left"), top.alias("top"), w.alias("width"), h.alias("height"))


@query("SELECT l_orderkey, arg_max(l_partkey, (l_extendedprice, l_linenumber, l_partkey)) AS dearest, arg_min(l_partkey, (l_extendedprice, l_linenumber, l_partkey)) AS cheapest FROM lineitem GROUP BY l_orderkey")
def m08_min_max_by_property(spark, sf_dir):
    by = F.struct("l_extendedprice", "l_linenumber", "l_partkey")
    return d.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_partkey", by).alias("dearest"), F.min_by("l_partkey", by).alias("cheapest"))


# annotations


def _annotation_rows(spark, sf_dir):
    """An image's markups as a tree: a group of all, in it a box for each with two corners, in that a label."""
    m = d.markup_log(spark, sf_dir).groupBy(F.col("image").alias("doc"), "number").agg(F.max("x").alias("x"), F.max("y").alias("y"), F.max("w").alias("w"), F.max("op").alias("op"))
    m = m.withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy("number")) - 1)
    none = F.lit(None).cast("double")
    corner = lambda dx, i: F.struct((F.col("x") + dx).alias("x"), F.col("y").alias("y"), none.alias("z"), none.alias("t"), none.alias("c"), F.lit(i).alias("index"))
    tags = F.create_map(F.lit("op"), F.col("op"), F.lit("probability"), (F.col("number") * 10).cast("string"))
    no_vertices, no_tags = F.array().cast(f"array<{an.VERTEX}>"), F.create_map().cast("map<string,string>")
    path = F.concat(F.lit("/0/"), F.col("place").cast("string"))
    group = m.select("doc").distinct().select("doc", F.lit("/0").alias("path"), F.lit(0).alias("depth"), F.lit("group").alias("type"), F.lit("all").alias("name"), no_tags.alias("tags"), no_vertices.alias("vertices"))
    box = m.select("doc", path.alias("path"), F.lit(1).alias("depth"), F.lit("rect").alias("type"), F.concat(F.lit("m<"), F.col("number").cast("string")).alias("name"), tags.alias("tags"), F.array(corner(F.col("w"), 1), corner(F.lit(0.0), 0)).alias("vertices"))
    label = m.select("doc", F.concat(path, F.lit("/0")).alias("path"), F.lit(2).alias("depth"), F.lit("label").alias("type"), F.lit(None).cast("string").alias("name"), no_tags.alias("tags"), no_vertices.alias("vertices"))
    return group.unionByName(box).unionByName(label)


ROWS = f"WITH {d.MARKUPS}, m AS (SELECT image AS doc, number, max(x) AS x, max(y) AS y, max(w) AS w, max(op) AS op, row_number() OVER (PARTITION BY image ORDER BY number) - 1 AS place FROM markups GROUP BY image, number)"
NUM = lambda v: f"regexp_replace(({v})::VARCHAR, '\\.0$', '')"


@query(f"{ROWS} SELECT DISTINCT doc, '/0' AS path, 0 AS depth, 'group' AS type, 'all' AS name, '' AS tags, '' AS vertices FROM m UNION ALL SELECT doc, '/0/' || place, 1, 'rect', 'm<' || number, 'op=' || op || ';probability=' || number * 10, {NUM('x')} || ' ' || {NUM('y')} || ' 0;' || {NUM('x + w')} || ' ' || {NUM('y')} || ' 1' FROM m UNION ALL SELECT doc, '/0/' || place || '/0', 2, 'label', NULL, '', '' FROM m")
def s21_u07_annotation_round_trip(spark, sf_dir):
    """Trees written as XML, one document an image, and flattened again, with tags and vertices in the order of their index."""
    from ..functions.geo import number_text as n

    rows = an.flatten_annotations(an.to_xml(_annotation_rows(spark, sf_dir)))
    tags = F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    vertices = F.array_join(F.transform("vertices", lambda v: F.concat_ws(" ", n(v["x"]), n(v["y"]), v["index"].cast("string"))), ";")
    return rows.select("doc", "path", "depth", "type", "name", tags.alias("tags"), vertices.alias("vertices"))


@query(f"{ROWS} SELECT DISTINCT doc, '/0' AS path, 0 AS n, 'group,all,' AS line FROM m UNION ALL SELECT doc, '/0/' || place, 0, 'rect,m<' || number || ', ' || {NUM('x + w')} || ',' || {NUM('y')} || ',,,,1' FROM m UNION ALL SELECT doc, '/0/' || place, 1, ' ' || {NUM('x')} || ',' || {NUM('y')} || ',,,,0' FROM m UNION ALL SELECT doc, '/0/' || place || '/0', 0, 'label,,' FROM m")
def s22_annotation_csv(spark, sf_dir):
    return an.csv_lines(_annotation_rows(spark, sf_dir))


@query(f"{ROWS} SELECT doc, 1 + 2 * count(*) AS objects, 'group,label,rect' AS types, 'op,probability' AS tags FROM m GROUP BY doc")
def a15_annotation_totals(spark, sf_dir):
    t = an.totals(_annotation_rows(spark, sf_dir))
    return t.select("doc", "objects", F.array_join("types", ",").alias("types"), F.array_join("tags", ",").alias("tags"))


@query(f"{ROWS} SELECT doc, number, x + 5 AS first_x, 2 * y AS first_y, x + w + 5 AS last_x FROM m")
def w08_m06_moved_annotations(spark, sf_dir):
    """Vertices in the order of their index, shifted along x and scaled along y."""
    r = _annotation_rows(spark, sf_dir).where("type = 'rect'")
    v = F.array_sort(an.moved(F.col("vertices"), {"x": 5.0}, {"y": 2.0}), lambda a, b: a["index"] - b["index"])
    r = r.select("doc", F.regexp_extract("name", r"(\d+)$", 1).try_cast("int").alias("number"), v.alias("v"))
    return r.select("doc", "number", F.col("v")[0]["x"].alias("first_x"), F.col("v")[0]["y"].alias("first_y"), F.col("v")[1]["x"].alias("last_x"))


@query(f"{ROWS} SELECT doc, number FROM m WHERE op <> 'delete' AND number * 10 >= 20")
def f08_visible_objects(spark, sf_dir):
    """Objects shown by type (here the operation) and probability."""
    r = _annotation_rows(spark, sf_dir).where("type = 'rect'")
    shown = an.visible(F.try_element_at("tags", F.lit("op")), F.col("tags"), exclude=["delete"], least=20.0)
    return r.where(shown).select("doc", F.regexp_extract("name", r"(\d+)$", 1).try_cast("int").alias("number"))


# uploads and stores


@query("SELECT event_id, concat_ws(',', CASE WHEN event_id % 13 = 0 THEN 'no position' END, CASE WHEN event_id % 7 = 0 THEN 'no time' END, CASE WHEN event_id % 11 = 0 THEN 'no url' END) AS reasons, CASE WHEN event_id % 5 = 0 THEN 'no title' ELSE '' END AS track_reasons FROM events WHERE event_type = 'view'")
def f07_required_fields(spark, sf_dir):
    e = d.table(spark, sf_dir, "events").where("event_type = 'view'")
    url = F.when(F.col("event_id") % 11 == 0, " ").otherwise("http://x")
    faults = ing.video_faults(F.col("value"), F.when(F.col("event_id") % 13 != 0, F.col("value")), F.when(F.col("event_id") % 7 != 0, F.col("ts")), url)
    track = ing.track_faults(F.when(F.col("event_id") % 5 != 0, F.col("event_type")))
    return e.select("event_id", F.array_join(faults, ",").alias("reasons"), F.array_join(track, ",").alias("track_reasons"))


NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


@query(f"SELECT p_partkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-' || lower(printf('%x', (('0x' || substr(h, 17, 2))::INT & 63) | 128)) || substr(h, 19, 2) || '-' || substr(h, 21, 12) AS v3 FROM (SELECT p_partkey, md5(unhex('{NAMESPACE.replace('-', '')}') || encode(p_name)) AS h FROM part)")
def n02_name_uuid_v3(spark, sf_dir):
    return d.table(spark, sf_dir, "part").select("p_partkey", ing.name_uuid(NAMESPACE, F.col("p_name"), 3).alias("v3"))


@query("SELECT (p_partkey % 200)::VARCHAR AS upload, 'f' || p_partkey || CASE WHEN p_partkey % 4 = 0 THEN '.gpx' ELSE '.jpg' END AS name, CASE WHEN p_partkey % 4 = 0 THEN 'track' ELSE 'photo' END AS type, (length(p_name) + 1)::BIGINT AS size FROM part WHERE p_partkey % 10 = 3")
def s18_upload_manifest(spark, sf_dir):
    """Files of uploads as they lie in their folders: type by extension, size, an id from upload and name."""
    m = stores.manifest(spark, stores.sample_uploads(spark, d.table(spark, sf_dir, "part")))
    return m.select("upload", "name", "type", "size")


@query("SELECT (p_partkey % 200)::VARCHAR AS upload, 'f' || p_partkey || CASE WHEN p_partkey % 4 = 0 THEN '.gpx' ELSE '.jpg' END AS name, CASE WHEN p_partkey % 4 = 0 THEN 'track' ELSE 'photo' END AS type, (length(p_name) + 1)::BIGINT AS size FROM part")
def s18_all_uploads(spark, sf_dir):
    """Files of all uploads as they lie in their folders: type by extension, size, an id from upload and name."""
    m = stores.manifest(spark, stores.sample_uploads(spark, d.table(spark, sf_dir, "part"), every=1))
    return m.select("upload", "name", "type", "size")


@query(f"WITH {d.MARKUPS} SELECT image::VARCHAR AS image, number, op_no, op FROM (SELECT *, row_number() OVER (PARTITION BY image, number ORDER BY op_no DESC) AS k FROM markups) WHERE k = 1 AND op <> 'delete'")
def s19_markup_store(spark, sf_dir):
    """Current markups written as JSON documents by upload, and read again."""
    m = c.current_versions(d.markup_log(spark, sf_dir), ["image", "number"], "op_no")
    docs = m.select((F.col("image") % 20).cast("string").alias("UPLOADID"), F.col("image").cast("string").alias("IMAGEID"), F.col("number").alias("n"), F.to_json(F.struct(F.array(F.struct("op_no", "op")).alias("objects"))).alias("doc"))
    got = stores.read_markups(spark, stores.write_markups(spark, docs))
    last = ing.last_object(F.col("doc"), "op_no: int, op: string")
    return got.select(F.col("IMAGEID").alias("image"), F.col("n").alias("number"), last["op_no"].alias("op_no"), last["op"].alias("op"))


@query(f"WITH {d.TRACKS}, l AS (SELECT track, count(*) AS points, min(lon) AS west FROM points GROUP BY track) SELECT track, points, west, 4326 AS srid FROM l")
def s20_track_table(spark, sf_dir):
    """Lines of tracks appended to a spatial table as EWKB text, and read again as geometries."""
    t = stores.append_tracks(spark, d.track_points(spark, sf_dir))
    from ..functions import geometry as ge

    return t.select("track", ge.num_points(F.col("geom")).cast("long").alias("points"), ge.bounds(F.col("geom"))["minx"].alias("west"), F.col("geom.srid").alias("srid"))
