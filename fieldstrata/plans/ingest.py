"""Queries on uploads, photos, markups and keys."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ingest as g
from ..operators import catalog as c
from ..sources import datasets as d
from .registry import query

FILES = "files AS (SELECT p_partkey AS file, p_partkey % 200 AS upload, p_name || CASE WHEN p_partkey % 40 = 7 THEN '.GPX' ELSE '.JPG' END AS name, (p_retailprice * 5000)::BIGINT AS size FROM part)"


def files(spark, sf_dir):
    p = d.table(spark, sf_dir, "part")
    name = F.concat("p_name", F.when(F.col("p_partkey") % 40 == 7, ".GPX").otherwise(".JPG"))
    return p.select(F.col("p_partkey").alias("file"), (F.col("p_partkey") % 200).alias("upload"), name.alias("name"), F.round(F.col("p_retailprice") * 5000).cast("long").alias("size"))


@query(f"WITH {FILES} SELECT file, upload, name, size FROM files WHERE upload NOT IN (SELECT upload FROM files WHERE NOT (lower(split_part(name, '.', -1)) = 'jpg' AND size <= 8388608))")
def f01_photo_batches(spark, sf_dir):
    f = files(spark, sf_dir)
    return c.whole_batches(f, "upload", (g.extension(F.col("name")) == "jpg") & (F.col("size") <= g.PHOTO_BYTES))


@query(f"WITH {FILES} SELECT file, upload, name, size FROM files WHERE upload NOT IN (SELECT upload FROM files WHERE lower(split_part(name, '.', -1)) <> 'gpx')")
def f02_track_batches(spark, sf_dir):
    return c.whole_batches(files(spark, sf_dir), "upload", g.extension(F.col("name")) == "gpx")


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE s_suppkey > 0 AND s_name <> ''")
def f03_attribute_query(spark, sf_dir):
    return d.table(spark, sf_dir, "supplier").where("s_suppkey > 0 and s_name != ''").select("s_suppkey", "s_name", "s_nationkey")


@query(f"WITH {d.IMAGES} SELECT image, width, height FROM images WHERE upload = 7")
def f04_images_of_upload(spark, sf_dir):
    return d.images(spark, sf_dir).where("upload = 7").select("image", "width", "height")


@query("SELECT c_custkey AS k, coalesce(f, -1) AS first FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS f FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def f05_first_match(spark, sf_dir):
    f = d.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("f"))
    return d.table(spark, sf_dir, "customer").join(f, F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("c_custkey").alias("k"), F.coalesce("f", F.lit(-1)).alias("first"))


@query(f"WITH {d.SPRINGS} SELECT upload, lon, lat FROM springs WHERE lon BETWEEN -20 AND 60 AND lat BETWEEN 0 AND 50")
def f06_extent(spark, sf_dir):
    return d.springs(spark, sf_dir).where(g.in_extent(F.col("lon"), F.col("lat"), -20, 0, 60, 50)).select("upload", "lon", "lat")


@query("SELECT p_partkey, regexp_matches(lower(substr(md5(p_name), 1, 8) || '-' || substr(md5(p_name), 9, 4) || '-' || substr(md5(p_name), 13, 4) || '-' || substr(md5(p_name), 17, 4) || '-' || substr(md5(p_name), 21, CASE WHEN p_partkey % 2 = 0 THEN 12 ELSE 11 END)), '^[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}$') AS valid FROM part")
def f10_uuid_validity(spark, sf_dir):
    m = F.md5("p_name")
    cut = F.when(F.col("p_partkey") % 2 == 0, F.substring(m, 21, 12)).otherwise(F.substring(m, 21, 11))
    t = F.concat_ws("-", F.substring(m, 1, 8), F.substring(m, 9, 4), F.substring(m, 13, 4), F.substring(m, 17, 4), cut)
    return d.table(spark, sf_dir, "part").select("p_partkey", g.is_uuid(t).alias("valid"))


@query("SELECT o_orderkey, try_cast(CASE WHEN o_orderkey % 5 = 0 THEN 'x' || o_orderkey ELSE o_orderkey::VARCHAR END AS DOUBLE) AS x FROM orders WHERE try_cast(CASE WHEN o_orderkey % 5 = 0 THEN 'x' || o_orderkey ELSE o_orderkey::VARCHAR END AS DOUBLE) IS NOT NULL")
def f11_numeric_points(spark, sf_dir):
    t = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("x"), F.col("o_orderkey").cast("string"))).otherwise(F.col("o_orderkey").cast("string"))
    return d.table(spark, sf_dir, "orders").select("o_orderkey", t.try_cast("double").alias("x")).where("x is not null")


@query("SELECT o_orderkey AS image, CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END * ((o_orderkey % 90) + (o_orderkey % 60) / 60e0 + (o_orderkey * 13 % 6000) / 100e0 / 3600) AS lat, CASE WHEN o_orderkey % 3 = 1 THEN -1 ELSE 1 END * ((o_orderkey * 7 % 5000) / 10e0) AS alt, CASE WHEN o_orderkey % 4 = 0 THEN (o_orderkey % 360) / 1e0 ELSE (o_orderkey % 360) / 1e0 - 9.77e0 END AS heading FROM orders")
def e01_e02_exif_position(spark, sf_dir):
    k = F.col("o_orderkey")
    s = lambda x: x.cast("string")
    o = d.table(spark, sf_dir, "orders").select(
        k.alias("image"),
        F.array(F.concat(s(k % 90), F.lit("/1")), F.concat(s(k % 60), F.lit("/1")), F.concat(s(k * 13 % 6000), F.lit("/100"))).alias("lat"),
        F.when(k % 2 == 0, "S").otherwise("N").alias("lat_ref"), F.concat(s(k * 7 % 5000), F.lit("/10")).alias("alt"), F.when(k % 3 == 1, "1").otherwise("0").alias("alt_ref"),
        F.concat(s(k % 360), F.lit("/1")).alias("dir"), F.when(k % 4 == 0, "T").otherwise("M").alias("dir_ref"),
    )
    return o.select("image", g.dms(F.col("lat"), F.col("lat_ref")).alias("lat"), g.altitude(F.col("alt"), F.col("alt_ref")).alias("alt"), g.heading(F.col("dir"), F.col("dir_ref")).alias("heading"))


@query("SELECT o_orderkey AS image, strftime(CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END, '%Y/%m/%d') AS day, strftime(o_orderdate, '%m-%d-%Y') AS file_day, strftime(o_orderdate, '%H:%M:%S') AS file_time FROM orders")
def e03_e04_capture_date(spark, sf_dir):
    t = "yyyy:MM:dd HH:mm:ss"
    o = d.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image"), "o_orderdate", F.when(F.col("o_orderkey") % 3 != 0, F.date_format("o_orderdate", t)).alias("original"), F.date_format(F.col("o_orderdate") + F.expr("interval 1 day"), t).alias("ifd0"))
    day, time = g.file_stamp(F.col("o_orderdate"))
    return o.select("image", g.capture_date(F.col("original"), F.col("ifd0")).alias("day"), day.alias("file_day"), time.alias("file_time"))


@query("SELECT event_id, strftime(ts + INTERVAL 7 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS utc FROM events")
def d01_utc_text(spark, sf_dir):
    return d.table(spark, sf_dir, "events").select("event_id", g.utc_text(F.col("ts"), "America/Phoenix").alias("utc"))


@query("SELECT event_id, ts - to_seconds(3600 + (event_id % 10) * 900) AS utc FROM events")
def d02_utc_by_offset(spark, sf_dir):
    return d.table(spark, sf_dir, "events").select("event_id", g.utc_by_offset(F.col("ts"), F.lit(3600), F.col("event_id") % 10 * 900).alias("utc"))


@query("SELECT o_orderkey, o_orderdate + INTERVAL 14 MONTH + INTERVAL 3 DAY + INTERVAL 4 HOUR + INTERVAL 5 MINUTE + INTERVAL 6 SECOND AS adjusted FROM orders")
def d03_adjust_time(spark, sf_dir):
    i = F.make_interval(F.lit(1), F.lit(2), F.lit(0), F.lit(3), F.lit(4), F.lit(5), F.lit(6))
    return d.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderdate") + i).alias("adjusted"))


@query("SELECT event_id, ts AS at FROM (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE date_trunc('milliseconds', ts) END AS ts FROM events)")
def d04_epoch_millis(spark, sf_dir):
    ms = F.when(F.col("event_id") % 9 != 0, F.unix_millis(F.col("ts").cast("timestamp")))
    return d.table(spark, sf_dir, "events").select("event_id", F.timestamp_millis(ms).cast("timestamp_ntz").alias("at"))


@query(f"WITH {FILES} SELECT file, lower(split_part(name, '.', -1)) AS ext, split_part(name, '.', 1) AS base FROM files")
def n01_file_names(spark, sf_dir):
    return files(spark, sf_dir).select("file", g.extension(F.col("name")).alias("ext"), g.base_name(F.col("name")).alias("base"))


def _uuid_sql(h: str, v: int) -> str:
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-{v}' || substr({h}, 14, 3) || '-' || lower(printf('%x', (('0x' || substr({h}, 17, 2))::INT & 63) | 128)) || substr({h}, 19, 2) || '-' || substr({h}, 21, 12)"


NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


@query(f"SELECT p_partkey, {_uuid_sql('h', 5)} AS v5 FROM (SELECT p_partkey, sha1(unhex('{NAMESPACE.replace('-', '')}') || encode(p_name)) AS h FROM part)")
def n02_name_uuid(spark, sf_dir):
    return d.table(spark, sf_dir, "part").select("p_partkey", g.name_uuid(NAMESPACE, F.col("p_name")).alias("v5"))


@query("SELECT p_partkey, md5(p_name) AS digest FROM part")
def n04_md5(spark, sf_dir):
    return d.table(spark, sf_dir, "part").select("p_partkey", F.md5("p_name").alias("digest"))


@query("SELECT p_partkey, lower('<a>' || p_name || '</a>') AS text FROM part")
def n05_clean_xml(spark, sf_dir):
    t = F.concat(F.lit("<a>"), "p_name", F.lit("<![CDATA[x <b>\n]]></a>"))
    return d.table(spark, sf_dir, "part").select("p_partkey", g.clean_xml(t).alias("text"))


@query("SELECT event_id, event_type AS title, event_id % 5 AS number FROM events")
def n06_last_object(spark, sf_dir):
    """Markup metadata: the last object of the document's list."""
    shape = F.struct(F.lit("circle").alias("title"), F.lit(0).cast("long").alias("number"))
    doc = F.to_json(F.struct(F.array(shape, F.struct(F.col("event_type").alias("title"), (F.col("event_id") % 5).alias("number"))).alias("objects")))
    e = d.table(spark, sf_dir, "events").select("event_id", g.last_object(doc, "title: string, number: bigint").alias("o"))
    return e.select("event_id", "o.title", "o.number")


@query("SELECT coalesce(max(o_orderkey), 0) + 1 AS next_id FROM orders")
def a12_next_id(spark, sf_dir):
    return c.next_id(d.table(spark, sf_dir, "orders"), "o_orderkey")


@query(f"WITH {d.MARKUPS} SELECT image, max(number) AS highest, count(*) AS entries FROM markups GROUP BY image")
def a13_a14_markup_counts(spark, sf_dir):
    return d.markup_log(spark, sf_dir).groupBy("image").agg(F.max("number").alias("highest"), F.count("*").alias("entries"))


@query(f"WITH {FILES} SELECT upload, sum(size)::BIGINT AS bytes, count(*) AS files FROM files GROUP BY upload")
def a22_upload_bytes(spark, sf_dir):
    return files(spark, sf_dir).groupBy("upload").agg(F.sum("size").alias("bytes"), F.count("*").alias("files"))


@query("SELECT (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY c_custkey) AS id, c_custkey FROM customer")
def w02_sequential_ids(spark, sf_dir):
    start = c.next_id(d.table(spark, sf_dir, "orders"), "o_orderkey").first()[0]
    return c.append_ids(spark, d.table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], start)


@query(f"WITH {d.MARKUPS} SELECT image, number, op_no, op, x, y, w, h FROM (SELECT *, row_number() OVER (PARTITION BY image, number ORDER BY op_no DESC) AS k FROM markups) WHERE k = 1 AND op <> 'delete'")
def w05_current_markups(spark, sf_dir):
    return c.current_versions(d.markup_log(spark, sf_dir), ["image", "number"], "op_no")


@query(f"WITH {d.IMAGES} SELECT image, strftime(taken, '%Y%m%d_%H%M%S') || CASE WHEN k > 1 THEN '_' || (k - 1) ELSE '' END AS name FROM (SELECT *, row_number() OVER (PARTITION BY strftime(taken, '%Y%m%d_%H%M%S') ORDER BY image) AS k FROM images)")
def w07_capture_names(spark, sf_dir):
    return c.capture_names(d.images(spark, sf_dir), "taken", "image").select("image", "name")


@query("SELECT p_partkey, k % 4 AS z, k // 4 AS t FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey % 50 ORDER BY p_partkey // 50) - 1 AS k FROM part)")
def w10_stack_assembly(spark, sf_dir):
    """Natural order of file names in each directory, dealt to planes and times."""
    f = d.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 50).alias("dir"), F.concat(F.lit("img"), F.floor(F.col("p_partkey") / 50).cast("string"), F.lit(".tif")).alias("name"))
    k = F.row_number().over(Window.partitionBy("dir").orderBy(c.natural_key(F.col("name")))) - 1
    return f.select("p_partkey", k.alias("k")).select("p_partkey", (F.col("k") % 4).cast("long").alias("z"), F.floor(F.col("k") / 4).alias("t"))


@query(
    "WITH f AS (SELECT p_partkey, p_partkey % 7 AS dir, p_size AS a, p_partkey // 7 % 300 AS b, p_partkey AS c FROM part) "
    "SELECT p_partkey, (k % 5)::BIGINT AS z, k // 5 AS t FROM (SELECT p_partkey, row_number() OVER (PARTITION BY dir ORDER BY CASE WHEN dir < 5 THEN c END, b, a, c) - 1 AS k FROM f)"
)
def w10_two_block_names(spark, sf_dir):
    """Names of several numbers: the last one that all files of a directory have decides first; leading zeros do not count."""
    k, dir_ = F.col("p_partkey"), F.col("p_partkey") % 7
    short = F.concat(F.lit("s"), F.col("p_size").cast("string"), F.lit("_t"), F.floor(k / 7 % 300).cast("string"))
    name = F.when(dir_ < 5, F.concat(short, F.lit("_n"), F.lpad(k.cast("string"), 30, "0"))).otherwise(short)
    # from directory 5 on the names that end at the second number are not distinct without their key, which is no common block
    name = F.when((dir_ >= 5) & (k > 13), F.concat(name, F.lit("_n"), F.lpad(k.cast("string"), 12, "0"))).otherwise(name)
    return c.stack_order(d.table(spark, sf_dir, "part").select("p_partkey", dir_.alias("dir"), name.alias("name")), "dir", "name", 5).select("p_partkey", "z", "t")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 1")
def t01_newest(spark, sf_dir):
    return d.table(spark, sf_dir, "orders").select("o_orderkey").orderBy(F.desc("o_orderkey")).limit(1)


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_name, s_suppkey LIMIT 30")
def t02_first_names(spark, sf_dir):
    return d.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name").orderBy("s_name", "s_suppkey").limit(30)


@query(f"WITH {d.MARKUPS} SELECT image, string_agg(n, ',' ORDER BY n) AS list FROM (SELECT DISTINCT image, 'markup_' || number AS n FROM markups) GROUP BY image")
def t03_markup_list(spark, sf_dir):
    n = d.markup_log(spark, sf_dir).select("image", F.concat(F.lit("markup_"), F.col("number").cast("string")).alias("n"))
    return n.groupBy("image").agg(F.array_join(F.sort_array(F.collect_set("n")), ",").alias("list"))
