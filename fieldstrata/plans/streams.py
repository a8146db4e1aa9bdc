"""Queries on states built by streams, each run to the end of its input."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import datasets as d
from ..sources import formats as fm
from ..sources.store import shared_path
from ..streaming import ingest as st
from .registry import query

STANDS = f"{d.MARKUPS}, l AS (SELECT *, last_value(CASE WHEN op IN ('insert', 'delete') THEN op END IGNORE NULLS) OVER (PARTITION BY image, number ORDER BY op_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM markups), b AS (SELECT image, number, op_no, op, x, y, w, h, coalesce(op = 'insert' OR last = 'insert', FALSE) AS ok FROM l)"
CURRENT = f"WITH {STANDS} SELECT image, number, op_no, op, x, y, w, h FROM (SELECT *, row_number() OVER (PARTITION BY image, number ORDER BY op_no DESC) AS k FROM b WHERE ok) WHERE k = 1 AND op <> 'delete'"


@query(CURRENT)
def r02_markup_state(spark, sf_dir):
    return st.apply_operations(None, d.markup_log(spark, sf_dir), ["image", "number"], "op_no")[0]


@query(f"WITH {STANDS} SELECT image, number, op_no, op, x, y, w, h, 'File Missing!' AS message FROM b WHERE NOT ok")
def r02_refused_operations(spark, sf_dir):
    return st.apply_operations(None, d.markup_log(spark, sf_dir), ["image", "number"], "op_no")[1]


def _markup_changes(spark, sf_dir):
    """Changes of a stream of files in the order of the operations, run twice: the second run goes on from the first."""
    home = shared_path(spark, "markups")
    log = d.markup_log(spark, sf_dir)
    for n in range(3):  # operations arrive in turn
        log.where(f"least(op_no, 3) = {n + 1}").write.parquet(f"{home}/in/{n}")
        if n:  # a run after the second and after the third arrival
            source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 8).option("recursiveFileLookup", "true").parquet(f"{home}/in")
            st.markup_stream(source, ["image", "number"], "op_no", f"{home}/out", f"{home}/checkpoint")
    return st.changes(spark, log.schema, f"{home}/out")


@query(CURRENT)
def r02_markup_stream(spark, sf_dir):
    """The same state by keys in the state store, several batches and two runs long."""
    found = st.current_markups(_markup_changes(spark, sf_dir), ["image", "number"], "op_no")
    return found.select("image", "number", "op_no", "op", "x", "y", "w", "h")


@query(f"WITH {STANDS} SELECT image, number, op_no, op, x, y, w, h, 'File Missing!' AS message FROM b WHERE NOT ok")
def r02_refused_in_stream(spark, sf_dir):
    return st.refused(_markup_changes(spark, sf_dir))


@query(f"WITH {d.TRACKS} SELECT track::VARCHAR AS track, seq - 1 AS seq, lon, lat, ele, ts AS time FROM points")
def r01_track_stream(spark, sf_dir):
    """GPX documents of all tracks, many in a file, taken up by a stream as track points."""
    home = shared_path(spark, "gpx")
    docs = fm.gpx_documents(d.track_points(spark, sf_dir))
    docs = docs.select(*[F.col(c).cast("string").alias(n) for c, n in zip(docs.columns, ("track", "gpx"), strict=True)])
    docs.write.json(f"{home}/in")
    st.track_rows(spark.readStream.schema(docs.schema).json(f"{home}/in"), f"{home}/out", f"{home}/checkpoint")
    return spark.read.parquet(f"{home}/out")


@query("SELECT DISTINCT user_id AS upload, event_type AS file FROM events")
def r03_duplicate_uploads(spark, sf_dir):
    """Uploads of a stream without those that come again within the bound."""
    home = shared_path(spark, "uploads")
    e = d.table(spark, sf_dir, "events").select(F.col("user_id").alias("upload"), F.col("event_type").alias("file"), F.col("ts").cast("timestamp").alias("ts"))
    e.write.parquet(f"{home}/in")
    source = spark.readStream.schema(e.schema).parquet(f"{home}/in")
    q = st.once_per_upload(source).writeStream.format("parquet").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start(f"{home}/out")
    q.awaitTermination()
    return spark.read.parquet(f"{home}/out").select("upload", "file")


@query(
    "WITH e AS (SELECT event_id AS file, user_id AS upload, event_id % 600 AS s FROM events) SELECT upload, file, s AS at FROM e "
    "UNION ALL SELECT upload, file, s + 10800 FROM e WHERE file % 7 = 0"
)
def r03_late_uploads(spark, sf_dir):
    """Five batches across the watermark of an hour: copies ten minutes later and three hours later, as long as the first is
    known, are dropped; after the watermark has passed they count as new; rows older than the watermark are late."""
    home = shared_path(spark, "late-uploads")
    e = d.table(spark, sf_dir, "events").select(F.col("user_id").alias("upload"), F.col("event_id").alias("file"), (F.col("event_id") % 600).alias("at"))
    later = lambda seconds: (F.col("at") + seconds).alias("at")
    batches = [
        e,
        e.where("file % 3 = 0").select("upload", "file", later(600)),
        e.where("file % 5 = 0").select("upload", "file", later(10800)),
        e.where("file % 13 = 0").select("upload", "file", later(10800)),
        e.where("file % 7 = 0").select("upload", "file", later(10800)).unionByName(e.where("file % 11 = 0").select("upload", (-F.col("file") - 1).alias("file"), "at")),
    ]
    files = 4
    for n, b in enumerate(batches):
        b.withColumn("ts", F.timestamp_seconds(F.col("at") + 1_700_000_000)).repartition(files).write.parquet(f"{home}/in/{n}")
    source = spark.readStream.schema(spark.read.parquet(f"{home}/in/0").schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(f"{home}/in")
    q = st.once_per_upload(source).writeStream.format("parquet").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start(f"{home}/out")
    q.awaitTermination()
    return spark.read.parquet(f"{home}/out").select("upload", "file", "at")
