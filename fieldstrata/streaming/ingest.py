"""Streaming ingest: new files to track points, markup operations to current state, duplicate uploads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators.catalog import current_versions
from ..sources.formats import read_gpx


def track_stream(spark: SparkSession, folder: str, sink: str, checkpoint: str, name: str = r"([^/]+?)(?:-[^/]*)?\.[A-Za-z]+$") -> None:
    """Takes up GPX files that arrived in ``folder`` since the last run, as track points in Parquet.

    ``name`` finds the track in a file's path.
    """
    files = spark.readStream.schema("value string").option("wholetext", "true").option("recursiveFileLookup", "true").format("text").load(folder)
    docs = files.select(F.regexp_extract(F.col("_metadata.file_path"), name, 1).alias("track"), F.col("value").alias("gpx"))
    q = read_gpx(docs, "track").writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
    q.awaitTermination()


def track_rows(documents: DataFrame, sink: str, checkpoint: str) -> None:
    """The same for a stream of rows (track, gpx), many documents a file: one run to its present end."""
    q = read_gpx(documents, "track").writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
    q.awaitTermination()


def apply_operations(state: DataFrame | None, batch: DataFrame, key: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(new state, refused) of a batch of insert, update and delete rows.

    An update or delete of a key that does not stand at that moment is refused as "File Missing!": the key stands if
    the last insert or delete before the row is an insert or, without one in the batch, if the state has it.
    However operations are dealt into batches, state and refusals are the same.
    """
    before = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    b = batch.withColumn("_last", F.last(F.when(F.col("op").isin("insert", "delete"), F.col("op")), ignorenulls=True).over(before))
    if state is not None:
        b = b.join(state.select(*key).distinct().withColumn("_known", F.lit(True)), key, "left")
    else:
        b = b.withColumn("_known", F.lit(None).cast("boolean"))
    ok = (F.col("op") == "insert") | F.coalesce(F.col("_last") == "insert", F.col("_known"), F.lit(False))
    good = b.where(ok).select(*batch.columns)
    log = good if state is None else state.unionByName(good)
    return current_versions(log, key, order), b.where(~ok).select(*batch.columns).withColumn("message", F.lit("File Missing!"))


#: Groups of keys that the state store holds together: one group costs about as much as some hundred rows.
BUCKETS = 4096


def _keyed(columns: list[str], order: str):
    """What a batch does to the keys of a bucket: all refused operations, and of the accepted ones of a key the last; the state is
    the keys that stand, a line each."""

    def step(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["_key", order], kind="stable")
        known = set(state.get[0].split("\n")) if state.exists else set()
        texts, op, at = rows["_key"].to_numpy(), rows["op"].to_numpy(), np.arange(len(rows))
        first = np.concatenate([[True], texts[1:] != texts[:-1]])
        start, run = np.flatnonzero(first), np.cumsum(first) - 1
        was = np.array([x in known for x in texts[start]], bool)
        inserted = op == "insert"
        turn = np.maximum.accumulate(np.where(inserted | (op == "delete"), at, -1))  # the last insert or delete up to a row
        before = np.concatenate([[-1], turn[:-1]])
        good = inserted | np.where(before >= start[run], inserted[before], was[run])
        keep, last = ~good, np.maximum.reduceat(np.where(good, at, -1), start)
        keep[last[last >= 0]] = True
        end = turn[np.concatenate([start[1:], [len(rows)]]) - 1]
        stands = np.where(end >= start, inserted[end], was)
        if (stands != was).any():
            known.difference_update(texts[start][~stands])
            known.update(texts[start][stands])
            if known:
                state.update(("\n".join(known),))
            else:
                state.remove()
        yield rows.assign(message=np.where(good, None, "File Missing!"))[[*columns, "message"]][keep]

    return step


def keyed_changes(operations: DataFrame, key: list[str], order: str, buckets: int = BUCKETS) -> DataFrame:
    """A stream of operations as a stream of changes: of each batch the last accepted operation of a key, and all refused
    ones with a message. The state store keeps the keys that stand, no documents, by ``buckets`` of their hashes, so that a batch
    costs its rows and not a call a key; a run goes on only with the number of buckets it began with."""
    schema = StructType([*operations.schema.fields, StructField("message", StringType())])
    keyed = operations.withColumn("_key", F.to_json(F.struct(*key))).withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(buckets)))
    return keyed.groupBy("_bucket").applyInPandasWithState(_keyed(operations.columns, order), schema, "stands string", "append", GroupStateTimeout.NoTimeout)


def markup_stream(operations: DataFrame, key: list[str], order: str, folder: str, checkpoint: str) -> None:
    """Runs a stream of operations to its present end; ``changes`` has what all runs into ``folder`` have changed.

    Every batch writes its own changes under its number, so a batch that is run again after a failure writes the same
    place; a run without new files writes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    q = keyed_changes(operations, key, order).writeStream.outputMode("append").foreachBatch(write)
    q.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def changes(spark: SparkSession, schema: StructType, folder: str) -> DataFrame:
    """All changes of a folder with their batch; none if no batch has run yet. ``schema`` is that of the operations."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/changes")
    full = StructType([*schema.fields, StructField("message", StringType()), StructField("batch", LongType())])
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(f"{folder}/changes")


def current_markups(found: DataFrame, key: list[str], order: str) -> DataFrame:
    """The documents that stand after the ``changes``."""
    return current_versions(found.where("message is null").drop("message", "batch"), key, order)


def refused(found: DataFrame) -> DataFrame:
    return found.where("message is not null").drop("batch")


def once_per_upload(uploads: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """A stream without repeated (upload, file), as far as they arrive within ``late``.

    An upload is known to the end of the first batch whose watermark (the latest time of the batches before, less ``late``) has passed
    its time plus ``late``; the same upload after that counts as new. Rows older than the watermark of the batch before are
    dropped as late.
    """
    return uploads.withWatermark(ts, late).dropDuplicatesWithinWatermark(["upload", "file"])
