"""Stores of uploads, markup documents and spatial tables."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.ingest import extension, name_uuid
from . import adapters
from .store import shared_path, stored

#: Namespace of the ids of uploaded files.
FILES = "5a5c0d4e-7b0a-5a43-9f5e-0d1c7a1d3b11"


def file_type(name: Column) -> Column:
    ext = extension(name)
    return F.when(ext.isin("jpg", "jpeg"), "photo").when(ext == "gpx", "track").when(ext.isin("mp4", "mov", "avi"), "video").otherwise("other")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(upload, name, type, size, id, modified) of all files under ``folder``/<upload>/; only names and sizes are read.

    Folders are listed in tasks, level by level, and what they hold goes to the shared folder: no list of files passes the
    driver. Names that begin with a dot or an underscore are left out.
    """
    home = folder if "://" in folder or folder.startswith("file:") else os.path.abspath(folder)

    def listed(batches):
        import pyarrow as pa
        from pyarrow import fs

        files, _ = fs.FileSystem.from_uri(home)
        for b in batches:
            for at in b.column(0).to_pylist():
                found = [f for f in files.get_file_info(fs.FileSelector(at)) if not f.base_name.startswith((".", "_"))]
                for part in (found[n : n + 10_000] for n in range(0, len(found), 10_000)):
                    kept = [[f.path for f in part], [f.type == fs.FileType.Directory for f in part], [f.size for f in part], [f.mtime_ns and f.mtime_ns // 1_000_000 for f in part]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(kept, (pa.string(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], names=["path", "folder", "size", "modified"])

    from pyarrow import fs

    todo, levels = spark.createDataFrame([(fs.FileSystem.from_uri(home)[1],)], "path string"), []
    while not levels or not todo.isEmpty():
        dealt = todo.repartition(2 * spark.sparkContext.defaultParallelism, "path") if levels else todo
        levels.append(stored(spark, dealt.mapInArrow(listed, "path string, folder boolean, size long, modified long"), "listed"))
        todo = levels[-1].where("folder").select("path")
    files = reduce(DataFrame.unionByName, levels).where("not folder")
    files = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("upload"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "size", F.timestamp_millis("modified").alias("modified"))
    return files.select("upload", "name", file_type(F.col("name")).alias("type"), "size", name_uuid(FILES, F.concat_ws("/", "upload", "name")).alias("id"), "modified")


def sample_uploads(spark: SparkSession, parts: DataFrame, every: int = 10) -> str:
    """Small files in folders by upload, one for every tenth (or every) part: a folder to read a manifest from."""
    home = shared_path(spark, "uploads")
    p = (parts.where("p_partkey % 10 = 3") if every > 1 else parts).select((F.col("p_partkey") % 200).cast("string").alias("upload"), F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 4 == 0, ".gpx").otherwise(".jpg")).alias("name"), F.concat("p_name", F.lit("\n")).alias("body"))

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(home if "://" in home or home.startswith("file:") else f"file://{home}")
        n = 0
        for b in batches:
            for upload, name, body in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                files.create_dir(os.path.join(base, upload))
                with files.open_output_stream(os.path.join(base, upload, name)) as out:
                    out.write(body.encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    p.mapInArrow(run, "n long").agg(F.sum("n")).first()
    return home


def write_markups(spark: SparkSession, docs: DataFrame, path: str | None = None) -> str:
    """Appends markup documents (UPLOADID, IMAGEID, n, doc) to a store, in folders by upload; returns its path.

    A document is a line of JSON with its keys, so one file holds many; Spark commits them together.
    """
    path = path or shared_path(spark, "markups")
    docs.repartition("UPLOADID").write.partitionBy("UPLOADID").mode("append").json(path)
    return path


def read_markups(spark: SparkSession, path: str, upload: str | None = None) -> DataFrame:
    """Markup documents of a store, or of one upload, whose folder alone is read then."""
    m = spark.read.schema("IMAGEID string, n int, doc string, UPLOADID string").json(path)
    return m if upload is None else m.where(F.col("UPLOADID") == upload)


def append_tracks(spark: SparkSession, points: DataFrame, url: str | None = None, properties: dict | None = None, table: str = "track_lines") -> DataFrame:
    """Appends the line of every track (track, seq, lon, lat) to a spatial table and returns the table, geometries read.

    With a JDBC ``url`` the table is in that database, else a Parquet table in the shared folder; geometries are
    EWKB in hexadecimal, as spatial databases take them.
    """
    vertices = F.transform(F.sort_array(F.collect_list(F.struct("seq", "lon", "lat"))), lambda p: g.vertex(p["lon"], p["lat"]))
    lines = points.groupBy("track").agg(g.line(vertices, F.lit(4326)).alias("geom")).where("geom is not null")
    rows = adapters.out(lines, "geom", "ewkb_hex")
    if url:
        rows.write.jdbc(url, table, mode="append", properties=properties)
        back = spark.read.jdbc(url, table, properties=properties)
    else:
        path = shared_path(spark, table)
        rows.write.mode("append").parquet(path)
        back = spark.read.parquet(path)
    return adapters.load(back, "geom", "ewkb_hex")
