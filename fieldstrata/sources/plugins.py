"""Folders of documents as Spark data sources, and functions of the user as table functions.

``spark.dataSource.register(AnnotationFolder)`` (or another of them), then ``spark.read.format("annotations").load(folder)``,
``spark.readStream`` likewise, and ``df.write.format("annotations").save(folder)``. A user's own format is a subclass
of ``Folder`` with a ``name``, a ``schema`` and ``rows``.
"""

from __future__ import annotations

import os
import uuid
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a path or address that all executors can reach."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path))


@dataclass
class Files(InputPartition):
    paths: list[str]


class Folder(DataSource):
    """Documents of a folder, one a file, any depth. Options: path, ``suffix`` of the files, ``files`` a partition (64)."""

    #: Suffix of files where the option does not say.
    suffix = ""

    def rows(self, path: str, data: bytes) -> Iterator[tuple]:
        """Rows of one document, in the order of the schema; none for one that cannot be read."""
        raise NotImplementedError

    def schema(self) -> str:
        raise NotImplementedError

    def listed(self) -> list[tuple[int, str]]:
        """(time of change, path) of all files in the order in which streams take them; names that begin with . or _ are no documents."""
        system, base = opened(self.options["path"])
        found = system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
        wanted = self.options.get("suffix", self.suffix).lower()
        hidden = lambda p: any(x[0] in "._" for x in p[len(base) :].split("/") if x)
        return sorted((f.mtime_ns or 0, f.path) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(wanted) and not hidden(f.path))

    def dealt(self, paths: list[str]) -> list[Files]:
        n = int(self.options.get("files", 64))
        return [Files(paths[i : i + n]) for i in range(0, len(paths), n)]

    def read(self, files: Files) -> Iterator[tuple]:
        system, _ = opened(self.options["path"])
        for path in files.paths:
            with system.open_input_stream(path) as f:
                data = f.read()
            yield from self.rows(path, data)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(self)


class _Reader(DataSourceReader):
    def __init__(self, source: Folder):
        self.source = source

    def partitions(self) -> list[Files]:
        return self.source.dealt([p for _, p in self.source.listed()])

    def read(self, partition: Files | None) -> Iterator[tuple]:
        return self.source.read(partition) if partition else iter(())


class _Stream(DataSourceStreamReader):
    """Offsets are the time and path of the last file taken, so they do not grow with the folder; files are to be put
    there whole, under times that do not go back."""

    def __init__(self, source: Folder):
        self.source = source

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        last = self.source.listed()[-1:]
        return {"time": last[0][0], "path": last[0][1]} if last else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        a, b = ((o["time"], o["path"]) for o in (start, end))
        return self.source.dealt([p for t, p in self.source.listed() if a < (t, p) <= b])

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.source.read(partition)


class AnnotationFolder(Folder):
    """Objects of annotation XML, of any nesting: (doc, path, depth, type, name, tags); ``doc`` is the file's name without its
    suffix. Written rows are (doc, xml), a file a document."""

    suffix = ".xml"

    @classmethod
    def name(cls) -> str:
        return "annotations"

    def schema(self) -> str:
        return "doc string, path string, depth int, type string, name string, tags map<string,string>"

    def rows(self, path: str, data: bytes) -> Iterator[tuple]:
        doc = os.path.basename(path).rsplit(".", 1)[0]
        for at, depth, node in objects(data):
            yield doc, at, depth, node.get("type") or node.tag, node.get("name"), {t.get("name") or "": t.get("value") or "" for t in node if t.tag == "tag"}

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options.get("suffix", self.suffix), schema.names, overwrite)


class TrackFolder(Folder):
    """Points of GPX files: (track, trk, seg, seq, lon, lat, ele, time); ``track`` is the file's name without its suffix."""

    suffix = ".gpx"

    @classmethod
    def name(cls) -> str:
        return "tracks"

    def schema(self) -> str:
        return "track string, trk int, seg int, seq int, lon double, lat double, ele double, time string"

    def rows(self, path: str, data: bytes) -> Iterator[tuple]:
        try:
            root = ET.fromstring(data)
        except ET.ParseError:
            return
        plain = lambda node: node.tag.rsplit("}", 1)[-1]
        named = lambda node, tag: [c for c in node if plain(c) == tag]
        text = lambda node, tag: next((c.text for c in named(node, tag)), None)
        track = os.path.basename(path).rsplit(".", 1)[0]
        for i, trk in enumerate(named(root, "trk")):
            for j, seg in enumerate(named(trk, "trkseg")):
                for k, p in enumerate(named(seg, "trkpt")):
                    yield track, i, j, k, _number(p.get("lon")), _number(p.get("lat")), _number(text(p, "ele")), text(p, "time")


def _number(text: str | None) -> float | None:
    try:
        return float(text)
    except (TypeError, ValueError):
        return None


def objects(data: bytes | str) -> Iterator[tuple[str, int, ET.Element]]:
    """(path, depth, element) of the objects of an annotation document, parents first; none if it is malformed."""
    try:
        todo = [(ET.fromstring(data), "", 0)]
    except (ET.ParseError, TypeError):
        return
    while todo:
        node, path, depth = todo.pop()
        children = [(f"{path}/{i}", depth, c) for i, c in enumerate(x for x in node if x.tag not in ("vertex", "tag"))]
        yield from children
        todo += [(c, at, d + 1) for at, d, c in reversed(children)]


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceWriter):
    """Each task writes its documents aside; they get their names when all tasks have ended well, and go if one has not.

    Of a document that stands there its new text takes the place; with ``overwrite`` all other documents go.
    """

    def __init__(self, path: str, suffix: str, columns: list[str], overwrite: bool):
        self.path, self.suffix, self.overwrite = path, suffix, overwrite
        self.doc, self.xml = columns.index("doc"), columns.index("xml")
        self.aside = f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        system, base = opened(self.path)
        names = []
        for row in iterator:
            folder = f"{base}/{self.aside}/{uuid.uuid4().hex}"
            system.create_dir(folder)
            name = f"{row[self.doc]}{self.suffix}"
            with system.open_output_stream(f"{folder}/{name}") as out:
                out.write((row[self.xml] or "").encode())
            names.append(f"{os.path.basename(folder)}/{name}")
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, base = opened(self.path)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
                if f.type == fs.FileType.File and f.path.endswith(self.suffix):
                    system.delete_file(f.path)
        for m in messages:
            for name in m.names if m else ():
                system.move(f"{base}/{self.aside}/{name}", f"{base}/{name.split('/', 1)[1]}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, base = opened(self.path)
        if system.get_file_info(f"{base}/{self.aside}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/{self.aside}")


def walked(docs: DataFrame, walk: Callable[[str, int, ET.Element], Iterator[tuple]], returns: str) -> DataFrame:
    """Rows that a user's function makes of every object of annotation documents (doc, xml): (doc, *returns).

    ``walk`` gets the path, depth and element of each object, parents first, and yields tuples of ``returns`` (a DDL text).
    """

    class Walker:
        def eval(self, xml: str):
            for path, depth, node in objects(xml):
                yield from walk(path, depth, node)

    walker = F.udtf(Walker, returnType=returns)
    return docs.lateralJoin(walker(F.col("xml").outer())).drop("xml")


def lookup_tables(spark: SparkSession, counts: DataFrame, generate: Callable[[list[tuple[int, int]]], list[tuple[int, float]]]) -> DataFrame:
    """Look-up tables (channel, bin, value) that a user's function makes of each channel's histogram (channel, bin, n).

    ``generate`` gets the (bin, n) of one channel in order and returns (bin, value); a channel has as many rows as bins.
    """

    class Generator:
        def __init__(self):
            self.channel, self.bins = None, []

        def eval(self, row):
            self.channel = row["channel"]
            self.bins.append((row["bin"], row["n"]))

        def terminate(self):
            for b, value in generate(sorted(self.bins)):
                yield self.channel, b, float(value)

    made = F.udtf(Generator, returnType="channel long, bin int, value double")
    table = counts.select(F.col("channel").cast("long").alias("channel"), F.col("bin").cast("int").alias("bin"), F.col("n").cast("long").alias("n"))
    return made(table.asTable().partitionBy("channel"))
