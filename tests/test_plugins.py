"""Folders of documents as data sources, and functions of the user."""

import os

import pytest
from pyspark.sql import functions as F

from fieldstrata.functions import images
from fieldstrata.sources import plugins as p

XML = '<image><gobject type="rect" name="r{0}"><vertex x="1" y="2" index="0"/><tag name="k" value="v{0}"/><gobject type="point" name="p"/></gobject><circle name="c"/></image>'
GPX = '<gpx xmlns="http://www.topografix.com/GPX/1/1"><trk><trkseg><trkpt lat="1" lon="2"><ele>3</ele><time>t</time></trkpt><trkpt lat="x" lon="4"/></trkseg><trkseg><trkpt lat="5" lon="6"/></trkseg></trk></gpx>'


@pytest.fixture(scope="module")
def sources(spark):
    for s in (p.AnnotationFolder, p.TrackFolder):
        spark.dataSource.register(s)
    return spark


def put(folder, files):
    for name, text in files.items():
        os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
        with open(f"{folder}/{name}", "w") as f:
            f.write(text)


def test_annotations_are_read(sources, tmp_path):
    put(tmp_path, {f"a/{i}.xml": XML.format(i) for i in range(5)} | {"bad.xml": "<image>", "note.txt": "x", "_aside/9.xml": XML})
    df = sources.read.format("annotations").option("files", 2).load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 3 and df.count() == 15
    got = df.where("doc = '3'").orderBy("path").collect()
    assert [(r.path, r.depth, r.type, r.name, r.tags) for r in got] == [("/0", 0, "rect", "r3", {"k": "v3"}), ("/0/0", 1, "point", "p", {}), ("/1", 0, "circle", "c", {})]
    assert sources.read.format("annotations").load(f"{tmp_path}/none").count() == 0


def test_tracks_are_read(sources, tmp_path):
    put(tmp_path, {"t1.gpx": GPX, "t2.GPX": GPX, "bad.gpx": "<gpx>"})
    got = sources.read.format("tracks").load(str(tmp_path)).where("track = 't1'").orderBy("trk", "seg", "seq").collect()
    assert [tuple(r) for r in got] == [("t1", 0, 0, 0, 2.0, 1.0, 3.0, "t"), ("t1", 0, 0, 1, 4.0, None, None, None), ("t1", 0, 1, 0, 6.0, 5.0, None, None)]


def test_annotations_are_written_and_replaced(sources, tmp_path):
    folder = str(tmp_path / "out")
    docs = sources.createDataFrame([(str(i), XML.format(i)) for i in range(6)], "doc string, xml string").repartition(3)
    docs.write.format("annotations").mode("append").save(folder)
    assert sorted(os.listdir(folder)) == [f"{i}.xml" for i in range(6)]
    sources.createDataFrame([("2", XML.format("new")), ("7", None)], "doc string, xml string").write.format("annotations").mode("append").save(folder)
    back = sources.read.format("annotations").load(folder)
    assert back.where("doc = '2' and name = 'rnew'").count() == 1 and back.select("doc").distinct().count() == 6 and len(os.listdir(folder)) == 7
    with pytest.raises(Exception, match="division|DIVIDE"):
        docs.withColumn("doc", F.expr("string(1 / (int(doc) - 4))")).write.format("annotations").mode("append").save(folder)
    assert len(os.listdir(folder)) == 7  # nothing of a failed write stays
    docs.limit(1).write.format("annotations").mode("overwrite").save(folder)
    assert len(os.listdir(folder)) == 1


def test_streams_take_new_files_only(sources, tmp_path):
    def run():
        q = sources.readStream.format("tracks").load(f"{tmp_path}/in").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint").start(f"{tmp_path}/out")
        q.processAllAvailable()
        q.stop()
        return sorted(r.track for r in sources.read.schema(p.TrackFolder({}).schema()).parquet(f"{tmp_path}/out").select("track").distinct().collect())

    put(tmp_path / "in", {"a.gpx": GPX})
    assert run() == ["a"]
    put(tmp_path / "in", {"b.gpx": GPX, "sub/c.gpx": GPX})
    assert run() == ["a", "b", "c"]
    assert run() == ["a", "b", "c"]
    assert sources.read.parquet(f"{tmp_path}/out").count() == 9


def test_a_format_of_the_user(sources, tmp_path):
    class Lines(p.Folder):
        """A row a line."""

        @classmethod
        def name(cls):
            return "lines-of-text"

        def schema(self):
            return "file string, line string"

        def rows(self, path, data):
            for line in data.decode().splitlines():
                yield path.rsplit("/", 1)[1], line

    put(tmp_path, {"x.txt": "one\ntwo"})
    sources.dataSource.register(Lines)
    assert [tuple(r) for r in sources.read.format("lines-of-text").load(str(tmp_path)).collect()] == [("x.txt", "one"), ("x.txt", "two")]


def test_a_walker_of_the_user(spark):
    docs = spark.createDataFrame([(1, XML.format(1)), (2, "<bad"), (3, None)], "doc int, xml string")
    got = p.walked(docs, lambda path, depth, node: [(path, len(node))] if depth == 0 else [], "path string, children int")
    assert sorted(map(tuple, got.collect())) == [(1, "/0", 3), (1, "/1", 0)]


def test_a_generator_of_look_up_tables(spark):
    px = spark.range(1000).select((F.col("id") % 3).alias("channel"), F.pow(F.col("id") % 97, F.lit(2)).alias("v"))
    counts = images.histogram(px, "channel", "v", 16)

    def stretch(bins):
        total, run = sum(n for _, n in bins), 0
        for b, n in bins:
            run += n
            yield b, run * 255 // total

    got = {(r.channel, r.bin): r.value for r in p.lookup_tables(spark, counts, lambda bins: list(stretch(bins))).collect()}
    for channel in range(3):
        bins = sorted((r.bin, r.n) for r in counts.where(F.col("channel") == channel).collect())
        assert {b: got[channel, b] for b, _ in bins} == {b: float(v) for b, v in stretch(bins)}


def test_a_layout_of_the_user(spark):
    df = spark.createDataFrame([(1, 600, 300, "strips"), (2, 600, 300, "map"), (3, 9, 9, "none"), (4, 9, 9, None)], "image int, width int, height int, kind string")
    images.register_layout("strips", lambda d, tile: d.select("image", F.explode(F.sequence(F.lit(0), F.floor((F.col("height") - 1) / tile))).alias("top")))
    try:
        got = images.planned(df, F.col("kind"), 256).collect()
        assert sorted(r.plan for r in got if r.image == 1) == ['{"top":0}', '{"top":1}'] and {r.image for r in got} == {1, 2}
        assert images.planned(df, "none").count() == 0 and images.planned(df, "strips").count() == 6
    finally:
        del images.LAYOUTS["strips"]
