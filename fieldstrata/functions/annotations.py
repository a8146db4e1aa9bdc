"""Annotation trees: XML to rows and back, CSV lines, visibility, moving and scaling."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geo import number_text

VERTEX = "struct<x:double,y:double,z:double,t:double,c:double,index:int>"
SCHEMA = f"doc long, path string, depth int, type string, name string, tags map<string,string>, vertices array<{VERTEX}>"
AXES = ("x", "y", "z", "t", "c")


def _number(text: str | None) -> float | None:
    try:
        return None if text is None else float(text)
    except ValueError:
        return None


def _index(text: str | None) -> int | None:
    try:
        found = int(text) if text and text.lstrip("-").isdigit() else None
    except ValueError:
        return None
    return found if found is not None and -(2**31) <= found < 2**31 else None


def _object_batch(rows: list[tuple]):
    """An Arrow batch of ``SCHEMA``; of each row vertices are tuples of ``AXES`` and index."""
    import pyarrow as pa

    doc, path, depth, kind, name, tags, found = zip(*rows, strict=True)
    ends = lambda lists: pa.array([0, *itertools.accumulate(map(len, lists))], pa.int32())
    columns = list(zip(*itertools.chain.from_iterable(found), strict=True)) or [[]] * 6
    vertices = pa.StructArray.from_arrays([pa.array(c, pa.int32() if n == "index" else pa.float64(), from_pandas=True) for c, n in zip(columns, (*AXES, "index"), strict=True)], names=[*AXES, "index"])
    keys, values = (pa.array(list(itertools.chain.from_iterable(v)), pa.string()) for v in (tags, (t.values() for t in tags)))
    plain = [pa.array(v, t) for v, t in ((doc, pa.int64()), (path, pa.string()), (depth, pa.int32()), (kind, pa.string()), (name, pa.string()))]
    nested = [pa.MapArray.from_arrays(ends(tags), keys, values), pa.ListArray.from_arrays(ends(found), vertices)]
    return pa.RecordBatch.from_arrays([*plain, *nested], names=["doc", "path", "depth", "type", "name", "tags", "vertices"])


def flatten_annotations(docs: DataFrame) -> DataFrame:
    """Every object of annotation XML (doc, xml), of any nesting: (doc, path, depth, type, name, tags, vertices).

    The object may lie inside another document; its path tells the place among its parent's objects. Vertices come in
    the order of their index, those without one in the order of the document after them. Malformed documents give no
    rows (``malformed`` tells them).
    """

    def run(batches):
        import xml.etree.ElementTree as ET

        for b in batches:
            rows = []
            for doc, xml in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    todo = [(ET.fromstring(xml), "", 0)]
                except (ET.ParseError, TypeError):
                    continue
                while todo:
                    node, path, depth = todo.pop()
                    for i, c in enumerate(x for x in node if x.tag not in ("vertex", "tag")):
                        at, tags, found, inner = f"{path}/{i}", {}, [], False
                        for v in c:
                            if v.tag == "vertex":
                                found.append((*[_number(v.get(k)) for k in AXES], _index(v.get("index"))))
                            elif v.tag == "tag":
                                tags[v.get("name") or ""] = v.get("value") or ""
                            else:
                                inner = True
                        if inner:
                            todo.append((c, at, depth + 1))
                        found.sort(key=lambda v: (v[5] is None, v[5] or 0))
                        rows.append((doc, at, depth, c.get("type") or c.tag, c.get("name"), tags, found))
                if len(rows) >= 10_000:
                    yield _object_batch(rows)
                    rows = []
            if rows:
                yield _object_batch(rows)

    return docs.select(F.col("doc").cast("long").alias("doc"), "xml").mapInArrow(run, SCHEMA)


def malformed(docs: DataFrame) -> DataFrame:
    """Documents (doc, xml) that are no well-formed XML."""
    bad = F.from_xml("xml", "_corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})["_corrupt_record"]
    return docs.where(F.col("xml").isNull() | bad.isNotNull())


def _escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def object_xml(inner: Column) -> Column:
    """XML of the object of a row, around the XML of its children."""
    attribute = lambda k, v: F.when(v.isNotNull(), F.concat(F.lit(f' {k}="'), v, F.lit('"'))).otherwise("")
    vertex = lambda v: F.concat(F.lit("<vertex"), *[attribute(k, number_text(v[k])) for k in AXES], attribute("index", v["index"].cast("string")), F.lit("/>"))
    tags = F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(F.lit('<tag name="'), _escaped(e["key"]), F.lit('" value="'), _escaped(e["value"]), F.lit('"/>')))
    head = F.concat(F.lit('<gobject type="'), _escaped(F.col("type")), F.lit('"'), attribute("name", _escaped(F.col("name"))), F.lit(">"))
    return F.concat(head, F.array_join(F.transform("vertices", vertex), ""), F.array_join(tags, ""), inner, F.lit("</gobject>"))


def to_xml(rows: DataFrame, wrapper: str = "image") -> DataFrame:
    """(doc, xml) of object rows, children inside their parents: one grouping for each level of the deepest tree.

    No rows give no documents.
    """
    deepest = rows.agg(F.max("depth")).first()[0]
    made, below = None, None
    if deepest is None:
        return rows.select("doc", F.lit(None).cast("string").alias("xml")).limit(0)
    for depth in range(deepest, -1, -1):
        level = rows.where(F.col("depth") == depth)
        if below is not None:
            level = level.join(below, ["doc", "path"], "left")
            level = level.withColumn("xml", object_xml(F.coalesce("inner", F.lit("")))).drop("inner")
        else:
            level = level.withColumn("xml", object_xml(F.lit("")))
        place = F.substring_index("path", "/", -1).cast("int")
        parent = F.regexp_replace("path", r"/\d+$", "")
        inner = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("i"), "xml"))), lambda s: s["xml"]), "")
        below = level.groupBy("doc", parent.alias("path")).agg(inner.alias("inner"))
        made = below
    return made.select("doc", F.concat(F.lit(f"<{wrapper}>"), "inner", F.lit(f"</{wrapper}>")).alias("xml"))


def csv_lines(rows: DataFrame) -> DataFrame:
    """(doc, path, n, line): ``type,name, x,y,z,t,c,index`` for the first vertex of an object, the vertex alone for further ones."""
    value = lambda v, k: F.coalesce(number_text(v[k]), F.lit(""))
    vertex = lambda v: F.concat(F.lit(" "), *[F.concat(value(v, k), F.lit(",")) for k in AXES], F.coalesce(v["index"].cast("string"), F.lit("")))
    head = F.concat(F.coalesce("type", F.lit("")), F.lit(","), F.coalesce("name", F.lit("")), F.lit(","))
    lines = F.when(F.size("vertices") > 0, F.transform("vertices", lambda v, i: F.concat(F.when(i == 0, head).otherwise(""), vertex(v)))).otherwise(F.array(head))
    return rows.select("doc", "path", F.posexplode(lines).alias("n", "line"))


def totals(rows: DataFrame) -> DataFrame:
    """(doc, objects, types, tags): number of objects, their distinct types and tag names."""
    named = rows.select("doc", "path", "type", F.explode_outer(F.map_keys("tags")).alias("tag"))
    return named.groupBy("doc").agg(F.count_distinct("path").alias("objects"), F.array_sort(F.collect_set("type")).alias("types"), F.array_sort(F.collect_set("tag")).alias("tags"))


def visible(kind: Column, tags: Column, include: list[str] = (), exclude: list[str] = (), least: float = 0.0, tag: str = "probability") -> Column:
    """Whether an object is shown: its type wanted and not unwanted, its probability (100 if it has none) not below ``least``."""
    ok = ~kind.isin(*exclude) if exclude else F.lit(True)
    ok = ok & kind.isin(*include) if include else ok
    return ok & (F.coalesce(F.try_element_at(tags, F.lit(tag)).try_cast("double"), F.lit(100.0)) >= least)


def moved(vertices: Column, by: dict[str, float], scale: dict[str, float] | None = None) -> Column:
    """Vertices scaled, then shifted along the axes named; axes that a vertex lacks stay missing."""
    new = lambda v: F.struct(*[(v[k] * F.lit((scale or {}).get(k, 1.0)) + F.lit(by.get(k, 0.0))).alias(k) for k in AXES], v["index"].alias("index"))
    return F.transform(vertices, new)
