"""Vectorised helpers where column expressions do not reach: WKB, hulls, simplification."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import stored

TYPES = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}


def parse_wkb(data: bytes) -> dict | None:
    """A geometry (type, srid, parts) from little-endian WKB or EWKB; further dimensions are stepped over and dropped.

    The parts of collections inside collections become the outer one's. Bytes that are no such geometry give None.
    """

    def one(at: int) -> tuple[str, int | None, list[dict], int]:
        order, code = struct.unpack_from("<BI", data, at)
        kind = code & 0xFF
        if order != 1 or kind not in TYPES:
            raise ValueError("no little-endian WKB")
        at, srid = at + 5, None
        dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
        if code & 0x20000000:
            (srid,) = struct.unpack_from("<I", data, at)
            at += 4

        def points(n: int, at: int) -> tuple[list, int]:
            got = np.frombuffer(data, "<f8", n * dims, at).reshape(n, dims)[:, :2].tolist()
            return [{"x": x, "y": y} for x, y in got], at + 8 * n * dims

        if kind == 1:
            pts, at = points(1, at)
            return TYPES[kind], srid, [{"type": "Point", "rings": [pts]}], at
        (n,) = struct.unpack_from("<I", data, at)
        at += 4
        parts: list[dict] = []
        if kind == 2:
            pts, at = points(n, at)
            if n == 1:
                raise ValueError("a line of one vertex")
            parts = [{"type": "LineString", "rings": [pts]}] if n else []
        elif kind == 3:
            rings = []
            for _ in range(n):
                (m,) = struct.unpack_from("<I", data, at)
                pts, at = points(m, at + 4)
                rings.append(pts)
            parts = [{"type": "Polygon", "rings": rings}] if n else []
        else:
            for _ in range(n):
                _, _, more, at = one(at)
                parts += more
        return TYPES[kind], srid, parts, at

    try:
        kind, srid, parts, _ = one(0)
    except (struct.error, ValueError):
        return None
    return {"type": kind, "srid": srid, "parts": parts}


def make_wkb(kind: str, srid: int | None, parts: list[dict], extended: bool = False) -> bytes:
    """Little-endian WKB; with ``extended`` and an SRID, EWKB."""
    code = {v: k for k, v in TYPES.items()}[kind]
    flag = 0x20000000 if extended and srid is not None else 0
    head = struct.pack("<BI", 1, code | flag) + (struct.pack("<I", srid) if flag else b"")
    flat = lambda r: np.array([(v["x"], v["y"]) for v in r], "<f8").tobytes()
    if code > 3:
        return head + struct.pack("<I", len(parts)) + b"".join(make_wkb(p["type"], None, [p]) for p in parts)
    if not len(parts):
        return head + struct.pack("<I", 0)
    rings = parts[0]["rings"]
    if code == 1:
        return head + flat(rings[0])
    if code == 2:
        return head + struct.pack("<I", len(rings[0])) + flat(rings[0])
    return head + struct.pack("<I", len(rings)) + b"".join(struct.pack("<I", len(r)) + flat(r) for r in rings)


def from_wkb_batch(data: pa.Array) -> list[dict | None]:
    """Geometries of a batch; where all have the size and head of a point, they are read in one go."""
    raw = data.to_pylist()
    if raw and all(d is not None and len(d) == 21 and d[:5] == b"\x01\x01\x00\x00\x00" for d in raw):
        xy = np.frombuffer(b"".join(raw), np.dtype([("head", "V5"), ("x", "<f8"), ("y", "<f8")]))
        return [{"type": "Point", "srid": None, "parts": [{"type": "Point", "rings": [[{"x": x, "y": y}]]}]} for x, y in zip(xy["x"].tolist(), xy["y"].tolist(), strict=True)]
    return [None if d is None else parse_wkb(d) for d in raw]


def to_wkb_batch(geoms: pa.Array, extended: bool) -> list[bytes | None]:
    return [None if v is None or v["type"] is None else make_wkb(v["type"], v["srid"], v["parts"], extended) for v in geoms.to_pylist()]


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise from the smallest point, by monotone chains."""
    p = sorted(set(map(tuple, points.tolist())))
    if len(p) < 3:
        return np.array(p).reshape(-1, 2)

    def chain(ps: list) -> list:
        out: list = []
        for q in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def convex_hulls(v: DataFrame, chunk: int = 4096) -> DataFrame:
    """(geom, seq, x, y) of the hull of each geometry's vertices.

    Large geometries are reduced in chunks first: the hull of the hulls of chunks is that of all, and few
    points of a chunk remain.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h = hull(pdf[["x", "y"]].to_numpy())
        return pd.DataFrame({"geom": pdf["geom"].iloc[0], "part": 0, "seq": np.arange(1, len(h) + 1), "x": h[:, 0], "y": h[:, 1]})

    schema = "geom long, part int, seq int, x double, y double"
    parts = v.select(F.col("geom").cast("long").alias("geom"), F.floor(F.col("seq") / chunk).cast("int").alias("part"), "seq", "x", "y")
    return parts.groupBy("geom", "part").applyInPandas(run, schema).groupBy("geom").applyInPandas(run, schema).drop("part")


def keep_simple(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Which vertices of a line Douglas-Peucker keeps."""
    keep, todo = np.zeros(len(points), bool), [(0, len(points) - 1)]
    keep[[0, -1]] = True
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d, q = points[b] - points[a], points[a + 1 : b] - points[a]
        length = np.hypot(*d)
        far = np.abs(d[0] * q[:, 1] - d[1] * q[:, 0]) / length if length else np.hypot(q[:, 0], q[:, 1])
        at = int(far.argmax())
        if far[at] > tolerance:
            keep[a + 1 + at] = True
            todo += [(a, a + 1 + at), (a + 1 + at, b)]
    return keep


def _kept(pdf: pd.DataFrame, tolerance: float) -> pd.DataFrame:
    pdf = pdf.sort_values("seq")
    return pdf[keep_simple(pdf[["x", "y"]].to_numpy(), tolerance)]


def simplify(v: DataFrame, tolerance: float, limit: int = 100_000) -> DataFrame:
    """Vertices of each line that remain within ``tolerance`` by Douglas-Peucker.

    Lines of up to ``limit`` vertices are done whole in a task. Longer ones are first cut at the farthest vertex of each
    piece, found by an aggregation over all tasks, until no piece is longer; that is what the method does
    anyway, so the result is the same.
    """
    p = v.select(F.col("geom").cast("long").alias("geom"), F.col("seq").cast("int").alias("seq"), "x", "y")
    ends = p.groupBy("geom").agg(F.min("seq").alias("a"), F.max("seq").alias("b"), F.count("*").alias("n"), F.min_by(F.struct("x", "y"), "seq").alias("pa"), F.max_by(F.struct("x", "y"), "seq").alias("pb"))
    long = ends.where(F.col("n") > limit)
    schema = "geom long, seq int, x double, y double"
    whole = p.join(long.select("geom"), "geom", "left_anti").groupBy("geom").applyInPandas(lambda pdf: _kept(pdf, tolerance), schema)
    if long.isEmpty():
        return whole
    open_, done = p.join(long, "geom"), []
    dx, dy = F.col("pb.x") - F.col("pa.x"), F.col("pb.y") - F.col("pa.y")
    qx, qy, size = F.col("x") - F.col("pa.x"), F.col("y") - F.col("pa.y"), F.sqrt(dx * dx + dy * dy)
    far = F.when(size > 0, F.abs(dx * qy - dy * qx) / size).otherwise(F.sqrt(qx * qx + qy * qy))
    while not open_.where(F.col("n") > limit).isEmpty():
        inner = open_.where((F.col("n") > limit) & (F.col("seq") > F.col("a")) & (F.col("seq") < F.col("b")))
        cut = inner.groupBy("geom", "a").agg(F.max_by(F.struct("seq", "x", "y"), F.struct(far.alias("d"), -F.col("seq"))).alias("m"), F.max(far).alias("d"))
        j = open_.join(cut.withColumnRenamed("geom", "g_").withColumnRenamed("a", "a_"), (F.col("geom") == F.col("g_")) & (F.col("a") == F.col("a_")), "left").drop("g_", "a_")
        done.append(j.where(F.col("d") <= tolerance).where((F.col("seq") == F.col("a")) | (F.col("seq") == F.col("b"))).select("geom", "seq", "x", "y"))
        j = j.where(F.col("d").isNull() | (F.col("d") > tolerance))
        middle = F.struct("m.x", "m.y")
        pieces = F.array(F.struct(F.col("a").alias("a"), F.col("m.seq").alias("b"), F.col("pa").alias("pa"), middle.alias("pb")), F.struct(F.col("m.seq").alias("a"), F.col("b").alias("b"), middle.alias("pa"), F.col("pb").alias("pb")))
        mine = F.filter(pieces, lambda s: F.col("seq").between(s["a"], s["b"]))
        same = F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b"), F.col("pa").alias("pa"), F.col("pb").alias("pb")))
        j = j.select("geom", "seq", "x", "y", F.explode(F.when(F.col("m").isNull(), same).otherwise(mine)).alias("s")).select("geom", "seq", "x", "y", "s.*")
        counts = j.groupBy(F.col("geom").alias("g_"), F.col("a").alias("a_")).agg(F.count("*").alias("n"))
        open_ = j.join(counts, (F.col("geom") == F.col("g_")) & (F.col("a") == F.col("a_"))).drop("g_", "a_")
        open_ = stored(v.sparkSession, open_, "pieces")
    rest = open_.select("geom", "a", "seq", "x", "y").groupBy("geom", "a").applyInPandas(lambda pdf: _kept(pdf, tolerance)[["geom", "seq", "x", "y"]], schema)
    for d in done:
        rest = rest.unionByName(d)
    return whole.unionByName(rest.distinct())
