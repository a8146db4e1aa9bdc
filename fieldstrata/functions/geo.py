"""Column functions on coordinates: distances, projections, geohashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6378137.0
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def great_circle(x1: Column, y1: Column, x2: Column, y2: Column, radius: float = RADIUS) -> Column:
    """Distance on the sphere in the unit of ``radius`` (atan2 form)."""
    a, b, d = F.radians(y1), F.radians(y2), F.radians(x2 - x1)
    top = F.sqrt(F.pow(F.cos(b) * F.sin(d), F.lit(2)) + F.pow(F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d), F.lit(2)))
    return F.lit(radius) * F.atan2(top, F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(d))


def arc_degrees(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Angle between two points in degrees (acos form, its argument held to 1)."""
    a, b = F.radians(y1), F.radians(y2)
    cos = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(F.radians(x1 - x2))
    return F.degrees(F.acos(F.greatest(F.least(cos, F.lit(1.0)), F.lit(-1.0))))


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * RADIUS, F.log(F.tan(F.radians(lat) / 2 + F.lit(0.7853981633974483))) * RADIUS


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / RADIUS), F.degrees(F.atan(F.exp(y / RADIUS)) * 2 - F.lit(1.5707963267948966))


def cell_index(value: Column, low: float, span: float, bits: int) -> Column:
    """Number of the cell that repeated halving gives; a value on an edge falls in the lower cell."""
    return F.greatest(F.ceil((value - low) / span * (1 << bits)) - 1, F.lit(0)).cast("long")


def geohash(lon: Column, lat: Column, length: int) -> Column:
    """Geohash of ``length`` letters, bits of longitude first."""
    bits = 5 * length
    x, y = cell_index(lon, -180.0, 360.0, (bits + 1) // 2), cell_index(lat, -90.0, 180.0, bits // 2)
    letters = []
    for i in range(length):
        value = F.lit(0).cast("long")
        for bit in range(5 * i, 5 * i + 5):
            source, at = (x, (bits + 1) // 2 - 1 - bit // 2) if bit % 2 == 0 else (y, bits // 2 - 1 - bit // 2)
            value = value * 2 + F.shiftright(source, at).bitwiseAND(F.lit(1).cast("long"))
        letters.append(F.substr(F.lit(ALPHABET), (value + 1).cast("int"), F.lit(1)))
    return F.concat(*letters)


def geohash_bounds(code: Column) -> Column:
    """struct(x0, x1, y0, y1) of a geohash's cell, halving once for each bit."""
    start = F.struct(F.lit(-180.0).alias("x0"), F.lit(180.0).alias("x1"), F.lit(-90.0).alias("y0"), F.lit(90.0).alias("y1"), F.lit(True).alias("lon"))
    values = F.flatten(F.transform(F.split(F.lower(code), ""), lambda c: F.transform(F.sequence(F.lit(4), F.lit(0), F.lit(-1)), lambda s: F.floor((F.position(c, F.lit(ALPHABET)) - 1) / F.pow(F.lit(2.0), s)) % 2)))

    def halve(acc: Column, bit: Column) -> Column:
        mx, my, up = (acc["x0"] + acc["x1"]) / 2, (acc["y0"] + acc["y1"]) / 2, bit == 1
        lon = acc["lon"]
        return F.struct(
            F.when(lon & up, mx).otherwise(acc["x0"]).alias("x0"), F.when(lon & ~up, mx).otherwise(acc["x1"]).alias("x1"),
            F.when(~lon & up, my).otherwise(acc["y0"]).alias("y0"), F.when(~lon & ~up, my).otherwise(acc["y1"]).alias("y1"), (~lon).alias("lon"),
        )

    return F.aggregate(values, start, halve)


def number_text(x: Column) -> Column:
    """A coordinate as text in fixed notation, whole numbers without a decimal point."""
    t = x.cast("string")
    fixed = F.regexp_replace(x.cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    return F.when(t.contains("E") & (F.abs(x) < 1e19), fixed).otherwise(F.regexp_replace(t, r"\.0$", ""))
