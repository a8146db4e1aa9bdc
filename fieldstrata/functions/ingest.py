"""Column functions of photo and upload ingest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PHOTO_BYTES = 8_388_608
MAGNETIC_DECLINATION = 9.77


def rational(text: Column) -> Column:
    """EXIF "n/d" as a double; null where d is 0 or missing."""
    p = F.split(text, "/")
    return F.try_divide(p[0].cast("double"), p[1].cast("double"))


def dms(parts: Column, ref: Column) -> Column:
    """Degrees from three rationals; south and west are negative; null without a position."""
    value = rational(parts[0]) + rational(parts[1]) / 60 + rational(parts[2]) / 3600
    return F.when(ref.isin("S", "W"), -value).otherwise(value)


def altitude(text: Column, ref: Column, reference_compat: bool = False) -> Column:
    """Metres; below the sea where ref is 1. ``reference_compat`` turns the sign round, as older data has it."""
    below = (ref.isNull() | (ref == "") | (ref == "0")) if reference_compat else (ref == "1")
    return F.when(below, -rational(text)).otherwise(rational(text))


def heading(text: Column, ref: Column) -> Column:
    """True heading: magnetic ones are corrected by a fixed declination."""
    return F.when(F.coalesce(ref, F.lit("")) == "T", rational(text)).otherwise(rational(text) - MAGNETIC_DECLINATION)


def extension(file: Column) -> Column:
    return F.lower(F.substring_index(file, ".", -1))


def base_name(file: Column) -> Column:
    return F.split_part(file, F.lit("."), F.lit(1))


def name_uuid(namespace: str, name: Column, version: int = 5) -> Column:
    """Name UUID of version 3 (md5) or 5 (sha1)."""
    data = F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8"))
    h = F.md5(data) if version == 3 else F.sha1(data)
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F))).bitwiseOR(F.lit(0x80))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit(str(version)), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def is_uuid(text: Column) -> Column:
    return text.rlike(r"(?i)^\{?[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}\}?$")


def utc_text(local: Column, zone: str | Column) -> Column:
    return F.date_format(F.to_utc_timestamp(local, zone), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def clean_xml(text: Column) -> Column:
    """Lower case, without CDATA sections."""
    return F.regexp_replace(F.lower(text), r"(?s)<!\[cdata\[.*?\]\]>", "")


def video_faults(lat: Column, lon: Column, utc: Column, url: Column) -> Column:
    """Reasons why a video cannot be taken: an array, empty if it can."""
    missing = lambda c: c.isNull() | (F.trim(c.cast("string")) == "")
    return F.array_compact(F.array(F.when(missing(lat) | missing(lon), "no position"), F.when(missing(utc), "no time"), F.when(missing(url), "no url")))


def track_faults(title: Column) -> Column:
    return F.array_compact(F.array(F.when(title.isNull() | (F.trim(title) == ""), "no title")))


def capture_date(original: Column, other: Column) -> Column:
    """Date of capture as Y/m/d: the original one, else that of the file's own field."""
    return F.translate(F.split(F.coalesce(original, other), " ")[0], ":", "/")


def file_stamp(at: Column) -> tuple[Column, Column]:
    """(m-d-Y, H:i:s) of a file's time."""
    return F.date_format(at, "MM-dd-yyyy"), F.date_format(at, "HH:mm:ss")


def utc_by_offset(at: Column, raw_seconds: Column, dst_seconds: Column) -> Column:
    return at - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (raw_seconds + dst_seconds).cast("decimal(18,6)"))


def last_object(doc: Column, fields: str) -> Column:
    """The last object of a markup document's list, which holds its metadata."""
    return F.element_at(F.from_json(doc, f"objects array<struct<{fields}>>")["objects"], -1)


def in_extent(x: Column, y: Column, minx: float, miny: float, maxx: float, maxy: float) -> Column:
    return x.between(minx, maxx) & y.between(miny, maxy)
