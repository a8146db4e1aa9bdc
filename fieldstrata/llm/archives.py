"""Operator 5: legacy ARC archives to WARC, with revisit records for equal payloads."""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_join, scratch, stored

ARC_BYTES, WARC_BYTES = 4 << 20, 32 << 20
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "arc-to-warc")
FIELDS = {"1": "URL IP-address Archive-date Content-type Archive-length", "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def write_arc(name: str, records: list[tuple[str, str, str, str, bytes]], version: str = "1", date: str = "20240101000000") -> bytes:
    """An ARC archive: a version block, then (url, ip, date, content type, body) records with declared lengths."""
    note = f"{version} 0 fieldstrata\n{FIELDS[version]}\n".encode()
    lead = f"filedesc://{name} 0.0.0.0 {date} text/plain"
    out = [f"{lead} {len(note)}\n".encode() if version == "1" else f"{lead} 200 - - 0 {name} {len(note)}\n".encode(), note, b"\n"]
    at = sum(map(len, out))
    for url, ip, when, kind, body in records:
        lead = f"{url} {ip} {when} {kind}"
        line = f"{lead} {len(body)}\n" if version == "1" else f"{lead} 200 {base32_sha1(body)} - {at} {name} {len(body)}\n"
        out += [line.encode(), body, b"\n"]
        at += sum(map(len, out[-3:]))
    return b"".join(out)


def read_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC archive; header fields are those that the version block names.

    Bodies are taken by their declared lengths, whatever they hold. The version block comes first, as a record with
    ``version``. A header line with another number of fields, a length that is none or one beyond the archive ends
    it with a record that has an ``error``: where the next would begin cannot be told.
    """
    at, names = 0, None
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r")
        known = names or FIELDS["1"].lower().split(" ")
        fields = line.rsplit(" ", len(known) - 1)
        length = int(fields[-1]) if re.fullmatch("[0-9]+", fields[-1], re.ASCII) else -1
        fault = "header line not ended" if end < 0 else "header line without a length" if length < 0 else "length beyond the archive" if end + 1 + length > len(data) else ""
        if not fault and names and len(fields) != len(names):
            fault = f"header line of {len(fields)} instead of {len(names)} fields"
        if fault:
            yield {"offset": at, "url": line[:200], "error": fault}
            return
        body = data[end + 1 : end + 1 + length]
        if names is None:
            block = body.decode("utf-8", "replace").split("\n")
            version = block[0].split(" ")[0]
            names = [n.lower() for n in (block[1].strip() if len(block) > 1 and block[1].strip() else FIELDS.get(version, FIELDS["1"])).split(" ")]
            lead = line.split(" ")
            yield {"url": lead[0], "ip-address": lead[1] if len(lead) > 1 else "-", "archive-date": lead[2] if len(lead) > 2 else "", "content-type": "application/warc-fields", "offset": at, "body": body, "version": version}
        else:
            yield dict(zip(names, fields, strict=True)) | {"offset": at, "body": body}
        at = end + 1 + length


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """(head with its blank line, payload) of an HTTP response; a body without a status line is all payload."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    head, sep, payload = body.partition(b"\r\n\r\n")
    return head + sep, payload


def _field(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _to_arc(version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def archive() -> pa.RecordBatch:
            name = f"pages-{TaskContext.get().partitionId():05d}-{held[0][5]}.arc"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([write_arc(name, [h[:5] for h in held], version)], pa.binary())], names=["name", "arc"])

        for batch in batches:
            for page_id, url, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                payload = (html or "").encode()
                told = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n{told}Content-Length: {len(payload)}\r\n\r\n".encode()
                held.append((_field(url or "") or "-", "0.0.0.0", "20240101000000", "text/html", head + payload, page_id))
                size += len(head) + len(payload)
                if size >= ARC_BYTES:
                    yield archive()
                    held, size = [], 0
        if held:
            yield archive()

    return run


def pages_to_arc(pages: DataFrame, version: str = "1") -> DataFrame:
    """ARC archives (name, arc) of about 4 MB from (page_id, url, html), made partition by partition."""
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(_to_arc(version), "name string, arc binary")


SCHEMA = "page_id long, record_id string, kind string, uri string, date string, ip string, content_type string, http_head binary, payload binary, payload_bytes long, payload_digest string, block_digest string, error string"


def _record(name: str, r: dict) -> tuple:
    """A row of SCHEMA; one with an error if the record cannot be converted."""
    if "error" in r:
        return (None, None, None, r["url"], None, None, None, None, None, None, None, None, f"{name} at {r['offset']}: {r['error']}")
    stamp = r.get("archive-date", "")[:14]
    try:
        when = datetime.datetime.strptime(stamp.ljust(14, "0"), "%Y%m%d%H%M%S")
    except ValueError:
        return (None, None, None, r["url"], None, None, None, None, None, None, None, None, f"{name} at {r['offset']}: date {stamp!r}")
    head, payload = split_http(r["body"])
    kind = "warcinfo" if "version" in r else "response" if head else "resource"
    if kind != "response":
        head, payload = b"", r["body"]
    page = re.search(rb"(?mi)^x-page-id: (\d+|-\d+)\r?$", head)
    record_id = f"<urn:uuid:{uuid.uuid5(_SPACE, f'{name} {r["offset"]} {r["url"]} {stamp}')}>"
    media = "application/http;msgtype=response" if kind == "response" else r.get("content-type") or "application/octet-stream"
    ip = r.get("ip-address", "-")
    return (int(page[1]) if page else None, record_id, kind, r["url"], f"{when:%Y-%m-%dT%H:%M:%SZ}", ip, media, head, payload, len(payload), base32_sha1(payload), base32_sha1(r["body"]), None)


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [f.split() for f in SCHEMA.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[k] for _, k in fields]
    for batch in batches:
        for name, arc in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = [_record(name, r) for r in read_arc(arc.as_py() or b"")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in fields])


def arc_to_records(archives: DataFrame) -> DataFrame:
    """Records of ARC archives (name, arc) with the identifiers, timestamps, types and digests that WARC asks for.

    Version blocks are warcinfo, HTTP answers response, all else (DNS answers, bare bodies) resource with its own
    content type. Payloads are bytes. Record ids are name-based UUIDs of archive, place, URL and date, so a second
    conversion gives the same. What cannot be converted is a row with ``error`` and nothing to write.
    """
    return archives.select("name", "arc").mapInArrow(_convert, SCHEMA)


def rejects(archives: DataFrame) -> DataFrame:
    """(uri, error) of the records that cannot be converted."""
    return arc_to_records(archives).where("error is not null").select("uri", "error")


def warc_bytes(revisit: Column) -> Column:
    """A WARC record without its closing blank lines, as bytes. Revisits hold the HTTP head only."""
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))
    length = F.octet_length("http_head") + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    named = F.col("kind") != "warcinfo"
    fields = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise(F.col("kind"))),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.col("date")),
        F.when(named, line("WARC-Target-URI", F.col("uri"))).otherwise(line("WARC-Filename", F.regexp_replace("uri", "^filedesc://", ""))),
        F.when(named & (F.col("ip") != "-"), line("WARC-IP-Address", F.col("ip"))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(~revisit, line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.col("block_digest")))).otherwise(""),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", F.col("response_record_id")), line("X-Payload-Length", F.col("payload_bytes").cast("string")), F.coalesce(line("X-Refers-To-Page", F.col("refers_to").cast("string")), F.lit("")))).otherwise(""),
        line("Content-Type", F.col("content_type")),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
    )
    return F.concat(F.encode(fields, "UTF-8"), F.col("http_head"), F.when(revisit, F.lit(b"")).otherwise(F.col("payload")))


def write_warc(spark: SparkSession, archives: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Converts ARC archives and writes WARC files of about 32 MB under ``path``.

    Of HTTP answers with equal payloads of at least ``least_bytes`` bytes the one with the largest page_id (of equal
    ones that with the largest record id) is the response and the others refer to it. First the digests that occur again are counted; they are joined to the
    records so that no frequent payload meets in one task. Spark's text writer takes the bytes as they are,
    ends each record with the two blank lines that close it, and commits files task by task. Records with an error are
    not written (``rejects``).
    """
    records = arc_to_records(archives).where("error is null")
    twice = records.where((F.col("kind") == "response") & (F.col("payload_bytes") >= least_bytes)).groupBy("payload_digest").agg(F.max(F.struct("page_id", "record_id")).alias("x"), F.count("*").alias("n"), F.sum("payload_bytes").alias("bytes"))
    sums = stored(spark, twice.select("payload_digest", F.col("x.page_id").alias("refers_to"), F.col("x.record_id").alias("response_record_id"), "n", "bytes"), "payloads")
    total = sums.agg(F.sum("n"), F.sum("bytes")).first()
    per_file = max(1, int(WARC_BYTES // max((total[1] or 0) / max(total[0] or 1, 1) + 600, 1)))
    again = stored(spark, sums.where("n > 1").drop("bytes"), "again")
    joined = hot_join(spark, records, again, "payload_digest", "n", "record_id")
    revisit = (F.col("kind") == "response") & F.coalesce(F.col("record_id") != F.col("response_record_id"), F.lit(False))
    joined.select(warc_bytes(revisit).cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", per_file).text(path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record, taken by its declared length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(fields["content-length"])
        yield fields, data[end + 4 : end + 4 + length]
        at = end + 4 + length + 4


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0):
            rows = []
            for fields, block in parse_warc(data.as_py()):
                head, payload = split_http(block) if fields["content-type"].startswith("application/http") else (b"", block)
                page = re.search(rb"(?mi)^x-page-id: (-?\d+)\r?$", head)
                kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                if kind != "revisit":
                    size = len(payload)
                    if base32_sha1(payload) != digest:
                        raise ValueError("payload and digest differ")
                else:
                    size = int(fields["x-payload-length"])
                refers = fields.get("x-refers-to-page")
                rows.append((int(page[1]) if page else None, size, digest, kind, int(refers) if refers else None, fields["warc-record-id"], fields.get("warc-target-uri")))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "uri"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files under a path; payloads are checked against their digests."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(_read_back, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, uri string")


def convert_pages(pages: DataFrame, version: str = "1", path: str | None = None) -> DataFrame:
    """Pages as ARC archives, converted to WARC files and read back, a row a page.

    Null html is an empty payload, a null url is written as "-". Rows without a page_id have a record without one
    and come after all others as responses. Repeated rows of a page_id are records of their own; of those with equal
    html one is the response. Extra columns are ignored.
    """
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write_warc(spark, pages_to_arc(pages, version), path)
    return read_warc(spark, path).where("record_type != 'warcinfo'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS hex FROM p),
b AS (
  SELECT page_id, payload_bytes, hex,
    list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((('0x' || substr(hex, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
    max(page_id) OVER (PARTITION BY hex) AS last
  FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM b
"""
