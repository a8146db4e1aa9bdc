"""Operator 1: token ids in patched frame-of-reference blocks."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, partitions, scratch

MAGIC = b"PFOR\x01\x00\x00\x00"
BLOCK, PERCENTILE, SEGMENT_IDS = 256, 90, 1 << 18


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits needed for each value."""
    return np.where(x == 0, 0, np.frexp(x.astype(np.float64))[1]).astype(np.uint8)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, BLOCK) values of ``width`` bits to (blocks, BLOCK * width / 64) words of 64 bits, little end first."""
    n = len(values)
    out = np.zeros((BLOCK // 64, width, n), np.uint64)
    v = np.ascontiguousarray(values.reshape(n, BLOCK // 64, 64).transpose(1, 2, 0)).astype(np.uint64)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        out[:, word] |= v[:, j] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= v[:, j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.transpose(2, 0, 1)).reshape(n, -1)


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    n = len(packed)
    words = np.ascontiguousarray(packed.reshape(n, BLOCK // 64, width).transpose(1, 2, 0))
    out = np.empty((BLOCK // 64, 64, n), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, j] = value & mask
    return np.ascontiguousarray(out.transpose(2, 0, 1)).reshape(n, BLOCK)


def encode_segment(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, start: int, percentile: int = PERCENTILE) -> bytes:
    """One segment of the file format, all numbers little-endian.

    Header: magic (8 bytes), then int64: documents, ids, blocks, ``start`` (ids before the segment in its
    file), exceptions. Then the documents' ids (int64) and lengths (uint32); for each block its minimum
    (uint32), width in bits (uint8), start of its packed words in 8-byte words (uint32, the block index) and
    end of its exceptions in the list (uint32); the exceptions' places in the block (uint16) and values
    over the minimum (uint32); the packed words. A block holds 256 ids (the last is filled up with its
    minimum); its width is that of the 90th percentile of the ids less the block's minimum.
    """
    blocks = -(-len(ids) // BLOCK)
    grid = np.full(blocks * BLOCK, ids[-1] if len(ids) else 0, np.int64)
    grid[: len(ids)] = ids
    grid = grid.reshape(blocks, BLOCK)
    low = grid.min(axis=1) if blocks else np.zeros(0, np.int64)
    over = (grid - low[:, None]).astype(np.uint64)
    rank = BLOCK * percentile // 100
    width = np.maximum(_bits(np.partition(over, rank, axis=1)[:, rank]), 1) if blocks else np.zeros(0, np.uint8)
    out = over >> width.astype(np.uint64)[:, None] > 0
    block, place = np.nonzero(out)
    values = over[out].astype("<u4")
    over[out] = 0
    size = width.astype(np.int64) * (BLOCK // 64)
    at = np.concatenate([[0], np.cumsum(size)])
    packed = np.zeros(int(at[-1]), "<u8")
    for w in np.unique(width):
        which = np.flatnonzero(width == w)
        to = at[which][:, None] + np.arange(int(w) * (BLOCK // 64))
        packed[to] = _pack(over[which], int(w))
    head = np.array([len(doc_ids), len(ids), blocks, start, len(values)], "<i8")
    ends = np.cumsum(np.bincount(block, minlength=blocks)) if blocks else np.zeros(0)
    parts = [head, doc_ids.astype("<i8"), lengths.astype("<u4"), low.astype("<u4"), width, at[:-1].astype("<u4"), ends.astype("<u4"), place.astype("<u2"), values, packed]
    return MAGIC + b"".join(p.tobytes() for p in parts)


def decode_segment(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(documents' ids, lengths, token ids, start) of a segment."""
    if data[:8] != MAGIC:
        raise ValueError("not a token segment")
    at = 8

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(data, kind, n, at)
        at += got.nbytes
        return got

    n_docs, n_ids, blocks, start, n_out = map(int, take("<i8", 5))
    doc_ids, lengths, low, width = take("<i8", n_docs), take("<u4", n_docs), take("<u4", blocks), take("u1", blocks)
    index, ends, place, values = take("<u4", blocks), take("<u4", blocks), take("<u2", n_out), take("<u4", n_out)
    packed = np.frombuffer(data[at:], "<u8")
    grid = np.zeros((blocks, BLOCK), np.uint64)
    for w in np.unique(width):
        which = np.flatnonzero(width == w)
        grid[which] = _unpack(packed[index[which].astype(np.int64)[:, None] + np.arange(int(w) * (BLOCK // 64))], int(w))
    grid[np.repeat(np.arange(blocks), np.diff(np.concatenate([[0], ends.astype(np.int64)]))), place] = values
    ids = (grid + low.astype(np.uint64)[:, None]).reshape(-1)[:n_ids].astype("<u4")
    return doc_ids, lengths, ids, start


_CLOSING = ".,;:!?)\"'"


def _make(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Token ids of whole texts by the tokenizers library.

    The pre-tokenizer cuts at every space between words, so the ids of a text are those of its
    space-separated units; units and pre-tokens met before are remembered (bounded, two generations).
    Texts with two blanks in a row or one at an end, with an added token or with unusual characters, go to
    the library in one piece.
    """

    def __init__(self, path: str, cap: int = 600_000):
        import regex

        self.made, self.cap = _make(path), cap
        self.units, self.old_units, self.pieces, self.old_pieces = {}, {}, {}, {}
        plain = [chr(c) for c in (10, *range(0x20, 0x7F), *range(0xA1, 0x250))]
        self.unusual = re.compile(r"[^\x20-\x7e\n\xa1-\u024f]").search
        self.apart = ["  ", " \n", "\n ", "\n\n", *(t.content for t in self.made.get_added_tokens_decoder().values())]
        # where the library cuts a text of these characters, and how it writes them
        self.cut = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+").findall
        self.spelt = {ord(c): "".join(p for p, _ in self.made.pre_tokenizer.pre_tokenize_str(c)) for c in plain}

    def odd(self, text: str) -> bool:
        """Whether the units of a text might not give its ids."""
        return text[0] in " \n" or text[-1] in " \n" or any(x in text for x in self.apart) or self.unusual(text) is not None

    def ids(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.made.model.tokenize(piece.translate(self.spelt))]).tobytes()

    def piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            got = self.old_pieces.get(piece)
            if got is None:
                got = self.ids(piece)
            if len(self.pieces) >= self.cap:
                self.pieces, self.old_pieces = {}, self.pieces
            self.pieces[piece] = got
        return got

    def unit(self, word: str) -> bytes:
        """Ids of a space and a word."""
        got = self.old_units.get(word)
        if got is None:
            if word.isalpha():  # one piece, remembered as a unit only
                got = self.ids(" " + word)
            elif (core := word.rstrip(_CLOSING)).isalpha():  # the marks after a word are a piece of their own
                got = (self.units.get(core) or self.unit(core)) + self.piece(word[len(core) :])
            else:
                got = b"".join([self.piece(p) for p in self.cut(" " + word)])
        if len(self.units) >= self.cap:
            self.units, self.old_units = {}, self.units
        self.units[word] = got
        return got

    def __call__(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers; none for null and empty texts."""
        if not text:
            return b""
        if self.odd(text):
            return np.array(self.made.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = text.split(" ")
        get, unit = self.units.get, self.unit
        return b"".join([self.piece(p) for p in self.cut(first)] + [get(u) or unit(u) for u in rest])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file; a Python worker keeps it, with what it remembers, from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _write(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, start = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        doc_ids, held, size, number = [], [], 0, 0

        def segment() -> pa.RecordBatch:
            lengths = np.array([len(h) // 4 for h in held], np.int64)
            ids = np.frombuffer(b"".join(held), "<u4")
            made = encode_segment(np.array(doc_ids, np.int64), lengths, ids, start)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([made], pa.binary())], names=["part", "segment", "n_ids", "payload"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text) + end
                doc_ids.append(doc_id)
                held.append(ids)
                size += len(ids) // 4
                if size >= SEGMENT_IDS:
                    yield segment()
                    start, number = start + size, number + 1
                    doc_ids, held, size = [], [], 0
        if doc_ids:
            yield segment()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Writes the token ids of all texts, in ascending doc_id order, as a table of segments.

    Texts are dealt out by ranges of doc_id and sorted inside each; every task encodes its range and
    makes one file after the other, in segments of about 262,144 ids, so memory is bounded by one segment
    and one text. Null and empty texts have the end id only. Rows with one doc_id stay together, in the
    order of their texts; rows without a doc_id are left out. Extra columns are ignored.
    """
    src = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = max(partitions(docs.sparkSession), 1)
    rows = src.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(_write(tokenizer, end_id), "part int, segment int, n_ids long, payload binary").write.mode("overwrite").parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            doc_ids, lengths, ids, start = decode_segment(payload.as_py())
            ends = np.cumsum(lengths.astype(np.int64))
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[(e - n) * 4 : e * 4]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(doc_ids), part, np.int32)), pa.array(doc_ids), pa.array(start + ends - lengths), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())],
                names=["part", "doc_id", "at", "n_tokens", "ids_crc32"],
            )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Reads a token table back: (doc_id, start, n_tokens, ids_crc32) decoded from every segment.

    Segments know where they start in their part; what the parts before hold is a sum over one number for
    each part (one a write task), which is all that comes to the driver.
    """
    files = spark.read.schema("part int, segment int, n_ids long, payload binary").parquet(path)
    totals = dict(files.groupBy("part").agg(F.sum("n_ids")).collect())
    before, rows = 0, []
    for part in sorted(totals):
        rows.append((part, before))
        before += totals[part]
    offsets = spark.createDataFrame(rows, "part int, before long")
    decoded = files.select("part", "payload").mapInArrow(_read, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return decoded.join(F.broadcast(offsets), "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, tokenizer: str | None = None, path: str | None = None) -> DataFrame:
    """Writes and reads back; ``tokenizer`` is the path of a tokenizer file on every executor."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    path = path or scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer)
    return read_index(docs.sparkSession, path)


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents kept: (doc_id, start, n_tokens, ids_crc32)."""
    return token_table(docs)
