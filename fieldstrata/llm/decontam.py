"""Operator 4: benchmark passages in documents, by shared seeds and greedy string tiling."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, stored, without

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
SEED_WORDS, COVERAGE, BLOCK_CHARS = 5, 0.5, 16_000_000
_BASE, _MOD = 1_000_003, (1 << 61) - 1


def tokens(text: str | None) -> list[str]:
    """Words of a text in lower case, without punctuation; none for null."""
    return WORD.findall(text.translate(_LOWER)) if text else []


def _windows(seq: list[int], s: int, marked: list[bool]) -> Iterator[tuple[int, int]]:
    """(start, Karp-Rabin hash) of each run of ``s`` unmarked tokens; 0 stands for no token."""
    top = pow(_BASE, s - 1, _MOD)
    value = length = 0
    for i, x in enumerate(seq):
        if marked[i] or not x:
            value = length = 0
            continue
        if length == s:
            value = (value - seq[i - s] * top) % _MOD
            length -= 1
        value = (value * _BASE + x) % _MOD
        length += 1
        if length == s:
            yield i - s + 1, value


def _starts(table: dict[int, list[int]], windows: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Places (item, document) where windows begin to match: those of which the windows one earlier match too are
    left out, as they lie inside a longer match. What a pair of windows in a row leaves is worked out once."""
    known: dict[tuple[int, int], list[int]] = {}
    before, last = None, 0
    for d, h in windows:
        found = table.get(h, ())
        if found and before == d - 1 and (old := table.get(last)):
            if (last, h) not in known:
                inside = {i + 1 for i in old}
                known[last, h] = [i for i in found if i not in inside]
            found = known[last, h]
        for i in found:
            yield i, d
        before, last = d, h


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning."""
    n, size = min(len(a), len(b)), 32
    at = 0
    while at < n:
        differ = a[at : min(at + size, n)] != b[at : min(at + size, n)]
        if differ.any():
            return at + int(differ.argmax())
        at, size = at + size, size * 4
    return n


def tile(item: list[int], doc: list[int], least: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (item place, document place, length) of the tiles, longest first.

    Matches are found by running Karp-Rabin for a search length that starts at the item's and is halved
    down to ``least``; where runs begin to match they are extended, and those longest in a round are marked first, if nothing of
    them is marked yet. A match longer than twice the search length starts the search anew at its length.
    """
    a, b = np.array(item, np.int64), np.array(doc, np.int64)
    a[a == 0], b[b == 0] = -1, -2  # no tokens; marked ones become such too
    tiles = []
    s = max(least, min(len(item), len(doc)))
    while True:
        table: dict[int, list[int]] = {}
        for at, h in _windows(a.tolist(), s, (a < 0).tolist()):
            table.setdefault(h, []).append(at)
        found, longest = [], 0
        for i, d in _starts(table, _windows(b.tolist(), s, (b < 0).tolist())) if table else ():
            n = _common(a[i:], b[d:])
            if n >= s:
                found.append((n, i, d))
                longest = max(longest, n)
        if longest > 2 * s:
            s = longest
            continue
        again = False
        for n, i, d in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            if (a[i : i + n] >= 0).all() and (b[d : d + n] >= 0).all():
                a[i : i + n], b[d : d + n] = -1, -2
                tiles.append((i, d, n))
            else:
                again = True  # what is left of it may still hold a match
        if again and any(True for _ in _windows(a.tolist(), s, (a < 0).tolist())):
            continue  # at the same length: the rest of a longer match may be as long
        if s == least:
            return tiles
        s = max(least, s // 2)


class Index:
    """Seeds of a block of benchmark items: word numbers, and the places of each run of ``k`` words.

    With ``only`` the index is for the items of just k words, which match whole.
    """

    def __init__(self, items: list[tuple[int, str | None]], k: int = SEED_WORDS, only: bool = False):
        self.k, self.words, self.items = k, {}, {}
        places: dict[int, list[tuple[int, int]]] = {}
        for item_id, text in items:
            found = tokens(text)
            if item_id is None or len(found) < k or only and len(found) > k:
                continue
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in found]
            self.items[item_id] = ids
            for at, h in enumerate(self.hashes(np.array(ids, np.uint64)).tolist()):
                places.setdefault(h, []).append((item_id, at))
        self.places = places
        self.seeds = np.array(sorted(places), np.uint64)

    def hashes(self, ids: np.ndarray) -> np.ndarray:
        n = max(len(ids) - self.k + 1, 0)
        value = np.zeros(n, np.uint64)
        for j in range(self.k):
            value = value * np.uint64(0x9E3779B97F4A7C15) + ids[j : n + j] * np.uint64(0xD6E8FEB86659FD93)
        return value

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the seeds in a row of word numbers; 0 is a word that no item has."""
        if not len(self.seeds) or len(ids) < self.k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        gaps = np.concatenate([[0], np.cumsum(ids == 0)])
        at = np.flatnonzero(gaps[self.k :] == gaps[: -self.k])
        value = np.zeros(len(at), np.uint64)
        for j in range(self.k):
            value = value * np.uint64(0x9E3779B97F4A7C15) + ids[at + j] * np.uint64(0xD6E8FEB86659FD93)
        near = np.minimum(np.searchsorted(self.seeds, value), len(self.seeds) - 1)
        on = self.seeds[near] == value
        return at[on], value[on]

    def matches(self, ids: np.ndarray, at: np.ndarray, value: np.ndarray, coverage: float) -> Iterator[tuple[int, int, int, int]]:
        """(item, its words, words covered by tiles, tiles) of items whose coverage is enough."""
        seen: dict[int, set[int]] = {}
        where: dict[int, list[int]] = {}
        order = np.argsort(value, kind="stable")
        kinds, first = np.unique(value[order], return_index=True)
        for h, places in zip(kinds.tolist(), np.split(at[order], first[1:]), strict=True):
            mine: dict[int, list[int]] = {}
            for item, i in self.places[h]:
                mine.setdefault(item, []).append(i)
            for item, starts in mine.items():
                seen.setdefault(item, set()).update(starts)
                where.setdefault(item, []).extend(places.tolist())
        for item, starts in seen.items():
            words = self.items[item]
            within = {x for i in starts for x in range(i, i + self.k)}
            if len(within) < coverage * len(words):  # tiles cannot cover more than the seeds do
                continue
            part, end = [], 0
            for d in sorted(set(where[item])):
                if d > end and part:
                    part.append(0)
                part += ids[max(d, end) : d + self.k].tolist()
                end = d + self.k
            tiles = tile(words, part, self.k)
            covered = sum(n for _, _, n in tiles)
            if covered >= coverage * len(words):
                yield item, len(words), covered, len(tiles)


def _scan(shared, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):  # by about 2 million characters
                end, size, split = at, 0, []
                while end < len(texts) and (end == at or size < 2_000_000):
                    split.append(tokens(texts[end]))
                    size += len(texts[end] or "")
                    end += 1
                starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in split])[:-1]])
                out = []
                for index in shared.value:
                    get = index.words.get
                    ids = np.array([n for x in split for n in (*map(get, x, repeat(0)), 0)], np.uint64)
                    places, values = index.hits(ids)
                    row = np.searchsorted(starts, places, side="right") - 1
                    for r in np.unique(row).tolist():
                        on = row == r
                        out += [(doc_ids[at + r], *m) for m in index.matches(ids, places[on], values[on], coverage)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "item_id", "item_words", "covered_words", "tiles"])
                at = end

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed_words: int = SEED_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Pairs of a document and a benchmark item of which it holds enough: (doc_id, item_id, item_words, covered_words, tiles, coverage).

    Words are compared in lower case without punctuation. Documents are scanned where they lie, for runs of
    ``seed_words`` words that an item has too; for items of which such runs cover ``coverage`` of the words,
    the text around the runs is tiled greedily, so that passages in another order count and no word
    counts twice. The benchmark's index goes to all tasks if its texts have at most ``block_chars``
    characters; a larger one is dealt into blocks of about that size, each scanned in a pass of its own.
    Items of fewer words than a seed
    match where they stand whole; null and empty texts match nothing. Rows without an id are left out;
    repeated rows of a pair give one row. Extra columns are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    blocks = -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars) or 1
    src = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        rows = [(r[0], r[1]) for r in part.collect()]
        index = [i for i in (Index(rows, seed_words), *(Index(rows, k, True) for k in range(1, seed_words))) if i.items]
        pairs = src.mapInArrow(_scan(spark.sparkContext.broadcast(index), coverage), "doc_id long, item_id long, item_words long, covered_words long, tiles long")
        found = pairs if found is None else found.union(pairs)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("covered_words", "item_words", "tiles")).alias("x"))
    return best.select("doc_id", "item_id", "x.item_words", "x.covered_words", "x.tiles", (F.col("x.covered_words") / F.col("x.item_words")).alias("coverage"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a contaminating passage; rows without a doc_id and those without a text stay; of
    repeated rows of a doc_id all go if one is contaminated."""
    bad = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return without(docs, stored(spark, bad, "contaminated"))
