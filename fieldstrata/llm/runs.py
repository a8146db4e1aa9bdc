"""Operator 11: periodic runs of words, from Lyndon roots that the first phase of Baier's suffix sorter gives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, WordHashes, documents, words

LEAST, EXPONENT, GRAM = 6, 4, 4


def lyndon_groups(letters: list[int]) -> tuple[list[int], list[int]]:
    """Of each place the length of the longest Lyndon word that starts there, and the number of its group.

    Baier's grouping: suffixes begin in groups by first letter, and groups are taken from the highest down. Each
    place of the group at hand lengthens the word of the nearest place to its left that is still in a lower group;
    places lengthened from one group by the same number of words move together to just above it. A group's
    word is final when it is taken, and places of one group have equal words. Nearest lower places are found
    over a forest of taken places; all in all nearly linear time.
    """
    n = len(letters)
    rank = {x: r for r, x in enumerate(sorted(set(letters)))}
    group = [rank[x] for x in letters]
    k = len(rank)
    size, members = [1] * k, [[] for _ in range(k)]
    for i, g in enumerate(group):
        members[g].append(i)
    below, above = list(range(-1, k - 1)), list(range(1, k + 1))
    to = list(range(n + 1))  # slot i + 1 is place i; slot 0 ends every search
    now = k - 1
    while now >= 0:
        taken = [i for i in members[now] if group[i] == now]
        for i in taken:
            to[i + 1] = i
        times: dict[int, int] = {}
        for i in taken:
            slot = i
            while (up := to[slot]) != slot:
                to[slot] = slot = to[up]
            if slot:
                times[slot] = times.get(slot, 0) + 1
        parts: dict[tuple[int, int], list[int]] = {}
        for slot, c in times.items():
            parts.setdefault((c, group[slot - 1]), []).append(slot - 1)
        for (c, old), places in sorted(parts.items(), reverse=True):
            new = len(size)
            size.append(size[old] + c * size[now])
            members.append(places)
            for j in places:
                group[j] = new
            higher = above[old]
            below[higher] = above[old] = new
            below.append(old)
            above.append(higher)
        members[now] = taken
        now = below[now]
    return [size[g] for g in group], group


def lce(letters: list[int], a: int, b: int, step: int) -> int:
    """How far the letters from places a < b on (step 1) or back from them (step -1) agree."""
    n, length = len(letters), 0
    while a >= 0 and b < n and letters[a] == letters[b]:
        a, b, length = a + step, b + step, length + 1
    return length


def runs_of(letters: list[int], least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``exponent`` (3 or more) periods and ``least`` letters, by start, then period.

    Under one of the two orders of the letters every place inside a run where its root stands as a Lyndon word has
    that root as its longest one. So a run shows as exponent - 1 or more roots of one group in a row, and reaches
    less than a period beyond them to either side.
    """
    found = set()
    for order in (letters, [-x for x in letters]):
        length, group = lyndon_groups(order)
        n = len(order)
        for i, p in enumerate(length):
            g = group[i]
            last = i + (exponent - 2) * p
            if last >= n or any(group[j] != g for j in range(i + p, last + 1, p)) or (i >= p and group[i - p] == g):
                continue
            while last + p < n and group[last + p] == g:
                last += p
            start = i - lce(order, i - 1, i + p - 1, -1)
            end = last + p + lce(order, last, last + p, 1)
            if end - start >= max(least, exponent * p):
                found.add((start, end - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def word_runs(text: list[str], hashes: WordHashes, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """Runs among the words of a text.

    All windows of ``GRAM`` words inside a run of four periods and six words occur again in the text (a shorter
    period fills them, a longer one repeats them), so only stretches of windows that occur twice are looked at, each
    ended by a letter of its own.
    """
    n = len(text)
    if n < least:
        return []
    h = np.fromiter(map(hashes.__getitem__, text), np.uint64, n)
    value = np.zeros(n - GRAM + 1, np.uint64)
    for j in range(GRAM):
        value = value * np.uint64(0x9E3779B97F4A7C15) + h[j : n - GRAM + 1 + j]
    order = np.argsort(value, kind="stable")
    same = value[order[1:]] == value[order[:-1]]
    if not same.any():
        return []
    again = np.zeros(n + 1, np.int64)
    for at in (order[1:][same], order[:-1][same]):
        again[np.unique(at)] |= 1
    cover = np.zeros(n + GRAM, np.int64)
    np.add.at(cover, np.flatnonzero(again), 1)
    np.add.at(cover, np.flatnonzero(again) + GRAM, -1)
    inside = np.cumsum(cover)[:n] > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    number: dict[str, int] = {}
    letters, places = [], []
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if b - a >= least:
            letters += [number.setdefault(w, len(number) + 1) for w in text[a:b]]
            places += range(a, b)
            letters.append(n + len(letters) + 1)  # met once only
            places.append(-1)
    return sorted(((places[s], length, p) for s, length, p in runs_of(letters, least, exponent)), key=lambda r: (r[0], r[2]))


def collapsed(text: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return text
    cover = np.zeros(len(text) + 1, np.int64)
    for start, length, p in runs:
        cover[start + p] += 1
        cover[start + length] -= 1
    return [text[i] for i in np.flatnonzero(np.cumsum(cover)[:-1] == 0).tolist()]


SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _find(least: int, exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        run_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        for batch in batches:
            ids, sizes, found, texts = batch.column(0), [], [], []
            for text in batch.column(1):
                w = words(text.as_py())
                r = word_runs(w, hashes, least, exponent)
                sizes.append(len(w))
                found.append([{"start": s, "length": n, "period": p} for s, n, p in r])
                texts.append(" ".join(collapsed(w, r)))
            columns = [ids, pa.array(sizes, pa.int64()), pa.array(found, run_type), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """Runs of each text and the text without their repeats: (doc_id, n_words, runs, collapsed).

    A run is a longest stretch of words with smallest period q and max(least, exponent * q) words or more (least 6,
    exponent 4 at the lowest). ``collapsed`` joins the words that no run holds after its first q words by one space.
    One pass, row by row, without a shuffle. Null and empty texts have no words, no runs and an empty text; repeated rows
    and rows without a doc_id are treated alike, each by itself; other columns are ignored.
    """
    if least < LEAST or exponent < EXPONENT:
        raise ValueError(f"runs of at least {LEAST} words and {EXPONENT} periods are found")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_find(least, exponent), SCHEMA)


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the query: every tenth document by crc32 of its id repeats a stretch to its end.

    With h = crc32(id) and g = floor(h / 10), words from a = g % n on repeat the first 1 + floor((n - a) / (3 + g % 8)) of
    them where h % 10 = 0; the text is then its words joined by a space. Rows without an id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    w = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), h.alias("h"))
    d = d.withColumn("w", F.when(F.col("h") % 10 == 0, w)).withColumn("g", F.floor(F.col("h") / 10)).withColumn("n", F.size("w"))
    d = d.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    d = d.withColumn("p", (F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)) + 1).cast("int"))

    def place(i: Column) -> Column:
        return F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))

    told = F.array_join(F.transform("w", lambda x, i: F.get("w", place(i))), " ")
    return d.select("doc_id", F.when(F.col("n") > 0, told).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = periodic_runs(with_repeats(documents(spark, sf_dir)))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    told = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    d = d.withColumn("best", best)
    return d.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(told, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
