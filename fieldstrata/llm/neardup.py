"""Operator 8: near duplicates by BagMinHash signatures, bands and a check of multiset overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, documents, hot_join, mix, shingle_hashes, stored, temporary, without, words
from .linking import crowded, link, salted_pairs

WORDS, THRESHOLD, BANDS, ROWS = 5, 0.8, 26, 5
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def bags(texts: list[str | None], hashes: WordHashes, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: (shingle hash, row, how often it occurs there)."""
    split = [words(t) for t in texts]
    lengths = np.array([len(w) for w in split], np.int64)
    flat = np.fromiter((hashes[w] for ws in split for w in ws), np.uint64, int(lengths.sum()))
    shingle, row = shingle_hashes(flat, lengths, k)
    order = np.argsort(shingle ^ mix(row.astype(np.uint64) + _GOLD))
    shingle, row = shingle[order], row[order]
    first = np.ones(len(shingle), bool)
    first[1:] = (shingle[1:] != shingle[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(first)
    return shingle[at], row[at], np.diff(np.append(at, len(shingle)))


def bag_signatures(shingle: np.ndarray, row: np.ndarray, weight: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """BagMinHash: an (n_rows, m) array; two rows agree in a component with the chance of their weighted Jaccard.

    The weight axis is cut at 0, 1, 2, 4, 8 ... Each shingle has one Poisson process for each of these
    intervals that its weight reaches, with m points a unit of time and of weight; every point carries a
    component and a weight level, drawn from its own hash, and counts where the weight reaches that level.
    A component keeps its earliest point. As points come in order of time, the processes stop at a time by
    which every component has a point (checked; the few rows with a gap go on for longer), so about
    m * (ln m + 4) points are made for a row, whatever its length.
    """
    signature = np.zeros((n_rows, m), np.uint64)
    total = np.bincount(row, weights=weight, minlength=n_rows)
    todo, factor = total > 0, np.log(m) + 4
    while todo.any():
        limit = np.where(todo, factor / np.maximum(total, 1), -1.0)
        best = np.full(n_rows * m, np.inf)
        seen = []
        low, width = 0, 1
        while True:
            act = np.flatnonzero((weight > low) & todo[row])
            if not len(act):
                break
            seed = mix(shingle[act] ^ (np.uint64((low + width) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)))
            stop, owner, reach = limit[row[act]], row[act], weight[act]
            x = np.zeros(len(act))
            step = 0
            while len(x):
                step += 1
                point = mix(seed + np.uint64(step * int(_GOLD) & (1 << 64) - 1))
                x = x - np.log(((point >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / (m * width)
                on = x <= stop
                x, seed, stop, owner, reach, point = x[on], seed[on], stop[on], owner[on], reach[on], point[on]
                draw = mix(point ^ np.uint64(0xA0761D6478BD642F))
                level = low + 1 + ((draw >> np.uint64(32)) % np.uint64(width)).astype(np.int64)
                target = owner * m + ((draw & np.uint64(0xFFFFFFFF)) % np.uint64(m)).astype(np.int64)
                keep = level <= reach
                target, at, point = target[keep], x[keep], draw[keep]
                np.minimum.at(best, target, at)
                seen.append((target, at, point))
            low, width = (1, 1) if low == 0 else (low * 2, low * 2)
        flat = signature.reshape(-1)
        for target, at, point in seen:
            won = at == best[target]
            flat[target[won]] = point[won]
        todo = todo & np.isinf(best.reshape(n_rows, m)).any(axis=1)
        factor *= 3
    return signature


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` components; the band's number is part of the key."""
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), 1))
    parts = signature.reshape(len(signature), bands, rows)
    for r in range(rows):
        key = mix(key * _GOLD + parts[:, :, r])
    return key.view(np.int64)


def _sign(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = 0
            while at < len(texts):  # by about 2 million characters, so that long texts don't pile up
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end] or "") < 2_000_000):
                    size += len(texts[end] or "")
                    end += 1
                shingle, row, weight = bags(texts[at:end], hashes, k)
                sig = bag_signatures(shingle, row, weight, end - at, bands * rows)
                keys = band_keys(sig, bands, rows)
                some = np.zeros(end - at, bool)
                some[row] = True
                flat = pa.array(keys[some].reshape(-1))
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]).astype(np.int32))
                size = pa.array(np.bincount(row, weights=weight, minlength=end - at).astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), batch.column(2).slice(at, end - at), size, pa.ListArray.from_arrays(offsets, flat)], names=["id", "digest", "size", "bands"])
                at = end

    return run


def overlap(a: str | None, b: str | None, hashes: WordHashes, k: int = WORDS) -> float:
    """Multiset Jaccard of the texts' shingles; 0 where either has none."""
    shingle, row, weight = bags([a, b], hashes, k)
    if not (row == 0).any() or not (row == 1).any():
        return 0.0
    order = np.argsort(shingle, kind="stable")
    shingle, weight = shingle[order], weight[order]
    same = np.flatnonzero(shingle[1:] == shingle[:-1])
    both = np.minimum(weight[same], weight[same + 1]).sum()
    return both / (weight.sum() - both)


def _verify(k: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ta, tb = (batch.column(c).to_pylist() for c in ("text_a", "text_b"))
            keep = [overlap(x, y, hashes, k) >= threshold for x, y in zip(ta, tb, strict=True)]
            yield batch.drop_columns(["text_a", "text_b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _elements(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shingle, _, weight = bags([text], hashes, k)
                level = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
                e = mix(np.repeat(shingle, weight) + level.astype(np.uint64) * _GOLD).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(e)], pa.int32()), pa.array(e))], names=["id", "e"])

    return run


def overlaps(a: list[np.ndarray], b: list[np.ndarray], shared: np.ndarray, columns: int = 2048) -> np.ndarray:
    """How many of the ``shared`` elements (sorted) each row of a has in common with each row of b.

    An element occurs once in a row at most, so the counts are products of 0/1 tables, made by slices of columns.
    """

    def placed(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        at = np.minimum(np.searchsorted(shared, flat), len(shared) - 1)
        on = shared[at] == flat
        order = np.argsort(at[on], kind="stable")
        return at[on][order], owner[on][order]

    out = np.zeros((len(a), len(b)), np.float32)
    if not len(shared):
        return out
    sides = placed(a), placed(b)
    for low in range(0, len(shared), columns):
        tables = []
        for (at, owner), n in zip(sides, out.shape, strict=True):
            i, j = np.searchsorted(at, [low, low + columns])
            table = np.zeros((n, columns), np.float32)
            table[owner[i:j], at[i:j] - low] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    return out


def _compare(threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Links between rows that ask and rows of a block; one for each two components is enough."""
        asks, own = rows[rows["asks"]], rows[~rows["asks"]]
        if not len(asks) or not len(own):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("a", "b", "ca", "cb")})
        once = rows.drop_duplicates("id")
        element, held = np.unique(np.concatenate(once["e"].tolist()), return_counts=True)
        both = overlaps(asks["e"].tolist(), own["e"].tolist(), element[held > 1]).astype(np.float64)
        size_a, size_b = asks["e"].map(len).to_numpy(), own["e"].map(len).to_numpy()
        similar = both / np.maximum(size_a[:, None] + size_b - both, 1) >= threshold
        i, j = np.nonzero(similar & (asks["c"].to_numpy()[:, None] != own["c"].to_numpy()))
        found = pd.DataFrame({"a": asks["id"].to_numpy()[i], "b": own["id"].to_numpy()[j], "ca": asks["c"].to_numpy()[i], "cb": own["c"].to_numpy()[j]})
        return found.drop_duplicates(["ca", "cb"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Class of near copies of every row: (id, class_id, class_size, is_representative).

    Rows are linked when their texts are equal, or when they share a band and the multiset Jaccard of
    their shingles of ``k`` words is ``threshold`` or more; classes are the connected components, named by
    their smallest id. The 26 bands of 5 rows miss a pair at 0.8 with a chance of 4 in 100,000. Null
    and empty texts, and those of blanks only, have no shingles and are classes of their own, one a row; a
    text of fewer than k words is one shingle. Repeated rows of one id count as one, in the
    class of the smallest id if their texts differ. Rows without an id are left out. Other columns of the input are ignored, whatever their names.
    """
    spark = docs.sparkSession
    src = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # an id without words gets a digest of its own, so it is never grouped
    src = src.select("id", "text", F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.md5("text")).otherwise(F.concat(F.lit("-"), F.col("id").cast("string"))).alias("digest"))
    with temporary():
        signed = stored(spark, src.mapInArrow(_sign(k, bands, rows), "id long, digest string, size long, bands array<long>"), "signatures")
        texts = signed.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("bands").alias("bands"))
        texts = stored(spark, texts, "distinct-texts")
        keyed = texts.where("size(bands) > 0").select(F.explode("bands").alias("bucket"), F.col("rep").alias("id"))
        members = stored(spark, crowded(spark, keyed), "members")
        candidates = src.select("id", "text").join(members.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
        candidates = stored(spark, candidates, "candidate-texts")

        def verify(pairs: DataFrame) -> DataFrame:
            pairs = salted_pairs(spark, pairs, candidates)
            schema = ", ".join(f"{c} long" for c in pairs.columns if not c.startswith("text_"))
            return stored(spark, pairs.mapInArrow(_verify(k, threshold), schema), "links")

        def payload(ids: DataFrame) -> DataFrame:
            return candidates.join(ids, "id", "left_semi").mapInArrow(_elements(k), "id long, e array<long>")

        sizes = texts.groupBy(F.col("rep").alias("id")).agg(F.max("size").alias("size"))
        comp = stored(spark, link(spark, members, sizes, verify, payload, _compare(threshold)), "classes")
        # a component is named by its smallest id
        names = stored(spark, comp.groupBy("comp").agg(F.min("id").alias("class_id"), F.count("*").alias("w")), "class-names")
        comp = hot_join(spark, comp, names, "comp", "w", "id").select("id", "class_id")
        classes = texts.join(comp, F.col("rep") == F.col("id"), "left").select("digest", F.coalesce("class_id", "rep").alias("class_id"), "n")
        classes = stored(spark, classes, "text-classes")
        out = hot_join(spark, signed.select("id", "digest").distinct(), classes, "digest", "n", "id").groupBy("id").agg(F.min("class_id").alias("class_id"))
        out = stored(spark, out, "memberships")
        sizes = stored(spark, out.groupBy("class_id").agg(F.count("*").alias("class_size")), "class-sizes")
        out = hot_join(spark, out, sizes.withColumn("n", F.col("class_size")), "class_id", "n", "id")
        out = out.select(F.col("id").alias(id_col), "class_id", "class_size", (F.col("id") == F.col("class_id")).alias("is_representative"))
        return stored(spark, out, "near-duplicates", keep=True)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, that with the smallest doc_id; repeated rows of that doc_id stay too, and
    rows without a doc_id; null and empty texts are classes of their own."""
    with temporary():
        gone = stored(spark, near_duplicates(docs).where("not is_representative").select("doc_id"), "copies", keep=True)
    return without(docs, gone)
