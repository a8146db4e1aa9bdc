"""Shared folders, skew-safe joins and word hashing used by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the text contracts: runs of anything but space and the ASCII control blanks.
WORD = r"[^\x20\x09-\x0D]+"
_WORD = re.compile(WORD)
_ODD_BLANK = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def words(text: str | None) -> list[str]:
    """Words of a text; null and empty texts have none. ``str.split`` where it agrees with WORD."""
    if not text:
        return []
    if text.isascii():
        odd = "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text
    else:
        odd = _ODD_BLANK.search(text)
    return _WORD.findall(text) if odd else text.split()


class WordHashes(dict):
    """64-bit hash by word, remembered for up to ``cap`` words."""

    def __init__(self, cap: int = 400_000):
        super().__init__()
        self.cap = cap

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < self.cap:
            self[word] = value
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``k`` words and the row of each.

    ``hashes`` holds the word hashes of all rows one after the other. A row of 1 to k-1 words has one
    shingle of all its words; a row without words has none.
    """
    rows = np.repeat(np.arange(len(lengths)), lengths)
    ends = np.cumsum(lengths)
    out, owner = [], []
    if len(hashes) >= k:
        value = np.zeros(len(hashes) - k + 1, np.uint64)
        for j in range(k):
            value = value * np.uint64(0x9E3779B97F4A7C15) + hashes[j : len(hashes) - k + 1 + j]
        inside = rows[: len(value)] == rows[k - 1 :]
        out.append(mix(value[inside]))
        owner.append(rows[: len(value)][inside])
    for row in np.flatnonzero((lengths > 0) & (lengths < k)):
        value = np.uint64(0)
        with np.errstate(over="ignore"):
            for h in hashes[ends[row] - lengths[row] : ends[row]]:
                value = value * np.uint64(0x9E3779B97F4A7C15) + h
        out.append(mix(np.array([value ^ np.uint64(lengths[row])], np.uint64)))
        owner.append(np.array([row]))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(owner)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share.

    The session's ``spark.checkpoint.dir`` names it; only where that is unset (local tests) a temporary
    folder is taken and set as the checkpoint folder.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        base = spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="spark-")
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/fieldstrata/{name}-{uuid.uuid4().hex}"


_SCOPES: list[list[DataFrame]] = []


@contextmanager
def temporary() -> Iterator[None]:
    """Tables made by ``stored`` inside, but for those with ``keep``, are deleted at the end."""
    _SCOPES.append([])
    try:
        yield
    finally:
        discard(*_SCOPES.pop())


#: Setting by which Spark deletes the shuffle files of a query at its end.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(spark: SparkSession, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """The rows of ``df``, written as Parquet in the shared folder and read again: lineage and shuffle files end here.

    With ``keep`` the table outlives the innermost ``temporary``, and belongs to the next one if there is one.
    """
    path = scratch(spark, name)
    free = spark.conf.get(_FREE, "false")
    spark.conf.set(_FREE, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_FREE, free)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    scopes = _SCOPES[: len(_SCOPES) - keep]
    if scopes:
        scopes[-1].append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``stored`` that nothing will read again."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._scratch)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_join(spark: SparkSession, left: DataFrame, right: DataFrame, key: str, weight: str, row_id: str) -> DataFrame:
    """Left outer join on ``key`` that no single key can slow down.

    ``right`` is a stored table, one row a key; its column ``weight`` counts the rows of ``left`` with
    that key. Keys with more than a quarter of a mean partition number at most four a partition: that
    bounds the broadcast. All others are joined by shuffle, in which rows already matched go by their
    own ``row_id``. Columns of ``right`` (but the key) are added, null where there is no such key.
    """
    n = partitions(spark)
    total = right.agg(F.sum(weight)).first()[0] or 0
    limit = max(total // (4 * n), 64)
    extra = [c for c in right.columns if c != key]
    hot = right.where(F.col(weight) > limit).select(F.col(key).alias("_hk"), *[F.col(c).alias(f"_h_{c}") for c in extra])
    number = dict(right.dtypes)[key] in ("bigint", "int")
    as_key = (lambda c: F.col(c).cast("long")) if number else (lambda c: F.col(c).cast("string"))
    cold = right.where(F.col(weight) <= limit).select(as_key(key).alias("_ck"), *[F.col(c).alias(f"_c_{c}") for c in extra])
    j = left.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left")
    # where the made-up key should meet a real one, what is found there is not taken
    own = F.xxhash64(F.col(row_id)) if number else F.concat(F.lit("\x00"), F.col(row_id).cast("string"))
    done = F.col("_hk").isNotNull() | F.col(key).isNull()
    j = j.withColumn("_jk", F.when(done, own).otherwise(as_key(key))).withColumn("_done", done)
    j = j.join(cold, F.col("_jk") == F.col("_ck"), "left")
    return j.select(*left.columns, *[F.when(F.col("_done"), F.col(f"_h_{c}")).otherwise(F.col(f"_c_{c}")).alias(c) for c in extra])


def hot_match(spark: SparkSession, left: DataFrame, right: DataFrame, key: str, weight: str, test: Column) -> DataFrame:
    """Inner join on ``key`` of the rows that pass ``test``, that no single key can slow down.

    ``right`` is a stored table, one row a key; its column ``weight`` counts the rows of ``left`` with that key. As
    in ``hot_join`` keys above a share of the rows are broadcast, the others meet by shuffle; rows of ``left`` whose
    key is not in ``right`` or that fail the test are not carried on.
    """
    n = partitions(spark)
    limit = max((right.agg(F.sum(weight)).first()[0] or 0) // (4 * n), 64)
    extra = [c for c in right.columns if c not in (key, weight)]
    side = right.withColumnRenamed(key, "_mk").select("_mk", *extra, weight)
    hot = F.broadcast(side.where(F.col(weight) > limit).drop(weight))
    cold = side.where(F.col(weight) <= limit).drop(weight)
    a = left.join(hot, (F.col(key) == F.col("_mk")) & test).drop("_mk")
    rest = left.join(F.broadcast(hot.select("_mk")), F.col(key) == F.col("_mk"), "left_anti")
    return a.unionByName(rest.join(cold, (F.col(key) == F.col("_mk")) & test).drop("_mk"))


#: Rows of one number or short key each up to which a table counts as small enough to broadcast.
SMALL_TABLE = 1_000_000


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is not in ``gone`` (one long column of distinct ids, stored); rows without one stay.

    Up to ``SMALL_TABLE`` ids are broadcast, so that no text moves; more meet the documents by shuffle.
    """
    name = f"_gone_{uuid.uuid4().hex}"  # a name that no column of the documents has
    ids = gone.select(F.col(gone.columns[0]).alias(name))
    ids = F.broadcast(ids) if ids.count() <= SMALL_TABLE else ids
    return docs.join(ids, F.col("doc_id") == F.col(name), "left_anti")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
