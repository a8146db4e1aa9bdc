"""Operator 6: mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SMALL_TABLE, WORD, documents, hot_join, stored, temporary

#: A document's hash has 60 bits; each refinement splits the boundary bucket by the next 12.
BITS, LEVEL_BITS = 60, 12
MAX_REPEATS = 3


def doc_hash(doc_id: Column) -> Column:
    """60 bits of the md5 of the id as text: the same on every run and in any engine."""
    return F.conv(F.substring(F.md5(doc_id.cast("string")), 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, cap: int = MAX_REPEATS) -> DataFrame:
    """Target words of each source: (source, source_size, target).

    ``sizes`` has one row a source. Sources in code-point order, null last, weigh 1, 2, 3, 1, 2, 3 ...
    and share the words of all; a target stops at ``cap`` times its source's size and the excess goes
    to the others by weight. With ratios cap * size / weight in rising order, the first k sources are at
    their cap for the smallest k at which the share of the rest fits below the next ratio. One row a
    source goes through a window without partitions; documents do not.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("weight", (F.row_number().over(every) - 1) % 3 + 1)
    s = s.withColumn("ratio", F.col("source_size") * F.lit(float(cap)) / F.col("weight"))
    up = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, all_ = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(all_)).withColumn("weights", F.sum("weight").over(all_))
    s = s.withColumn("capped", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * cap).withColumn("used", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("share", (F.col("total") - F.col("capped")) / (F.col("weights") - F.col("used")).cast("double"))
    s = s.withColumn("level", F.first(F.when(F.col("share") <= F.col("ratio"), F.col("share")), ignorenulls=True).over(all_))
    target = F.when(F.col("level").isNull() | (F.col("ratio") <= F.col("level")), F.col("source_size") * F.lit(float(cap))).otherwise(F.col("weight") * F.col("level"))
    return s.select("source", "source_size", target.alias("target"))


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source))


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    h = F.coalesce(doc_hash(F.col("doc_id")), F.lit(0)).alias("h")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _source_key(F.col("source").cast("string")).alias("key"), h, *more)


def _by_source(spark: SparkSession, left: DataFrame, table: DataFrame) -> DataFrame:
    """Left join with one row a source: broadcast where there are at most ``SMALL_TABLE`` // 10 sources."""
    if table.count() <= SMALL_TABLE // 10:
        return left.join(F.broadcast(table), "key", "left")
    return hot_join(spark, left, table, "key", "n", "doc_id")


def thresholds(spark: SparkSession, d: DataFrame, cap: int = MAX_REPEATS) -> DataFrame:
    """What a source gives, one row a source: (key, source_size, target, rounds, below, n).

    ``d`` is a stored table (doc_id, key, h, size). A source's target is whole rounds over all its documents and
    a rest. For the rest, words are summed by source and the top 12 bits of a hash of the doc_id; the bucket in
    which the sum passes the rest is split by the next 12 bits, and so on: five small histograms give the largest
    hash threshold whose documents do not exceed the rest. The next hash is added if that brings the source nearer
    to its target.
    """
    sizes = d.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    source = F.when(F.col("key") != "-", F.substr("key", F.lit(2)))
    t = targets(sizes.select(source.alias("source"), "source_size"), cap).withColumn("key", _source_key(F.col("source")))
    t = t.withColumn("rounds", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    t = t.withColumn("rest", F.col("target") - F.col("rounds") * F.col("source_size"))
    counts = sizes.select(F.col("key").alias("k2"), "n")
    t = stored(spark, t.join(counts, F.col("key") == F.col("k2")).select("key", "source_size", "target", "rounds", "rest", "n"), "targets")
    # prefix: the hash bits found so far; under: words of the hashes below it
    edge = t.select("key", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("under"), "rest", "n")
    shift = BITS
    while shift:
        before, shift = shift, shift - LEVEL_BITS
        edge = stored(spark, edge, "edge")
        # the histogram counts every document once; later levels only the boundary bucket of each source
        if before == BITS:
            in_edge = d.select("key", "h", "size")
        else:
            in_edge = _by_source(spark, d, edge.select("key", "prefix", "n")).where(F.shiftright("h", before) == F.col("prefix"))
        hist = in_edge.groupBy("key", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("words"))
        hist = hist.join(edge.withColumnRenamed("key", "k2"), F.col("key") == F.col("k2"))
        upto = F.sum("words").over(Window.partitionBy("key").orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
        hist = hist.withColumn("upto", F.col("under") + upto)
        # the first bucket that passes the rest; a source whose every bucket fits keeps the end of the range
        first = F.min_by(F.struct("b", (F.col("upto") - F.col("words")).alias("under")), F.when(F.col("upto") > F.col("rest"), F.col("b")))
        nxt = hist.groupBy("key").agg(first.alias("x"), F.max("rest").alias("rest"), F.max("n").alias("n"), F.max("upto").alias("all"))
        edge = nxt.select("key", F.coalesce("x.b", F.lit((1 << (BITS - shift)) - 1)).alias("prefix"), F.coalesce("x.under", "all").alias("under"), "rest", "n", F.col("x").isNotNull().alias("passed"))
        if shift:
            edge = edge.where("passed").drop("passed")
    edge = stored(spark, edge, "edge")
    at = _by_source(spark, d, edge.select("key", "prefix", "n")).where("h = prefix").groupBy("key").agg(F.sum("size").alias("next"))
    cut = edge.join(at.withColumnRenamed("key", "k2"), F.col("key") == F.col("k2"), "left")
    # below the threshold, and the threshold itself where that comes nearer
    nearer = F.col("next").isNotNull() & (F.col("under") + F.col("next") - F.col("rest") < F.col("rest") - F.col("under"))
    cut = cut.select(F.col("key").alias("k2"), F.when(nearer, F.col("prefix") + 1).otherwise(F.col("prefix")).alias("below"))
    t = t.join(cut, F.col("key") == F.col("k2"), "left").select("key", "source_size", "target", "rounds", F.when(F.col("rest") > 0, F.coalesce("below", F.lit(1 << BITS))).otherwise(F.lit(0)).alias("below"), "n")
    return t


def mix_sources(docs: DataFrame, cap: int = MAX_REPEATS) -> DataFrame:
    """What the mix takes of each document: (doc_id, size, source_size, target, taken).

    Documents are kept by comparing a hash of their doc_id with their source's threshold (``thresholds``); nothing is
    sorted. A document of no words takes none. Null sources are one source. Rows without a doc_id share a
    hash. Repeated rows of one doc_id and source are taken as often as each other. Extra columns are ignored.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    with temporary():
        d = stored(spark, _keyed(docs, size.alias("size")), "sizes", keep=True)
        t = stored(spark, thresholds(spark, d, cap), "thresholds", keep=True)
    return _by_source(spark, d, t).select("doc_id", "size", "source_size", "target", (F.col("size") * times()).alias("taken"))


def times() -> Column:
    """How often the mix takes a document of hash h."""
    return F.col("rounds") + (F.col("h") < F.col("below")).cast("long")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source),
r AS (SELECT *, source_size * 3.0::DOUBLE / weight AS ratio FROM s),
w AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
         coalesce(sum(source_size) OVER up, 0) * 3 AS capped, coalesce(sum(weight) OVER up, 0) AS used
  FROM r WINDOW up AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - capped)::DOUBLE / (weights - used)::DOUBLE AS share FROM w),
f AS (SELECT arg_min(share, ratio) AS level FROM (SELECT share, min(ratio) AS ratio FROM l WHERE share <= ratio GROUP BY share)),
t AS (
  SELECT source, source_size, CASE WHEN level IS NULL OR ratio <= level THEN source_size * 3.0::DOUBLE ELSE weight * level END AS target
  FROM l CROSS JOIN f),
q AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS rounds FROM t),
c AS (
  SELECT d.doc_id, d.size, q.source_size, q.target, q.rounds, q.target - q.rounds * q.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h)::BIGINT AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.h)::BIGINT AS here
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
       size * (rounds + CASE WHEN rest > 0 AND (upto <= rest OR (upto - here <= rest AND upto - rest < rest - (upto - here))) THEN 1 ELSE 0 END) AS taken
FROM c
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it: none to three times; rows without a word are not taken, null sources
    are one source, repeated rows are taken each."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    with temporary():
        d = stored(spark, _keyed(docs, size.alias("size")), "sizes")
        t = stored(spark, thresholds(spark, d), "thresholds", keep=True)
    rows = _keyed(docs, F.struct(*docs.columns).alias("row"), F.coalesce(F.col("text").rlike(WORD), F.lit(False)).alias("some"))
    rows = _by_source(spark, rows, t).where(F.col("some") & (times() > 0))
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), times()))).select("row.*")
