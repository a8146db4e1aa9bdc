"""Groups of linked rows: connected components, and exact linking inside hash buckets without all pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, hot_join, hot_match, mix, partitions, stored

#: What a block of rows holds in units of size, and what a row counts for besides its size.
BLOCK_ROOM, ROW_ROOM = 200_000, 150
#: Buckets up to this many members give the pairs of their components; larger ones go through blocks.
SMALL = 24


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    ``edges`` has long columns a, b (a != b). Returns (id, comp): comp is the smallest id of the
    component; ids without an edge do not appear. Every step is one grouping and one skew-safe join,
    each round is written to the shared folder; the rounds end when the edges no longer change.
    """
    e = stored(spark, edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    state = None
    while True:
        # large star: each node's larger neighbours move to its smallest neighbour
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(spark, both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), "low")
        big = hot_join(spark, both.where("v > u"), low, "u", "n", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        big = stored(spark, big, "large-star")
        # small star: a node's smaller neighbours, and the node, move to the smallest of them
        discard(low)
        low = stored(spark, big.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "low")
        moved = hot_join(spark, big, low.where("n > 1"), "u", "n", "v").where("m is not null and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = e, stored(spark, moved.union(low.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        discard(low, big, old)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(e.select("v", "v").distinct())


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (bucket, id) in order, repeated rows taken once, those of a bucket with another row here, and those at
    the ends, with n: the bucket's rows in the batch."""
    held, first = None, True

    def out(bucket: np.ndarray, ids: np.ndarray, n: np.ndarray, keep: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(bucket[keep]), pa.array(ids[keep]), pa.array(n[keep].astype(np.int32))], names=["bucket", "id", "n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        before = 1 if held is None else held[2]
        if held is not None:
            bucket, ids = np.concatenate([held[0], bucket]), np.concatenate([held[1], ids])
        once = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (ids[1:] != ids[:-1])])
        bucket, ids = bucket[once], ids[once]
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        n = np.diff(np.append(starts, len(bucket)))
        size = np.repeat(n, n)
        # a row held back had company in its own batch, if not here
        size[: n[0]] = np.maximum(size[: n[0]], before)
        last = starts[-1]
        held = (bucket[last:][-1:], ids[last:][-1:], size[last])
        keep = size > 1
        keep[0] |= first
        keep[-1] = False
        first = False
        yield out(bucket, ids, size, keep)
    if held is not None:  # the last row may go on in the next partition
        yield out(held[0], held[1], np.array([max(held[2], 2)]), np.array([True]))


def crowded(spark: SparkSession, keyed: DataFrame) -> DataFrame:
    """Rows (bucket, id, n) of ``keyed`` (bucket, id) whose bucket may have another row.

    One sort by ranges of (bucket, id), so a frequent bucket is dealt over several tasks; each task passes
    over its rows once. Rows alone in their bucket go, but for the two ends of a task's range. n is the number of
    the bucket's rows seen together: its size or, for buckets beyond a batch or a range, a part of it.
    """
    n = partitions(spark)
    return keyed.repartitionByRange(n, "bucket", "id").sortWithinPartitions("bucket", "id").mapInArrow(_runs, "bucket long, id long, n int")


#: Keys a task packs at a time; parts of the keys; of a bucket so many ids of a pack go to its part, the others to one of SALTS more.
PACK, PARTS, PART_IDS, SALTS = 1 << 21, 512, 64, 16


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, salt, buckets, ids) of rows (id, keys): 32 bits of each key after those of its part, and the ids, as bytes."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def pack() -> pa.RecordBatch:
        ids, lengths, keys = (np.concatenate(x) for x in zip(*held, strict=True))
        # an id comes with the same keys each time
        once = np.zeros(len(ids), bool)
        once[np.unique(ids, return_index=True)[1]] = True
        keys = keys[np.repeat(once, lengths)].view(np.uint64) >> np.uint64(23)
        ids = np.repeat(ids[once], lengths[once])
        order = np.argsort(keys)
        keys, ids = keys[order], ids[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        rank = np.arange(len(keys)) - np.repeat(starts, np.diff(np.append(starts, len(keys))))
        salts = np.where(rank < PART_IDS, 0, 1 + (mix(ids.view(np.uint64)) % np.uint64(SALTS)).astype(np.int64))
        group = (keys >> np.uint64(32)).astype(np.int64) + salts * PARTS
        if salts.any():
            order = np.argsort(group, kind="stable")
            keys, ids, group = keys[order], ids[order], group[order]
        cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        low = keys.astype(np.uint32)
        ends = [*cuts[1:], len(keys)]
        data = [[x[i:j].tobytes() for i, j in zip(cuts, ends, strict=True)] for x in (low, ids)]
        group = group[cuts].astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(group % PARTS), pa.array(group // PARTS), *[pa.array(x, pa.binary()) for x in data]], names=["part", "salt", "buckets", "ids"])

    for batch in batches:
        lists = batch.column(1)
        held.append((batch.column(0).to_numpy(), lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy()))
        size += len(held[-1][2])
        if size >= PACK:
            yield pack()
            held, size = [], 0
    if size:
        yield pack()


def _unpacked(group: pa.Table) -> pa.Table:
    """Rows (bucket, id, n) of the packs of a part, of buckets with another id in it; with a salt all, as the others have gone to the part itself."""
    part, salt = group["part"][0].as_py(), group["salt"][0].as_py()
    low, ids = (np.concatenate([np.frombuffer(x.as_py(), kind) for x in group[c]]) for c, kind in (("buckets", np.uint32), ("ids", np.int64)))
    order = np.argsort(low)
    low, ids = low[order], ids[order]
    same = low[1:] == low[:-1]
    company = np.concatenate([same, [False]]) | np.concatenate([[False], same]) | bool(salt)
    low, ids = low[company], ids[company]
    order = np.lexsort((ids, low))
    low, ids = low[order], ids[order]
    once = np.concatenate([[True], (low[1:] != low[:-1]) | (ids[1:] != ids[:-1])])[: len(low)]
    low, ids = low[once], ids[once]
    starts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]])[: len(low)])
    n = np.repeat(*[np.diff(np.append(starts, len(low)))] * 2)
    n = np.maximum(n, PART_IDS if salt else 0)
    keep = n > 1
    return pa.table({"bucket": low[keep].astype(np.int64) + (part << 32), "id": ids[keep], "n": n[keep].astype(np.int32)})


def met(keyed: DataFrame) -> DataFrame:
    """Rows (bucket, id, n) of ``keyed`` (id, keys: evenly spread 64-bit numbers, the same for the same id) whose bucket has another id.

    As ``crowded``, but keys are packed with their ids in arrays before they move, 12 bytes each, and are not sorted among tasks. A bucket
    is named by the first 41 bits of its key. Of a frequent bucket a pack sends its part but ``PART_IDS`` ids and others elsewhere, with
    n not below that number, so no group holds much of it; there an id may be told twice.
    """
    packs = keyed.select("id", "keys").mapInArrow(_packs, "part int, salt int, buckets binary, ids binary")
    return packs.groupBy("part", "salt").applyInArrow(_unpacked, "bucket long, id long, n int")


def _joined(spark: SparkSession, e: DataFrame, links: DataFrame) -> DataFrame:
    """``e`` with the components c joined that links (ca, cb) connect."""
    merged = components(spark, links.select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a != b"))
    weights = e.groupBy(F.col("c").alias("id")).agg(F.count("*").alias("w"))
    merged = stored(spark, merged.join(weights, "id").select(F.col("id").alias("c"), "comp", "w"), "joined-components")
    out = hot_join(spark, e, merged, "c", "w", "id")
    return stored(spark, out.withColumn("c", F.coalesce("comp", "c")).drop("comp", "w"), "joined")


def link(spark: SparkSession, members: DataFrame, sizes: DataFrame, verify: Callable[[DataFrame], DataFrame], payload: Callable[[DataFrame], DataFrame], compare: Callable[[pd.DataFrame], pd.DataFrame], keyed: bool = False) -> DataFrame:
    """Components of the graph in which two members of a common bucket are linked if ``verify`` keeps the pair.

    ``members`` is a stored table (bucket, id, n) from ``crowded``, ``sizes`` has (id, size) of every id; ``verify`` takes pairs
    with columns a, b and returns those rows that hold. First every id is compared with one other, the
    centre of its fullest bucket: the member that meets most others. Then buckets that still hold several components
    are looked at: small ones give the pairs of ids of different components, larger ones go through blocks. There
    ``payload`` adds to rows with an id what ``compare`` reads, and ``compare`` gives links (a, b, ca, cb) between
    rows that ask and rows of the block, one for each two components. First each asks one block, as that settles most,
    then the rest asks all; with ``keyed`` all are asked at once, and rows have their buckets in a column ``keys``, so
    that ``compare`` need only look at those that share one. The components are those of verifying all pairs of every bucket, but pairs inside one
    component are not made, and between the steps an id is one row. Returns (id, comp) of ids that have a link.
    """
    heads = members.groupBy("id").agg(F.max_by("bucket", F.struct("n", "bucket")).alias("best"), F.sum("n").alias("met"), F.collect_list(F.struct("bucket", "n")).alias("buckets"))
    heads = stored(spark, heads, "heads")
    centres = heads.groupBy("best").agg(F.max_by("id", F.struct("met", "id")).alias("centre"), F.count("*").alias("w"))
    centres = stored(spark, centres, "centres")
    e = stored(spark, hot_join(spark, heads, centres, "best", "w", "id").drop("w", "best", "met"), "with-centres")
    found = verify(e.where("id != centre").select(F.col("centre").alias("a"), F.col("id").alias("b")))
    linked = found.select(F.col("b").alias("id"), F.col("a").alias("to"))
    e = stored(spark, e.join(linked, "id", "left").withColumn("c", F.coalesce("to", "id")).drop("to"), "starred")
    discard(heads, centres)

    # open small buckets: pairs of different components
    x = e.select(F.explode("buckets").alias("k"), "id", "c").select("k.bucket", "k.n", "id", "c")
    lists = x.where(F.col("n") <= SMALL).groupBy("bucket").agg(F.count("*").alias("k"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.collect_list(F.struct("id", "c")).alias("l"))
    lists = lists.where(f"lo != hi and k <= {SMALL}")
    pair = lambda p, q: F.struct(F.least(p["id"], q["id"]).alias("a"), F.greatest(p["id"], q["id"]).alias("b"), F.when(p["id"] < q["id"], p["c"]).otherwise(q["c"]).alias("ca"), F.when(p["id"] < q["id"], q["c"]).otherwise(p["c"]).alias("cb"))
    each = F.flatten(F.transform("l", lambda p, i: F.transform(F.filter(F.slice("l", i + 2, SMALL), lambda q: q["c"] != p["c"]), lambda q: pair(p, q))))
    found = verify(stored(spark, lists.select(F.explode(each).alias("p")).select("p.*").distinct(), "small-pairs"))
    if not found.isEmpty():
        e = _joined(spark, e, found)
    large = F.exists("buckets", lambda k: k["n"] > SMALL // 2)  # also remainders at the ends of batches
    if not e.where(large).isEmpty():
        e = _blocks(spark, e, sizes)
        for whole in (True,) if keyed else (False, True):
            found = _closing(spark, e, payload, compare, whole, keyed)
            if found is None:
                break
            if not found.isEmpty():
                e = _joined(spark, e, found)
    return e.select("id", F.col("c").alias("comp"))


def _blocks(spark: SparkSession, e: DataFrame, sizes: DataFrame) -> DataFrame:
    """Lays the rows in blocks of bounded size, those with one centre together: adds room and block."""
    e = stored(spark, e.join(sizes.select("id", (F.col("size") + ROW_ROOM).alias("room")), "id"), "roomed")
    homes = stored(spark, e.groupBy("centre").agg(F.count("*").alias("w"), F.ceil(F.sum("room") / BLOCK_ROOM).alias("blocks")), "homes")
    block = F.xxhash64("centre", F.pmod(F.xxhash64("id"), F.col("blocks")))
    return stored(spark, hot_join(spark, e, homes, "centre", "w", "id").withColumn("block", block).drop("blocks", "w"), "blocks")


def _closing(spark: SparkSession, e: DataFrame, payload: Callable[[DataFrame], DataFrame], compare: Callable[[pd.DataFrame], pd.DataFrame], whole: bool, keyed: bool) -> DataFrame | None:
    """Links (a, b, ca, cb) that join ids of different components, a outside a bucket's largest component; None
    if no larger bucket is open.

    A row outside the largest component of a bucket asks every block that holds a member of that bucket, once
    however many buckets they share (without ``whole`` it asks one block only), and a block answers all who
    ask it. No pairs are made; with ``whole`` no link is lost.
    """
    x = e.select(F.explode("buckets").alias("k"), "id", "c", "block").select("k.bucket", "id", "c", "block")
    parts = x.groupBy("bucket", "c").agg(F.count("*").alias("m"), F.collect_set("block").alias("blocks"))
    open_ = parts.groupBy("bucket").agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.sum("m").alias("w"), F.count("*").alias("parts"), F.array_distinct(F.flatten(F.collect_list("blocks"))).alias("blocks"))
    open_ = stored(spark, open_.where(f"parts > 1 and w > {SMALL}").drop("parts"), "open")
    if open_.isEmpty():
        return None
    outside = hot_match(spark, x.drop("block"), open_, "bucket", "w", F.col("c") != F.col("main"))
    asks = outside.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("blocks"))).alias("blocks"))
    if not whole:
        asks = asks.withColumn("blocks", F.slice("blocks", F.pmod(F.xxhash64("id"), F.size("blocks")).cast("int") + 1, 1))
    asks = stored(spark, asks.join(e.select("id", "c", "room"), "id").select("id", "c", "room", F.explode("blocks").alias("block")), "asks")
    asked = asks.groupBy("block").agg(F.count("*").alias("w"), F.ceil(F.sum("room") / BLOCK_ROOM).cast("int").alias("chunks"))
    asked = stored(spark, asked, "asked")
    needed = asks.select("id").union(e.join(asked.select("block"), "block", "left_semi").select("id")).distinct()
    data = stored(spark, payload(needed), "payload")
    dealt = hot_join(spark, asks, asked, "block", "w", "id").select("id", "c", "block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("chunks")).cast("int").alias("chunk"), F.lit(True).alias("asks"))
    answer = e.join(asked.select("block", "chunks"), "block").select("id", "c", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(False).alias("asks"))
    # dealt by number, as a small table may be much work
    if keyed:
        data = data.join(e.select("id", F.transform("buckets", lambda k: k["bucket"]).alias("keys")), "id")
    met = dealt.unionByName(answer).join(data, "id").repartition(max(partitions(spark), 64), "block", "chunk")
    found = met.groupBy("block", "chunk").applyInPandas(compare, "a long, b long, ca long, cb long")
    return stored(spark, found, "closing-links")


def salted_pairs(spark: SparkSession, pairs: DataFrame, texts: DataFrame, chunk: int = 256) -> DataFrame:
    """Pairs (a, b, more) with the text of either added: text_a, text_b.

    ``texts`` (id, text) has one row an id. A centre with many pairs is dealt out over copies of its row,
    one for about ``chunk`` pairs, so no task holds more than a few chunks of one centre.
    """
    pairs = stored(spark, pairs, "pairs")
    counts = stored(spark, pairs.groupBy("a").agg(F.count("*").alias("n")), "pair-counts")
    dealt = hot_join(spark, pairs, counts, "a", "n", "b").withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / chunk)).cast("int")).drop("n")
    copies = texts.join(counts.withColumnRenamed("a", "id"), "id").select(F.col("id").alias("a"), F.col("text").alias("text_a"), F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / chunk) - 1).cast("int"))).alias("salt"))
    b_side = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return dealt.join(b_side, "b").join(copies, ["a", "salt"]).select(*pairs.columns, "text_a", "text_b")
