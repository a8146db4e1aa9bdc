"""Uploads, markups and keys: validation, versions, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.store import stored


def whole_batches(files: DataFrame, batch: str, ok: Column) -> DataFrame:
    """Files of batches in which every file passes; one offence rejects the batch."""
    bad = files.where(~F.coalesce(ok, F.lit(False))).select(F.col(batch).alias("_b")).distinct()
    return files.join(bad, F.col(batch) == F.col("_b"), "left_anti")


def current_versions(log: DataFrame, key: list[str], order: str, op: str = "op") -> DataFrame:
    """Latest row of each key after inserts, updates and deletes; deleted keys are gone."""
    rest = [c for c in log.columns if c not in key]
    last = log.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return last.select(*key, "_r.*").where(F.col(op) != "delete")


def next_id(t: DataFrame, id_col: str) -> DataFrame:
    return t.agg((F.coalesce(F.max(id_col), F.lit(0)) + 1).cast("long").alias("next_id"))


def append_ids(spark: SparkSession, rows: DataFrame, order: list[str], start: int) -> DataFrame:
    """Sequential ids from ``start`` in the order given, without bringing all rows into one partition.

    Rows are sorted by ranges and written once with the number of their range and their place in it; only the number
    of rows of each range comes to the driver.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_k", place)
    dealt = stored(spark, dealt, "dealt")
    before, offsets = start, []
    for p, n in sorted((r[0], r[1]) for r in dealt.groupBy("_p").count().collect()):
        offsets.append((p, before))
        before += n
    off = spark.createDataFrame(offsets, "_p int, _o long")
    return dealt.join(F.broadcast(off), "_p").withColumn("id", F.col("_o") + F.col("_k")).drop("_p", "_k", "_o")


def decode_domain(rows: DataFrame, column: str, domain: DataFrame) -> DataFrame:
    """Adds the label of a coded value: "NA" stays, unknown codes and null give null. ``domain`` (code, label) is small by nature."""
    d = domain.select(F.col("code").alias("_code"), F.col("label").alias("_label"))
    j = rows.join(d, F.col(column) == F.col("_code"), "left")
    return j.withColumn(f"{column}_label", F.when(F.col(column) == "NA", "NA").otherwise(F.col("_label"))).drop("_code", "_label")


def capture_names(images: DataFrame, taken: str, key: str) -> DataFrame:
    """New file names by capture time; those of one second get _1, _2 in the order of the key."""
    stem = F.date_format(taken, "yyyyMMdd_HHmmss")
    n = F.row_number().over(Window.partitionBy("stem").orderBy(key))
    j = images.withColumn("stem", stem).withColumn("_n", n - 1)
    return j.withColumn("name", F.concat(F.col("stem"), F.when(F.col("_n") > 0, F.concat(F.lit("_"), F.col("_n").cast("string"))).otherwise(""))).drop("stem", "_n")


def natural_blocks(name: Column) -> Column:
    """Runs of digits and of other characters of a name, as sort keys: numbers by size, whatever their length, before text."""
    runs = F.regexp_extract_all(name, F.lit(r"\d+|\D+"), F.lit(0))
    number = lambda r: F.regexp_replace(r, r"^0+(?=\d)", "")
    key = lambda kind, size, text: F.struct(F.lit(kind).alias("kind"), size.cast("int").alias("size"), text.alias("text"))
    return F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), key(0, F.length(number(r)), number(r))).otherwise(key(1, F.lit(0), F.trim(r))))


def natural_key(name: Column, blocks: Column | None = None) -> Column:
    """Sort key of a name by its blocks from the last of the first ``blocks`` ones (all without) back to the first."""
    made = natural_blocks(name)
    return F.reverse(made if blocks is None else F.slice(made, F.lit(1), blocks))


def stack_order(files: DataFrame, directory: str, name: str, planes: int) -> DataFrame:
    """Adds (z, t) of the files of each directory, ``planes`` planes to a time, by the natural order of names.

    Only as many blocks count as the shortest name of the directory has; of these the last decides first. Equal
    keys go by the name itself.
    """
    least = files.groupBy(F.col(directory).alias("_dir")).agg(F.min(F.size(natural_blocks(F.col(name)))).alias("_least"))
    j = files.join(least, F.col(directory).eqNullSafe(F.col("_dir"))).withColumn("_key", natural_key(F.col(name), F.col("_least")))
    k = F.row_number().over(Window.partitionBy(directory).orderBy("_key", name)) - 1
    return j.withColumn("_k", k).withColumn("z", (F.col("_k") % planes).cast("long")).withColumn("t", F.floor(F.col("_k") / planes)).drop("_dir", "_least", "_key", "_k")
