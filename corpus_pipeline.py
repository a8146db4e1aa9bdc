"""Corpus pipeline: quality rules, near-duplicate removal, decontamination, source mixing, token blocks.

``STAGES`` are (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. All but
the last return the columns of ``documents``; each result is written as Parquet in the shared folder and read
again as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldstrata.llm import decontam, mixing, neardup, quality, tokens
from fieldstrata.llm.common import discard, stored, temporary

STAGES = [
    ("quality rules", quality.stage),
    ("near-duplicate removal", neardup.stage),
    ("benchmark decontamination", decontam.stage),
    ("source mixing", mixing.stage),
    ("token blocks", tokens.stage),
]

#: Fitted votes, signatures and tilings have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token index of what the pipeline keeps of ``documents``: (doc_id, start, n_tokens, ids_crc32)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = docs
        with temporary():
            docs = stored(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
        if hasattr(before, "_scratch"):
            discard(before)
    out = STAGES[-1][1](spark, docs, sf_dir)  # the token files hold all that it returns
    discard(docs)
    return out
