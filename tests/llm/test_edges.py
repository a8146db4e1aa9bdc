"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from fieldstrata.llm import archives, decontam, licenses, lines, mixing, neardup, pii, quality, tokens, toxicity

SF = "/root/testdata/sf0.001"
LONG = "\n".join(" ".join(f"word{i * j % 977}" for j in range(40)) for i in range(2500))  # 900,000 characters
SAME = " ".join(f"tie{i}" for i in range(80))
ROWS = [(None, SAME, "x"), (None, None, None), (1, None, "x"), (2, "", None), (3, LONG, "x"), (3, LONG, "x"), (4, SAME, "y"), (5, SAME, "y"), (5, SAME + " other text", "z"), (6, " \n\t ", "z"), (-7, SAME, "y")]
CLASH = ["id", "bucket", "n", "row", "key", "h", "a", "b", "c", "kept", "digest", "found", "page_id", "size", "_id", "_gone", "start", "w"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumn("lang", F.lit(None).cast("string")).withColumn("n_chars", F.length("text"))
    for i, c in enumerate(CLASH):
        df = df.withColumn(c, F.lit(i if i % 2 else "x"))
    return df


@pytest.fixture(scope="module")
def network(spark):
    texts = spark.createDataFrame([(i, ("vile words here " if i % 2 else "kind words here ") * 10) for i in range(60)], "doc_id long, text string")
    return toxicity.fit(texts, spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 0)], "doc_id long, toxic int"))


def pages(df):
    return df.drop("page_id").select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"), "n", "digest")


#: Operator, and how many rows it gives for ROWS: one a row, one a row with an id, or one an id.
RUNS = {
    "op1": (lambda df, net: tokens.token_table(df), 9),
    "op2": (lambda df, net: licenses.scan_licenses(df), 11),
    "op3": (lambda df, net: pii.replace_entities(df), 11),
    "op4": (lambda df, net: decontam.contaminated(df, df.sparkSession.createDataFrame([(1, SAME), (1, SAME), (2, None), (None, SAME), (3, "")], "item_id long, text string").withColumn("n", F.lit(1))), 3),
    "op5": (lambda df, net: archives.convert_pages(pages(df)), 11),
    "op6": (lambda df, net: mixing.mix_sources(df), 11),
    "op7": (lambda df, net: lines.line_groups(df), None),
    "op8": (lambda df, net: neardup.near_duplicates(df), 7),
    "op9": (lambda df, net: toxicity.score_documents(df, net), 11),
    "op10": (lambda df, net: quality.judge(df), 11),
}


@pytest.mark.parametrize("name", RUNS)
def test_operators(docs, network, name):
    run, rows = RUNS[name]
    got = run(docs, network)
    assert run(docs.limit(0), network).count() == 0
    found = got.collect()
    assert rows is None or len(found) == rows
    if name == "op1":
        assert [r.n_tokens for r in sorted(found, key=lambda r: r.start)][:3] and {r.n_tokens for r in found if r.doc_id in (1, 2)} == {1}
    elif name == "op4":
        assert {(r.doc_id, r.item_id, r.coverage) for r in found} == {(4, 1, 1.0), (5, 1, 1.0), (-7, 1, 1.0)}
    elif name == "op5":
        assert sum(r.record_type == "response" for r in found) == 5 and {r.refers_to for r in found if r.page_id == 4} == {5}
    elif name == "op6":
        assert all(r.taken <= 3 * r["size"] for r in found)
    elif name == "op7":
        assert {(r.doc_id, r.line): r.kept for r in found if r.doc_id in (-7, 4)} == {(-7, 0): True, (4, 0): False}
        assert {r.doc_id for r in found} == {3, 4, 5, -7}
    elif name == "op8":
        by = {r.doc_id: (r.class_id, r.is_representative) for r in found}
        assert by[4][0] == by[5][0] == by[-7][0] == -7 and by[-7][1] and by[1] == (1, True)
    elif name == "op10":
        assert all(r.base_failed for r in found if r.doc_id in (1, 2, 6))


@pytest.mark.parametrize("stage", [quality.stage, neardup.stage, decontam.stage, mixing.stage])
def test_stages_keep_columns(spark, docs, stage):
    got = stage(spark, docs, SF)
    assert got.schema.names == docs.schema.names and got.count() > 0
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_token_stage(spark, docs):
    assert tokens.stage(spark, docs, SF).count() == 9 and tokens.stage(spark, docs.limit(0), SF).count() == 0


def test_columns_of_nulls(spark, docs, network):
    none = docs.withColumn("text", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string"))
    for name, (run, _) in RUNS.items():
        rows = run(none, network).count()
        assert rows == (0 if name in ("op4", "op7") else 9 if name == "op1" else 7 if name == "op8" else 11), name
