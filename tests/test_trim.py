"""The registered trim over whole texts."""

from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
BLANKS = " \t\n\r\f\v"


def test_trim_whitespace_takes_whole_texts(spark):
    from lodeseek.plans.queries import QUERIES

    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    want = sorted((r["doc_id"], r["text"].strip(BLANKS)) for r in rows)
    assert max(len(t) for _, t in want) > 40
    assert sorted((r["doc_id"], r["trimmed"]) for r in QUERIES["trim_whitespace"](spark, FOLDER).collect()) == want
