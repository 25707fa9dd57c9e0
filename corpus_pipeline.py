"""The corpus pipeline: quality, near-duplicates, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and reread as the next
stage's docs. All but the last return the columns of documents, with their decisions applied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm.common import new_path, table
from lodeseek.llm.decontaminate import contamination
from lodeseek.llm.nearcopies import one_of_each
from lodeseek.llm.packing import pack
from lodeseek.llm.quality import graded, scored, train
from lodeseek.llm.secrets import redacted


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose probability of the best grade is under one half.

    Null and empty texts are judged by their style features alone. Repeated rows are judged alike and all stay or go. Without
    ratings, or with ratings of one grade only, every document stays. Other columns, of any names, pass through; an empty table stays empty.
    """
    model = train(docs, graded(table(spark, sf_dir, "labels")))
    return scored(docs, model).filter("keep").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least doc_id; documents without a doc_id stay.

    Near copies have a Jaccard similarity of 0.8 or more over five-word shingles (op4's fingerprints and 4 bits are another rule).
    Null and wordless texts are copies of each other. Rows that share a doc_id but no text are documents of their own; of
    rows that share both, one stays (see one_of_each). Other columns, of any names, pass through; an empty table stays empty.
    """
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold a full window of 13 words of an item, or whose hit words are a twentieth of theirs or more.

    Null and wordless texts stay; repeated rows stay or go alike; without benchmark items all stay. Other columns, of any
    names, pass through; an empty table stays empty.
    """
    found = contamination(docs, table(spark, sf_dir, "benchmark"), carry=True)
    return found.filter("NOT contaminated AND NOT full").select("row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kinds; every document stays, repeated rows too.

    A null text stays null and keeps its n_chars; an empty one stays empty. Other columns, of any names, pass through; an empty table stays empty.
    """
    clean = redacted(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 ids.

    A null or empty text is the end id alone; repeated rows and rows without a doc_id are packed like any other; other columns are
    not read; an empty table gives no pieces.
    """
    found = pack(docs).withColumn("ids_crc32", F.crc32("ids"))
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("packing", packing)]

#: SQL has no hash of seed 42, no fitted classifier and no tokenizer: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
