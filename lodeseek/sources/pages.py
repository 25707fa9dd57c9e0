"""The page table: upserts as one aggregation by url, lookups, counts, the saved frontier, seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.functions.urls import domain_stored

SCHEMA = "url string, domain string, crawled_at timestamp, status_code int, content_hash string, content_size long, ai_score double, era string, indexed boolean"


def content_hash(html: Column) -> Column:
    return F.sha2(html, 256)


def url_key(url: Column) -> Column:
    """The object name of a page."""
    return F.concat(F.substring(F.md5(url), 1, 16), F.lit(".html"))


def upsert_pages(pages: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """batch overwrites status, hash, size; its nulls keep ai_score, era and indexed; crawled_at is set on conflict if a status came.

    One shuffle of both tables by url. batch has at most one row a url.
    """
    both = pages.select("*", F.lit(0).alias("_new")).unionByName(batch.select(*(F.col(c) for c in pages.columns), F.lit(1).alias("_new")))
    old = lambda c: F.max(F.when(F.col("_new") == 0, F.col(c)))
    new = lambda c: F.max(F.when(F.col("_new") == 1, F.col(c)))
    has_old, has_new = F.max(F.col("_new") == 0), F.max(F.col("_new") == 1)
    written = lambda c: F.when(has_new, new(c)).otherwise(old(c)).alias(c)
    crawled = F.when(has_old & has_new & new("status_code").isNotNull(), now).otherwise(old("crawled_at"))
    return both.groupBy("url").agg(
        F.coalesce(old("domain"), new("domain")).alias("domain"), crawled.alias("crawled_at"), written("status_code"), written("content_hash"), written("content_size"),
        *(F.coalesce(new(c), old(c)).alias(c) for c in ("ai_score", "era", "indexed"))).select(*pages.columns)


def mark_crawled(pages: DataFrame, fetched: DataFrame, now: Column, reset_on_change: bool = False) -> DataFrame:
    """fetched(url, status_code, content_hash, content_size) set crawled_at and what was fetched; new rows are not indexed, old ones keep their flag.

    reset_on_change: a changed hash clears the flag.
    """
    got = fetched.select("url", F.struct("status_code", "content_hash", "content_size").alias("_f"))
    rows = pages.join(got, "url", "full_outer")
    new = F.col("_f").isNotNull()
    pick = lambda c: F.when(new, F.col(f"_f.{c}")).otherwise(F.col(c)).alias(c)
    changed = F.lit(reset_on_change) & new & ~F.col("_f.content_hash").eqNullSafe(F.col("content_hash"))
    return rows.select(
        "url", F.coalesce("domain", domain_stored(F.col("url"))).alias("domain"), F.when(new, now).otherwise(F.col("crawled_at")).alias("crawled_at"), pick("status_code"), pick("content_hash"), pick("content_size"),
        "ai_score", "era", F.when(changed, False).otherwise(F.coalesce("indexed", F.lit(False))).alias("indexed"))


def get_page(pages: DataFrame, url: str) -> DataFrame:
    return pages.filter(F.col("url") == url)


def unindexed(pages: DataFrame, limit: int = 100) -> DataFrame:
    """The oldest crawled pages with status 200 that are not indexed."""
    return pages.filter("crawled_at IS NOT NULL AND status_code = 200 AND NOT indexed").orderBy("crawled_at", "url").limit(limit)


def mark_indexed(pages: DataFrame, done: DataFrame) -> DataFrame:
    flags = done.select("url").distinct().withColumn("_d", F.lit(True))
    return pages.join(flags, "url", "left").withColumn("indexed", F.col("indexed") | F.coalesce("_d", F.lit(False))).drop("_d")


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.agg(F.count("*").alias("pages"), F.count_if("indexed").alias("indexed"))


def save_frontier(entries: DataFrame, path: str) -> None:
    entries.select("url", "domain", "priority", "added_at").write.mode("overwrite").parquet(path)


def load_frontier(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).orderBy("priority", "added_at")


def clear_frontier(spark: SparkSession, path: str) -> None:
    save_frontier(load_frontier(spark, path).limit(0), path + ".empty")
    spark.read.parquet(path + ".empty").write.mode("overwrite").parquet(path)


def seed_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Seeds of a text file's lines: trimmed, without blanks and # lines."""
    trimmed = F.regexp_replace(F.col(column), r"^[ \t\r\n]+|[ \t\r\n]+\z", "")
    return lines.select(trimmed.alias("url")).filter("url <> '' AND NOT startswith(url, '#')")


def seeds_from_text(spark: SparkSession, path: str) -> DataFrame:
    return seed_lines(spark.read.text(path))


def seeds_from_list(value: Column) -> Column:
    """A comma-separated list, trimmed."""
    return F.filter(F.transform(F.split(value, ","), lambda s: F.regexp_replace(s, r"^[ \t\r\n]+|[ \t\r\n]+\z", "")), lambda s: s != "")


def run_sql(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(sql)
