"""Continuous jobs: the incremental indexer and the crawl frontier's seen set and politeness."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

import lodeseek.streaming
from lodeseek.functions.urls import domain_mt, url_normalize_mt
from lodeseek.operators.index import build_docs, index_stats, latest, parsed_documents, postings
from lodeseek.session import shared_path
from lodeseek.sources.pages import mark_indexed, unindexed
from lodeseek.sources.store import IndexStore

cloudpickle.register_pickle_by_value(lodeseek.streaming)

#: crawled_at, in seconds, tells versions of a page apart; sources may lack it.
PAGES = "page_id long, url string, html string, crawled_at long"
#: Urls that hold one of these are not indexed.
SKIPPED = ("test-", "example.com")
COLUMNS = {"TITLE": "title", "H1": "h1", "H2": "h2", "BODY": "body", "META_DESC": "description", "URL": "url"}


def index_tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """docs and postings of index input (doc_id, url, title, h1, h2, body, description, dates, era)."""
    return {"docs": build_docs(parsed, COLUMNS, "body"), "postings": postings(parsed, COLUMNS)}


def merge_batch(store: IndexStore, pages: DataFrame) -> None:
    """Indexes the pages' latest versions, by crawled_at, as a new segment; the rest of the index is not rewritten."""
    version = F.struct(F.coalesce("crawled_at", F.lit(0)), F.xxhash64("url", "html")) if "crawled_at" in pages.columns else F.xxhash64("url", "html")
    delta = index_tables(parsed_documents(latest(pages, "page_id", version)))
    store.append(delta | {"terms": lambda read: term_changes(store, read("docs"), read("postings"))}, index_stats)


def term_changes(store: IndexStore, docs: DataFrame, posting_rows: DataFrame) -> DataFrame:
    """(term, df): new postings count for their terms, those of replaced documents against them. Without replaced documents no old posting is read."""
    rows = posting_rows.filter("leads").select("term", F.lit(1).alias("n"))
    if store.current() is not None:
        replaced = store.read("docs").select("doc_id").join(docs.select("doc_id"), "doc_id", "left_semi")
        if not replaced.isEmpty():
            rows = rows.union(store.read("postings").filter("leads").join(docs.select("doc_id"), "doc_id", "left_semi").select("term", F.lit(-1)))
    return rows.groupBy("term").agg(F.sum("n").alias("df")).filter("df <> 0")


def index_round(store: IndexStore, table: DataFrame, blobs: DataFrame, limit: int = 100, skip: tuple[str, ...] = SKIPPED) -> tuple[DataFrame, DataFrame]:
    """One round over a page table: its oldest unindexed pages are indexed. (The table after it, one row of counts: indexed, skipped, failed).

    Pages whose url holds a text of skip are passed over; those without a blob (key, data) of their content_hash have failed. Both are
    marked as indexed too, so that no round meets them again. A document's id is the table's page_id or, without one, its url's hash.
    """
    spark = table.sparkSession
    named = table if "page_id" in table.columns else table.withColumn("page_id", F.xxhash64("url"))
    passed = functools.reduce(Column.__or__, [F.contains("url", F.lit(s)) for s in skip], F.lit(False))
    held = blobs.select(F.col("key").alias("content_hash"), F.col("data").cast("string").alias("html")).dropDuplicates(["content_hash"])
    # The round's rows are fixed by writing them: what is indexed, counted and marked is the same.
    path = shared_path(spark, "round")
    unindexed(named, limit).join(held, "content_hash", "left").select("page_id", "url", "html", F.unix_seconds("crawled_at").alias("crawled_at"), passed.alias("skipped")).write.parquet(path)
    batch = spark.read.parquet(path)
    good = batch.filter("NOT skipped AND html IS NOT NULL")
    if not good.isEmpty():
        merge_batch(store, good.drop("skipped"))
    counts = batch.agg(F.count_if(~F.col("skipped") & F.col("html").isNotNull()).alias("indexed"), F.count_if("skipped").alias("skipped"), F.count_if(~F.col("skipped") & F.col("html").isNull()).alias("failed"))
    return mark_indexed(table, batch), counts


def index_stream(spark: SparkSession, source: str, root: str, checkpoint: str, files: int = 100) -> StreamingQuery:
    """Indexes what has arrived under source and ends. A batch that is run again replaces the same documents by the same."""
    arriving = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files).parquet(source)
    store = IndexStore(spark, root)
    return arriving.writeStream.foreachBatch(lambda batch, _: merge_batch(store, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def admitted_stream(arrivals: DataFrame, url: str = "url") -> DataFrame:
    """Unseen URLs, normalised. The seen set is the stream's state and is never forgotten, as in the frontier."""
    rows = arrivals.withColumn("url", url_normalize_mt(F.col(url))).filter("url <> ''").withColumn("domain", domain_mt(F.col("url")))
    return rows.filter("domain <> ''").dropDuplicates(["url"])


def polite_stream(admitted: DataFrame, delay_ms: int = 1000, ts: str = "ts") -> DataFrame:
    """(url, domain, fetch_at ms): each domain's entries at least delay_ms apart, in order of arrival. State: the domain's next free time."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        free = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(["at", "url"], kind="stable")
        out = []
        for at in rows["at"]:
            free = max(free, int(at))
            out.append(free)
            free += delay_ms
        state.update((free,))
        yield pd.DataFrame({"url": rows["url"].to_numpy(), "domain": key[0], "fetch_at": out})

    rows = admitted.select("url", "domain", F.unix_millis(F.col(ts).cast("timestamp")).alias("at"))
    return rows.groupBy("domain").applyInPandasWithState(step, "url string, domain string, fetch_at long", "free long", "append", GroupStateTimeout.NoTimeout)
