"""The streaming jobs: incremental indexing equals a full build; the seen set and politeness keep what they promise."""

import datetime

from pyspark.sql import functions as F

from lodeseek.operators import index as ix
from lodeseek.operators import ranking
from lodeseek.sources.store import IndexStore
from lodeseek.streaming import jobs

PAGE = "<html><head><title>{t}</title></head><body><h1>{h}</h1><h1>again</h1><p>{b}</p></body></html>"


def pages(spark, rows):
    return spark.createDataFrame([(i, f"http://h.test/{i}", PAGE.format(t=t, h=h, b=b), at) for i, t, h, b, at in rows], jobs.PAGES)


def tables(store):
    docs = sorted(tuple(r) for r in store.read("docs").select("doc_id", "title", "doc_length").collect())
    return docs, sorted((r["term"], r["doc_id"], r["field"], r["tf"], tuple(r["positions"])) for r in store.read("postings").collect()), sorted(tuple(r) for r in store.read("terms").collect())


def test_incremental_index_equals_full_build(spark, tmp_path):
    first = [(1, "one", "alpha", "running dogs", 1), (2, "two", "beta", "cats", 1), (3, "three", "gamma", "cats and dogs", 1)]
    second = [(2, "newest", "delta", "birds", 9), (2, "older", "delta", "fish", 5), (4, "four", "beta", "dogs", 2)]
    pages(spark, first).coalesce(1).write.parquet(str(tmp_path / "in"))
    for run in (second, []):
        query = jobs.index_stream(spark, str(tmp_path / "in"), str(tmp_path / "index"), str(tmp_path / "state"))
        query.awaitTermination(120)
        if run:
            pages(spark, run).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    whole = IndexStore(spark, str(tmp_path / "whole"))
    jobs.merge_batch(whole, pages(spark, [first[0], first[2], second[0], second[2]]))
    grown = IndexStore(spark, str(tmp_path / "index"))
    assert tables(grown) == tables(whole)
    assert {r["doc_id"]: r["title"] for r in grown.read("docs").collect()}[2] == "newest"
    assert [tuple(r) for r in grown.read("stats").select("doc_count", "term_count").collect()] == [(4, grown.read("terms").count())]
    # Two h1 calls: positions restart, and the length counts (call, term) pairs.
    h1 = {(r["term"], r["doc_id"]): list(r["positions"]) for r in grown.read("postings").filter(F.col("field") == ix.FIELDS["H1"]).collect()}
    assert h1[("again", 4)] == [0] and h1[("beta", 4)] == [0]


def test_segments_grow_and_merge(spark, tmp_path):
    """Any order of new, changed and empty pages gives the index of the last versions, in few segments; old versions are cleared."""
    store, last = IndexStore(spark, str(tmp_path / "index"), buckets=4), {}
    batches = [[(i, f"t{i}", f"word{i}", "common text", 1) for i in range(12)], [(3, "new", "head", "birds", 2)], [(20, "x", "y", "common", 2)], [(3, "newer", "head", "common fish", 3), (20, "x", "y", "gone", 4)], [(21, "q", "word1", "z", 5)]]
    for batch in batches:
        jobs.merge_batch(store, pages(spark, batch))
        last |= {row[0]: row for row in batch}
    empty = spark.createDataFrame([(40, None, None, 1)], jobs.PAGES)
    jobs.merge_batch(store, empty)
    whole = IndexStore(spark, str(tmp_path / "whole"))
    jobs.merge_batch(whole, pages(spark, list(last.values())).union(empty))
    assert tables(store) == tables(whole)
    assert [tuple(r) for r in store.read("stats").collect()] == [tuple(r) for r in whole.read("stats").collect()]
    assert 1 < len(store.segments()) <= 4
    assert {r["doc_id"] for r in store.term_postings(["common"]).collect()} == {*range(12), 3}
    store.vacuum(1)
    assert len(store.versions()) == 1 and tables(store) == tables(whole)
    none = IndexStore(spark, str(tmp_path / "none"))
    jobs.merge_batch(none, empty)
    assert none.read("postings").count() == 0 and none.read("docs").count() == 1


def test_index_round(spark, tmp_path):
    from lodeseek.sources.pages import SCHEMA

    urls = ["http://h.test/a", "http://www.example.com/b", "http://h.test/test-c", "http://h.test/lost", "http://h.test/late"]
    rows = [(u, "h.test", datetime.datetime(2024, 1, 1 + i), 200, None if "lost" in u else f"k{i}", 1, None, None, False) for i, u in enumerate(urls)]
    table, store = spark.createDataFrame(rows, SCHEMA), IndexStore(spark, str(tmp_path / "index"))
    blobs = spark.createDataFrame([(f"k{i}", bytearray(PAGE.format(t="t", h="h", b=f"body{i}").encode())) for i in (0, 1, 4)], "key string, data binary")
    table, counts = jobs.index_round(store, table, blobs, limit=4)
    assert tuple(counts.first()) == (1, 2, 1) and [r["url"] for r in store.read("docs").collect()] == urls[:1]
    assert [r["url"] for r in table.filter("NOT indexed").collect()] == urls[4:]
    table, counts = jobs.index_round(store, table, blobs)
    assert tuple(counts.first()) == (1, 0, 0) and store.read("docs").count() == 2 and table.filter("NOT indexed").isEmpty()
    assert tuple(jobs.index_round(store, table, blobs)[1].first()) == (0, 0, 0)


def test_seen_set_and_politeness(spark, tmp_path):
    rows = [("http://a.test/1", 1000), ("http://a.test/1#x", 1001), ("http://a.test/2", 1002), ("http://b.test/", 1003), ("bad", 1004)]
    frame = spark.createDataFrame(rows, "url string, at long").select("url", F.timestamp_millis("at").alias("ts"))
    frame.write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema("url string, ts timestamp").parquet(str(tmp_path / "in"))
    query = jobs.polite_stream(jobs.admitted_stream(arriving), 500).writeStream.format("memory").queryName("polite").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r["url"], r["fetch_at"]) for r in spark.table("polite").collect())
    assert [u for u, _ in got] == ["http://a.test/1", "http://a.test/2", "http://b.test/"]
    assert abs(got[0][1] - got[1][1]) >= 500


def test_formatted_page(spark):
    rows = [(1, "First", "http://h/1", "a\nb", 1600000000, 0.5, 2.0), (2, "", "http://h/2", "", 0, 0.5, 1.0)]
    frame = spark.createDataFrame(rows, "doc_id long, title string, url string, snippet string, published_at long, ai_score double, score double")
    assert ranking.formatted(frame) == "1. First\n   http://h/1\n   [Sep 13, 2020 · Pre-AI ✓]\n   a b\n\n2. (No title)\n   http://h/2\n   [Date: Unknown]  AI: 50%\n\n"
    assert ranking.formatted(frame.limit(0)) == "No results found.\n"
