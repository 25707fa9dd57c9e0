"""The engine's own operators: exact values, store round trips, and registered queries against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lodeseek.functions import aiscore, dates, text, urls
from lodeseek.operators import ranking
from lodeseek.plans.oracles import ORACLES
from lodeseek.plans.queries import QUERIES
from lodeseek.plans.query import parse_query
from lodeseek.sources.cache import Cache
from lodeseek.sources.store import IndexStore, compress, decompress

FOLDER = "/root/testdata/sf0.001"
STEMS = "ponies>poni agreed>agre playing>plai relational>relat organization>organ triplicate>triplic easily>easili yes>ye sky>sky hopping>hop filing>file controll>control adoption>adopt was>wa of>of".split()


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, v {kind}")
    return [r["o"] for r in rows.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_stems(spark):
    words, want = zip(*(p.split(">") for p in STEMS))
    assert column(spark, words, text.stem) == list(want) == [text.stem_py(w) for w in words]


def test_text(spark):
    assert column(spark, ["Café e-mail 12x", ""], text.normalize) == ["cafemail12x", ""]
    assert column(spark, ["Café e-mail 12x"], text.tokenize_plain) == [["caf", "e", "mail", "12x"]]
    short, long = "a" * 200, "b" * 160 + ". " + "c" * 100
    assert column(spark, [short, long, "d" * 300], text.snippet) == [short, "b" * 160 + "....", "d" * 150 + "..."]
    rows = text.token_rows(spark.createDataFrame([(1, "é The cats, CATS")], "k long, t string"), "k", "t").orderBy("position").collect()
    assert [(r["position"], r["original"], r["char_offset"], r["token"]) for r in rows] == [(0, "cats", 7, "cats"), (1, "CATS", 13, "cats")]


def test_dates(spark):
    noon = 1609502400 + 14 * 86400
    assert column(spark, ["on 2021-01-15", "Jan 15, 2021", "http://h/2021/1/15/x", "none", "2021-13-01"], dates.parse_date) == [noon, noon, noon, 0, 0]
    assert column(spark, [0, 1669766399, 1669766400], dates.era_string, "long") == ["unknown", "pre-ai", "post-ai"]
    assert column(spark, ["Published on January 15, 2021", "(c) 2015"], dates.content_date) == [noon, 1435752000]


def test_urls(spark):
    given = ["HTTP://Example.COM:80/%7Ea/%2F?x=1#f", "https://h.test:443", "ftp://h/", "http://h:8080/a/"]
    assert column(spark, given, urls.url_normalize) == ["http://example.com/~a/%2F?x=1", "https://h.test/", "", "http://h:8080/a/"]
    assert column(spark, given, urls.url_normalize_mt)[3] == "http://h:8080/a"
    asked = ["http://h/a.PDF", "http://h/?page=2", "http://h/?a=1&b=2&c=3&d=4", "http://h/login", "mailto:x", "http://h/ok"]
    assert column(spark, asked, urls.rejection_reason) == ["bad extension", "pagination", "too many query params", "low-value pattern", "not HTTP(S)", "unknown"]
    assert column(spark, asked, urls.is_acceptable) == [False] * 5 + [True]


def test_ai_score(spark):
    plain = "The dog ran home. It was late, and the rain had not stopped since noon when we left. Cold. My brother made soup for all of us that night! Who knew? Nobody asked about the broken gate or the two missing hens."
    said = "It is important to note that this comprehensive landscape is crucial. Furthermore, we delve into robust paradigms. " * 6
    low, high, short = column(spark, [plain, said, "too short"], aiscore.ai_score)
    assert low < 0.4 < 0.5 < high and short == 0.0


def test_query_parser():
    q = parse_query('bitcoin "machine learning" -scam era:pre-ai ai:<0.3 site:Example.com the a:b')
    assert (q.terms, q.phrases, q.excluded, q.era, q.max_ai, q.site) == (["bitcoin", "ab"], ["machine learning"], ["scam"], "PRE_AI", 0.3, "example.com")
    assert parse_query("era:post-ai").terms == ["erapostai"] and parse_query("-scam ai:0.5").empty()


MOCK = [("bitcoin", 1, [0, 15, 45]), ("price", 1, [1, 46]), ("bitcoin", 2, [0, 10, 20, 30, 40]), ("trade", 2, [1, 11, 21]), ("ethereum", 3, [0, 12]), ("price", 3, [1, 13, 25]), ("bitcoin", 4, [0, 8]), ("scam", 4, [1, 5, 9])]
DOCS = [(1, 150, 0.10, "pre-ai", "example.com"), (2, 200, 0.85, "post-ai", "aisite.com"), (3, 180, 0.40, "unknown", "crypto.example.com"), (4, 100, 0.05, "pre-ai", "security.com")]


@pytest.mark.parametrize("asked,want", [("bitcoin price", {1, 2, 3, 4}), ("bitcoin era:pre-ai", {1, 4}), ("bitcoin ai:<0.3", {1, 4}), ("price site:example.com", {1, 3}), ("bitcoin -scam", {1, 2}), ('"bitcoin price"', {1}), ("bitcoin era:pre-ai ai:<0.5 -scam", {1})])
def test_ranker(spark, asked, want):
    docs = spark.createDataFrame(DOCS, "doc_id long, doc_length int, ai_score double, era string, domain string")
    postings = spark.createDataFrame([(t, d, 0, len(p), p) for t, d, p in MOCK], "term string, doc_id long, field int, tf int, positions array<int>")
    terms = postings.groupBy("term").agg(F.count_distinct("doc_id").alias("df"))
    stats = spark.createDataFrame([(4, 157.5)], "doc_count long, avgdl double")
    got = ranking.top(ranking.ranked(parse_query(asked), docs, postings, terms, stats)).collect()
    assert {r["doc_id"] for r in got} == want and [r["score"] for r in got] == sorted((r["score"] for r in got), reverse=True)
    assert all(0 < r["score"] <= r["relevance"] for r in got)


def test_store(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    rows = spark.createDataFrame([(t, d, 0, len(p), p) for t, d, p in MOCK], "term string, doc_id long, field int, tf int, positions array<int>")
    store.write({"postings": rows.limit(1)})
    assert store.current() is None  # not published
    store.commit({"postings": rows, "terms": lambda read: read("postings").groupBy("term").agg(F.count("*").alias("df"))})
    assert {(r["term"], r["doc_id"]) for r in store.term_postings(["price", "scam"]).collect()} == {("price", 1), ("price", 3), ("scam", 4)}
    assert store.read("terms").count() == 5 and store.size() > 0
    assert decompress(compress(b"x" * 9000)) == b"x" * 9000 and decompress(b"plain") == b"plain" and compress(b"") == b""


def test_cache():
    now = [0.0]
    cache = Cache(lambda: now[0])
    cache.set("a", 1, 10)
    assert (cache.ttl("a"), cache.ttl("b"), cache.incr("n"), cache.mget(["a", "b"]), cache.get_or_set("c", None, lambda: 7)) == (10, -2, 1, [1, None], 7)
    now[0] = 11
    assert not cache.exists("a") and cache.ttl("c") == -1 and cache.keys("*") == ["c", "n"]


@pytest.mark.parametrize("name", ["tokenize_plain", "tokenize_positions", "snippet", "bm25_topk", "exclusion", "text", "links", "meta_tags", "url_filter", "era_string", "content_date", "page_upsert", "robots_allowed", "frontier_order"])
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "orders", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    frame = QUERIES[name](spark, FOLDER)
    found = db.execute(ORACLES[name])
    at = {d[0]: i for i, d in enumerate(found.description)}
    assert set(at) == set(frame.columns)
    said = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    want = sorted(tuple(said(r[at[c]]) for c in frame.columns) for r in found.fetchall())
    assert sorted(tuple(map(said, r)) for r in frame.collect()) == want and want
