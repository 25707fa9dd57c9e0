"""Registered queries over the reference's operators: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.functions import aiscore as ai
from lodeseek.functions import dates, urls
from lodeseek.functions import text as tx
from lodeseek.operators import frontier as fr
from lodeseek.operators import html as hp
from lodeseek.operators import index as ix
from lodeseek.operators import ranking as rk
from lodeseek.operators import robots as rb
from lodeseek.plans import fixtures as fx
from lodeseek.plans.query import parse_query
from lodeseek.session import shared_path, spread
from lodeseek.sources import pages as pg
from lodeseek.sources import store as st

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
FLAGSHIP = "thtion attion thing"


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def docs_of(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def pages_of(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "pages").select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))


def joined(array: Column) -> Column:
    return F.array_join(array, ",")


def body_postings(spark: SparkSession, folder: str) -> DataFrame:
    return ix.postings(spread(docs_of(spark, folder)), {"BODY": "text"})


def body_terms(spark: SparkSession, folder: str) -> DataFrame:
    return ix.counted_terms(spread(docs_of(spark, folder)), {"BODY": "text"})


_STORES: dict[tuple[str, str, str], st.IndexStore] = {}


def stored(spark: SparkSession, folder: str, kind: str, source: DataFrame, columns: dict[str, str], body: str) -> st.IndexStore:
    """The index of a folder's documents or pages, built and published once a session; searches read it."""
    key = (spark.sparkContext.applicationId, folder, kind)
    if key not in _STORES or _STORES[key].current() is None:
        store = st.IndexStore(spark, shared_path(spark, f"index-{kind}"))
        store.commit({
            "postings": ix.postings(source, columns),
            "docs": ix.build_docs(source, columns, body),
            "terms": lambda read: ix.terms(read("postings")),
            "stats": lambda read: ix.index_stats(read("docs"), read("terms")),
        })
        _STORES[key] = store
    return _STORES[key]


def body_store(spark: SparkSession, folder: str) -> st.IndexStore:
    return stored(spark, folder, "body", spread(docs_of(spark, folder)), {"BODY": "text"}, "text")


def page_store(spark: SparkSession, folder: str) -> st.IndexStore:
    parsed = ix.parsed_documents(spread(pages_of(spark, folder)))
    return stored(spark, folder, "pages", parsed, {"TITLE": "title", "BODY": "body", "META_DESC": "description", "URL": "url"}, "body")


def tables(store: st.IndexStore, words: list[str] | None = None) -> tuple[DataFrame, ...]:
    """docs, postings (of words alone, if given), terms, statistics."""
    docs, terms = store.read("docs"), store.read("terms")
    rows = store.read("postings") if words is None else store.term_postings(words)
    return docs, rows, terms, store.read("stats")


def found_in(store: st.IndexStore, text: str, params: rk.Params = rk.Params()) -> DataFrame:
    parsed = parse_query(text)
    return rk.ranked(parsed, *tables(store, [*parsed.scoring_terms(), *parsed.excluded]), params)


def search(spark: SparkSession, folder: str, text: str, params: rk.Params = rk.Params()) -> DataFrame:
    return found_in(body_store(spark, folder), text, params)


def scored(matches: DataFrame) -> DataFrame:
    return matches.select("doc_id", F.round("relevance", 6).alias("relevance"), F.round("score", 6).alias("score"))


# Text


@query
def normalize(spark, folder):
    return docs_of(spark, folder).select("doc_id", tx.normalize(F.col("text")).alias("normalized"), tx.to_lower(F.col("text")).alias("lowered"))


@query
def tokenize_plain(spark, folder):
    return docs_of(spark, folder).select("doc_id", joined(tx.tokenize_plain(F.col("text"))).alias("tokens"))


@query
def tokenize_positions(spark, folder):
    return tx.token_rows(spread(docs_of(spark, folder)), "doc_id", "text").select("doc_id", F.col("position").cast("long").alias("position"), "original", F.col("char_offset").cast("long").alias("char_offset"), "token")


@query
def tokenize_stemmed(spark, folder):
    """Documents' tokens as the tokenizer gives them, stemmed, counted with their last positions."""
    return body_postings(spark, folder).groupBy("term").agg(F.sum("tf").alias("n"), F.max(F.element_at("positions", -1)).cast("long").alias("last"))


@query
def stop_words(spark, folder):
    words = docs_of(spark, folder).select(F.explode(tx.tokenize_plain(F.col("text"))).alias("word"))
    return words.filter(tx.is_stop_word(F.col("word"))).groupBy("word").agg(F.count("*").alias("n"))


@query
def stem_vocab(spark, folder):
    words = spread(docs_of(spark, folder)).select(F.explode(F.array_distinct(tx.tokenize_plain(F.col("text")))).alias("token")).distinct()
    return tx.stemmed(words.filter(tx.is_kept(F.col("token"))))


@query
def snippet(spark, folder):
    return docs_of(spark, folder).select("doc_id", tx.snippet(F.col("text")).alias("snippet"))


@query
def trim_whitespace(spark, folder):
    return docs_of(spark, folder).select("doc_id", tx.trim_whitespace(F.concat(F.lit(" \t\n"), F.col("text"), F.lit("\f\n "))).alias("trimmed"))


@query
def eras(spark, folder):
    names = ["pre-ai", "PreAI", "pre_ai", "human", "trans", "Transition", "ai-era", "aiera", "AI", "post-ai", "", "x"]
    rows = fx.frame(spark, [(n,) for n in names], "era string")
    return rows.select("era", tx.parse_era(F.col("era")).alias("parsed"), tx.era_to_string(tx.parse_era(F.col("era"))).alias("display"), tx.string_to_era(F.col("era")).alias("stored"))


# Index


@query
def postings_body(spark, folder):
    rows = body_postings(spark, folder)
    return rows.select("term", "doc_id", F.col("tf").cast("long").alias("tf"), joined(F.col("positions")).alias("positions"))


@query
def token_df(spark, folder):
    return body_terms(spark, folder)


@query
def doc_length(spark, folder):
    docs = spread(docs_of(spark, folder))
    return docs.select("doc_id", ix.doc_length(docs, {"BODY": "text"}).cast("long").alias("doc_length")).filter("doc_length > 0")


def _average(spark, folder, mode):
    return ix.counted_stats(spread(docs_of(spark, folder)), {"BODY": "text"}, mode).select("doc_count", "term_count", F.round("avgdl", 6).alias("avgdl"))


@query
def avgdl_sample100(spark, folder):
    return _average(spark, folder, "sample100")


@query
def avgdl_exact(spark, folder):
    return _average(spark, folder, "exact")


@query
def idf(spark, folder):
    n = docs_of(spark, folder).agg(F.count("*").alias("n")).withColumn("_one", F.lit(1))
    rows = body_terms(spark, folder).withColumn("_one", F.lit(1)).join(F.broadcast(n), "_one")
    return rows.select("term", F.round(rk.idf(F.col("df"), F.col("n")), 6).alias("idf"))


@query
def remove_document(spark, folder):
    gone = docs_of(spark, folder).filter("doc_id % 3 = 0").select("doc_id")
    return ix.terms(ix.remove_documents(body_postings(spark, folder), gone))


@query
def merge_index(spark, folder):
    """Documents with even ids re-indexed in upper case with a word appended; the rest stay."""
    base = body_postings(spark, folder)
    new = docs_of(spark, folder).filter("doc_id % 2 = 0").withColumn("text", F.concat(F.upper(F.translate("text", "äöüéèêçàñóíáúß", "--------------")), F.lit(" appended")))
    return ix.terms(ix.merge_postings(base, ix.postings(new, {"BODY": "text"})))


@query
def multi_field_index(spark, folder):
    parsed = ix.parsed_documents(spread(pages_of(spark, folder)))
    rows = ix.postings(parsed, {"TITLE": "title", "BODY": "body", "META_DESC": "description", "URL": "url"})
    return rows.groupBy("term", F.col("field").cast("long").alias("field")).agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query
def is_indexed(spark, folder):
    docs = body_store(spark, folder).read("docs")
    return docs.filter("doc_id IN (0, 5, 77)").select("doc_id", F.col("doc_length").cast("long").alias("doc_length"), "era", "domain")


# Search


@query
def bm25_or(spark, folder):
    return scored(search(spark, folder, FLAGSHIP))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    store = body_store(spark, folder)
    winners = rk.top(found_in(store, FLAGSHIP), 10)
    return rk.with_display(winners, store.read("docs")).select("doc_id", F.round("score", 6).alias("score"), "snippet")


QUERIES["bm25_topk"] = flagship


@query
def repeated_terms(spark, folder):
    return scored(search(spark, folder, 'thing thing "attion" the'))


@query
def exclusion(spark, folder):
    return scored(search(spark, folder, "attion -thing"))


@query
def phrase_pairwise(spark, folder):
    return scored(search(spark, folder, '"ci nci n" "ci nci" de'))


@query
def phrase_contiguous(spark, folder):
    return scored(search(spark, folder, '"ci nci n"', rk.Params(phrase_mode="contiguous")))


@query
def ai_filter_max(spark, folder):
    return scored(search(spark, folder, "attion ai:<0.1"))


@query
def ai_filter_min(spark, folder):
    return scored(search(spark, folder, "attion thing ai:>0.1"))


@query
def ai_penalty(spark, folder):
    rows = docs_of(spark, folder).select("doc_id", ai.ai_score(F.col("text")).alias("a"))
    return rows.select("doc_id", F.round(F.col("a") * 0.2, 6).alias("penalty"), F.round(10 * (1 - F.col("a") * 0.2), 6).alias("final"))


@query
def pagination(spark, folder):
    return scored(rk.page_of(search(spark, folder, FLAGSHIP), 2, 5))


@query
def result_totals(spark, folder):
    return rk.result_totals(search(spark, folder, FLAGSHIP), 7)


@query
def batch_search(spark, folder):
    """Every benchmark item as a query over documents, in one job."""
    words = ix.postings(read(spark, folder, "benchmark"), {"BODY": "text"}, key="item_id")
    asked = words.select(F.col("doc_id").alias("query_id"), "term", F.col("tf").cast("long").alias("times"))
    found = rk.batch_top(asked, *tables(body_store(spark, folder)), k=3)
    return found.select("query_id", "doc_id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


@query
def parsed_queries(spark, folder):
    texts = ['bitcoin price', 'bitcoin era:pre-ai ai:<0.3', 'price site:Example.com -scam', '"machine learning" the basics', 'a:b -x: ai:2 e-mail', '', 'open "quote running', 'era:post-ai ai:0.5 ai:>0.2']
    rows = [(q, " ".join(p.terms), "|".join(p.phrases), " ".join(p.excluded), p.era, p.max_ai, p.min_ai, p.site) for q in texts for p in [parse_query(q)]]
    return fx.frame(spark, rows, "query string, terms string, phrases string, excluded string, era string, max_ai double, min_ai double, site string")


@query
def site_filter(spark, folder):
    return scored(found_in(page_store(spark, folder), "thing the onth site:example.com"))


@query
def era_filter(spark, folder):
    docs, *rest = tables(body_store(spark, folder), ["attion"])
    docs = docs.withColumn("era", F.when(F.col("doc_id") % 3 == 0, "pre-ai").when(F.col("doc_id") % 3 == 1, "post-ai").otherwise("unknown"))
    return scored(rk.ranked(parse_query("attion era:ai-era"), docs, *rest))


@query
def format_results(spark, folder):
    pages = pages_of(spark, folder).select("page_id", "url", hp.html_title(F.col("html")).alias("title"), tx.snippet(hp.html_text(F.col("html"))).alias("snippet"))
    published, score = (F.col("page_id") % 4) * 556590000, (F.col("page_id") % 7) / 20.0
    return pages.select("page_id", rk.shown_title(F.col("title")).alias("title"), rk.shown_url(F.col("url")).alias("url"), F.concat(rk.shown_date(published), rk.shown_ai(published, score)).alias("line"), rk.shown_snippet(F.col("snippet")).alias("snippet"))


# AI score: texts get blank lines and starters where the id is divisible by 3, phrases where by 5


def rewritten(spark: SparkSession, folder: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Furthermore, "), F.replace("text", F.lit("\n"), F.lit("\n \nIndeed, ")))).otherwise(F.col("text"))
    text = F.when(F.col("doc_id") % 5 == 0, F.replace(text, F.lit(" the "), F.lit(" delves into a robust tapestry; in conclusion the "))).otherwise(text)
    return docs_of(spark, folder).select("doc_id", text.alias("text"))


def _scores(spark, folder, f, name):
    return spread(rewritten(spark, folder)).select("doc_id", F.round(f(F.col("text")), 6).alias(name))


@query
def ai_vocab(spark, folder):
    return _scores(spark, folder, ai.vocabulary_score, "vocabulary")


@query
def ai_uniform(spark, folder):
    return _scores(spark, folder, ai.uniformity_score, "uniformity")


@query
def ai_repeat(spark, folder):
    return _scores(spark, folder, ai.repetition_score, "repetition")


@query
def ai_score(spark, folder):
    return _scores(spark, folder, ai.ai_score, "ai_score")


@query
def sentences(spark, folder):
    return docs_of(spark, folder).select("doc_id", F.size(ai.sentences(F.col("text"))).cast("long").alias("n"), F.size(ai.paragraphs(F.col("text"))).cast("long").alias("paragraphs"))


# HTML


@query
def title(spark, folder):
    return pages_of(spark, folder).select("page_id", hp.html_title(F.col("html")).alias("title"))


@query
def text(spark, folder):
    body = hp.html_text(F.col("html"))
    return pages_of(spark, folder).select("page_id", body.alias("text"), hp.word_count(body).cast("long").alias("word_count"))


@query
def links(spark, folder):
    found = pages_of(spark, folder).select("page_id", F.posexplode(hp.html_links(F.col("html"), F.col("url"))).alias("pos", "l"))
    return found.select("page_id", F.col("pos").cast("long").alias("pos"), "l.url", "l.anchor_text")


@query
def hrefs(spark, folder):
    found = pages_of(spark, folder).select("page_id", F.posexplode(hp.html_hrefs(F.col("html"), F.col("url"))).alias("pos", "url"))
    return found.select("page_id", F.col("pos").cast("long").alias("pos"), "url")


@query
def meta_tags(spark, folder):
    """Pages get description and date tags from their ids; the last of a key wins."""
    tag = F.concat(F.lit('<head><meta name="Description" content="first"><meta content=\'About &amp; '), F.col("page_id").cast("string"), F.lit("' name='description'><meta property=\"article:published_time\" content=\"2021-05-0"), (F.col("page_id") % 9 + 1).cast("string"), F.lit('T00:00:00Z">'))
    pages = pages_of(spark, folder).withColumn("html", F.replace("html", F.lit("<head>"), tag))
    meta = hp.html_meta(F.col("html"))
    return pages.select("page_id", hp.meta_first(meta, "description").alias("description"), hp.meta_first(meta, "article:published_time", "date", "pubdate").alias("published"), F.size(meta).cast("long").alias("n"))


@query
def html_tree(spark, folder):
    """The tree walk, for malformed markup: same text and link counts as the patterns on regular pages."""
    return hp.parse_pages(pages_of(spark, folder), mode="tree").select("page_id", "title", F.col("text_content").alias("text"), F.col("link_count").cast("long").alias("link_count"))


def _lenient(spark: SparkSession, folder: str) -> DataFrame:
    """Every page id in a page with entities, unquoted attributes, an unclosed anchor, headings and a title outside of the head."""
    i = F.col("page_id").cast("string")
    html = F.concat(
        F.lit("<html><head><title>T"), i, F.lit(" &mdash; caf&eacute; &#8217;&#x41;&copy &nosuch;</title></head><body><svg><title>icon</title></svg><h1>Head "), i, F.lit("</h1><p>one &amp;amp; two</p><h2>Sub <b>"), i,
        F.lit("</b></h2><h1 class=x>More</h1><a data-href='/no' href=/x/"), i, F.lit(">first <a class=b href='/y?a=1&amp;b=2'>second</a> <a href=#top>none</a></body></html>"))
    return pages_of(spark, folder).select("page_id", F.lit("http://h.test/d/").alias("url"), html.alias("html"))


@query
def html_lenient(spark, folder):
    parsed = hp.parse_pages(_lenient(spark, folder))
    return parsed.select("page_id", "title", "text_content", joined(F.col("h1")).alias("h1"), joined(F.col("h2")).alias("h2"), joined(F.transform("links", lambda x: F.concat(x["url"], F.lit(" "), x["anchor_text"]))).alias("links"))


@query
def heading_postings(spark, folder):
    """Headings as fields of several calls: term frequencies add up, positions restart, lengths count (call, term) pairs."""
    columns = {"H1": "h1", "H2": "h2"}
    parsed = ix.parsed_documents(_lenient(spark, folder))
    lengths = parsed.select("doc_id", ix.doc_length(parsed, columns).alias("doc_length"))
    rows = ix.postings(parsed, columns).filter("term IN ('head', 'more', 'sub')").join(lengths, "doc_id")
    return rows.select("doc_id", "term", F.col("field").cast("long").alias("field"), F.col("tf").cast("long").alias("tf"), joined(F.col("positions")).alias("positions"), F.col("doc_length").cast("long").alias("doc_length"))


# URLs


@query
def url_parse(spark, folder):
    part = urls.url_parse(F.col("url"))
    rows = pages_of(spark, folder).select("page_id", "url").unionByName(fx.frame(spark, fx.ENCODED, "page_id long, url string").withColumn("page_id", -F.col("page_id")))
    return rows.select("page_id", part["scheme"].alias("scheme"), part["host"].alias("host"), part["port"].cast("long").alias("port"), part["path"].alias("path"), part["query"].alias("query"))


@query
def url_normalize(spark, folder):
    return pages_of(spark, folder).select("page_id", urls.url_normalize(F.col("url")).alias("normalized"))


@query
def percent_decode(spark, folder):
    return fx.frame(spark, fx.ENCODED, "id long, url string").select("id", urls.url_normalize(F.col("url")).alias("normalized"))


@query
def url_normalize_mt(spark, folder):
    rows = pages_of(spark, folder).select("page_id", "url").unionByName(fx.frame(spark, fx.ENCODED, "page_id long, url string").withColumn("page_id", -F.col("page_id")))
    return rows.select("page_id", urls.url_normalize_mt(F.col("url")).alias("normalized"))


@query
def domain_variants(spark, folder):
    rows = pages_of(spark, folder).select("page_id", "url").unionByName(fx.frame(spark, fx.ENCODED, "page_id long, url string").withColumn("page_id", -F.col("page_id")))
    u = F.col("url")
    return rows.select("page_id", urls.url_domain(u).alias("frontier"), urls.domain_mt(u).alias("mt"), urls.domain_stored(u).alias("stored"), urls.domain_robots(u).alias("robots"))


@query
def link_resolve(spark, folder):
    forms = ["http://x.test/a", "//cdn.test/b", "/c", "d/e", "../f", "?g=1", ""]
    pages = pages_of(spark, folder).select("page_id", "url", F.explode(F.array(*map(F.lit, forms))).alias("link"))
    return pages.select("page_id", "link", urls.link_resolve(F.col("link"), F.col("url")).alias("resolved"))


@query
def url_filter(spark, folder):
    return _filter_urls(spark, folder).select("id", urls.is_acceptable(F.col("url")).alias("acceptable"), urls.rejection_reason(F.col("url")).alias("reason"), urls.query_params(F.col("url")).cast("long").alias("params"), urls.is_test_url(F.col("url")).alias("test_url"))


def _filter_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Page URLs, plain and with suffixes that some rules reject."""
    endings = ["", ".PDF", "/pages/3", "?a=1&b=2&c=3&d=4", "/Login", "?x=1&offset=2", "/" + "z" * 240]
    rows = pages_of(spark, folder).select("page_id", "url", F.posexplode(F.array(*map(F.lit, endings))).alias("k", "end"))
    return rows.select((F.col("page_id") * 10 + F.col("k")).alias("id"), F.concat("url", "end").alias("url"))


# Dates: order dates 25 years later straddle the cutoff


def dated(spark: SparkSession, folder: str) -> DataFrame:
    day = F.add_months(F.col("o_orderdate").cast("date"), 300)
    return spread(read(spark, folder, "orders").select("o_orderkey", day.alias("day")))


@query
def make_timestamp(spark, folder):
    rows = read(spark, folder, "orders").select("o_orderkey", (F.col("o_orderkey") % 200 + 1940).cast("int").alias("y"), (F.col("o_orderkey") % 14).cast("int").alias("m"), (F.col("o_orderkey") % 33).cast("int").alias("d"))
    return rows.select("o_orderkey", dates.make_timestamp(F.col("y"), F.col("m"), F.col("d")).alias("t"))


@query
def parse_dates(spark, folder):
    rows = dated(spark, folder)
    iso, said = F.date_format("day", "yyyy-MM-dd"), F.date_format("day", "MMMM d, yyyy")
    path = F.concat(F.lit("http://h.test/"), F.date_format("day", "yyyy/M/d"), F.lit("/x"))
    return rows.select(
        "o_orderkey", dates.parse_iso(F.concat(F.lit("on "), iso, F.lit("T10:00"))).alias("iso"), dates.parse_text_date(F.concat(F.lit("on "), said)).alias("said"), dates.url_date(path).alias("path"),
        dates.parse_date(F.when(F.col("o_orderkey") % 2 == 0, said).otherwise(path)).alias("any"))


@query
def era_string(spark, folder):
    t = F.unix_date("day").cast("long") * 86400
    rows = dated(spark, folder).select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, 0).otherwise(t).alias("t"))
    return rows.select("o_orderkey", dates.era_string(F.col("t")).alias("era"), dates.format_with_era(F.col("t")).alias("shown"), dates.is_pre_ai(F.col("t")).alias("pre"), dates.is_post_ai(F.col("t")).alias("post"))


@query
def content_date(spark, folder):
    return fx.frame(spark, fx.CONTENT, "id long, text string").select("id", dates.content_date(F.col("text")).alias("t"))


@query
def best_date(spark, folder):
    rows = dated(spark, folder)
    k = F.col("o_orderkey") % 4
    iso = F.date_format("day", "yyyy-MM-dd")
    meta, url = F.when(k == 0, iso).otherwise(""), F.when(k == 1, F.concat(F.lit("http://h.test/"), F.date_format("day", "yyyy/MM"), F.lit("/p"))).otherwise("http://h.test/p")
    body, modified = F.when(k == 2, F.concat(F.lit("Published "), iso)).otherwise("no date"), F.when(k == 3, iso).otherwise("")
    published, changed, era = dates.best_dates(meta, modified, url, body)
    return rows.select("o_orderkey", published.alias("published"), changed.alias("modified"), era.alias("era"))


# Page table


def crawled(spark: SparkSession, folder: str) -> DataFrame:
    """Page rows: every fifth failed, every third indexed, every seventh not crawled."""
    i = F.col("page_id")
    return pages_of(spark, folder).groupBy("url").agg(F.max("page_id").alias("page_id"), F.max_by("html", "page_id").alias("html")).select(
        "url", urls.domain_stored(F.col("url")).alias("domain"), F.when(i % 7 != 0, F.timestamp_seconds(F.lit(1700000000) + (i * 7919) % 1000)).alias("crawled_at"), F.when(i % 5 == 0, 404).otherwise(200).alias("status_code"),
        pg.content_hash(F.col("html")).alias("content_hash"), F.octet_length("html").cast("long").alias("content_size"), F.lit(None).cast("double").alias("ai_score"), F.lit(None).cast("string").alias("era"), (i % 3 == 0).alias("indexed"))


def shown_pages(rows: DataFrame) -> DataFrame:
    return rows.select("url", "domain", F.unix_seconds("crawled_at").alias("crawled_at"), F.col("status_code").cast("long").alias("status_code"), "content_hash", "content_size", "ai_score", "era", "indexed")


@query
def content_hash(spark, folder):
    return pages_of(spark, folder).select("page_id", pg.content_hash(F.col("html")).alias("content_hash"), pg.url_key(F.col("url")).alias("key"))


@query
def page_upsert(spark, folder):
    old = crawled(spark, folder)
    host = F.length("url") % 4
    batch = old.filter(host < 2).select(F.when(host == 0, F.col("url")).otherwise(F.concat("url", F.lit("/new"))).alias("url"), "domain", F.lit(None).cast("timestamp").alias("crawled_at"), F.lit(301).alias("status_code"), F.lit("h").alias("content_hash"), F.lit(7).cast("long").alias("content_size"), F.when(F.col("indexed"), 0.5).alias("ai_score"), F.lit(None).cast("string").alias("era"), F.lit(None).cast("boolean").alias("indexed"))
    return shown_pages(pg.upsert_pages(old, batch, F.timestamp_seconds(F.lit(1800000000))))


@query
def mark_crawled(spark, folder):
    old = crawled(spark, folder)
    got = old.filter("NOT indexed").select(F.when(F.length("url") % 2 == 0, F.col("url")).otherwise(F.concat("url", F.lit("/new"))).alias("url"), F.lit(200).alias("status_code"), F.lit("n").alias("content_hash"), F.lit(9).cast("long").alias("content_size"))
    return shown_pages(pg.mark_crawled(old, got, F.timestamp_seconds(F.lit(1800000000))))


@query
def unindexed_batch(spark, folder):
    return shown_pages(pg.unindexed(crawled(spark, folder), 20))


@query
def mark_indexed(spark, folder):
    rows = crawled(spark, folder)
    return pg.page_counts(pg.mark_indexed(rows, pg.unindexed(rows, 20)))


@query
def page_counts(spark, folder):
    return pg.page_counts(crawled(spark, folder))


@query
def get_page(spark, folder):
    return shown_pages(pg.get_page(crawled(spark, folder), "https://thther.example.org/en/685"))


@query
def key_values(spark, folder):
    table = read(spark, folder, "customer").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_name").alias("value"))
    table = st.remove(st.put(table, fx.frame(spark, [("c:10", "new"), ("d:1", "other")], "key string, value string")), fx.frame(spark, [("c:11",)], "key string"))
    return st.iterate_prefix(table, "c:1", 50)


@query
def range_size(spark, folder):
    rows = read(spark, folder, "customer").select(F.concat(F.lit("c:"), F.col("c_custkey")).alias("key"), F.col("c_name").alias("value"))
    return st.range_size(rows, "c:2", "c:5")


@query
def count_prefix(spark, folder):
    table = read(spark, folder, "customer").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("key"))
    return st.count_prefix(table, "c:1")


@query
def seeds(spark, folder):
    lines = pg.seed_lines(fx.frame(spark, fx.SEEDS, "n long, value string"))
    rows = lines.withColumn("priority", F.lit(0)).withColumn("seq", F.lit(0))
    return fr.admitted(rows).select("url", "domain")


# Robots and frontier


@query
def robots_rules(spark, folder):
    return rb.robots_rules(fx.frame(spark, fx.ROBOTS, "domain string, content string")).select("domain", "agent", F.col("seq").cast("long").alias("seq"), "allow", "path")


@query
def robots_agents(spark, folder):
    return rb.robots_agents(fx.frame(spark, fx.ROBOTS, "domain string, content string")).select("domain", "agent", F.col("crawl_delay").cast("long").alias("crawl_delay"))


@query
def robots_allowed(spark, folder):
    urls_, files = fx.frame(spark, fx.ROBOTS_URLS, "id long, domain string, url string"), fx.frame(spark, fx.ROBOTS, "domain string, content string")
    named = [rb.robots_allowed(urls_, files, bot).select("id", F.lit(bot).alias("bot"), "allowed", F.col("crawl_delay").cast("long").alias("crawl_delay")) for bot in ("LodeBot", "unnamed")]
    return named[0].unionByName(named[1])


@query
def frontier_dedup(spark, folder):
    rows = fx.frame(spark, fx.FRONTIER, "seq long, url string, priority long")
    seen = fx.frame(spark, [("http://c.test/",)], "url string")
    return fr.admitted(rows, seen)


@query
def frontier_order(spark, folder):
    rows = fr.admitted(fx.frame(spark, fx.FRONTIER, "seq long, url string, priority long"))
    return fr.schedule(rows, 0, 500).select("url", "priority", "fetch_at")


@query
def politeness_schedule(spark, folder):
    """Events as arrivals: user_id as domain, event id as order."""
    rows = read(spark, folder, "events").select(F.col("user_id").cast("string").alias("domain"), (F.col("event_id") % 4).alias("priority"), F.col("event_id").alias("seq"))
    return fr.schedule(rows, 1000, 1000, mt=True).select("seq", "domain", "fetch_at")


@query
def domain_cap(spark, folder):
    rows = pages_of(spark, folder).select("page_id", urls.domain_stored(F.col("url")).alias("domain"))
    return fr.domain_capped(rows, 5)


@query
def top_domains(spark, folder):
    return fr.top_domains(pages_of(spark, folder).select(urls.domain_stored(F.col("url")).alias("domain")))


@query
def crawl_round(spark, folder):
    """Decisions over all page URLs, with one robots file for every host of example.org."""
    entries = pages_of(spark, folder).select("page_id", "url", urls.domain_mt(F.col("url")).alias("domain"))
    files = entries.filter(F.col("domain").endswith("example.org")).select("domain").distinct().withColumn("content", F.lit("User-agent: *\nDisallow: /fr\nCrawl-delay: 3"))
    done = entries.filter("page_id % 2 = 0").groupBy("domain").agg(F.count("*").alias("n"))
    return fr.crawl_decisions(entries, files, done, "LodeBot", 4).select("page_id", "decision", F.col("delay_ms").cast("long").alias("delay_ms"))


@query
def new_links(spark, folder):
    parsed = pages_of(spark, folder).select(hp.html_links(F.col("html"), F.col("url")).alias("links"))
    seen = pages_of(spark, folder).select(urls.url_normalize_mt(F.col("url")).alias("url"))
    return fr.new_links(parsed, seen).select("url", "domain")


def frontier_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Events as frontier entries: user_id names the domain, the event id gives order and priority."""
    domain = F.concat(F.lit("h"), F.col("user_id").cast("string"), F.lit(".test"))
    return spread(read(spark, folder, "events")).select(F.concat(F.lit("http://"), domain, F.lit("/"), F.col("event_id").cast("string")).alias("url"), domain.alias("domain"), (F.col("event_id") % 4).cast("int").alias("priority"), F.col("event_id").alias("seq"))


@query
def frontier_saved(spark, folder):
    """The frontier written and loaded again."""
    path = shared_path(spark, "frontier")
    pg.save_frontier(frontier_rows(spark, folder).withColumn("added_at", F.col("seq")), path)
    return pg.load_frontier(spark, path).select("url", "domain", F.col("priority").cast("long").alias("priority"), "added_at")


@query
def frontier_exported(spark, folder):
    rows = fr.imported(fr.exported(frontier_rows(spark, folder).filter("priority = 3")))
    return rows.select("url", F.col("priority").cast("long").alias("priority"), "seq")


@query
def next_url(spark, folder):
    rows = frontier_rows(spark, folder)
    return fr.next_url(rows, rows.filter("seq % 97 = 0").select("domain")).select("url", "seq")


@query
def frontier_counters(spark, folder):
    """A URL a user, every tenth invalid."""
    rows = frontier_rows(spark, folder).withColumn("url", F.when(F.col("seq") % 10 == 0, "bad").otherwise(F.concat(F.lit("http://"), "domain", F.lit("/"))))
    return fr.counters(rows, fr.admitted(rows, mt=True))


@query
def crawl_counters(spark, folder):
    k = F.col("seq")
    rows = frontier_rows(spark, folder).select(
        F.when(k % 3 == 0, "robots").otherwise("fetch").alias("decision"), F.when(k % 4 == 0, 404).otherwise(200).alias("status_code"), (k % 1000).alias("content_size"), (k % 9).alias("links_found"), (k % 5).alias("links_accepted"))
    return fr.crawl_counters(rows)


@query
def robots_cache(spark, folder):
    """The latest robots file of each domain, every fifth fetch failed."""
    rows = frontier_rows(spark, folder).select("domain", F.col("seq").alias("fetched_at"), F.when(F.col("seq") % 5 != 0, F.concat(F.lit("# "), F.col("seq").cast("string"))).alias("content"))
    return rb.robots_cache(rows)


@query
def seed_list(spark, folder):
    return pages_of(spark, folder).select("page_id", F.explode(pg.seeds_from_list(F.concat(F.lit(" "), "url", F.lit(" ,, "), "url", F.lit("/b\t")))).alias("url"))


@query
def latest_versions(spark, folder):
    """Three versions of each page in one batch; the one of the greatest time stays, whatever its place."""
    version = F.explode(F.array(F.lit(2), F.lit(7), F.lit(5))).alias("v")
    rows = pages_of(spark, folder).select("page_id", version).select("page_id", F.concat(F.lit("text "), F.col("v").cast("string")).alias("html"), ((F.col("v") * (F.col("page_id") % 5 + 1)) % 11).alias("at"))
    return ix.latest(rows, "page_id", F.col("at")).select("page_id", "html")
