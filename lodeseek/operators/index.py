"""The positional inverted index as tables: docs, postings, terms and statistics; built whole, or merged and cut down.

postings(term, doc_id, field, tf, positions, leads) has a row for each (term, document, field); positions count kept tokens and
restart with each field call. A document's length is its number of distinct (field call, term) pairs, not of tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseek.functions.aiscore import ai_score
from lodeseek.functions.dates import best_dates
from lodeseek.functions.fixed import STOP_WORDS
from lodeseek.functions.text import snippet
from lodeseek.functions.urls import domain_stored
from lodeseek.operators.html import parse_pages
from lodeseek.operators.inversion import counter, inverter, tallier

FIELDS = {"BODY": 0, "TITLE": 1, "H1": 2, "H2": 3, "URL": 4, "META_DESC": 5, "ANCHOR": 6}


def field_calls(docs: DataFrame, columns: dict[str, str]) -> Column:
    """A document's field calls, as an array of (field, text): columns maps field names to columns, of text or, for H1 and H2, arrays of text."""
    calls = []
    for field, column in columns.items():
        texts = F.col(column) if docs.schema[column].dataType.typeName() == "array" else F.array(F.col(column))
        calls.append(_calls(texts, FIELDS[field]))
    return F.concat(*calls)


def _calls(texts: Column, code: int) -> Column:
    return F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda t: F.struct(F.lit(code).cast("byte").alias("field"), t.alias("text")))


def postings(docs: DataFrame, columns: dict[str, str], key: str = "doc_id", least: int = 1, most: int = 100, stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """Postings of documents, one row each in docs; several calls of one field add up, each with positions of its own.

    leads marks the first of a document's postings of a term, over all fields. Nothing is shuffled.
    """
    schema = T.StructType([
        T.StructField("term", T.StringType()), T.StructField("doc_id", docs.schema[key].dataType), T.StructField("field", T.ByteType()), T.StructField("tf", T.IntegerType()),
        T.StructField("positions", T.ArrayType(T.IntegerType())), T.StructField("leads", T.BooleanType())])
    return docs.select(F.col(key).alias("doc_id"), field_calls(docs, columns).alias("calls")).mapInArrow(inverter(least, most, stop), schema)


def doc_length(docs: DataFrame, columns: dict[str, str], least: int = 1, most: int = 100, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """The number of distinct (field call, term) pairs of each row of docs."""
    return F.arrow_udf(counter(least, most, stop), "int")(field_calls(docs, columns))


def terms(posting_rows: DataFrame) -> DataFrame:
    """(term, df)"""
    return posting_rows.filter("leads").groupBy("term").agg(F.count("*").alias("df"))


def tallies(docs: DataFrame, columns: dict[str, str], least: int = 1, most: int = 100, stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(term, df, docs, length): what each task counted of its documents in one pass; docs and length have rows of null term."""
    return docs.select(field_calls(docs, columns).alias("calls")).mapInArrow(tallier(least, most, stop), "term string, df long, docs long, length long")


def counted_terms(docs: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The terms of postings that are not asked for."""
    return tallies(docs, columns).filter("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df"))


def build_docs(docs: DataFrame, columns: dict[str, str], body: str, key: str = "doc_id") -> DataFrame:
    """The docs table; columns are those of the postings, for doc_length. docs may have url, title, published_at, modified_at and era; what it lacks is empty or unknown."""
    have = lambda c, default: F.col(c) if c in docs.columns else F.lit(default)
    text = F.coalesce(F.col(body), F.lit(""))
    url = have("url", "").cast("string")
    return docs.select(
        F.col(key).alias("doc_id"), url.alias("url"), have("title", "").cast("string").alias("title"), snippet(text).alias("snippet"), have("published_at", 0).cast("long").alias("published_at"),
        have("modified_at", 0).cast("long").alias("modified_at"), ai_score(text).alias("ai_score"), have("era", "unknown").cast("string").alias("era"), domain_stored(url).alias("domain"),
        doc_length(docs, columns).alias("doc_length"))


def latest(docs: DataFrame, key: str, order: Column) -> DataFrame:
    """Of each document of a batch the version that is greatest by order, which must tell versions apart."""
    return docs.groupBy(key).agg(F.max_by(F.struct(*docs.columns), order).alias("r")).select("r.*")


def parsed_documents(pages: DataFrame, key: str = "page_id", mode: str = "regex") -> DataFrame:
    """Pages as index input: parsed, dated and with an era."""
    parsed = parse_pages(pages, key, mode=mode)
    published, modified, era = best_dates(F.col("published_date"), F.col("modified_date"), F.col("url"), F.col("text_content"))
    return parsed.select(F.col(key).alias("doc_id"), "url", "title", F.col("text_content").alias("body"), "h1", "h2", "description", published.alias("published_at"), modified.alias("modified_at"), era.alias("era"))


def remove_documents(posting_rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Postings without those of ids (doc_id); terms without postings vanish with them."""
    return posting_rows.join(ids.select("doc_id").distinct(), "doc_id", "left_anti")


def merge_postings(base: DataFrame, delta: DataFrame) -> DataFrame:
    """base with the documents of delta in their new versions."""
    return remove_documents(base, delta).select(*delta.columns).unionByName(delta)


def index_stats(docs: DataFrame, term_rows: DataFrame, mode: str = "sample100") -> DataFrame:
    """One row: doc_count, term_count, avgdl. sample100: over the first hundred ids in the order of their decimal strings."""
    lengths = docs.select("doc_id", "doc_length")
    if mode == "sample100":
        lengths = lengths.orderBy(F.col("doc_id").cast("string")).limit(100)
    average = lengths.agg(F.coalesce(F.avg("doc_length"), F.lit(100.0)).alias("avgdl"))
    one = [docs.agg(F.count("*").alias("doc_count")), term_rows.agg(F.count("*").alias("term_count")), average]
    keyed = [x.withColumn("_one", F.lit(1)) for x in one]
    return keyed[0].join(keyed[1], "_one").join(keyed[2], "_one").drop("_one")


def counted_stats(docs: DataFrame, columns: dict[str, str], mode: str = "sample100", key: str = "doc_id") -> DataFrame:
    """index_stats of documents whose index is not asked for: one pass over their texts, and one over the sampled ones, chosen first."""
    average = lambda n: F.coalesce(F.try_divide(F.sum("length"), F.sum("docs")), F.lit(100.0)).alias(n)
    each = tallies(docs, columns).groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("length").alias("length"))
    one = each.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("doc_count"), F.count("term").alias("term_count"), average("avgdl"))
    if mode != "sample100":
        return one
    first = tallies(docs.orderBy(F.col(key).cast("string")).limit(100), columns).agg(average("avgdl"))
    return one.drop("avgdl").withColumn("_one", F.lit(1)).join(first.withColumn("_one", F.lit(1)), "_one").drop("_one")
