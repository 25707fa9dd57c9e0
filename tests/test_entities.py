"""Entities that markup or the end cuts off stay as they are, as in SQL; others are read."""

import duckdb
import pytest

from lodeseek.operators import html
from lodeseek.plans.oracles import ORACLES
from lodeseek.plans.queries import QUERIES

PAGE = "<html><head><title>%s</title></head><body><h1>%s</h1><p>%s</p><a href='/x'>%s</a></body></html>"
TEXTS = ["one&amp;&amp", "two&am", "three &quot;x&quot", "four &amp; five&copy;"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("cut")
    rows = [(i, f"http://www.example.com/{i}", PAGE % (t, t, f"thing onth {t}", t)) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{path}/pages.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["html_tree", "multi_field_index", "site_filter", "text", "title", "format_results", "links"])
def test_cut_entities(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, QUERIES[name](spark, folder).select(*names).collect())) == sorted(want.fetchall())


def test_entities_before_a_blank(spark):
    pages = spark.createDataFrame([(1, "", "<title>a &copy b</title><p>&lt x&#65 &#6</p>")], "page_id long, url string, html string")
    for mode in ("regex", "tree"):
        row = html.parse_pages(pages, mode=mode).select("title", "text_content").first()
        assert row["title"] == "a © b" and row["text_content"].endswith("< xA &#6")
