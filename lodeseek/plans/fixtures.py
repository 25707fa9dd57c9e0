"""Small inline inputs of registered queries, as frames and as SQL VALUES."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ROBOTS = [
    ("a.test", "User-agent: *\r\nDisallow: /private\nAllow: /private/open # note\nCrawl-delay: 2\n\nUser-agent: LodeBot\nUser-agent: other\nDisallow: /\nAllow: /ok"),
    ("b.test", "# all welcome\nUser-Agent : *\nDisallow:\nCrawl-delay: x\nCrawl-delay: 7s"),
    ("c.test", "Disallow: /lost\nno colon here\nUser-agent: *\nSitemap: http://c.test/s\nAllow: /p\nDisallow: /p\nUser-agent: *\nDisallow: /q"),
    ("d.test", ""),
]
ROBOTS_URLS = [
    (1, "a.test", "http://a.test/private/x"), (2, "a.test", "http://a.test/private/open/1"), (3, "a.test", "http://a.test/ok?x=1"), (4, "b.test", "http://b.test/any"), (5, "c.test", "http://c.test/p/1"),
    (6, "c.test", "http://c.test/q"), (7, "c.test", "http://c.test"), (8, "d.test", "/private"), (9, "e.test", "http://e.test/lost"), (10, "c.test", "http://c.test/lost"),
]
ENCODED = [
    (1, "http://h.test/%7Euser/%41%2d%5F"), (2, "HTTP://H.Test:80/a%2Fb%zz%4"), (3, "https://h.test:443"), (4, "https://h.test:8443/?"), (5, "http://h.test/p?q=%41#f"), (6, "ftp://h.test/"), (7, "no url"), (8, "http://h.test/%c3%a9%2541"), (9, "http://h.test?x=1"),
]
CONTENT = [
    (1, "Published on January 15, 2021 by me"), (2, "Posted: 2020-3-22 and more"), (3, "Updated 2019-01-05. Text"), (4, "Date: March 3, 2018"), (5, "September 2024 was warm"), (6, "words words words words words September 2024"), (7, "(c) 2015 us"), (8, "Copyright 1990"),
    (9, "A day: 2017-13-01"), (10, "Nov 30, 2022"), (11, "nothing here"), (12, "published 2021-99-01 then May 5, 2016"), (13, "On May 5, 1980 and 2001-02-03"), (14, "© 2012"),
]
SEEDS = [(1, "  http://a.test/ "), (2, "# comment"), (3, ""), (4, "http://b.test/x\t"), (5, "not a url"), (6, "http://a.test/")]
FRONTIER = [
    (1, "http://a.test/1", 2), (2, "http://b.test/1", 0), (3, "http://A.test/1#x", 0), (4, "http://a.test/2", 1), (5, "http://b.test/2", 3), (6, "bad", 0), (7, "http://c.test", 1), (8, "http://a.test/3", 0),
]


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(rows: list[tuple]) -> str:
    """The same rows in SQL, as a subquery of columns column0, column1 and so on."""
    cell = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''").replace("\n", "'||chr(10)||'").replace("\r", "'||chr(13)||'").replace("\t", "'||chr(9)||'") + "'"
    names = ", ".join(f"column{i}" for i in range(len(rows[0])))
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") _v({names}))"
