"""Plans of queries that grew faster than their input."""

import re

from pyspark.sql import functions as F

from lodeseek.functions import aiscore, dates, tokens
from lodeseek.functions import text as tx
from lodeseek.functions.fixed import STOP_WORDS
from lodeseek.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def optimized(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_best_date_works_out_its_inputs_once(spark):
    """An input of best_dates was repeated in every pattern, twice again for the era."""
    assert optimized(QUERIES["best_date"](spark, FOLDER)).count("date_format") <= 4 * 3
    rows = spark.createDataFrame([("", "2021-05-06", "http://h/2020/03/", "x"), ("none", "", "", "(c) 2015"), (None, None, None, None)], "p string, m string, u string, t string")
    found = rows.select(*(c.alias(n) for c, n in zip(dates.best_dates(*map(F.col, "pmut")), ("published", "modified", "era")))).collect()
    assert [r["era"] for r in found] == ["pre-ai", "pre-ai", "unknown"] and found[1]["published"] == 1435752000 and found[2]["published"] == 0


def test_frontier_counters_try_the_url_pattern_once(spark):
    """Each part of a normalised URL repeated the patterns before it, and counting made every URL again."""
    plan = optimized(QUERIES["frontier_counters"](spark, FOLDER))
    assert plan.count("(?is)^(https?)") <= 20


def test_stem_vocab_tests_distinct_words_alone(spark):
    """Stop words were looked up for every token, before words were made distinct."""
    plan = optimized(QUERIES["stem_vocab"](spark, FOLDER))
    assert "yourselves" not in plan[plan.index("Generate") :]


def test_phrases_are_counted_without_a_pattern_of_all(spark):
    """A pattern of all phrases tried each of them at every character."""
    assert "delve|delves" not in optimized(QUERIES["ai_vocab"](spark, FOLDER))
    rows = spark.createDataFrame([("DELVE delves Ärobust",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(aiscore.phrase_count(F.col("t"))).collect()] == [4, 0, 0]


def test_token_positions_are_made_in_place(spark, monkeypatch):
    """Windows over every run of letters shuffled and sorted them all."""
    frame = QUERIES["tokenize_positions"](spark, FOLDER)
    plan = optimized(frame)
    assert "Window" not in plan and "Sort" not in plan and "MapInArrow" in plan
    monkeypatch.setattr(tokens, "PIECE", 7)
    rows = [(1, "é The cats, CATS" * 9), (2, None), (3, ""), (None, "x" * 101 + " y"), (4, "abc"), (5, "deF" + "g" * 20 + "-" * 20), (6, "-KK1\U0001f600z")]
    want = []
    for key, text in rows:
        n = 0
        for m in re.finditer(rb"[A-Za-z0-9]+", (text or "").encode()):
            word = m[0].decode()
            if len(word) <= 100 and word.lower() not in STOP_WORDS:
                want.append((key, n, word, m.start(), word.lower()))
                n += 1
    got = tx.token_rows(spark.createDataFrame(rows, "k long, t string").coalesce(1), "k", "t").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
