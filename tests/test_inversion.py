"""Postings made in place equal those of a plain loop over texts, with stems of the column form."""

import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lodeseek.functions import text as tx
from lodeseek.functions.fixed import STOP_WORDS
from lodeseek.operators import index as ix
from lodeseek.operators import inversion as inv
from lodeseek.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
ROWS = [(1, "The cats; CATS and cafés", ["One two", "two", None]), (2, None, None), (3, "", []), (None, "lone word " * 3, ["x" * 101]), (5, "Kelvin İstanbul " + "running " * 70000, ["running"])]


def test_stems_of_both_forms(spark):
    words = spark.read.parquet(f"{FOLDER}/documents.parquet").select(F.explode(tx.kept_tokens(F.col("text"))).alias("token")).distinct()
    rows = tx.stemmed(words).collect()
    assert len(rows) > 100 and all(tx.stem_py(r["token"]) == r["stem"] for r in rows)


def test_postings_equal_a_loop(spark, monkeypatch):
    monkeypatch.setattr(inv, "MOST_STEMS", 3)
    monkeypatch.setattr(inv, "FLUSH", 4)
    docs = spark.createDataFrame(ROWS, "id long, body string, h1 array<string>")
    want, lengths = [], {}
    for key, body, heads in ROWS:
        pairs, seen = 0, set()
        for field, texts in ((0, [body]), (2, heads or [])):
            at = defaultdict(list)
            for t in texts:
                kept = [w.lower() for w in re.findall("[A-Za-z0-9]+", t or "") if len(w) <= 100 and w.lower() not in STOP_WORDS]
                stems = [tx.stem_py(w) for w in kept]
                pairs += len(set(stems))
                for i, s in enumerate(stems):
                    at[s].append(i)
            want += [(s, key, field, len(p), tuple(sorted(p)), s not in seen) for s, p in at.items()]
            seen |= set(at)
        lengths[key] = pairs
    columns = {"BODY": "body", "H1": "h1"}
    got = [(r["term"], r["doc_id"], r["field"], r["tf"], tuple(r["positions"]), r["leads"]) for r in ix.postings(docs, columns, "id").collect()]
    assert Counter(got) == Counter(want)
    assert {r["id"]: r["n"] for r in docs.select("id", ix.doc_length(docs, columns).alias("n")).collect()} == lengths
    df = {r["term"]: r["df"] for r in ix.terms(ix.postings(docs, columns, "id")).collect()}
    assert df == Counter(w[0] for w in want if w[5]) and df["run"] == 1
    assert ix.postings(docs.limit(0), columns, "id").count() == 0


def test_statistics_of_one_pass_equal_those_of_the_index(spark, monkeypatch):
    """Average lengths made every posting, with positions, to count terms, and went over all texts a second time for lengths."""
    monkeypatch.setattr(inv, "MOST_STEMS", 3)
    monkeypatch.setattr(inv, "MOST_COUNTS", 4)
    columns = {"BODY": "body", "H1": "h1"}
    rows = ROWS + [(n, f"common word{n % 7} word{n % 11} " * (n % 3), ["common"]) for n in range(6, 150)]
    docs = spark.createDataFrame(rows, "id long, body string, h1 array<string>")
    for some in (docs, docs.limit(0)):
        stored = some.select(F.col("id").alias("doc_id"), ix.doc_length(some, columns).alias("doc_length"))
        terms = ix.terms(ix.postings(some, columns, "id"))
        assert Counter(map(tuple, ix.counted_terms(some, columns).collect())) == Counter(map(tuple, terms.collect()))
        for mode in ("sample100", "exact"):
            assert ix.counted_stats(some, columns, mode, "id").collect() == ix.index_stats(stored, terms, mode).collect()


def test_average_lengths_read_texts_once(spark):
    plan = lambda name: QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan("avgdl_exact").count("MapInArrow") == 1 and "ArrowEvalPython" not in plan("avgdl_exact")
    sampled = plan("avgdl_sample100")
    assert "ArrowEvalPython" not in sampled and sampled.index("GlobalLimit") > sampled.rindex("MapInArrow")


def test_document_frequencies_need_no_positions(spark):
    """Every posting went from Python to the JVM with its positions, and a table of 2^18 stems filled up in each worker."""
    for name in ("token_df", "idf"):
        assert "positions" not in QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    stems = inv.Stems(1, 100, STOP_WORDS)
    assert all(stems[b"%d" % n] == str(n) for n in range(300_000))
    assert len(stems) + len(stems.before) <= 1 << 17 and stems[b"the"] is None and stems[b"299999"] == "299999"
