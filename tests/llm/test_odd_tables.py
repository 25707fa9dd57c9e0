"""Column names of any kind, null columns and empty tables in every stage and operator; the fit against a plain maximum."""

import numpy as np
import pytest
from pyspark.sql import functions as F

SOURCE = "/root/testdata/sf0.001"
TEXT = "doc_id long, text string, lang string, source string, n_chars long"


def odd(spark, rows):
    frame = spark.createDataFrame([(i, t, None, None, len(t or "")) for i, t in rows], TEXT)
    for name in ("a.b", "a-b", "my col", "tick`ed", "row", "id", "uid", "n_hit", "at", "spans", "keep"):
        frame = frame.withColumn(name, F.lit(name))
    return frame


ROWS = [(1, "some words of a text that is long enough to have shingles"), (2, None), (3, ""), (4, "é " * 40), (None, "no id at all here"), (5, "w " * 3000), (6, "token=abcdefgh1 x")]


@pytest.mark.parametrize("name", ["quality", "near_dedup", "decontaminate", "secrets", "packing"])
def test_stages_take_odd_columns(spark, name):
    import corpus_pipeline

    frame = odd(spark, ROWS)
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, frame, SOURCE)
    rows = got.collect()
    if name == "packing":
        assert {r["doc_id"] for r in rows} == {i for i, _ in ROWS}
    else:
        assert got.columns == frame.columns and all(r["a.b"] == "a.b" and r["tick`ed"] == "tick`ed" for r in rows)
    assert stage(spark, frame.limit(0), SOURCE).count() == 0


def test_operators_take_odd_columns(spark):
    from lodeseek.llm import licenses, maxscore, packing, secrets, simhash, tokencount, urlfilter, warc

    frame = odd(spark, ROWS).withColumnRenamed("doc_id", "the.id").withColumnRenamed("text", "the text")
    names = {"id_col": "the.id", "text_col": "the text"}
    for operator in (licenses.license_scan, packing.pack, tokencount.token_counts, simhash.near_duplicates, secrets.secret_spans):
        got = operator(frame, **names)
        assert got.columns[0] == "the.id" and {r[0] for r in got.collect()} == {i for i, _ in ROWS}
    pages = frame.withColumnRenamed("the text", "the.html").withColumn("the url", F.lit("http://h.test/x"))
    assert warc.archive(pages, "the.id", "the url", "the.html").count() == len(ROWS)
    assert urlfilter.url_verdicts(pages, "the.id", "the url").columns[0] == "the.id"
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(60)], "`v.id` long, `my vector` array<double>").withColumn("part", F.lit(1))
    assert [tuple(r) for r in maxscore.top_k(vectors, 1, id_col="v.id", vec_col="my vector").orderBy("query_id").collect()] == [(0, 1, 1, 65536), (50, 1, 59, 65536 * (50 * 59 + 1))]


def loss(x, grades, w, t, ridge):
    """Mean negative log-likelihood of the cumulative link model, written from its definition."""
    score = x @ w
    below = lambda k: np.where(k < 0, 0.0, np.where(k >= len(t), 1.0, 1 / (1 + np.exp(-(t[np.clip(k, 0, len(t) - 1)] - score)))))
    return -np.log(below(grades) - below(grades - 1)).mean() + ridge / 2 * (w**2).sum()


def test_fit_finds_the_maximum():
    """No small step from the fitted weights and thresholds lowers the loss by more than the descent leaves, and random starts end no lower."""
    from lodeseek.llm.quality import fit

    rng = np.random.default_rng(3)
    n, size, ridge = 1500, 8, 0.01
    x = rng.random((n, size)) < 0.4
    true = rng.normal(0, 1.5, size)
    grades = np.searchsorted([-0.5, 1.0], x @ true + rng.logistic(size=n)).astype(int)
    flat, many = np.nonzero(x)[1].astype(np.int32), x.sum(axis=1)
    model = fit(grades, flat, np.concatenate(([0], np.cumsum(many)[:-1])), 3, least=1, ridge=ridge, rounds=600)
    found = loss(x, grades, model.weights, model.thresholds, ridge)
    for k in range(size):
        for step in (-0.02, 0.02):
            moved = model.weights.copy()
            moved[k] += step
            assert loss(x, grades, moved, model.thresholds, ridge) > found - 1e-5
    for k in range(2):
        for step in (-0.02, 0.02):
            moved = model.thresholds.copy()
            moved[k] += step
            assert loss(x, grades, model.weights, moved, ridge) > found - 1e-5
    assert found < min(loss(x, grades, rng.normal(0, 1.5, size), np.sort(rng.normal(0, 1, 2)), ridge) for _ in range(200))
    assert found <= loss(x, grades, true, np.array([-0.5, 1.0]), ridge) + 1e-3
