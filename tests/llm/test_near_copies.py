"""The pipeline's near-duplicate stage against brute-force Jaccard similarity."""

import random

import pytest

TEXT = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    """The least id of each component of pairs with 5-word Jaccard >= 0.8; texts without words are copies of each other."""
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    for i in sets:
        for j in sets:
            a, b = sets[i], sets[j]
            if i < j and (5 * len(a & b) >= 4 * len(a | b)) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return sorted(i for i in root if root[i] == i)


def corpus():
    rng, rows = random.Random(5), []
    words = [f"w{i}" for i in range(400)]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice((30, 120, 400)))]
        rows.append(base)
        for every in (400, 200, 100, 60, 50, 20):
            rows.append([rng.choice(words) if rng.random() < 1 / every else w for w in base])
    base = [rng.choice(words) for _ in range(150)]
    rows += [[rng.choice(words) if rng.random() < 1 / 70 else w for w in base] for _ in range(40)]
    banner = [rng.choice(words) for _ in range(30)]
    rows += [banner + [rng.choice(words) for _ in range(40)] for _ in range(20)]
    texts = [" ".join(w) for w in rows] + ["", " \n", "one two", "ONE  two", "one two three four five", "one two three four six", None]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("most", [1 << 20, 4000])
def test_near_copies(spark, most):
    from lodeseek.llm.nearcopies import near_copies

    rows = corpus()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_copies(frame, most=most).collect()
    assert sorted(r["doc_id"] for r in got) == [i for i, _ in rows]
    assert sorted({r["component_id"] for r in got}) == brute_kept(rows)


def test_stage_keeps_one_of_each_group(spark):
    import corpus_pipeline

    rows = corpus()
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], TEXT)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame, "").collect()) == brute_kept(rows)


def test_stage_keeps_texts_that_share_an_id(spark):
    """Rows of one id with different texts stay; repeated rows become one; rows without an id and odd columns pass."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    rows = [(1, "a b c d e f g h"), (1, "i j k l m n o p"), (1, "a b c d e f g h"), (2, "i j k l m n o p"), (None, "i j k l m n o p"), (3, None), (4, " ")]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], TEXT)
    frame = frame.withColumn("a.b", F.lit(1)).withColumn("my `col`", F.lit("x")).withColumn("raw", F.lit(2)).withColumn("uid", F.create_map(F.lit("k"), F.lit(1)))
    got = corpus_pipeline.near_dedup(spark, frame, "")
    assert got.columns == frame.columns
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got.collect()) == [("1", "a b c d e f g h"), ("1", "i j k l m n o p"), ("3", "None"), ("None", "i j k l m n o p")]
    assert corpus_pipeline.near_dedup(spark, frame.limit(0), "").count() == 0
