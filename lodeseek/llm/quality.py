"""Quality scores by ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds t_1 < t_2 < .. turn a text's
score s into P(grade <= k) = sigmoid(t_k+1 - s). Its expected grade is the sum of its tail probabilities, and a text is
selected by the tail probability P(grade >= select).

Features of a text are presences: words (A-Z lower-cased, cut at other ASCII than letters and digits), words' first four
bytes, the last three bytes of what stands between blanks, and classes of a few ratios of style, all hashed to 2**`bits` weights. The model is fitted on at most `max_rows`
rated documents (those with the least hashed ids), the only sample here; scoring covers every row, where it is read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.common import boxed, col, fields, released, slices, utf8
from lodeseek.llm.decontaminate import words

_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_UPPER, _SPACE = bytes(range(65, 91)), b" \t\r\n\f\v"


def features(text: bytes | None, bits: int) -> np.ndarray:
    """Hashed features, each once, sorted."""
    text, mask, crc = text or b"", (1 << bits) - 1, zlib.crc32
    found = words(text)
    distinct = set(found)
    hashed = {crc(w) & mask for w in distinct}
    hashed.update(crc(p, 1) & mask for p in {w[:4] for w in distinct})
    hashed.update(crc(e, 3) & mask for e in {w[-3:] for w in set(text.split())})
    size = max(1, len(text))
    letters = size - len(text.translate(None, _LETTERS))
    upper = size - len(text.translate(None, _UPPER))
    blank = size - len(text.translate(None, _SPACE))
    ratios = (
        ("symbols", (size - letters - blank) / size),
        ("upper", upper / max(1, letters)),
        ("blank", blank / size),
        ("distinct", len(distinct) / max(1, len(found)) ** 0.8),
        ("lines", text.count(b"\n") / max(1, len(found))),
        ("same_lines", 1 - len(set(lines := text.split(b"\n"))) / len(lines)),
        ("bars", text.count(b"|") / max(1, len(found))),
        ("length", np.log2(1 + len(found)) / 20),
    )
    hashed.update(crc(f"{name} {int(min(40, 40 * x))}".encode(), 2) & mask for name, x in ratios)
    return np.array(sorted(hashed), np.int32)


class Model:
    """Weights (2**bits) and thresholds (grades - 1); no thresholds: ratings told nothing, every text is kept."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds, self.bits = weights, thresholds, len(weights).bit_length() - 1

    def tails(self, text: bytes | None) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, .."""
        score = float(self.weights[features(text, self.bits)].sum())
        return _sigmoid(score - self.thresholds)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(grades: np.ndarray, flat: np.ndarray, starts: np.ndarray, bits: int, least: int = 3, ridge: float = 1e-4, rounds: int = 100, rate: float = 0.1) -> Model:
    """Maximum penalised likelihood by Adam over all rows, at a falling rate. flat: the rows' features one after another, from starts on."""
    top, n, size = int(grades.max(initial=0)), len(grades), 1 << bits
    if n == 0 or len(np.unique(grades)) < 2:
        return Model(np.zeros(size), np.zeros(0))
    often = np.bincount(flat, minlength=size) >= least
    names = np.flatnonzero(often)
    place = np.cumsum(often, dtype=np.int32) - 1
    edges = np.append(starts, len(flat))
    parts = []  # of some hundred rows each, so that what a round computes for every feature is never held whole
    for at in range(0, n, 512):
        to = min(n, at + 512)
        some = flat[edges[at] : edges[to]]
        own = np.repeat(np.arange(to - at, dtype=np.int32), np.diff(edges[at : to + 1]))
        parts.append((at, to, own[often[some]], place[some[often[some]]]))
    w, gaps = np.zeros(len(names)), np.zeros(top)  # thresholds: gaps[0], then steps of exp(gaps[k])
    gaps[0] = np.log(((grades == 0).sum() + 1) / ((grades > 0).sum() + 1))
    first, second = np.zeros(len(w) + top), np.zeros(len(w) + top)
    for k in range(1, rounds + 1):
        steps = np.exp(gaps[1:])
        t = gaps[0] + np.concatenate(([0.0], np.cumsum(steps)))
        score = np.concatenate([np.bincount(own, w[some], to - at) for at, to, own, some in parts])
        ends = np.concatenate(([-np.inf], t, [np.inf]))
        low, high = _sigmoid(ends[grades] - score), _sigmoid(ends[grades + 1] - score)
        d_low, d_high = low * (1 - low), high * (1 - high)
        p = np.maximum(high - low, 1e-12)
        d_score = (d_high - d_low) / p
        d_t = np.array([(d_low[grades == j + 1] / p[grades == j + 1]).sum() - (d_high[grades == j] / p[grades == j]).sum() for j in range(top)])
        d_gaps = np.concatenate(([d_t.sum()], [d_t[j:].sum() * steps[j - 1] for j in range(1, top)]))
        d_w = sum(np.bincount(some, d_score[at:to][own], len(w)) for at, to, own, some in parts)
        gradient = np.concatenate((d_w / n + ridge * w, d_gaps / n))
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        move = rate * (1 - (k - 1) / rounds) * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
        w, gaps = w - move[: len(w)], gaps - move[len(w) :]
    weights = np.zeros(size)
    weights[names] = w
    return Model(weights, gaps[0] + np.concatenate(([0.0], np.cumsum(np.exp(gaps[1:])))))


FEATURES = pa.schema([("at", pa.int64()), ("raw", pa.int64()), ("grade", pa.int32()), ("features", pa.list_(pa.int32()))])


def train(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", max_rows: int = 12_000, bits: int = 18, **options) -> Model:
    """A model from docs and their ratings (id_col, grade_col from 0 on). Ratings with nulls or without a document are ignored.

    The sample has at most max_rows ratings, those of least hashed id, and after they met their documents at most max_rows rated
    texts, those of least hashed id, text and grade: ids that repeat, in ratings or in docs, are so many rated texts, up to that bound.
    """
    rated = ratings.select(col(id_col).alias("id"), col(grade_col).cast("int").alias("grade")).dropna().filter("grade >= 0")
    sample = rated.withColumn("at", F.xxhash64("id")).orderBy("at", "id", "grade").limit(max_rows)
    texts = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).join(F.broadcast(sample), "id")
    texts = texts.select("at", F.xxhash64("text").alias("raw"), "grade", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [features(t, bits) for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("at", "raw", "grade")), pa.array(found, pa.list_(pa.int32()))], names=["at", "raw", "grade", "features"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches), FEATURES).sort_by([(c, "ascending") for c in ("at", "raw", "grade")]).combine_chunks()
        lists = got["features"].combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        starts = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))[:-1]
        model = fit(got["grade"].to_numpy(), lists.flatten().to_numpy(), starts, bits, **options)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (model.weights, model.thresholds)], names=["weights", "thresholds"])
        released()

    # The sample is bounded, so it is fitted in one task; the model alone comes to the driver.
    sampled = texts.mapInArrow(run, "at long, raw long, grade int, features array<int>").orderBy("at", "raw", "grade").limit(max_rows)
    rows = sampled.repartition(1).mapInArrow(fitted, "weights binary, thresholds binary").collect()
    if not rows:
        return Model(np.zeros(1 << bits), np.zeros(0))
    return Model(*(np.frombuffer(rows[0][c], np.float64) for c in ("weights", "thresholds")))


def scored(docs: DataFrame, model: Model, text_col: str = "text", select: int = 2, cut: float = 0.5) -> DataFrame:
    """A row for each row of docs: row (all its columns), expected_grade, p_tail = P(grade >= select), keep (p_tail >= cut).

    Null and empty texts are scored by their style features alone. If the model has no thresholds (no ratings, or of one
    grade), or none for select, the figures are null and every row is kept.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    rows = boxed(docs)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*held.value)
        for batch in slices(batches, "row"):
            tails = [own.tails(t) for t in utf8(batch.column("row").field(at))]
            known = 0 < select <= len(own.thresholds)
            arrays = [batch.column("row"), *(pa.array(x, pa.float64()) for x in (([float(t.sum()) for t in tails], [float(t[select - 1]) for t in tails]) if known else ([None] * len(tails),) * 2))]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "expected_grade", "p_tail"])

    out = rows.mapInArrow(run, fields(rows.schema["row"], "expected_grade double, p_tail double"))
    return out.withColumn("keep", F.coalesce(F.col("p_tail") >= cut, F.lit(True)))


def graded(labels: DataFrame) -> DataFrame:
    """Grades of the labels table: 0 toxic, 1 harmless but poor, 2 harmless and good; a row with a null label has none."""
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("toxic").isNull() | F.col("quality").isNull(), None).otherwise(F.when(F.col("quality") > 0, 2).otherwise(1))
    return labels.select("doc_id", grade.alias("grade"))
