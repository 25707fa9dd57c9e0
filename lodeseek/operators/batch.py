"""Many queries against many documents: a block of documents' term counts times a block of queries' terms is one matrix product.

Joining postings to queries would make a row for each pair of a posting and a query that holds its term, and shuffle a row for each
pair of query and document. Here nothing of pairs leaves a task but its best k a query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Cells of the matrix of one block of documents.
CELLS = 1 << 20


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores over 0; equal ones to the smaller id. Sums differ in their last digits with the order of their terms."""
    at = np.flatnonzero(scores > 0)
    key = np.round(scores[at], 9)
    if len(at) > k:
        keep = key >= np.partition(key, len(at) - k)[len(at) - k]
        at, key = at[keep], key[keep]
    return at[np.lexsort((ids[at], -key))[:k]]


def scorer(query: np.ndarray, term: np.ndarray, times: np.ndarray, idf: np.ndarray, queries: int, average: float, k: int, k1: float, b: float, penalty: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, doc_length, ai_score, found: array of (no, tf)) -> (no, doc_id, score), the best k a query of each task. query, term and times are cells of the queries' matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = np.zeros((len(idf), queries))
        asked[term, query] = times
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, "int64"), np.empty(0))] * queries
        step = max(1, CELLS // len(idf))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids, lengths, ai, found = (part.column(i) for i in range(4))
                ids = ids.to_numpy(zero_copy_only=False)
                pairs = found.flatten()
                counts = np.zeros((len(ids), len(idf)))
                # A term's postings of several fields add up before they are weighted.
                np.add.at(counts, (np.repeat(np.arange(len(ids)), found.value_lengths().to_numpy(zero_copy_only=False)), pairs.field(0).to_numpy()), pairs.field(1).to_numpy())
                norm = k1 * (1 - b + b * lengths.to_numpy(zero_copy_only=False).astype("float64") / average)
                weights = idf * (counts * (k1 + 1)) / (counts + norm[:, None])
                scores = (weights @ asked) * (1 - ai.to_numpy(zero_copy_only=False) * penalty)[:, None]
                for q in range(queries):
                    i, s = np.concatenate([best[q][0], ids]), np.concatenate([best[q][1], scores[:, q]])
                    kept = best_of(i, s, k)
                    best[q] = (i[kept], s[kept])
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.arange(queries, dtype="int32"), [len(i) for i, _ in best])), pa.array(np.concatenate([i for i, _ in best]).astype("int64")), pa.array(np.concatenate([s for _, s in best]))], ["no", "doc_id", "score"])

    return run
