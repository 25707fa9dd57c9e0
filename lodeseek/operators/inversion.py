"""Documents turned into postings where they lie: a document's postings need its own tokens alone, so nothing is shuffled.

Grouping a text's tokens takes time square in its length with array functions, and a shuffle of every token with an aggregation;
so this one step runs over Arrow batches. A task holds one batch of texts, the postings of one document beyond a flush, and a
table of stems of bounded size. Where positions are not asked for, a task counts its documents' terms in a table that is given on and
emptied when full.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

import lodeseek
from lodeseek.functions.text import stem_py

# Workers get the functions by value, so that an executor without this package can run them.
cloudpickle.register_pickle_by_value(lodeseek)

WORD = re.compile(rb"[a-z0-9]+")
MOST_STEMS, FLUSH, MOST_COUNTS = 1 << 17, 1 << 17, 1 << 16


class Stems(dict):
    """Lower-cased word -> its stem; None for words that the index leaves out. When half of MOST_STEMS are here, they make room, and are looked up until the next half is full."""

    def __init__(self, least: int, most: int, stop: tuple[str, ...]):
        super().__init__()
        self.least, self.most, self.stop, self.before = least, most, {w.encode() for w in stop}, {}

    def __missing__(self, word: bytes) -> str | None:
        if not self.least <= len(word) <= self.most:
            return None
        if len(self) >= MOST_STEMS // 2:
            self.before = self.copy()
            self.clear()
        if word in self.before:
            found = self.before[word]
        else:
            found = None if word in self.stop else stem_py(word.decode())
        self[word] = found
        return found


def call_terms(text: bytes | None, stems: Stems) -> dict[str, list[int]]:
    """Positions of each term in one field call, in order; kept tokens alone are counted."""
    found: dict[str, list[int]] = defaultdict(list)
    at = 0
    for word in WORD.findall((text or b"").lower()):
        term = stems[word]
        if term is not None:
            found[term].append(at)
            at += 1
    return found


def call_set(text: bytes | None, stems: Stems) -> set[str]:
    """The terms of one field call."""
    found = set(map(stems.__getitem__, set(WORD.findall((text or b"").lower()))))
    found.discard(None)
    return found


def document_calls(calls: pa.ListArray) -> Iterator[list[tuple[int, bytes | None]]]:
    """Each document's (field, text) calls."""
    fields, texts = calls.flatten().flatten()
    fields, texts, at = fields.to_pylist(), texts.cast(pa.binary()), 0
    for n in calls.value_lengths().to_pylist():
        yield [(fields[i], texts[i].as_py()) for i in range(at, at + n)]
        at += n


def field_terms(calls: list[tuple[int, bytes | None]], stems: Stems) -> dict[int, dict[str, list[int]]]:
    """Field -> term -> positions; several calls of a field add up."""
    fields: dict[int, dict[str, list[int]]] = {}
    for field, text in calls:
        found = call_terms(text, stems)
        have = fields.setdefault(field, found)
        if have is not found:
            for term, positions in found.items():
                have[term] = sorted(have.get(term, []) + positions)
    return fields


class Rows:
    """Postings on their way into one Arrow batch."""

    def __init__(self) -> None:
        self.terms, self.owners, self.fields, self.leads = [], array("i"), array("b"), []
        self.positions, self.ends = array("i"), array("i", [0])

    def add(self, owner: int, field: int, terms: dict[str, list[int]], known: set[str] | None) -> None:
        self.terms.extend(terms)
        self.owners.extend([owner] * len(terms))
        self.fields.extend([field] * len(terms))
        self.leads.extend([known is None or t not in known for t in terms])
        for positions in terms.values():
            self.positions.extend(positions)
            self.ends.append(len(self.positions))

    def batch(self, keys: pa.Array) -> pa.RecordBatch:
        ends = np.frombuffer(self.ends, "int32")
        positions = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(self.positions, "int32")))
        columns = [pa.array(self.terms, pa.string()), keys.take(pa.array(np.frombuffer(self.owners, "int32"))), pa.array(np.frombuffer(self.fields, "int8")), pa.array(np.diff(ends)), positions, pa.array(self.leads, pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, ["term", "doc_id", "field", "tf", "positions", "leads"])


def inverter(least: int, most: int, stop: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, calls) -> (term, doc_id, field, tf, positions, leads)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems = Stems(least, most, stop)
        for batch in batches:
            keys, rows = batch.column(0), Rows()
            for owner, calls in enumerate(document_calls(batch.column(1))):
                known: set[str] | None = None
                for field, terms in field_terms(calls, stems).items():
                    rows.add(owner, field, terms, known)
                    known = (known or set()) | terms.keys() if len(calls) > 1 else None
                if len(rows.positions) >= FLUSH:
                    yield rows.batch(keys)
                    rows = Rows()
            if rows.terms:
                yield rows.batch(keys)

    return run


def counter(least: int, most: int, stop: tuple[str, ...]) -> Callable[[pa.Array], pa.Array]:
    """calls -> number of distinct (call, term) pairs"""
    stems = Stems(least, most, stop)

    def run(calls: pa.Array) -> pa.Array:
        return pa.array([sum(len(call_set(text, stems)) for _, text in each) for each in document_calls(calls)], pa.int32())

    return run


def tallier(least: int, most: int, stop: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(calls) -> (term, df, docs, length): rows to be added up by term; those without a term have documents and their lengths."""

    def rows(terms: list[str | None], *counts: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array(c, pa.int64()) for c in counts)], ["term", "df", "docs", "length"])

    def found(counts: Counter) -> pa.RecordBatch:
        return rows(list(counts), list(counts.values()), *[[0] * len(counts)] * 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems, counts = Stems(least, most, stop), Counter()
        for batch in batches:
            length = 0
            for calls in document_calls(batch.column(0)):
                sets = [call_set(text, stems) for _, text in calls]
                length += sum(map(len, sets))
                counts.update(set().union(*sets))
                if len(counts) >= MOST_COUNTS:
                    yield found(counts)
                    counts.clear()
            yield rows([None], [0], [batch.num_rows], [length])
        yield found(counts)

    return run
