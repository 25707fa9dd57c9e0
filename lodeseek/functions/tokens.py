"""Tokens with their places, made where a text lies: a token's place needs its own document alone, so nothing is shuffled or sorted.

Cells of whole pieces of text are worked on at once, over Arrow batches; a piece ends between tokens, so a long document is cut too.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

import lodeseek

# Workers get the functions by value, so that an executor without this package can run them.
cloudpickle.register_pickle_by_value(lodeseek)

PIECE = 1 << 20
NO_WORD = re.compile(rb"[^A-Za-z0-9]")


def tokenizer(least: int, most: int, stop: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, text) -> (key, position, original, char_offset, token)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_ = np.arange(256, dtype="uint8")
        upper = (bytes_ >= 65) & (bytes_ <= 90)
        lower = np.where(upper, bytes_ + 32, bytes_).astype("uint8")
        in_word = upper | (bytes_ >= 97) & (bytes_ <= 122) | (bytes_ >= 48) & (bytes_ <= 57)
        stops = pa.array(stop, pa.string())
        for batch in batches:
            if not batch.num_rows:
                continue
            column = pc.fill_null(batch.column(1).cast(pa.large_binary()), b"")
            _, starts, data = column.buffers()
            starts = np.frombuffer(starts, "int64")[column.offset : column.offset + len(column) + 1]
            view = np.frombuffer(data or b"", "uint8")
            at, end, owner, before = int(starts[0]), int(starts[-1]), -1, 0
            while at < end:
                cut = NO_WORD.search(view, at + PIECE, end) if at + PIECE < end else None
                cut = cut.start() if cut else end
                piece = view[at:cut]
                word = in_word[piece]
                edges = starts[(starts > at) & (starts < cut)] - at
                opens, closes = word.copy(), word.copy()
                opens[1:] &= ~word[:-1]
                closes[:-1] &= ~word[1:]
                opens[edges], closes[edges - 1] = word[edges], word[edges - 1]
                first = np.flatnonzero(opens)
                sizes = np.flatnonzero(closes) + 1 - first
                fit = (sizes >= least) & (sizes <= most)
                first, sizes = first[fit], sizes[fit]
                ends = np.zeros(len(first) + 1, "int64")
                np.cumsum(sizes, out=ends[1:])
                letters = piece[np.repeat(first - ends[:-1], sizes) + np.arange(ends[-1])]
                words = lambda cells: pa.StringArray.from_buffers(len(first), pa.py_buffer(ends.astype("int32")), pa.py_buffer(cells))  # noqa: B023, E731
                originals, tokens = words(letters), words(lower[letters])
                kept = pc.invert(pc.is_in(tokens, value_set=stops))
                first = first[kept.to_numpy(zero_copy_only=False)] + at
                if len(first):
                    owners = np.searchsorted(starts, first, "right") - 1
                    heads = np.concatenate(([0], np.flatnonzero(np.diff(owners)) + 1))
                    runs = np.diff(np.append(heads, len(owners)))
                    positions = np.arange(len(owners)) - np.repeat(heads, runs)
                    if owners[0] == owner:
                        positions[: runs[0]] += before
                    owner, before = owners[-1], int(positions[-1]) + 1
                    columns = [batch.column(0).take(pa.array(owners)), pa.array(positions.astype("int32")), originals.filter(kept), pa.array((first - starts[owners]).astype("int32")), tokens.filter(kept)]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "position", "original", "char_offset", "token"])
                at = cut

    return run
