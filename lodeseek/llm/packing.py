"""Sum-of-squares online packing of token ids into windows.

Whole windows are cut from a document as they come. Its remainder goes to the fill level that minimises the sum of
squared counts of partially filled windows, taken over a level array: counts[h] windows hold h ids, 0 < h < capacity,
and level 0 stands for a new window. Among equals the fullest level wins. When more than `max_open` windows are open,
and at the end of a partition, the emptiest windows are cut up to fill the fullest, which leaves one partial window;
that one is cut at powers of two, which need no padding. A partition is packed on its own, in one pass over the rows
as they are read: nothing is shuffled, memory is bounded by `max_open` windows, and a lost task is simply run again
with the same result.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lodeseek.llm.common import fields, slices, slim

VOCABULARY = "byte_bpe_50k.json"


def encoder(path: str) -> Callable[[str], list[int]]:
    """Text to ids of the byte-level BPE in a `tokenizers` file, special tokens in a text included.

    Where the file's ids follow its merges, tiktoken gives the same ids several times faster; else `tokenizers` is used.
    """
    spec = json.loads(open(path, encoding="utf-8").read())
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
    if spec.get("normalizer") or not _plain(spec) or any(vocab.get(m) != 256 + i for i, m in enumerate(joined)):
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        return lambda text: slow.encode(text, add_special_tokens=False).ids
    of = {c: b for b, c in _byte_names().items()}
    ranks = {bytes(of[c] for c in piece): i for piece, i in vocab.items() if piece not in special}
    fast = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    plain, marks = fast._core_bpe.encode_ordinary, tuple(special)

    def encode(text: str) -> list[int]:
        return fast.encode(text, allowed_special="all") if any(m in text for m in marks) else plain(text)

    return encode


def _plain(spec: dict) -> bool:
    pre = spec.get("pre_tokenizer") or {}
    return pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)


def _byte_names() -> dict[int, str]:
    """The printable character that stands for each byte in such a file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in shown}
    return names | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in names)}


class Packer:
    """Packs (key, ids) into windows; `put` and `finish` give closed windows as lists of (key, start, ids)."""

    def __init__(self, capacity: int = 2048, max_open: int = 2048):
        self.capacity, self.max_open, self.open = capacity, max_open, 0
        self.counts = np.zeros(capacity + 1, np.int64)
        self.windows: list[list[list]] = [[] for _ in range(capacity)]

    def put(self, key: int, ids: np.ndarray) -> Iterator[list]:
        whole = len(ids) // self.capacity * self.capacity
        for at in range(0, whole, self.capacity):
            yield [(key, at, ids[at : at + self.capacity])]
        if len(ids) > whole:
            yield from self.place((key, whole, ids[whole:]))

    def level(self, size: int) -> int:
        """The level to place `size` ids on; 0: a new window."""
        levels = np.flatnonzero(self.counts[1 : self.capacity - size + 1]) + 1
        if not len(levels):
            return 0
        cost = 2 * (self.counts[levels + size] - self.counts[levels]) + 2
        cost[levels + size == self.capacity] -= 1
        at = len(cost) - 1 - int(cost[::-1].argmin())
        return int(levels[at]) if cost[at] <= 2 * self.counts[size] + 1 else 0

    def place(self, piece: tuple) -> Iterator[list]:
        h, size = self.level(len(piece[2])), len(piece[2])
        window = self.windows[h].pop() if h else []
        self.counts[h] -= h > 0
        self.open += h == 0
        window.append(piece)
        if h + size == self.capacity:
            self.open -= 1
            yield window
            return
        self.counts[h + size] += 1
        self.windows[h + size].append(window)
        if self.open > self.max_open:
            yield from self.merge()

    def merge(self) -> Iterator[list]:
        """Closes all open windows but one, which stays open."""
        todo = [(h, w) for h in range(1, self.capacity) for w in self.windows[h]]
        self.windows, self.open = [[] for _ in range(self.capacity)], 0
        self.counts[:] = 0
        spare: list[tuple] = []
        first, last = 0, len(todo) - 1
        while first <= last:
            fill, window = todo[last]
            last -= 1
            while fill < self.capacity:
                if not spare:
                    if first > last:
                        break
                    spare = todo[first][1][::-1]
                    first += 1
                key, start, ids = spare.pop()
                gap = self.capacity - fill
                if len(ids) > gap:
                    spare.append((key, start + gap, ids[gap:]))
                    ids = ids[:gap]
                window.append((key, start, ids))
                fill += len(ids)
            if fill == self.capacity:
                yield window
                continue
            self.keep(fill, window)
        if spare:
            self.keep(sum(len(x[2]) for x in spare), spare[::-1])

    def keep(self, fill: int, window: list) -> None:
        self.counts[fill] += 1
        self.windows[fill].append(window)
        self.open += 1

    def finish(self) -> Iterator[list]:
        yield from self.merge()
        for fill in range(1, self.capacity):
            for window in self.windows[fill]:
                pieces, parts = window[::-1], [1 << b for b in reversed(range(fill.bit_length())) if fill >> b & 1]
                for gap in parts:
                    part = []
                    while gap:
                        key, start, ids = pieces.pop()
                        if len(ids) > gap:
                            pieces.append((key, start + gap, ids[gap:]))
                            ids = ids[:gap]
                        part.append((key, start, ids))
                        gap -= len(ids)
                    yield part


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1, path: str | None = None, max_open: int = 2048) -> DataFrame:
    """id_col, start, length, doc_tokens, sequence_id, offset (long) and ids (binary, little-endian unsigned 32-bit): a row a piece.

    A null or empty text is `end_id` alone. Rows with null or repeated ids are packed like any other; so are repeated
    rows. No rows give no rows. Other columns are not read. `path`: the vocabulary file, on every machine.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    rows = slim(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, made = encoder(path), Packer(capacity, max_open), TaskContext.get().partitionId() << 32
        ids, total, alive = {}, {}, 0  # of documents with open pieces
        out: list[tuple] = []
        id_type = None

        def closed(windows: Iterator[list]) -> None:
            nonlocal made
            for window in windows:
                offset = 0
                for key, start, got in window:
                    out.append((key, start, len(got), made, offset, got.tobytes()))
                    offset += len(got)
                made += 1

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 6
            arrays = [pa.array([ids[k] for k in columns[0]], id_type), *(pa.array(c, pa.int64()) for c in (columns[1], columns[2], [total[k] for k in columns[0]], columns[3], columns[4])), pa.array(columns[5], pa.binary())]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch in slices(batches, "text", 2 << 20):
            id_type = batch.column("id").type
            for own, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                got = np.array([*encode(text or ""), end_id], "<u4")
                ids[alive], total[alive] = own, len(got)
                closed(packer.put(alive, got))
                alive += 1
            if out:
                yield batch_of()
            if len(ids) > 1 << 16:
                held = {p[0] for level in packer.windows for w in level for p in w}
                ids, total = {k: ids[k] for k in held}, {k: total[k] for k in held}
        if id_type is not None:
            closed(packer.finish())
            yield batch_of()

    found = rows.mapInArrow(run, fields(rows.schema["id"], "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"))
    return found.withColumnRenamed("id", id_col)
