"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A 64-bit fingerprint is a set of eight positional bytes (position, value). Two fingerprints that differ in at most
`bits` bits share at least 8 - bits positional bytes. The index does not shuffle by single positional bytes, whose lists
would hold 1/256 of all fingerprints each: as prefix filters allow, a pair with that guaranteed minimum shares at
least t of the first 8 - (8 - bits) + t positions, so postings are keyed by t positional bytes at once. t follows
from the number of distinct fingerprints alone, and any t gives the same links.

Within a list, of whatever size, the members' positional bytes are indexed singly: the postings of a member's eight bytes
are tallied per partner, partners under the guaranteed minimum are dropped, and only the rest are verified bit by bit. Of a
list only a spanning forest of its links leaves the task: a walk takes each reached fingerprint against those not yet
reached, so a dense group of near copies gives one link a member. Lists over `max_list` members are split into blocks, and
each pair of blocks is a list of its own, so that no list goes to one task however many members it has. Exact copies
share a fingerprint and enter the index once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.common import cut, fields, slices, slim, utf8
from lodeseek.llm.components import called, components, dealt

_SMALL = 16


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle, repeats included; fewer words are one shingle, no words none."""
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= shingle:
        return np.array([digest(joined, 42)] if words else [], np.uint64)
    n = len(words) - shingle + 1
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: n - 1] + 1))
    return np.fromiter((digest(joined[i:j], 42) for i, j in zip(starts.tolist(), ends[shingle - 1 :].tolist())), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; 0 without any."""
    counts, step = np.zeros(2048, np.int64), 1 << 16
    for at in range(0, len(hashes), step):
        counts += np.bincount((hashes[at : at + step].view(np.uint8).reshape(-1, 8) + _POSITION).ravel(), minlength=2048)
    ones = counts.reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(2 * ones > len(hashes), axis=1, bitorder="little").tobytes(), "little")


def simhash(text: bytes | None, shingle: int = 4) -> int:
    """The unsigned fingerprint of one text (UTF-8); 0 without words."""
    return fingerprint(shingle_hashes((text or b"").lower().split(), shingle))


_POSITION = np.arange(8, dtype=np.int64) * 256
_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp long): a row for each row of docs. Null and wordless texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = np.array([simhash(t, shingle) for t in utf8(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found.view(np.int64))], names=["id", "fp"])

    rows = slim(docs, id_col, text_col)
    return rows.mapInArrow(run, fields(rows.schema["id"], "fp long"))


def index_bytes(n: int, bits: int = 4) -> int:
    """Positional bytes in a posting key: enough that n fingerprints spread over the keys' values."""
    return next((t for t in range(2, 8 - bits) if n <= 1 << (8 * t + 6)), max(1, 8 - bits))


def postings(fps: DataFrame, t: int, bits: int = 4) -> DataFrame:
    """(fp, key): a row for each t of the first bits + t positional bytes."""
    byte = [F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)) for p in range(8)]
    keys = []
    for number, chosen in enumerate(combinations(range(bits + t), t)):
        key = F.lit(number).cast("long")
        for p in chosen:
            key = F.shiftleft(key, 8).bitwiseOR(byte[p])
        keys.append(key)
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def linked_pairs(fps: DataFrame, bits: int = 4, max_list: int = 1 << 16, t: int | None = None) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) whose components are those of all links."""
    n = fps.count()
    t = t or index_bytes(n, bits)
    lists = dealt(postings(fps, t, bits), "key", "fp", F.lit(1), max_list)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_key, rest_fp = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            key = np.concatenate((rest_key, batch.column("list").to_numpy(zero_copy_only=False)))
            fp = np.concatenate((rest_fp, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)))
            if not len(key):
                continue
            whole = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
            rest_key, rest_fp = key[whole:], fp[whole:]
            yield _as_batch(list_links(key[:whole], fp[:whole], bits))
        yield _as_batch(list_links(rest_key, rest_fp, bits))

    return lists.mapInArrow(run, "a long, b long")


def _as_batch(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    sides = [np.concatenate([x[k] for x in found] or [np.empty(0, np.uint64)]).view(np.int64) for k in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in sides], names=["a", "b"])


def list_links(key: np.ndarray, fp: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links in each run of equal keys."""
    if len(key) < 2:
        return []
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(starts, len(key)))
    small = np.repeat(sizes <= _SMALL, sizes)
    found, k, f = [], key[small], fp[small]
    for shift in range(1, _SMALL):
        if shift >= len(k):
            break
        at = np.flatnonzero(k[shift:] == k[:-shift])
        if not len(at):
            break
        found.append(_links(f[at], f[at + shift], bits))
    for start, size in zip(starts[sizes > _SMALL].tolist(), sizes[sizes > _SMALL].tolist()):
        found += spanning_links(fp[start : start + size], bits)
    return found


def _links(a: np.ndarray, b: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a short list whose tally of shared positional bytes reaches the minimum, verified."""
    tally = np.zeros(len(a), np.int8)
    for p in range(8):
        tally += a.view(np.uint8)[p::8] == b.view(np.uint8)[p::8]
    able = tally >= 8 - bits
    return _verified(a[able], b[able], bits)


def _verified(a: np.ndarray, b: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    close = (np.bitwise_count(a ^ b) <= bits) & (a != b)
    return a[close], b[close]


class _Members:
    """The members of a long list that are not reached yet, indexed by positional byte."""

    def __init__(self, fp: np.ndarray):
        self.fp, self.open, self.left = fp, np.ones(len(fp), bool), len(fp)
        values = np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8)
        self.order = [np.argsort(values[:, p], kind="stable") for p in range(8)]
        self.ends = [np.searchsorted(values[o, p], np.arange(257)) for p, o in enumerate(self.order)]

    def partners(self, f: np.uint64, least: int) -> np.ndarray:
        """Places of open members that share at least `least` positional bytes with f."""
        lists = [o[e[b] : e[b + 1]] for o, e, b in zip(self.order, self.ends, f.reshape(1).view(np.uint8).tolist())]
        all_ = np.concatenate(lists)
        if 4 * len(all_) > len(self.fp):
            at = np.flatnonzero(np.bincount(all_, minlength=len(self.fp)) >= least)
        else:  # a place that stands `least` times in the sorted postings
            all_.sort()
            at = np.unique(all_[least - 1 :][all_[least - 1 :] == all_[: len(all_) - least + 1]])
        return at[self.open[at]]

    def take(self, at: np.ndarray) -> None:
        self.open[at] = False
        self.left -= len(at)


def spanning_links(fp: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links of one list."""
    found, front = [], []
    rest = _Members(np.unique(fp))
    while rest.left or front:
        if not front:
            seed = int(rest.open.argmax())
            rest.take(np.array([seed]))
            front.append(rest.fp[seed])
        if 2 * rest.left < len(rest.fp):  # what is reached already need not be tallied
            rest = _Members(rest.fp[rest.open])
        if not rest.left:
            break
        f = front.pop()
        at = rest.partners(f, 8 - bits)
        at = at[np.bitwise_count(rest.fp[at] ^ f) <= bits]
        if len(at):
            rest.take(at)
            found.append((np.full(len(at), f), rest.fp[at]))
            front += list(rest.fp[at])
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, bits: int = 4, max_list: int = 1 << 16) -> DataFrame:
    """A row for each row of docs: id_col, fp long, component_id (the least id reachable over links, its own included).

    Nulls: a null or wordless text has fingerprint 0 and links like any other; a row with a null id is returned with
    the component of its fingerprint, and counts for no component_id (null where a component has null ids only).
    Repeated rows and ids come back as often as they come in. An empty table gives no rows. Other columns are not read.
    """
    fps = cut(fingerprints(docs, id_col, text_col, shingle))
    distinct = cut(fps.groupBy("fp").agg(F.min("id").alias("component_id")))
    of = cut(called(distinct, "fp", components(linked_pairs(distinct.select("fp"), bits, max_list)), "component_id"))
    return fps.join(of.drop("root"), "fp").select("id", "fp", "component_id").withColumnRenamed("id", id_col)
