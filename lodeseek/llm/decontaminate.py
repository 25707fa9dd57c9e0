"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

A window is `width` consecutive words of an item, or the whole of a shorter item. Its words are read as shingles of two
(a one-word window is its own shingle). Exact containment needs every shingle of a window, so one necessary prefix token
is enough: the rarest, by counts over all documents. Documents are probed with these tokens; where one occurs, its
offset in the window and the window's length bound the only place the window can stand, and the words there are compared
exactly. The benchmark is the stated query set. It is cut into blocks of at most about `block_bytes` of text, and one block at a time
is collected, indexed and broadcast, in jobs of its own: documents are read twice a block (counts, then matches). A benchmark
of one block needs no shuffle; with more, the hits of each block are stored by text digest and meet their documents in one join.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.common import boxed, col, cut, fields, slices, utf8

#: Lower-cases A-Z and blanks what is no word byte.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD_BYTES).split()


def windows(item: list[bytes], width: int) -> list[tuple[bytes, ...]]:
    return [tuple(item[i : i + width]) for i in range(max(1, len(item) - width + 1))] if item else []


def shingles(window: tuple[bytes, ...]) -> list[tuple[bytes, ...]]:
    return list(zip(window, window[1:])) if len(window) > 1 else [window]


def prefix_index(items: list[tuple[str, bytes]], width: int, counts: dict[tuple[bytes, ...], int]) -> dict:
    """First word -> shingle -> (offset, length) -> window -> ids of the items that hold it."""
    holders: dict[tuple, set[str]] = defaultdict(set)
    for item_id, text in items:
        for window in windows(words(text), width):
            holders[window].add(item_id)
    index: dict = {}
    for window, ids in holders.items():
        own = shingles(window)
        offset = min(range(len(own)), key=lambda i: (counts.get(own[i], 0), own[i], i))
        places = index.setdefault(own[offset][0], {}).setdefault(own[offset], {})
        places.setdefault((offset, len(window)), {})[window] = sorted(ids)
    return index


def matches(text: list[bytes], index: dict) -> tuple[set[tuple[int, int]], set[str]]:
    """Word spans of window occurrences, and the ids of their items."""
    spans, found, n = set(), set(), len(text)
    for i in [i for i, w in enumerate(text) if w in index]:
        by_shingle = index[text[i]]
        for shingle in ((text[i],), tuple(text[i : i + 2])):
            for (offset, length), known in by_shingle.get(shingle, {}).items():
                start = i - offset
                if start >= 0 and start + length <= n and (ids := known.get(tuple(text[start : start + length]))):
                    spans.add((start, start + length))
                    found.update(ids)
    return spans, found


def merged(spans: set[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_HITS = "array<struct<start:long,end:long>>"


def shingle_counts(texts: DataFrame, part: list[tuple[str, bytes]], width: int) -> dict[tuple[bytes, ...], int]:
    """How often each shingle of the items' windows stands in texts (text); at most one row a shingle of the items comes back."""
    held = texts.sparkSession.sparkContext.broadcast([text for _, text in part])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {s for text in held.value for w in windows(words(text), width) for s in shingles(w)}
        heads, tally = {s[0] for s in known}, Counter()
        for batch in slices(batches, "text"):
            for text in utf8(batch.column("text")):
                got = words(text)
                for i in [i for i, w in enumerate(got) if w in heads]:
                    for shingle in ((got[i],), tuple(got[i : i + 2])):
                        if shingle in known:
                            tally[shingle] += 1
        keys = list(tally)
        yield pa.RecordBatch.from_arrays([pa.array([b" ".join(k) for k in keys], pa.binary()), pa.array([tally[k] for k in keys], pa.int64())], names=["shingle", "n"])

    rows = texts.select("text").mapInArrow(count, "shingle binary, n long").groupBy("shingle").agg(F.sum("n").alias("n")).collect()
    return {tuple(bytes(r["shingle"]).split(b" ")): r["n"] for r in rows}


def _found(texts: list[list[bytes]], index: dict, width: int) -> list[tuple[list, bool, list]]:
    """(merged spans, whether a window of full width is among them, items) of each text."""
    out = []
    for text in texts:
        spans, items = matches(text, index)
        out.append((merged(spans), any(e - s == width for s, e in spans), sorted(items)))
    return out


def _columns(texts: list[list[bytes]], found: list[tuple[list, bool, list]]) -> list[pa.Array]:
    return [
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([sum(e - s for s, e in x) for x, _, _ in found], pa.int64()),
        pa.array([[{"start": s, "end": e} for s, e in x] for x, _, _ in found], _SPANS),
        pa.array([full for _, full, _ in found], pa.bool_()),
        pa.array([items for _, _, items in found], pa.list_(pa.string())),
    ]


_OUT = f"n_words long, n_hit long, hits {_HITS}, full boolean, items array<string>"
_NAMES = ["id", "n_words", "n_hit", "hits", "full", "items"]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = 13, share: int = 20, block_bytes: int = 8 << 20, carry: bool = False) -> DataFrame:
    """A row for each row of docs: id_col, n_words, n_hit (long), hits (spans of words), full, items (ids as strings, sorted), contaminated.

    full: a window of `width` words is hit; contaminated: a hit, and share * n_hit >= n_words. Null and wordless texts have no words and no hits. Items with a
    null id or without words match nothing; items that share an id count once. Repeated rows and null ids of docs come
    back as they are. An empty benchmark leaves all documents clean. Other columns are not read; with carry, id_col is
    replaced by row, a struct of all columns of docs, whatever their names. A block holds one item at least.
    """
    texts = docs.select(col(text_col).alias("text"))
    items = benchmark.select(col(item_col).cast("string").alias("item"), col(item_text).alias("text")).dropna()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))

    def indexed(b: int):
        part = [(r["item"], r["text"].encode()) for r in items.filter(block == b).collect()]
        return docs.sparkSession.sparkContext.broadcast(prefix_index(part, width, shingle_counts(texts, part, width) if part else {}))

    got = _one_block(docs, id_col, text_col, indexed(0), width, carry) if blocks == 1 else _many_blocks(docs, id_col, text_col, map(indexed, range(blocks)), width, carry)
    return got.withColumnRenamed("id", "row" if carry else id_col).withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def _one_block(docs: DataFrame, id_col: str, text_col: str, index, width: int, carry: bool) -> DataFrame:
    rows = boxed(docs).withColumnRenamed("row", "id") if carry else docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    at, heavy = docs.columns.index(text_col), "id" if carry else "text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, heavy):
            texts = [words(t) for t in utf8(batch.column("id").field(at) if carry else batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *_columns(texts, _found(texts, index.value, width))], names=_NAMES)

    return rows.mapInArrow(run, fields(rows.schema["id"], _OUT))


def _many_blocks(docs: DataFrame, id_col: str, text_col: str, indexes, width: int, carry: bool) -> DataFrame:
    """Hits depend on the text alone, so those of each block are kept by text digest, once a text, and joined at the end."""
    digest = F.md5(col(text_col).cast("binary")).alias("digest")
    texts, hits = docs.select(digest, col(text_col).alias("text")), None
    for index in indexes:

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                found = _found([words(t) for t in utf8(batch.column("text"))], index.value, width)
                hit = pa.array([bool(x[0]) for x in found])
                arrays = [batch.column("digest"), *_columns([[]] * len(found), found)[2:]]
                yield pa.RecordBatch.from_arrays([a.filter(hit) for a in arrays], names=["digest", "hits", "full", "items"])

        some = cut(texts.mapInArrow(run, f"digest string, hits {_HITS}, full boolean, items array<string>").dropDuplicates(["digest"]))
        hits = some if hits is None else hits.unionByName(some)
        index.unpersist()
    hits = hits.groupBy("digest").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.max("full").alias("full"), F.flatten(F.collect_list("items")).alias("items"))
    rows = docs.select((F.struct(*map(col, docs.columns)) if carry else col(id_col)).alias("id"), col(text_col).alias("text"), digest)
    met = rows.join(hits, "digest", "left").select("id", "text", "hits", "full", "items")

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = [words(t) for t in utf8(batch.column("text"))]
            found = [(merged({(s["start"], s["end"]) for s in x or []}), bool(full), sorted(set(items or []))) for x, full, items in zip(*(batch.column(c).to_pylist() for c in ("hits", "full", "items")))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *_columns(texts, found)], names=_NAMES)

    return met.mapInArrow(total, fields(met.schema["id"], _OUT))
