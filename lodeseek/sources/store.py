"""Stores: versioned index directories with an atomic pointer, key lookups and prefix scans, blobs as Zstandard Parquet."""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS, SPLITS = 64, 16
#: A merged segment has a bucket for each so many bytes, if those are more buckets than its store asks for.
BUCKET_BYTES = 256 << 20


def bucketed(postings: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    return postings.withColumn("bucket", F.pmod(F.hash("term"), F.lit(buckets)))


class IndexStore:
    """Tables of an index under root, in segments. A version is a list of segments and its statistics; one pointer file's rename publishes it.

    A later segment's documents replace those of earlier ones, which are hidden when tables are read. Appending writes the new
    documents alone. Segments are merged while one is under twice what follows it, so a document is rewritten a logarithmic number
    of times and a version has logarithmically many segments. One writer at a time; documents of null id are never replaced.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._paths(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        if not self._fs.exists(self._paths(self.root)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._paths(self.root)))

    def versions(self) -> list[str]:
        return [n for n in self._names() if n.startswith("current-")]

    def current(self) -> str | None:
        """The published version: the greatest pointer wins."""
        pointers = self.versions()
        return pointers[-1].split("-", 2)[2] if pointers else None

    def segments(self, pointer: str | None = None) -> dict[str, int]:
        """Segment -> its number of term buckets, oldest first, of a pointer (the last one)."""
        pointer = pointer or next(iter(self.versions()[::-1]), None)
        if pointer is None:
            return {}
        lines = self._text(f"{self.root}/{pointer}").split()
        return {name: int(n) for name, _, n in (line.partition(":") for line in lines)}

    def write(self, tables: dict[str, DataFrame | Callable[[Callable[[str], DataFrame]], DataFrame]], buckets: int | None = None) -> str:
        """Writes all tables, in order, to a version that nothing refers to yet; leaving it unpublished is a rollback.

        A table may be a function of a reader of those already written, so that it is derived from them, not from their sources.
        """
        version = uuid.uuid4().hex
        for name, frame in tables.items():
            path = f"{self.root}/{version}/{name}"
            frame = frame(lambda n: self._table(version, n)) if callable(frame) else frame
            if name == "postings":
                # A bucket is dealt to several tasks by document, so that a frequent term's postings are not one task's.
                frame = bucketed(frame.drop("bucket"), buckets or self.buckets)
                rows = frame.repartition(F.col("bucket"), F.pmod(F.hash("doc_id"), F.lit(SPLITS)))
                rows.sortWithinPartitions("bucket", "term", "doc_id").write.partitionBy("bucket").option("compression", "zstd").parquet(path)
            else:
                frame.write.option("compression", "zstd").parquet(path)
            # A table without rows has no files to tell its columns.
            self._put(f"{self.root}/{version}/_{name}.json", frame.schema.json())
        return version

    def _put(self, path: str, text: str) -> None:
        out = self._fs.create(self._paths(path))
        out.write(bytearray(text.encode()))
        out.close()

    def _text(self, path: str) -> str:
        source = self._fs.open(self._paths(path))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def publish(self, version: str, segments: dict[str, int] | None = None) -> None:
        """Makes version the current one; without segments it is a segment of its own."""
        pointers = self.versions()
        number = int(pointers[-1].split("-")[1]) + 1 if pointers else 0
        temporary, final = f"{self.root}/_{version}", f"{self.root}/current-{number:010d}-{version}"
        lines = "".join(f"{s}:{n}\n" for s, n in (segments or {version: self.buckets}).items())
        self._put(temporary, lines)
        if not self._fs.rename(self._paths(temporary), self._paths(final)):
            raise RuntimeError(f"cannot publish {version}")

    def commit(self, tables: dict) -> str:
        """Replaces the index by tables."""
        version = self.write(tables)
        self.publish(version)
        return version

    def append(self, tables: dict, stats: Callable[[DataFrame, DataFrame], DataFrame], keep: int = 16) -> None:
        """Adds docs, postings and terms as a segment, merges what is due, publishes with statistics made of live docs and terms.

        terms hold what the segment adds to each term's df: less than nothing where documents lost the term. Of the versions
        before, keep - 1 stay readable.
        """
        parts = self.segments() | {self.write(tables): self.buckets}
        sizes = {s: self.size(s) for s in parts}
        tail, order = sizes[list(parts)[-1]], list(parts)
        first = len(order) - 1
        while first and sizes[order[first - 1]] < 2 * tail:
            first -= 1
            tail += sizes[order[first]]
        if first < len(order) - 1:
            due = {s: parts.pop(s) for s in order[first:]}
            buckets = max(self.buckets, *due.values(), 1 << (tail // BUCKET_BYTES).bit_length() - 1 if tail >= BUCKET_BYTES else 1)
            parts[self.write({n: self.live(n, due) for n in ("docs", "postings")} | {"terms": self.live("terms", due, every=bool(parts))}, buckets)] = buckets
        self.publish(self.write({"stats": stats(self.live("docs", parts), self.live("terms", parts))}), parts)
        self.vacuum(keep)

    def vacuum(self, keep: int) -> None:
        """Removes what the last keep versions do not refer to, unpublished leavings too."""
        kept = self.versions()[-keep:]
        needed = {*kept, *(k.split("-", 2)[2] for k in kept), *(s for k in kept for s in self.segments(k))}
        for name in self._names():
            if name not in needed:
                self._fs.delete(self._paths(f"{self.root}/{name}"), True)

    def _table(self, segment: str, name: str) -> DataFrame:
        schema = StructType.fromJson(json.loads(self._text(f"{self.root}/{segment}/_{name}.json")))
        return self.spark.read.schema(schema).parquet(f"{self.root}/{segment}/{name}")

    def live(self, name: str, parts: dict[str, int], every: bool = False, words: list[str] | None = None) -> DataFrame:
        """docs, postings (of words alone, if given) or terms over segments. every keeps changes of df that are no sum yet."""
        order = list(parts)
        frames = [self._table(s, name) for s in order]
        if words is not None:
            frames = [f.filter(F.col("bucket").isin(*self._buckets(words, parts[s])) & F.col("term").isin(*words)) for s, f in zip(order, frames)]
        if name == "postings":
            frames = [f.drop("bucket") for f in frames]
        if name == "terms" and len(order) > 1:
            rows = functools.reduce(DataFrame.unionByName, frames).groupBy("term").agg(F.sum("df").alias("df"))
            return rows.filter(F.col("df") != 0 if every else F.col("df") > 0)
        # What replaces a segment's documents is at most as large as the segment.
        for i in range(len(order) - 1):
            newer = functools.reduce(DataFrame.union, [self._table(s, "docs").select("doc_id") for s in order[i + 1 :]])
            frames[i] = frames[i].join(newer, "doc_id", "left_anti").select(*frames[i].columns)
        return functools.reduce(DataFrame.unionByName, frames)

    def _published(self) -> dict[str, int]:
        parts = self.segments()
        if not parts:
            raise FileNotFoundError(f"no index published under {self.root}")
        return parts

    def read(self, name: str) -> DataFrame:
        parts = self._published()
        return self.live(name, parts) if name in ("docs", "postings", "terms") else self._table(self.current(), name)

    def _buckets(self, words: list[str], buckets: int) -> list[int]:
        return [r[0] for r in self.spark.createDataFrame([(w,) for w in words] or [("",)], "term string").select(F.pmod(F.hash("term"), F.lit(buckets))).distinct().collect()]

    def term_postings(self, words: list[str]) -> DataFrame:
        """Postings of some terms: their buckets' directories alone are read, and the terms are pushed to the scan."""
        return self.live("postings", self._published(), words=words)

    def size(self, segment: str | None = None) -> int:
        """Bytes of a segment, or of the published version."""
        names = [segment] if segment else {self.current(), *self._published()}
        return sum(self._fs.getContentSummary(self._paths(f"{self.root}/{n}")).getLength() for n in names)


def get(table: DataFrame, key: str, column: str = "key") -> DataFrame:
    return table.filter(F.col(column) == key)


def put(table: DataFrame, rows: DataFrame, column: str = "key") -> DataFrame:
    """table with rows, which replace those of equal keys."""
    return table.join(rows.select(column), column, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def remove(table: DataFrame, keys: DataFrame, column: str = "key") -> DataFrame:
    return table.join(keys.select(column), column, "left_anti").select(*table.columns)


def iterate_prefix(table: DataFrame, prefix: str, limit: int | None = None, column: str = "key") -> DataFrame:
    """Rows in key order; a limit is the early stop."""
    rows = table.filter(F.startswith(F.col(column), F.lit(prefix))).orderBy(column)
    return rows.limit(limit) if limit is not None else rows


def count_prefix(table: DataFrame, prefix: str, column: str = "key") -> DataFrame:
    return table.filter(F.startswith(F.col(column), F.lit(prefix))).agg(F.count("*").alias("n"))


def range_size(table: DataFrame, first: str, last: str, column: str = "key") -> DataFrame:
    """One row: bytes, the uncompressed size of the rows with first <= key < last. The range is pushed to the scan; 0 for an empty one."""
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)).cast("long") for c in table.columns), F.lit(0).cast("long"))
    return table.filter((F.col(column) >= first) & (F.col(column) < last)).agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def put_blobs(pages: DataFrame, path: str, key: str = "key", data: str = "data") -> None:
    """Appends blobs, compressed at rest; empty ones stay empty. Keys are hashes of the contents: equal keys hold equal blobs."""
    _append(pages.select(F.col(key).alias("key"), F.col(data).alias("data")), f"{path}/blobs")


def remove_blobs(keys: DataFrame, path: str, key: str = "key") -> None:
    """Appends tombstones, which hide what was put before them; blobs are not rewritten."""
    _append(keys.select(F.col(key).alias("key")), f"{path}/removed")


def _append(rows: DataFrame, path: str) -> None:
    rows.withColumn("at", F.unix_micros(F.current_timestamp())).write.mode("append").option("compression", "zstd").parquet(path)


def get_blobs(spark: SparkSession, path: str) -> DataFrame:
    """(key, data) of all blobs that are not removed."""
    blobs = spark.read.schema("key string, data binary, at long").parquet(f"{path}/blobs")
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/removed")
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        gone = spark.read.schema("key string, at long").parquet(f"{path}/removed").groupBy("key").agg(F.max("at").alias("until"))
        blobs = blobs.join(gone, (blobs["key"] == gone["key"]) & (blobs["at"] <= gone["until"]), "left_anti")
    return blobs.select("key", "data")


def blob_exists(spark: SparkSession, path: str, keys: DataFrame, key: str = "key") -> DataFrame:
    """keys with a column exists; contents are not read."""
    have = get_blobs(spark, path).select(F.col("key").alias("_k")).distinct()
    return keys.join(have, F.col(key) == F.col("_k"), "left").select(*keys.columns, F.col("_k").isNotNull().alias("exists"))


def compress(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(data) if data else b""


def decompress(data: bytes) -> bytes:
    """Data without the Zstandard magic comes back as it is."""
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data) if data[:4] == b"\x28\xb5\x2f\xfd" else data
