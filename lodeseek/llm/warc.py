"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each a group of whole WARC records of about `frame_bytes`, followed by a
skippable frame with the table of frame sizes (the public seekable format), so that any record is read by one seek and
one frame. An index table maps record ids to bundle, frame and offset in the frame.

Tasks write bundles under names of their own and return the index rows; the index is committed by Spark's writer with the
rows of successful attempts only, so a file that a lost attempt left is never referred to. Payloads are digested where they
are read, and the response of equal payloads is found by an aggregation over (digest, id) alone. Only digests that repeat are
joined back to the pages: broadcast while they are few, so that no page is shuffled, and else in a join that a skewed digest splits.

The root is opened by the JVM's readers for the index and by pyarrow's filesystems for bundles; it must be a URI that both
know on driver and executors (file:// on a shared mount, hdfs://, s3://). A root without a scheme is a shared local path.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.common import col, cut, fields, new_path, slices, utf8

_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_DATE = "2024-01-01T00:00:00Z"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(key: str, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record; a revisit (payload None) keeps the HTTP head, as the identical-payload profile allows."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + (payload or b"")
    target = "".join(c for c in url or "" if c not in "\r\n") or "urn:unknown"
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{key}>", f"WARC-Target-URI: {target}",
        f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


class BundleWriter:
    def __init__(self, sink, frame_bytes: int, level: int):
        self.sink, self.frame_bytes, self.pack = sink, frame_bytes, zstandard.ZstdCompressor(level=level)
        self.buffer, self.size, self.sizes = [], 0, []

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame number, and offset in the frame."""
        if self.size and self.size + len(data) > self.frame_bytes:
            self.flush()
        at = self.size
        self.buffer.append(data)
        self.size += len(data)
        return len(self.sizes), at

    def flush(self) -> None:
        packed = self.pack.compress(b"".join(self.buffer))
        self.sink.write(packed)
        self.sizes.append((len(packed), self.size))
        self.buffer, self.size = [], 0

    def close(self) -> None:
        if self.size:
            self.flush()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes)
        self.sink.write(struct.pack("<II", _SKIPPABLE, len(table) + 9) + table + struct.pack("<IBI", len(self.sizes), 0, _SEEKABLE))
        self.sink.close()


def seek_table(source) -> list[tuple[int, int, int]]:
    """(offset, packed size, size) of each frame of a bundle."""
    end = source.size()
    source.seek(end - 9)
    n, flags, magic = struct.unpack("<IBI", source.read(9))
    if magic != _SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    source.seek(end - 9 - n * width)
    table, out, at = source.read(n * width), [], 0
    for i in range(n):
        packed, size = struct.unpack_from("<II", table, i * width)
        out.append((at, packed, size))
        at += packed
    return out


def read_frame(source, frame: tuple[int, int, int]) -> bytes:
    source.seek(frame[0])
    return zstandard.ZstdDecompressor().decompress(source.read(frame[1]), max_output_size=frame[2])


def records(data: bytes, at: int = 0) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record from at on."""
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")[1:]
        headers = dict(line.split(": ", 1) for line in lines)
        size = int(headers["Content-Length"])
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 8 + size


def write_bundles(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, bundle_bytes: int = 256 << 20, frame_bytes: int = 1 << 20, level: int = 3) -> DataFrame:
    """Writes a record for each row of pages under root, and gives the index: id, bundle, frame, offset, bytes (of the record).

    A null html is an empty payload, a null url `urn:unknown`. Of rows with equal payloads of at least `least` bytes those with
    the largest id are responses (rows that repeat it all are), the others revisit it; rows with a null id are responses.
    """
    spark = pages.sparkSession
    html = F.coalesce(col(html_col), F.lit("")).alias("html")
    slim = pages.select(col(id_col).alias("id"), col(url_col).alias("url"), html)
    digest = F.unhex(F.sha1(F.encode("html", "UTF-8")))
    named = slim.withColumn("digest", digest)
    several = named.filter(F.octet_length("html") >= least).groupBy("digest").agg(F.max("id").alias("first"), F.count("*").alias("n"))
    first = cut(several.filter("n > 1").select("digest", "first"))
    ruled = named.join(F.broadcast(first) if first.count() <= 100_000 else first, "digest", "left")
    refers = F.when((F.octet_length("html") >= least) & (F.col("id") != F.col("first")), F.col("first").cast("string"))
    rows = ruled.select("id", "url", F.when(refers.isNull(), F.col("html")).alias("html"), F.octet_length("html").cast("long").alias("size"), "digest", refers.alias("refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pyarrow.fs.FileSystem.from_uri(root)
        writer, name, written = None, "", 0
        for batch in slices(batches, "html"):
            places = []
            columns = [batch.column(c).to_pylist() for c in ("id", "url", "size", "digest", "refers")]
            for own, url, size, sha, refers_to, payload in zip(*columns, utf8(batch.column("html"))):
                if writer is None:
                    name, written = f"{uuid.uuid4().hex}.warc.zst", 0
                    writer = BundleWriter(store.open_output_stream(f"{base}/{name}", compression=None), frame_bytes, level)
                data = record(str(own), url, payload, size, base32(sha), refers_to)
                places.append((name, *writer.add(data), len(data)))
                written += len(data)
                if written >= bundle_bytes:
                    writer.close()
                    writer = None
            arrays = [batch.column("id"), *(pa.array(c, t) for c, t in zip(zip(*places), (pa.string(), pa.int32(), pa.int64(), pa.int64())))] if places else None
            if arrays:
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "bundle", "frame", "offset", "bytes"])
        if writer is not None:
            writer.close()

    store, base = pyarrow.fs.FileSystem.from_uri(root)
    store.create_dir(base, recursive=True)
    index = f"{root}/index"
    rows.mapInArrow(run, fields(rows.schema["id"], "bundle string, frame int, offset long, bytes long")).write.parquet(index)
    return spark.read.parquet(index)


def read_bundles(index: DataFrame, root: str, id_type: str = "long", task_bytes: int = 8 << 20) -> DataFrame:
    """A row for each record in the indexed bundles: id, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits).

    Frames are dealt out in runs of neighbours, to so many tasks that one has about task_bytes of records; a task opens a bundle and reads its seek table once.
    """
    size = index.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    bundles = index.select("bundle", "frame").distinct().repartition(max(1, -(-size // task_bytes)), "bundle", F.floor(F.col("frame") / 4)).sortWithinPartitions("bundle", "frame")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pyarrow.fs.FileSystem.from_uri(root)
        now, source, table = None, None, []
        for batch in batches:
            for name, frame in zip(batch.column("bundle").to_pylist(), batch.column("frame").to_pylist()):
                if name != now:
                    if source is not None:
                        source.close()
                    now, source = name, store.open_input_file(f"{base}/{name}")
                    table = seek_table(source)
                rows = []
                for headers, block in records(read_frame(source, table[frame])):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    said = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if response := headers["WARC-Type"] == "response":
                        if base32(hashlib.sha1(payload).digest()) != said:
                            raise ValueError(f"damaged record {headers['WARC-Record-ID']} in {name}")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    page = headers["WARC-Record-ID"][10:-1]
                    rows.append((None if page == "None" else page, size, said, headers["WARC-Type"], None if response else headers["WARC-Refers-To"][10:-1], payload.decode() if response else None))
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.large_string()))]
                yield pa.RecordBatch.from_arrays([*arrays[:5], arrays[5].cast(pa.string())], names=["id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
        if source is not None:
            source.close()

    found = bundles.mapInArrow(run, "id string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload string")
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("id", "refers_to")})


def fetch(place: dict, root: str) -> tuple[dict[str, str], bytes]:
    """One record, by its index row: one seek and one frame."""
    store, base = pyarrow.fs.FileSystem.from_uri(root)
    with store.open_input_file(f"{base}/{place['bundle']}") as source:
        return next(records(read_frame(source, seek_table(source)[place["frame"]]), place["offset"]))


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, root: str | None = None, **options) -> DataFrame:
    """Writes pages into bundles under root (by default in the shared folder) and reads them all back.

    A row for each row of pages, with read_bundles' columns and the id under its own name. Rows with a null id come back with
    one; an empty table gives an empty archive. Other columns are not read.
    """
    spark = pages.sparkSession
    root = root or new_path(spark, "warc")
    if "://" not in root and not root.startswith("file:"):
        root = f"file://{root}"
    index = write_bundles(pages, root, id_col, url_col, html_col, least, **options)
    kind = pages.schema[id_col].dataType.simpleString()
    return read_bundles(index, root, kind).withColumnRenamed("id", id_col)
