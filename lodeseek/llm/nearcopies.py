"""Near copies by similarity: SimHash links, verified, and what they leave: sets of word shingles of Jaccard similarity `least` or more.

First the SimHash operator's index (llm/simhash.py) links fingerprints of the same shingles, and its links are verified on the whole
sets. A Hamming radius cannot promise all pairs: at five-word Jaccard 0.8 about 10 of 64 bits differ on average, and the byte
index promises pairs of up to 7 differing bits only. So what is still apart is joined by prefixes. A text's sketch is the
`_SKETCH` least hashes of its set (all of a smaller set). Sketches of two sets of similarity 0.8 share at least
`_SHARED` hashes, but for a probability of about 2e-9 (of 64 draws, each shared with 0.8 or more); of small sets the bound is certain. With all hashes
ordered by the number of sketches that hold them, counted over all texts, two such sketches share one of their first size - shared + 1. So a text is
listed only under hashes that other texts hold, and only if these reach into its prefix: passages that many otherwise different
texts share are last in order and give no candidates.

Lists that still hold texts of different components chain their members into families. A family is compared in one place (a
large one in pairs of blocks): the sets' hashes are indexed, a text outside of the family's largest component is tallied against
all members by that index, and of the exact similarities that reach 0.8 a spanning forest leaves the task. So neither the
pairs of a list nor those of a group of copies are ever written out. Groups are the components of all links. Exact copies (the
same words) enter once. Shingles are held as 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.llm.common import col, cut, fields, released, slices, utf8
from lodeseek.llm.components import called, components, dealt
from lodeseek.llm.simhash import fingerprint, linked_pairs, shingle_hashes


def shingle_set(text: bytes | None, shingle: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles (a shorter text is one shingle); empty without words."""
    return np.unique(shingle_hashes((text or b"").lower().split(), shingle))


_SKETCH, _SHARED = 64, 28


def shared(n: int, percent: int) -> int:
    """What the sketch of a set of n hashes shares at least with that of any similar set."""
    if n > _SKETCH:
        return _SHARED * percent // 80
    # A larger similar set has at most n * 100 / percent hashes, of which its sketch may leave out what is over _SKETCH.
    return max(1, -(-percent * n // 100) - max(0, n * 100 // percent - _SKETCH))


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def signatures(rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(id, raw, uid, fp, n, keys, first) for (id, raw, text): the same uid for the same words, fingerprint, size of the set, sketch and prefix length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            known, found = {}, []
            for t in utf8(batch.column("text")):
                words = (t or b"").lower().split()
                uid = xxhash.xxh64_intdigest(b" ".join(words), 7)
                if uid not in known:
                    hashes = shingle_hashes(words, shingle)
                    own = np.unique(hashes)
                    keys = own[:_SKETCH].view(np.int64)
                    known[uid] = (uid, fingerprint(hashes), len(own), len(keys) - shared(len(own), percent) + 1, keys)
                found.append(known[uid])
            uid, fp = (_longs(np.array([x[k] for x in found], np.uint64)) for k in range(2))
            n, first = (pa.array([x[k] for x in found], pa.int64()) for k in (2, 3))
            keys = pa.array([x[4] for x in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("raw"), uid, fp, n, first, keys], names=["id", "raw", "uid", "fp", "n", "first", "keys"])

    return rows.mapInArrow(run, fields(rows.schema["id"], "raw long, uid long, fp long, n long, first long, keys array<long>"))


_FEW = 100_000


def _sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(uid, found binary): the words of the wanted texts (id, raw, uid), packed, a row each."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = pa.array([zlib.compress(b" ".join((t or b"").lower().split()), 1) for t in utf8(batch.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("uid"), found], names=["uid", "found"])

    few = _small(wanted.select("id", "raw", "uid"))
    return rows.join(few, ["id", "raw"]).select("uid", "text").mapInArrow(packed, "uid long, found binary").dropDuplicates(["uid"])


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= _FEW else df


def _verified(pairs: DataFrame, sets: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b: uids) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {}

        def whole(x: bytes) -> np.ndarray:
            if x not in known:
                if len(known) >= 64:
                    known.pop(next(iter(known)))
                known[x] = shingle_set(zlib.decompress(x), shingle)
            return known[x]

        for batch in batches:
            close = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = whole(x.as_py()), whole(y.as_py())
                both = len(x) + len(y) - len(np.union1d(x, y))
                close.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(close, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])

    few = _small(cut(pairs.distinct()))
    x = sets.select(F.col("uid").alias("a"), F.col("found").alias("x"))
    y = sets.select(F.col("uid").alias("b"), F.col("found").alias("y"))
    return x.join(few, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _lists(texts: DataFrame) -> DataFrame:
    """(key, uid): each text under the hashes of its prefix that other texts hold too."""
    postings = texts.select(F.explode("keys").alias("key"), "uid", (F.size("keys") - F.col("first")).alias("spare")).repartition("key")
    several = postings.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1")
    held = postings.join(several, "key")
    # Of a sketch's hashes the last `spare` in order are not in its prefix; hashes of its own alone come first.
    order = Window.partitionBy("uid").orderBy(F.desc("df"), F.desc("key"))
    return held.withColumn("at", F.row_number().over(order)).filter("at > spare").select("key", "uid")


def spanning_links(uids: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between members of different roots, enough to join all that similar members join."""
    many = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(codes, kind="stable")
    owners = np.repeat(np.arange(len(sets), dtype=np.int32), many)[order]
    ends = np.concatenate(([0], np.cumsum(np.bincount(codes))))
    starts = np.concatenate(([0], np.cumsum(many)))
    of = np.unique(roots, return_inverse=True)[1]
    sizes, found = np.bincount(of), []
    waiting = np.ones(len(sets), bool)
    # Who still waits at the end is in one component with all others that wait; who is near any of them has found it.
    while len(out := np.flatnonzero(waiting & (of != sizes.argmax()))):
        x = out[0]
        waiting[x] = False
        both = np.bincount(np.concatenate([owners[ends[c] : ends[c + 1]] for c in codes[starts[x] : starts[x + 1]]]), minlength=len(sets))
        near = np.flatnonzero((100 * both >= percent * (many[x] + many - both)) & (of != of[x]))
        for other, at in zip(*np.unique(of[near], return_index=True)):
            found.append((uids[x], uids[near[at]]))
            sizes[of[x]] += sizes[other]
            sizes[other] = 0
            of[of == other] = of[x]
    return found


def _family_links(families: DataFrame, shingle: int, percent: int, most: int) -> DataFrame:
    """(a, b) of families (family, uid, root, n, found); a block of a family has about `most` hashes."""
    lists = dealt(families, "family", "uid", F.col("n"), most).select("list", "uid", "root", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def links() -> pa.RecordBatch:
            known = {u: (r, shingle_set(zlib.decompress(x), shingle)) for u, r, x in held}  # pairs of a block with itself come twice
            uids = np.array(list(known), np.int64)
            got = spanning_links(uids, np.array([r for r, _ in known.values()], np.int64), [s for _, s in known.values()], percent) if len(known) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([int(x[k]) for x in got], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for key, *row in zip(*(batch.column(c).to_pylist() for c in ("list", "uid", "root", "found"))):
                if key != now:
                    if len(held) > 1:
                        yield links()
                    now, held = key, []
                held.append(row)
        yield links()
        released()

    return lists.mapInArrow(run, "a long, b long")


def similar_links(rows: DataFrame, texts: DataFrame, shingle: int = 5, percent: int = 80, most: int = 1 << 20, bits: int = 4) -> DataFrame:
    """(node, root) of the components of all pairs of texts with similarity of percent or more. texts: (uid, id, raw, fp, n, first, keys), a row a uid.

    most and bits change the work, not the components.
    """
    lists = cut(_lists(texts))
    sets = cut(_sets(rows, cut(texts.select("uid", "id", "raw").join(lists.select("uid").distinct(), "uid", "left_semi"))))
    # Links of SimHash: of fingerprints that are near each other, and of texts with one fingerprint.
    named = cut(texts.groupBy("fp").agg(F.min("uid").alias("uid")))
    near = linked_pairs(named.select("fp"), bits)
    for side in ("a", "b"):
        near = near.join(named.select(F.col("fp").alias(side), F.col("uid").alias(f"{side}_uid")), side)
    same = texts.select("fp", F.col("uid").alias("b_uid")).join(named.withColumnRenamed("uid", "a_uid"), "fp").filter("a_uid != b_uid")
    pairs = near.select("a_uid", "b_uid").unionByName(same.select("a_uid", "b_uid"))
    pairs = pairs.select(F.least("a_uid", "b_uid").alias("a"), F.greatest("a_uid", "b_uid").alias("b"))
    roots = components(_verified(pairs, sets, shingle, percent))
    rooted = lists.join(roots.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    several = rooted.groupBy("key").agg(F.min("root").alias("p"), F.max("root").alias("q"), F.min("uid").alias("first")).filter("p != q")
    mixed = cut(rooted.join(several.select("key", "first"), "key"))
    if mixed.isEmpty():
        return roots
    families = components(mixed.select(F.col("uid").alias("a"), F.col("first").alias("b"))).select(F.col("node").alias("uid"), F.col("root").alias("family"))
    members = mixed.select("uid", "root").distinct().join(families, "uid").join(texts.select("uid", "n"), "uid").join(sets, "uid")
    links = _family_links(members.select("family", "uid", "root", "n", "found"), shingle, percent, most)
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, most: int = 1 << 20) -> DataFrame:
    """(id, raw, least) for each row of docs with an id: raw is xxhash64 of the text; least (id, raw) of the least document of its group."""
    rows = docs.filter(col(id_col).isNotNull()).select(col(id_col).alias("id"), F.xxhash64(col(text_col)).alias("raw"), col(text_col).alias("text"))
    found = cut(signatures(rows, shingle, percent))
    texts = found.groupBy("uid").agg(F.min(F.struct("id", "raw")).alias("least"), *(F.first(c).alias(c) for c in ("fp", "n", "first", "keys")))
    texts = cut(texts.select("uid", "least", "least.*", "fp", "n", "first", "keys"))
    roots = similar_links(rows, texts, shingle, percent, most)
    of = cut(called(texts.select("uid", "least"), "uid", roots, "least").drop("root"))
    return found.select("id", "raw", "uid").join(of, "uid").select("id", "raw", "least")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, most: int = 1 << 20) -> DataFrame:
    """A row for each row of docs with an id: id_col, component_id (the least id of its group of near copies).

    Null and wordless texts are copies of each other and of nothing else. Rows that share an id but not a text are texts of their
    own; repeated rows come back as often as they come in. Other columns are not read. An empty table gives no rows.
    """
    return groups(docs, id_col, text_col, shingle, percent, most).select("id", F.col("least.id").alias("component_id")).withColumnRenamed("id", id_col)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, most: int = 1 << 20) -> DataFrame:
    """docs without near copies: of each group the row with the least id stays, of the rows with that id the one of the least text hash.

    Rows without an id stay, all of them. Of rows that repeat an id and its text one stays, the one of the least hash of the
    other columns. Columns come back as they are, whatever their names. An empty table stays empty.
    """
    found = groups(docs, id_col, text_col, shingle, percent, most)
    first = found.filter((F.col("id") == F.col("least.id")) & (F.col("raw") == F.col("least.raw"))).select("id", "raw").distinct()
    others = [col(c) for c in docs.columns if c != text_col]
    rows = docs.filter(col(id_col).isNotNull()).select(
        col(id_col).alias("id"), F.xxhash64(col(text_col)).alias("raw"), F.struct(*map(col, docs.columns)).alias("row"), F.xxhash64(F.to_json(F.struct(*others))).alias("rest"))
    # Repeated rows are one before the shuffle; the join then finds the rows dealt by its own keys.
    kept = rows.groupBy("id", "raw").agg(F.min_by("row", "rest").alias("row")).join(first, ["id", "raw"], "left_semi")
    return kept.select("row.*").unionByName(docs.filter(col(id_col).isNull()))
