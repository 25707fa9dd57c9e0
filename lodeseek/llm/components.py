"""Connected components of a link table, by alternating large-star and small-star contractions.

Links are first contracted to forests within the partitions that they are made in, so that long chains and repeated links
stay there. Each round is two aggregations and two equi-joins, so a hub with a third of all links is pre-aggregated on the
map side and split by the skew join; nothing is collected but one row of convergence figures a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.common import cut


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, least node of its component) of a partition's links."""
    least: dict[int, int] = {}
    for batch in batches:
        for pair in zip(*(batch.column(c).to_pylist() for c in ("u", "v"))):
            tops = []
            for x in pair:
                way = []
                while (up := least.get(x, x)) != x:
                    way.append(x)
                    x = up
                for y in way:
                    least[y] = x
                tops.append(x)
            if tops[0] != tops[1]:
                least[max(tops)] = min(tops)
    nodes = list(least)
    for x in sorted(nodes):  # a parent is less than its child, so it is final already
        least[x] = least.get(least[x], least[x])
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([least[x] for x in nodes], pa.int64())], names=["u", "v"])


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root): each node (long) that has a link to another, with the least node that it reaches.

    Null ends and self-links are ignored; repeated links count once; no links give no rows.
    """
    pairs = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    edges = cut(pairs.mapInArrow(forest, "u long, v long").distinct())
    before = _figures(edges)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = cut(
            small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        after = _figures(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def dealt(rows: DataFrame, key: str, member: str, weight: Column, most: int) -> DataFrame:
    """rows as lists, one after another in their partitions: a column `list` in place of key.

    A key's rows of over `most` weight are split into blocks by member, and each pair of blocks is a list of its own, so that every
    two members meet and no list grows with its key.
    """
    hot = rows.groupBy(key).agg(F.sum(weight).alias("weight")).filter(F.col("weight") > most)
    hot = cut(hot.select(key, F.ceil(F.col("weight") / most).cast("int").alias("blocks")))
    names = [c for c in rows.columns if c != key]
    if blocks := hot.count():
        # At most the whole weight / most keys are hot; they are broadcast only while that table is small.
        rows = rows.join(F.broadcast(hot) if blocks <= 100_000 else hot, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        rows = rows.withColumn("own", F.pmod(F.xxhash64(member), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select(*names, F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other")).alias("list"))
    else:
        rows = rows.withColumnRenamed(key, "list")
    return rows.repartition("list").sortWithinPartitions("list")


def _figures(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def called(rows: DataFrame, node: str, roots: DataFrame, name: str) -> DataFrame:
    """rows (node, name) -> (node, root, name): name is the least of the component; nodes without a link are roots themselves.

    A component may hold a third of all rows: names are aggregated before the shuffle, and stored, so that both sides of
    the join by root are plain exchanges and a skewed one is split.
    """
    linked = rows.join(roots.withColumnRenamed("node", node), node, "left").select(node, F.coalesce("root", node).alias("root"), name)
    linked = cut(linked)
    least = cut(linked.groupBy("root").agg(F.min(name).alias(name)))
    return linked.select(node, "root").join(least, "root").select(node, "root", name)
