"""URL filters: listed rules first, then a path-template tree per host.

Each host's paths form a tree of segments, made lexically plain first (digit runs, long hexadecimal), that is generalised level by
level. Below a branch, a segment stays a literal branch where it carries a fair share of the branch's urls, and all others
become the wildcard branch `*`. Literal branches with enough labels are then put in order of their labelled block rates, and neighbours whose
rates do not differ significantly are merged into one. The next level is counted below the branches so named, so what
stands under a wildcard or a merged branch is pooled. A template, the branch names of a whole path, is rejected when its smoothed
labelled purity, blocked / (labelled + prior), is high enough. Labels come from the listed rules, so the tree carries
their judgement to urls that no rule fits.

All counting is on (host, path) groups aggregated where they are read; a host with a third of all urls is one key of
pre-aggregated sums. A branch has at most 1 / share literal branches, so its merging looks at a bounded list, and names go back to
their paths in a join whose small side is broadcast only after its size is checked; else it is one that a skewed key splits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.common import col, cut

RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null without one. rules: a short list of (verdict, host, path)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, of, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):  # the longest ends up outermost
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        name, verdict = F.when(fits, of + start).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def plain_segments(path: Column, max_depth: int) -> Column:
    """The path's segments, lexically plain; what is deeper than max_depth is one segment `**`."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    plain = F.transform(parts, lambda s: F.regexp_replace(F.regexp_replace(s, r"[0-9a-fA-F-]{16,}", "#"), r"[0-9]+", "#"))
    return F.when(F.size(plain) > max_depth, F.concat(F.slice(plain, 1, max_depth), F.array(F.lit("**")))).otherwise(plain)


_FEW = 100_000
_SUMS = ("n", "labelled", "blocked")


def _small(df: DataFrame) -> DataFrame:
    df = cut(df)
    return F.broadcast(df) if df.count() <= _FEW else df


def _merged(rated: Column, z: float) -> Column:
    """Branches (rate, seg, labelled, blocked) as (seg, name): neighbours in order of rate whose pooled test finds no difference share a name."""
    start = F.struct(F.lit(0).cast("long").alias("labelled"), F.lit(0).cast("long").alias("blocked"), F.lit(0).alias("group"), F.array().cast("array<struct<seg:string,name:string>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        labelled, blocked = s["labelled"] + x["labelled"], s["blocked"] + x["blocked"]
        pooled = blocked / labelled
        spread = F.sqrt(pooled * (1 - pooled) * (1 / s["labelled"].cast("double") + 1 / x["labelled"].cast("double")))
        same = (s["labelled"] > 0) & (F.abs(x["rate"] - F.try_divide(s["blocked"], s["labelled"])) <= z * spread)
        group = s["group"] + F.when(same, 0).otherwise(1)
        named = F.struct(x["seg"].alias("seg"), F.concat(F.lit("~"), group.cast("string")).alias("name"))
        return F.struct(
            F.when(same, labelled).otherwise(x["labelled"]).alias("labelled"), F.when(same, blocked).otherwise(x["blocked"]).alias("blocked"), group.alias("group"), F.concat(s["out"], F.array(named)).alias("out"))

    return F.aggregate(F.array_sort(rated), start, step)["out"]


def rejected_paths(paths: DataFrame, share: float, least: int, z: float, prior: float, purity: float) -> DataFrame:
    """(host, segs) of the rejected templates. paths: host, segs (array), n, labelled, blocked, a row a path."""
    sums = [F.sum(c).alias(c) for c in _SUMS]
    at = cut(paths.filter(F.size("segs") > 0).withColumn("above", F.array().cast("array<string>")))
    deepest = at.agg(F.max(F.size("segs"))).first()[0] or 0
    for d in range(deepest):
        here = at.filter(F.size("segs") > d).withColumn("seg", F.col("segs")[d])
        total = here.groupBy("host", "above").agg(F.sum("n").alias("total"))
        nodes = here.groupBy("host", "above", "seg").agg(*sums).filter(F.col("n") >= least)
        literal = nodes.join(_small(total), ["host", "above"]).filter(F.col("n") >= F.lit(share) * F.col("total"))
        enough = F.col("labelled") >= least
        branch = F.struct((F.col("blocked") / F.col("labelled").cast("double")).alias("rate"), "seg", "labelled", "blocked")
        lists = literal.groupBy("host", "above").agg(F.collect_list(F.when(enough, branch)).alias("rated"), F.collect_list(F.when(~enough, F.struct("seg", F.concat(F.lit("="), "seg").alias("name")))).alias("own"))
        names = lists.select("host", "above", F.inline(F.concat("own", _merged(F.col("rated"), z))))
        seg = F.when(F.size("segs") > d, F.col("segs")[d])
        at = at.withColumn("seg", seg).join(_small(names), ["host", "above", "seg"], "left")
        grown = F.concat("above", F.array(F.coalesce("name", F.lit("*"))))
        at = cut(at.withColumn("above", F.when(F.col("seg").isNotNull(), grown).otherwise(F.col("above"))).select(*paths.columns, "above"))
    judged = at.groupBy("host", "above").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    bad = judged.filter(F.col("blocked") / (F.col("labelled") + prior) >= purity).select("host", "above")
    return at.join(_small(bad), ["host", "above"], "left_semi").select("host", "segs")


def url_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, max_depth: int = 16, share: float = 0.01, least: int = 5, z: float = 1.96, prior: float = 2.0, purity: float = 0.8) -> DataFrame:
    """A row for each row of pages: id_col, host, path, rule (null without one), verdict (allow or block).

    A null url, or one without ://, has an empty host and path; no rule fits it and it is allowed. Null and repeated ids come
    back as they are; an empty table gives no rows; other columns are not read. What is deeper than max_depth segments is one segment.
    """
    url = col(url_col)
    split = pages.select(col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    split = split.select("*", rule.alias("rule"), verdict.alias("listed"))
    segs = plain_segments(F.col("path"), max_depth)
    paths = split.groupBy("host", segs.alias("segs")).agg(
        F.count("*").alias("n"), F.count("listed").alias("labelled"), F.count_if(F.col("listed") == "block").alias("blocked"))
    bad = _small(rejected_paths(paths, share, least, z, prior, purity)).withColumn("bad", F.lit(True))
    ruled = split.filter(F.col("rule").isNotNull()).select("id", "host", "path", "rule", F.col("listed").alias("verdict"))
    others = split.filter(F.col("rule").isNull()).withColumn("segs", segs).join(bad, ["host", "segs"], "left")
    others = others.select("id", "host", "path", "rule", F.when(F.col("bad"), "block").otherwise("allow").alias("verdict"))
    return ruled.unionByName(others).withColumnRenamed("id", id_col)
