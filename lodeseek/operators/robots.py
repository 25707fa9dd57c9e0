"""Robots files as tables of agents and rules, and their judgement of URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.functions.text import to_lower
from lodeseek.functions.urls import domain_robots

_EDGES = r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+\z"
DEFAULT_DELAY_MS = 1000


def _trim(x: Column) -> Column:
    return F.regexp_replace(x, _EDGES, "")


def directives(files: DataFrame, key: str = "domain", content: str = "content") -> DataFrame:
    """(key, seq, directive, value): the meaningful lines of each file."""
    lines = F.split(F.regexp_replace(F.col(content), "\r\n?", "\n"), "\n")
    rows = files.select(key, F.posexplode(lines).alias("seq", "line")).withColumn("line", _trim(F.col("line")))
    rows = rows.filter((F.col("line") != "") & ~F.col("line").startswith("#") & F.contains("line", F.lit(":")))
    value = _trim(F.regexp_extract("line", "(?s)^[^:]*:(.*)$", 1))
    return rows.select(key, "seq", to_lower(_trim(F.regexp_extract("line", "^([^:]*):", 1))).alias("directive"), _trim(F.regexp_replace(value, "(?s)#.*$", "")).alias("value"))


def _grouped(files: DataFrame, key: str, content: str) -> DataFrame:
    """Directives with a group number: a user-agent line after a rule opens a group. Lines of one file are one bounded group."""
    rows = directives(files, key, content)
    agent, rule = F.col("directive") == "user-agent", F.col("directive").isin("allow", "disallow", "crawl-delay")
    rows = rows.filter(agent | rule)
    order = Window.partitionBy(key).orderBy("seq")
    opens = agent & (F.coalesce(F.lag("directive").over(order), F.lit("allow")) != "user-agent")
    return rows.withColumn("grp", F.sum(F.when(opens, 1).otherwise(0)).over(order))


def robots_agents(files: DataFrame, key: str = "domain", content: str = "content") -> DataFrame:
    """(key, agent, crawl_delay): each named agent once; -1 without a delay, else the last valid one."""
    rows = _grouped(files, key, content)
    agents = rows.filter("directive = 'user-agent'").select(key, "grp", to_lower(F.col("value")).alias("agent"))
    number = F.regexp_extract("value", r"^[+-]?[0-9]{1,9}", 0).try_cast("int")
    delays = rows.filter("directive = 'crawl-delay'").select(key, "grp", "seq", number.alias("delay")).filter("delay IS NOT NULL")
    joined = agents.join(delays, [key, "grp"], "left")
    return joined.groupBy(key, "agent").agg(F.coalesce(F.max_by("delay", F.col("seq")), F.lit(-1)).alias("crawl_delay"))


def robots_rules(files: DataFrame, key: str = "domain", content: str = "content") -> DataFrame:
    """(key, agent, seq, allow, path): the rules of each agent; those before any agent belong to none."""
    rows = _grouped(files, key, content)
    agents = rows.filter("directive = 'user-agent'").select(key, "grp", to_lower(F.col("value")).alias("agent")).distinct()
    rules = rows.filter("directive IN ('allow', 'disallow')").select(key, "grp", "seq", (F.col("directive") == "allow").alias("allow"), F.col("value").alias("path"))
    return agents.join(rules, [key, "grp"]).select(key, "agent", "seq", "allow", "path")


def path_of(url: Column) -> Column:
    """Path with query and fragment; the input itself if it starts with a slash."""
    rest = F.regexp_extract(url, "(?s)^.*?://[^/]*(/.*)$", 1)
    return F.when(~F.contains(url, F.lit("://")), url).when(rest == "", "/").otherwise(rest)


def matching_agent(urls: DataFrame, agents: DataFrame, bot: str, key: str = "domain") -> DataFrame:
    """urls with agent (the bot's own name, else *, else null) and crawl_delay (-1 without)."""
    own = agents.filter(F.col("agent").isin(bot.lower(), "*")).groupBy(key).agg(F.min_by(F.struct("agent", "crawl_delay"), F.when(F.col("agent") == bot.lower(), 0).otherwise(1)).alias("m"))
    return urls.join(own, key, "left").select(*urls.columns, F.col("m.agent").alias("agent"), F.coalesce("m.crawl_delay", F.lit(-1)).alias("crawl_delay"))


def robots_allowed(urls: DataFrame, files: DataFrame, bot: str, url: str = "url", key: str = "domain") -> DataFrame:
    """urls (with url and key) and allowed, crawl_delay. The longest prefix wins, allow wins ties, no rule allows."""
    named = matching_agent(urls, robots_agents(files, key), bot, key)
    rules = robots_rules(files, key).filter("path <> ''")
    # A domain's rules meet its urls as one sorted array, so nothing is multiplied by the number of rules.
    best = rules.groupBy(key, "agent").agg(F.reverse(F.array_sort(F.collect_set(F.struct(F.length("path").alias("n"), "allow", "path")))).alias("rules"))
    path = path_of(F.col(url))
    hit = F.try_element_at(F.filter("rules", lambda r: F.startswith(path, r["path"])), F.lit(1))["allow"]
    return named.join(best, [key, "agent"], "left").select(*urls.columns, F.coalesce(hit, F.lit(True)).alias("allowed"), "crawl_delay")


def robots_cache(fetches: DataFrame) -> DataFrame:
    """One file a domain: the latest of fetches(domain, fetched_at, content); a failed fetch (null content) allows all."""
    return fetches.groupBy("domain").agg(F.max_by(F.struct(F.coalesce("content", F.lit("")).alias("content")), "fetched_at").alias("r")).select("domain", "r.content")


def delay_ms(crawl_delay: Column) -> Column:
    return F.when(crawl_delay > 0, crawl_delay * 1000).otherwise(DEFAULT_DELAY_MS)


def robots_domain(url: Column) -> Column:
    return domain_robots(url)
