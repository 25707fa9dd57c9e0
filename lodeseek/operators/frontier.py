"""The crawl frontier as tables: admission, order, politeness, limits, and one crawl round as a set-based job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.functions.urls import domain_mt, is_acceptable, is_normalisable_mt, url_domain, url_normalize, url_normalize_mt
from lodeseek.operators.robots import delay_ms, robots_allowed

PRIORITIES = {"SEED": 0, "HIGH": 1, "NORMAL": 2, "LOW": 3}
MAX_PAGES_PER_DOMAIN = 50


def admitted(urls: DataFrame, seen: DataFrame | None = None, mt: bool = False, url: str = "url", order: str = "seq") -> DataFrame:
    """New frontier entries (url, domain, priority, seq): normalised, valid, unseen, the first arrival of each. urls: url, priority, seq."""
    normal = url_normalize_mt(F.col(url)) if mt else url_normalize(F.col(url))
    rows = urls.select(normal.alias("url"), "priority", order).filter("url <> ''")
    rows = rows.withColumn("domain", domain_mt(F.col("url")) if mt else url_domain(F.col("url")))
    rows = rows.filter("domain <> ''") if mt else rows
    first = rows.groupBy("url").agg(F.min_by(F.struct("domain", "priority", order), order).alias("r")).select("url", "r.*")
    return first.join(seen.select("url").distinct(), "url", "left_anti") if seen is not None else first


def counters(urls: DataFrame, new: DataFrame, mt: bool = True, url: str = "url") -> DataFrame:
    """One row: urls_added, duplicates_rejected, invalid."""
    valid = is_normalisable_mt(F.col(url)) if mt else url_normalize(F.col(url)) != ""
    asked = urls.agg(F.count_if(valid).alias("valid"), F.count_if(~valid).alias("invalid"))
    return asked.withColumn("_one", F.lit(1)).join(new.agg(F.count("*").alias("urls_added")).withColumn("_one", F.lit(1)), "_one").select("urls_added", (F.col("valid") - F.col("urls_added")).alias("duplicates_rejected"), "invalid")


def schedule(entries: DataFrame, start_ms: int = 0, default_delay: int = 1000, mt: bool = False, order: str = "seq") -> DataFrame:
    """When each entry may be fetched: its place among its domain's entries times the domain's delay (column delay_ms if there is one)."""
    urgent = F.desc("priority") if mt else F.asc("priority")
    place = F.row_number().over(Window.partitionBy("domain").orderBy(urgent, order)) - 1
    delay = F.col("delay_ms") if "delay_ms" in entries.columns else F.lit(default_delay)
    return entries.withColumn("fetch_at", (F.lit(start_ms) + place * delay).cast("long"))


def pop_order(entries: DataFrame, mt: bool = False, order: str = "seq") -> Column:
    """Sort keys of the queue: single-threaded, the lower priority number first; multi-threaded, the higher."""
    return [F.desc("priority") if mt else F.asc("priority"), F.asc(order)]


def next_url(entries: DataFrame, limited: DataFrame, order: str = "seq") -> DataFrame:
    """The best entry whose domain is not in limited(domain)."""
    return entries.join(limited.select("domain").distinct(), "domain", "left_anti").orderBy(*pop_order(entries, order=order)).limit(1)


def domain_capped(pages: DataFrame, most: int = MAX_PAGES_PER_DOMAIN, domain: str = "domain", order: str = "page_id") -> DataFrame:
    """The first `most` pages of each domain. Ranks stop being kept at `most`, so a large domain is cut before its rows are gathered."""
    rank = F.row_number().over(Window.partitionBy(domain).orderBy(order))
    return pages.withColumn("_r", rank).filter(F.col("_r") <= most).drop("_r")


def top_domains(pages: DataFrame, n: int = 10, domain: str = "domain") -> DataFrame:
    return pages.groupBy(domain).agg(F.count("*").alias("n")).orderBy(F.desc("n"), domain).limit(n)


def crawl_decisions(entries: DataFrame, robots: DataFrame, crawled: DataFrame, bot: str, most: int = MAX_PAGES_PER_DOMAIN) -> DataFrame:
    """entries with decision: filtered, domain limit, robots or fetch, in this order of tests. crawled: domain, n pages so far."""
    counts = crawled.groupBy("domain").agg(F.sum("n").alias("have"))
    rows = robots_allowed(entries, robots, bot).join(counts, "domain", "left")
    decision = F.when(~is_acceptable(F.col("url")), "filtered").when(F.coalesce("have", F.lit(0)) >= most, "domain limit").when(~F.col("allowed"), "robots").otherwise("fetch")
    return rows.select(*entries.columns, decision.alias("decision"), delay_ms(F.col("crawl_delay")).alias("delay_ms"))


def new_links(parsed: DataFrame, seen: DataFrame, priority: int = 2) -> DataFrame:
    """Frontier entries from the links of fetched pages: filtered, normalised, unseen."""
    links = parsed.select(F.explode("links.url").alias("url")).filter(is_acceptable(F.col("url"))).select("url", F.lit(priority).alias("priority"), F.lit(0).alias("seq"))
    return admitted(links, seen, mt=True)


def crawl_counters(decided: DataFrame) -> DataFrame:
    """One row of totals over decided(decision, status_code, content_size, links_found, links_accepted)."""
    done = (F.col("decision") == "fetch") & (F.col("status_code") == 200)
    return decided.agg(
        F.count_if(done).alias("crawled"), F.count_if((F.col("decision") == "fetch") & (F.col("status_code") != 200)).alias("failed"), F.count_if(F.col("decision") != "fetch").alias("filtered"),
        F.coalesce(F.sum(F.when(done, F.col("content_size"))), F.lit(0)).alias("bytes"), F.coalesce(F.sum("links_found"), F.lit(0)).alias("links_found"), F.coalesce(F.sum("links_accepted"), F.lit(0)).alias("links_accepted"))


def exported(entries: DataFrame, order: str = "seq") -> DataFrame:
    """Pending entries in pop order, to be saved; imported() gives them back at priority 0."""
    return entries.orderBy(*pop_order(entries, mt=True, order=order))


def imported(saved: DataFrame) -> DataFrame:
    return saved.withColumn("priority", F.lit(0))
