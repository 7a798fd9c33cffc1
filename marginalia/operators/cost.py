"""Cost of page rescue with and without a cache, quality gates, and resumable work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import with_neighbours


def rescue_cost(
    calls: DataFrame, pages: DataFrame, latencies: DataFrame, strategies: dict[str, int], min_reduction: float, min_saving: float
) -> DataFrame:
    """One row for each strategy: unique pages and calls, seconds cached and uncached, savings, gate.

    calls(paper, query_id, indices ARRAY<INT>, n), pages(paper, page): all pages,
    latencies(paper, page, seconds): an unmeasured page costs 0. A strategy takes the indices
    with neighbours up to its radius. Cached, a page is paid once over all queries.
    """
    total = pages.join(latencies, ["paper", "page"], "left").agg(
        F.count("*").alias("all_pages"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("always")
    )
    rows = None
    for name, radius in strategies.items():
        wanted = with_neighbours(F.array_distinct("indices"), F.col("n"), radius)
        asked = calls.select(F.lit(name).alias("strategy"), "paper", "query_id", F.explode(wanted).alias("page"))
        rows = asked if rows is None else rows.unionByName(asked)
    per_page = rows.groupBy("strategy", "paper", "page").agg(F.count("*").alias("calls")).join(latencies, ["paper", "page"], "left")
    s = F.coalesce("seconds", F.lit(0.0))
    got = per_page.groupBy("strategy").agg(
        F.count("*").alias("unique_pages"),
        F.sum("calls").alias("uncached_calls"),
        F.sum(s).alias("cached"),
        F.sum(s * F.col("calls")).alias("uncached"),
    )
    reduction = 1 - F.col("unique_pages") / F.col("all_pages")

    def saving(c: str) -> Column:
        return F.when(F.col("always") > 0, 1 - F.col(c) / F.col("always")).otherwise(0.0)

    return got.crossJoin(F.broadcast(total)).select(  # total is one row
        "strategy",
        "unique_pages",
        "uncached_calls",
        F.round(reduction, 9).alias("page_reduction"),
        F.round("cached", 6).alias("cached_seconds"),
        F.round(saving("cached"), 9).alias("cached_saving"),
        F.round("uncached", 6).alias("uncached_seconds"),
        F.round(saving("uncached"), 9).alias("uncached_saving"),
        ((F.round(reduction, 9) >= min_reduction) & (F.round(saving("cached"), 9) >= min_saving)).alias("gate_passed"),
    )


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work items without a finished one of the same key."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def cache_key(parser: Column, path: Column, size: Column, modified: Column, page: Column) -> Column:
    """SHA-256 of what decides a parse: parser, path, size, time of change, page."""
    return F.sha2(F.to_json(F.struct(parser.alias("parser"), path.alias("path"), size.alias("size"), modified.alias("modified"), page.alias("page"))), 256)


def gate(**checks: Column) -> list[Column]:
    """A column for each check and gate_passed, all of them; a null check fails."""
    each = [F.coalesce(c, F.lit(False)) for c in checks.values()]
    every = each[0]
    for c in each[1:]:
        every = every & c
    return [c.alias(k) for k, c in zip(checks, each)] + [every.alias("gate_passed")]
