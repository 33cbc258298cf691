"""Collecting items: age cut, known ids, first of each id, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftloom.functions.dates import midnight
from siftloom.functions.text import utf16_length


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key. One window, with the limit pushed below the shuffle by the planner."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def collect_items(entries: DataFrame, seen: DataFrame, today: Column, max_age_days: int, ord_col: str = "ord") -> DataFrame:
    """Entries with a link, not older than max_age_days before today's first second in UTC, whose id isn't in seen, first of each id.

    entries has id, link and published_at; a missing time counts as now and always passes.
    """
    cut = midnight(F.date_sub(today, max_age_days))
    fresh = entries.where((F.col("link").isNotNull()) & (F.col("link") != "")).where(F.col("published_at").isNull() | (F.col("published_at") >= cut))
    return first_by(fresh.join(seen.select("id"), "id", "left_anti"), ["id"], ord_col)


def by_published_dates(items: DataFrame, dates: DataFrame | None, day: Column) -> DataFrame:
    """Only items of the given days; all if there are none."""
    if dates is None:
        return items
    return items.withColumn("date", day).join(dates.select("date").distinct(), "date", "left_semi").drop("date")


def accepts(old: Column, new: Column, least: int) -> Column:
    """Whether a fetched text replaces an excerpt: long enough, and at least twice as long."""
    n = utf16_length(F.coalesce(new, F.lit("")))
    return (n >= least) & (n >= 2 * utf16_length(F.coalesce(old, F.lit(""))))


def needs_enriching(excerpt: Column, is_thread: Column, least: int = 250) -> Column:
    body = F.coalesce(excerpt, F.lit(""))
    return (utf16_length(body) < least) & ~(F.coalesce(is_thread, F.lit(False)) & (body != ""))


def enrich(items: DataFrame, fetched: DataFrame, least: int = 250) -> DataFrame:
    """items with better excerpts from fetched (id, text), and thin recomputed for all."""
    better = items.join(fetched.select("id", F.col("text").alias("_new")), "id", "left")
    excerpt = F.when(accepts(F.col("excerpt"), F.col("_new"), least), F.col("_new")).otherwise(F.col("excerpt"))
    out = better.withColumn("excerpt", excerpt).drop("_new")
    return out.withColumn("thin", utf16_length(F.coalesce("excerpt", F.lit(""))) < least)


def enrich_rounds(items: DataFrame, fetched: DataFrame, least: int = 250) -> tuple[DataFrame, DataFrame]:
    """items after two passes of fetched (id, pass, text), and the attempts (id, pass, ok) that counted.

    The first pass asks for all that need it, the second only for those that the first left short.
    """
    asked = items.where(needs_enriching(F.col("excerpt"), F.col("thread"), least)).select("id")
    one = fetched.where("pass = 1").join(asked, "id", "left_semi")
    first = enrich(items, one, least)
    still = first.join(asked, "id", "left_semi").where("thin").select("id")
    two = fetched.where("pass = 2").join(still, "id", "left_semi")
    tried = items.select("id", "excerpt").join(one, "id").unionByName(first.select("id", "excerpt").join(two, "id"))
    return enrich(first, two, least), tried.select("id", "pass", accepts(F.col("excerpt"), F.col("text"), least).alias("ok"))


def select_targets(items: DataFrame, muted: DataFrame, priority: DataFrame, limit: int, ord_col: str = "ord") -> DataFrame:
    """Thin items of muted sources, those with a priority id first, then in order, limit at most."""
    first = priority.select("id").distinct().withColumn("_first", F.lit(1))
    targets = items.where("thin").join(muted.select("source").distinct(), "source", "left_semi").join(first, "id", "left")
    return targets.orderBy(F.coalesce("_first", F.lit(0)).desc(), ord_col).limit(limit).drop("_first")


def merge_longer(shortlist: DataFrame, enriched: DataFrame, least: int = 250) -> DataFrame:
    """shortlist with the excerpts of enriched (id, excerpt) that are at least least and longer."""
    got = shortlist.join(enriched.select("id", F.col("excerpt").alias("_new")), "id", "left")
    n, old = utf16_length(F.coalesce("_new", F.lit(""))), utf16_length(F.coalesce("excerpt", F.lit("")))
    return got.withColumn("excerpt", F.when((n >= least) & (n > old), F.col("_new")).otherwise(F.col("excerpt"))).drop("_new")


def merge_sources(*parts: DataFrame) -> DataFrame:
    """All rows of all parts; columns that a part lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
