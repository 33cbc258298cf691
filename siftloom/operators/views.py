"""What readers and editors look at: filters, facets, breakdowns, diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftloom.functions.text import source_state

OTHER = "其他"
#: Kinds of sources in the order in which they are shown.
GROUPS = ("blog", "newsletter", "lab", "media", "community", "podcast", "video")


def contains_any(query: str, *fields: str) -> Column:
    """Whether a field holds the query, whatever its case; an empty query is everywhere."""
    out = F.lit(query.strip() == "")
    for f in fields:
        out = out | F.contains(F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))), F.lit(query.strip().lower()))
    return out


#: What a search in the two kinds of pages looks through.
FIELDS = ("title", "excerpt", "source", "url")
TOPIC_FIELDS = ("title", "title_original", "summary", "why_read", "source", "author")


def page_filter(
    items: DataFrame, source: str | None = None, view: str = "all", query: str = "", state: DataFrame | None = None, fields: tuple[str, ...] = FIELDS, date: str | None = None, tool: str | None = None, topic: str | None = None
) -> DataFrame:
    """Items of a source, a date, a tool and a topic (whichever are named), unread or starred or all, that hold a query in one of the fields."""
    out = items.where(contains_any(query, *fields))
    if source is not None:
        out = out.where(F.col("source") == source)
    if date is not None:
        out = out.where(F.col("date") == F.lit(date).cast(dict(items.dtypes)["date"]))
    for column, value in (("tools", tool), ("topics", topic)):
        if value is not None:
            out = out.where(F.coalesce(F.array_contains(column, value), F.lit(False)))
    if view == "unread":
        out = out.join(state.where("is_read = 1").select("id"), "id", "left_anti")
    elif view == "starred":
        out = out.join(state.where("is_starred = 1").select("id"), "id", "left_semi")
    return out


def top(items: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows by an order, with their place from 1. Only these n rows are numbered together."""
    some = items.orderBy(*order).limit(n)
    return some.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def newest(items: DataFrame) -> DataFrame:
    return items.orderBy(F.desc_nulls_last("published_at"), "id")


#: Tags of indexes that are about technology.
TECH_TAGS = "(?i)编程|技术|开发|前端|后端|运维|开源|AI|机器学习|数据|算法|安全|效率|工具|极客|Linux|云计算|架构"


def technical(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("tags").rlike(TECH_TAGS))


def enabled_sources(sources: DataFrame) -> DataFrame:
    """Sources that are switched on and have a feed or an adapter or a search to ask."""
    return sources.where(F.coalesce("enabled", F.lit(False)) & (F.coalesce("feed", F.lit("")) != ""))


def per_source(sources: DataFrame, items: DataFrame) -> DataFrame:
    """How many items each source gave, also those that gave none."""
    n = items.groupBy("source").agg(F.count("*").alias("n"))
    return sources.select(F.col("name").alias("source")).join(n, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n"))


def zero_yield(counted: DataFrame) -> DataFrame:
    return counted.where("n = 0").select("source")


def run_stats(items: DataFrame, attempts: DataFrame, errors: DataFrame) -> DataFrame:
    """One row about a run: items, seats, rejected and thin ones, enrichment attempts and successes by pass, and sources that failed.

    items: outcome, thin. attempts: pass, ok, skipped. errors: source, partial.
    """
    n = lambda test: F.count(F.when(test, 1))
    ran = ~F.col("skipped")
    of_items = items.agg(F.count("*").alias("fetched"), n(F.col("outcome") == "shortlist").alias("shortlisted"), n(F.col("outcome") != "shortlist").alias("rejected"), n(F.col("thin")).alias("thin"))
    of_tries = attempts.agg(
        n(ran & (F.col("pass") == 1)).alias("enrich_attempted"), n(ran & F.col("ok")).alias("enriched"), n(ran & (F.col("pass") == 2)).alias("retry_attempted"), n(ran & F.col("ok") & (F.col("pass") == 2)).alias("retried"), n(F.col("skipped")).alias("enrich_skipped")
    )
    return of_items.crossJoin(of_tries).crossJoin(errors.agg(n(~F.col("partial")).alias("failed_sources")))  # one row each


def panel(sources: DataFrame, items: DataFrame, status: DataFrame) -> DataFrame:
    """Sources (name, kind, enabled, disabled_reason) with their items in the window, state and note, those with most items first."""
    n = items.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n"))
    got = sources.join(n, "name", "left").join(status.select(F.col("source").alias("name"), "consecutive_failures", "last_error_message"), "name", "left")
    failures = F.coalesce("consecutive_failures", F.lit(0))
    note = F.when(~F.col("enabled"), F.coalesce("disabled_reason", F.lit("未启用"))).when(failures > 0, F.concat(F.lit("连续失败 "), failures.cast("string"), F.lit(" 次："), F.coalesce("last_error_message", F.lit("")))).otherwise("正常")
    return got.select("name", "kind", F.coalesce("n", F.lit(0)).alias("n"), source_state(failures).alias("state"), note.alias("note")).orderBy(F.desc("n"), "name")


def facets(items: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """(value, n) of an array column, the most frequent first, equal ones by value."""
    out = items.select(F.explode(column).alias("value")).groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")
    return out.limit(top) if top else out


def breakdown(items: DataFrame, top: int = 5, pinned: tuple[str, ...] = (), column: str = "source", other: str = OTHER) -> DataFrame:
    """Counts by source: the top ones and the pinned by themselves, the rest in one row that is left out if empty.

    The top ones are found by a limit, task by task, and looked up; nothing ranks all sources together.
    """
    counts = items.groupBy(column).agg(F.count("*").alias("n"))
    best = counts.orderBy(F.desc("n"), column).limit(top).select(F.col(column).alias("_best"), F.lit(True).alias("_top"))
    ranked = counts.join(F.broadcast(best), F.col(column).eqNullSafe(F.col("_best")), "left")  # top rows
    own = F.coalesce("_top", F.lit(False)) | (F.coalesce(F.col(column).isin(*pinned), F.lit(False)) if pinned else F.lit(False))
    named = ranked.select(F.when(own, F.col(column)).otherwise(F.lit(other)).alias("name"), "n")
    return named.groupBy("name").agg(F.sum("n").alias("n"))


def grouped(items: DataFrame, groups: tuple[str, ...] = GROUPS, column: str = "type") -> DataFrame:
    """Items with their group and its place: known types in a fixed order, others last."""
    known = F.col(column).isin(*groups)
    places = F.create_map(*[F.lit(x) for i, g in enumerate(groups) for x in (g, i)])
    return items.withColumns({"group": F.when(known, F.col(column)).otherwise(F.lit(OTHER)), "group_ord": F.when(known, F.try_element_at(places, F.col(column))).otherwise(F.lit(len(groups)))})


def counts_today(items: DataFrame, date: Column, key: str = "source") -> DataFrame:
    return items.groupBy(key).agg(F.sum(F.when(date, 1).otherwise(0)).alias("today"), F.count("*").alias("window"))


def reader_stats(items: DataFrame, state: DataFrame) -> DataFrame:
    got = items.join(state.select("id", "is_read", "is_starred"), "id", "left")
    return got.agg(F.count("*").alias("total"), F.sum(F.when(F.coalesce("is_read", F.lit(0)) == 0, 1).otherwise(0)).alias("unread"), F.sum(F.coalesce("is_starred", F.lit(0))).alias("starred"))


def readable_corpus(items: DataFrame, share: float = 0.5, least: int = 10) -> DataFrame:
    """Of each source: items, thin ones, readable ones, and muted: at least least items and a share of them thin."""
    g = items.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("thin").cast("int")).alias("thin"))
    return g.select("source", "n", "thin", (F.col("n") - F.col("thin")).alias("readable"), ((F.col("n") >= least) & (F.col("thin") >= share * F.col("n"))).alias("muted"))


def sampling_windows(items: DataFrame, least: int = 15, hours: float = 24.0) -> DataFrame:
    """Of each source: dated items, the hours they span, and narrow: many items within less than a day."""
    g = items.where("published_at is not null").groupBy("source").agg(F.count("*").alias("n"), ((F.unix_micros(F.max("published_at").cast("timestamp")) - F.unix_micros(F.min("published_at").cast("timestamp"))) / 3_600_000_000).alias("hours"))
    return g.withColumn("narrow", (F.col("n") >= least) & (F.col("hours") < hours))


def grade(entries: DataFrame, now: Column, body_least: int = 400) -> DataFrame:
    """Of each feed: entries, shares with a date and with a body, latest date and its age in days."""
    dated = F.avg(F.col("published_at").isNotNull().cast("double"))
    return entries.groupBy("source").agg(
        F.count("*").alias("n"), dated.alias("dated"), F.avg((F.coalesce(F.length("body"), F.lit(0)) > body_least).cast("double")).alias("with_body"), F.max("published_at").alias("latest"),
    ).withColumn("age_days", F.round((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("latest").cast("timestamp"))) / 86_400_000_000).cast("int"))


def audit(graded: DataFrame, stale: int = 60, tiny: int = 3, thin: float = 0.3) -> DataFrame:
    return graded.withColumn("problem", F.when(F.col("n") == 0, "errored").when(F.col("age_days") > stale, "stale").when(F.col("n") <= tiny, "tiny").when(F.col("with_body") < thin, "thin"))


def evaluate(entries: DataFrame, now: Column, first: int = 20, hits_least: int = 2, active_days: int = 120, media_days: int = 14) -> DataFrame:
    """Of each feed, by its first entries: whether it is active, a medium (10 or more within two weeks), and has enough hits.

    entries: source, ord, published_at, hits (number of scored matches), tools.
    """
    w = Window.partitionBy("source").orderBy("ord")
    some = entries.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= first)
    day = 86_400_000_000
    g = some.groupBy("source").agg(
        F.count("*").alias("n"), F.sum((F.col("hits") > 0).cast("int")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tools")))).alias("tools"),
        F.round((F.unix_micros(now.cast("timestamp")) - F.max(F.unix_micros(F.col("published_at").cast("timestamp")))) / day).cast("int").alias("age_days"),
        ((F.max(F.unix_micros(F.col("published_at").cast("timestamp"))) - F.min(F.unix_micros(F.col("published_at").cast("timestamp")))) / day).alias("span_days"),
    )
    why = F.when(F.coalesce(F.col("age_days") > active_days, F.lit(True)), "inactive").when((F.col("n") >= 10) & (F.col("span_days") < media_days), "media").when(F.col("hits") < hits_least, "off-topic").otherwise("good")
    return g.withColumn("verdict", why)


def length_report(lengths: DataFrame, column: str = "n_chars", low: int = 350, high: int = 500) -> DataFrame:
    """Number, least, median (rounded mean of the middle two if even), greatest, and how many are out of bounds."""
    c = F.col(column)
    return lengths.agg(F.count(c).alias("n"), F.min(c).alias("least"), F.round(F.median(c)).cast("long").alias("median"), F.max(c).alias("most"), F.sum(F.when((c < low) | (c > high), 1).otherwise(0)).alias("outliers"))


def probe(items: DataFrame, pattern: str, known: Column, scopes: tuple[str, ...] = ("title", "excerpt", "both")) -> DataFrame:
    """For each scope of text: how many items a pattern hits, of how many, and how many of the hits are known to be good."""
    both = F.concat_ws("\n", "title", "excerpt")
    rows = items.select(known.alias("known"), F.explode(F.array(*[F.struct(F.lit(s).alias("scope"), (both if s == "both" else F.col(s)).alias("text")) for s in scopes])).alias("x"))
    hit = F.coalesce(F.col("x.text").rlike(pattern), F.lit(False))
    return rows.groupBy(F.col("x.scope").alias("scope")).agg(F.count("x.text").alias("texts"), F.sum(hit.cast("int")).alias("hits"), F.sum((hit & F.col("known")).cast("int")).alias("known_hits"))


def calendar(items: DataFrame, dates: DataFrame) -> DataFrame:
    """Items and unread of each date, also of those without any."""
    g = items.groupBy("date").agg(F.count("*").alias("n"), F.sum(F.when(F.col("is_read"), 0).otherwise(1)).alias("unread"))
    return dates.join(g, "date", "left").select("date", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("unread", F.lit(0)).alias("unread"))


def authors(items: DataFrame) -> DataFrame:
    """Of each author: posts, last day, the first post's id, the best rating, and all titles and ratings in order, most posts first.

    An author's titles are what a person has published, so they make one row.
    """
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("ord", c))), lambda x: x[c])
    found = items.groupBy("author").agg(F.count("*").alias("posts"), F.max("date").alias("last_day"), F.min_by("id", "ord").alias("first_id"), F.max("rating").alias("best"), in_order("title").alias("titles"), in_order("rating").alias("ratings"))
    return found.orderBy(F.desc("posts"), "author")


def inbound(links: DataFrame, least: int = 2, top: int | None = None) -> DataFrame:
    """Hosts by how many seeds link to them, with one example."""
    g = links.groupBy("host").agg(F.count_distinct("seed").alias("links"), F.min("seed").alias("example")).where(F.col("links") >= least).orderBy(F.desc("links"), "host")
    return g.limit(top) if top else g


def assemble(decisions: DataFrame, shortlist: DataFrame) -> DataFrame:
    """A day's items: decisions (url, action, rating) on shortlisted items, those dropped left out; a decision on nothing is an error."""
    got = decisions.join(shortlist, "url", "left")
    known = got.withColumn("id", F.when(F.col("id").isNotNull(), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("no such item: "), F.col("url")))))
    return known.where("action <> 'drop'").orderBy(F.desc("rating"), F.desc("published_at"))


def missing_fields(items: DataFrame, required: tuple[str, ...], rating: str | None = None) -> DataFrame:
    """(id, field) for each required field that is null or empty, and for ratings that are no whole number from 1 to 5."""
    tests = [F.when(F.col(f).isNull() | (F.col(f).cast("string") == ""), F.lit(f)) for f in required]
    if rating:
        r = F.col(rating)
        tests.append(F.when(~F.coalesce(r.between(1, 5) & (r == F.floor(r)), F.lit(False)), F.lit(rating)))
    return items.select("id", F.explode(F.array_compact(F.array(*tests))).alias("field"))


def within(days: DataFrame, today: Column, n: int) -> DataFrame:
    """The last n days, newest first; future ones are left out."""
    age = F.datediff(today, F.col("date"))
    return days.where((age >= 0) & (age < n))


def expired(days: DataFrame, today: Column, keep: int) -> DataFrame:
    """The days that retention deletes; never future ones."""
    return days.where(F.datediff(today, F.col("date")) >= keep)
