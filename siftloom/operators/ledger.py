"""Ledgers: seen ids, source status, query yield, deferral, authors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import CHUNK_ROWS, Running, chunk_bounds, scan

SEEN_DAYS = 45
DEFER_DAYS = 21
ROUNDS = 3


def save_seen(seen: DataFrame, fresh: DataFrame, today: Column, keep: int = SEEN_DAYS) -> DataFrame:
    """The ledger (id, first_date) with new ids under today's date, without those first seen over keep days ago."""
    both = seen.select("id", "first_date").unionByName(fresh.select("id", today.alias("first_date")))
    return both.groupBy("id").agg(F.min("first_date").alias("first_date")).where(F.datediff(today, "first_date") <= keep)


def forget_date(seen: DataFrame, date: Column) -> DataFrame:
    """The ledger without one date, whose items are then fetched anew."""
    return seen.where(F.col("first_date") != date)


def status(attempts: DataFrame, keys: tuple[str, ...] = ("source",), ord_col: str = "ord", ok_col: str = "ok", at_col: str = "at") -> DataFrame:
    """last_success, last_error and consecutive_failures of each source, from its attempts in order.

    Only two aggregates are needed: the last success, and the failures after it.
    """
    order = F.struct(ord_col)
    last_ok = F.max(F.when(F.col(ok_col), order))
    base = attempts.groupBy(*keys).agg(last_ok.alias("_ok"), F.max(F.when(F.col(ok_col), F.col(at_col))).alias("last_success"), F.max(F.when(~F.col(ok_col), F.col(at_col))).alias("last_error"))
    after = attempts.join(base, list(keys)).groupBy(*keys, "last_success", "last_error").agg(
        F.sum(F.when(~F.col(ok_col) & (F.col("_ok").isNull() | (order > F.col("_ok"))), 1).otherwise(0)).cast("int").alias("consecutive_failures")
    )
    return after


def update_status(ledger: DataFrame, run: DataFrame) -> DataFrame:
    """The ledger after one run (source, ok, at, message): a success resets the failures, a failure adds one."""
    r = run.select("source", "ok", "at", "message")
    both = ledger.join(r, "source", "full_outer")
    return both.select(
        "source", F.when(F.col("ok"), F.col("at")).otherwise(F.col("last_success")).alias("last_success"), F.when(~F.col("ok"), F.col("at")).otherwise(F.col("last_error")).alias("last_error"),
        F.when(~F.col("ok"), F.col("message")).otherwise(F.col("last_error_message")).alias("last_error_message"),
        F.when(F.col("ok"), 0).when(~F.col("ok"), F.coalesce("consecutive_failures", F.lit(0)) + 1).otherwise(F.col("consecutive_failures")).cast("int").alias("consecutive_failures"),
    )


def record_yield(ledger: DataFrame, today: DataFrame, date: Column) -> DataFrame:
    """The ledger (query, runs, items, shortlisted, last_run, last_shortlist) after a day's (query, items, shortlisted)."""
    t = today.select("query", F.col("items").alias("_i"), F.col("shortlisted").alias("_s"))
    both = ledger.join(t, "query", "full_outer")
    ran = F.col("_i").isNotNull()
    add = lambda c, d: (F.coalesce(c, F.lit(0)) + F.coalesce(d, F.lit(0))).cast("int").alias(c)
    return both.select(
        "query", (F.coalesce("runs", F.lit(0)) + ran.cast("int")).cast("int").alias("runs"), add("items", "_i"), add("shortlisted", "_s"),
        F.when(ran, date).otherwise(F.col("last_run")).alias("last_run"), F.when(F.coalesce("_s", F.lit(0)) > 0, date).otherwise(F.col("last_shortlist")).alias("last_shortlist"),
    )


def barren(ledger: DataFrame, pool: DataFrame, least: int = 5) -> DataFrame:
    """Queries that ran least times for nothing, and whether they are still in the pool."""
    dead = ledger.where((F.col("runs") >= least) & (F.col("shortlisted") == 0))
    return dead.join(pool.select("query").distinct().withColumn("in_pool", F.lit(True)), "query", "left").withColumn("in_pool", F.coalesce("in_pool", F.lit(False)))


def retirable(derived: DataFrame, ledger: DataFrame, least: int = 5) -> DataFrame:
    """Names all of whose derived queries ran least times and found nothing; a query that never ran keeps its name."""
    both = derived.select("name", "query").join(ledger.select("query", "runs", "items", "shortlisted"), "query", "left")
    sums = both.groupBy("name").agg(F.count("*").alias("queries"), F.count("runs").alias("known"), F.min(F.coalesce("runs", F.lit(0))).alias("least_runs"), F.sum(F.coalesce("items", F.lit(0))).alias("items"), F.sum(F.coalesce("shortlisted", F.lit(0))).alias("shortlisted"))
    return sums.where((F.col("known") == F.col("queries")) & (F.col("least_runs") >= least) & (F.col("shortlisted") == 0)).select("name", "queries", "items")


def plan_seen(run: DataFrame, ledger: DataFrame, today: Column, rounds: int = ROUNDS, ttl: int = DEFER_DAYS) -> DataFrame:
    """What becomes of each id: state seen or wait, attempts, stalls, gates, promoted and stalled.

    run: id, gate (null if not gated), muted. ledger: id, first, attempts, stalls, gates. An ungated id is seen. A gated
    one gains an attempt and is seen at the last round (promoted), unless it was held as thin while its source is muted and
    it is younger than ttl days: then it stalls. Ids that didn't come today wait until they are older than ttl days.
    """
    l = ledger.select("id", F.col("first").alias("_first"), F.col("attempts").alias("_att"), F.col("stalls").alias("_st"), F.col("gates").alias("_gates"))  # noqa: E741
    both = run.withColumn("_run", F.lit(True)).join(l, "id", "full_outer")
    came = F.coalesce("_run", F.lit(False))
    gated = came & F.col("gate").isNotNull()
    first = F.coalesce("_first", today)
    stall = gated & (F.col("gate") == "thin") & F.coalesce("muted", F.lit(False)) & (first >= F.date_sub(today, ttl))
    both = both.withColumns({"_came": came, "_gated": gated, "first": first, "_stall": F.coalesce(stall, F.lit(False))})
    attempts = F.coalesce("_att", F.lit(0)) + (F.col("_gated") & ~F.col("_stall")).cast("int")
    old = F.coalesce("_gates", F.create_map().cast("map<string,int>"))
    g = F.col("gate")
    gates = F.when(F.col("_gated"), F.map_concat(F.map_filter(old, lambda k, v: k != g), F.create_map(g, F.coalesce(F.try_element_at(old, g), F.lit(0)) + 1))).otherwise(old)
    both = both.withColumns({"attempts": attempts.cast("int"), "stalls": (F.coalesce("_st", F.lit(0)) + F.col("_stall").cast("int")).cast("int"), "gates": gates})
    done = F.col("_came") & (~F.col("_gated") | (~F.col("_stall") & (F.col("attempts") >= rounds)))
    state = F.when(done, "seen").when(F.col("_came") | (F.col("first") >= F.date_sub(today, ttl)), "wait")
    both = both.withColumn("state", state).where("state is not null")
    return both.select("id", "state", "first", "attempts", "stalls", "gates", ((F.col("state") == "seen") & F.col("_gated")).alias("promoted"), F.col("_stall").alias("stalled"))


def breaker(attempts: DataFrame, keys: tuple[str, ...] = ("source",), probe: int = 40, least_yield: float = 0.05, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """attempts (keys, ord, ok) with skipped: whether the source had been given up before this one, after probe tries of
    which under least_yield worked. Other sources are not affected.

    Tries, successes and the first trip are prefix scans, so a source may have any number of attempts.
    """
    bounds = chunk_bounds(attempts, "ord", chunk_rows)
    counted = scan(attempts, list(keys), "ord", {"_tries": Running("sum", F.lit(1), True), "_good": Running("sum", F.col("ok").cast("int"), True)}, bounds=bounds)
    tries, good = F.coalesce("_tries", F.lit(0)), F.coalesce("_good", F.lit(0))
    marked = counted.withColumn("_trip", ((tries >= probe) & (good < least_yield * tries)).cast("int")).drop("_tries", "_good")
    return scan(marked, list(keys), "ord", {"_tripped": Running("max", F.col("_trip"))}, bounds=bounds).withColumn("skipped", F.col("_tripped") == 1).drop("_trip", "_tripped")


def recover(attempts: DataFrame, transient: str = "50[0234]|fetch failed|timeout|reset") -> DataFrame:
    """Each source's last outcome over its rounds, and whether a later round mended a first failure that was transient."""
    g = attempts.groupBy("source").agg(F.max_by("ok", "round").alias("ok"), F.max("round").alias("rounds"), F.min_by("ok", "round").alias("first_ok"), F.min_by("message", "round").alias("first_message"))
    return g.select("source", "ok", "rounds", (F.col("ok") & ~F.col("first_ok") & F.coalesce(F.col("first_message").rlike(transient), F.lit(False))).alias("recovered"))


def author_entry(ledger: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The author ledger after lookups: failed ones change nothing, pending ones count an attempt, others conclude."""
    o = outcomes.where("outcome <> 'failed'").select("platform", "author", F.col("outcome").alias("_o"), F.col("site").alias("_site"))
    both = ledger.join(o, ["platform", "author"], "full_outer")
    wait = F.col("_o") == "pending"
    return both.select(
        "platform", "author", F.when(F.col("_o").isNull(), F.col("site")).when(wait, F.col("site")).otherwise(F.col("_site")).alias("site"),
        F.when(F.col("_o").isNull(), F.coalesce("pending", F.lit(False))).otherwise(wait).alias("pending"),
        F.when(wait, F.coalesce("attempts", F.lit(0)) + 1).otherwise(F.coalesce("attempts", F.lit(0))).cast("int").alias("attempts"),
    )


def needs_query(authors: DataFrame, ledger: DataFrame, most: int = 3) -> DataFrame:
    """Authors without an entry, or with one that is pending after fewer than most attempts."""
    done = ledger.where(~F.coalesce("pending", F.lit(False)) | (F.coalesce("attempts", F.lit(0)) >= most))
    return authors.join(done.select("platform", "author"), ["platform", "author"], "left_anti")
