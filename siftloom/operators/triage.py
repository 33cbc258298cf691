"""Allocating a limited list: best copy of a title, thin share, forum share, two rounds of quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from siftloom.sources.shared import written

from .scan import Running, scan

#: Why a row that could have had a seat has none.
GATES = ("thin", "quota", "forum-share", "cap")


def best_copies(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """copy_rank: 1 for the best row of a title_key: readable, then score, then time, then order. Empty keys all get 1."""
    alone = F.when(F.col("title_key") == "", F.col("ord"))
    w = Window.partitionBy(*keys, "title_key", alone).orderBy(F.col("thin").asc(), F.col("score").desc(), F.col("published_at").desc(), F.col("ord").asc())
    return df.withColumn("copy_rank", F.row_number().over(w))


def two_round_quota(df: DataFrame, quota: int, limit: int, group: str = "source", keys: tuple[str, ...] = ()) -> DataFrame:
    """The limit best rows with at most quota a group, filled up with at most as many again; seat numbers them.

    Without keys the best rows are taken by a limit before these few are numbered together.
    """
    df = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, group).orderBy(F.col("score").desc(), "ord"))).where(F.col("_rn") <= 2 * quota)
    best = (F.col("_rn") > quota, F.col("score").desc(), F.col("ord"))
    if not keys:
        df = df.orderBy(*best).limit(limit)
    return df.withColumn("seat", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).where(F.col("seat") <= limit).drop("_rn")


def _thin_share(live: DataFrame, run: str, share: float) -> DataFrame:
    """(run, score, _out, _edge, _left): for each score of live thin rows whether rows of it are beyond the share of thin rows, or some of them
    are: all but the _left first in order.

    Rows are counted by score. A score is a small whole number, so there are few of them.
    """
    thin = live.where("thin").groupBy(run, "score").agg(F.count("*").alias("_n"))
    above = F.coalesce(F.sum("_n").over(Window.partitionBy(run).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    most = live.groupBy(run).agg(F.greatest(F.lit(3), F.round(F.count(F.when(~F.col("thin"), 1)) * share / (1 - share))).cast("long").alias("_most"))
    placed = thin.withColumn("_above", above).join(most, run)
    left = F.col("_most") - F.col("_above")
    return placed.select(run, "score", (left <= 0).alias("_out"), ((left > 0) & (left < F.col("_n"))).alias("_edge"), left.alias("_left"))


def _seats(live: DataFrame, run: str, cap: int, quota: int, forum_share: float) -> DataFrame:
    """(run, ord, source, seat) of the rows that get seats.

    Only the 2 * quota best of each source, and of these the cap best articles and cap best threads of a run, are ever ranked together: both ranks
    are filters, which tasks apply before rows move.
    """
    of_source = Window.partitionBy(run, "source").orderBy(F.col("score").desc(), "ord")
    best = live.select(run, "source", "thread", "score", "ord").withColumn("_rn", F.row_number().over(of_source)).where(F.col("_rn") <= 2 * quota)
    of_kind = Window.partitionBy(run, "thread").orderBy(F.col("_rn") > quota, F.col("score").desc(), "ord")
    best = best.withColumn("seat", F.row_number().over(of_kind)).where(F.col("seat") <= cap)
    forum = live.groupBy(run).agg(F.least(F.count(F.when(F.col("thread"), 1)), F.greatest(F.lit(6), F.round(F.lit(cap * forum_share)))).alias("_reserve"))
    few = best.join(forum, run).withColumn("_article", ~F.col("thread") & (F.col("seat") <= cap - F.col("_reserve")))
    few = few.withColumn("_ta", F.sum(F.col("_article").cast("int")).over(Window.partitionBy(run)))  # 2 * cap rows of a run at most
    budget = F.least(F.greatest(F.lit(6), F.least(F.col("_reserve"), F.round(F.col("_ta") * forum_share / (1 - forum_share)))), F.lit(cap) - F.col("_ta"))
    return few.where(F.col("_article") | (F.col("thread") & (F.col("seat") <= budget))).select(run, "ord", "source", "seat")


def triage(scored: DataFrame, cap: int = 60, quota: int = 8, forum_share: float = 0.4, thin_share: float = 0.25, run: str = "run", published: DataFrame | None = None) -> DataFrame:
    """(run, id, source, thread, thin, score, ord) of each row of scored with why, outcome (shortlist or rejected), gate and seat, for each
    run by itself. Only these narrow columns are dealt out, and they are written once, so that items are scored once; join texts back by run and id.

    scored: run, id, source, thread, summary_page, thin, title_key, score, verdict, published_at, ord (a number, one row each in a run). A row is
    rejected for being a summary page, for a title already published, for its verdict, as a copy, then as thin beyond the share; the rest
    get seats: articles all but the forum's reserve, the forum its share of what articles took, each source quota and then as many again. Only
    thin, quota, forum-share and cap are gates. No row is lost.

    A run may have any number of rows: copies are told by the best row of each title, thin rows by counts of their scores, seats by rank filters, and
    the gates of those without a seat by what their source got. Each is an aggregation or a filter, joined back to the rows.
    """
    df = scored.select(run, "id", "source", "thread", "summary_page", "thin", "title_key", "score", "verdict", "published_at", "ord")
    if published is not None:
        df = df.join(published.select("title_key").distinct().withColumn("_published", F.lit(True)), "title_key", "left")
    else:
        df = df.withColumn("_published", F.lit(None).cast("boolean"))
    early = F.when(F.coalesce("summary_page", F.lit(False)), "summary-page").when((F.col("title_key") != "") & F.coalesce("_published", F.lit(False)), "published").when(F.col("verdict") != "shortlist", "verdict")
    rows = written(df.withColumn("why", early).drop("_published", "summary_page", "verdict"))

    # of each title readable rows first, then score, time and order; a missing time is the oldest
    best = F.max(F.struct(~F.col("thin"), "score", "published_at", -F.col("ord")))
    titled = rows.where((F.col("title_key") != "") & F.col("why").isNull()).groupBy(run, "title_key").agg(best["col4"].alias("_best"))
    copy = F.col("why").isNull() & (F.col("ord") != -F.col("_best"))
    rows = rows.join(titled, [run, "title_key"], "left").withColumn("why", F.when(copy, "copy").otherwise(F.col("why")))
    rows = written(rows.select(run, "id", "source", "thread", "thin", "score", "ord", "why"))

    live = rows.where("why is null")
    shares = _thin_share(live, run, thin_share)
    edge = live.where("thin").join(shares.where("_edge"), [run, "score"])
    late = scan(edge, [run], "ord", {"_place": Running("sum", F.lit(1), True)}).where(F.coalesce("_place", F.lit(0)) >= F.col("_left")).select(run, "ord", F.lit(True).alias("_late"))
    rows = rows.join(shares.select(run, "score", "_out"), [run, "score"], "left").join(late, [run, "ord"], "left")
    thin = F.col("why").isNull() & F.col("thin") & (F.coalesce("_out", F.lit(False)) | F.coalesce("_late", F.lit(False)))
    rows = written(rows.select(run, "id", "source", "thread", "thin", "score", "ord", "why", thin.alias("_thin")))

    seats = written(_seats(rows.where("why is null and not _thin"), run, cap, quota, forum_share))
    used = seats.groupBy(run, "source").agg(F.count("*").alias("_used"))
    out = rows.join(seats.select(run, "ord", "seat"), [run, "ord"], "left").join(used, [run, "source"], "left")
    chosen = F.col("seat").isNotNull()
    gate = F.when(F.col("_thin"), "thin").when(F.col("why").isNotNull() | chosen, None).when(F.coalesce("_used", F.lit(0)) >= 2 * quota, "quota").when(F.col("thread"), "forum-share").otherwise("cap")
    return out.select(run, "id", "source", "thread", "thin", "score", "ord", "why", "seat", gate.alias("gate"), F.when(chosen, "shortlist").otherwise("rejected").alias("outcome"))


def observed(triaged: DataFrame) -> tuple[DataFrame, Observation]:
    """What triage gave, with counts of it that are collected while an action on it runs, without a second pass."""
    seen = Observation("triage")
    n = lambda test: F.count(F.when(test, 1))
    told = F.col("seat").isNotNull().cast("int") + F.col("gate").isNotNull().cast("int") + F.col("why").isNotNull().cast("int")
    counts = {
        "fetched": F.count(F.lit(1)), "shortlisted": n(F.col("outcome") == "shortlist"), "rejected": n(F.col("outcome") == "rejected"), "thin": n(F.col("thin")), "unexplained": n(told != 1),
        "unseated": n((F.col("outcome") == "shortlist") & F.col("seat").isNull()), **{f"gate_{g.replace('-', '_')}": n(F.col("gate") == g) for g in GATES},
    }
    return triaged.observe(seen, *[c.alias(k) for k, c in counts.items()]), seen


def conserved(seen: Observation, fetched: int | None = None) -> dict[str, int]:
    """The counts, once an action has run; an error if a row is neither shortlisted nor rejected, is told no reason or more than one, sits without
    a seat, or if other rows came out than fetched ones went in."""
    got = dict(seen.get)
    wrong = {
        "rows that are neither shortlisted nor rejected": got["fetched"] - got["shortlisted"] - got["rejected"], "rows without one reason": got["unexplained"], "rows without a seat": got["unseated"],
        "rows lost or added": 0 if fetched is None else got["fetched"] - fetched,
    }
    if any(wrong.values()):
        raise ValueError("triage lost its balance: " + ", ".join(f"{n} {what}" for what, n in wrong.items() if n))
    return got
