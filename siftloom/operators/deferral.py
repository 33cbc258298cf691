"""Deferral over many days: what the daily plan does with an id, as one fold over all of its days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ledger import DEFER_DAYS, ROUNDS

STATE = "struct<state:string,first:int,last:int,attempts:int,stalls:int,gates:map<string,int>,promoted:boolean,stalled:boolean>"


def _step(rounds: int, ttl: int):
    def step(a: Column, x: Column) -> Column:
        # an entry past its time to live stays while its id comes each day, and goes on the first day on which it doesn't
        gone = a["state"].isNull() | ((a["state"] == "wait") & (x["day"] > F.greatest(a["first"] + ttl + 1, a["last"] + 1)))
        kept = lambda c, none: F.when(gone, none).otherwise(a[c])
        first, gated = kept("first", x["day"]), x["gate"].isNotNull()
        stall = gated & (x["gate"] == "thin") & F.coalesce(x["muted"], F.lit(False)) & (first >= x["day"] - ttl)
        attempts = kept("attempts", F.lit(0)) + (gated & ~stall).cast("int")
        old = kept("gates", F.create_map().cast("map<string,int>"))
        gates = F.when(gated, F.map_concat(F.map_filter(old, lambda k, v: k != x["gate"]), F.map_from_arrays(F.array(x["gate"]), F.array(F.coalesce(F.try_element_at(old, x["gate"]), F.lit(0)) + 1)))).otherwise(old)
        done = ~gated | (~stall & (attempts >= rounds))
        after = F.struct(
            F.when(done, "seen").otherwise("wait").alias("state"), first.alias("first"), x["day"].alias("last"), attempts.cast("int").alias("attempts"), (kept("stalls", F.lit(0)) + stall.cast("int")).cast("int").alias("stalls"),
            gates.alias("gates"), (done & gated).alias("promoted"), stall.alias("stalled"),
        ).cast(STATE)
        return F.when(a["state"] == "seen", a).otherwise(after)

    return step


def fold_days(runs: DataFrame, last_day: Column, rounds: int = ROUNDS, ttl: int = DEFER_DAYS) -> DataFrame:
    """(id, state, first, last, attempts, stalls, gates, promoted, stalled) after the runs of all days up to last_day, as that many daily plans in a
    row would leave it; state is seen or wait, and an entry that has run out is not there.

    runs: id, day, gate (null if not gated), muted; a row for each id and day. An id has a row a day at most, so its days are one short array, and
    ids are independent: one aggregation by id, whatever the number of days. An id that is seen doesn't come again; if it does, it stays seen.
    A run of several days without an id counts as as many daily runs. A null id is left out.
    """
    rows = runs.where(F.col("id").isNotNull() & (F.col("day") <= last_day)).select("id", F.struct(F.unix_date("day").alias("day"), "gate", "muted").alias("x"))
    days = rows.groupBy("id").agg(F.array_sort(F.collect_list("x")).alias("days"))
    start = F.lit(None).cast(STATE)
    end = F.unix_date(last_day)
    out = days.select("id", F.aggregate("days", start, _step(rounds, ttl)).alias("s")).select("id", "s.*")
    alive = (F.col("state") == "seen") | (F.col("last") == end) | (F.greatest(F.col("first") + ttl + 1, F.col("last") + 1) > end)
    return out.where(alive).withColumns({c: F.date_from_unix_date(c) for c in ("first", "last")})
