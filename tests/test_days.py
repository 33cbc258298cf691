"""Folds and streams over days against the daily operators run one after the other."""

import random

import pytest
from pyspark.sql import functions as F

from siftloom.operators import deferral, ledger
from siftloom.streaming import stateful

DAYS = [f"2024-01-{d:02d}" for d in range(1, 29)]


def daily_plans(spark, rows, ttl):
    """plan_seen day after day; a seen id leaves the ledger for good."""
    seen, waiting = {}, []
    for day in DAYS:
        run = [(i, g, m) for i, d, g, m in rows if d == day and i not in seen]
        kinds = "id string, first string, attempts int, stalls int, gates map<string,int>"
        plan = ledger.plan_seen(spark.createDataFrame(run, "id string, gate string, muted boolean"), spark.createDataFrame(waiting, kinds).withColumn("first", F.to_date("first")), F.lit(day).cast("date"), 3, ttl).coalesce(1).collect()
        waiting = [(r["id"], str(r["first"]), r["attempts"], r["stalls"], r["gates"]) for r in plan if r["state"] == "wait"]
        seen |= {r["id"]: (str(r["first"]), r["attempts"], r["stalls"], tuple(sorted(r["gates"].items()))) for r in plan if r["state"] == "seen"}
    return {(i, "seen", *v) for i, v in seen.items()} | {(i, "wait", f, a, s, tuple(sorted(g.items()))) for i, f, a, s, g in waiting}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = []
    for i in range(40):
        gates = rng.choice([["thin"], ["thin", "thin", "cap"], ["thin", "quota", None], ["cap", "quota"]])
        out += [(f"i{i}", d, rng.choice(gates), rng.random() < 0.8) for d in DAYS if rng.random() < (0.12, 0.5, 0.95)[i % 3]]
    return out


def test_fold_equals_daily_plans(spark, rows):
    df = spark.createDataFrame(rows, "id string, day string, gate string, muted boolean").withColumn("day", F.to_date("day")).repartition(3)
    got = deferral.fold_days(df, F.lit(DAYS[-1]).cast("date"), 3, 4).collect()
    assert {(r["id"], r["state"], str(r["first"]), r["attempts"], r["stalls"], tuple(sorted(r["gates"].items()))) for r in got} == daily_plans(spark, rows, 4)
    assert {r["state"] for r in got} == {"seen", "wait"}


@pytest.mark.parametrize("cuts", [[28], [1, 2, 9, 28]])
def test_deferral_stream_in_any_runs(spark, tmp_path, rows, cuts):
    df = spark.createDataFrame(rows, "id string, day string, gate string, muted boolean").withColumn("at", F.expr("try_to_timestamp(concat(day, 'T00:00:00Z'))"))
    parts = [df.where((F.dayofmonth("at") > a) & (F.dayofmonth("at") <= b)).drop("day") for a, b in zip([0, *cuts], cuts)]
    out = stateful.run_in_periods(parts, lambda s: stateful.deferrals(s, "at", 3, 4), str(tmp_path), "update")
    last = {r["id"]: r["s"] for r in out.groupBy("id").agg(F.max_by(F.struct("state", "first", "last", "attempts", "stalls", "gates"), "batch").alias("s")).collect()}
    fold = {r["id"]: r for r in deferral.fold_days(df.withColumn("day", F.to_date("day")), F.lit(DAYS[-1]).cast("date"), 3, 4).collect()}
    for i, r in fold.items():
        s = last[i]
        assert (s["state"], s["first"], s["last"], s["attempts"], s["stalls"]) == (r["state"], r["first"], r["last"], r["attempts"], r["stalls"])
        assert s["gates"] == ",".join(f"{g}={n}" for g, n in sorted(r["gates"].items()))
    ends = lambda s: max(s["first"].toordinal() + 5, s["last"].toordinal() + 1)
    assert all(s["state"] == "expired" or ends(s) <= fold_end() for i, s in last.items() if i not in fold)


def fold_end():
    import datetime as dt

    return dt.date.fromisoformat(DAYS[-1]).toordinal()


@pytest.mark.parametrize("cuts", [[28], [3, 4, 15, 28]])
def test_first_sights_equal_the_daily_ledger(spark, tmp_path, cuts):
    rng = random.Random(3)
    rows = [(f"i{i}", f"{d}T{rng.randrange(10, 24)}:30:00Z") for i in range(30) for d in DAYS for _ in range(2) if rng.random() < (0.1, 0.5, 0.02)[i % 3]]
    df = spark.createDataFrame(rows, "id string, t string").select("id", F.expr("try_to_timestamp(t)").alias("at"))
    known, fresh = [], set()
    for day in DAYS:
        new = sorted({i for i, t in rows if t.startswith(day)} - {i for i, _ in known})
        fresh |= {(i, day) for i in new}
        kept = ledger.save_seen(spark.createDataFrame(known, "id string, first_date string").withColumn("first_date", F.to_date("first_date")), spark.createDataFrame([(i,) for i in new], "id string"), F.lit(day).cast("date"), 6)
        known = [(r["id"], str(r["first_date"])) for r in kept.coalesce(1).collect()]
    parts = [df.where((F.dayofmonth("at") > a) & (F.dayofmonth("at") <= b)) for a, b in zip([0, *cuts], cuts)]
    out = stateful.run_in_periods(parts, lambda s: stateful.first_sights(s, "at", 6), str(tmp_path))
    assert {(r["id"], str(r["first_date"])) for r in out.collect()} == fresh and out.count() == len(fresh)
