"""Versions that are published whole, and the clustered ledger."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from siftloom.sources import versions
from siftloom.sources.clustered import SeenTable


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_version_may_be_made_from_the_one_before(spark, tmp_path):
    store = versions.Versions(spark, str(tmp_path / "s"))
    assert store.read("seen") is None
    assert store.commit(1, {"seen": spark.range(2).toDF("id"), "other": spark.range(1).toDF("x")})
    assert store.commit(2, {"seen": store.read("seen").unionByName(spark.range(5, 6).toDF("id"))})
    assert rows(store.read("seen")) == [(0,), (1,), (5,)] and rows(store.read("seen", 1)) == [(0,), (1,)] and rows(store.read("other")) == [(0,)]
    assert not store.commit(2, {"seen": spark.range(9).toDF("id")}) and rows(store.read("seen")) == [(0,), (1,), (5,)]
    with pytest.raises(ValueError):
        store.commit(0, {})
    assert store.numbers() == [1, 2] and store.read("nothing") is None


def test_a_writer_that_fails_between_parts_changes_nothing(spark, tmp_path):
    store = versions.Versions(spark, str(tmp_path / "s"))
    store.commit(1, {"a": spark.range(1).toDF("id"), "b": spark.range(1).toDF("id")})
    broken = spark.range(3).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        store.commit(2, {"a": spark.range(7).toDF("id"), "b": broken})
    assert store.numbers() == [1] and rows(store.read("a")) == rows(store.read("b")) == [(0,)]
    assert store.commit(2, {"a": spark.range(2).toDF("id"), "b": spark.range(2).toDF("id")})
    gone = store.clean(keep=1)
    assert len(gone) == 4 or len(gone) == 3  # two of version 1, and what the lost writer left
    assert rows(store.read("a")) == [(0,), (1,)] and store.numbers() == [2]


def test_only_one_of_two_writers_publishes(spark, tmp_path):
    a, b = (versions.Versions(spark, str(tmp_path / "s")) for _ in range(2))
    assert a.commit(1, {"x": spark.range(1).toDF("id")})
    assert not b._publish(1, {"version": 1, "parts": {}})
    assert rows(b.read("x")) == [(0,)] and not [p for p in (tmp_path / "s" / "manifests").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_run_output(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def slow(i):
        calls.add(1)
        return i

    items = spark.range(4).select(F.udf(slow, "long")("id").alias("id"), (F.col("id") % 2 == 0).alias("chosen"))
    store = versions.Versions(spark, str(tmp_path / "run"))
    assert versions.write_run(spark, str(tmp_path / "run"), 1, items)
    assert store.read("_pending/shortlist") is None and len(rows(store.read("_raw"))) == 4
    before = calls.value
    parts = lambda r: {"shortlist": r.where("chosen"), "rejected": r.where("not chosen"), "errors": r.where("false")}
    assert versions.write_run(spark, str(tmp_path / "run"), 2, items, parts) and calls.value == before + 4
    assert rows(store.read("_pending/shortlist")) == [(0, True), (2, True)] and rows(store.read("_pending/errors")) == []
    assert not versions.write_run(spark, str(tmp_path / "run"), 2, items, parts) and calls.value == before + 4


@pytest.fixture
def seen(spark, tmp_path):
    return SeenTable(spark, str(tmp_path / "seen"), buckets=4, bits=1 << 12, keep=3)


def ids(spark, some):
    return spark.createDataFrame([(i,) for i in some], "id string")


def test_seen_table_equals_a_set(spark, seen):
    rng, known = random.Random(1), {}
    for d in range(1, 9):
        day = dt.date(2024, 1, d)
        for gone in seen.expire(day):
            known = {i: f for i, f in known.items() if str(f) != gone}
        came = {f"i{rng.randrange(300)}" for _ in range(60)}
        new = {r["id"] for r in seen.unseen(ids(spark, came)).collect()}
        assert new == came - known.keys()
        seen.add(ids(spark, new), day)
        known |= dict.fromkeys(new, day)
        assert {(r["id"], r["first_date"]) for r in seen.ids().collect()} == set(known.items())
    assert min(known.values()) == dt.date(2024, 1, 5)


def test_the_ledger_is_not_moved(spark, seen):
    seen.add(ids(spark, [f"i{i}" for i in range(500)]), dt.date(2024, 1, 1))
    out = seen.unseen(ids(spark, [f"i{i}" for i in range(400, 600)]))
    plan = out._jdf.queryExecution().sparkPlan().toString() + out._jdf.queryExecution().executedPlan().toString()
    scan = [x for x in plan.split("\n") if "FileScan parquet" in x and seen.name in x]
    assert scan and all("Bucketed: true" in x for x in scan)
    lines = plan.split("\n")
    for i, x in enumerate(lines):
        if "FileScan parquet" in x and seen.name in x:
            above = [y.strip(" :+-*()0123456789") for y in lines[max(0, i - 4) : i]]
            assert not any(y.startswith("Exchange hashpartitioning(_known") for y in above)
    assert {r["id"] for r in out.collect()} == {f"i{i}" for i in range(500, 600)}


def test_nulls_repeats_and_a_day_added_twice(spark, seen):
    assert {r["id"] for r in seen.unseen(ids(spark, ["a", None])).collect()} == {"a", None}
    for some in (["a", "a", None], ["a", "b"]):
        seen.add(ids(spark, some), dt.date(2024, 1, 1))
    assert rows(seen.ids().select("id")) == [("a",), ("b",)]
    assert {r["id"] for r in seen.unseen(ids(spark, ["a", "b", "c", None])).collect()} == {"c", None}
    assert seen.expire(dt.date(2024, 1, 4)) == [] and seen.expire(dt.date(2024, 1, 5)) == ["2024-01-01"]
    assert {r["id"] for r in seen.unseen(ids(spark, ["a"])).collect()} == {"a"}


def test_most_new_ids_never_reach_the_join(spark, tmp_path):
    seen = SeenTable(spark, str(tmp_path / "t"), buckets=4, bits=1 << 14)
    seen.add(ids(spark, [f"i{i}" for i in range(1000)]), dt.date(2024, 1, 1))
    fresh = spark.range(5000).select(F.concat(F.lit("n"), "id").alias("id"))
    hit = seen.may_hold(F.col("id"), F.col("bloom"))
    assert fresh.join(F.broadcast(seen.filter()), hit, "left_semi").count() < 150
    assert ids(spark, [f"i{i}" for i in range(1000)]).join(F.broadcast(seen.filter()), hit, "left_semi").count() == 1000
