"""Prefix scans and numbers against loops, with a key that has half of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from siftloom.operators import ledger, state
from siftloom.operators.scan import Running, chunk_bounds, numbered, scan


def table(n=3000, seed=1):
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.5 else rng.choice(["a", "b", "c", None]), i, rng.choice([None, rng.randrange(100)]), rng.random() < 0.1) for i in range(n)]
    rng.shuffle(rows)
    return rows


def loop(rows):
    out, state = {}, {}
    for k, i, v, _ in sorted(rows, key=lambda r: r[1]):
        n, s, m, last = state.get(k, (0, None, None, None))
        before = (n or None, last)
        n += 1
        if v is not None:
            s, m, last = (s or 0) + v, v if m is None else max(m, v), v
        state[k] = (n, s, m, last)
        out[i] = (n, s, m, last, *before)
    return out


@pytest.mark.parametrize("chunk_rows", [100, 700, 1 << 20])
def test_scan(spark, chunk_rows):
    rows = table()
    df = spark.createDataFrame(rows, "k string, i long, v long, ok boolean").repartition(5)
    v = F.col("v")
    running = {"n": Running("sum", F.lit(1)), "s": Running("sum", v), "m": Running("max", v), "last": Running("last", v), "before": Running("sum", F.lit(1), True), "last_before": Running("last", v, True)}
    got = {r["i"]: tuple(r[c] for c in running) for r in scan(df, ["k"], "i", running, chunk_rows).collect()}
    assert got == loop(rows)


def test_no_task_has_a_whole_key(spark):
    df = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    out = scan(df, ["k"], "id", {"n": Running("sum", F.lit(1))}, 5000)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.agg(F.max("n")).first()[0] == 100_000
    assert "SinglePartition" not in plan
    sizes = df.withColumn("c", F.floor(F.col("id") / 5000)).groupBy("k", "c").count().agg(F.max("count")).first()[0]
    assert sizes <= 5000 and len(chunk_bounds(df, "id", 5000)) == 39


def test_orders_of_other_kinds(spark):
    rows = [(k, f"2024-01-{d:02d}", d) for k in "ab" for d in range(1, 29)]
    df = spark.createDataFrame(rows, "k string, day string, d long").withColumn("day", F.to_date("day")).repartition(3)
    for order in ("day", "at"):
        some = df.withColumn("at", F.to_timestamp("day"))
        got = scan(some, ["k"], order, {"s": Running("sum", F.col("d"))}, 7).where("day = date'2024-01-28'").collect()
        assert [r["s"] for r in got] == [sum(range(1, 29))] * 2


def test_breaker_and_chunks_in_parts(spark):
    rows = table(2000, 4)
    df = spark.createDataFrame(rows, "source string, ord long, v long, ok boolean").repartition(4)
    want, seen = {}, {}
    for k, i, _, ok in sorted(rows, key=lambda r: r[1]):
        n, good, dead = seen.get(k, (0, 0, False))
        dead = dead or (n >= 40 and good < 0.08 * n)
        want[i] = dead
        seen[k] = (n + 1, good + ok, dead)
    for size in (90, 1 << 20):
        got = {r["ord"]: r["skipped"] for r in ledger.breaker(df, least_yield=0.08, chunk_rows=size).collect()}
        assert got == want
    pending = df.select(F.coalesce("source", F.lit("none")).alias("user_email"), F.col("ord").alias("seq"), F.lit("x").alias("item_id"))
    a, b = (sorted((r["seq"], r["chunk"]) for r in state.chunks(pending, 20, size).collect()) for size in (77, 1 << 20))
    assert a == b and max(c for _, c in a) > 20


def test_numbers(spark):
    rows = [(i, i % 7) for i in range(5000)]
    df = spark.createDataFrame(rows, "i long, v long").repartition(6)
    out = numbered(df, F.desc("v"), "i", start=1)
    assert "Window" not in df._jdf.queryExecution().toString()
    got = sorted((r["n"], r["v"], r["i"]) for r in out.collect())
    assert [(v, i) for _, v, i in got] == sorted(((v, i) for i, v in rows), key=lambda x: (-x[0], x[1])) and [n for n, _, _ in got] == list(range(1, 5001))


def test_empty(spark):
    df = spark.createDataFrame([], "k string, i long, v long")
    assert scan(df, ["k"], "i", {"n": Running("sum", F.lit(1))}).collect() == [] and numbered(df, "i").collect() == []
