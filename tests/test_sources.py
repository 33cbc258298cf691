"""Files, the landed data source and streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from siftloom.sources import files, landed
from siftloom.streaming import streams


def test_days(spark, tmp_path):
    for name in ("2026-09-07", "2026-09-05", "2026-08-01", "2026-09-09"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"date": name, "items": [{"id": name, "source": "s"}], "errors": [{"source": "x", "message": "m"}, "plain"]}))
    (tmp_path / "2026-09-06.json").write_text("{broken")
    (tmp_path / "status.json").write_text("{}")
    days = files.read_days(spark, str(tmp_path), F.lit("2026-09-07").cast("date"), 30)
    assert [str(r["date"]) for r in days.collect()] == ["2026-09-07", "2026-09-05"]
    assert {r["id"] for r in files.items_of(days).collect()} == {"2026-09-07", "2026-09-05"}
    assert {(r["source"], r["message"]) for r in files.errors_of(days).collect()} == {("x", "m"), (None, "plain")}
    page = files.page(days).first()
    assert "2026-09-07" in page["json"] and (page["day_count"], page["item_count"]) == (2, 2) and page["bytes"] == len(page["json"].encode())
    with pytest.raises(Exception, match="at most 1 days"):
        files.page(days, 1).collect()
    assert files.prune_days(spark, str(tmp_path), F.lit("2026-09-07").cast("date"), 30) == ["2026-08-01"]
    assert sorted(p.name for p in tmp_path.glob("*.json")) == ["2026-09-05.json", "2026-09-06.json", "2026-09-07.json", "2026-09-09.json", "status.json"]


def test_missing_state(spark, tmp_path):
    assert files.read_state(spark, str(tmp_path / "none.json"), "id string").count() == 0
    (tmp_path / "s.json").write_text('{"id":"a"}\nnonsense\n')
    assert [r["id"] for r in files.read_state(spark, str(tmp_path / "s.json"), "id string").collect()] == ["a"]


def test_dynamic_days(spark, tmp_path):
    write = lambda rows: files.write_days(spark.createDataFrame(rows, "date string, n int"), str(tmp_path / "d"))
    write([("a", 1), ("b", 2)])
    write([("b", 3)])
    assert {(r["date"], r["n"]) for r in spark.read.parquet(str(tmp_path / "d")).collect()} == {("a", 1), ("b", 3)}


def test_landed(spark, tmp_path):
    for s in ("a", "b"):
        (tmp_path / s).mkdir()
        (tmp_path / s / "1.xml").write_text(f"<rss>{s}</rss>")
    landed.register(spark)
    df = spark.read.format("landed").load(str(tmp_path))
    assert {(r["source"], r["body"]) for r in df.collect()} == {("a", "<rss>a</rss>"), ("b", "<rss>b</rss>")}
    assert [r["body"] for r in df.where("source = 'b'").collect()] == ["<rss>b</rss>"]


def test_landed_files_are_dealt_to_tasks(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for i in range(7):
        (tmp_path / "a" / f"{i}.txt").write_text(str(i))
    landed.register(spark)
    df = spark.read.format("landed").option("filesPerTask", 3).load(f"file://{tmp_path}")
    assert sorted(r["body"] for r in df.collect()) == list("0123456") and len({r["p"] for r in df.select(F.spark_partition_id().alias("p")).collect()}) == 3
    (tmp_path / "b").mkdir()
    assert spark.read.format("landed").load(str(tmp_path)).where("source = 'b'").count() == 0


def test_landed_stream(spark, tmp_path):
    landed.register(spark)
    (tmp_path / "in" / "a").mkdir(parents=True)
    for n, names in enumerate((["1", "2"], ["3"], [])):
        for x in names:
            (tmp_path / "in" / "a" / x).write_text(f"body {x}")
        q = spark.readStream.format("landed").load(str(tmp_path / "in")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["source"], r["name"], r["body"]) for r in got) == [("a", x, f"body {x}") for x in "123"]


def run(df, mode, tmp_path, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_streams_equal_batches(spark, tmp_path):
    rows = [("i1", dt.datetime(2026, 1, 1), "s"), ("i1", dt.datetime(2026, 1, 2), "s"), ("i2", dt.datetime(2026, 1, 2), "t")]
    spark.createDataFrame(rows, "id string, published_at timestamp, source string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, published_at timestamp, source string").parquet(str(tmp_path / "in"))
    run(streams.first_seen(stream), "append", tmp_path, "seen")
    assert sorted(r["id"] for r in spark.table("seen").collect()) == ["i1", "i2"]
    run(streams.day_counts(stream), "complete", tmp_path, "days")
    assert sorted((str(r["date"]), r["source"], r["n"]) for r in spark.table("days").collect()) == [("2026-01-01", "s", 1), ("2026-01-02", "s", 1), ("2026-01-02", "t", 1)]


def test_failures_stream(spark, tmp_path):
    spark.createDataFrame([("s", 0, False), ("s", 1, True), ("s", 2, False), ("s", 3, False)], "source string, ord long, ok boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source string, ord long, ok boolean").parquet(str(tmp_path / "in"))
    run(streams.failures(stream), "update", tmp_path, "fails")
    assert [(r["source"], r["consecutive_failures"]) for r in spark.table("fails").collect()] == [("s", 2)]


def test_failures_stream_takes_rows_in_any_order_and_many_chunks(spark, tmp_path):
    n = 26
    rows = [("s", i, i == 0) for i in range(n)][::-1] + [("t", i, i == 20) for i in range(n)]
    spark.createDataFrame(rows, "source string, ord long, ok boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source string, ord long, ok boolean").parquet(str(tmp_path / "in"))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 10)
    try:
        run(streams.failures(stream), "update", tmp_path, "chunked")
    finally:
        spark.conf.set(name, before)
    assert {r["source"]: r["consecutive_failures"] for r in spark.table("chunked").collect()} == {"s": 25, "t": 5}


def test_upsert_stream(spark, tmp_path):
    kind = "user_email string, seq long, item_id string, read boolean, starred boolean"
    spark.createDataFrame([("u", 1, "i", True, None), ("u", 2, "i", None, True)], kind).write.parquet(str(tmp_path / "in"))
    q = spark.readStream.schema(kind).parquet(str(tmp_path / "in")).writeStream.foreachBatch(streams.upsert_into(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    assert [(r["is_read"], r["is_starred"]) for r in spark.read.parquet(str(tmp_path / "out" / "v=0")).collect()] == [(1, 1)]


def test_snapshots_rewrite_only_what_a_batch_touches(spark, tmp_path):
    kind = "user_email string, seq long, item_id string, read boolean, starred boolean"
    out = str(tmp_path / "out")
    write = streams.upsert_into(out, 8)
    batches = [[("u", 1, "i", True, None), ("v", 2, "i", True, None)], [("u", 3, "i", None, True)], [("u", 4, "i", False, None)], [("u", 5, "j", True, None)]]
    for i, rows in enumerate([*batches[:2], batches[1], *batches[2:]]):  # one batch comes twice
        write(spark.createDataFrame(rows, kind), i - (i > 1))
    got = {(r["user_email"], r["item_id"]): (r["is_read"], r["is_starred"], r["v"]) for r in streams.snapshot(spark, out).collect()}
    assert got == {("u", "i"): (0, 1, 3), ("u", "j"): (1, 0, 3), ("v", "i"): (1, 0, 0)}
    held = spark.read.parquet(out).select("bucket", "v").distinct().collect()
    assert sorted(r["v"] for r in held) == [0, 2, 3]
