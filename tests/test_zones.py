"""Queries and operators on times give the same rows whatever the session's zone."""

import os

import oracle
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from siftloom.functions import dates as D
from siftloom.operators import collect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(params=["UTC", "America/New_York", "Asia/Shanghai"])
def zoned(spark, request):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield spark
    spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("name", ["collect_window", "day_window_scan", "calendar_counts", "feed_grade", "sampling_windows"])
def test_same_rows_as_sql(zoned, name):
    assert oracle.differences(zoned, name, entry.queries()[name], entry.oracle_sql()[name], SF, oracle.connect(SF)) is None


def test_cut_is_midnight_in_utc(zoned):
    rows = zoned.createDataFrame([("a", "2026-08-24T02:00:00Z"), ("b", "2026-08-24T00:00:00Z"), ("c", "2026-08-23T23:59:59Z"), ("d", None)], "id string, at string")
    rows = rows.select("id", F.lit("l").alias("link"), D.iso(F.col("at")).alias("published_at"), F.lit(0).alias("ord"))
    got = collect.collect_items(rows, zoned.createDataFrame([], "id string"), F.lit("2026-09-07").cast("date"), 14)
    assert sorted(r["id"] for r in got.collect()) == ["a", "b", "d"]


@pytest.mark.parametrize("text,micros", [
    ("2026-07-26T10:00:00", 1785060000), ("2026-07-26 10:00:00", 1785060000), ("2026-07-26", 1785024000), ("2026-07-26T10:00:00+08:00", 1785031200), ("2026-07-26T10:00:00Z", 1785060000), ("26 Jul 2026 10:00:00", 1785060000),
    ("Sun, 26 Jul 2026 10:00:00 GMT", 1785060000), ("26 Jul 2026 10:00:00 +0800", 1785031200), ("July 26, 2026", 1785024000), ("2026/7/26", 1785024000), ("no time", None),
])
def test_texts_without_a_zone_are_utc(zoned, text, micros):
    got = zoned.createDataFrame([(text,)], "t string").select(F.unix_seconds(D.parse(F.col("t")))).first()[0]
    assert got == micros


def test_days_and_instants(zoned):
    row = zoned.sql("SELECT TIMESTAMP_NTZ '2024-03-10 02:30:00' AS w, timestamp_seconds(1710037800) AS t").select(F.unix_seconds(D.utc(F.col("w"))), D.day(F.col("t")).cast("string"), D.day(F.col("t"), "America/New_York").cast("string")).first()
    assert tuple(row) == (1710037800, "2024-03-10", "2024-03-09")
