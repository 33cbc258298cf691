"""Every operator over written payloads gives the stated rows, whatever the session's zone."""

import literals
import oracle
import pytest


@pytest.mark.parametrize("name", sorted(literals.CASES))
def test_stated_rows(spark, name):
    case, names, rows = literals.CASES[name]
    df = case(spark)
    assert sorted(df.columns) == sorted(names)
    assert oracle.rows(df.columns, [tuple(r) for r in df.collect()]) == oracle.rows(names, rows)


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Shanghai"])
@pytest.mark.parametrize("name", ["search_v2ex", "search_discourse", "search_vocus", "search_juejin", "dates_parsed", "days_in_zone", "feed_entries", "adapter_entries", "collected_items", "sitemap_targets", "monthly_note_dates", "article_metadata"])
def test_other_zones(spark, name, zone):
    case, names, rows = literals.CASES[name]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = case(spark)
        got = [tuple(r) for r in df.collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert oracle.rows(df.columns, got) == oracle.rows(names, rows)
