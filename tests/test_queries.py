"""Every query that has SQL gives the same rows as DuckDB."""

import os

import oracle
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()
#: So small that the smallest tables have no such row.
MAY_BE_EMPTY = {"seen_ledger", "barren_queries", "retirable", "stale_sources", "deferred_ttl", "triage_shortlist", "validate_required"}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    wrong = oracle.differences(spark, name, entry.queries()[name], SQL[name], SF, con)
    assert wrong is None or (name in MAY_BE_EMPTY and wrong.endswith("no rows")), wrong


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_validate_required_reports_every_field(spark, tmp_path):
    texts = [(1, None, "s"), (2, "", "s"), (3, "\nsecond line", "s"), (4, "a title", None), (5, "a title", "s")]
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.sql("SELECT id AS event_id, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS ts, 1.0D AS value, 'view' AS event_type FROM range(1, 5)").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r["id"], r["field"]) for r in entry.queries()["validate_required"](spark, str(tmp_path)).collect()}
    assert got == {(str(i), "tail") for i in range(1, 6)} | {("1", "title"), ("2", "title"), ("3", "title"), ("4", "source"), ("5", "published_at")}
