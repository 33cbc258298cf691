"""Queries over the days of events: first sights with a time to live and deferral, as streams and as folds."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftloom.functions import dates as D
from siftloom.operators import deferral, ledger, properties
from siftloom.sources.clustered import SeenTable
from siftloom.sources.shared import folder
from siftloom.sources.versions import Versions
from siftloom.streaming import stateful

from .registry import query, table

LAST = "2024-01-28"
KEEP, TTL, ROUNDS = 7, 5, 3
#: Days on which the stream is run.
PERIODS = (("2024-01-01", "2024-01-10"), ("2024-01-11", "2024-01-19"), ("2024-01-20", "2024-01-31"))


def arrivals(rows: DataFrame) -> list[DataFrame]:
    day = F.to_date(D.day(F.col("at"), "UTC"))
    return [rows.where(day.between(a, b)) for a, b in PERIODS]


_SIGHTS = f"""RECURSIVE d AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS id, CAST(ts AS DATE) AS day FROM events), nxt AS (SELECT a.id, a.day, min(b.day) AS later FROM d a JOIN d b ON a.id = b.id AND b.day >= a.day + {KEEP + 2} GROUP BY a.id, a.day),
    r AS (SELECT id, min(day) AS day FROM d GROUP BY id UNION ALL SELECT r.id, later FROM r JOIN nxt ON nxt.id = r.id AND nxt.day = r.day)"""


@query(f"WITH {_SIGHTS} SELECT id, CAST(day AS VARCHAR) AS first_date FROM r")
def first_sights_stream(spark, sf_dir):
    """Users of events as ids of a stream in three runs: each sight that is a first one."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("id"), D.utc(F.col("ts")).alias("at"))
    out = stateful.run_in_periods(arrivals(rows), lambda s: stateful.first_sights(s, "at", KEEP), folder(spark, "first-sights"))
    return out.select("id", F.col("first_date").cast("string").alias("first_date"))


def runs(spark, sf_dir) -> DataFrame:
    """A row for each user and day: the last event says what gate held it, if any."""
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("id"), F.to_date("ts").alias("day")).agg(F.max_by(F.struct("event_type", "value"), "event_id").alias("e"))
    kind = F.col("e.event_type")
    gate = F.when(kind.isin("click", "purchase"), "thin").when(kind == "view", "cap").when(kind == "error", "quota")
    return e.where(F.col("day") <= F.lit(LAST).cast("date")).select("id", "day", gate.alias("gate"), (F.col("e.value") > 40).alias("muted"))


_FOLD = f"""RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS id, CAST(ts AS DATE) - DATE '1970-01-01' AS day, arg_max(event_type, event_id) AS kind, arg_max(value, event_id) AS value FROM events WHERE CAST(ts AS DATE) <= DATE '{LAST}' GROUP BY 1, 2),
    r AS (SELECT id, day, CASE WHEN kind IN ('click', 'purchase') THEN 'thin' WHEN kind = 'view' THEN 'cap' WHEN kind = 'error' THEN 'quota' END AS gate, value > 40 AS muted, row_number() OVER (PARTITION BY id ORDER BY day) AS k FROM e),
    f AS (SELECT id, 0::BIGINT AS k, NULL::VARCHAR AS state, 0::BIGINT AS first, 0::BIGINT AS last, 0 AS attempts, 0 AS stalls, 0 AS cap, 0 AS quota, 0 AS thin, false AS promoted, false AS stalled FROM r WHERE k = 1
        UNION ALL SELECT id, k, CASE WHEN gate IS NULL OR (NOT stall AND att >= {ROUNDS}) THEN 'seen' ELSE 'wait' END, first, day, att, st + stall::INT, c + coalesce(gate = 'cap', false)::INT, q + coalesce(gate = 'quota', false)::INT, t + coalesce(gate = 'thin', false)::INT, gate IS NOT NULL AND NOT stall AND att >= {ROUNDS}, stall
        FROM (SELECT *, a0 + (gate IS NOT NULL AND NOT stall)::INT AS att FROM (SELECT *, coalesce(gate = 'thin' AND muted AND first >= day - {TTL}, false) AS stall FROM (
            SELECT id, k, day, gate, muted, CASE WHEN gone THEN day ELSE first0 END AS first, CASE WHEN gone THEN 0 ELSE attempts END AS a0, CASE WHEN gone THEN 0 ELSE stalls END AS st, CASE WHEN gone THEN 0 ELSE cap END AS c, CASE WHEN gone THEN 0 ELSE quota END AS q, CASE WHEN gone THEN 0 ELSE thin END AS t FROM (
                SELECT r.id, r.k, r.day, r.gate, r.muted, f.first AS first0, f.attempts, f.stalls, f.cap, f.quota, f.thin, f.state IS NULL OR r.day > greatest(f.first + {TTL + 1}, f.last + 1) AS gone FROM f JOIN r ON r.id = f.id AND r.k = f.k + 1 WHERE f.state IS DISTINCT FROM 'seen'))))),
    z AS (SELECT id, arg_max({{'state': state, 'first': first, 'last': last, 'attempts': attempts, 'stalls': stalls, 'cap': cap, 'quota': quota, 'thin': thin, 'promoted': promoted, 'stalled': stalled}}, k) AS s FROM f WHERE k > 0 GROUP BY id)
    SELECT id, s.state AS state, CAST(DATE '1970-01-01' + s.first::INTEGER AS VARCHAR) AS first, s.attempts AS attempts, s.stalls AS stalls, concat_ws(',', CASE WHEN s.cap > 0 THEN 'cap=' || s.cap END, CASE WHEN s.quota > 0 THEN 'quota=' || s.quota END, CASE WHEN s.thin > 0 THEN 'thin=' || s.thin END) AS gates, s.promoted AS promoted, s.stalled AS stalled
    FROM z WHERE s.state = 'seen' OR s.last = DATE '{LAST}' - DATE '1970-01-01' OR greatest(s.first + {TTL + 1}, s.last + 1) > DATE '{LAST}' - DATE '1970-01-01'"""


@query(f"WITH {_FOLD}")
def deferral_fold(spark, sf_dir):
    """What 28 daily plans leave of each user of events."""
    got = deferral.fold_days(runs(spark, sf_dir), F.lit(LAST).cast("date"), ROUNDS, TTL)
    gates = F.array_join(F.transform(F.array_sort(F.map_keys("gates")), lambda g: F.concat(g, F.lit("="), F.try_element_at("gates", g).cast("string"))), ",")
    return got.select("id", "state", F.col("first").cast("string").alias("first"), "attempts", "stalls", gates.alias("gates"), "promoted", "stalled")


@query(f"WITH {_FOLD}")
def deferral_stream(spark, sf_dir):
    """The same by a stream in three runs, with entries that run out removed by timers."""
    rows = runs(spark, sf_dir).withColumn("at", D.midnight(F.col("day"))).select("id", "at", "gate", "muted")
    out = stateful.run_in_periods(arrivals(rows), lambda s: stateful.deferrals(s, "at", ROUNDS, TTL), folder(spark, "deferrals"), "update")
    names = ["state", "first", "last", "attempts", "stalls", "gates", "promoted", "stalled"]
    last = out.groupBy("id").agg(F.max_by(F.struct(*names), "batch").alias("s")).select("id", "s.*")
    end = F.lit(LAST).cast("date")
    alive = (F.col("state") == "seen") | ((F.col("state") == "wait") & ((F.col("last") == end) | (F.greatest(F.date_add("first", TTL + 1), F.date_add("last", 1)) > end)))
    return last.where(alive).select("id", "state", F.col("first").cast("string").alias("first"), "attempts", "stalls", "gates", "promoted", "stalled")


#: Days whose runs are saved one after the other.
SAVED = ("2024-01-08", "2024-01-09", "2024-01-10")


@query("""WITH e AS (SELECT *, CAST(ts AS DATE) AS day FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-10'),
    s AS (SELECT user_id, min(day) AS first_date FROM e GROUP BY user_id), d AS (SELECT user_id, day, bool_or(event_type <> 'error') AS ok FROM e GROUP BY 1, 2), l AS (SELECT user_id, max(CASE WHEN ok THEN day END) AS last_ok FROM d GROUP BY 1),
    f AS (SELECT d.user_id, sum(CASE WHEN NOT ok AND day > coalesce(last_ok, DATE '1970-01-01') THEN 1 ELSE 0 END) AS n FROM d JOIN l USING (user_id) GROUP BY 1),
    y AS (SELECT event_type, count(DISTINCT day) AS runs, count(*) AS items, sum((value > 90)::INT) AS shortlisted FROM e GROUP BY 1)
    SELECT 'seen' AS part, CAST(user_id AS VARCHAR) AS key, CAST(first_date AS VARCHAR) AS value FROM s UNION ALL SELECT 'status', CAST(user_id AS VARCHAR), CAST(n AS VARCHAR) FROM f UNION ALL SELECT 'yields', event_type, runs || '/' || items || '/' || shortlisted FROM y""")
def saved_state(spark, sf_dir):
    """Seen ids, status and yields of three daily runs over events, each made from the version before and published with one manifest; the last day
    is run twice."""
    store = Versions(spark, folder(spark, "state"))
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    empty = {"seen": "id string, first_date date", "status": "source string, last_success timestamp, last_error timestamp, last_error_message string, consecutive_failures int", "yields": "query string, runs int, items int, shortlisted int, last_run date, last_shortlist date"}
    for text in (*SAVED, SAVED[-1]):
        date = F.lit(text).cast("date")
        rows = e.where(F.col("day") == date)
        old = {n: held if (held := store.read(n)) is not None else spark.createDataFrame([], kind) for n, kind in empty.items()}
        run = rows.groupBy(F.col("user_id").cast("string").alias("source")).agg(F.max(F.col("event_type") != "error").alias("ok")).withColumns({"at": D.midnight(date), "message": F.lit("failed")})
        ran = rows.groupBy(F.col("event_type").alias("query")).agg(F.count("*").alias("items"), F.sum((F.col("value") > 90).cast("int")).alias("shortlisted"))
        fresh = rows.select(F.col("user_id").cast("string").alias("id")).distinct()
        store.commit(dt.date.fromisoformat(text).toordinal(), {"seen": ledger.save_seen(old["seen"], fresh, date), "status": ledger.update_status(old["status"], run), "yields": ledger.record_yield(old["yields"], ran, date)})
    part = lambda n, key, value: store.read(n).select(F.lit(n).alias("part"), F.col(key).alias("key"), value.alias("value"))
    yields = F.concat_ws("/", *[F.col(c).cast("string") for c in ("runs", "items", "shortlisted")])
    return part("seen", "id", F.col("first_date").cast("string")).unionByName(part("status", "source", F.col("consecutive_failures").cast("string"))).unionByName(part("yields", "query", yields))


@query("SELECT e.event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = e.event_id)")
def anti_seen(spark, sf_dir):
    """Events whose number isn't the id of a document, by a clustered ledger of the documents' ids."""
    seen = SeenTable(spark, folder(spark, "seen"), buckets=8, bits=1 << 20)
    seen.add(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id")), dt.date(2024, 1, 1))
    return seen.unseen(table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), "event_id")).select("event_id")


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS value, count(*) AS n, sum(value) AS total, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY 1, 2")
def property_facets(spark, sf_dir):
    """Events by type and the last digit of the number in their properties, with sums."""
    rows = properties.parsed(table(spark, sf_dir, "events"), "props")
    digit = rows.withColumn("digit", properties.value("v", "$.k", "long") % 10)
    return digit.groupBy("event_type", F.col("digit").alias("value")).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.sum(properties.value("v", "$.k", "long")).alias("k"))


@query("SELECT CAST(json_extract_string(props, '$.k') AS VARCHAR) AS value, count(*) AS n, max(value) AS best FROM events GROUP BY 1")
def property_values(spark, sf_dir):
    rows = properties.parsed(table(spark, sf_dir, "events"), "props")
    return properties.facet(rows, "$.k", keys=()).join(rows.groupBy(properties.value("v", "$.k", "string").alias("value")).agg(F.max("value").alias("best")), "value")


@query("""WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN left(props, length(props) - 1) WHEN 1 THEN NULL ELSE props END AS props FROM events)
    SELECT count(*) AS rows, sum((props IS NOT NULL AND NOT json_valid(props))::INT)::BIGINT AS bad, sum((props IS NULL)::INT)::BIGINT AS missing, 'OBJECT<k: BIGINT>' AS schema FROM t""")
def property_quality(spark, sf_dir):
    """Every fourth text of properties cut short, every fourth taken away: both are counted."""
    m = F.col("event_id") % 4
    rows = table(spark, sf_dir, "events").select(F.when(m == 0, F.expr("left(props, length(props) - 1)")).when(m != 1, F.col("props")).alias("props"))
    return properties.quality(properties.parsed(rows, "props"))


@query("SELECT event_id, k AS key, CAST(json_extract(props, '$.' || k) AS BIGINT) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def property_rows(spark, sf_dir):
    rows = properties.unnested(properties.parsed(table(spark, sf_dir, "events"), "props"), "$", ("event_id",))
    return rows.select("event_id", "key", properties.value(F.col("value"), "$", "long").alias("value"))
