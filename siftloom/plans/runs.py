"""Queries over events, conversations and orders: collection, ledgers, reader state, rotation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftloom.functions import dates as D
from siftloom.functions.vocab import derived_queries, rotation
from siftloom.operators import collect, ledger, pools, state, views
from siftloom.operators.scan import Running, numbered, scan

from .registry import query, table

TODAY = "2024-01-28"
PLAN_DAY = "2024-01-23"


def today():
    return F.lit(TODAY).cast("date")


def events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events")


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS id, event_id AS ord, ts FROM events WHERE ts >= TIMESTAMP '2024-01-14' AND CAST(user_id AS VARCHAR) NOT IN (SELECT CAST(user_id AS VARCHAR) FROM events WHERE ts < TIMESTAMP '2024-01-05' AND event_type = 'purchase'))
    SELECT id, min(ord) AS first_event FROM e GROUP BY id""")
def collect_window(spark, sf_dir):
    e = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("ord"), D.utc(F.col("ts")).alias("published_at"), F.lit("x").alias("link"), "event_type")
    seen = e.where((F.col("published_at") < D.midnight(F.lit("2024-01-05").cast("date"))) & (F.col("event_type") == "purchase")).select("id").distinct()
    return collect.collect_items(e, seen, today(), 14).select("id", F.col("ord").alias("first_event"))


@query(f"SELECT CAST(user_id AS VARCHAR) AS id, CAST(min(CAST(ts AS DATE)) AS VARCHAR) AS first_date FROM events GROUP BY user_id HAVING date_diff('day', min(CAST(ts AS DATE)), DATE '{TODAY}') <= 26")
def seen_ledger(spark, sf_dir):
    e = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("id"), F.to_date("ts").alias("first_date"))
    none = e.where("false").select("id")
    return ledger.save_seen(e, none, today(), 26).withColumn("first_date", F.col("first_date").cast("string"))


_ATTEMPTS = "att AS (SELECT user_id, event_id AS ord, event_type <> 'error' AS ok FROM events)"


@query(f"WITH {_ATTEMPTS}, l AS (SELECT user_id, max(CASE WHEN ok THEN ord END) AS last_ok FROM att GROUP BY user_id) SELECT a.user_id, sum(CASE WHEN NOT ok AND ord > coalesce(last_ok, -1) THEN 1 ELSE 0 END)::INTEGER AS consecutive_failures FROM att a JOIN l USING (user_id) GROUP BY a.user_id")
def consecutive_failures(spark, sf_dir):
    att = events(spark, sf_dir).select("user_id", F.col("event_id").alias("ord"), (F.col("event_type") != "error").alias("ok"), F.col("ts").alias("at"))
    return ledger.status(att, ("user_id",)).select("user_id", "consecutive_failures")


@query(f"WITH {_ATTEMPTS}, l AS (SELECT user_id, max(CASE WHEN ok THEN ord END) AS last_ok FROM att GROUP BY user_id), c AS (SELECT a.user_id, sum(CASE WHEN NOT ok AND ord > coalesce(last_ok, -1) THEN 1 ELSE 0 END) AS n FROM att a JOIN l USING (user_id) GROUP BY a.user_id) SELECT user_id FROM c WHERE n >= 2")
def stale_sources(spark, sf_dir):
    return consecutive_failures(spark, sf_dir).where("consecutive_failures >= 2").select("user_id")


@query("""WITH a AS (SELECT user_id, event_id AS ord, event_type = 'purchase' AS ok FROM events), b AS (SELECT *, count(*) OVER w AS tries, coalesce(sum(ok::INT) OVER w, 0) AS good FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    c AS (SELECT *, max((tries >= 12 AND good < 0.15 * tries)::INT) OVER (PARTITION BY user_id ORDER BY ord) AS dead FROM b) SELECT user_id, ord, dead = 1 AS skipped FROM c""")
def circuit_breaker(spark, sf_dir):
    att = events(spark, sf_dir).select("user_id", F.col("event_id").alias("ord"), (F.col("event_type") == "purchase").alias("ok"))
    return ledger.breaker(att, ("user_id",), 12, 0.15).select("user_id", "ord", "skipped")


@query("""WITH a AS (SELECT user_id AS source, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS round, max(event_id) AS e FROM events GROUP BY 1, 2), b AS (SELECT a.source, a.round, ev.value > 50 AS ok FROM a JOIN events ev ON ev.event_id = a.e)
    SELECT source, arg_max(ok, round) AS ok, max(round)::INTEGER AS rounds, arg_max(ok, round) AND NOT arg_min(ok, round) AS recovered FROM b GROUP BY source""")
def retry_recovery(spark, sf_dir):
    r = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).otherwise(3)
    last = events(spark, sf_dir).groupBy(F.col("user_id").alias("source"), r.alias("round")).agg(F.max_by("value", "event_id").alias("value"))
    return ledger.recover(last.select("source", "round", (F.col("value") > 50).alias("ok"), F.lit("HTTP 503").alias("message")))


_PLAN = f"""run AS (SELECT doc_id AS id, CASE WHEN n_chars < 250 THEN 'thin' WHEN n_chars > 4000 THEN 'cap' END AS gate, source = 'src0' AS muted FROM documents),
    led AS (SELECT event_id AS id, CAST(ts AS DATE) AS first, user_id % 4 AS attempts, user_id % 2 AS stalls, CASE WHEN event_type = 'click' THEN 'thin' ELSE 'quota' END AS g, (user_id % 3 + 1) AS gn FROM events),
    j AS (SELECT coalesce(run.id, led.id) AS id, run.id IS NOT NULL AS came, gate, coalesce(muted, false) AS muted, coalesce(led.first, DATE '{PLAN_DAY}') AS first, coalesce(attempts, 0) AS att, coalesce(stalls, 0) AS st, g, coalesce(gn, 0) AS gn FROM run FULL JOIN led ON run.id = led.id),
    k AS (SELECT *, came AND gate IS NOT NULL AS gated, coalesce(came AND gate = 'thin' AND muted AND first >= DATE '{PLAN_DAY}' - INTERVAL 21 DAY, false) AS stall FROM j),
    m AS (SELECT *, att + (gated AND NOT stall)::INT AS attempts2 FROM k),
    n AS (SELECT *, CASE WHEN came AND (NOT gated OR (NOT stall AND attempts2 >= 3)) THEN 'seen' WHEN came OR first >= DATE '{PLAN_DAY}' - INTERVAL 21 DAY THEN 'wait' END AS state FROM m)"""


def planned(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    n = F.col("n_chars")
    run = docs.select(F.col("doc_id").alias("id"), F.when(n < 250, "thin").when(n > 4000, "cap").alias("gate"), (F.col("source") == "src0").alias("muted"))
    u = F.col("user_id")
    g = F.when(F.col("event_type") == "click", "thin").otherwise("quota")
    led = events(spark, sf_dir).select(
        F.col("event_id").alias("id"), F.to_date("ts").alias("first"), (u % 4).cast("int").alias("attempts"), (u % 2).cast("int").alias("stalls"), F.create_map(g, (u % 3 + 1).cast("int")).alias("gates"))
    return ledger.plan_seen(run, led, F.lit(PLAN_DAY).cast("date"))


@query(f"WITH {_PLAN} SELECT id, state, attempts2::INTEGER AS attempts, (st + stall::INT)::INTEGER AS stalls, (gn + (CASE WHEN gated THEN 1 ELSE 0 END))::INTEGER AS gate_sum, state = 'seen' AND gated AS promoted, stall AS stalled FROM n WHERE state IS NOT NULL")
def plan_seen(spark, sf_dir):
    total = F.aggregate(F.map_values("gates"), F.lit(0), lambda a, x: a + x)
    return planned(spark, sf_dir).select("id", "state", "attempts", "stalls", total.alias("gate_sum"), "promoted", "stalled")


@query(f"WITH {_PLAN} SELECT id, CAST(first AS VARCHAR) AS first FROM n WHERE state = 'wait' AND NOT came")
def deferred_ttl(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return planned(spark, sf_dir).where("state = 'wait'").join(docs, "id", "left_anti").select("id", F.col("first").cast("string").alias("first"))


@query("""WITH t AS (SELECT event_type AS query, count(*) AS items, sum((value > 90)::INT) AS shortlisted FROM events WHERE event_type <> 'error' GROUP BY 1), l AS (SELECT event_type AS query, count(DISTINCT user_id) AS runs, 7 AS items, 0 AS shortlisted FROM events WHERE event_type <> 'click' GROUP BY 1)
    SELECT coalesce(t.query, l.query) AS query, (coalesce(runs, 0) + (t.query IS NOT NULL)::INT)::INTEGER AS runs, (coalesce(l.items, 0) + coalesce(t.items, 0))::INTEGER AS items, (coalesce(l.shortlisted, 0) + coalesce(t.shortlisted, 0))::INTEGER AS shortlisted FROM t FULL JOIN l ON t.query = l.query""")
def query_yield(spark, sf_dir):
    e = events(spark, sf_dir)
    now = e.where("event_type <> 'error'").groupBy(F.col("event_type").alias("query")).agg(F.count("*").alias("items"), F.sum((F.col("value") > 90).cast("int")).alias("shortlisted"))
    old = e.where("event_type <> 'click'").groupBy(F.col("event_type").alias("query")).agg(F.count_distinct("user_id").alias("runs"), F.lit(7).alias("items"), F.lit(0).alias("shortlisted"), F.lit(None).cast("date").alias("last_run"), F.lit(None).cast("date").alias("last_shortlist"))
    return ledger.record_yield(old, now, today()).select("query", "runs", "items", "shortlisted")


def yields(spark, sf_dir):
    """Each part name as a query: how often it was ordered, and how often in bulk."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").cast("int").alias("runs"), F.sum((F.col("l_quantity") > 49).cast("int")).cast("int").alias("shortlisted"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand").join(li, "l_partkey").select(F.col("l_partkey").alias("query"), "p_brand", "runs", F.col("runs").alias("items"), "shortlisted")


_YIELDS = "y AS (SELECT p_partkey AS query, p_brand, count(*)::INTEGER AS runs, count(*)::INTEGER AS items, sum((l_quantity > 49)::INT)::INTEGER AS shortlisted FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2)"


@query(f"WITH {_YIELDS} SELECT query, runs, query IN (SELECT ps FROM (SELECT l_partkey AS ps FROM lineitem WHERE l_quantity < 2)) AS in_pool FROM y WHERE runs >= 5 AND shortlisted = 0")
def barren_queries(spark, sf_dir):
    pool = table(spark, sf_dir, "lineitem").where("l_quantity < 2").select(F.col("l_partkey").alias("query"))
    return ledger.barren(yields(spark, sf_dir), pool).select("query", "runs", "in_pool")


@query(f"WITH {_YIELDS} SELECT p_brand || '-' || (query // 3)::VARCHAR AS name, count(*) AS queries, sum(items)::BIGINT AS items FROM y GROUP BY 1 HAVING min(runs) >= 5 AND sum(shortlisted) = 0")
def retirable(spark, sf_dir):
    y = yields(spark, sf_dir)
    name = F.concat("p_brand", F.lit("-"), F.floor(F.col("query") / 3).cast("string"))
    return ledger.retirable(y.select(name.alias("name"), "query"), y)


@query("WITH pool AS (SELECT n_nationkey AS ord, n_name AS query FROM nation) SELECT query FROM pool WHERE ord % 5 = (DATE '2024-01-28' - DATE '1970-01-01') % 5")
def query_rotation(spark, sf_dir):
    pool = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("query"))
    return rotation(pool, today(), 5, 25).select("query")


_STATE = "ch AS (SELECT user_id, event_type AS item, event_id AS seq, CASE WHEN event_type IN ('click', 'view') THEN value > 30 END AS r, CASE WHEN event_type IN ('purchase', 'view') THEN value > 60 END AS s FROM events)"


def changes(spark, sf_dir):
    e = events(spark, sf_dir)
    kind, value = F.col("event_type"), F.col("value")
    return e.select(F.col("user_id").cast("string").alias("user_email"), kind.alias("item_id"), F.col("event_id").alias("seq"), F.when(kind.isin("click", "view"), value > 30).alias("read"), F.when(kind.isin("purchase", "view"), value > 60).alias("starred"))


def old_state(spark, sf_dir):
    e = events(spark, sf_dir).where("event_type in ('click', 'signup')")
    return e.groupBy(F.col("user_id").cast("string").alias("user_email"), F.col("event_type").alias("item_id")).agg(F.lit(0).alias("is_read"), F.lit(1).alias("is_starred"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("updated_at"))


_UPSERT = f"""{_STATE}, f AS (SELECT CAST(user_id AS VARCHAR) AS user_email, item AS item_id, arg_max(r, seq) FILTER (r IS NOT NULL) AS r, arg_max(s, seq) FILTER (s IS NOT NULL) AS s FROM ch GROUP BY 1, 2),
    o AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS user_email, event_type AS item_id FROM events WHERE event_type IN ('click', 'signup')),
    st AS (SELECT coalesce(f.user_email, o.user_email) AS user_email, coalesce(f.item_id, o.item_id) AS item_id, coalesce(f.r::INT, CASE WHEN o.item_id IS NOT NULL THEN 0 END, 0)::INTEGER AS is_read, coalesce(f.s::INT, CASE WHEN o.item_id IS NOT NULL THEN 1 END, 0)::INTEGER AS is_starred FROM f FULL JOIN o ON f.user_email = o.user_email AND f.item_id = o.item_id)"""


@query(f"WITH {_UPSERT} SELECT * FROM st")
def state_upsert(spark, sf_dir):
    return state.upsert(old_state(spark, sf_dir), changes(spark, sf_dir), F.lit("2024-02-01 00:00:00").cast("timestamp")).select("user_email", "item_id", "is_read", "is_starred")


@query(f"WITH {_UPSERT} SELECT user_email, coalesce(string_agg(CASE WHEN is_read = 1 THEN item_id END, ',' ORDER BY item_id), '') AS read, coalesce(string_agg(CASE WHEN is_starred = 1 THEN item_id END, ',' ORDER BY item_id), '') AS starred FROM st GROUP BY user_email")
def state_read_lists(spark, sf_dir):
    lists = state.read_lists(state_upsert(spark, sf_dir))
    return lists.select("user_email", F.array_join("read", ",").alias("read"), F.array_join("starred", ",").alias("starred"))


@query("SELECT event_id AS seq, ((row_number() OVER (PARTITION BY user_id ORDER BY event_id, event_type) - 1) // 20)::INTEGER AS chunk FROM events")
def pending_chunks(spark, sf_dir):
    return state.chunks(changes(spark, sf_dir), 20).select("seq", "chunk")


@query("SELECT event_id AS seq, CASE WHEN event_type IN ('signup', 'error') THEN 'no-flag' END AS why FROM events WHERE event_type IN ('signup', 'error')")
def change_violations(spark, sf_dir):
    return state.violations(changes(spark, sf_dir), 1_000_000).select("seq", "why")


@query(f"""WITH {_UPSERT}, cur AS (SELECT user_email, item_id, 'read' AS flag FROM st WHERE is_read = 1), imp AS (SELECT user_email, item_id, 'read' AS flag FROM o)
    SELECT user_email, item_id, flag, false AS is_new FROM cur UNION ALL SELECT *, true FROM (SELECT * FROM imp EXCEPT SELECT * FROM cur)""")
def import_union(spark, sf_dir):
    current = state_upsert(spark, sf_dir).where("is_read = 1").select("user_email", "item_id", F.lit("read").alias("flag"))
    return state.merge_import(current, old_state(spark, sf_dir).select("user_email", "item_id", F.lit("read").alias("flag")))


_DAYS = "d AS (SELECT CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY 1)"


def day_counts(spark, sf_dir):
    return events(spark, sf_dir).groupBy(F.to_date("ts").alias("date")).agg(F.count("*").alias("n"))


@query(f"WITH {_DAYS} SELECT CAST(date AS VARCHAR) AS date, n FROM d WHERE date_diff('day', date, DATE '{TODAY}') BETWEEN 0 AND 13")
def day_window_scan(spark, sf_dir):
    return views.within(day_counts(spark, sf_dir), today(), 14).select(F.col("date").cast("string").alias("date"), "n")


@query(f"WITH {_DAYS} SELECT CAST(date AS VARCHAR) AS date FROM d WHERE date_diff('day', date, DATE '{TODAY}') >= 20")
def retention_prune(spark, sf_dir):
    return views.expired(day_counts(spark, sf_dir), today(), 20).select(F.col("date").cast("string").alias("date"))


@query("""WITH c AS (SELECT unnest(generate_series(DATE '2023-12-20', DATE '2024-01-28', INTERVAL 1 DAY))::DATE AS date), e AS (SELECT CAST(ts AS DATE) AS date, count(*) AS n, sum(CASE WHEN event_type = 'click' THEN 0 ELSE 1 END) AS unread FROM events GROUP BY 1)
    SELECT CAST(c.date AS VARCHAR) AS date, coalesce(n, 0)::BIGINT AS n, coalesce(unread, 0)::BIGINT AS unread FROM c LEFT JOIN e USING (date)""")
def calendar_counts(spark, sf_dir):
    dates = spark.range(1).select(F.explode(D.last_dates(today(), 40)).alias("date"))
    rows = events(spark, sf_dir).select(F.to_date("ts").alias("date"), (F.col("event_type") == "click").alias("is_read"))
    return views.calendar(rows, dates).withColumn("date", F.col("date").cast("string"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS author, count(*) AS posts, CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS last_day, min(o_orderkey) AS first_id, max(o_totalprice) AS best, string_agg('order ' || o_orderkey, ',' ORDER BY o_orderkey) AS titles, list(o_totalprice ORDER BY o_orderkey) AS ratings FROM orders GROUP BY 1")
def author_rollup(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("author"), F.to_date("o_orderdate").alias("date"), key.alias("id"), key.alias("ord"), F.concat(F.lit("order "), key.cast("string")).alias("title"), F.col("o_totalprice").alias("rating"))
    return views.authors(rows).withColumns({"last_day": F.col("last_day").cast("string"), "titles": F.array_join("titles", ",")})


@query("""WITH s AS (SELECT 'u' || doc_id AS url, doc_id AS id FROM documents), dec AS (SELECT 'u' || doc_id AS url, CASE WHEN quality = 1 THEN 'keep' ELSE 'drop' END AS action, toxic AS rating FROM labels) SELECT s.id, dec.rating FROM dec JOIN s USING (url) WHERE action <> 'drop'""")
def day_assembly(spark, sf_dir):
    url = F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url")
    shortlist = table(spark, sf_dir, "documents").select(url, F.col("doc_id").alias("id"), F.lit(0).alias("published_at"))
    decisions = table(spark, sf_dir, "labels").select(url, F.when(F.col("quality") == 1, "keep").otherwise("drop").alias("action"), F.col("toxic").alias("rating"))
    return views.assemble(decisions, shortlist).select("id", "rating")


@query("WITH m AS (SELECT event_id, event_type, user_id FROM events), q AS (SELECT DISTINCT r_name || ' ' || n_name AS query FROM region JOIN nation ON n_regionkey = r_regionkey UNION SELECT n_name || ' review' FROM nation) SELECT query FROM q")
def query_pool_union(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    hand = nation.join(region.withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey").select(F.concat("r_name", F.lit(" "), "n_name").alias("query"))
    return hand.unionByName(derived_queries(nation, ["%s review"], "n_name").select("query")).distinct()


@query("""SELECT event_id, CAST(last_value(CASE WHEN event_type = 'purchase' THEN CAST(ts AS DATE) END IGNORE NULLS) OVER w AS VARCHAR) AS last_purchase, coalesce(sum((event_type = 'error')::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS errors_before, max(value) OVER w AS best
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""".replace("OVER (w ROWS BETWEEN", "OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN"))
def carry_forward(spark, sf_dir):
    """Each event with the day of its user's last purchase so far, the errors before it and the best value up to it."""
    kind = F.col("event_type")
    running = {
        "last_purchase": Running("last", F.when(kind == "purchase", F.to_date("ts"))), "errors_before": Running("sum", (kind == "error").cast("int"), True), "best": Running("max", F.col("value")),
    }
    out = scan(events(spark, sf_dir), ["user_id"], "event_id", running, chunk_rows=2000)
    return out.select("event_id", F.col("last_purchase").cast("string").alias("last_purchase"), F.coalesce("errors_before", F.lit(0)).alias("errors_before"), "best")


@query("SELECT event_id, (row_number() OVER (ORDER BY value DESC, event_id) - 1) AS place FROM events")
def dense_places(spark, sf_dir):
    """All events in one order, numbered from 0."""
    return numbered(events(spark, sf_dir).select("event_id", "value"), F.desc("value"), F.asc("event_id"), name="place").select("event_id", "place")


_POOL = """p AS (SELECT p_name || ' ' || p_brand AS query, 0 AS pool, p_partkey AS ord FROM part UNION ALL SELECT lower(n_name), 1, n_nationkey FROM nation UNION ALL SELECT lower(p_name), 2, p_partkey FROM part),
    f AS (SELECT query, min({'pool': pool, 'ord': ord}) AS place FROM p GROUP BY query), o AS (SELECT query, row_number() OVER (ORDER BY place, query) - 1 AS ord FROM f)"""


def pool(spark, sf_dir):
    part, nation = table(spark, sf_dir, "part"), table(spark, sf_dir, "nation")
    return pools.union_in_order(
        part.select(F.concat("p_name", F.lit(" "), "p_brand").alias("query"), F.col("p_partkey").alias("ord")), nation.select(F.lower("n_name").alias("query"), F.col("n_nationkey").alias("ord")),
        part.select(F.lower("p_name").alias("query"), F.col("p_partkey").alias("ord")),
    )


@query(f"WITH {_POOL} SELECT * FROM o")
def pool_in_order(spark, sf_dir):
    """All part names with their brands, nations and part names as one pool."""
    return pool(spark, sf_dir)


@query(f"WITH {_POOL}, c AS (SELECT greatest(1, ceil(count(*) / 24.0))::BIGINT AS cycle FROM o) SELECT query, ord FROM o, c WHERE ord % cycle = (DATE '{TODAY}' - DATE '1970-01-01') % cycle")
def pool_of_the_day(spark, sf_dir):
    rows = pool(spark, sf_dir)
    return rotation(rows, today(), 24, rows.count())
