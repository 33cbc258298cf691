"""Queries over documents as items: text, vocabulary, scores, triage, views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.functions import text as T
from siftloom.functions.vocab import Entry, Vocabulary, derived_queries
from siftloom.operators import collect, matching, scoring, triage as tri, views
from siftloom.sources.shared import written

from .registry import query, table, texts

#: What the driver's tables are scored by.
TOOLS = Vocabulary((
    Entry("gnu", "gnu general public license", ("gpl",)), Entry("apache", "apache license"), Entry("mit", "mit license", (), ("mit license form",)),
    Entry("cc", "cc by-nc", ("cc by",)), Entry("web", "http", ("https", "www"), (), False),
))
TOPICS = Vocabulary((Entry("version", "version"), Entry("token", "token", ("password",), ("token ring",)), Entry("license", "license", (), (), True, False)))
SOFT = ("licensed", "released", "contact")
EXPERIENCE = ("that", "with", "from", "der", "les", "que")
PROMO, NEWS, ACADEMIC = ("!!",), (" | ",), ("%%%",)


def latin_ratio(text: Column) -> Column:
    """Lower-case ASCII letters among all that isn't white space."""
    of = lambda pattern: F.char_length(F.regexp_replace(F.coalesce(text, F.lit("")), pattern, ""))
    return T.let(F.struct(of(T.WHITE).alias("all"), of("[^a-z]++").alias("own")), lambda n: F.when(n["all"] == 0, F.lit(0.0)).otherwise(n["own"] / n["all"]))


RULES = scoring.RuleSet(
    tools=TOOLS, topics=TOPICS, soft=SOFT, experience=EXPERIENCE, promo=PROMO, news=NEWS, academic=ACADEMIC, script_ratio=latin_ratio, min_script=0.5, job_headings=("[0-9]{16}", "@", "\\+[0-9]"),
    hard_promo="^[^a-z]*$", first_person="^(The|And) ", question="[?]\\s*$", self_promo="released under", coach_promo="@", machine_report="&&&", listicle_headings=("###", "\\$\\$\\$"), serial_title="^[A-Z][a-z]+\\.$", threshold=4,
)


def items(spark, sf_dir) -> DataFrame:
    """Documents as items, dated by the event of the same number."""
    docs, events = texts(spark, sf_dir, "documents"), table(spark, sf_dir, "events")
    title = F.regexp_extract("text", "^[^\\n]*", 0)
    cols = docs.select(
        F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("id"), "source", "lang", title.alias("title"), F.substring("text", 1, 2500).alias("excerpt"), T.article_tail(F.col("text"), 2500, 400).alias("tail"),
        (F.col("lang") == "fr").alias("thread"), (F.col("lang") == "es").alias("summary_page"),
    )
    dated = cols.join(events.select(F.col("event_id").alias("ord"), F.col("ts").alias("published_at"), F.col("value").alias("value"), "event_type"), "ord", "left")
    return dated.withColumns({"thin": T.thin(F.col("excerpt")), "title_key": T.title_key(F.col("title")), "views": F.coalesce((F.col("value") * 100).cast("long"), F.lit(0)), "comments": F.lit(0)})


ITEMS = """items AS (SELECT d.doc_id AS ord, CAST(d.doc_id AS VARCHAR) AS id, d.source, d.lang, regexp_extract(d.text, '^[^\\n]*', 0) AS title, substr(d.text, 1, 2500) AS excerpt,
    CASE WHEN length(d.text) > 2500 THEN right(d.text, 400) ELSE '' END AS tail, d.lang = 'fr' AS thread, d.lang = 'es' AS summary_page, e.ts AS published_at, e.value, e.event_type,
    length(substr(d.text, 1, 2500)) < 250 AS thin, regexp_replace(lower(regexp_extract(d.text, '^[^\\n]*', 0)), '[^0-9a-z\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}]+', '', 'g') AS title_key,
    coalesce(CAST(trunc(e.value * 100) AS BIGINT), 0) AS views FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id)"""


def sql_any(text: str, entry: Entry) -> str:
    own = f"lower({text})"
    for p in entry.not_:
        own = f"replace({own}, '{p}', '{' ' * len(p)}')"
    return "(" + " OR ".join(f"regexp_matches({own}, '(^|[^a-z0-9&]){n}($|[^a-z0-9])')" for n in entry.needles()) + ")"


def sql_count(text: str, vocabulary: Vocabulary, scored: bool = True) -> str:
    return "(" + " + ".join(f"CASE WHEN {sql_any(text, e)} THEN 1 ELSE 0 END" for e in vocabulary.entries if e.score or not scored) + ")"


def sql_ids(text: str, vocabulary: Vocabulary) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {sql_any(text, e)} THEN '{e.id}' END" for e in vocabulary.entries) + "], lambda x: x IS NOT NULL), ',')"


def sql_needles(text: str, needles: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"CASE WHEN contains(lower({text}), '{n}') THEN 1 ELSE 0 END" for n in needles) + ")"


def sql_patterns(text: str, patterns: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"CASE WHEN regexp_matches({text}, '{p}') THEN 1 ELSE 0 END" for p in patterns) + ")"


def sql_latin(x: str) -> str:
    bare = f"regexp_replace({x}, '[\\t\\n\\x0B\\f\\r \\x{{00A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{FEFF}}]+', '', 'g')"
    return f"(CASE WHEN {bare} = '' THEN 0.0 ELSE length(regexp_replace({bare}, '[^a-z]', '', 'g')) * 1.0 / length({bare}) END)"


_R = RULES
SCORED = f"""
    s0 AS (SELECT *, title || chr(10) || excerpt AS body, excerpt || chr(10) || tail AS bt FROM items),
    s1 AS (SELECT *, {sql_count('title', TOOLS)} + {sql_count('title', TOPICS)} AS th, {sql_count('body', TOOLS)} + {sql_count('body', TOPICS)} AS ah, {sql_needles('body', SOFT)} AS soft,
        {sql_needles('title', EXPERIENCE)} AS te, {sql_needles('excerpt', EXPERIENCE)} AS be, {sql_needles('body', PROMO)} AS p, {sql_needles('body', NEWS)} AS n, {sql_needles('body', ACADEMIC)} AS a,
        title || chr(10) || substr(excerpt, 1, 400) AS head, CASE WHEN tail <> '' THEN tail ELSE right(excerpt, 400) END AS tailend FROM s0),
    s2 AS (SELECT *, CASE WHEN {sql_latin('body')} < 0.5 AND {sql_latin('title')} < 0.5 THEN 'language' WHEN {sql_patterns('bt', _R.job_headings)} >= 2 THEN 'job' WHEN regexp_matches(title, '{_R.hard_promo}') THEN 'promo' WHEN ah + soft = 0 THEN 'no-hit' END AS closed FROM s1),
    scored AS (SELECT *, CASE WHEN closed IS NOT NULL THEN 0 ELSE
        CASE WHEN th >= 1 THEN 6 + least(th - 1, 2) ELSE least(ah, 2) END + least(soft, 2) + CASE WHEN regexp_matches(title, '{_R.first_person}') THEN 4 ELSE 0 END + CASE WHEN te > 0 THEN 3 ELSE 0 END + least(be, 3)
        - CASE WHEN regexp_matches(title, '{_R.question}') THEN 3 ELSE 0 END - 4 * p - 2 * n - 2 * a
        - CASE WHEN regexp_matches(head, '{_R.self_promo}') THEN 6 WHEN regexp_matches(tailend, '{_R.self_promo}') THEN 3 ELSE 0 END - CASE WHEN regexp_matches(body, '{_R.coach_promo}') THEN 6 ELSE 0 END - CASE WHEN regexp_matches(body, '{_R.machine_report}') OR regexp_matches(tail, '{_R.machine_report}') THEN 6 ELSE 0 END
        - CASE WHEN {sql_patterns('bt', _R.listicle_headings)} >= 2 THEN 8 ELSE 0 END - CASE WHEN regexp_matches(title, '{_R.serial_title}') THEN CASE WHEN be >= 4 THEN 2 ELSE 4 END ELSE 0 END
        + CASE WHEN thread AND length(excerpt) < 600 THEN -3 WHEN thread AND length(excerpt) >= 1800 THEN 1 ELSE 0 END + CASE WHEN views >= 2000 THEN 1 ELSE 0 END END AS score FROM s2),
    judged AS (SELECT *, CASE WHEN closed IS NULL AND score >= {_R.threshold} THEN 'shortlist' ELSE 'reject' END AS verdict FROM scored)"""


def scored(spark, sf_dir) -> DataFrame:
    return scoring.score_items(items(spark, sf_dir), RULES)


@query(f"WITH {ITEMS} SELECT ord AS doc_id, source, thin FROM items")
def thin_flag(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", T.thin(F.substring("text", 1, 2500)).alias("thin"))


@query(f"WITH {ITEMS} SELECT ord AS doc_id FROM items WHERE thin AND NOT (thread AND excerpt <> '')")
def needs_enrich(spark, sf_dir):
    return items(spark, sf_dir).where(collect.needs_enriching(F.col("excerpt"), F.col("thread"))).select(F.col("ord").alias("doc_id"))


@query(f"""WITH {ITEMS}, firsts AS (SELECT ord, substr(excerpt, 1, 150) AS excerpt, excerpt AS fetched FROM items),
    merged AS (SELECT ord, CASE WHEN length(fetched) >= 250 AND length(fetched) >= 2 * length(excerpt) THEN fetched ELSE excerpt END AS excerpt FROM firsts)
    SELECT ord AS doc_id, length(excerpt) AS n_chars, length(excerpt) < 250 AS thin FROM merged""")
def enrich_accept(spark, sf_dir):
    whole = items(spark, sf_dir).select("ord", "id", "excerpt")
    short = whole.select("ord", "id", F.substring("excerpt", 1, 150).alias("excerpt"))
    out = collect.enrich(short, whole.select("id", F.col("excerpt").alias("text")))
    return out.select(F.col("ord").alias("doc_id"), F.char_length("excerpt").cast("long").alias("n_chars"), "thin")


@query(f"WITH {ITEMS} SELECT ord AS doc_id, title_key FROM items")
def title_key(spark, sf_dir):
    return items(spark, sf_dir).select(F.col("ord").alias("doc_id"), "title_key")


@query(f"""WITH {ITEMS}, {SCORED}, best AS (SELECT *, CASE WHEN title_key = '' THEN 1 ELSE row_number() OVER (PARTITION BY title_key ORDER BY thin, score DESC, published_at DESC NULLS LAST, ord) END AS copy_rank FROM judged)
    SELECT ord AS doc_id, title_key, score FROM best WHERE copy_rank = 1""")
def title_best_copy(spark, sf_dir):
    return tri.best_copies(scored(spark, sf_dir)).where("copy_rank = 1").select(F.col("ord").alias("doc_id"), "title_key", "score")


@query(f"WITH {ITEMS} SELECT ord AS doc_id, {sql_ids('excerpt', TOOLS)} AS tools, {sql_ids('excerpt', TOPICS)} AS topics FROM items")
def vocab_hits(spark, sf_dir):
    x = F.col("excerpt")
    return items(spark, sf_dir).select(F.col("ord").alias("doc_id"), F.array_join(TOOLS.matches(x), ",").alias("tools"), F.array_join(TOPICS.matches(x), ",").alias("topics"))


def as_table(spark, vocabulary: Vocabulary) -> DataFrame:
    rows = [(e.id, n, list(e.not_)) for e in vocabulary.entries for n in e.needles()]
    return matching.entries(spark.createDataFrame(rows, "id string, name string, masks array<string>"), masks="masks")


@query(f"WITH {ITEMS}, f AS (SELECT ord, unnest(string_split({sql_ids('excerpt', TOOLS)}, ',')) AS entry FROM items UNION ALL SELECT ord, unnest(string_split({sql_ids('excerpt', TOPICS)}, ',')) FROM items) SELECT ord AS doc_id, entry FROM f WHERE entry <> ''")
def vocab_hits_indexed(spark, sf_dir):
    """The rows of vocab_hits, with the vocabularies as a table."""
    found = matching.match(items(spark, sf_dir), matching.index(as_table(spark, TOOLS).unionByName(as_table(spark, TOPICS))), "ord", "excerpt")
    return matching.matched_ids(found, "ord").withColumnRenamed("ord", "doc_id")


_HOLDS = "contains(low, needle) AND (regexp_matches(needle, '[^\x00-\x7F]') OR regexp_matches(low, '(^|[^a-z0-9&])' || regexp_escape(needle) || '($|[^a-z0-9])'))"


@query(f"""WITH v AS (SELECT item_id AS entry, lower(regexp_extract(text, '^[^ \n]+ [^ \n]+ [^ \n]+')) AS needle FROM benchmark UNION SELECT item_id, lower(regexp_extract(text, '[^ \n]+ [^ \n]+$')) FROM benchmark),
    d AS (SELECT doc_id, lower(text) AS low FROM documents) SELECT DISTINCT doc_id, entry FROM d, v WHERE needle <> '' AND {_HOLDS}""")
def phrase_hits(spark, sf_dir):
    """A vocabulary made of the first three and last two words of each benchmark item, in all documents."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.regexp_extract("text", "^[^ \n]+ [^ \n]+ [^ \n]+", 0).alias("name"), F.array(F.regexp_extract("text", "[^ \n]+ [^ \n]+$", 0)).alias("aka"))
    docs = texts(spark, sf_dir, "documents").select("doc_id", "text")
    return matching.matched_ids(matching.match(docs, matching.index(matching.entries(b, aka="aka")), "doc_id"), "doc_id")


@query(f"""WITH v AS (SELECT DISTINCT lower(p_name) AS needle FROM part), d AS (SELECT lower(text) AS low FROM documents), p AS (SELECT lower(html) AS low FROM pages)
    SELECT needle, (SELECT count(*) FROM d WHERE {_HOLDS}) AS in_documents, (SELECT count(*) FROM p WHERE {_HOLDS}) AS in_pages FROM v""")
def part_name_counts(spark, sf_dir):
    """How many documents and pages hold each part's name, also for names that none holds."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("id"), F.col("p_name").alias("name")).distinct()
    indexed = matching.index(matching.entries(names))
    out = names.select(F.lower("name").alias("needle")).distinct()
    for name, key, text in (("documents", "doc_id", "text"), ("pages", "page_id", "html")):
        found = matching.match(texts(spark, sf_dir, name).select(key, text), indexed, key, text).groupBy("needle").agg(F.count("*").alias(f"in_{name}"))
        out = out.join(found, "needle", "left").withColumn(f"in_{name}", F.coalesce(f"in_{name}", F.lit(0)))
    return out


_MASKED = Vocabulary((Entry("license", "license", (), ("public license", "apache license")),))


@query(f"SELECT doc_id, {sql_any('text', _MASKED.entries[0])} AS found FROM documents")
def vocab_masked(spark, sf_dir):
    return texts(spark, sf_dir, "documents").select("doc_id", (F.size(_MASKED.matches(F.col("text"))) > 0).alias("found"))


@query(f"WITH {ITEMS}, {SCORED} SELECT closed, count(*) AS n FROM judged WHERE closed IS NOT NULL GROUP BY closed")
def gate_tally(spark, sf_dir):
    return scored(spark, sf_dir).where("closed is not null").groupBy("closed").agg(F.count("*").alias("n"))


@query(f"WITH {ITEMS} SELECT ord AS doc_id, {sql_patterns('excerpt || chr(10) || tail', _R.job_headings)} AS headings FROM items")
def gate_headings(spark, sf_dir):
    both = F.concat_ws("\n", "excerpt", "tail")
    return items(spark, sf_dir).select(F.col("ord").alias("doc_id"), scoring._count(both, RULES.job_headings).alias("headings"))


@query(f"WITH {ITEMS}, {SCORED} SELECT ord AS doc_id, CAST(score AS INTEGER) AS score, verdict, closed FROM judged")
def score_rules(spark, sf_dir):
    return scored(spark, sf_dir).select(F.col("ord").alias("doc_id"), "score", "verdict", "closed")


TRIAGE = f"""{ITEMS}, {SCORED},
    t0 AS (SELECT *, lang AS run, CASE WHEN summary_page THEN 'summary-page' WHEN verdict <> 'shortlist' THEN 'verdict' END AS why0 FROM judged),
    t1 AS (SELECT *, CASE WHEN title_key = '' THEN 1 ELSE row_number() OVER (PARTITION BY run, title_key ORDER BY thin, score DESC, published_at DESC NULLS LAST, ord) END AS copy_rank FROM t0 WHERE why0 IS NULL),
    t2 AS (SELECT *, sum(CASE WHEN NOT thin THEN 1 ELSE 0 END) OVER (PARTITION BY run) AS rd, row_number() OVER (PARTITION BY run, thin ORDER BY score DESC, ord) AS tr FROM t1 WHERE copy_rank = 1),
    t3 AS (SELECT *, CASE WHEN thin AND tr > greatest(3, round(rd * 0.25 / 0.75)) THEN 'thin' END AS tgate FROM t2),
    t4 AS (SELECT *, row_number() OVER (PARTITION BY run, source ORDER BY score DESC, ord) AS rn, sum(CASE WHEN thread THEN 1 ELSE 0 END) OVER (PARTITION BY run) AS nf FROM t3 WHERE tgate IS NULL),
    t5 AS (SELECT *, least(nf, greatest(6, round(60 * 0.4))) AS reserve, rn <= 16 AS inn FROM t4),
    t6 AS (SELECT *, row_number() OVER (PARTITION BY run, inn, thread ORDER BY rn > 8, score DESC, ord) AS seat0 FROM t5),
    t7 AS (SELECT *, inn AND NOT thread AND seat0 <= 60 - reserve AS article FROM t6),
    t8 AS (SELECT *, sum(CASE WHEN article THEN 1 ELSE 0 END) OVER (PARTITION BY run) AS ta FROM t7),
    t9 AS (SELECT *, article OR (inn AND thread AND seat0 <= least(greatest(6, least(reserve, round(ta * 0.4 / 0.6))), 60 - ta)) AS chosen FROM t8),
    t10 AS (SELECT *, sum(CASE WHEN chosen THEN 1 ELSE 0 END) OVER (PARTITION BY run, source) AS used FROM t9),
    final AS (SELECT ord, run, CASE WHEN chosen THEN 'shortlist' ELSE 'rejected' END AS outcome, CASE WHEN chosen THEN NULL WHEN used >= 16 THEN 'quota' WHEN thread THEN 'forum-share' ELSE 'cap' END AS gate, NULL AS why FROM t10
        UNION ALL SELECT ord, run, 'rejected', 'thin', NULL FROM t3 WHERE tgate = 'thin' UNION ALL SELECT ord, run, 'rejected', NULL, 'copy' FROM t1 WHERE copy_rank > 1 UNION ALL SELECT ord, run, 'rejected', NULL, why0 FROM t0 WHERE why0 IS NOT NULL)"""


def triaged(spark, sf_dir) -> DataFrame:
    return tri.triage(scored(spark, sf_dir).withColumn("run", F.col("lang")))


@query(f"WITH {TRIAGE} SELECT ord AS doc_id, run FROM final WHERE outcome = 'shortlist'")
def triage_shortlist(spark, sf_dir):
    return triaged(spark, sf_dir).where("outcome = 'shortlist'").select(F.col("ord").alias("doc_id"), "run")


@query(f"WITH {TRIAGE} SELECT run, outcome, gate, why, count(*) AS n FROM final GROUP BY ALL")
def triage_rejected_gates(spark, sf_dir):
    return triaged(spark, sf_dir).groupBy("run", "outcome", "gate", "why").agg(F.count("*").alias("n"))


@query(f"WITH {TRIAGE} SELECT count(*) AS fetched, count(CASE WHEN outcome = 'shortlist' THEN 1 END) AS shortlisted, count(CASE WHEN outcome = 'rejected' THEN 1 END) AS rejected, count(CASE WHEN gate = 'thin' THEN 1 END) AS gate_thin, count(CASE WHEN gate = 'quota' THEN 1 END) AS gate_quota, count(CASE WHEN gate = 'forum-share' THEN 1 END) AS gate_forum_share, count(CASE WHEN gate = 'cap' THEN 1 END) AS gate_cap FROM final")
def triage_metrics(spark, sf_dir):
    """Counts of a triage as its rows were written, checked against its laws."""
    df, seen = tri.observed(triaged(spark, sf_dir))
    written(df)
    got = tri.conserved(seen)
    names = ["fetched", "shortlisted", "rejected", "gate_thin", "gate_quota", "gate_forum_share", "gate_cap"]
    return spark.createDataFrame([tuple(got[n] for n in names)], ", ".join(f"{n} long" for n in names))


@query("""WITH r AS (SELECT c_custkey, c_nationkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer),
    s AS (SELECT *, row_number() OVER (ORDER BY rn > 4, c_acctbal DESC, c_custkey) AS seat FROM r WHERE rn <= 8) SELECT c_custkey, c_nationkey, seat::INTEGER AS seat FROM s WHERE seat <= 60""")
def quota_two_round(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.col("c_acctbal").alias("score"), F.col("c_custkey").alias("ord"))
    return tri.two_round_quota(rows, 4, 60, "c_nationkey").select("c_custkey", "c_nationkey", "seat")


@query(f"WITH {ITEMS} SELECT source, count(*) AS n, sum(thin::INT)::BIGINT AS thin, (count(*) - sum(thin::INT))::BIGINT AS readable, count(*) >= 10 AND sum(thin::INT) >= 0.5 * count(*) AS muted FROM items GROUP BY source")
def readable_corpus(spark, sf_dir):
    return views.readable_corpus(items(spark, sf_dir))


@query(f"WITH {ITEMS}, g AS (SELECT source, count(*) AS n, (epoch_us(max(published_at)) - epoch_us(min(published_at))) / 3600000000.0 AS hours FROM items WHERE published_at IS NOT NULL GROUP BY source) SELECT *, n >= 15 AND hours < 24 AS narrow FROM g")
def sampling_windows(spark, sf_dir):
    return views.sampling_windows(items(spark, sf_dir))


@query(f"""WITH {ITEMS}, g AS (SELECT source, count(*) AS n, avg((published_at IS NOT NULL)::INT::DOUBLE) AS dated, avg((length(excerpt) > 400)::INT::DOUBLE) AS with_body, max(published_at) AS latest FROM items GROUP BY source)
    SELECT source, n, dated, with_body, round((epoch_us(TIMESTAMP '2024-03-01') - epoch_us(latest)) / 86400000000.0)::INTEGER AS age_days FROM g""")
def feed_grade(spark, sf_dir):
    return views.grade(items(spark, sf_dir).withColumn("body", F.col("excerpt")), F.lit("2024-03-01 00:00:00").cast("timestamp")).drop("latest")


@query(f"""WITH {ITEMS}, f AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ord) AS rn, {sql_count('excerpt', TOOLS)} AS h FROM items),
    g AS (SELECT source, count(*) AS n, sum((h > 0)::INT)::BIGINT AS hits, round((epoch_us(TIMESTAMP '2024-03-01') - max(epoch_us(published_at))) / 86400000000.0)::INTEGER AS age_days, (max(epoch_us(published_at)) - min(epoch_us(published_at))) / 86400000000.0 AS span_days FROM f WHERE rn <= 20 GROUP BY source)
    SELECT source, n, hits, age_days, CASE WHEN coalesce(age_days > 120, true) THEN 'inactive' WHEN n >= 10 AND span_days < 14 THEN 'media' WHEN hits < 2 THEN 'off-topic' ELSE 'good' END AS verdict FROM g""")
def feed_evaluate(spark, sf_dir):
    rows = items(spark, sf_dir).withColumn("tools", TOOLS.matches(F.col("excerpt"))).withColumn("hits", F.size("tools"))
    return views.evaluate(rows, F.lit("2024-03-01 00:00:00").cast("timestamp")).select("source", "n", "hits", "age_days", "verdict")


@query("SELECT count(n_chars) AS n, min(n_chars) AS least, round(median(n_chars))::BIGINT AS median, max(n_chars) AS most, sum(CASE WHEN n_chars < 350 OR n_chars > 500 THEN 1 ELSE 0 END)::BIGINT AS outliers FROM documents")
def summary_length_report(spark, sf_dir):
    return views.length_report(table(spark, sf_dir, "documents"))


_BREAK = "WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, source) AS rk FROM c) SELECT CASE WHEN rk <= 5 {pin} THEN source ELSE '其他' END AS name, sum(n)::BIGINT AS n FROM r GROUP BY 1"


@query(_BREAK.format(pin=""))
def source_breakdown_top_n(spark, sf_dir):
    return views.breakdown(table(spark, sf_dir, "documents"))


@query(_BREAK.format(pin="OR source IN ('src7', 'src19')"))
def source_breakdown_pinned(spark, sf_dir):
    return views.breakdown(table(spark, sf_dir, "documents"), pinned=("src7", "src19"))


@query(f"WITH {ITEMS}, v AS (SELECT unnest(string_split({sql_ids('excerpt', TOOLS)}, ',')) AS value FROM items) SELECT value, count(*) AS n FROM v WHERE value <> '' GROUP BY value")
def facet_counts(spark, sf_dir):
    return views.facets(items(spark, sf_dir).select(TOOLS.matches(F.col("excerpt")).alias("tools")), "tools")


@query("""SELECT doc_id, CASE WHEN lang IN ('en', 'de') THEN lang ELSE '其他' END AS "group", CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END AS group_ord FROM documents""")
def group_by_type(spark, sf_dir):
    return views.grouped(table(spark, sf_dir, "documents"), ("en", "de"), "lang").select("doc_id", "group", "group_ord")


@query("SELECT c_mktsegment AS source, sum(CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN 1 ELSE 0 END)::BIGINT AS today, count(*) AS \"window\" FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def counts_today_window(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("source")), "o_custkey")
    return views.counts_today(rows, F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))


@query(f"WITH {ITEMS} SELECT ord AS doc_id FROM items WHERE source = 'src3' AND (contains(lower(title), 'the') OR contains(lower(excerpt), 'the')) AND NOT EXISTS (SELECT 1 FROM events e WHERE e.event_id = items.ord AND e.event_type = 'click')")
def page_filter(spark, sf_dir):
    state = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), (F.col("event_type") == "click").cast("int").alias("is_read"))
    return views.page_filter(items(spark, sf_dir), "src3", "unread", "The", state, ("title", "excerpt")).select(F.col("ord").alias("doc_id"))


@query("SELECT count(*) AS total, sum(CASE WHEN e.event_type = 'click' THEN 0 ELSE 1 END)::BIGINT AS unread, sum(CASE WHEN e.event_type = 'purchase' THEN 1 ELSE 0 END)::BIGINT AS starred FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id")
def reader_stats(spark, sf_dir):
    state = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("event_type") == "click").cast("int").alias("is_read"), (F.col("event_type") == "purchase").cast("int").alias("is_starred"))
    return views.reader_stats(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), state)


@query(f"""WITH {ITEMS}, x AS (SELECT unnest([{{'scope': 'title', 'text': title}}, {{'scope': 'excerpt', 'text': excerpt}}, {{'scope': 'both', 'text': title || chr(10) || excerpt}}]) AS x, l.quality = 1 AS known FROM items LEFT JOIN labels l ON l.doc_id = items.ord)
    SELECT x.scope AS scope, count(x.text) AS texts, sum(regexp_matches(x.text, 'licen[sc]e')::INT)::BIGINT AS hits, sum((regexp_matches(x.text, 'licen[sc]e') AND coalesce(known, false))::INT)::BIGINT AS known_hits FROM x GROUP BY 1""")
def pattern_probe(spark, sf_dir):
    good = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ord"), (F.col("quality") == 1).alias("good"))
    return views.probe(items(spark, sf_dir).join(good, "ord", "left"), "licen[sc]e", F.coalesce("good", F.lit(False)))


@query(f"WITH {ITEMS}, pub AS (SELECT DISTINCT regexp_replace(lower(regexp_extract(text, '^[^\\n]*', 0)), '[^0-9a-z]+', '', 'g') AS k FROM benchmark) SELECT ord AS doc_id, title_key IN (SELECT k FROM pub) AS published FROM items WHERE title_key <> ''")
def published_title_semi(spark, sf_dir):
    pub = table(spark, sf_dir, "benchmark").select(T.title_key(F.regexp_extract("text", "^[^\\n]*", 0)).alias("title_key")).distinct().withColumn("p", F.lit(True))
    return items(spark, sf_dir).where("title_key <> ''").join(pub, "title_key", "left").select(F.col("ord").alias("doc_id"), F.coalesce("p", F.lit(False)).alias("published"))


@query(f"WITH {ITEMS}, v AS (SELECT ord, source, lang, {sql_latin('excerpt')} AS q FROM items) SELECT CAST(ord AS VARCHAR) AS id, 'tail' AS field FROM items WHERE tail = '' UNION ALL SELECT CAST(ord AS VARCHAR), 'published_at' FROM items WHERE published_at IS NULL")
def validate_required(spark, sf_dir):
    return views.missing_fields(items(spark, sf_dir), ("title", "source", "tail", "published_at"))


@query("SELECT replace('%s review', '%s', n_name) AS query, n_name AS name FROM nation UNION ALL SELECT replace('how to %s', '%s', n_name), n_name FROM nation")
def derived_query_pool(spark, sf_dir):
    return derived_queries(table(spark, sf_dir, "nation"), ["%s review", "how to %s"], "n_name")


@query(f"""WITH {ITEMS}, m AS (SELECT source FROM items GROUP BY source HAVING count(*) >= 10 AND sum(thin::INT) >= 0.02 * count(*)), pr AS (SELECT CAST(doc_id AS VARCHAR) AS id FROM labels WHERE quality = 1)
    SELECT ord AS doc_id FROM items WHERE thin AND source IN (SELECT source FROM m) ORDER BY (id IN (SELECT id FROM pr)) DESC, ord LIMIT 25""")
def reenrich_targets(spark, sf_dir):
    rows = items(spark, sf_dir)
    muted = views.readable_corpus(rows, 0.02).where("muted")
    priority = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("id"))
    return collect.select_targets(rows, muted, priority, 25).select(F.col("ord").alias("doc_id"))
