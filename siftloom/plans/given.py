"""Queries of the readers and views over the given tables: pages that link to each other, and conversations, pages and events written as the feeds,
index files and answers of search interfaces that the readers take apart again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.functions import dates as D
from siftloom.functions import text as T
from siftloom.functions import url as U
from siftloom.functions.vocab import Entry, Vocabulary
from siftloom.operators import adapters, collect, discovery, feeds, ledger, scoring, state, views

from .registry import query, table, texts
from .runs import _UPSERT, events, state_upsert, today

# pages ---------------------------------------------------------------------------------------------------------------------

_HOST = "regexp_replace(lower(regexp_extract({u}, '^(?i:https?)://([^/?#:]+)', 1)), '^www\\.', '')"
_ORIGIN = "regexp_extract({u}, '^(https?://[^/?#]+)', 1)"
_LINKED = f"""w AS (SELECT a.page_id, a.url, b.url AS link FROM pages a JOIN pages b ON b.page_id IN (a.page_id + 1, a.page_id + 7)),
    l AS (SELECT DISTINCT {_HOST.format(u='url')} AS seed, {_HOST.format(u='link')} AS host FROM w), o AS (SELECT * FROM l WHERE host <> seed AND NOT ends_with(host, '.' || seed) AND NOT ends_with(seed, '.' || host))"""


def linked(spark, sf_dir) -> DataFrame:
    """Pages with links to the pages one and seven after them."""
    pages = texts(spark, sf_dir, "pages")
    other = pages.select(F.explode(F.array(F.col("page_id") - 1, F.col("page_id") - 7)).alias("page_id"), F.concat(F.lit('<a class="x" href="'), "url", F.lit('">next</a>')).alias("a"))
    links = other.groupBy("page_id").agg(F.array_join(F.collect_list("a"), " ").alias("links"))
    return pages.join(links, "page_id", "left").select("page_id", "url", F.concat("html", F.coalesce("links", F.lit(""))).alias("html"))


@query(f"WITH {_LINKED} SELECT seed, host FROM o")
def outbound_hosts(spark, sf_dir):
    return discovery.outbound(linked(spark, sf_dir)).select("seed", "host")


@query(f"WITH {_LINKED} SELECT host, count(DISTINCT seed) AS links, min(seed) AS example FROM o GROUP BY host HAVING count(DISTINCT seed) >= 2")
def inbound_links(spark, sf_dir):
    """Hosts that pages of at least two other hosts link to."""
    return views.inbound(discovery.outbound(linked(spark, sf_dir)), 2)


@query(f"SELECT page_id, {_ORIGIN.format(u='url')} || '/feed/' || page_id AS feed FROM pages")
def declared_feeds(spark, sf_dir):
    """Pages that declare a feed at a place of their own."""
    tag = F.concat(F.lit("<link href='/feed/"), F.col("page_id").cast("string"), F.lit("' rel=alternate type=\"application/rss+xml\"><link rel=stylesheet href=x.css>"))
    return texts(spark, sf_dir, "pages").select("page_id", F.explode(discovery.declared_feeds(F.concat(tag, "html"), F.col("url"))).alias("feed"))


_PATHS = "[" + ", ".join(f"'{p}'" for p in discovery.FEED_PATHS) + "]"


@query(f"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '') AS base, lower({_ORIGIN.format(u='url')}) AS origin FROM pages)
    SELECT page_id, unnest(list_distinct(list_concat(list_transform({_PATHS}, lambda p: base || '/' || p), list_transform({_PATHS}, lambda p: origin || '/' || p)))) AS feed FROM b""")
def candidate_feeds(spark, sf_dir):
    return texts(spark, sf_dir, "pages").select("page_id", F.explode(discovery.candidate_feeds(F.col("url"))).alias("feed"))


def by_host(spark, sf_dir, line: Column, between: str = "\n") -> DataFrame:
    """(host, text): a file for each host of pages, with a line for each page in the order of ids."""
    rows = texts(spark, sf_dir, "pages").select(U.host(F.col("url")).alias("host"), "page_id", line.alias("line"))
    return rows.groupBy("host").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "line"))), lambda x: x["line"]), between).alias("text"))


@query(f"SELECT {_HOST.format(u='url')} AS title, url AS feed, CASE WHEN page_id % 3 = 0 THEN url ELSE {_ORIGIN.format(u='url')} END AS site FROM pages")
def opml_index(spark, sf_dir):
    site = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.regexp_extract("url", "^(https?://[^/?#]+)", 1))
    line = F.concat(F.lit('<outline text="'), U.host(F.col("url")), F.lit('" xmlUrl="'), "url", F.lit('" htmlUrl="'), site, F.lit('"/>'))
    return discovery.opml(by_host(spark, sf_dir, line))


@query(f"SELECT 'p' || page_id AS title, {_ORIGIN.format(u='url')} AS site, url AS feed, 'a,b' AS tags FROM pages WHERE page_id % 5 <> 0")
def csv_feed_index(spark, sf_dir):
    feed = F.when(F.col("page_id") % 5 == 0, F.lit("none")).otherwise(F.col("url"))
    line = F.concat_ws(",", F.concat(F.lit("p"), "page_id"), F.regexp_extract("url", "^(https?://[^/?#]+)", 1), F.concat(feed, F.lit(" ")), F.lit("a"), F.lit(" b"))
    files = by_host(spark, sf_dir, line).select(F.concat(F.lit("title,site,feed,tags\n"), "text").alias("text"))
    return discovery.csv_index(files)


_BARE = "replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', ''), '.example.', '.sample.')"


@query(f"SELECT DISTINCT {_BARE} || '/feed.xml' AS feed FROM pages")
def markdown_feed_index(spark, sf_dir):
    bare = F.replace(F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/$", ""), F.lit(".example."), F.lit(".sample."))
    line = F.concat(F.lit("- see "), bare, F.lit("/feed.xml. Not "), bare, F.lit("/page, nor https://github.com/a/feed.xml)"))
    return discovery.markdown_feeds(by_host(spark, sf_dir, line))


@query(f"SELECT {_HOST.format(u='url')} AS host, lower(arg_min({_ORIGIN.format(u='url')}, page_id)) AS origin, arg_min(url || '/rss.xml', page_id) FILTER (page_id % 2 = 0) AS feed FROM pages GROUP BY 1")
def site_list_index(spark, sf_dir):
    line = F.concat(F.lit("("), F.col("url"), F.when(F.col("page_id") % 2 == 0, F.lit("/rss.xml")).otherwise(F.lit("/about")), F.lit(")"))
    return discovery.site_list(by_host(spark, sf_dir, line))


@query(f"SELECT {_HOST.format(u='url')} AS host, 'blog ' || min(page_id) AS name, 'https://' || lower(arg_min(regexp_extract(url, '^https?://([^/?#]+)', 1), page_id)) AS origin FROM pages GROUP BY 1")
def domain_index(spark, sf_dir):
    entry = F.to_json(F.struct(F.concat(F.lit("blog "), "page_id").alias("blogName"), F.concat(F.lit(" "), F.regexp_extract("url", "^https?://([^/?#]+)", 1)).alias("domainName")))
    files = by_host(spark, sf_dir, entry, ",").select(F.concat(F.lit("["), "text", F.lit("]")).alias("text"))
    return discovery.domain_list(files)


@query(f"""WITH u AS (SELECT {_HOST.format(u='url')} AS source, page_id, url AS link, CASE WHEN page_id % 9 > 0 THEN DATE '2024-01-01' + CAST(page_id % 60 AS INTEGER) END AS day FROM pages WHERE contains(url, '/en/')),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY day DESC NULLS LAST, page_id) AS rank FROM u WHERE day IS NULL OR day >= DATE '2024-03-01' - 45) SELECT source, link, CAST(day AS VARCHAR) AS day, rank::INTEGER AS rank FROM r WHERE rank <= 3""")
def sitemap_targets(spark, sf_dir):
    """A site map for each host: the newest three addresses of 45 days that fit a pattern, those without a date last."""
    day = F.when(F.col("page_id") % 9 > 0, F.concat(F.lit("<lastmod>"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 60).cast("int")).cast("string"), F.lit("</lastmod>"))).otherwise("")
    line = F.concat(F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc>"), day, F.lit("</url>"))
    maps = by_host(spark, sf_dir, line, "").select(F.col("host").alias("source"), F.concat(F.lit("<urlset>"), "text", F.lit("</urlset>")).alias("body"))
    got = adapters.sitemap_targets(maps, D.midnight(F.lit("2024-03-01").cast("date")), "/en/", 45, 3)
    return got.select("source", "link", D.day(F.col("lastmod"), "UTC").cast("string").alias("day"), "rank")


@query("SELECT page_id, regexp_replace(url, '[.,;:!?)\\]]+$', '') AS site FROM pages")
def sites_in_bios(spark, sf_dir):
    """Profiles that name a page behind one on a platform."""
    bio = F.concat(F.lit("I write. https://github.com/x, https://a.github.com/y; "), "url", F.lit("!) and more https://later.org"))
    return texts(spark, sf_dir, "pages").select("page_id", T.site_from_bio(bio, ["github.com"]).alias("site"))


@query(f"SELECT DISTINCT {_HOST.format(u='url')} AS host FROM pages WHERE page_id % 3 <> 0")
def denied_hosts(spark, sf_dir):
    """Pages as lines of a list of what is denied: a third only as feeds, the others as whole hosts under one key or another."""
    m = F.col("page_id") % 3
    rows = table(spark, sf_dir, "pages").select(F.when(m == 0, "feed").otherwise("host").alias("scope"), F.when(m == 1, F.col("url")).alias("feed"), F.when(m == 0, F.col("url")).alias("url"), F.when(m == 2, U.host(F.col("url"))).alias("domain"))
    return discovery.denied_hosts(rows)


@query(f"SELECT DISTINCT {_HOST.format(u='url')} AS host FROM pages UNION SELECT lower(n_name) || '.example' FROM nation WHERE NOT contains(n_name, ' ')")
def known_hosts(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").where("not contains(n_name, ' ')").select(F.concat(F.lit("https://www."), F.lower("n_name"), F.lit(".example/")).alias("url"))
    return discovery.known_hosts(table(spark, sf_dir, "pages"), nations)


# conversations as feeds and answers ------------------------------------------------------------------------------------------

_CLEAN = "trim(regexp_replace(regexp_replace(substr(coalesce(text, ''), 1, 60), '[^A-Za-z ]', '', 'g'), ' +', ' ', 'g'))"


def turns(spark, sf_dir) -> DataFrame:
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.substring(F.coalesce("text", F.lit("")), 1, 60), "[^A-Za-z ]", ""), " +", " "))
    link = F.concat(F.lit("http://c.example/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    return texts(spark, sf_dir, "conversations").select("conv_id", "turn", "role", clean.alias("title"), link.alias("link"))


@query(f"""SELECT CAST(conv_id AS VARCHAR) AS source, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS ord, {_CLEAN} AS title, 'http://c.example/' || conv_id || '/' || turn AS link,
    '2024-08-05 0' || turn % 10 || ':00:00' AS published_at, CASE WHEN conv_id % 4 = 3 THEN '' ELSE {_CLEAN} END AS content_html FROM conversations""")
def feed_entries(spark, sf_dir):
    """Each conversation as a feed: RSS, Atom, RSS 1.0, and a podcast whose items have only an enclosure."""
    t = turns(spark, sf_dir)
    kind, hour = F.col("conv_id") % 4, (F.col("turn") % 10).cast("string")
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    mail, iso = F.concat(F.lit("Mon, 05 Aug 2024 0"), hour, F.lit(":00:00 GMT")), F.concat(F.lit("2024-08-05T0"), hour, F.lit(":00:00Z"))
    title, link = tag("title", F.col("title")), tag("link", F.col("link"))
    item = (
        F.when(kind == 0, tag("item", F.concat(title, link, tag("pubDate", mail), tag("description", F.col("title")))))
        .when(kind == 1, tag("entry", F.concat(title, F.lit('<link rel="alternate" href="'), "link", F.lit('"/>'), tag("published", iso), tag("summary", F.col("title")))))
        .when(kind == 2, tag("item", F.concat(title, link, tag("dc:date", iso), tag("description", F.col("title")))))
        .otherwise(tag("item", F.concat(title, F.lit('<enclosure url="'), "link", F.lit('"/><guid>no address</guid>'), tag("pubDate", mail))))
    )
    files = t.select("conv_id", F.struct("turn", item.alias("item")).alias("x")).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["item"]), "").alias("items"))
    whole = F.when(kind == 1, tag("feed", F.col("items"))).when(kind == 2, F.concat(F.lit("<rdf:RDF><channel/>"), "items", F.lit("</rdf:RDF>"))).otherwise(F.concat(F.lit("<rss><channel><title>c</title>"), "items", F.lit("</channel></rss>")))
    got = feeds.parse_feeds(files.select(F.col("conv_id").cast("string").alias("source"), whole.alias("body")))[0]
    return got.select("source", "ord", "title", "link", F.date_format(F.convert_timezone(None, F.lit("UTC"), F.col("published_at").cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss").alias("published_at"), "content_html")


@query("SELECT CAST(conv_id AS VARCHAR) AS source, 'neither RSS nor Atom' AS message FROM conversations WHERE turn = 0")
def feed_errors(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("turn = 0").select(F.col("conv_id").cast("string").alias("source"), F.concat(F.lit("<html>"), F.coalesce("text", F.lit("")), F.lit("</html>")).alias("body"))
    return feeds.parse_feeds(rows)[1]


def answers(rows: DataFrame, kind: str, entries: Column, wrap) -> DataFrame:
    """Entries of search results, one answer for each ten conversations, whose number is the query's."""
    q = F.floor(F.col("conv_id") / 10)
    bodies = rows.groupBy(q.alias("q")).agg(F.array_sort(F.collect_list(entries)).alias("rows"))
    payloads = bodies.select(F.lit("s").alias("source"), F.col("q").cast("string").alias("query"), F.col("q").cast("int").alias("query_ord"), F.lit("https://d.example").alias("base"), wrap(F.col("rows")).alias("body"))
    return adapters.search_results(payloads, kind)[0]


def threads(spark, sf_dir) -> DataFrame:
    """Each conversation with its first turn and how many follow."""
    t = turns(spark, sf_dir)
    return t.groupBy("conv_id").agg(F.min_by("title", "turn").alias("title"), F.min_by("role", "turn").alias("role"), (F.count("*") - 1).alias("replies"))


_THREADS = f"t AS (SELECT conv_id, arg_min({_CLEAN}, turn) AS title, arg_min(role, turn) AS role, count(*) - 1 AS replies FROM conversations GROUP BY conv_id)"


@query(f"WITH {_THREADS} SELECT 'https://d.example/t/s/' || conv_id AS link, length(title) AS n_chars, replies FROM t")
def first_post_join(spark, sf_dir):
    """Topics of a forum's answer, joined with their first posts, by the reader of such answers."""
    topic = F.struct(F.col("conv_id").alias("id"), F.concat(F.lit("c"), "conv_id").alias("title"), F.lit("s").alias("slug"), F.lit("2024-01-05T08:00:00Z").alias("created_at"), (F.col("replies") + 1).alias("posts_count"), F.col("title").alias("blurb"), F.col("role").alias("username"))
    wrap = lambda rows: F.to_json(F.struct(rows.alias("topics"), F.transform(rows, lambda x: F.struct(x["id"].alias("topic_id"), F.lit(1).alias("post_number"), x["blurb"].alias("blurb"), x["username"].alias("username"))).alias("posts")))
    got = answers(threads(spark, sf_dir), "discourse", topic, wrap)
    return got.select("link", F.char_length("excerpt").cast("long").alias("n_chars"), F.col("comments").alias("replies"))


@query(f"WITH {_THREADS} SELECT 'https://www.v2ex.com/t/' || conv_id AS link, 'c' || conv_id AS title, role AS author, replies AS comments, title AS excerpt, epoch(TIMESTAMP '2024-01-05 08:00:00')::BIGINT AS at FROM t")
def search_v2ex(spark, sf_dir):
    hit = F.struct(F.struct(F.col("conv_id").alias("id"), F.concat(F.lit("c"), "conv_id").alias("title"), F.col("title").alias("content"), F.lit("2024-01-05T08:00:00").alias("created"), F.col("role").alias("member"), "replies").alias("_source"))
    got = answers(threads(spark, sf_dir), "v2ex", hit, lambda rows: F.to_json(F.struct(rows.alias("hits"))))
    return got.select("link", "title", "author", "comments", "excerpt", F.unix_seconds("published_at").alias("at"))


@query(f"WITH {_THREADS} SELECT 'https://juejin.cn/post/' || conv_id AS link, title, role AS author, replies AS comments, conv_id * 3 AS views, 1704441600 + conv_id AS at FROM t")
def search_juejin(spark, sf_dir):
    info = F.struct(F.col("conv_id").cast("string").alias("article_id"), "title", F.lit("").alias("brief_content"), (F.lit(1704441600) + F.col("conv_id")).cast("string").alias("ctime"), (F.col("conv_id") * 3).alias("view_count"), F.col("replies").alias("comment_count"))
    row = F.struct(F.struct(info.alias("article_info"), F.struct(F.col("role").alias("user_name")).alias("author_user_info")).alias("result_model"))
    got = answers(threads(spark, sf_dir), "juejin", row, lambda rows: F.to_json(F.struct(F.lit(0).alias("err_no"), rows.alias("data"))))
    return got.select("link", "title", "author", "comments", "views", F.unix_seconds("published_at").alias("at"))


@query(f"WITH {_THREADS} SELECT 'https://vocus.cc/article/' || conv_id AS link, 'c' || conv_id AS title, replies AS comments, conv_id * 2 AS views FROM t WHERE conv_id % 3 <> 0")
def search_vocus(spark, sf_dir):
    """Every third article is for members only and goes."""
    row = F.struct(F.col("conv_id").cast("string").alias("contentId"), F.concat(F.lit("c"), "conv_id").alias("title"), F.lit("2024-01-05T08:00:00Z").alias("publishAt"), (F.col("conv_id") % 3 == 0).alias("isPay"), (F.col("conv_id") * 2).alias("pageview"), F.col("replies").alias("commentCount"))
    got = answers(threads(spark, sf_dir), "vocus", row, lambda rows: F.to_json(F.struct(rows.alias("contents"))))
    return got.select("link", "title", "comments", "views")


# events, parts and documents --------------------------------------------------------------------------------------------------


@query("""SELECT event_id, CASE event_id % 4 WHEN 2 THEN epoch(CAST(CAST(ts AS DATE) AS TIMESTAMP)) WHEN 3 THEN epoch(date_trunc('second', ts)) - 8 * 3600 ELSE epoch(date_trunc('second', ts)) END::BIGINT AS at FROM events""")
def dates_parsed(spark, sf_dir):
    """The times of events written in four ways and read again."""
    m, ts = F.col("event_id") % 4, F.col("ts")
    text = (
        F.when(m == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).when(m == 1, F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).when(m == 2, F.date_format(ts, "MMMM d, yyyy"))
        .otherwise(F.concat(F.date_format(ts, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0800")))
    )
    return events(spark, sf_dir).select("event_id", F.unix_seconds(D.parse(text)).alias("at"))


@query("SELECT CAST(CAST(ts + INTERVAL 8 HOUR AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1")
def days_in_zone(spark, sf_dir):
    return events(spark, sf_dir).groupBy(D.day(D.utc(F.col("ts"))).cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("""SELECT CAST(d AS VARCHAR) AS day, CASE WHEN d = DATE '2024-01-28' THEN '今天' WHEN d = DATE '2024-01-27' THEN '昨天' ELSE month(d) || '月' || day(d) || '日 ' || ['周日', '周一', '周二', '周三', '周四', '周五', '周六'][dayofweek(d) + 1] END AS label FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events)""")
def day_labels(spark, sf_dir):
    days = events(spark, sf_dir).select(F.to_date("ts").alias("d")).distinct()
    return days.select(F.col("d").cast("string").alias("day"), D.label(F.col("d"), today()).alias("label"))


_WHITE = "[\\t\\n\\x0B\\f\\r \\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+"


@query(f"""WITH b AS (SELECT doc_id, regexp_replace(translate(coalesce(text, ''), 'aeiou', '一二三四五'), '{_WHITE}', '', 'g') AS bare FROM documents)
    SELECT doc_id, CASE WHEN bare = '' THEN 0.0 ELSE (length(bare) - length(regexp_replace(bare, '[\\x{{4E00}}-\\x{{9FFF}}\\x{{3400}}-\\x{{4DBF}}]+', '', 'g'))) * 1.0 / (length(bare) + len(regexp_extract_all(bare, '[\\x{{10000}}-\\x{{10FFFF}}]'))) END AS ratio FROM b""")
def script_ratio(spark, sf_dir):
    """The share of Han characters in documents whose vowels became such."""
    return texts(spark, sf_dir, "documents").select("doc_id", T.cjk_ratio(F.translate("text", "aeiou", "一二三四五")).alias("ratio"))


_NAME = "regexp_replace(regexp_replace(lower({x}), '\\b(podcast|the|show)\\b', '', 'g'), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


@query(f"""WITH p AS (SELECT p_partkey, {_NAME.format(x="'The ' || p_name || ' show'")} AS x, {_NAME.format(x="lead(CASE p_partkey % 3 WHEN 0 THEN p_name ELSE split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2) || 's' END) OVER (ORDER BY p_partkey)")} AS y,
    {_NAME.format(x="p_name || ' podcast'")} AS own FROM part)
    SELECT p_partkey, CASE WHEN y IS NULL OR y = '' THEN 0 WHEN x = y THEN 100 WHEN least(length(x), length(y)) >= 5 AND (starts_with(x, y) OR starts_with(y, x)) THEN 80 WHEN length(x) >= 5 AND contains(y, x) THEN 60 ELSE 0 END AS score, CASE WHEN x = own THEN 100 ELSE 0 END AS own_score FROM p""")
def name_scores(spark, sf_dir):
    """How alike each part's name is to the next one's, and to its own in other words."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    other = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" "), F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit("s"))).alias("listed"))
    title = F.concat(F.lit("The "), "p_name", F.lit(" show"))
    return part.join(other, "p_partkey", "left").select("p_partkey", T.name_match(title, F.col("listed")).alias("score"), T.name_match(title, F.concat("p_name", F.lit(" podcast"))).alias("own_score"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 AND lower(p_type) NOT IN ('p', 'archive', 'tag', 'category', 'news') THEN lower(p_type) END AS name FROM part")
def post_users(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("/p/"), F.lit("/archive/2024/"), F.lit("/rss/")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", T.user_of_post(F.concat(F.lit("https://www.cnblogs.com/"), "p_type", kind, F.col("p_partkey").cast("string"))).alias("name"))


@query("SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 3 = 0 THEN 'brief' END, CASE WHEN n_chars < 500 THEN 'thin' END) AS badges, CASE WHEN doc_id % 10 = 0 THEN 'ok' WHEN doc_id % 10 < 7 THEN 'shaky' ELSE 'dead' END AS state FROM documents")
def badges_and_states(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(T.badges(F.col("doc_id") % 3 == 0, F.col("n_chars") < 500), ",").alias("badges"), T.source_state(F.when(F.col("doc_id") % 10 > 0, F.col("doc_id") % 10)).alias("state"))


@query("SELECT event_id, (row_number() OVER (ORDER BY ts DESC, event_id))::INTEGER AS place FROM events QUALIFY place <= 100")
def newest_first(spark, sf_dir):
    return views.top(events(spark, sf_dir).select("event_id", "ts"), 100, F.desc("ts"), "event_id").select("event_id", "place")


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS user FROM events WHERE event_type = 'purchase' UNION SELECT '*' FROM events WHERE event_type = 'error'")
def users_handled(spark, sf_dir):
    e = events(spark, sf_dir)
    return discovery.handled_users(e.where("event_type = 'purchase'").select(F.col("user_id").cast("string").alias("user")), e.where("event_type = 'error'").select(F.lit(None).cast("string").alias("user")))


@query("SELECT CAST(user_id AS VARCHAR) AS id, CAST(min(CAST(ts AS DATE)) AS VARCHAR) AS first_date FROM events GROUP BY user_id HAVING min(CAST(ts AS DATE)) <> DATE '2024-01-02'")
def date_refetched(spark, sf_dir):
    """The ledger of first sights without a day, whose ids are then new again."""
    seen = events(spark, sf_dir).groupBy(F.col("user_id").cast("string").alias("id")).agg(F.min(F.to_date("ts")).alias("first_date"))
    return ledger.forget_date(seen, F.lit("2024-01-02").cast("date")).withColumn("first_date", F.col("first_date").cast("string"))


_FLAGS = f"{_UPSERT}, flags AS (SELECT user_email, item_id, 'read' AS flag FROM st WHERE is_read = 1 UNION ALL SELECT user_email, item_id, 'starred' FROM st WHERE is_starred = 1)"


@query(f"WITH {_FLAGS} SELECT * FROM flags WHERE item_id <> 'error'")
def state_exported(spark, sf_dir):
    """Reader state as exported texts for all items but one, and read again."""
    kept = events(spark, sf_dir).where("event_type <> 'error'").select(F.col("event_type").alias("item_id"))
    return state.parse_import(state.export(state_upsert(spark, sf_dir), kept))


@query(f"WITH {_FLAGS} SELECT user_email, substr(item_id, 3) AS item_id, flag FROM flags WHERE starts_with(item_id, 'si')")
def flags_replaced(spark, sf_dir):
    """Local flags of a product whose ids begin with si, as the remote lists have them."""
    return state.replace_with_remote(state.read_lists(state_upsert(spark, sf_dir)), "si")


@query(f"WITH {_UPSERT} SELECT user_email, substr(item_id, 2) AS item_id, is_read, is_starred FROM st WHERE starts_with(item_id, 'c')")
def of_namespace(spark, sf_dir):
    return state.of_namespace(state_upsert(spark, sf_dir), "c")


@query(f"WITH {_UPSERT} SELECT user_email, item_id, is_read = 1 AS read, is_starred = 1 AS starred FROM st WHERE (is_read = 1 OR is_starred = 1) AND (user_email, item_id) NOT IN (SELECT CAST(user_id AS VARCHAR), event_type FROM events WHERE value > 95)")
def flags_to_migrate(spark, sf_dir):
    local = state_upsert(spark, sf_dir).select("user_email", "item_id", (F.col("is_read") == 1).alias("read"), (F.col("is_starred") == 1).alias("starred"))
    pending = events(spark, sf_dir).where("value > 95").select(F.col("user_id").cast("string").alias("user_email"), F.col("event_type").alias("item_id"))
    return state.migrate(local, pending)


_AUTHORS = """l AS (SELECT user_id, count(*) % 5 AS attempts, max(value) > 95 AS pending FROM events WHERE event_type = 'view' GROUP BY 1), o AS (SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 'failed' WHEN user_id % 3 = 1 THEN 'pending' ELSE 'found' END AS outcome FROM events WHERE event_type = 'click' GROUP BY 1),
    a AS (SELECT coalesce(l.user_id, o.user_id) AS user_id, CASE WHEN o.outcome = 'found' THEN 'new' WHEN l.user_id IS NOT NULL THEN 'old' END AS site, CASE WHEN o.outcome IS NULL THEN coalesce(pending, false) ELSE o.outcome = 'pending' END AS pending, (coalesce(attempts, 0) + CASE WHEN o.outcome = 'pending' THEN 1 ELSE 0 END)::INTEGER AS attempts FROM l FULL JOIN (SELECT * FROM o WHERE outcome <> 'failed') o ON l.user_id = o.user_id)"""


def author_ledger(spark, sf_dir) -> DataFrame:
    e, name = events(spark, sf_dir), F.col("user_id").cast("string").alias("author")
    old = e.where("event_type = 'view'").groupBy(F.lit("p").alias("platform"), name).agg(F.lit("old").alias("site"), (F.max("value") > 95).alias("pending"), (F.count("*") % 5).cast("int").alias("attempts"))
    outcome = F.when(F.col("user_id") % 3 == 0, "failed").when(F.col("user_id") % 3 == 1, "pending").otherwise("found")
    new = e.where("event_type = 'click'").select(F.lit("p").alias("platform"), name, outcome.alias("outcome"), F.lit("new").alias("site")).distinct()
    return ledger.author_entry(old, new)


@query(f"WITH {_AUTHORS} SELECT CAST(user_id AS VARCHAR) AS author, site, pending, attempts FROM a")
def author_entries(spark, sf_dir):
    return author_ledger(spark, sf_dir).select("author", "site", "pending", "attempts")


@query(f"WITH {_AUTHORS} SELECT DISTINCT CAST(user_id AS VARCHAR) AS author FROM events WHERE user_id NOT IN (SELECT user_id FROM a WHERE NOT pending OR attempts >= 3)")
def authors_to_ask(spark, sf_dir):
    some = events(spark, sf_dir).select(F.lit("p").alias("platform"), F.col("user_id").cast("string").alias("author")).distinct()
    return ledger.needs_query(some, author_ledger(spark, sf_dir)).select("author")


_PASSES = """i AS (SELECT doc_id, substr(coalesce(text, ''), 1, CAST(doc_id % 400 AS INTEGER)) AS e, doc_id % 7 = 0 AS thread, text FROM documents), q AS (SELECT *, length(e) < 250 AND NOT (thread AND e <> '') AS asked FROM i),
    a AS (SELECT *, CASE WHEN asked AND doc_id % 2 = 0 THEN substr(text, 1, 300) END AS f1, CASE WHEN asked AND doc_id % 3 < 2 THEN substr(text, 1, 600) END AS f2 FROM q),
    b AS (SELECT *, coalesce(length(f1) >= 250 AND length(f1) >= 2 * length(e), false) AS ok1 FROM a), c AS (SELECT *, CASE WHEN ok1 THEN f1 ELSE e END AS e1 FROM b), d AS (SELECT *, f2 IS NOT NULL AND length(e1) < 250 AS second FROM c),
    z AS (SELECT *, second AND length(f2) >= 250 AND length(f2) >= 2 * length(e1) AS ok2 FROM d)"""


def passes(spark, sf_dir):
    d = texts(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    items = d.select("id", F.expr("substr(text, 1, cast(id % 400 as int))").alias("excerpt"), (F.col("id") % 7 == 0).alias("thread"))
    got = d.where("id % 2 = 0").select("id", F.lit(1).alias("pass"), F.substring("text", 1, 300).alias("text")).unionByName(d.where("id % 3 < 2").select("id", F.lit(2).alias("pass"), F.substring("text", 1, 600).alias("text")))
    return collect.enrich_rounds(items, got)


@query(f"WITH {_PASSES} SELECT doc_id AS id, length(CASE WHEN ok2 THEN f2 ELSE e1 END) AS n, length(CASE WHEN ok2 THEN f2 ELSE e1 END) < 250 AS thin FROM z")
def two_pass_enrichment(spark, sf_dir):
    return passes(spark, sf_dir)[0].select("id", F.char_length("excerpt").cast("long").alias("n"), "thin")


@query(f"WITH {_PASSES} SELECT doc_id AS id, 1 AS pass, ok1 AS ok FROM z WHERE f1 IS NOT NULL UNION ALL SELECT doc_id, 2, ok2 FROM z WHERE second")
def two_pass_attempts(spark, sf_dir):
    return passes(spark, sf_dir)[1]


@query("""WITH n AS (SELECT user_id, count(*) FILTER (event_type <> 'signup') AS n, count(*) FILTER (event_type = 'error') AS f FROM events GROUP BY 1)
    SELECT CAST(user_id AS VARCHAR) AS name, n, CASE WHEN f = 0 THEN 'ok' WHEN f < 7 THEN 'shaky' ELSE 'dead' END AS state, CASE WHEN user_id % 5 = 0 THEN '未启用' WHEN f > 0 THEN '连续失败 ' || f || ' 次：HTTP 500' ELSE '正常' END AS note FROM n""")
def source_panel(spark, sf_dir):
    """Users as sources: their items, state and note."""
    e, name = events(spark, sf_dir), F.col("user_id").cast("string")
    sources = e.select(name.alias("name"), F.lit("blog").alias("kind"), (F.col("user_id") % 5 != 0).alias("enabled"), F.lit(None).cast("string").alias("disabled_reason")).distinct()
    failed = e.where("event_type = 'error'").groupBy(name.alias("source")).agg(F.count("*").cast("int").alias("consecutive_failures"), F.lit("HTTP 500").alias("last_error_message"))
    return views.panel(sources, e.where("event_type <> 'signup'").select(name.alias("source")), failed).select("name", "n", "state", "note")


@query("SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS source FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 10 = 0)")
def sources_without_yield(spark, sf_dir):
    sources = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("name"))
    return views.zero_yield(views.per_source(sources, table(spark, sf_dir, "orders").where("o_orderkey % 10 = 0").select(F.col("o_custkey").cast("string").alias("source"))))


#: Tools and topics that titles and texts below speak of.
AGENTS = Vocabulary((Entry("claude-code", "Claude Code", ("claudecode",)), Entry("cursor", "Cursor"), Entry("mcp", "MCP", (), (), True, False)))
TALK = Vocabulary((Entry("prompt", "提示词"), Entry("agent", "agent", (), ("user agent",))))
#: Titles, of which each document gets one before its own first words.
TITLES = (
    "我用 Claude Code 改造了项目", "Claude Code 求助 怎么办", "Cursor 踩坑记录", "招高级 Claude Code 工程师", "后端 20-30k", "三人车 上车", "[分享创造] 一个 agent", "第 3 章 Cursor 入门", "提示词 的写法？", "MCP 配置", "普通的一天", "user agent 是什么", "Claude Code 和 Cursor 对比 提示词",
)


def han_items(spark, sf_dir) -> DataFrame:
    """Documents whose vowels became Han characters, each with a title and with words of the rules here and there."""
    i = F.col("doc_id")
    pick = lambda words, k: F.when(i % k == 0, F.element_at(F.array(*[F.lit(w) for w in words]), (F.floor(i / k) % len(words) + 1).cast("int"))).otherwise("")
    own = F.col("own")
    some = [pick(scoring.HAN_EXPERIENCE, 2), pick(scoring.HAN_EXPERIENCE[7:], 3), pick(scoring.HAN_PROMO, 5), pick(scoring.HAN_NEWS, 7), pick(scoring.HAN_ACADEMIC, 11), pick(scoring.HAN_SOFT, 4), pick(("岗位职责 任职要求", "适合谁：你 核心能力：快", "欢迎 Star", "本文未执行", "AI 賦能"), 6), pick(("claudecode", "提示词", "cursor"), 3)]
    excerpt = F.concat_ws(" ", F.substring(own, 1, 500), *some, F.when(i % 4 == 1, F.substring(own, 501, 1500)).otherwise(""))
    title = F.concat_ws(" ", F.element_at(F.array(*[F.lit(t) for t in TITLES]), (i % len(TITLES) + 1).cast("int")), F.when(i % 2 == 0, F.substring(F.regexp_extract(own, "^[^\\n]*", 0), 1, 12)).otherwise(""))
    return texts(spark, sf_dir, "documents").select("doc_id", F.translate(F.coalesce("text", F.lit("")), "aeiou", "一二三四五").alias("own")).select(
        i.alias("id"), title.alias("title"), excerpt.alias("excerpt"), F.when(i % 9 == 0, F.concat(F.substring(own, -100, 100), F.lit(" 欢迎试用"))).otherwise("").alias("tail"), (i % 5 == 0).alias("thread"), (i % 2500).alias("views"), (i % 17).alias("comments"),
    )


@query()
def han_score_rules(spark, sf_dir):
    """The rules for Han texts over all documents. SQL would only restate them; tests hold the rows against a plain version."""
    got = scoring.score_items(han_items(spark, sf_dir), scoring.han_rules(AGENTS, TALK))
    return got.select("id", "score", "verdict", "closed", F.array_join("tools", ",").alias("tools"), F.array_join("topics", ",").alias("topics"))
