"""Adapters: pages and JSON that are not feeds, each a Column that gives entries; and the driver of search results."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftloom.functions.dates import iso, parse
from siftloom.functions.text import decode_entities, html_to_text

from . import matching
from .collect import first_by

#: What the pages look like.
BATCH_CARD = "(?is)<article\\b.*?</article>"
BATCH_LINK = '(?i)href="(/the-batch/issue-\\d+)"'
BATCH_DATE = '(?i)href="/the-batch/tag/[^"]+"[^>]*>([^<]+)</a>'
BATCH_TITLE = "(?is)<(?:h2|h3)\\b[^>]*>(.*?)</(?:h2|h3)>"
BATCH_LABEL = '(?i)aria-label="([^"]+)"'
PARAGRAPH = "(?is)<p\\b[^>]*>(.*?)</p>"
EPOCH_LINK = '(?i)<a href="([^"]+)" class="cover-link"></a>'
EPOCH_BADGE = '(?i)<span class="badge-text">([^<]+)</span>'
EPOCH_TITLE = '(?is)class="cover-link"></a>.*?<span class="trim">(.*?)</span>'
EPOCH_TEXT = '(?is)<p class="body-3 trim">(.*?)</p>'
SINA_CARD = '(?is)<a class="post-link" href="[^"]+">.*?<article class="post">.*?</article>.*?</a>'
SINA_TEXT = '(?is)<div class="post-text">(.*?)</div>'
SINA_TIME = '(?i)<div class="time">\\s*([^<]+)'
GUIDE_LINK = "https://blog\\.waytoagi\\.com/article/news-(\\d{4})(\\d{2})(\\d{2})"
GUIDE_TITLE = '(?is)<div class="text-sm font-bold">(.*?)</div>'
GUIDE_TEXT = '(?is)<div class="text-gray-500[^>]*>(.*?)</div>'
NOTE_TOKEN = '(?is)<div class="date">[^<]+</div>|<a href="[^"]+" class="note">.*?</a>'
NOTE_MONTH = '(?i)^<div class="date">([^<]+)</div>'
NOTE_LINK = '(?i)<a href="([^"]+)" class="note">'
NOTE_TITLE = "(?is)<h3>(.*?)</h3>"
NOTE_TEXT = '(?is)<div class="description">(.*?)</div>'
MAP_URL = "(?is)<url>.*?</url>"
MAP_LOC = "(?i)<loc>([^<]+)</loc>"
MAP_DATE = "(?i)<lastmod>([^<]+)</lastmod>"
PAGE_TITLE = "(?is)<title[^>]*>(.*?)</title>"
PAGE_DATE = '"datePublished"\\s*:\\s*"([^"]+)"'
LETTER_LINK = 'href="(/newsletter/\\d{4}/\\d{2})'
LETTER_TITLE = "(?is)<h1[^>]*>(.*?)</h1>"
LETTER_TEXT = '(?is)<div class="page-description">(.*?)</div>'
LETTER_BODY = "(?is)<article\\b[^>]*>(.*?)</article>"

Entries = Callable[[Column], Column]
REGISTRY: dict[str, Entries] = {}
KIND = "array<struct<title:string,link:string,published:string,content:string>>"


def adapter(name: str) -> Callable[[Entries], Entries]:
    def add(f: Entries) -> Entries:
        REGISTRY[name] = f
        return f

    return add


def clean(cell: Column) -> Column:
    return html_to_text(cell, 10_000)


def _one(text: Column, pattern: str, group: int = 1) -> Column:
    """What a pattern captures, or null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _blocks(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def entry(title: Column, link: Column, published: Column, content: Column) -> Column:
    return F.struct(clean(title).alias("title"), link.alias("link"), published.alias("published"), F.coalesce(content, F.lit("")).alias("content"))


@adapter("the-batch")
def issue_cards(html: Column) -> Column:
    def card(b: Column) -> Column:
        link, date = _one(b, BATCH_LINK), _one(b, BATCH_DATE)
        title = F.coalesce(_one(b, BATCH_TITLE), _one(b, BATCH_LABEL))
        return entry(title, F.concat(F.lit("https://www.deeplearning.ai"), link), date, _one(b, PARAGRAPH))

    return F.transform(_blocks(html, BATCH_CARD), card)


@adapter("epoch")
def listing_cards(html: Column) -> Column:
    start = '<div class="card cover-link-parent card-article-listing'
    parts = F.filter(F.split(html, f"(?={start})"), lambda p: F.startswith(p, F.lit(start)))

    def card(b: Column, i: Column) -> Column:
        own = F.when(i == F.size(parts) - 1, F.substring(b, 1, 10_000)).otherwise(b)
        path = F.when(F.startswith(_one(own, EPOCH_LINK), F.lit("/")), _one(own, EPOCH_LINK))
        badges = F.transform(F.regexp_extract_all(own, F.lit(EPOCH_BADGE), F.lit(1)), lambda x: F.regexp_replace(clean(x), "([A-Z][a-z]{2})\\.", "$1"))
        title = _one(own, EPOCH_TITLE)
        return entry(title, F.concat(F.lit("https://epoch.ai"), path), F.get(F.filter(badges, lambda x: parse(x).isNotNull()), 0), _one(own, EPOCH_TEXT))

    return F.transform(parts, card)


@adapter("rundown")
def embedded_posts(html: Column) -> Column:
    text = '"((?:\\\\.|[^"\\\\])*)"'
    found = _blocks(html, f'(?s)"web_title":{text},"web_subtitle":{text}.{{0,1000}}?"slug":"[^"]+".{{0,600}}?"scheduled_at":"[^"]+"')
    plain = lambda raw: F.coalesce(F.get(F.from_json(F.concat(F.lit('["'), raw, F.lit('"]')), "array<string>"), 0), raw)

    def post(b: Column) -> Column:
        title, subtitle = F.regexp_extract(b, f'"web_title":{text}', 1), F.regexp_extract(b, f'"web_subtitle":{text}', 1)
        return entry(plain(title), F.concat(F.lit("https://www.therundown.ai/p/"), _one(b, '"slug":"([^"]+)"')), _one(b, '"scheduled_at":"([^"]+)"'), plain(subtitle))

    return F.transform(found, post)


@adapter("sina-media")
def post_cards(html: Column) -> Column:
    def card(b: Column) -> Column:
        path, body = _one(b, '(?i)href="([^"]+)"'), F.coalesce(_one(b, SINA_TEXT), F.lit(""))
        link = F.when(path.rlike("(?i)^https?:"), path).otherwise(F.concat(F.lit("https://www.sina.cn"), path))
        title = F.coalesce(F.nullif(F.substring(clean(body), 1, 120), F.lit("")), F.lit("(无标题)"))
        return entry(title, link, F.concat(F.regexp_replace(F.trim(_one(b, SINA_TIME)), "^(\\S+)\\s+(\\d\\d:\\d\\d)$", "$1T$2:00"), F.lit("+08:00")), body)

    return F.transform(_blocks(html, SINA_CARD), card)


@adapter("waytoagi")
def dated_slugs(html: Column) -> Column:
    link = GUIDE_LINK
    found = _blocks(html, f'(?is)href="{link}".{{0,1000}}?<div class="text-sm font-bold">.*?</div>\\s*<div class="text-gray-500[^>]*>.*?</div>')

    def card(b: Column) -> Column:
        date = F.regexp_replace(F.regexp_extract(b, link, 0), "^.*news-(\\d{4})(\\d{2})(\\d{2})$", "$1-$2-$3T00:00:00+08:00")
        return entry(_one(b, GUIDE_TITLE), F.regexp_extract(b, link, 0), date, _one(b, GUIDE_TEXT))

    return F.transform(found, card)


@adapter("alignment")
def monthly_notes(html: Column) -> Column:
    """Notes under month headings: each note takes the last heading before it."""
    tokens = _blocks(html, NOTE_TOKEN)
    start = F.struct(F.lit(None).cast("string").alias("month"), F.array().cast(KIND).alias("out"))

    def step(a: Column, t: Column) -> Column:
        heading = _one(t, NOTE_MONTH)
        href = _one(t, NOTE_LINK)
        link = F.when(href.rlike("(?i)^https?:"), href).otherwise(F.concat(F.lit("https://alignment.anthropic.com/"), F.regexp_replace(href, "^\\.?/", "")))
        note = entry(_one(t, NOTE_TITLE), link, F.regexp_replace(a["month"], "^([A-Za-z]+) (\\d{4})$", "$1 1, $2"), _one(t, NOTE_TEXT))
        return F.struct(F.when(heading.isNotNull(), clean(heading)).otherwise(a["month"]).alias("month"), F.when(heading.isNull() & a["month"].isNotNull(), F.concat(a["out"], F.array(note).cast(KIND))).otherwise(a["out"]).alias("out"))

    return F.aggregate(tokens, start, step, lambda a: a["out"])


def refine_dates(entries: DataFrame, pages: DataFrame, now: Column, days: int = 75) -> DataFrame:
    """Entries of the last days, dated by the citation on their page where pages (link, html) has one."""
    fresh = entries.where(F.col("published_at") >= now - F.expr(f"interval {24 * days} hours"))
    cited = pages.select("link", citation_date(F.col("html")).alias("_cited"))
    return fresh.join(cited, "link", "left").withColumn("published_at", F.coalesce("_cited", "published_at")).drop("_cited")


def citation_date(html: Column) -> Column:
    """A date from year, month and day of a citation block."""
    part = lambda name, shape: _one(html, f"(?i)\\b{name}\\s*=\\s*\\{{({shape})\\}}")
    return parse(F.concat(part("month", "[^}]+"), F.lit(" "), part("day", "\\d{1,2}"), F.lit(", "), part("year", "\\d{4}")))


def sitemap(xml: Column, include: str | None = None) -> Column:
    """(link, lastmod) of each address that fits include."""
    def url(b: Column) -> Column:
        return F.struct(decode_entities(_one(b, MAP_LOC)).alias("link"), parse(_one(b, MAP_DATE)).alias("lastmod"))

    found = F.transform(_blocks(xml, MAP_URL), url)
    return F.filter(found, lambda u: u["link"].isNotNull() & (u["link"].rlike(include) if include else F.lit(True)))


def sitemap_targets(payloads: DataFrame, now: Column, include: str | None = None, days: int = 45, most: int = 40) -> DataFrame:
    """The newest addresses of each sitemap to fetch: not older than days, undated ones kept, most at most, newest first."""
    rows = payloads.select("source", F.posexplode(sitemap(F.col("body"), include)).alias("pos", "u")).select("source", "pos", "u.link", "u.lastmod")
    rows = rows.where(F.col("lastmod").isNull() | (F.col("lastmod") >= now - F.expr(f"interval {24 * days} hours")))
    w = Window.partitionBy("source").orderBy(F.desc_nulls_last("lastmod"), "pos")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def meta(html: Column, key: str) -> Column:
    """The content of a meta element, whichever of its attributes comes first."""
    k = key.replace(".", "\\.")
    first = f"(?is)<meta[^>]+(?:property|name)=[\"']{k}[\"'][^>]+content=[\"']([^\"']*)[\"']"
    second = f"(?is)<meta[^>]+content=[\"']([^\"']*)[\"'][^>]+(?:property|name)=[\"']{k}[\"']"
    return F.coalesce(_one(html, first), _one(html, second))


def article_meta(html: Column, link: Column, fallback: Column) -> Column:
    title = F.coalesce(meta(html, "og:title"), _one(html, PAGE_TITLE), link)
    date = F.coalesce(_one(html, PAGE_DATE), meta(html, "article:published_time"), fallback)
    return entry(title, link, date, F.coalesce(meta(html, "og:description"), meta(html, "description")))


def newsletter_links(index: Column, now: Column, base: str = "https://gwern.net", months: int = 5, most: int = 6) -> Column:
    """This month's and the last months' addresses, then those in the index, newest first, most in all."""
    derived = F.transform(F.sequence(F.lit(0), F.lit(months - 1)), lambda i: F.date_format(F.add_months(F.trunc(now, "month"), -i), f"'{base}/newsletter/'yyyy/MM"))
    found = F.transform(F.reverse(F.array_sort(F.array_distinct(F.regexp_extract_all(index, F.lit(LETTER_LINK), F.lit(1))))), lambda x: F.concat(F.lit(base), x))
    return F.slice(F.array_union(derived, found), 1, most)


def newsletter(html: Column, link: Column) -> Column:
    """The entry of one newsletter page; null without a title or a date in its address."""
    title, month = _one(html, LETTER_TITLE), F.regexp_extract(link, "/newsletter/(\\d{4}/\\d{2})", 1)
    description = F.coalesce(_one(html, LETTER_TEXT), meta(html, "description"))
    body = F.coalesce(_one(html, LETTER_BODY), description)
    return F.when(title.isNotNull() & (month != ""), entry(title, link, F.concat(F.replace(month, F.lit("/"), F.lit("-")), F.lit("-01T00:00:00Z")), body))


def adapt(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of payloads (source, adapter, body) by their adapters, first of each link, complete ones only; and errors.

    An adapter that isn't known, and one that finds nothing, is an error of its source.
    """
    all_ = F.array().cast(KIND)
    for name, f in REGISTRY.items():
        all_ = F.when(F.col("adapter") == name, f(F.col("body")).cast(KIND)).otherwise(all_)
    rows = payloads.select("source", F.posexplode(all_).alias("ord", "e")).select("source", "ord", "e.title", "e.link", parse(F.col("e.published")).alias("published_at"), F.col("e.content").alias("content_html"))
    good = first_by(rows.where("title <> '' and link is not null and published_at is not null"), ["source", "link"], "ord")
    unknown = ~F.col("adapter").isin(*REGISTRY)
    empty = payloads.join(good.select("source").distinct(), "source", "left_anti")
    return good, empty.select("source", F.when(unknown, F.concat(F.lit("unknown adapter "), F.col("adapter"))).otherwise("no entries found").alias("message"))


#: Adapters whose entries need further pages, which were landed as (link, html).
PAGED = ("sitemap", "gwern-newsletter", "alignment")


def adapt_with_pages(payloads: DataFrame, pages: DataFrame, now: Column, include: str | None = None) -> tuple[DataFrame, DataFrame]:
    """adapt() for all adapters: payloads (source, adapter, body), with the pages that site maps, newsletters and notes lead to.

    A site map's newest addresses take title, date and description from their pages, else what the map says; a page that
    didn't come gives no entry. A newsletter's months are its pages. Notes are cut by age and dated by their pages.
    """
    plain, errors = adapt(payloads.where(~F.col("adapter").isin("sitemap", "gwern-newsletter")))
    notes = payloads.where("adapter = 'alignment'").select("source").distinct()
    dated = refine_dates(plain.join(notes, "source", "left_semi"), pages, now)
    html = pages.select("link", "html")
    maps = sitemap_targets(payloads.where("adapter = 'sitemap'"), now, include).join(html, "link")
    maps = maps.select("source", F.col("rank").alias("ord"), article_meta(F.col("html"), F.col("link"), F.date_format("lastmod", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("e"))
    letters = payloads.where("adapter = 'gwern-newsletter'").select("source", F.posexplode(newsletter_links(F.col("body"), now)).alias("ord", "link")).join(html, "link")
    letters = letters.select("source", "ord", newsletter(F.col("html"), F.col("link")).alias("e"))
    rows = maps.unionByName(letters).where("e is not null").select("source", "ord", "e.title", "e.link", parse(F.col("e.published")).alias("published_at"), F.col("e.content").alias("content_html"))
    paged = first_by(rows.where("title <> '' and link is not null and published_at is not null"), ["source", "link"], "ord")
    good = plain.join(notes, "source", "left_anti").unionByName(dated.select(*plain.columns)).unionByName(paged)
    asked = payloads.where(F.col("adapter").isin(*PAGED)).select("source").distinct()
    none = asked.join(good.select("source").distinct(), "source", "left_anti").join(errors.select("source"), "source", "left_anti")
    return good, errors.unionByName(none.select("source", F.lit("no entries found").alias("message")))


@dataclass(frozen=True)
class Search:
    """A search interface's JSON as landed: its schema, the SQL of the results in it (p), and of an entry over one result (r).

    prepare takes the JSON out of a payload; failed says that the interface reported an error.
    """

    schema: str
    results: str
    missing: str
    fields: dict[str, str | Callable[[], Column]]
    failed: str = "false"
    prepare: Callable[[Column], Column] = lambda body: body


def _iso(path: str) -> Callable[[], Column]:
    return lambda: iso(F.expr(path))


SEARCHES = {
    "juejin": Search(
        "err_no int, data array<struct<result_model:struct<article_info:struct<article_id:string,title:string,brief_content:string,ctime:string,view_count:bigint,comment_count:bigint>,author_user_info:struct<user_name:string>>>>",
        "filter(p.data, x -> x.result_model.article_info.article_id is not null)", "p.data is null",
        {"title": "r.result_model.article_info.title", "link": "concat('https://juejin.cn/post/', r.result_model.article_info.article_id)", "published_at": "timestamp_seconds(cast(r.result_model.article_info.ctime as bigint))",
         "body": "r.result_model.article_info.brief_content", "author": "r.result_model.author_user_info.user_name", "views": "r.result_model.article_info.view_count", "comments": "r.result_model.article_info.comment_count"},
        "coalesce(p.err_no, 0) <> 0",
    ),
    "v2ex": Search(
        "hits array<struct<_source:struct<id:bigint,title:string,content:string,created:string,member:string,replies:bigint>>>", "p.hits", "p.hits is null",
        {"title": "r._source.title", "link": "concat('https://www.v2ex.com/t/', r._source.id)", "published_at": _iso("r._source.created"), "body": "r._source.content", "author": "r._source.member", "views": "cast(null as bigint)", "comments": "r._source.replies"},
    ),
    "discourse": Search(
        "topics array<struct<id:bigint,title:string,slug:string,created_at:string,posts_count:bigint>>, posts array<struct<topic_id:bigint,post_number:int,blurb:string,username:string>>", "p.topics", "p.topics is null",
        {"title": "r.title", "link": "concat(base, '/t/', r.slug, '/', r.id)", "published_at": _iso("r.created_at"), "body": "get(filter(p.posts, x -> x.topic_id = r.id), 0).blurb", "author": "get(filter(p.posts, x -> x.topic_id = r.id), 0).username", "views": "cast(null as bigint)", "comments": "r.posts_count - 1"},
    ),
    "segmentfault": Search(
        "props struct<pageProps:struct<initialState:struct<search:struct<result:struct<rows:array<struct<type:string,contents:struct<url:string,title:string,excerpt:string,created:string,comments:string>>>>>>>>",
        "filter(slice(p.props.pageProps.initialState.search.result.rows, 1, 20), x -> x.type = 'article' and x.contents.url <> '' and x.contents.title <> '')", "p.props.pageProps.initialState.search.result is null",
        {"title": "r.contents.title", "link": "concat(if(r.contents.url rlike '^https?:', '', 'https://segmentfault.com'), r.contents.url)", "published_at": "timestamp_seconds(try_cast(r.contents.created as bigint))", "body": "r.contents.excerpt", "author": "cast(null as string)", "views": "cast(null as bigint)", "comments": "coalesce(try_cast(r.contents.comments as bigint), 0)"},
        prepare=lambda body: F.regexp_extract(body, "(?s)__NEXT_DATA__[^>]*>(\\{.*?\\})</script>", 1),
    ),
    "vocus": Search(
        "contents array<struct<contentId:string,_id:string,title:string,publishAt:string,isPay:boolean,pageview:bigint,commentCount:bigint,article:struct<abstract:string,isPay:boolean>>>",
        "filter(p.contents, x -> coalesce(x.contentId, x._id) is not null and x.title <> '' and not coalesce(x.isPay, false) and not coalesce(x.article.isPay, false))", "p.contents is null",
        {"title": "r.title", "link": "concat('https://vocus.cc/article/', coalesce(r.contentId, r._id))", "published_at": _iso("r.publishAt"), "body": "r.article.abstract", "author": "cast(null as string)", "views": "r.pageview", "comments": "r.commentCount"},
    ),
}


def first_queries(asked: DataFrame, most: int) -> DataFrame:
    """The first queries (source, query, query_ord) of each source, as many as it may be asked."""
    w = Window.partitionBy("source").orderBy("query_ord")
    return asked.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")


def search_results(payloads: DataFrame, kind: str, body_limit: int = 2000) -> tuple[DataFrame, DataFrame]:
    """Entries of landed search results (source, query, query_ord, base, body), first of each link; and (source, message, partial).

    A payload that isn't the expected JSON, or says that it failed, is an attempt that failed: a source all of whose attempts
    failed has an error, one with some a partial error.
    """
    s = SEARCHES[kind]
    got = payloads.withColumn("p", F.from_json(s.prepare(F.col("body")), s.schema))
    got = got.withColumn("bad", F.expr(f"p is null or {s.missing} or {s.failed}"))
    rows = got.where("not bad").select("source", "query", "query_ord", "base", "p", F.expr(f"posexplode({s.results}) as (pos, r)"))
    rows = rows.select("source", "query", "query_ord", "pos", *[(F.expr(e) if isinstance(e, str) else e()).alias(c) for c, e in s.fields.items() if c != "body"], html_to_text(F.expr(s.fields["body"]), body_limit).alias("excerpt"))
    tries = got.groupBy("source").agg(F.count("*").alias("attempted"), F.sum(F.col("bad").cast("int")).alias("failed")).where("failed > 0")
    return first_by(rows, ["source", "link"], "query_ord", "pos"), tries.select("source", F.concat("failed", F.lit(" of "), "attempted", F.lit(" searches failed")).alias("message"), (F.col("failed") < F.col("attempted")).alias("partial"))


def tags_for(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query, tag): the longest name that a query holds anywhere, and the same without spaces. Names are found by an index of their pairs of characters."""
    asked = queries.select("query").distinct()
    indexed = matching.index(matching.entries(names, "name"), anywhere=True)
    held = matching.matched_ids(matching.match(asked, indexed, "query", "query", anywhere=True), "query", "name")
    best = held.groupBy("query").agg(F.max_by("name", F.struct(F.length("name"), "name")).alias("name"))
    return best.select("query", F.explode(F.array_distinct(F.array("name", F.replace("name", F.lit(" "), F.lit(""))))).alias("tag"))
