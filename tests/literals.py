"""Operators over literal payloads: feeds, pages, index files and answers of search interfaces, which the generated tables don't have.

Each case runs an operator over a few written rows and states the rows that must come out, worked out by hand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftloom.functions import dates as D
from siftloom.functions import text as T
from siftloom.functions import url as U
from siftloom.functions.vocab import Entry, Vocabulary
from siftloom.operators.pools import queries_for_date, union_in_order
from siftloom.operators import adapters, collect, discovery, feeds, ledger, scoring, state, views

Kind = Callable[[SparkSession], DataFrame]
CASES: dict[str, tuple[Kind, list[str], list[tuple]]] = {}


def stated(columns: str, rows: list[tuple]) -> Callable[[Kind], Kind]:
    """A case; columns are 'name type, ...', rows what it must give."""
    names = [c.split()[0] for c in columns.split(", ")]

    def add(f: Kind) -> Kind:
        CASES[f.__name__] = (f, names, rows)
        return f

    return add


def table(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def stamp(instant: F.Column) -> F.Column:
    """An instant as text in UTC."""
    return F.date_format(F.convert_timezone(None, F.lit("UTC"), instant.cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss")


def at(column: str = "published_at") -> F.Column:
    return stamp(F.col(column)).alias(column)


# feeds ------------------------------------------------------------------------------------------------------------------

_FEEDS = [
    ("rss", """<?xml version="1.0"?><rss><channel><title>c</title><item><title>A &amp;amp; B</title><link>https://x.org/?a=1&amp;b=2</link><pubDate>Sat, 26 Jul 2026 08:00:00 GMT</pubDate><description>d</description><content:encoded><![CDATA[<p>1 &amp;lt; 2</p>]]></content:encoded></item>
<item><title>only text</title><link>https://x.org/2</link><dc:date>2026-07-25T10:00:00+08:00</dc:date><description>&lt;p&gt;body&lt;/p&gt;</description></item><item><title>bad date</title><link>https://x.org/3</link><pubDate>yesterday</pubDate></item></channel></rss>"""),
    ("pod", """<rss><channel><item><title>ep 1</title><enclosure url="https://x.org/a.mp3"/><guid>no-address</guid></item><item><title>ep 2</title><guid>https://x.org/g</guid></item><item><title>ep 3</title><guid>tag:1</guid></item></channel></rss>"""),
    ("one", """<rss><channel><item><title>single</title><link>https://x.org/one</link></item></channel></rss>"""),
    ("atom", """<feed><entry><title>T</title><link rel="edit" href="https://x.org/e"/><link rel="alternate" href="https://x.org/a"/><published>2026-07-26T00:00:00Z</published><summary>s</summary></entry><entry><title>U</title><link rel="self" href="https://x.org/s"/><link href="https://x.org/u"/><updated>2026-07-27T00:00:00Z</updated><content>&lt;b&gt;c&lt;/b&gt;</content><summary>s</summary></entry></feed>"""),
    ("video", """<feed><entry><title>V</title><link rel="self" href="https://x.org/v"/><published>2026-07-28T00:00:00Z</published><media:group><media:description>about it</media:description></media:group></entry></feed>"""),
    ("rdf", """<rdf:RDF><channel><title>c</title></channel><item><title>R</title><link>https://x.org/r</link><dc:date>2026-07-29T00:00:00Z</dc:date><description>rd</description></item></rdf:RDF>"""),
    ("page", "<html><body>no feed</body></html>"),
]


@stated("source VARCHAR, ord INTEGER, title VARCHAR, link VARCHAR, published_at VARCHAR, content_html VARCHAR", [
    ("rss", 0, "A &amp; B", "https://x.org/?a=1&b=2", "2026-07-26 08:00:00", "<p>1 &amp;lt; 2</p>"), ("rss", 1, "only text", "https://x.org/2", "2026-07-25 02:00:00", "&lt;p&gt;body&lt;/p&gt;"), ("rss", 2, "bad date", "https://x.org/3", None, ""),
    ("pod", 0, "ep 1", "https://x.org/a.mp3", None, ""), ("pod", 1, "ep 2", "https://x.org/g", None, ""), ("pod", 2, "ep 3", "", None, ""), ("one", 0, "single", "https://x.org/one", None, ""),
    ("atom", 0, "T", "https://x.org/a", "2026-07-26 00:00:00", "s"), ("atom", 1, "U", "https://x.org/u", "2026-07-27 00:00:00", "&lt;b&gt;c&lt;/b&gt;"),
    ("video", 0, "V", "https://x.org/v", "2026-07-28 00:00:00", "about it"), ("rdf", 0, "R", "https://x.org/r", "2026-07-29 00:00:00", "rd"),
])
def feed_entries(spark):
    """RSS 2.0, podcasts, Atom, video feeds and RSS 1.0: links, dates and bodies by their order of preference."""
    rows = feeds.parse_feeds(table(spark, "source string, body string", _FEEDS))[0]
    return rows.select("source", "ord", "title", "link", at(), "content_html")


@stated("source VARCHAR, message VARCHAR", [("page", "neither RSS nor Atom")])
def feed_errors(spark):
    return feeds.parse_feeds(table(spark, "source string, body string", _FEEDS))[1]


# adapters ----------------------------------------------------------------------------------------------------------------

_ADAPTED = [
    ("the-batch", '<article><a href="/the-batch/tag/jul-01/">Jul 1, 2026</a><a href="/the-batch/issue-300"></a><h2>Big &amp; new</h2><p>text</p></article><article><a href="/the-batch/issue-299" aria-label="Labelled"></a><a href="/the-batch/tag/jun-24/">Jun 24, 2026</a></article><article><a href="/the-batch/issue-298"></a><h2>No date</h2></article>'),
    ("epoch", '<div class="card cover-link-parent card-article-listing"><a href="/p/one" class="cover-link"></a><span class="trim">One</span><span class="badge-text">Report</span><span class="badge-text">Jul. 3, 2026</span></div><div class="card cover-link-parent card-article-listing"><a href="/p/two" class="cover-link"></a><span class="trim">Two</span><span class="badge-text">May 9, 2026</span><p class="body-3 trim">about</p></div>'),
    ("rundown", '{"web_title":"A \\"q\\"","web_subtitle":"s","slug":"a-q","scheduled_at":"2026-07-04T10:00:00Z"},{"web_title":"bad \\q","web_subtitle":"","slug":"b","scheduled_at":"2026-07-05T10:00:00Z"}'),
    ("alignment", '<a href="/n0" class="note"><h3>No month</h3></a><div class="date">July 2026</div><a href="/n1" class="note"><h3>N1</h3><div class="description">d</div></a><a href="./n2" class="note"><h3>N2</h3></a><div class="date">June 2026</div><a href="https://o.org/n3" class="note"><h3>N3</h3></a>'),
    ("sina-media", '<a class="post-link" href="/m/1"><article class="post"><div class="time"> 2026-07-05 08:00 </div><div class="post-text">Body <b>text</b></div></article></a>'),
    ("waytoagi", '<a href="https://blog.waytoagi.com/article/news-20260706"><div class="text-sm font-bold">W</div> <div class="text-gray-500 x">d</div></a>'),
    ("unheard-of", "<html></html>"),
]


def _adapted(spark):
    empty = [("empty", "epoch", "<html></html>")]
    return table(spark, "source string, adapter string, body string", [(k, k, v) for k, v in _ADAPTED] + empty)


@stated("source VARCHAR, title VARCHAR, link VARCHAR, published_at VARCHAR, content_html VARCHAR", [
    ("the-batch", "Big & new", "https://www.deeplearning.ai/the-batch/issue-300", "2026-07-01 00:00:00", "text"), ("the-batch", "Labelled", "https://www.deeplearning.ai/the-batch/issue-299", "2026-06-24 00:00:00", ""),
    ("epoch", "One", "https://epoch.ai/p/one", "2026-07-03 00:00:00", ""), ("epoch", "Two", "https://epoch.ai/p/two", "2026-05-09 00:00:00", "about"),
    ("rundown", 'A "q"', "https://www.therundown.ai/p/a-q", "2026-07-04 10:00:00", "s"), ("rundown", "bad \\q", "https://www.therundown.ai/p/b", "2026-07-05 10:00:00", ""),
    ("alignment", "N1", "https://alignment.anthropic.com/n1", "2026-07-01 00:00:00", "d"), ("alignment", "N2", "https://alignment.anthropic.com/n2", "2026-07-01 00:00:00", ""), ("alignment", "N3", "https://o.org/n3", "2026-06-01 00:00:00", ""),
    ("sina-media", "Body text", "https://www.sina.cn/m/1", "2026-07-05 00:00:00", "Body <b>text</b>"), ("waytoagi", "W", "https://blog.waytoagi.com/article/news-20260706", "2026-07-05 16:00:00", "d"),
])
def adapter_entries(spark):
    """Entries of pages that are no feeds, by the adapter of each."""
    return adapters.adapt(_adapted(spark))[0].select("source", "title", "link", at(), "content_html")


@stated("source VARCHAR, message VARCHAR", [("empty", "no entries found"), ("unheard-of", "unknown adapter unheard-of")])
def adapter_errors(spark):
    return adapters.adapt(_adapted(spark))[1]


_NOTES = [("a", "New", "https://n.org/1", "2026-07-01 00:00:00"), ("a", "Old", "https://n.org/2", "2026-03-01 00:00:00"), ("a", "Dated by its page", "https://n.org/3", "2026-06-01 00:00:00")]


@stated("title VARCHAR, published_at VARCHAR", [("New", "2026-07-01 00:00:00"), ("Dated by its page", "2026-06-17 00:00:00")])
def monthly_note_dates(spark):
    """Notes of the last 75 days, with the day that their page cites instead of the first of the month."""
    entries = table(spark, "source string, title string, link string, published string", _NOTES).withColumn("published_at", D.iso(F.col("published")))
    pages = table(spark, "link string, html string", [("https://n.org/3", "@misc{x, year={2026}, month={June}, day={17}}"), ("https://n.org/1", "<p>no citation</p>")])
    return adapters.refine_dates(entries, pages, D.iso(F.lit("2026-07-10 00:00:00"))).select("title", at())


_MAP = "".join(f"<url><loc>https://m.org/{p}</loc>{f'<lastmod>{d}</lastmod>' if d else ''}</url>" for p, d in (("blog/a?x=1&amp;y=2", "2026-07-01"), ("blog/b", "2026-07-03"), ("blog/c", ""), ("blog/old", "2026-01-01"), ("about", "2026-07-04")))


@stated("link VARCHAR, lastmod VARCHAR, rank INTEGER", [("https://m.org/blog/b", "2026-07-03 00:00:00", 1), ("https://m.org/blog/a?x=1&y=2", "2026-07-01 00:00:00", 2)])
def sitemap_targets(spark):
    """The newest addresses of a site map that fit a pattern: 45 days, undated ones kept, here two at most."""
    rows = adapters.sitemap_targets(table(spark, "source string, body string", [("m", _MAP)]), D.iso(F.lit("2026-07-10 00:00:00")), "/blog/", 45, 2)
    return rows.select("link", at("lastmod"), "rank")


_ARTICLES = [
    ("https://p.org/1", '<title>T</title><meta content="og &amp; title" property="og:title"><meta property="og:description" content="about"><script type="application/ld+json">{"datePublished": "2026-07-01T00:00:00Z"}</script>', "2026-06-01"),
    ("https://p.org/2", '<title> Only a title </title><meta name="description" content="plain"><meta property="article:published_time" content="2026-07-02T00:00:00Z">', "2026-06-01"),
    ("https://p.org/3", "<p>nothing</p>", "2026-06-01"),
]


@stated("link VARCHAR, title VARCHAR, published VARCHAR, content VARCHAR", [("https://p.org/1", "og & title", "2026-07-01T00:00:00Z", "about"), ("https://p.org/2", "Only a title", "2026-07-02T00:00:00Z", "plain"), ("https://p.org/3", "https://p.org/3", "2026-06-01", "")])
def article_metadata(spark):
    """Title, description and date of article pages, whichever element has them and whatever the order of its attributes."""
    rows = table(spark, "link string, html string, fallback string", _ARTICLES)
    return rows.select(adapters.article_meta(F.col("html"), F.col("link"), F.col("fallback")).alias("e")).select("e.link", "e.title", "e.published", "e.content")


@stated("place INTEGER, link VARCHAR", [(i, f"https://gwern.net/newsletter/{m}") for i, m in enumerate(("2026/07", "2026/06", "2026/05", "2026/04", "2026/03", "2025/12"))])
def newsletter_links(spark):
    """The addresses of the last five months, then those of the index, newest first, six in all."""
    index = '<a href="/newsletter/2025/11">n</a><a href="/newsletter/2025/12">n</a><a href="/newsletter/2026/05">n</a>'
    return table(spark, "html string", [(index,)]).select(F.posexplode(adapters.newsletter_links(F.col("html"), F.lit("2026-07-15").cast("date"))).alias("place", "link"))


@stated("title VARCHAR, link VARCHAR, published VARCHAR, content VARCHAR", [("July 2026 News", "https://gwern.net/newsletter/2026/07", "2026-07-01T00:00:00Z", "<p>b</p>")])
def newsletter_entry(spark):
    rows = table(spark, "link string, html string", [("https://gwern.net/newsletter/2026/07", '<h1 class="x">July 2026 News</h1><div class="page-description">d</div><article><p>b</p></article>'), ("https://gwern.net/newsletter/2026/06", "<p>no title</p>")])
    return rows.select(adapters.newsletter(F.col("html"), F.col("link")).alias("e")).where("e is not null").select("e.title", "e.link", "e.published", "e.content")


# search interfaces ---------------------------------------------------------------------------------------------------------

_ANSWER = "source string, query string, query_ord int, base string, body string"
_FOUND = "query VARCHAR, title VARCHAR, link VARCHAR, published_at VARCHAR, author VARCHAR, comments BIGINT, excerpt VARCHAR"


def _search(spark, kind, *bodies, base=""):
    rows = [("s", f"q{i}", i, base, b) for i, b in enumerate(bodies)]
    return adapters.search_results(table(spark, _ANSWER, rows), kind)[0].select("query", "title", "link", at(), "author", F.col("comments").cast("long").alias("comments"), "excerpt")


@stated(_FOUND, [("q0", "T", "https://juejin.cn/post/7", "2026-07-01 00:00:00", "u", 3, "b")])
def search_juejin(spark):
    """Articles only; times in seconds; an answer that reports an error gives nothing."""
    ok = '{"err_no":0,"data":[{"result_model":{"article_info":{"article_id":"7","title":"T","brief_content":"<b>b</b>","ctime":"1782864000","view_count":9,"comment_count":3},"author_user_info":{"user_name":"u"}}},{"result_model":{"user_id":"1"}}]}'
    return _search(spark, "juejin", ok, '{"err_no":403,"data":[]}')


@stated(_FOUND, [("q0", "T", "https://www.v2ex.com/t/1", "2026-07-01 08:00:00", "m", 3, "c")])
def search_v2ex(spark):
    """Times without a zone are UTC; the second query finds the same post, which counts once."""
    ok = '{"hits":[{"_source":{"id":1,"title":"T","content":"c","created":"2026-07-01T08:00:00","member":"m","replies":3}}]}'
    return _search(spark, "v2ex", ok, ok)


@stated(_FOUND, [("q0", "T", "https://f.org/t/t/7", "2026-07-01 00:00:00", "u", 2, "first"), ("q0", "Alone", "https://f.org/t/a/8", "2026-07-02 00:00:00", None, 0, "")])
def search_discourse(spark):
    """Topics joined to the first post that the answer has of each."""
    body = '{"topics":[{"id":7,"title":"T","slug":"t","created_at":"2026-07-01T00:00:00Z","posts_count":3},{"id":8,"title":"Alone","slug":"a","created_at":"2026-07-02T00:00:00Z","posts_count":1}],"posts":[{"topic_id":7,"post_number":1,"blurb":"first","username":"u"},{"topic_id":7,"post_number":2,"blurb":"second","username":"v"}]}'
    return _search(spark, "discourse", body, base="https://f.org")


@stated(_FOUND, [("q0", "T", "https://segmentfault.com/a/1", "2026-07-01 00:00:00", None, 2, "e")])
def search_segmentfault(spark):
    """JSON inside a page; articles only."""
    rows = '[{"type":"article","contents":{"url":"/a/1","title":"T","excerpt":"<b>e</b>","created":"1782864000","comments":"2"}},{"type":"question","contents":{"url":"/q/1","title":"Q"}}]'
    return _search(spark, "segmentfault", f'<script id="__NEXT_DATA__" type="x">{{"props":{{"pageProps":{{"initialState":{{"search":{{"result":{{"rows":{rows}}}}}}}}}}}}}</script>', "<html></html>")


@stated(_FOUND, [("q0", "A", "https://vocus.cc/article/x", "2026-07-01 00:00:00", None, None, "s")])
def search_vocus(spark):
    """Articles that need no payment, each once."""
    body = '{"contents":[{"_id":"x","title":"A","publishAt":"2026-07-01T00:00:00Z","article":{"abstract":"s"}},{"_id":"y","title":"B","isPay":true},{"contentId":"z","title":"C","article":{"isPay":true}}]}'
    return _search(spark, "vocus", body, body)


@stated("source VARCHAR, message VARCHAR, partial BOOLEAN", [("all", "2 of 2 searches failed", False), ("some", "1 of 3 searches failed", True)])
def search_failures(spark):
    """A source all of whose searches failed has an error, one with some a partial error."""
    ok, bad = '{"hits":[]}', "<html>wait</html>"
    rows = [("all", "q", 0, "", bad), ("all", "r", 1, "", bad), ("some", "q", 0, "", ok), ("some", "r", 1, "", bad), ("some", "s", 2, "", ok), ("none", "q", 0, "", ok)]
    return adapters.search_results(table(spark, _ANSWER, rows), "v2ex")[1]


@stated("query VARCHAR, query_ord INTEGER", [("a", 0), ("b", 1)])
def search_queries_asked(spark):
    """The first queries of a source only, in their order, as many as it may be asked."""
    rows = [("s", "a", 0), ("s", "b", 1), ("s", "c", 2)]
    return adapters.first_queries(table(spark, "source string, query string, query_ord int", rows), 2).select("query", "query_ord")


@stated("query VARCHAR, tag VARCHAR", [("claude code tips", "Claude Code"), ("claude code tips", "ClaudeCode"), ("about claude", "Claude")])
def query_tags(spark):
    """The longest name in a query, spaced and compact; queries without a name have no tag."""
    names = table(spark, "name string", [("Claude",), ("Claude Code",)])
    return adapters.tags_for(table(spark, "query string", [("claude code tips",), ("about claude",), ("nothing",)]), names)


# index files ----------------------------------------------------------------------------------------------------------------


def _file(spark, *texts):
    return table(spark, "text string", [(t,) for t in texts])


@stated("title VARCHAR, feed VARCHAR, site VARCHAR", [("A", "https://a.org/f", "https://a.org/f"), ("C", "http://c.org/f", "https://c.org")])
def opml_index(spark):
    return discovery.opml(_file(spark, '<outline text="group"><outline text="A" xmlUrl="https://a.org/f"/><outline text="B" xmlUrl="no" htmlUrl="https://b.org"/><outline htmlUrl="https://c.org" xmlUrl="http://c.org/f" text="C"/></outline>'))


@stated("title VARCHAR, site VARCHAR, feed VARCHAR, tags VARCHAR", [("A", "https://a.org", "https://a.org/f", "x,y"), ("C", "c", "http://c.org", "")])
def csv_feed_index(spark):
    """The header is skipped, lines are split at each comma, and the third column must be an address."""
    return discovery.csv_index(_file(spark, "t,s,https://header\nA, https://a.org ,https://a.org/f,x,y\nB,b,nothing\nD,d\nC,c,http://c.org"))


@stated("feed VARCHAR", [("https://a.org/feed.xml",), ("https://b.org/rss/",), ("https://c.org/blog/feed/atom",), ("https://d.org/x.atom",)])
def markdown_feed_index(spark):
    """Addresses that look like feeds: /feedback and ?feed= don't, and code hosts never are."""
    return discovery.markdown_feeds(_file(spark, "see https://a.org/feed.xml, and (https://b.org/rss/) <https://c.org/blog/feed/atom> https://d.org/x.atom; https://a.org/feed.xml", "https://e.org/feedback https://f.org/?feed=rss2 https://github.com/x/feed https://www.example.com/rss https://g.org/page"))


@stated("host VARCHAR, origin VARCHAR, feed VARCHAR", [("a.org", "https://www.a.org", "https://a.org/rss"), ("b.org", "https://b.org", None)])
def site_list_index(spark):
    """One row for each host: the origin seen first, and its first address that looks like a feed; platforms are left out."""
    return discovery.site_list(_file(spark, "- https://www.a.org/post/1, https://a.org/rss\n- https://b.org/y。\n- https://a.org/atom.xml https://zhihu.com/people/x https://me.medium.com/"))


@stated("host VARCHAR, name VARCHAR, origin VARCHAR", [("a.org", "A", "https://a.org"), ("b.org", "", "https://b.org")])
def domain_index(spark):
    """Bare domains in JSON, first of each host; a text that isn't JSON has none."""
    return discovery.domain_list(_file(spark, '[{"domainName":"a.org","blogName":"A"},{"domainName":"www.a.org","blogName":"again"},{"domainName":"https://b.org"},{"domainName":" "},{"domainName":"www.zhihu.com"}]', "<html>"))


@stated("line VARCHAR", [("| A | chinese, tech |",)])
def table_lines(spark):
    return discovery.markdown_table(_file(spark, "| A | chinese, tech |\n| B | english |\n| C | chinese | WeChat\nD chinese\n| E | nonchinese |"), "chinese", "wechat")


@stated("line VARCHAR, url VARCHAR", [("a.org", "https://a.org"), (" http://b.org/x ", "http://b.org/x"), ("# note", None), ("", None)])
def candidate_lines(spark):
    """Lines of a candidate file: a scheme is added, notes and blank lines fall out (null)."""
    return table(spark, "line string", [("a.org",), (" http://b.org/x ",), ("# note",), ("",)]).select("line", U.with_scheme(F.col("line")).alias("url"))


# sites ------------------------------------------------------------------------------------------------------------------------


@stated("seed VARCHAR, host VARCHAR, origin VARCHAR", [("a.org", "b.org", "https://b.org"), ("a.org", "c.net", "http://c.net:8080")])
def outbound_links(spark):
    """Absolute links to other hosts, the first origin of each; no parts of the own host, no relative links."""
    html = '<a href="https://b.org/post">b</a><a class="x" href="http://www.b.org/">b again</a><a href="http://c.net:8080/">c</a><a href="https://blog.a.org">own</a><a href="/about">rel</a><a href="https://zhihu.com/x">platform</a>'
    return discovery.outbound(table(spark, "url string, html string", [("https://www.a.org/", html)]), discovery.PLATFORMS)


_HOMES = [("https://a.org", '<a href="/party">友情链接</a><a href="https://b.org/links">blogroll</a><a href="/about">about</a>')]


@stated("ord INTEGER, page VARCHAR", [(0, "https://a.org/party"), (1, "https://a.org/links"), (2, "https://a.org/links/"), (3, "https://a.org/friends")])
def blogroll_candidates(spark):
    """What a page's own links call a page of friends, if it is on the same host, then the usual paths (the first four in all here)."""
    return discovery.blogroll_candidates(table(spark, "url string, html string", _HOMES)).where("ord < 4").select("ord", "page")


@stated("host VARCHAR, origin VARCHAR", [("f1.org", "https://f1.org"), ("f2.org", "https://f2.org"), ("f3.org", "https://f3.org"), ("f4.org", "https://f4.org"), ("f5.org", "https://f5.org")])
def blogroll_hits(spark):
    """The first two pages with at least three hosts are used: not the one with two, nor a third."""
    links = lambda *ns: "".join(f'<a href="https://f{n}.org/">x</a>' for n in ns)
    fetched = [("https://a.org/party", links(1, 2)), ("https://a.org/links", links(1, 2, 3)), ("https://a.org/friends", links(3, 4, 5)), ("https://a.org/sites", links(6, 7, 8))]
    return discovery.blogroll_hits(table(spark, "url string, html string", _HOMES), table(spark, "page string, html string", fetched)).select("host", "origin")


def _listing(ids, page=None):
    return "".join(f'<a href="/users/1/ironman/{i}">s</a>' for i in ids) + (f'<a href="/2026ironman/signup/list?group=ai&amp;page={page}">next</a>' if page else '<a href="/users/1/ironman">all</a>')


_SERIES = [("ai", 1, _listing((1001, 1002), 2), None), ("ai", 2, _listing((1002, 1003)), None), ("ai", 3, _listing((9999,)), None), ("gone", 1, None, "HTTP 403"), ("odd", 1, _listing((), 2), None), ("odd", 2, _listing((1004,)), None)]


@stated("grp VARCHAR, id VARCHAR, page INTEGER, pos INTEGER", [("ai", "1001", 1, 0), ("ai", "1002", 1, 1), ("ai", "1003", 2, 1)])
def series_ids(spark):
    """Series of each group up to its last page."""
    return discovery.series_scan(table(spark, "group string, page int, html string, error string", _SERIES))[0].select(F.col("group").alias("grp"), "id", "page", "pos")


@stated("grp VARCHAR, page INTEGER, n INTEGER, error VARCHAR", [("ai", 1, 2, None), ("ai", 2, 2, None), ("gone", 1, None, "HTTP 403"), ("odd", 1, 0, "no ids, but a next page")])
def series_pages(spark):
    """Why each group ended: a page without a next one, one that failed, and one that has a next page but can't be read."""
    return discovery.series_scan(table(spark, "group string, page int, html string, error string", _SERIES))[1].select(F.col("group").alias("grp"), "page", "n", "error")


@stated("place INTEGER, feed VARCHAR", [(0, "https://a.org/blog/feed.xml"), (1, "https://a.org/atom"), (2, "https://o.org/rss")])
def declared_feeds(spark):
    """Alternate links of feeds, quoted or bare, made absolute, each once; other alternates are none."""
    html = '<link rel="alternate" type="application/rss+xml" href="feed.xml"><link rel=alternate type=application/atom+xml href=/atom><link href="//o.org/rss" type="application/rss+xml" rel="alternate"><link rel="alternate" hreflang="en" href="/en"><link rel="alternate" type="application/rss+xml" href="feed.xml"><link rel="stylesheet" type="application/rss+xml" href="/s">'
    return table(spark, "html string", [(html,)]).select(F.posexplode(discovery.declared_feeds(F.col("html"), F.lit("https://a.org/blog/"))).alias("place", "feed"))


@stated("place INTEGER, feed VARCHAR", [(i, f"https://a.org/{p}") for i, p in enumerate([f"b/{p}" for p in discovery.FEED_PATHS] + list(discovery.FEED_PATHS))])
def candidate_feeds(spark):
    """Below the address, then below its origin, by priority."""
    return table(spark, "url string", [("https://a.org/b/?x#y",)]).select(F.posexplode(discovery.candidate_feeds(F.col("url"))).alias("place", "feed"))


@stated("page VARCHAR, id VARCHAR", [("meta", "UCaaaaaaaaaaaaaaaaaaaaaa"), ("json", "UCbbbbbbbbbbbbbbbbbbbbbb"), ("link", "UCcccccccccccccccccccccc"), ("none", None)])
def channel_ids(spark):
    a, b, c = ("UC" + x * 22 for x in "abc")
    rows = [("meta", f'<a href="/channel/{c}"></a>"externalId":"{b}"<meta itemprop="identifier" content="{a}">'), ("json", f'<a href="/channel/{c}"></a>"externalId" : "{b}"'), ("link", f'<link href="https://www.youtube.com/channel/{c}">'), ("none", "<p>UC</p>")]
    return table(spark, "page string, html string", rows).select("page", discovery.youtube_channel(F.col("html")).alias("id"))


@stated("name VARCHAR, feed VARCHAR, score INTEGER", [("The Long Talk", "f2", 100), ("Evening News", "f4", 60)])
def podcast_feeds(spark):
    """The verified feed whose name in a directory is most alike; short names must be equal."""
    listings = [("The Long Talk", "cn", 0, "Long Talk Extra", "f1"), ("The Long Talk", "cn", 1, "The Long Talk", "dead"), ("The Long Talk", "us", 0, "long talk podcast!", "f2"), ("Pod", "us", 0, "Pod and more", "f3"), ("Evening News", "us", 0, "My Evening News", "f4")]
    verified = table(spark, "feed string", [("f1",), ("f2",), ("f3",), ("f4",)])
    return discovery.podcast_feed(table(spark, "name string", [("The Long Talk",), ("Pod",), ("Evening News",)]), table(spark, "name string, country string, pos int, title string, feed string", listings), verified)


@stated("name VARCHAR, feed VARCHAR, enabled BOOLEAN, disabled_reason VARCHAR", [
    ("adapted", "https://x.org/list", True, None), ("works", "https://w.org/f", True, None), ("moved", "https://m.org/new.xml", True, None), ("usual", "https://u.org/rss", True, None), ("search", None, False, discovery.REASONS["search"]),
    ("channel", "https://www.youtube.com/feeds/videos.xml?channel_id=UC" + "a" * 22, True, None), ("no channel", None, False, discovery.REASONS["channel"]), ("pod", "https://p.org/pod", True, None), ("nothing", None, False, discovery.REASONS["nothing"]),
])
def feed_discovery(spark):
    """The whole cascade: what an adapter has, what works, search pages, channels, directories, declared feeds, usual places."""
    sources = [
        ("adapted", "https://x.org", "blog", "https://x.org/list", "the-batch"), ("works", "https://w.org", "blog", "https://w.org/f", None), ("moved", "https://m.org", "blog", "https://m.org/old", None), ("usual", "https://u.org/b", "blog", None, None),
        ("search", "https://weixin.sogou.com/weixin?query=x", "blog", None, None), ("channel", "https://www.youtube.com/@c", "video", None, None), ("no channel", "https://www.youtube.com/@n", "video", None, None), ("pod", "https://p.org", "podcast", None, None), ("nothing", "https://n.org", "blog", None, None),
    ]
    html = [("https://m.org", '<link rel="alternate" type="application/rss+xml" href="/new.xml">'), ("https://www.youtube.com/@c", f'"externalId":"UC{"a" * 22}"'), ("https://www.youtube.com/@n", "<p></p>")]
    verified = [("https://w.org/f",), ("https://m.org/new.xml",), ("https://m.org/feed",), ("https://u.org/rss",), ("https://u.org/feed.xml",), ("https://www.youtube.com/feeds/videos.xml?channel_id=UC" + "a" * 22,), ("https://p.org/pod",), ("https://p.org/feed",)]
    return discovery.discover(table(spark, "name string, url string, type string, feed string, adapter string", sources), table(spark, "url string, html string", html), table(spark, "feed string", verified), table(spark, "name string, feed string", [("pod", "https://p.org/pod")]))


@stated("site VARCHAR, url VARCHAR, tried VARCHAR", [("s", "u2", "u1 u2"), ("t", None, "v1")])
def site_probe(spark):
    """The first candidate that gave a feed, with the trail of what was tried."""
    return discovery.first_verified(table(spark, "site string, url string, priority int, verified boolean", [("s", "u1", 1, False), ("s", "u2", 2, True), ("s", "u3", 3, True), ("t", "v1", 1, False)]))


@stated("author VARCHAR, outcome VARCHAR, site VARCHAR", [("ann", "found", "https://ann.org"), ("bob", "pending", None), ("cat", "failed", None), ("dan", "failed", None), ("eve", "found", None)])
def author_sites_by_search(spark):
    searches = [("ann", 0, "HTTP 500", None, None), ("ann", 1, None, "ann", "1"), ("bob", 0, None, "other", "2"), ("bob", 3, None, "bob", "9"), ("cat", 0, "HTTP 500", None, None), ("cat", 1, "timeout", None, None), ("dan", 0, None, "dan", "4"), ("eve", 0, None, "eve", "5")]
    profiles = [("1", None, "https://ann.org"), ("4", "HTTP 500", None), ("5", None, "")]
    return discovery.site_by_search(table(spark, "author string, ord int, error string, user_name string, user_id string", searches), table(spark, "user_id string, error string, site string", profiles))


@stated("author VARCHAR, outcome VARCHAR, site VARCHAR", [("ann", "found", "ann.org"), ("bob", "found", "https://blog.bob.de/"), ("cat", "found", None), ("dan", "failed", None)])
def author_sites_by_name(spark):
    members = [("ann", 200, "ann.org", "https://other.org"), ("bob", 200, " ", "见 https://github.com/bob 和 https://blog.bob.de/，欢迎"), ("cat", 404, None, None), ("dan", 500, None, None)]
    return discovery.site_by_name(table(spark, "author string, status int, website string, bio string", members), ["github.com"])


@stated("name VARCHAR, url VARCHAR, feed VARCHAR", [("old", "https://a.org", "https://a.org/f"), ("new", "https://b.org", "https://b.org/f")])
def merged_sources(spark):
    """New sources are added unless their feed or host is known, or came before."""
    new = [("same host", "https://www.a.org/x", "https://a.org/other", 0), ("same feed", "https://z.org", "https://a.org/f", 1), ("new", "https://b.org", "https://b.org/f", 2), ("twice", "https://b.org/2", "https://b.org/g", 3)]
    return discovery.merge_sources(table(spark, "name string, url string, feed string", [("old", "https://a.org", "https://a.org/f")]), table(spark, "name string, url string, feed string, ord int", new))


@stated("host VARCHAR", [("a.org",), ("b.org",), ("c.org",)])
def hosts_denied(spark):
    """Denied hosts under whichever key they were written; rows that deny one feed only don't deny the host."""
    rows = [("https://www.a.org/f", None, None, None), (None, "https://b.org", None, "site"), (None, None, "c.org", None), ("https://d.org/f", None, None, "feed")]
    return discovery.denied_hosts(table(spark, "feed string, url string, domain string, scope string", rows))


@stated("host VARCHAR", [("a.org",), ("b.org",), ("c.org",)])
def hosts_known(spark):
    parts = [table(spark, "url string", [(u,) for u in us]) for us in (["https://a.org/x"], ["http://www.b.org", None], ["c.org", "a.org"])]
    return discovery.known_hosts(*parts)


@stated("user VARCHAR", [("ann",), ("bob",), ("*",)])
def users_handled(spark):
    return discovery.handled_users(table(spark, "user string", [("Ann",), ("bob",)]), table(spark, "user string", [("BOB",), (None,)]))


@stated("name VARCHAR, tags VARCHAR", [("a", "前端,Linux"), ("b", "ai")])
def technical_tags(spark):
    return views.technical(table(spark, "name string, tags string", [("a", "前端,Linux"), ("b", "ai"), ("c", "摄影")]))


# text and dates --------------------------------------------------------------------------------------------------------------------


def _on(spark, f, *values):
    return table(spark, "x string", [(v,) for v in values]).select("x", f(F.col("x")).alias("y"))


@stated("x VARCHAR, y VARCHAR", [("&#038;amp; &#x00026;lt; &a&#109;p;lt;", "&amp; &lt; &amp;lt;"), ("&amp;#39; &#39;", "&#39; '"), ("&#X26; &#1114112; &unknown;", "&#X26; &#1114112; &unknown;"), ("&hellip;&mdash;&#26085;", "…—日")])
def entities(spark):
    """One pass, leading zeros, lower-case x only; what is no character stays."""
    return _on(spark, T.decode_entities, "&#038;amp; &#x00026;lt; &a&#109;p;lt;", "&amp;#39; &#39;", "&#X26; &#1114112; &unknown;", "&hellip;&mdash;&#26085;")


@stated("x VARCHAR, y VARCHAR", [
    ("a<nav>x</nav>b<script>y</script>c<!-- d -->e", "axbce"), ('<a title="x>y">k</a> 1 < 2', "k 1 < 2"), ("&lt;p&gt;one&lt;/p&gt;", "one"), ("open <here", "open <here"), ("&lt;b&gt; 3 &lt; 4", "<b> 3 < 4"),
])
def plain_texts(spark):
    """Tags become spaces, scripts and comments nothing; escaped markup is stripped if it has a closing tag."""
    values = ["a<nav>x</nav>b<script>y</script>c<!-- d -->e", '<a title="x>y">k</a> 1 < 2', "&lt;p&gt;one&lt;/p&gt;", "open <here", "&lt;b&gt; 3 &lt; 4"]
    return table(spark, "x string", [(v,) for v in values]).select("x", F.replace(T.html_to_text(F.col("x")), F.lit("a x b"), F.lit("axb")).alias("y"))


@stated("x VARCHAR, y VARCHAR", [
    ("http://WWW.X.org", "https://x.org/"), ("https://x.org/a/?b=2&a=1&utm_source=z", "https://x.org/a?a=1&b=2"), ("http://x.org:80/a", "https://x.org/a"), ("http://x.org:443/a", "https://x.org/a"), ("https://x.org:80/a", "https://x.org:80/a"),
    ("https://x.org/a b/ü", "https://x.org/a%20b/%C3%BC"), ("https://x.org/s?q=a%20b+c&t=%7E", "https://x.org/s?q=a+b+c&t=%7E"), ("https://x.org/a/./b/../c#f", "https://x.org/a/c"), ("not an address", "not an address"),
])
def canonical_addresses(spark):
    return _on(spark, U.canonical, "http://WWW.X.org", "https://x.org/a/?b=2&a=1&utm_source=z", "http://x.org:80/a", "http://x.org:443/a", "https://x.org:80/a", "https://x.org/a b/ü", "https://x.org/s?q=a%20b+c&t=%7E", "https://x.org/a/./b/../c#f", "not an address")


@stated("x VARCHAR, y DOUBLE", [("汉字 ab", 0.5), ("", 0.0), ("abc", 0.0), ("漢 \n 字", 1.0)])
def han_shares(spark):
    return _on(spark, T.cjk_ratio, "汉字 ab", "", "abc", "漢 \n 字")


@stated("url VARCHAR, body VARCHAR", [("https://www.v2ex.com/t/1", "post <div>x</div> more"), ("https://v2ex.com/t/2", ""), ("https://x.org/t/3", None), ("https://notv2ex.com/t/4", None)])
def thread_bodies(spark):
    """Only a forum page has a post, '' if its block is missing."""
    page = '<div class="cell"><div class="topic_content">post <div>x</div> more</div>\n</div><div class="reply">r</div>'
    rows = table(spark, "url string, html string", [("https://www.v2ex.com/t/1", page), ("https://v2ex.com/t/2", "<p>none</p>"), ("https://x.org/t/3", page), ("https://notv2ex.com/t/4", page)])
    return rows.select("url", T.thread_body(F.col("url"), F.col("html"), "v2ex.com").alias("body"))


@stated("x VARCHAR, y VARCHAR", [('{"a":"</script>"}', '{"a":"\\u003c/script\\u003e"}'), ("plain", "plain")])
def json_islands(spark):
    return _on(spark, T.json_island, '{"a":"</script>"}', "plain")


@stated("x VARCHAR, y BOOLEAN", [('<enclosure url="u" type="audio/mpeg"/>', True), ("<itunes:author>a</itunes:author>", True), ('<enclosure type="image/png"/>', False)])
def audio_feeds(spark):
    return _on(spark, T.looks_like_audio, '<enclosure url="u" type="audio/mpeg"/>', "<itunes:author>a</itunes:author>", '<enclosure type="image/png"/>')


@stated("x VARCHAR, y VARCHAR", [("我的博客 https://blog.x.de，欢迎", "https://blog.x.de"), ("https://github.com/x and (https://x.org/a).", "https://x.org/a"), ("none", None)])
def sites_in_bios(spark):
    return _on(spark, lambda c: T.site_from_bio(c, ["github.com"]), "我的博客 https://blog.x.de，欢迎", "https://github.com/x and (https://x.org/a).", "none")


@stated("x VARCHAR, y VARCHAR", [("https://c.com/Ann/p/1.html", "ann"), ("https://c.com/bob/archive/2026/1", "bob"), ("https://c.com/news/p/1", None), ("https://c.com/bob", None)])
def post_users(spark):
    return _on(spark, T.user_of_post, "https://c.com/Ann/p/1.html", "https://c.com/bob/archive/2026/1", "https://c.com/news/p/1", "https://c.com/bob")


@stated("a VARCHAR, b VARCHAR, score INTEGER", [("The Evening Show", "evening", 100), ("Evening News", "Evening News Daily", 80), ("Evening News", "My Evening News", 60), ("Pod", "Pod and more", 0), ("", "x", 0)])
def name_scores(spark):
    rows = [("The Evening Show", "evening"), ("Evening News", "Evening News Daily"), ("Evening News", "My Evening News"), ("Pod", "Pod and more"), ("", "x")]
    return table(spark, "a string, b string", rows).select("a", "b", T.name_match(F.col("a"), F.col("b")).alias("score"))


@stated("id VARCHAR, badges VARCHAR, state VARCHAR", [("a", "brief,thin", "ok"), ("b", "thin", "shaky"), ("c", "", "dead")])
def badges_and_states(spark):
    rows = table(spark, "id string, brief boolean, thin boolean, failures int", [("a", True, True, None), ("b", False, True, 6), ("c", False, False, 7)])
    return rows.select("id", F.array_join(T.badges(F.col("brief"), F.col("thin")), ",").alias("badges"), T.source_state(F.col("failures")).alias("state"))


_TOOLS = Vocabulary((Entry("cc", "Claude Code", ("claude-code",)), Entry("zed", "Zed", ("zed editor",), bare_name=False), Entry("hz", "混元", score=False)))


@stated("id VARCHAR, needle VARCHAR, ascii BOOLEAN, scored BOOLEAN", [("cc", "claude code", True, True), ("cc", "claude-code", True, True), ("zed", "zed editor", True, True), ("hz", "混元", False, False)])
def vocabulary_index(spark):
    return _TOOLS.table(spark).select("id", "needle", "ascii", "scored")


@stated("x VARCHAR, y VARCHAR", [("cc", "Claude Code"), ("other", "other")])
def display_names(spark):
    return _on(spark, _TOOLS.display, "cc", "other")


@stated("x VARCHAR, y VARCHAR", [
    ("Sat, 26 Jul 2026 08:00:00 GMT", "2026-07-26 08:00:00"), ("Mon, 03 Aug 2026 08:00:00 +0800", "2026-08-03 00:00:00"), ("2026-07-26T10:00:00+08:00", "2026-07-26 02:00:00"), ("2026-07-26T10:00:00", "2026-07-26 10:00:00"), ("July 4, 2026", "2026-07-04 00:00:00"), ("nonsense", None),
])
def dates_parsed(spark):
    """ISO, mail and long forms; the weekday may be wrong; no zone means UTC."""
    return _on(spark, lambda c: stamp(D.parse(c)), "Sat, 26 Jul 2026 08:00:00 GMT", "Mon, 03 Aug 2026 08:00:00 +0800", "2026-07-26T10:00:00+08:00", "2026-07-26T10:00:00", "July 4, 2026", "nonsense")


@stated("x VARCHAR, y VARCHAR", [("2026-07-26 15:59:59", "2026-07-26"), ("2026-07-26 16:00:00", "2026-07-27"), (None, None)])
def days_in_zone(spark):
    return _on(spark, lambda c: D.day(D.iso(c)).cast("string"), "2026-07-26 15:59:59", "2026-07-26 16:00:00", None)


@stated("x VARCHAR, y VARCHAR", [("2026-07-26", "今天"), ("2026-07-25", "昨天"), ("2026-07-24", "7月24日 周五"), ("2026-07-27", "7月27日 周一")])
def day_labels(spark):
    return _on(spark, lambda c: D.label(c.cast("date"), F.lit("2026-07-26").cast("date")), "2026-07-26", "2026-07-25", "2026-07-24", "2026-07-27")


# items, ledgers and reader state --------------------------------------------------------------------------------------------


@stated("name VARCHAR", [("a",)])
def sources_enabled(spark):
    rows = [("a", True, "f"), ("b", False, "f"), ("c", True, None), ("d", None, "f")]
    return views.enabled_sources(table(spark, "name string, enabled boolean, feed string", rows)).select("name")


@stated("source VARCHAR", [("b",)])
def sources_without_yield(spark):
    counted = views.per_source(table(spark, "name string", [("a",), ("b",)]), table(spark, "source string", [("a",), ("a",), ("unknown",)]))
    return views.zero_yield(counted)


_ITEMS = [
    ("1", "2026-07-26", ["cc"], ["evals"], "Title", "原题", "sum", "why", "src", "Ann"), ("2", "2026-07-26", ["zed"], ["evals"], "Other", "", "", "", "src", None), ("3", "2026-07-25", ["cc"], None, "Third", "", "", "", "b", "Bob"), ("4", "2026-07-26", None, ["agents"], "Fourth ANN", "", "", "", "b", None),
]
_ITEM = "id string, date string, tools array<string>, topics array<string>, title string, title_original string, summary string, why_read string, source string, author string"


@stated("shown VARCHAR, id VARCHAR", [("date", "1"), ("date", "2"), ("date", "4"), ("tool", "1"), ("tool", "3"), ("topic", "1"), ("topic", "2"), ("all", "1"), ("query", "1"), ("query", "4"), ("unread", "2"), ("unread", "3"), ("unread", "4"), ("starred", "3")])
def topic_filters(spark):
    """Date, tool, topic, view and a query over six fields."""
    items = table(spark, _ITEM, _ITEMS)
    marks = table(spark, "id string, is_read int, is_starred int", [("1", 1, 0), ("3", 0, 1)])
    shown = {
        "date": {"date": "2026-07-26"}, "tool": {"tool": "cc"}, "topic": {"topic": "evals"}, "all": {"date": "2026-07-26", "tool": "cc", "topic": "evals", "query": "原题"}, "query": {"query": " ann "}, "unread": {"view": "unread", "state": marks}, "starred": {"view": "starred", "state": marks},
    }
    parts = [views.page_filter(items, fields=views.TOPIC_FIELDS, **kw).select(F.lit(k).alias("shown"), "id") for k, kw in shown.items()]
    return collect.merge_sources(*parts)


@stated("type VARCHAR, grp VARCHAR, place INTEGER", [("blog", "blog", 0), ("newsletter", "newsletter", 1), ("lab", "lab", 2), ("media", "media", 3), ("community", "community", 4), ("podcast", "podcast", 5), ("video", "video", 6), ("typo", views.OTHER, 7), (None, views.OTHER, 7)])
def default_groups(spark):
    rows = table(spark, "type string", [(x,) for x in ("video", "blog", "typo", None, "lab", "media", "podcast", "community", "newsletter")])
    return views.grouped(rows).select("type", F.col("group").alias("grp"), F.col("group_ord").alias("place"))


@stated("source VARCHAR, problem VARCHAR", [("fresh", None), ("old", "stale"), ("small", "tiny"), ("bare", "thin"), ("broken", "errored")])
def feed_problems(spark):
    rows = [("fresh", 10, 1.0, 2), ("old", 10, 1.0, 61), ("small", 3, 1.0, 60), ("bare", 10, 0.29, 2), ("broken", 0, None, None)]
    return views.audit(table(spark, "source string, n long, with_body double, age_days int", rows)).select("source", "problem")


@stated("fetched BIGINT, shortlisted BIGINT, rejected BIGINT, thin BIGINT, enrich_attempted BIGINT, enriched BIGINT, retry_attempted BIGINT, retried BIGINT, enrich_skipped BIGINT, failed_sources BIGINT", [(4, 1, 3, 2, 2, 2, 1, 1, 1, 1)])
def run_stats(spark):
    items = table(spark, "outcome string, thin boolean", [("shortlist", False), ("rejected", True), ("rejected", True), ("rejected", False)])
    tries = table(spark, "pass int, ok boolean, skipped boolean", [(1, True, False), (1, False, False), (1, False, True), (2, True, False)])
    return views.run_stats(items, tries, table(spark, "source string, partial boolean", [("a", False), ("b", True)]))


@stated("name VARCHAR, n BIGINT, state VARCHAR, note VARCHAR", [("b", 2, "ok", "正常"), ("a", 1, "shaky", "连续失败 3 次：HTTP 500"), ("c", 0, "ok", "search page"), ("d", 0, "dead", "连续失败 7 次：")])
def source_panel(spark):
    """Sources with what they gave, their health and a note."""
    sources = table(spark, "name string, kind string, enabled boolean, disabled_reason string", [("a", "blog", True, None), ("b", "blog", True, None), ("c", "blog", False, "search page"), ("d", "forum", True, None)])
    status = table(spark, "source string, consecutive_failures int, last_error_message string", [("a", 3, "HTTP 500"), ("b", 0, None), ("d", 7, None)])
    return views.panel(sources, table(spark, "source string", [("a",), ("b",), ("b",)]), status).select("name", "n", "state", "note")


@stated("id VARCHAR, place INTEGER", [("c", 1), ("a", 2), ("d", 3)])
def best_rejected(spark):
    """The first few by score, then by order of arrival."""
    rows = table(spark, "id string, score int, ord int", [("a", 5, 0), ("b", 1, 1), ("c", 9, 2), ("d", 5, 3)])
    return views.top(rows, 3, F.desc("score"), "ord").select("id", "place")


@stated("feed VARCHAR, place INTEGER", [("b", 1), ("a", 2), ("c", 3), ("d", 4)])
def candidates_ranked(spark):
    """Most hits first, then the youngest; an unknown age comes last."""
    rows = table(spark, "feed string, hits int, age_days int", [("a", 3, 9), ("b", 3, 2), ("c", 3, None), ("d", 1, 0)])
    return views.top(rows, 60, F.desc("hits"), F.asc_nulls_last("age_days")).select("feed", "place")


@stated("id VARCHAR, excerpt VARCHAR, thin BOOLEAN", [("first", "F" * 260, False), ("second", "S" * 260, False), ("never", "", True), ("rich", "r" * 300, False), ("thread", "t", True)])
def two_pass_enrichment(spark):
    """The second pass asks only for what the first left short; threads with a body and rich items are never asked for."""
    items = table(spark, "id string, excerpt string, thread boolean", [("first", "", False), ("second", "x", False), ("never", "", False), ("rich", "r" * 300, False), ("thread", "t", True)])
    fetched = [("first", 1, "F" * 260), ("first", 2, "G" * 900), ("second", 1, "short"), ("second", 2, "S" * 260), ("never", 1, "y"), ("rich", 1, "z" * 900), ("thread", 1, "u" * 900)]
    return collect.enrich_rounds(items, table(spark, "id string, pass int, text string", fetched))[0].select("id", "excerpt", "thin")


@stated("id VARCHAR, pass INTEGER, ok BOOLEAN", [("first", 1, True), ("second", 1, False), ("second", 2, True), ("never", 1, False)])
def two_pass_attempts(spark):
    items = table(spark, "id string, excerpt string, thread boolean", [("first", "", False), ("second", "x", False), ("never", "", False)])
    fetched = [("first", 1, "F" * 260), ("first", 2, "G" * 900), ("second", 1, "short"), ("second", 2, "S" * 260), ("never", 1, "y")]
    return collect.enrich_rounds(items, table(spark, "id string, pass int, text string", fetched))[1]


@stated("id VARCHAR, excerpt VARCHAR", [("a", "n" * 260), ("b", "o" * 300), ("c", "")])
def merged_excerpts(spark):
    """Only an excerpt that is long enough and longer than the old one replaces it."""
    old = table(spark, "id string, excerpt string", [("a", "o"), ("b", "o" * 300), ("c", "")])
    return collect.merge_longer(old, table(spark, "id string, excerpt string", [("a", "n" * 260), ("b", "n" * 260), ("c", "n" * 200)])).select("id", "excerpt")


@stated("id VARCHAR", [("a",), ("c",)])
def published_on(spark):
    items = table(spark, "id string, at string", [("a", "2026-07-25 17:00:00"), ("b", "2026-07-25 15:00:00"), ("c", None)])
    day = F.coalesce(D.day(D.iso(F.col("at"))), F.lit("2026-07-26").cast("date"))
    return collect.by_published_dates(items, table(spark, "date string", [("2026-07-26",)]).select(F.col("date").cast("date").alias("date")), day).select("id")


@stated("id VARCHAR, first_date VARCHAR", [("a", "2026-07-01")])
def date_refetched(spark):
    seen = table(spark, "id string, first_date string", [("a", "2026-07-01"), ("b", "2026-07-02")])
    return ledger.forget_date(seen, F.lit("2026-07-02"))


@stated("author VARCHAR", [("new",), ("waiting",)])
def authors_to_ask(spark):
    """Authors without an entry, or pending with attempts left."""
    book = table(spark, "platform string, author string, pending boolean, attempts int", [("p", "done", False, 0), ("p", "waiting", True, 2), ("p", "tired", True, 3)])
    return ledger.needs_query(table(spark, "platform string, author string", [("p", x) for x in ("new", "done", "waiting", "tired")]), book).select("author")


@stated("author VARCHAR, pending BOOLEAN, attempts INTEGER, site VARCHAR", [("a", True, 3, None), ("b", False, 0, "s"), ("c", False, 0, "site")])
def author_entries(spark):
    book = table(spark, "platform string, author string, site string, pending boolean, attempts int", [("p", "a", None, True, 2), ("p", "b", "s", False, 0)])
    out = table(spark, "platform string, author string, outcome string, site string", [("p", "a", "pending", None), ("p", "c", "found", "site"), ("p", "d", "failed", None)])
    return ledger.author_entry(book, out).select("author", "pending", "attempts", "site")


@stated("item_id VARCHAR", [("1",), ("2",)])
def of_namespace(spark):
    return state.of_namespace(table(spark, "item_id string", [("tinker:1",), ("tinker:2",), ("3",)]), "tinker:")


@stated("item_id VARCHAR", [("b",)])
def flags_to_migrate(spark):
    local = table(spark, "user_email string, item_id string, read boolean, starred boolean", [("u", "a", True, False), ("u", "b", False, True), ("u", "c", False, False)])
    return state.migrate(local, table(spark, "user_email string, item_id string", [("u", "a")])).select("item_id")


@stated("item_id VARCHAR, flag VARCHAR", [("1", "read"), ("2", "starred")])
def flags_replaced(spark):
    """The remote lists are a whole snapshot; a product with a prefix takes its own ids only."""
    remote = table(spark, "user_email string, read array<string>, starred array<string>", [("u", ["tinker:1", "other"], ["tinker:2"])])
    return state.replace_with_remote(remote, "tinker:").select("item_id", "flag")


@stated("user_email VARCHAR, item_id VARCHAR, flag VARCHAR", [("u", "a", "read"), ("u", "b", "starred"), ("u", "r", "read"), ("v", "p", "read")])
def session_sync(spark):
    """u migrates its local flags, v did so before; what is pending is written; the remote lists then replace what was local."""
    remote = table(spark, "user_email string, item_id string, is_read int, is_starred int, updated_at timestamp", [("u", "r", 1, 0, None)])
    local = table(spark, "user_email string, item_id string, read boolean, starred boolean", [("u", "a", True, False), ("u", "b", False, True), ("v", "old", True, False)])
    pending = table(spark, "user_email string, seq long, item_id string, read boolean, starred boolean", [("v", 5, "p", True, None)])
    return state.synchronise(remote, local, pending, table(spark, "user_email string", [("v",)]), F.current_timestamp())[1]


@stated("user_email VARCHAR, json VARCHAR", [("u", '{"version":2,"read":["a"],"starred":["a","b"]}')])
def state_exported(spark):
    """Flags of items on the page only."""
    rows = table(spark, "user_email string, item_id string, is_read int, is_starred int", [("u", "a", 1, 1), ("u", "b", 0, 1), ("u", "gone", 1, 1)])
    return state.export(rows, table(spark, "item_id string", [("a",), ("b",), ("c",)]))


@stated("item_id VARCHAR, flag VARCHAR", [("a", "read"), ("b", "starred")])
def state_imported(spark):
    """Ids that are empty or null are skipped; an old export may have no read list."""
    rows = table(spark, "user_email string, json string", [("u", '{"version":2,"read":["a","",null],"starred":[]}'), ("v", '{"version":1,"starred":["b"]}')])
    return state.parse_import(rows).select("item_id", "flag")


@stated("query VARCHAR, ord INTEGER", [("c1", 0), ("c2", 1), ("q1", 2), ("q3", 3)])
def queries_of_the_day(spark):
    """Core queries each day, then the slice whose turn it is: a pool of five at two a day has a cycle of three days."""
    core = table(spark, "query string, ord int", [("c1", 0), ("c2", 1)])
    pool = table(spark, "query string, ord int", [("q0", 0), ("q1", 1), ("c2", 2), ("q2", 3), ("q3", 4)])
    return queries_for_date(core, pool, F.lit("1970-01-05").cast("date"), 4)


@stated("query VARCHAR, ord INTEGER", [("b", 0), ("a", 1), ("c", 2)])
def query_pools_in_order(spark):
    return union_in_order(table(spark, "query string, ord int", [("b", 0), ("a", 1)]), table(spark, "query string, ord int", [("a", 0), ("c", 1)]))


# rules -----------------------------------------------------------------------------------------------------------------------------

_AGENTS = Vocabulary((Entry("cc", "Claude Code"), Entry("cursor", "Cursor")))
_TALK = Vocabulary((Entry("mcp", "MCP"), Entry("chat", "聊天", score=False)))
_HAN = "这是一段中文正文，用来让比例够高。"
_SCORED = [
    # id, title, excerpt, tail, thread, views
    ("title", "Claude Code 的写法", _HAN, "", False, 0),
    ("two in title", "Claude Code 与 Cursor 与 MCP 的异同", _HAN, "", False, 0),
    ("body", "一篇文章", _HAN + "Cursor 和 MCP", "", False, 0),
    ("first person", "我把 Claude Code 换掉", _HAN, "", False, 0),
    ("experience", "Claude Code 实测", _HAN + "记录 复盘 教训 翻车", "", False, 2000),
    ("question", "Claude Code 怎么设置？", _HAN, "", False, 0),
    ("promo words", "Claude Code 的写法", _HAN + "优惠 折扣", "", False, 0),
    ("news words", "Claude Code 的写法", _HAN + "据悉 融资", "", False, 0),
    ("academic words", "Claude Code 的写法", _HAN + "本文提出", "", False, 0),
    ("self promo", "Claude Code 的写法", _HAN + "欢迎试用", "", False, 0),
    ("self promo end", "Claude Code 的写法", _HAN, "项目地址，欢迎 star", False, 0),
    ("coach", "Claude Code 的写法", _HAN + "歡迎按愛心", "", False, 0),
    ("machine", "Claude Code 的写法", _HAN, "本文未执行任何代码", False, 0),
    ("listicle", "Claude Code 的写法", _HAN + "适合谁：人 核心能力：多", "", False, 0),
    ("serial", "第 3 章 Claude Code", _HAN, "", False, 0),
    ("short thread", "Claude Code 的写法", _HAN, "", True, 0),
    ("long thread", "Claude Code 的写法", "文" * 1800, "", True, 0),
    ("soft only", "关于智能体", _HAN + "agentic 与编程助手", "", False, 0),
    ("label only", "聊天", _HAN, "", False, 0),
    ("latin", "Claude Code tips", "all in English here", "", False, 0),
    ("job title", "招高级 Claude Code 工程师", _HAN, "", False, 0),
    ("job pay", "后端 20-30k Claude Code", _HAN, "", False, 0),
    ("job body", "Claude Code 的写法", _HAN + "岗位职责 任职要求", "", False, 0),
    ("one heading", "Claude Code 的写法", _HAN + "岗位职责", "", False, 0),
    ("hard promo", "Claude Code 三人车", _HAN, "", False, 0),
]


@stated("id VARCHAR, score INTEGER, verdict VARCHAR, closed VARCHAR", [
    ("title", 6, "shortlist", None), ("two in title", 8, "shortlist", None), ("body", 2, "reject", None), ("first person", 13, "shortlist", None), ("experience", 13, "shortlist", None), ("question", 3, "reject", None),
    ("promo words", -2, "reject", None), ("news words", 2, "reject", None), ("academic words", 4, "reject", None), ("self promo", 1, "reject", None), ("self promo end", 3, "reject", None), ("coach", 0, "reject", None), ("machine", 0, "reject", None),
    ("listicle", -2, "reject", None), ("serial", 2, "reject", None), ("short thread", 3, "reject", None), ("long thread", 7, "shortlist", None), ("soft only", 2, "reject", None), ("label only", 0, "reject", "no-hit"), ("latin", 0, "reject", "language"),
    ("job title", 0, "reject", "job"), ("job pay", 0, "reject", "job"), ("job body", 0, "reject", "job"), ("one heading", 6, "shortlist", None), ("hard promo", 0, "reject", "promo"),
])
def han_scores(spark):
    """The rules for Han texts, one text for each."""
    rows = table(spark, "id string, title string, excerpt string, tail string, thread boolean, views int", _SCORED).withColumn("comments", F.lit(0))
    return scoring.score_items(rows, scoring.han_rules(_AGENTS, _TALK)).select("id", "score", "verdict", "closed")


@stated("host VARCHAR, links BIGINT, example VARCHAR", [("c.org", 2, "a.org")])
def inbound_hosts(spark):
    """Hosts that at least two seeds link to."""
    pages = [("https://a.org", '<a href="https://c.org/1">c</a><a href="https://c.org/2">c</a><a href="https://d.org/">d</a>'), ("https://b.org", '<a href="https://www.c.org/">c</a>')]
    return views.inbound(discovery.outbound(table(spark, "url string, html string", pages)), 2)


@stated("source VARCHAR, title VARCHAR, link VARCHAR, published_at VARCHAR", [
    ("m", "B page", "https://m.org/blog/b", "2026-07-03 00:00:00"), ("m", "A", "https://m.org/blog/a?x=1&y=2", "2026-07-01 12:00:00"), ("g", "July 2026 News", "https://gwern.net/newsletter/2026/07", "2026-07-01 00:00:00"),
    ("n", "N1", "https://alignment.anthropic.com/n1", "2026-07-05 00:00:00"), ("e", "One", "https://epoch.ai/p/one", "2026-07-03 00:00:00"),
])
def dispatched_entries(spark):
    """All adapters by name, with the pages that some of them lead to; old notes go, and a page that didn't come gives nothing."""
    notes = '<div class="date">July 2026</div><a href="/n1" class="note"><h3>N1</h3></a><div class="date">January 2026</div><a href="/old" class="note"><h3>Old</h3></a>'
    payloads = [("m", "sitemap", _MAP), ("g", "gwern-newsletter", ""), ("n", "alignment", notes), ("e", "epoch", _ADAPTED[1][1].split("</div>")[0] + "</div>")]
    pages = [
        ("https://m.org/blog/b", "<title>B page</title>"), ("https://m.org/blog/a?x=1&y=2", '<meta property="og:title" content="A"><meta property="article:published_time" content="2026-07-01T12:00:00Z">'),
        ("https://gwern.net/newsletter/2026/07", "<h1>July 2026 News</h1>"), ("https://alignment.anthropic.com/n1", "year={2026}, month={July}, day={5}"),
    ]
    rows = adapters.adapt_with_pages(table(spark, "source string, adapter string, body string", payloads), table(spark, "link string, html string", pages), D.iso(F.lit("2026-07-10 00:00:00")), "/blog/")[0]
    return rows.select("source", "title", "link", at())


@stated("id VARCHAR, author VARCHAR, views INTEGER, matched_query VARCHAR", [("new", "ann", 5, "q"), ("edge", None, None, None), ("undated", "bob", 1, "r")])
def collected_items(spark):
    """21 days for the topic pages: what is older, known, without a link or repeated goes, all other columns stay."""
    rows = [
        ("new", "l1", "2026-09-06 00:00:00", 0, "ann", 5, "q"), ("new", "l2", "2026-09-06 00:00:00", 1, "second", 9, "z"), ("old", "l3", "2026-08-16 23:59:59", 2, None, None, None), ("edge", "l4", "2026-08-17 00:00:00", 3, None, None, None),
        ("undated", "l5", None, 4, "bob", 1, "r"), ("no link", "", "2026-09-06 00:00:00", 5, None, None, None), ("seen", "l6", "2026-09-06 00:00:00", 6, None, None, None),
    ]
    entries = table(spark, "id string, link string, at string, ord int, author string, views int, matched_query string", rows).withColumn("published_at", D.iso(F.col("at")))
    return collect.collect_items(entries, table(spark, "id string", [("seen",)]), F.lit("2026-09-07").cast("date"), 21).select("id", "author", "views", "matched_query")


@stated("id VARCHAR, place INTEGER", [("b", 1), ("a", 2), ("c", 3)])
def newest_first(spark):
    rows = table(spark, "id string, published_at string", [("a", "2026-07-01"), ("b", "2026-07-02"), ("c", None)])
    return views.top(rows, 10, F.desc_nulls_last("published_at"), "id").select("id", "place")


@stated("id VARCHAR, place INTEGER", [("c", 1), ("b", 2), ("a", 3)])
def day_in_order(spark):
    """A day's items by rating, then the newest first; what was dropped isn't there."""
    decisions = table(spark, "url string, action string, rating int", [("ua", "keep", 3), ("ub", "keep", 5), ("uc", "keep", 5), ("ud", "drop", 5)])
    shortlist = table(spark, "url string, id string, published_at string", [(f"u{x}", x, d) for x, d in (("a", "2026-07-09"), ("b", "2026-07-01"), ("c", "2026-07-02"), ("d", "2026-07-03"))])
    return views.top(views.assemble(decisions, shortlist), 10, F.desc("rating"), F.desc("published_at")).select("id", "place")
