"""Text, address and date functions against literal expectations."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from siftloom.functions import dates as D
from siftloom.functions import text as T
from siftloom.functions import url as U
from siftloom.functions.vocab import Entry, Vocabulary


def one(spark, f, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()[0]


@pytest.mark.parametrize(("html", "want"), [
    ("<p>a</p><script>x<1</script>b", "a b"), ('<a title="x>y">k</a> 1 < 2', "k 1 < 2"), ("open < here", "open < here"), ("a&amp;lt;b", "a&lt;b"), ("&#26085;&#x672C; &nbsp;&hellip;", "日本 …"),
    ("&lt;p&gt;one&lt;/p&gt;", "one"), ("<!-- <b>no</b> -->yes", "yes"), ("", ""), (None, ""), ("&unknown; &#0; &#38;amp;", "&unknown; &#0; &amp;"),
])
def test_html_to_text(spark, html, want):
    assert one(spark, T.html_to_text, html) == want


def test_cut_counts_code_points(spark):
    assert one(spark, lambda c: T.html_to_text(c, 3), "ab😀cd") == "ab😀"
    assert one(spark, T.utf16_length, "ab😀") == 4


def test_article(spark):
    assert one(spark, T.article_text, "<body><nav>n</nav><article>a<article>b</article>c</article>after</body>") == "a b c"
    assert one(spark, T.article_text, "<main>m</main>") == "m"
    assert one(spark, T.article_text, "<body>plain</body>") == "plain"
    assert one(spark, lambda c: T.article_tail(c, 4, 2), "abcdef") == "ef"
    assert one(spark, lambda c: T.article_tail(c, 6, 2), "abcdef") == ""


@pytest.mark.parametrize(("a", "b", "same"), [
    ("https://x.org/a/", "https://x.org/a", True), ("http://WWW.X.org/a#f", "https://x.org/a", True), ("https://x.org/a?utm_source=q&b=1&a=2", "https://x.org/a?a=2&b=1", True),
    ("https://x.org/a?id=1", "https://x.org/a?id=2", False), ("https://x.org/?ref=k", "https://x.org", True), ("https://x.org/A", "https://x.org/a", False), ("https://x.org/a?SPM=1&sc=2", "https://x.org/a", True),
])
def test_canonical(spark, a, b, same):
    assert (one(spark, U.item_id, a) == one(spark, U.item_id, b)) is same


@pytest.mark.parametrize(("url", "want"), [
    ("http://WWW.X.org", "https://x.org/"), ("https://x.org/?ref=k", "https://x.org/"), ("https://x.org/a/?b=2&a=1", "https://x.org/a?a=1&b=2"), ("http://x.org:80/a", "https://x.org/a"), ("http://x.org:443/a", "https://x.org/a"),
    ("https://x.org:80/a", "https://x.org:80/a"), ("https://x.org:8443/", "https://x.org:8443/"), ("https://x.org/a b/ü", "https://x.org/a%20b/%C3%BC"), ("https://x.org/s?q=a%20b+c&t=%7Ex*", "https://x.org/s?q=a+b+c&t=%7Ex*"),
    ("https://x.org/a?x", "https://x.org/a?x="), ("https://x.org/a/./b/../c", "https://x.org/a/c"), ("https://u:p@x.org/", "https://u:p@x.org/"), ("  https://x.org/a#f  ", "https://x.org/a"), ("https://x.org/a?k=%E4%BD%A0", "https://x.org/a?k=%E4%BD%A0"),
    ("not an address", "not an address"),
])
def test_canonical_form(spark, url, want):
    assert one(spark, U.canonical, url) == want
    assert one(spark, U.item_id, url) == hashlib.sha256(want.encode()).hexdigest()[:16]


def test_literal_ids(spark):
    assert one(spark, U.item_id, "http://www.example.org:80/?utm_source=x#top") == "8198d1bac40a1033"
    assert one(spark, U.item_id, "https://example.org/post/?b=1&a=2") == "9ce743d261d7d7d9"


@pytest.mark.parametrize(("text", "want"), [
    ("&#038;amp; &#x00026;lt; &a&#109;p;lt;", "&amp; &lt; &amp;lt;"), ("&#X26; &#1114112; &#55296;", "&#X26; &#1114112; &#55296;"), ("&amp;#39;", "&#39;"), ("&amp;amp;lt;", "&amp;lt;"), ("&hellip;&mdash;", "…—"), ("&", "&"), (None, None),
])
def test_entities_are_decoded_once(spark, text, want):
    assert one(spark, T.decode_entities, text) == want


def test_noise_leaves_nothing_behind(spark):
    assert one(spark, T.strip_noise, "a<nav>x</nav>b<form>y</form>") == "ab"
    assert one(spark, T.html_to_text, "a<script>x</script>b<!-- c -->d") == "abd"
    assert one(spark, T.html_to_text, "&lt;b&gt;x&lt;/b &gt; 3 &lt; 4") == "x 3 < 4"


def test_addresses(spark):
    assert one(spark, U.canonical, "not an address") == "not an address"
    assert one(spark, U.host, "WWW.Example.org") == "example.org"
    assert one(spark, U.resolve, "feed.xml", "https://x.org/a/b.html") == "https://x.org/a/feed.xml"
    assert one(spark, U.resolve, "//y.org/f", "https://x.org/a") == "https://y.org/f"
    assert one(spark, T.safe_url, "java\nscript:alert(1)") == "#"
    assert one(spark, T.safe_url, "ht\ntps://x.org") == "https://x.org"


@pytest.mark.parametrize(("text", "want"), [
    ("Sat, 26 Jul 2026 08:00:00 GMT", dt.datetime(2026, 7, 26, 8)), ("Mon, 03 Aug 2026 08:00:00 +0800", dt.datetime(2026, 8, 3)), ("2026-07-26T10:00:00+08:00", dt.datetime(2026, 7, 26, 2)),
    ("July 4, 2026", dt.datetime(2026, 7, 4)), ("nonsense", None), (None, None),
])
def test_dates(spark, text, want):
    assert one(spark, lambda c: F.date_format(D.parse(c), "yyyy-MM-dd HH:mm"), text) == (want and want.strftime("%Y-%m-%d %H:%M"))


def test_date_labels(spark):
    day = lambda c: c.cast("date")
    assert one(spark, lambda a, b: D.label(day(a), day(b)), "2026-09-07", "2026-09-07") == "今天"
    assert one(spark, lambda a, b: D.label(day(a), day(b)), "2026-09-06", "2026-09-07") == "昨天"
    assert one(spark, lambda a, b: D.label(day(a), day(b)), "2026-09-01", "2026-09-07") == "9月1日 周二"


def test_vocabulary(spark):
    v = Vocabulary((Entry("go", "go"), Entry("cc", "Claude"), Entry("mcp", "MCP", (), ("mcp server list",)), Entry("han", "折腾"), Entry("x", "bare", ("alias",), (), False)))
    found = lambda t: one(spark, v.matches, t)
    assert found("let's go.") == ["go"]
    assert found("google &go; ergo") == []
    assert found("mcp server list only") == []
    assert found("我折腾MCP") == ["mcp", "han"]
    assert found("bare") == [] and found("Alias") == ["x"]


def test_small_text_functions(spark):
    assert one(spark, T.title_key, "Hello, 世界! 42") == "hello世界42"
    assert one(spark, T.cjk_ratio, "世界ab") == 0.5
    assert one(spark, T.name_match, "The Pod!", "the pod") == 100
    assert one(spark, T.name_match, "The Long Talk", "long talk extra") == 80
    assert one(spark, T.name_match, "The Pod", "the pod cast") == 0
    assert one(spark, lambda c: T.site_from_bio(c, ["github.com"]), "see https://github.com/me and https://me.org/.") == "https://me.org/"
    assert one(spark, T.user_of_post, "https://www.cnblogs.com/Ann/p/1.html") == "ann"
    assert one(spark, T.escape_html, "<a&'\">") == "&lt;a&amp;&#39;&quot;&gt;"
    assert one(spark, T.json_island, '"</script>"') == '"\\u003c/script\\u003e"'
