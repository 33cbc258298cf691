"""Finding sources: index formats, outbound links, candidates, known and denied hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.functions import url as U
from siftloom.functions.text import name_match, site_from_bio

from .collect import first_by

#: Where a site may keep its feed, by priority: for sites that are probed, and for sources that lost theirs.
FEED_PATHS = ("feed", "rss", "atom.xml", "index.xml", "feed.xml", "rss.xml", "feed/", "rss/", "feeds/posts/default", "blog/feed", "posts/index.xml")
SOURCE_PATHS = ("feed", "rss", "rss.xml", "feed.xml", "atom.xml", "index.xml", "feed/")
#: An address that looks like a feed; addresses in a text that are nobody's feed.
FEED_LIKE = "(?i)/(feed|rss|atom)(\\.(xml|json))?/?$|\\.(xml|atom)$|/feed/|/rss/"
NO_FEED = "(?i)github\\.com|githubusercontent|w3\\.org|example\\."
#: Hosts that are platforms, shops and tools, nobody's blog.
PLATFORMS = (
    "(?i)(^|\\.)(github|githubusercontent|gitee|gitlab|twitter|x|zhihu|juejin|csdn|cnblogs|segmentfault|oschina|bilibili|weibo|douban|jianshu|medium|substack|youtube|youtu|wikipedia|apple|google|microsoft|baidu|jd|taobao|tmall|amazon|"
    "instagram|facebook|linkedin|telegram|discord|npmjs|w3|mozilla|vercel|netlify|cloudflare|notion|figma|okjike|okjk|xiaoyuzhoufm|ximalaya|visualstudio|gohugo|astro|hexo|wordpress|typora|16personalities|openart|gaoding)\\.[a-z.]+$"
)
#: Where a page of links to friends may be, and what links to it say.
LINK_PATHS = ("links", "links/", "friends", "friends/", "link", "link/", "friend", "friend/", "links.html", "friends.html", "links/index.html", "blogroll", "blogroll/", "sites", "sites/")
LINK_ANCHOR = "(?i)友链|友情链接|朋友们|友情連結|友站|朋友們|部落格連結|部落卷|部落滾|部落滚|link exchange|blogroll"
#: Addresses of search results, which have no feed, and the reasons why a source has none.
UNDISCOVERABLE = "weixin\\.sogou\\.com|zhihu\\.com/search"
REASONS = {"search": "链接指向搜索结果页，不是内容站点，没有可用 feed", "channel": "无法从 YouTube 频道页解析出 channelId", "nothing": "试遍常见 feed 路径均未找到可用 feed"}


def _blogs(rows: DataFrame, platforms: str | tuple[str, ...]) -> DataFrame:
    """Rows whose host is no platform: a pattern, or the hosts themselves."""
    if not platforms:
        return rows
    return rows.where(~F.col("host").rlike(platforms) if isinstance(platforms, str) else ~F.col("host").isin(*platforms))


def _lines(text: Column) -> Column:
    return F.split(text, "\\r?\\n")


def opml(files: DataFrame, text_col: str = "text") -> DataFrame:
    """(title, feed, site) of each outline with a feed address; the site falls back to the feed."""
    tags = files.select(F.explode(F.regexp_extract_all(text_col, F.lit("(?is)(<outline\\b[^>]*>)"), F.lit(1))).alias("t"))
    attr = lambda name: F.regexp_extract("t", f"(?is)\\b{name}=[\"']([^\"']*)[\"']", 1)
    out = tags.select(attr("text").alias("title"), attr("xmlUrl").alias("feed"), attr("htmlUrl").alias("site")).where(F.col("feed").rlike("(?i)^http"))
    return out.withColumn("site", F.when(F.col("site") == "", F.col("feed")).otherwise(F.col("site")))


def csv_index(files: DataFrame, text_col: str = "text") -> DataFrame:
    """(title, site, feed, tags) of lines after the first, split at each comma, with a feed in the third column."""
    rows = files.select(F.posexplode(F.split(text_col, "\n")).alias("n", "line")).where("n > 0").select(F.transform(F.split("line", ","), lambda x: F.regexp_replace(x, "^\\s+|\\s+$", "")).alias("c"))
    rows = rows.where((F.size("c") >= 3) & F.startswith(F.get("c", 2), F.lit("http")))
    return rows.select(F.get("c", 0).alias("title"), F.get("c", 1).alias("site"), F.get("c", 2).alias("feed"), F.array_join(F.slice("c", F.lit(4), F.size("c")), ",").alias("tags"))


def markdown_feeds(files: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct addresses in a text that look like feeds, without the one punctuation mark at their end."""
    urls = files.select(F.explode(F.regexp_extract_all(text_col, F.lit("(https?://[^\\s\"'<>)\\]]+)"), F.lit(1))).alias("u")).select(F.regexp_replace("u", "[.,;]$", "").alias("feed"))
    return urls.where(F.col("feed").rlike(FEED_LIKE) & ~F.col("feed").rlike(NO_FEED)).distinct()


def markdown_table(files: DataFrame, tag: str, deny: str, text_col: str = "text") -> DataFrame:
    """The table lines that hold a tag as a word of their own and not another word, whatever its case."""
    lines = files.select(F.explode(_lines(F.col(text_col))).alias("line"))
    return lines.where(F.startswith("line", F.lit("|")) & F.col("line").rlike(f"(^|[ ,|]){tag}([ ,|]|$)") & ~F.contains(F.lower("line"), F.lit(deny)))


def site_list(files: DataFrame, platforms: str | tuple[str, ...] = PLATFORMS, text_col: str = "text") -> DataFrame:
    """(host, origin, feed): the first address of each host that is no platform, and its first address that looks like a feed."""
    urls = files.select(F.posexplode(F.regexp_extract_all(text_col, F.lit("(https?://[^\\s\"'<>)\\]]+)"), F.lit(1))).alias("pos", "u")).select("pos", F.regexp_replace("u", "[.,;、）]+$", "").alias("u"))
    rows = _blogs(urls.select("pos", "u", U.host(F.col("u")).alias("host")).where("host is not null"), platforms)
    feed = F.when(F.col("u").rlike(FEED_LIKE), F.col("u"))
    return rows.groupBy("host").agg(F.min_by(U.origin(F.col("u")), "pos").alias("origin"), F.min_by(feed, F.when(feed.isNotNull(), F.col("pos"))).alias("feed"))


def domain_list(files: DataFrame, platforms: str | tuple[str, ...] = PLATFORMS, text_col: str = "text") -> DataFrame:
    """(host, name, origin) of a JSON array of {blogName, domainName}, bare domains mostly, first of each; a text that isn't JSON gives none."""
    rows = files.select(F.posexplode(F.from_json(text_col, "array<struct<blogName:string,domainName:string>>")).alias("pos", "d")).where("trim(d.domainName) <> ''")
    rows = rows.select("pos", F.coalesce("d.blogName", F.lit("")).alias("name"), F.concat(F.lit("https://"), F.regexp_replace(F.trim("d.domainName"), "^https?://", "")).alias("u"))
    rows = _blogs(rows.withColumn("host", U.host(F.col("u"))).where("host is not null and host <> ''"), platforms)
    return rows.groupBy("host").agg(F.min_by("name", "pos").alias("name"), F.min_by(U.origin(F.col("u")), "pos").alias("origin"))


def outbound(pages: DataFrame, platforms: str | tuple[str, ...] = (), keys: tuple[str, ...] = ()) -> DataFrame:
    """(seed, host, origin, *keys) of links from pages (url, html, *keys) to other hosts, no parts of the own; first origin of each."""
    links = pages.select(U.host(F.col("url")).alias("seed"), *keys, F.posexplode(F.regexp_extract_all("html", F.lit("(?is)<a\\b[^>]*href=[\"'](https?://[^\"']+)[\"'][^>]*>"), F.lit(1))).alias("pos", "link"))
    rows = links.select("seed", *keys, "pos", U.host(F.col("link")).alias("host"), U.origin(F.col("link")).alias("origin")).where("host is not null and host <> seed")
    rows = _blogs(rows.where(~F.endswith("host", F.concat(F.lit("."), F.col("seed"))) & ~F.endswith("seed", F.concat(F.lit("."), F.col("host")))), platforms)
    return rows.groupBy("seed", "host", *keys).agg(F.min_by("origin", "pos").alias("origin"))


def declared_feeds(html: Column, base: Column) -> Column:
    """Addresses of alternate links of type RSS or Atom, in order, each once; values may be bare."""
    tags = F.regexp_extract_all(html, F.lit("(?is)(<link\\b[^>]*>)"), F.lit(1))
    feeds = F.filter(tags, lambda t: t.rlike("(?i)rel=[\"']?[^\"'>]*alternate") & t.rlike("(?i)type=[\"']?application/(rss|atom)\\+xml[\"'\\s>]"))
    href = lambda t: F.coalesce(F.nullif(F.regexp_extract(t, "(?i)href=[\"']([^\"']+)[\"']", 1), F.lit("")), F.regexp_extract(t, "(?i)href=([^\\s\"'>]+)", 1))
    return F.array_distinct(F.transform(F.filter(F.transform(feeds, href), lambda h: h != ""), lambda h: U.resolve(h, base)))


def candidate_feeds(url: Column, paths: tuple[str, ...] = FEED_PATHS) -> Column:
    """Where a site's feed may be: below the address, then below its origin."""
    base, origin = F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "/$", ""), U.origin(url)
    return F.array_distinct(F.concat(*[F.array(*[F.concat(b, F.lit(f"/{p}")) for p in paths]) for b in (base, origin)]))


def youtube_channel(html: Column) -> Column:
    """A channel's id by the first of three patterns that fits."""
    patterns = ('itemprop="identifier"\\s+content="(UC[\\w-]{20,})"', '"externalId"\\s*:\\s*"(UC[\\w-]{20,})"', "channel/(UC[\\w-]{20,})")
    return F.coalesce(*[F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in patterns])


def series_ids(html: Column, pattern: str = "/users/\\d+/ironman/(\\d{3,6})\\b") -> Column:
    return F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)))


def has_next(html: Column, page: Column) -> Column:
    """Whether a listing links to the page after this one."""
    return F.array_contains(F.regexp_extract_all(html, F.lit("signup/list\\?group=[^\"']*(?:&|&amp;)page=(\\d+)\\b"), F.lit(1)), (page + 1).cast("string"))


def series_scan(pages: DataFrame, most: int = 12) -> tuple[DataFrame, DataFrame]:
    """(group, id) in the order of pages, and (group, page, n, error) of each page that counts.

    pages: group, page from 1, html, error (null if it came). A group ends at the first page that failed, has no id, or has no
    next page. A page without ids that has a next page is an error: not the end, but something that can't be read.
    """
    seen = pages.where((F.col("page") >= 1) & (F.col("page") <= most)).select("group", "page", "error", series_ids(F.coalesce("html", F.lit(""))).alias("ids"), has_next(F.coalesce("html", F.lit("")), F.col("page")).alias("next"))
    seen = seen.withColumn("ends", F.col("error").isNotNull() | (F.size("ids") == 0) | ~F.col("next"))
    last = seen.groupBy("group").agg(F.min(F.when(F.col("ends"), F.col("page"))).alias("last"))
    seen = seen.join(last, "group").where(F.col("last").isNull() | (F.col("page") <= F.col("last")))
    broken = F.when((F.size("ids") == 0) & F.col("next"), "no ids, but a next page")
    ids = seen.where("error is null").select("group", "page", F.posexplode("ids").alias("pos", "id")).groupBy("group", "id").agg(F.min(F.struct("page", "pos")).alias("at"))
    return ids.select("group", "id", "at.page", "at.pos"), seen.select("group", "page", F.when(F.col("error").isNull(), F.size("ids")).alias("n"), F.coalesce("error", broken).alias("error"))


def first_verified(candidates: DataFrame, key: str = "site", ok: str = "verified", order: str = "priority") -> DataFrame:
    """Of each site the first candidate that was verified, with the trail of all that were tried before it."""
    first = candidates.where(F.col(ok)).groupBy(key).agg(F.min(order).alias("_at"), F.min_by("url", order).alias("_url"))
    trail = candidates.join(first, key, "left").where(F.col("_at").isNull() | (F.col(order) <= F.col("_at")))
    tried = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("url").alias("u")))), lambda s: s["u"]), " ")
    return trail.groupBy(key).agg(F.max("_url").alias("url"), tried.alias("tried"))


def blogroll_candidates(homes: DataFrame) -> DataFrame:
    """(seed, ord, page): where homes (url, html) may keep a page of links: what its own links call so, then the usual paths."""
    anchors = F.regexp_extract_all("html", F.lit("(?is)(<a\\b[^>]*href=[\"'][^\"']+[\"'][^>]*>.{0,80}?</a>)"), F.lit(1))
    href = lambda t: F.regexp_extract(t, "(?is)href=[\"']([^\"']+)[\"']", 1)
    said = F.filter(F.coalesce(anchors, F.array().cast("array<string>")), lambda t: href(t).rlike(LINK_ANCHOR) | F.regexp_extract(t, "(?is)>(.*)</a>$", 1).rlike(LINK_ANCHOR))
    own = F.filter(F.transform(said, lambda t: U.resolve(href(t), F.col("url"))), lambda u: U.host(u) == U.host(F.col("url")))
    usual = F.array(*[F.concat(F.regexp_replace("url", "/?$", "/"), F.lit(p)) for p in LINK_PATHS])
    return homes.select(U.host(F.col("url")).alias("seed"), F.posexplode(F.array_distinct(F.concat(own, usual))).alias("ord", "page"))


def blogroll_pages(pages: DataFrame, least: int = 3, most: int = 2) -> DataFrame:
    """Of each seed the first pages (seed, ord, hosts) with enough outbound hosts."""
    return pages.where(F.col("hosts") >= least).withColumn("_rn", F.expr("row_number() over (partition by seed order by ord)")).where(F.col("_rn") <= most).drop("_rn")


def blogroll_hits(homes: DataFrame, fetched: DataFrame, platforms: str | tuple[str, ...] = (), least: int = 3, most: int = 2) -> DataFrame:
    """(seed, host, origin): what the pages of links of homes (url, html) link to, by the fetched pages (page, html) there are."""
    pages = blogroll_candidates(homes).join(fetched, "page").select("seed", "ord", F.col("page").alias("url"), "html")
    links = outbound(pages, platforms, ("ord",))
    used = blogroll_pages(links.groupBy("seed", "ord").agg(F.count("*").alias("hosts")), least, most)
    return links.join(used.select("seed", "ord"), ["seed", "ord"]).groupBy("seed", "host").agg(F.min_by("origin", "ord").alias("origin"))


def discover(sources: DataFrame, fetched: DataFrame, verified: DataFrame, podcasts: DataFrame) -> DataFrame:
    """(name, feed, enabled, disabled_reason) of sources (name, url, type, feed, adapter), by the first way that gives a feed.

    An adapter's feed and a feed that still works stay. Search result pages have none. A channel page gives its channel's feed or
    nothing. Then come a podcast's feed in a directory, what the page declares first, and the usual places. fetched: (url, html) of
    pages; verified: (feed) of addresses that gave entries; podcasts: (name, feed) found in a directory and verified.
    """
    rows = sources.join(fetched.select("url", "html"), "url", "left").join(podcasts.select("name", F.col("feed").alias("podcast")), "name", "left")
    channel = F.col("url").rlike("youtube\\.com/@")
    of_channel = F.concat(F.lit("https://www.youtube.com/feeds/videos.xml?channel_id="), youtube_channel(F.col("html")))
    asked = (F.col("type") == "podcast") | F.col("url").rlike("podcasts\\.apple\\.com/.*search\\?.*term=")
    declared = F.get(declared_feeds(F.col("html"), F.col("url")), 0)
    ways = F.when(channel, F.array(of_channel)).otherwise(F.concat(F.array(F.when(asked, F.col("podcast")), declared), candidate_feeds(F.col("url"), SOURCE_PATHS)))
    ways = F.when(F.col("url").rlike(UNDISCOVERABLE), F.array().cast("array<string>")).otherwise(ways)
    tried = rows.select("name", F.posexplode(F.concat(F.array("feed"), ways)).alias("ord", "feed")).where("feed is not null").join(verified.select("feed").distinct(), "feed", "left_semi")
    best = tried.groupBy("name").agg(F.min_by("feed", "ord").alias("found"))
    kept = F.when(F.col("adapter").isNotNull(), F.col("feed"))
    reason = F.when(F.col("url").rlike(UNDISCOVERABLE), REASONS["search"]).when(channel & youtube_channel(F.coalesce("html", F.lit(""))).isNull(), REASONS["channel"]).otherwise(REASONS["nothing"])
    out = rows.join(best, "name", "left").withColumn("found", F.coalesce(kept, "found"))
    return out.select("name", F.col("found").alias("feed"), F.col("found").isNotNull().alias("enabled"), F.when(F.col("found").isNull(), reason).alias("disabled_reason"))


def merge_sources(known: DataFrame, new: DataFrame) -> DataFrame:
    """known and the new sources (name, url, feed, ord) whose feed and host none of them has, first of each host."""
    fresh = new.withColumn("host", U.host(F.col("url"))).join(known.select("feed").where("feed is not null").distinct(), "feed", "left_anti")
    fresh = fresh.join(known_hosts(known), "host", "left_anti")
    return known.select("name", "url", "feed").unionByName(first_by(first_by(fresh, ["feed"], "ord"), ["host"], "ord").select("name", "url", "feed"))


def denied_hosts(denylist: DataFrame) -> DataFrame:
    """Hosts that are denied as a whole, under whichever key they were written."""
    return denylist.where(F.coalesce("scope", F.lit("")) != "feed").select(U.host(F.coalesce("feed", "url", "domain")).alias("host")).where("host is not null").distinct()


def known_hosts(*parts: DataFrame) -> DataFrame:
    """Hosts of any table with a url column."""
    out = None
    for p in parts:
        h = p.select(U.host(F.col("url")).alias("host"))
        out = h if out is None else out.unionByName(h)
    return out.where("host is not null").distinct()


def new_hosts(candidates: DataFrame, known: list[DataFrame], ord_col: str = "ord") -> DataFrame:
    """The first candidate of each host that no known table has."""
    out = candidates
    for k in known:
        out = out.join(k.select("host").distinct(), "host", "left_anti")
    return first_by(out, ["host"], ord_col)


def handled_users(subscribed: DataFrame, denied: DataFrame) -> DataFrame:
    """Users, in lower case, that are subscribed or denied; * if the whole host is denied."""
    own = subscribed.select(F.lower("user").alias("user"))
    off = denied.select(F.when(F.col("user").isNull(), F.lit("*")).otherwise(F.lower("user")).alias("user"))
    return own.unionByName(off).where("user is not null").distinct()


def podcast_feed(sources: DataFrame, listings: DataFrame, verified: DataFrame, least: int = 60) -> DataFrame:
    """(name, feed): of each source the verified feed whose name in a directory is most alike, if it is alike enough.

    sources: name. listings: name (the source looked up), country, pos, title, feed. verified: feed.
    """
    rated = sources.select("name").join(listings.where("feed is not null"), "name").withColumn("score", name_match(F.col("name"), F.col("title"))).where(F.col("score") >= least)
    good = rated.join(verified.select("feed").distinct(), "feed", "left_semi")
    return first_by(good, ["name"], F.desc("score"), "country", "pos").select("name", "feed", "score")


def site_by_search(searches: DataFrame, profiles: DataFrame, most: int = 3) -> DataFrame:
    """(author, outcome, site): an author's site by searching for titles and then asking for the profile of the user found.

    searches: author, ord, error, user_name, user_id (a row for each result, or one with an error). profiles: user_id, error, site. Only the first
    most searches count. All of them failed: failed, and nothing is to be written. No user of that name: pending. A profile that failed: failed.
    """
    g = searches.where(F.col("ord") < most).groupBy("author").agg(
        F.bool_and(F.col("error").isNotNull()).alias("dead"), F.min_by("user_id", F.when((F.col("user_name") == F.col("author")) & F.col("user_id").isNotNull(), F.col("ord"))).alias("user_id")
    )
    got = g.join(profiles.select("user_id", F.col("error").alias("bad"), "site", F.lit(True).alias("asked")), "user_id", "left")
    outcome = F.when(F.col("user_id").isNull() & F.col("dead"), "failed").when(F.col("user_id").isNull(), "pending").when(F.col("asked").isNull() | F.col("bad").isNotNull(), "failed").otherwise("found")
    return got.select("author", outcome.alias("outcome"), F.when(outcome == "found", F.nullif("site", F.lit(""))).alias("site"))


def site_by_name(members: DataFrame, platforms: list[str]) -> DataFrame:
    """(author, outcome, site): an author's site by a profile (author, status, website, bio); 404 is an answer, other errors aren't. The bio
    is read if the profile names no site."""
    named = F.nullif(F.trim(F.coalesce("website", F.lit(""))), F.lit(""))
    ok = F.col("status").isin(200, 404)
    return members.select("author", F.when(ok, "found").otherwise("failed").alias("outcome"), F.when(F.col("status") == 200, F.coalesce(named, site_from_bio(F.col("bio"), platforms))).alias("site"))
