"""Queries over raw web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftloom.functions import text as T
from siftloom.functions import url as U
from siftloom.operators import collect, views

from .registry import query, texts

WHITE = "[\\t\\n\\x0B\\f\\r \\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+"


def sql_canonical(url: str, source: str) -> str:
    """A CTE chain that ends in canon(all columns of source, canonical). Written for addresses without users, dots and odd characters in their paths."""
    form = lambda x: f"replace(replace(replace(url_encode(url_decode({x})), '%20', '+'), '%2A', '*'), '~', '%7E')"
    return f"""
    p0 AS (SELECT *, lower(split_part({url}, '://', 1)) AS scheme, split_part(split_part({url}, '://', 2), '#', 1) AS bare FROM {source}),
    p1 AS (SELECT *, regexp_replace(lower(split_part(split_part(bare, '?', 1), '/', 1)), '^www\\.', '') AS authority, substr(split_part(bare, '?', 1), strpos(split_part(bare, '?', 1) || '/', '/')) AS path0, substr(bare, strpos(bare || '?', '?') + 1) AS cquery FROM p0),
    p2 AS (SELECT *, split_part(authority, ':', 1) || CASE WHEN split_part(authority, ':', 2) IN ('', '443', CASE WHEN scheme = 'http' THEN '80' ELSE '' END) THEN '' ELSE ':' || split_part(authority, ':', 2) END AS chost,
             CASE WHEN path0 IN ('', '/') THEN '/' WHEN suffix(path0, '/') THEN left(path0, length(path0) - 1) ELSE path0 END AS cpath, list_filter(string_split(cquery, '&'), lambda p: p <> '') AS prs FROM p1),
    p3 AS (SELECT *, list_filter(list_transform(range(1, len(prs) + 1), lambda i: {{'k': {form("split_part(prs[i], '=', 1)")}, 'i': i, 'v': {form("substr(prs[i], strpos(prs[i] || '=', '=') + 1)")}}}), lambda s: NOT (lower(s.k) LIKE 'utm\\_%' ESCAPE '\\' OR lower(s.k) IN ('ref', 'sc', 'spm'))) AS ps FROM p2),
    canon AS (SELECT *, CASE WHEN scheme NOT IN ('http', 'https') THEN {url} ELSE 'https://' || chost || cpath || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(list_transform(list_sort(ps), lambda s: s.k || '=' || s.v), '&') ELSE '' END END AS canonical FROM p3)"""


def sql_entities(x: str) -> str:
    """One pass: a text is cut into entities and what stands between, and each entity is replaced."""
    named = "|".join(T.ENTITIES)
    cases = " ".join(f"WHEN t = '&{name};' THEN '{char.replace(chr(39), chr(39) * 2)}'" for name, char in T.ENTITIES.items())
    numeric = "WHEN regexp_matches(t, '^&#[0-9]+;$') THEN chr(t[3:-2]::INTEGER)"
    return f"array_to_string(list_transform(regexp_extract_all({x}, '&(?:{named}|#[0-9]+);|[^&]+|&'), lambda t: CASE {cases} {numeric} ELSE t END), '')"


def sql_tags(x: str) -> str:
    return f"regexp_replace({x}, '<[a-zA-Z!/?](?:[^\"''>]|\"[^\"]*\"|''[^'']*'')*>', ' ', 'g')"


def sql_text(html: str, source: str, limit: int | None = 2000, name: str = "plain") -> str:
    """A CTE chain that ends in name(all columns of source, body)."""
    cut = "body0" if limit is None else f"substr(body0, 1, {limit})"
    return f"""
    {name}1 AS (SELECT *, {sql_entities(sql_tags(f"regexp_replace(regexp_replace(regexp_replace(coalesce({html}, ''), '(?is)<script\\b[^>]*>.*?</script>', '', 'g'), '(?is)<style\\b[^>]*>.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g')"))} AS bare0 FROM {source}),
    {name}2 AS (SELECT *, trim(regexp_replace(CASE WHEN regexp_matches(bare0, '</[a-zA-Z][a-zA-Z0-9]*\\s*>') THEN {sql_tags('bare0')} ELSE bare0 END, '{WHITE}', ' ', 'g')) AS body0 FROM {name}1),
    {name} AS (SELECT *, {cut} AS body FROM {name}2)"""


def sql_article(html: str) -> str:
    x = f"coalesce({html}, '')"
    for tag in T.NOISE:
        x = f"regexp_replace({x}, '(?is)<{tag}\\b[^>]*>.*?</{tag}>', '', 'g')"
    return x


ARTICLE = f"""
    quiet AS (SELECT page_id, url, {sql_article('html')} AS q FROM pages),
    art AS (SELECT page_id, url, CASE WHEN regexp_matches(q, '(?is)<article\\b[^>]*>.*</article>') THEN regexp_extract(q, '(?is)<article\\b[^>]*>(.*)</article>', 1)
        WHEN regexp_matches(q, '(?is)<main\\b[^>]*>.*</main>') THEN regexp_extract(q, '(?is)<main\\b[^>]*>(.*)</main>', 1)
        WHEN regexp_matches(q, '(?is)<body\\b[^>]*>.*</body>') THEN regexp_extract(q, '(?is)<body\\b[^>]*>(.*)</body>', 1) ELSE q END AS art FROM quiet)"""


@query(f"WITH {sql_canonical('url', 'pages')} SELECT page_id, canonical, substr(sha256(canonical), 1, 16) AS item_id FROM canon")
def page_item_id(spark, sf_dir):
    return texts(spark, sf_dir, "pages").select("page_id", U.canonical(F.col("url")).alias("canonical"), U.item_id(F.col("url")).alias("item_id"))


@query(f"WITH {sql_canonical('url', 'pages')} SELECT canonical, min(page_id) AS page_id, count(*) AS copies FROM canon GROUP BY canonical")
def page_canonical_dedupe(spark, sf_dir):
    return texts(spark, sf_dir, "pages").groupBy(U.canonical(F.col("url")).alias("canonical")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("copies"))


@query(f"WITH {sql_text('html', 'pages')} SELECT page_id, body AS text, length(body) AS n_chars FROM plain")
def html_to_text(spark, sf_dir):
    return texts(spark, sf_dir, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


@query(f"SELECT page_id, length({sql_article('html')}) AS n_chars, sha256({sql_article('html')}) AS digest FROM pages")
def noise_stripped(spark, sf_dir):
    q = T.strip_noise(F.coalesce("html", F.lit("")))
    return texts(spark, sf_dir, "pages").select("page_id", q.alias("q")).select("page_id", F.char_length("q").cast("long").alias("n_chars"), F.sha2("q", 256).alias("digest"))


@query(f"WITH {ARTICLE}, {sql_text('art', 'art')} SELECT page_id, body AS text FROM plain")
def article_extract(spark, sf_dir):
    return texts(spark, sf_dir, "pages").select("page_id", T.article_text(F.col("html")).alias("text"))


@query(f"WITH {ARTICLE}, {sql_text('art', 'art', None)} SELECT page_id, substr(body, 1, 300) AS excerpt, CASE WHEN length(body) > 300 THEN right(body, 100) ELSE '' END AS tail FROM plain")
def excerpt_tail(spark, sf_dir):
    whole = texts(spark, sf_dir, "pages").select("page_id", T.article_text(F.col("html"), None).alias("body"))
    return whole.select("page_id", F.substring("body", 1, 300).alias("excerpt"), T.article_tail(F.col("body"), 300, 100).alias("tail"))


@query("SELECT regexp_replace(lower(regexp_extract(url, '^(?i:https?)://([^/?#:]+)', 1)), '^www\\.', '') AS host, count(*) AS pages FROM pages GROUP BY 1")
def page_host_counts(spark, sf_dir):
    return texts(spark, sf_dir, "pages").groupBy(U.host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"))


@query(f"""WITH {ARTICLE}, {sql_text('art', 'art')}, {sql_canonical('url', 'plain')},
    firsts AS (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY page_id) AS rn FROM canon)
    SELECT split_part(chost, ':', 1) AS host, count(*) AS pages, sum(CASE WHEN length(body) < 250 THEN 1 ELSE 0 END)::BIGINT AS thin, min(substr(sha256(canonical), 1, 16)) AS first_id FROM firsts WHERE rn = 1 GROUP BY 1""")
def page_digest(spark, sf_dir):
    """Flagship: canonical address, id, article text, first of each id, then counts by host."""
    first = collect.first_by(texts(spark, sf_dir, "pages").withColumn("canonical", U.canonical(F.col("url"))), ["canonical"], "page_id")
    first = first.select(T.thin(T.article_text(F.col("html"))).alias("thin"), F.substring(F.sha2("canonical", 256), 1, 16).alias("id"), F.regexp_extract("canonical", "^https://([^/?:]+)", 1).alias("host"))
    return first.groupBy("host").agg(F.count("*").alias("pages"), F.sum(F.col("thin").cast("long")).alias("thin"), F.min("id").alias("first_id"))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '(?i)^https?:') THEN url ELSE '#' END AS safe, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM pages")
def safe_links(spark, sf_dir):
    return texts(spark, sf_dir, "pages").select("page_id", T.safe_url(F.col("url")).alias("safe"), T.escape_html(F.col("url")).alias("escaped"))


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, length(regexp_extract_all(html, '(?i)<p\\b')) AS paragraphs FROM pages")
def page_meta(spark, sf_dir):
    title = F.trim(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1))
    return texts(spark, sf_dir, "pages").select("page_id", title.alias("title"), F.regexp_count("html", F.lit("(?i)<p\\b")).cast("long").alias("paragraphs"))


@query("""WITH known AS (SELECT DISTINCT regexp_replace(lower(regexp_extract(url, '^(?i:https?)://([^/?#:]+)', 1)), '^www\\.', '') AS host FROM pages WHERE regexp_matches(url, '(?i)^http:')),
    cand AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^(?i:https?)://([^/?#:]+)', 1)), '^www\\.', '') AS host FROM pages)
    SELECT host, min(page_id) AS page_id FROM cand WHERE host NOT IN (SELECT host FROM known) GROUP BY host""")
def exclude_known_hosts(spark, sf_dir):
    from siftloom.operators import discovery

    pages = texts(spark, sf_dir, "pages").select("page_id", "url", U.host(F.col("url")).alias("host"))
    known = pages.where(F.col("url").rlike("(?i)^http:")).select("host")
    return discovery.new_hosts(pages, [known], "page_id").select("host", "page_id")
