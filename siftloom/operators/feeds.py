"""Feeds: RSS 2.0, Atom and RSS 1.0 payloads to entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.functions.dates import parse
from siftloom.functions.text import decode_entities

_ITEM = "struct<title:string,link:string,pubDate:string,`dc:date`:string,description:string,`content:encoded`:string,guid:string,enclosure:array<struct<_url:string>>>"
_ENTRY = "struct<title:string,link:array<struct<_href:string,_rel:string>>,published:string,updated:string,content:string,summary:string,`media:group`:struct<`media:description`:string>>"
SCHEMAS = {"rss": f"channel struct<item:array<{_ITEM}>>", "rdf": f"item array<{_ITEM}>", "atom": f"entry array<{_ENTRY}>"}
RAW = "array<struct<title:string,link:string,published:string,content:string>>"


def keep_entities(xml: Column) -> Column:
    """& outside CDATA becomes &amp;, so that a parser gives back what was written and bodies are decoded only once, later."""
    parts = F.split(xml, "(?=<!\\[CDATA\\[)|(?<=\\]\\]>)")
    return F.array_join(F.transform(parts, lambda p: F.when(F.startswith(p, F.lit("<![CDATA[")), p).otherwise(F.replace(p, F.lit("&"), F.lit("&amp;")))), "")


def dialect(xml: Column) -> Column:
    """rss, atom or rdf by the root element; null for anything else."""
    root = F.lower(F.regexp_extract(F.regexp_replace(xml, "(?s)<\\?.*?\\?>|<!--.*?-->|<!DOCTYPE[^>]*>", ""), "<([A-Za-z:]+)", 1))
    return F.when((root == "rss") & xml.rlike("(?i)<channel\\b"), "rss").when(root == "feed", "atom").when(root == "rdf:rdf", "rdf")


def _or(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols], F.lit(""))


def _item(x: Column) -> Column:
    guid = F.when(F.trim(x["guid"]).rlike("(?i)^https?://"), x["guid"])
    link = _or(decode_entities(x["link"]), decode_entities(F.get(x["enclosure"], 0)["_url"]), decode_entities(guid))
    return F.struct(_or(decode_entities(x["title"])).alias("title"), link.alias("link"), _or(x["pubDate"], x["dc:date"]).alias("published"), F.coalesce(F.nullif(x["content:encoded"], F.lit("")), x["description"], F.lit("")).alias("content"))


def _entry(x: Column) -> Column:
    of = lambda test: F.get(F.filter(x["link"], test), 0)["_href"]
    link = F.coalesce(of(lambda l: l["_rel"] == "alternate"), of(lambda l: l["_rel"].isNull()), F.get(x["link"], 0)["_href"])
    content = F.coalesce(F.nullif(x["content"], F.lit("")), F.nullif(x["summary"], F.lit("")), x["media:group"]["media:description"], F.lit(""))
    return F.struct(_or(decode_entities(x["title"])).alias("title"), _or(decode_entities(link)).alias("link"), _or(x["published"], x["updated"]).alias("published"), content.alias("content"))


def parse_feeds(payloads: DataFrame, body_col: str = "body") -> tuple[DataFrame, DataFrame]:
    """Entries of payloads (source, body) with ord, title, link, published_at and content_html; and (source, message) of those that are no feed.

    Dates that can't be read are null; bodies stay as written.
    """
    safe = payloads.withColumns({"_kind": dialect(F.col(body_col)), "_xml": keep_entities(F.col(body_col))})
    options = {"mode": "PERMISSIVE", "rowTag": "ROW"}
    parsed = lambda k: F.from_xml(F.when(F.col("_kind") == k, F.col("_xml")), SCHEMAS[k], options)
    rss = F.transform(parsed("rss")["channel"]["item"], _item).cast(RAW)
    rdf = F.transform(parsed("rdf")["item"], _item).cast(RAW)
    atom = F.transform(parsed("atom")["entry"], _entry).cast(RAW)
    rows = safe.where("_kind is not null").select("source", F.posexplode(F.coalesce(rss, atom, rdf)).alias("ord", "e"))
    entries = rows.select("source", "ord", "e.title", "e.link", parse(F.col("e.published")).alias("published_at"), F.col("e.content").alias("content_html"))
    errors = safe.where("_kind is null").select("source", F.lit("neither RSS nor Atom").alias("message"))
    return entries, errors
