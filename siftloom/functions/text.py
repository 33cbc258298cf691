"""Text and HTML functions: Column in, Column out, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers' regular expressions see it; Java's \s is ASCII only.
WHITE = "[\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]+"
HAN = "[\\u4E00-\\u9FFF\\u3400-\\u4DBF]"
#: Named entities that are decoded.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "mdash": "—", "ndash": "–", "hellip": "…",
    "rsquo": "’", "lsquo": "‘", "ldquo": "“", "rdquo": "”",
}
NOISE = ("script", "style", "nav", "header", "footer", "aside", "form", "noscript")
_ENTITY = f"&(?:{'|'.join(ENTITIES)}|#\\d+|#x[0-9a-fA-F]+);"


def let(value: Column, body) -> Column:
    """body(value), with value computed once for a row however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _character(name: Column) -> Column:
    """What the entity of a name stands for; null for a number that is no character."""
    code = F.when(F.startswith(name, F.lit("#x")), F.conv(F.substring(name, 3, 20), 16, 10).try_cast("long")).otherwise(F.substring(name, 2, 20).try_cast("long"))
    good = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    numeric = F.when(good, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    known = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])
    return F.when(F.startswith(name, F.lit("#")), numeric).otherwise(F.element_at(known, name))


def decode_entities(text: Column) -> Column:
    """13 named entities and all numeric ones in one pass, so that what decoding makes is never decoded again. A number that is no
    character stays as it is."""

    def one(part: Column) -> Column:
        whole = F.regexp_extract(part, f"^{_ENTITY}", 0)
        char = lambda e: F.when(e == "", part).otherwise(F.concat(F.coalesce(_character(F.substring(e, F.lit(2), F.length(e) - 2)), e), F.substring(part, F.length(e) + 1, F.length(part))))
        return let(whole, char)

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(F.split(text, f"(?={_ENTITY})"), one), "")).otherwise(text)


def strip_tags(html: Column) -> Column:
    """Each tag becomes a space. A tag begins with < before a letter, !, / or ?, and ends at the first > outside quotes."""
    return F.regexp_replace(html, "<(?=[a-zA-Z!/?])(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+>", " ")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, WHITE, " "))


def html_to_text(html: Column, limit: int | None = 2000) -> Column:
    """Visible text of HTML, cut to limit code points. Markup that was escaped is stripped once more, but not decoded again."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), "(?is)<(script|style)\\b[^>]*>.*?</\\1>", "")
    bare = F.regexp_replace(bare, "(?s)<!--.*?-->", "")
    marked = lambda x: F.when(x.rlike("</[a-zA-Z][a-zA-Z0-9]*\\s*>"), strip_tags(x)).otherwise(x)
    text = collapse(let(decode_entities(strip_tags(bare)), marked))
    return text if limit is None else F.substring(text, 1, limit)


def strip_noise(html: Column) -> Column:
    """Without scripts, styles, navigation, headers, footers, asides and forms; what stood around them meets."""
    return F.regexp_replace(html, f"(?is)<({'|'.join(NOISE)})\\b[^>]*>.*?</\\1>", "")


def extract_tag(html: Column, tag: str) -> Column:
    """From the first opening to the last closing tag; null without both."""
    found = F.regexp_extract(html, f"(?is)<{tag}\\b[^>]*>(.*)</{tag}>", 1)
    return F.when(html.rlike(f"(?is)<{tag}\\b[^>]*>.*</{tag}>"), found)


def article_html(html: Column) -> Column:
    clean = strip_noise(F.coalesce(html, F.lit("")))
    return F.coalesce(extract_tag(clean, "article"), extract_tag(clean, "main"), extract_tag(clean, "body"), clean)


def article_text(html: Column, limit: int | None = 2000) -> Column:
    return html_to_text(article_html(html), limit)


def article_tail(text: Column, limit: int = 2000, tail: int = 400) -> Column:
    """The last code points of a text that was cut; empty if nothing was cut. Takes the uncut text."""
    return F.when(F.char_length(text) > limit, F.substring(text, -tail, tail)).otherwise(F.lit(""))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return F.char_length(text) + F.when(F.octet_length(text) > F.char_length(text), F.regexp_count(text, F.lit("[\\x{10000}-\\x{10FFFF}]"))).otherwise(0)


def cjk_ratio(text: Column) -> Column:
    """Han characters among all that isn't white space; 0 for an empty text."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")
    return let(bare, lambda x: F.when(x == "", F.lit(0.0)).otherwise((F.char_length(x) - F.char_length(F.regexp_replace(x, HAN + "+", ""))) / utf16_length(x)))


def title_key(title: Column) -> Column:
    """A title without anything but lower-case ASCII letters, digits and Han characters."""
    return F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^0-9a-z\\u4E00-\\u9FFF\\u3400-\\u4DBF]+", "")


def hits_in_lower(low: Column, needles: list[str]) -> Column:
    """The needles that a text contains, in lower case already, in the order given."""
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(n.lower())), F.lit(n)) for n in needles])) if needles else F.array().cast("array<string>")


def hits(text: Column, needles: list[str]) -> Column:
    """The needles that a text contains, whatever their case, in the order given. A text is lower-cased once, not for each needle."""
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda low: hits_in_lower(low, needles))


def thin(text: Column, least: int = 250) -> Column:
    """Whether too little of a text is there to judge it; least is 200 for a digest of everything."""
    return utf16_length(F.coalesce(text, F.lit(""))) < least


def safe_url(url: Column) -> Column:
    """The address if it is http or https once tabs and line ends are out, else #."""
    clean = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "[\\t\\n\\r]", "")
    return F.when(clean.rlike("(?i)^https?:"), clean).otherwise(F.lit("#"))


def escape_html(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;"))
    for char, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def json_island(json: Column) -> Column:
    """JSON that may stand in a script element."""
    out = json
    for char, code in (("<", "\\u003c"), (">", "\\u003e"), (" ", "\\u2028"), (" ", "\\u2029")):
        out = F.replace(out, F.lit(char), F.lit(code))
    return out


def thread_body(url: Column, html: Column, host: str, css_class: str = "topic_content") -> Column:
    """The post of a forum page, up to where its block and the one around it end: '' if the block is missing, null for pages of
    other hosts."""
    found = F.regexp_extract(html, f'(?s)<div class="{css_class}">(.*?)</div>\\s*</div>', 1)
    own = "(^|\\.)" + host.replace(".", "\\.") + "$"
    return F.when(F.lower(F.try_parse_url(url, F.lit("HOST"))).rlike(own), found)


def looks_like_audio(xml: Column) -> Column:
    return xml.rlike("(?i)<enclosure[^>]+type=[\"']audio/|<itunes:")


def site_from_bio(bio: Column, platforms: list[str]) -> Column:
    """The first address in a profile that isn't on a platform: characters that addresses have only, without punctuation at its end."""
    found = F.regexp_extract_all(F.coalesce(bio, F.lit("")), F.lit("(https?://[A-Za-z0-9\\-._~:/?#\\[\\]@!$&'()*+,;=%]+)"), F.lit(1))
    bare = F.transform(found, lambda u: F.regexp_replace(u, "[.,;:!?)\\]]+$", ""))
    known = "|".join(p.replace(".", "\\.") for p in platforms) or "(?!)"
    return F.get(F.filter(bare, lambda u: ~u.rlike(f"(?i)^https?://([^/]*\\.)?({known})(/|$)")), 0)


def user_of_post(url: Column, reserved: tuple[str, ...] = ("p", "archive", "tag", "category", "news")) -> Column:
    """The author in /<user>/p/... or /<user>/archive/...; null for reserved words and other addresses."""
    path = F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/")
    user = F.lower(F.get(path, 1))
    return F.when(F.get(path, 2).isin("p", "archive") & ~user.isin(*reserved) & (user != ""), user)


def name_match(source: Column, listed: Column, least: int = 5) -> Column:
    """How alike a podcast's names are: 100 equal, 80 one begins the other and both have least characters, 60 the listed one holds the
    source's, else 0. Case, punctuation and the words podcast, the and show don't count."""
    bare = lambda c: F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "\\b(?:podcast|the|show)\\b", ""), "[^\\p{L}\\p{N}]+", "")
    x, y = bare(source), bare(listed)
    return (
        F.when((x == "") | (y == ""), 0).when(x == y, 100)
        .when((F.least(F.length(x), F.length(y)) >= least) & (F.startswith(x, y) | F.startswith(y, x)), 80).when((F.length(x) >= least) & F.contains(y, x), 60).otherwise(0)
    )


def badges(brief: Column, is_thin: Column) -> Column:
    return F.array_compact(F.array(F.when(brief, F.lit("brief")), F.when(is_thin, F.lit("thin"))))


def source_state(failures: Column) -> Column:
    return F.when(F.coalesce(failures, F.lit(0)) == 0, "ok").when(failures < 7, "shaky").otherwise("dead")
