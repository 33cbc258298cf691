"""Addresses: canonical form, stable id, host."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

_TRACKING = "(?i)^(utm_.*|ref|sc|spm)$"
_PARTS = "^(?i:(https?)):[/\\\\]*([^/\\\\?#@]*@)?([^/\\\\?#:]+)(?::(\\d*))?([^?#]*)(?:\\?([^#]*))?"
#: What an address parser writes as %XX in a path.
_PATH_ESCAPES = "[^\\x21-\\x7E]|[\"<>`{}^]"


_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
#: Full stops of other scripts, which part a host's labels too.
_STOPS = "[\u3002\uFF0E\uFF61]"


def characters(text: Column) -> Column:
    """The characters of a text that isn't empty, also those beyond the basic plane."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(text), F.lit(1))), lambda i: F.substring(text, i, F.lit(1)))


def _record(**fields: Column) -> Column:
    """A struct whose names stand in the expression itself, so they hold wherever it is put."""
    return F.named_struct(*[x for name, value in fields.items() for x in (F.lit(name), value)])


def _digits(delta: Column, bias: Column) -> Column:
    """A number as a run of base-36 digits whose weights depend on the bias; a number below 2^31 has seven at most."""

    def step(a: Column, k: Column) -> Column:
        t = F.greatest(F.lit(1), F.least(F.lit(26), F.lit(36) * k - bias)).cast("long")
        last = a["q"] < t
        digit = F.when(last, a["q"]).otherwise(t + (a["q"] - t) % (F.lit(36) - t))
        more = _record(q=F.when(last, a["q"]).otherwise(F.floor((a["q"] - t) / (F.lit(36) - t))).cast("long"), out=F.concat(a["out"], F.substring(F.lit(_DIGITS), (digit + 1).cast("int"), F.lit(1))), done=last)
        return F.when(a["done"], a).otherwise(more)

    start = _record(q=delta.cast("long"), out=F.lit(""), done=F.lit(False))
    return F.aggregate(F.sequence(F.lit(1), F.lit(7)), start, step, lambda a: a["out"])


def _adapted(delta: Column, points: Column, first: Column) -> Column:
    """The bias after a number was written."""
    halved = let(F.floor(delta / F.when(first, 700).otherwise(2)).cast("long"), lambda d: (d + F.floor(d / points)).cast("long"))
    start = lambda d: _record(d=d, k=F.lit(0).cast("long"))
    step = lambda a, _: F.when(a["d"] > 455, _record(d=F.floor(a["d"] / 35).cast("long"), k=(a["k"] + 36))).otherwise(a)
    return let(halved, lambda d: F.aggregate(F.sequence(F.lit(1), F.lit(7)), start(d), step, lambda a: (a["k"] + F.floor(36 * a["d"] / (a["d"] + 38))).cast("long")))


def punycode(label: Column) -> Column:
    """A host's label with characters beyond ASCII as RFC 3492 writes it, xn-- before it; others as they are.

    One fold over the pairs of a code point that is to be written, in ascending order, and a character of the label.
    """
    chars = F.transform(characters(label), lambda c: _record(c=c, p=F.ascii(c).cast("long")))

    def encoded(cs: Column) -> Column:
        plain = F.filter(cs, lambda x: x["p"] < 128)
        points = F.array_sort(F.array_distinct(F.transform(F.filter(cs, lambda x: x["p"] >= 128), lambda x: x["p"])))
        pairs = F.flatten(F.transform(points, lambda m: F.transform(cs, lambda x, i: _record(m=m, p=x["p"], i=i))))
        basic = F.array_join(F.transform(plain, lambda x: x["c"]), "")
        b = F.size(plain).cast("long")
        begun = _record(n=F.lit(128).cast("long"), delta=F.lit(0).cast("long"), bias=F.lit(72).cast("long"), h=b, out=F.lit(""))

        def step(a: Column, x: Column) -> Column:
            up = F.when(x["i"] == 0, a["delta"] + (x["m"] - a["n"]) * (a["h"] + 1)).otherwise(a["delta"]) + (x["p"] < x["m"]).cast("long")
            here = x["p"] == x["m"]
            wrote = let(up, lambda d: _record(n=x["m"], delta=F.when(here, F.lit(0).cast("long")).otherwise(d), bias=F.when(here, _adapted(d, a["h"] + 1, a["h"] == b)).otherwise(a["bias"]), h=(a["h"] + here.cast("long")), out=F.when(here, F.concat(a["out"], _digits(d, a["bias"]))).otherwise(a["out"])))
            # after the label's last character the next code point is the least that may come
            return F.when(x["i"] == F.size(cs) - 1, let(wrote, lambda w: _record(n=(w["n"] + 1), delta=(w["delta"] + 1), bias=w["bias"], h=w["h"], out=w["out"]))).otherwise(wrote)

        return F.concat(F.lit("xn--"), basic, F.when(b > 0, "-").otherwise(""), F.aggregate(pairs, begun, step, lambda a: a["out"]))

    return F.when(label.rlike("[^\\x00-\\x7F]"), let(chars, encoded)).otherwise(label)


def ipv4(host: Column) -> Column:
    """A host whose last label is a number, as four decimal bytes: parts may be decimal, octal after 0 or hexadecimal after 0x, and the last part fills
    the bytes that are left. Null if it is no such address."""
    number = lambda p: (
        F.when(p.rlike("(?i)^0x[0-9a-f]{0,15}$"), F.conv(F.concat(F.lit("0"), F.substring(p, 3, 20)), 16, 10)).when(p.rlike("^0[0-7]{1,20}$"), F.conv(p, 8, 10)).when(p.rlike("^(0|[1-9][0-9]{0,17})$"), p)
    ).try_cast("long")
    parts = F.transform(F.split(F.regexp_replace(host, "\\.$", ""), "\\."), number)

    def address(ps: Column) -> Column:
        n, last = F.size(ps), F.element_at(ps, -1)
        front = F.slice(ps, F.lit(1), n - 1)
        good = (n <= 4) & F.forall(front, lambda p: F.coalesce(p <= 255, F.lit(False))) & F.coalesce(last < F.pow(F.lit(256), F.lit(5) - n), F.lit(False))
        value = F.aggregate(front, F.lit(0).cast("long"), lambda a, p: a * 256 + p) * F.pow(F.lit(256), F.lit(5) - n).cast("long") + last
        return F.when(good, let(value, lambda v: F.concat_ws(".", *[(F.shiftright(v, s) % 256).cast("string") for s in (24, 16, 8, 0)])))

    return let(parts, address)


def ascii_host(host: Column) -> Column:
    """A host as an address parser writes it: lower case, labels beyond ASCII in Punycode, numbers as IPv4 addresses. Null for numbers that are none.

    Letters are taken as they are composed in the text; no other compatibility mapping is made than that of full stops.
    """
    plain = F.when(F.contains(host, F.lit("%")), F.coalesce(F.try_url_decode(F.replace(host, F.lit("+"), F.lit("%2B"))), host)).otherwise(host)
    low = F.lower(F.when(plain.rlike(_STOPS), F.regexp_replace(plain, _STOPS, ".")).otherwise(plain))
    named = F.when(low.rlike("[^\\x00-\\x7F]"), F.array_join(F.transform(F.split(low, "\\."), punycode), ".")).otherwise(low)
    return let(named, lambda h: F.when(h.rlike("(^|\\.)([0-9]+|0x[0-9a-f]*)\\.?$"), ipv4(h)).otherwise(h))


def _path(raw: Column) -> Column:
    """A path with forward slashes, without . and .. segments, escaped where it must be, and without a slash at its end but for the root."""
    slashes = F.regexp_replace(raw, "\\\\", "/")
    dotted = F.aggregate(
        F.split(F.regexp_replace(slashes, "(?<=/)(\\.{1,2})$", "$1/"), "/"), F.array().cast("array<string>"),
        lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(1)))).when(x == ".", a).otherwise(F.concat(a, F.array(x))),
        lambda a: F.array_join(a, "/"),
    )
    plain = F.when(slashes.rlike("/\\.{1,2}(/|$)"), dotted).otherwise(slashes)
    escape = lambda c: F.when(c.rlike(_PATH_ESCAPES), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c)
    escaped = let(plain, lambda p: F.when(p.rlike(_PATH_ESCAPES), F.array_join(F.transform(characters(p), escape), "")).otherwise(p))
    return let(F.when(escaped == "", F.lit("/")).otherwise(escaped), lambda p: F.when(p == "/", p).otherwise(F.regexp_replace(p, "/$", "")))


def _query(raw: Column) -> Column:
    """Parameters without the tracking ones, decoded, sorted by key and written again as forms are; equal keys keep their order."""
    plain = lambda x: F.coalesce(F.try_url_decode(x), F.replace(x, F.lit("+"), F.lit(" ")))
    pairs = F.transform(F.filter(F.split(raw, "&"), lambda p: p != ""), lambda p, i: F.struct(plain(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"), i.alias("i"), plain(F.regexp_extract(p, "=(.*)$", 1)).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: ~p["k"].rlike(_TRACKING)))
    return F.array_join(F.transform(kept, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")


def canonical(url: Column) -> Column:
    """https, no www., lower-case host, no default port, no fragment, no tracking parameters, the rest decoded, sorted by key and
    encoded again, no slash at the end but for the root.

    What isn't an http address stays as it is, and so does one whose host is a number but no IPv4 address.
    """
    clean = F.regexp_replace(F.regexp_replace(url, "^[\\x00-\\x20]+|[\\x00-\\x20]+$", ""), "[\\t\\n\\r]", "")
    part = lambda i: F.regexp_extract(clean, _PARTS, i)
    host = F.regexp_replace(ascii_host(part(3)), "^www\\.", "")
    port = F.regexp_replace(part(4), "^0+(?=\\d)", "")
    default = (port == "") | (port == "443") | ((port == "80") & (F.lower(part(1)) == "http"))
    whole = F.concat(F.lit("https://"), part(2), host, F.when(default, "").otherwise(F.concat(F.lit(":"), port)), _path(part(5)), let(_query(part(6)), lambda q: F.when(q == "", q).otherwise(F.concat(F.lit("?"), q))))
    return F.when(part(3) == "", url).otherwise(F.coalesce(whole, url))


def item_id(url: Column) -> Column:
    """16 hex digits of the SHA-256 of the canonical address."""
    return F.substring(F.sha2(canonical(url), 256), 1, 16)


def host(url: Column) -> Column:
    """Host as an address parser has it, without www.; a bare domain counts as https; null if there is none."""
    full = F.when(url.rlike("^\\s*[a-zA-Z][a-zA-Z0-9+.-]*://"), F.trim(url)).otherwise(F.concat(F.lit("https://"), F.trim(url)))
    found = F.regexp_extract(full, "^[a-zA-Z][a-zA-Z0-9+.-]*:[/\\\\]{2}(?:[^/\\\\?#@]*@)?([^/\\\\?#:@\\s<>\\[\\]^|]+)(?=[/\\\\?#:]|$)", 1)
    return F.regexp_replace(ascii_host(F.nullif(found, F.lit(""))), "^www\\.", "")


def origin(url: Column) -> Column:
    """Scheme, host in lower case and a port that isn't the default."""
    part = lambda i: F.regexp_extract(F.trim(url), "^(?i:(https?)):[/]+(?:[^/?#@]*@)?([^/?#:]+)(?::(\\d+))?", i)
    scheme, port = F.lower(part(1)), part(3)
    default = (port == "") | ((scheme == "https") & (port == "443")) | ((scheme == "http") & (port == "80"))
    return F.when(part(2) != "", F.concat(scheme, F.lit("://"), F.lower(part(2)), F.when(default, "").otherwise(F.concat(F.lit(":"), port))))


def with_scheme(text: Column) -> Column:
    """A candidate address from a text line; null for empty lines and those that begin with #."""
    bare = F.trim(text)
    return F.when((bare == "") | F.startswith(bare, F.lit("#")), F.lit(None)).when(bare.rlike("(?i)^https?://"), bare).otherwise(F.concat(F.lit("https://"), bare))


def resolve(href: Column, base: Column) -> Column:
    """An absolute address for absolute, scheme-relative, root-relative and plain relative references."""
    scheme, authority = F.regexp_extract(base, "^(https?):", 1), F.regexp_extract(base, "^(https?://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(F.regexp_replace(base, "[?#].*$", ""), "^(https?://[^/]+)$", "$1/"), "[^/]*$", "")
    return (
        F.when(href.rlike("(?i)^https?://"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(authority, href))
        .otherwise(F.concat(folder, F.regexp_replace(href, "^\\./", "")))
    )
