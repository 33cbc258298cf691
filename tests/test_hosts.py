"""Hosts beyond ASCII and in numbers, against the standard library."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from siftloom.functions import url as U


def test_punycode_equals_the_codec(spark):
    rng = random.Random(4)
    letters = "abz019-äßéюñ日本語한ัم😀𐍈"
    labels = ["müller", "bücher", "日本語", "παράδειγμα", "правда", "ü", "aü", "üa", "ab", "a-ü", "-ü", "üü", "ñandú", "😀", "他们为什么不说中文", "porquénopuedensimplementehablarenespañol"]
    labels += ["".join(rng.choices(letters, k=rng.randrange(1, 20))) for _ in range(150)]
    want = {x: x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in labels}
    df = spark.createDataFrame([(x,) for x in want], "x string")
    assert {r["x"]: r["y"] for r in df.select("x", U.punycode(F.col("x")).alias("y")).collect()} == want


NUMBERS = {
    "127.0.0.1": "127.0.0.1", "0x7f.1": "127.0.0.1", "0x7F.0.0.0x1": "127.0.0.1", "2130706433": "127.0.0.1", "017700000001": "127.0.0.1", "1.2.3": "1.2.0.3", "1.65537": "1.1.0.1", "0": "0.0.0.0", "0x": "0.0.0.0", "1.2.3.4.": "1.2.3.4", "4294967295": "255.255.255.255",
    "4294967296": None, "256.1.1.1": None, "1.2.3.256": None, "1.2.3.4.5": None, "a.1": None, "08": None, "1..2": None, "0xfffffffff": None, "99999999999999999999": None, "a.b": "a.b", "1a": "1a", "1.a": "1.a", "WWW.A.Example": "www.a.example", "a.0xg": "a.0xg",
    "Müller.Example": "xn--mller-kva.example", "m%C3%BCller.example": "xn--mller-kva.example", "日本。jp": "xn--wgv71a.jp", "straße.de": "xn--strae-oqa.de",
}


def test_hosts(spark):
    df = spark.createDataFrame([(x,) for x in NUMBERS], "x string")
    assert {r["x"]: r["y"] for r in df.select("x", U.ascii_host(F.col("x")).alias("y")).collect()} == NUMBERS


def test_numbers_in_every_form(spark):
    rng, want = random.Random(9), {}
    for _ in range(200):
        v = rng.randrange(1 << 32)
        b = v.to_bytes(4, "big")
        form = [str, hex, lambda n: "0" + oct(n)[2:] if n else "0"]
        some = lambda n: rng.choice(form)(n)
        cut = rng.randrange(4)
        want[".".join([*map(some, b[:cut]), some(int.from_bytes(b[cut:], "big"))])] = str(ipaddress.ip_address(v))
    df = spark.createDataFrame([(x,) for x in want], "x string")
    assert {r["x"]: r["y"] for r in df.select("x", U.ascii_host(F.col("x")).alias("y")).collect()} == want


@pytest.mark.parametrize("url,canonical", [
    ("https://müller.example/", "https://xn--mller-kva.example/"), ("http://www.MÜLLER.example/a/?b=1&a=2", "https://xn--mller-kva.example/a?a=2&b=1"), ("http://0x7f.1/", "https://127.0.0.1/"), ("http://0x7f.1:8080/x", "https://127.0.0.1:8080/x"), ("http://1.2.3.4.5/", "http://1.2.3.4.5/"), ("http://a.example/😀é/x", "https://a.example/%F0%9F%98%80%C3%A9/x"),
])
def test_canonical(spark, url, canonical):
    assert spark.createDataFrame([(url,)], "u string").select(U.canonical(F.col("u"))).first()[0] == canonical
