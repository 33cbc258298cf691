"""Vocabularies as tables against the same vocabularies as expressions, and against a plain search."""

import random
import re

import pytest
from pyspark.sql import functions as F

from siftloom.functions.vocab import Entry, Vocabulary
from siftloom.operators import matching

ENTRIES = (
    Entry("js", "Node.js", ("nodejs",)), Entry("c", "C++"), Entry("net", ".NET"), Entry("gpt", "GPT-4", (), ("gpt-4 turbo",)), Entry("plus", "++"), Entry("han", "向量数据库"), Entry("one", "库"), Entry("mix", "AI助手", ("ai 助手",)), Entry("lic", "license", (), ("public license", "mit license")),
    Entry("no", "hidden", ("shown",), (), False), Entry("same", "node.js"), Entry("fr", "café"), Entry("sp", "a b"), Entry("q", "\\E.x"),
)
TEXTS = [
    "I use Node.js.", "xnode.js", "node.jsx", "C++ and c++11", "ASP.NET", ".net", "(.NET)", "gpt-4 turbo", "GPT-4 turbo and GPT-4", "++", "a++b", "用向量数据库", "库", "我的AI助手", "ai 助手", "public license", "public license, a license", "hidden", "shown", "&license", "Café", "cafés", "xcafé", "a  b", "a b", "a bc", "\\e.x y", "", None, "库a", "a库", "é",
]


def rows(entries):
    return [(e.id, e.needles()[0], e.needles()[1:], list(e.not_)) for e in entries if e.needles()]


def found(spark, entries, texts, counted=False):
    vocabulary = matching.entries(spark.createDataFrame(rows(entries), "id string, name string, aka array<string>, masks array<string>"), aka="aka", masks="masks")
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    got = matching.matched_ids(matching.match(df, matching.index(vocabulary, matching.token_counts(df) if counted else None)))
    return {(r["id"], r["entry"]) for r in got.collect()}


def test_same_as_the_expression(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    want = {(r["id"], x) for r in df.select("id", Vocabulary(ENTRIES).matches(F.col("text")).alias("m")).collect() for x in r["m"]}
    assert found(spark, ENTRIES, TEXTS) == want and len(want) > 20


def plain(needle, text):
    low = text.lower()
    return needle in low if not needle.isascii() else re.search(f"(?<![a-z0-9&]){re.escape(needle)}(?![a-z0-9])", low) is not None


@pytest.mark.parametrize("counted", [False, True])
def test_many_needles(spark, counted):
    rng = random.Random(2)
    bits = ["ab", "b", "c1", "&", "é", "库", " ", ".", "-", "AB", "日本", "😀"]
    make = lambda n: "".join(rng.choices(bits, k=rng.randrange(1, n)))
    names = sorted({make(4).lower().strip() for _ in range(150)} - {""})
    texts = [make(25) for _ in range(120)]
    got = found(spark, [Entry(str(i), n) for i, n in enumerate(names)], texts, counted=counted)
    assert got == {(t, str(i)) for t, text in enumerate(texts) for i, n in enumerate(names) if plain(n, text)} and len(got) > 500


def test_no_nested_loop_over_needles(spark):
    vocabulary = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("name "), "id").alias("name"))
    texts = spark.range(1000).select("id", F.concat(F.lit("a name "), F.col("id").cast("string")).alias("text"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = matching.match(texts, matching.index(matching.entries(vocabulary)))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("NestedLoop") <= 1 and "CartesianProduct" not in plan  # the one row of needles without a token
        assert df.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_empty(spark):
    assert found(spark, ENTRIES, []) == set() and found(spark, ENTRIES[:0], TEXTS) == set()
