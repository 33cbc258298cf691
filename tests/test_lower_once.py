"""Searches for many words lower-case a text once, not for each word; the guarded pattern finds what the bare one finds."""

import re

from pyspark.sql import functions as F

from siftloom.functions import text as T
from siftloom.functions.vocab import Entry, Vocabulary
from siftloom.operators import scoring
from siftloom.plans import given

#: Copies in lower case: three of a title (tools, topics, words of experience), one of an excerpt, one of the body for all its searches.
COPIES = 5


def lowered(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("lower(")


def shown(spark, f):
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    try:
        return f()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_texts_are_lowered_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "Alpha 坑 BETA user agent"), (2, None), (3, "agent")], "id int, text string")
    df.write.parquet(f"{tmp_path}/t.parquet")
    df = spark.read.parquet(f"{tmp_path}/t.parquet")
    words, names = [f"word {i}" for i in range(50)] + ["Beta", "坑"], Vocabulary((Entry("a", "Alpha", ("坑",)), Entry("agent", "agent", (), ("User Agent",)), Entry("b", "BETA")))
    found = df.select("id", T.hits(F.col("text"), words).alias("w"), names.matches(F.col("text")).alias("n"))
    assert shown(spark, lambda: lowered(found)) == 2
    assert {r["id"]: (r["w"], r["n"]) for r in found.collect()} == {1: (["Beta", "坑"], ["a", "b"]), 2: ([], []), 3: ([], ["agent"])}


def test_rules_lower_each_text_a_fixed_number_of_times(spark):
    assert shown(spark, lambda: lowered(given.han_score_rules(spark, "/root/testdata/sf0.001"))) == COPIES


def test_guarded_pattern_finds_what_the_bare_one_finds(spark):
    bare = scoring.HAN_PATTERNS["self_promo"]
    guarded = scoring.han_rules(given.AGENTS, given.TALK).self_promo
    flat = bare[1:-1].replace("[\\[【](分享创造|分享創造|开源|開源)[\\]】]", "[分享创造]|【開源】")
    for a, b in (("\\s*", " "), ("[Ss]tar", "Star"), ("[:：]", "："), ("\\[", "["), ("\\]", "]"), ("?", "")):
        flat = flat.replace(a, b)
    wordings = flat.split("|")
    assert len(wordings) > 60 and all(re.fullmatch(bare, w) for w in wordings)
    texts = [t for w in wordings for t in (w, f"a 一{w}", f"{w}\n", w[1:], w[:-1])] + ["", "求", "【", "[开源"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.col("t").rlike(guarded).alias("found")).collect()
    assert [(r["t"], r["found"]) for r in got] == [(t, re.search(bare, t) is not None) for t in texts]
