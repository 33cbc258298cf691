"""Words longer than a hash's block, passages and sets that differ in such words only, and columns with clashing names."""

from __future__ import annotations

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute

from siftloom.llm import kernels as K
from siftloom.llm import neardup, substring, toxicity

LONG = [("a" + "x" * n + "b", "b" + "x" * n + "a") for n in (4094, 4095, 4096, 8191, 99_998)]


def hashes(words, **k):
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return K.word_hashes(data, K.words(data, np.array([0, len(data)])), **k).tolist()


@pytest.mark.parametrize("pair", LONG, ids=lambda p: str(len(p[0])))
def test_swapped_bytes_have_other_hashes(pair):
    assert len(set(hashes(pair))) == 2
    assert hashes(pair) == [hashes([w])[0] for w in pair]
    assert not set(hashes(pair)) & set(hashes(pair, seed=1))


def test_hash_depends_on_the_word_alone():
    words = [f"w{i}" for i in range(500)] + [chr(97 + i % 26) * (4080 + i) for i in range(40)]
    assert hashes(words) == [hashes([w])[0] for w in words]
    assert len(set(hashes(words))) == len(words)


@pytest.mark.parametrize("pair", LONG, ids=lambda p: str(len(p[0])))
def test_passages_of_long_words(spark, pair):
    common = " ".join(f"w{i}" for i in range(49))
    docs = [(1, f"{common} {pair[0]}"), (2, f"{common} {pair[1]}"), (3, f"more {common} {pair[1]}")]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute.substrings(docs)


@pytest.mark.parametrize("pair", LONG, ids=lambda p: str(len(p[0])))
def test_sets_of_long_words(spark, pair):
    docs = [(1, f"{pair[0]} p q r"), (2, f"{pair[1]} p q r"), (3, f"{pair[1]} P Q R")]
    got = {r["id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), size=4).collect()}
    assert got == brute.near(docs)


def test_carried_columns_may_have_any_name(spark):
    rows = [(i, f"text {i}", "kept", 1.0) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, scored_text string, score double")
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.learn(docs, labels), carry=True)
    assert set(got.columns) == {"doc_id", "text", "scored_text", "score"} and {r["scored_text"] for r in got.collect()} == {"kept"}
