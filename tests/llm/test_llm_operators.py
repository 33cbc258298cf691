"""The pipeline operators against plain versions, on a table of awkward rows and on the smallest generated one."""

from __future__ import annotations

import hashlib
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from siftloom.llm import fingerprints, graph, kernels, langid, licenses, mixing, neardup, packing, quality, queries, sharding, substring, toxicity

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long, score string, copy int, at string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(n))


def table():
    rng = random.Random(3)
    base, passage = words(rng, 120), words(rng, 70)
    b = base.split()
    texts = [
        base, base, base.upper(), " ".join([*b[:60], "new", *b[60:]]), " ".join(b[:-3]), None, "", " \n\t ", "one", "one two", "ONE  two", "one two three four", words(rng, 40) + "\n" + passage, passage + " " + words(rng, 30),
        words(rng, 13) + " " + passage + " " + words(rng, 20), "é" * 50 + " ñandú ß", words(rng, 20_000), "x" * 200_000, "ha " * 300, "a b\na b\n\nc", "This is licensed under the GNU General Public License, version 3.", "CC BY-NC 4.0 and cc by and MIT License; mit licence",
        "Apache\nLicense apache license", " ".join(b[20:]) + " tail", "日本語 テキスト", "😀 ### $$$ |", words(rng, 300) + " " + base, "<|endoftext|> hi a<|startoftext|>b",
    ]
    return [(i * 3 + 1, t, ("en", "fr", None)[i % 3], ("hot", "hot", "b", None)[i % 4], None if t is None else len(t), "clash", 7, "clash") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(table(), KIND).repartition(5)


@pytest.fixture(scope="module")
def plain():
    return [(r[0], r[1]) for r in table()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def test_substrings(docs, plain, empty):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.dedup_substrings(docs).collect()}
    assert got == brute.substrings(plain)
    assert substring.dedup_substrings(empty).count() == 0
    kept = {r["doc_id"]: r["kept_text"] for r in substring.dedup_substrings(docs, carry=("lang",)).collect()}
    assert kept[1] == plain[0][1] and kept[16] is None


@pytest.mark.parametrize("period", sorted(substring.COVERS))
def test_covers_are_difference_covers(period):
    c = substring.COVERS[period]
    assert {(a - b) % period for a in c for b in c} == set(range(period))


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(docs, plain, empty, size):
    got = {r["id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs, size=size).collect()}
    assert got == brute.near(plain, size)
    assert neardup.near_duplicates(empty, size=size).count() == 0


def test_near_duplicate_chains_of_many_copies(spark):
    """Copies each a little further from the first: links form chains that no single leader sees."""
    rng = random.Random(8)
    w = words(rng, 60).split()
    rows = []
    for i in range(120):
        if i % 3 == 0:
            w = [*w]
            w[rng.randrange(60)] = f"new{i}"
        rows.append((i, " ".join(w)))
    got = {r["id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()}
    assert got == brute.near(rows)


def edited(rng, base, share):
    """A copy with about a share of its words replaced, dropped or doubled."""
    out = []
    for w in base:
        if rng.random() >= share:
            out.append(w)
        elif rng.random() < 0.8:
            out += [words(rng, 1)] * rng.choice((1, 1, 2))
    return " ".join(out)


@pytest.mark.parametrize("original", [True, False])
def test_near_duplicates_in_one_large_group_of_edited_copies(spark, original):
    """1200 copies of one text at resemblances on both sides of the threshold, with and without the original."""
    rng = random.Random(12)
    base = words(rng, 80).split()
    rows = [(i, edited(rng, base, rng.choice((0.01, 0.03, 0.05, 0.08)))) for i in range(1200)]
    if original:
        rows.append((1200, " ".join(base)))
    got = {r["id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()}
    assert got == brute.near(rows)


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "a b c d e")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(df, size=4).collect()
    assert sorted((r["id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    a, b = words(random.Random(1), 60), words(random.Random(2), 60)
    other = spark.createDataFrame([(0, a), (1, a), (1, b), (2, b)], "doc_id long, text string")
    got = neardup.near_duplicates(other, size=4).collect()
    assert sorted((r["id"], r["component_id"], r["kept"]) for r in got) == [(0, 0, True), (1, 0, False), (1, 1, True), (2, 1, False)]
    assert substring.dedup_substrings(df).count() == 4
    assert sharding.shard(df, [1.0, 1.0]).count() == 4
    assert packing.pack(df, queries.tokenizer_path(), 8).count() == 4
    assert fingerprints.compare_with_next(df).count() == 4
    assert mixing.mix(df.withColumn("source", F.lit("s"))).count() >= 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 200)] + [(500, 500 + i) for i in range(1, 50)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root if any(n in e and e[0] != e[1] for e in edges)}


def test_superminhash_estimates_resemblance():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    for n, shift in ((1000, 250), (40, 10), (5, 1)):
        a, b = pool[:n], pool[shift : n + shift]
        sig = kernels.superminhash(np.concatenate([a, b]), np.array([0, n, 2 * n]), 400)
        assert abs((sig[0] == sig[1]).mean() - (n - shift) / (n + shift)) < 0.08


def test_packing(spark, docs, plain, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    got = packing.pack(docs, queries.tokenizer_path(), 512).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == brute.pieces(plain, tokenizer, 512)
    by: dict = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for some in by.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= 512
    assert len(by) <= -(-sum(r["length"] for r in got) // 512) + 1
    assert packing.pack(empty, queries.tokenizer_path()).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_everything_once(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 65): rng.randrange(1, 400 if seed % 2 else 6) for _ in range(rng.choice([1, 3, 40]))}
    used: dict = {}
    for times, use in packing.plan(counts, 64):
        assert times > 0 and sum(use) <= 64
        for x in use:
            used[x] = used.get(x, 0) + times
    assert used == counts


def test_plan_completes_by_one_two_and_three():
    assert packing.plan({60: 1, 4: 1}, 64) == [(1, [60, 4])]
    assert sorted(packing.plan({50: 1, 9: 1, 5: 1}, 64)[0][1]) == [5, 9, 50]
    assert sorted(packing.plan({40: 1, 11: 1, 9: 1, 4: 1}, 64)[0][1]) == [4, 9, 11, 40]


def test_fingerprints(docs, plain, empty):
    rows = {r["doc_id"]: r for r in fingerprints.compare_with_next(docs).collect()}
    ids = sorted(i for i, _ in plain)
    texts = {i: t or "" for i, t in plain}
    for k, i in enumerate(ids):
        a, nxt = texts[i], texts[ids[(k + 1) % len(ids)]]
        half = len(a) // 2
        assert rows[i]["n_chars"] == len(a)
        assert rows[i]["edited_sha256"] == hashlib.sha256((a[: len(a) - half] + nxt[:half]).encode()).hexdigest()
        assert 0 <= rows[i]["near_edited"] <= 1 and 0 <= rows[i]["near_next"] <= 1
    assert rows[1]["fingerprint"] == rows[4]["fingerprint"] != rows[10]["fingerprint"]
    assert rows[1]["near_next"] == 1
    assert fingerprints.compare_with_next(empty).count() == 0


def test_closed_syncmers_are_chosen_at_the_edges(spark):
    text = words(random.Random(4), 200)
    chosen = spark.createDataFrame([(text,)], "text string").select(fingerprints.syncmers(F.col("text"), 4).alias("s"), F.transform(F.split("text", " "), lambda w: F.xxhash64(w)).alias("h")).first()
    h = [(1 << 63) - 1] * 3 + chosen["h"] + [(1 << 63) - 1] * 3
    want = sum(min(h[i : i + 4]) in (h[i], h[i + 3]) for i in range(len(h) - 3))
    assert len(chosen["s"]) == want


def test_fingerprints_keep_all_anchors_and_places(spark):
    """Long texts that differ in one word of the middle, and one that has the other's passage further behind."""
    base = words(random.Random(9), 1500).split()
    changed = [*base[:750], "changed", *base[751:]]
    late = ["before"] * 40 + base[300:900]
    rows = list(enumerate([" ".join(base), " ".join(changed), " ".join(late)]))
    got = {r["doc_id"]: r for r in fingerprints.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    parsed = lambda f: [(int(x[:8], 16), int(x[8:])) for x in f.split(" ")]
    at = {i: parsed(r["fingerprint"]) for i, r in got.items()}
    assert got[0]["fingerprint"] != got[1]["fingerprint"]
    runs = spark.createDataFrame([(" ".join(base),)], "text string").select(F.transform(F.split("text", " "), lambda w: F.xxhash64(w)).alias("h")).first()["h"]
    h = [(1 << 63) - 1] * 2 + runs + [(1 << 63) - 1] * 2
    assert [p for _, p in at[0]] == [i - 2 for i in range(len(h) - 2) if min(h[i : i + 3]) in (h[i], h[i + 2])]
    apart = {p for _, p in at[0]} - {p for x, p in at[0] if (x, p) in set(at[1])}
    assert apart and apart <= {748, 749, 750}
    inside = {(x, p - 300 + 40) for x, p in at[0] if 300 <= p <= 897}
    assert len(inside) > 300 and inside <= set(at[2])
    sets = {i: {x for x, _ in a} for i, a in at.items()}
    for i, r in got.items():
        own, nxt, edited = sets[i], sets[(i + 1) % 3], {x for x, _ in parsed(r["edited_fingerprint"])}
        assert abs(r["near_next"] - len(own & nxt) / len(own | nxt)) < 1e-12 and abs(r["near_edited"] - len(own & edited) / len(own | edited)) < 1e-12


def test_fingerprints_match_under_a_shift(spark):
    """A word put in front, a passage from further behind, and texts of which only the fingerprints are left."""
    base = words(random.Random(2), 400).split()
    texts = [" ".join(base), " ".join(["first", *base]), " ".join(["x"] * 7 + base[100:300]), "other words altogether", ""]
    df = fingerprints.fingerprint(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", fingerprints.written(F.col("anchors")).alias("f"))
    a, b = df.where("doc_id = 0").select(F.col("f").alias("a")), df.select("doc_id", F.col("f").alias("b"))
    got = {r["doc_id"]: r for r in a.crossJoin(b).select("doc_id", fingerprints.likeness_of(F.col("a"), F.col("b")).alias("near"), fingerprints.aligned(fingerprints.read(F.col("a")), fingerprints.read(F.col("b"))).alias("m"), F.size(fingerprints.read(F.col("a"))).alias("all")).collect()}
    n = got[0]["all"]
    assert got[0]["near"] == 1 and tuple(got[0]["m"]) == (0, n)
    assert got[1]["near"] > 0.97 and got[1]["m"]["shift"] == 1 and got[1]["m"]["n"] >= n - 3
    assert got[2]["m"]["shift"] == -93 and 90 < got[2]["m"]["n"] < 0.6 * n
    assert got[3]["near"] < 0.02 and got[3]["m"]["n"] <= 2 and got[4]["near"] < 0.02


def test_sharding(docs, empty):
    rows = sharding.shard(docs, [1.0] * 6, chunk=3).collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 6)
        assert (r["size"], r["text_crc32"]) == next((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in [(x[0], x[1]) for x in table()] if i == r["doc_id"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.shard(empty, [1.0]).count() == 0


def test_shard_weights(spark):
    n = spark.range(20_000).select(sharding.shard_of(F.col("id").cast("string"), [1.0, 3.0]).alias("s")).where("s = 1").count()
    assert abs(n / 20_000 - 0.75) < 0.02


def test_mixing(spark, docs, empty):
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, "hot").otherwise("b").alias("source"), F.lit("t").alias("copy"))
    got = mixing.mix(rows, {"hot": 1.0, "b": 3.0}).groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in got}
    assert abs(n["hot"] / 7_500 - 1) < 0.05 and abs(n["b"] / 22_500 - 1) < 0.05
    keys = [r["shuffle_key"] for r in mixing.mix(docs).collect()]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    assert mixing.mix(docs).exceptAll(mixing.mix(docs)).count() == 0
    assert mixing.mix(docs, {"hot": 1.0}).where("source is distinct from 'hot'").count() == 0
    assert mixing.mix(empty).count() == 0


def test_poisson_inverse(spark):
    import math

    for rate in (0.3, 1.0, 7.5):
        got = [r[0] for r in spark.range(2000).select(mixing.poisson_inverse((F.col("id") + 0.5) / 2000, F.lit(rate))).collect()]
        for u, n in zip([(i + 0.5) / 2000 for i in range(2000)], got):
            below = sum(math.exp(-rate) * rate**k / math.factorial(k) for k in range(n))
            assert below <= u + 1e-9 and below + math.exp(-rate) * rate**n / math.factorial(n) > u - 1e-9


def test_mixing_at_high_rates(spark):
    """A source of 1 % of the rows with target 0.5 has the rate 50; one row may have the rate 1000."""
    rows = spark.range(10_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 0, "rare").otherwise("rest").alias("source"))
    n = {r["source"]: r["count"] for r in mixing.mix(rows, {"rare": 1.0, "rest": 1.0}).groupBy("source").count().collect()}
    assert abs(n["rare"] / 5_000 - 1) < 0.06 and abs(n["rest"] / 5_000 - 1) < 0.06
    draw = [r[0] for r in spark.range(2000).select(mixing.poisson("s", F.col("id").cast("string"), F.lit(1000.0))).collect()]
    mean = sum(draw) / 2000
    assert abs(mean - 1000) < 3.5 and abs(sum((x - mean) ** 2 for x in draw) / 2000 / 1000 - 1) < 0.15
    one = mixing.uniform(F.concat(F.lit("s|"), F.col("id").cast("string")))
    assert spark.range(500).where(mixing.poisson("s", F.col("id").cast("string"), F.lit(16.0)) != mixing.poisson_inverse(one, F.lit(16.0))).count() == 0


def test_quality(spark, docs, plain, empty):
    labels = spark.createDataFrame([(1, 1, 0), (40, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.rules(docs, labels).collect()}
    assert got == {i: brute.quality(t) for i, t in plain}
    assert not [r for r in quality.rules(docs, labels.where("false")).collect() if r["kept"] and r["base_failed"]]
    assert quality.rules(empty, labels).count() == 0


def test_licenses(docs, plain, empty):
    rows = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    got = {i: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for i, r in rows.items()}
    assert got == {i: brute.licenses(t) for i, t in plain}
    by_text = {t: i for i, t in plain}
    assert rows[by_text["This is licensed under the GNU General Public License, version 3."]]["labels"] == "gpl,gpl-3.0"
    assert licenses.scan(empty).count() == 0


def test_language(spark, docs, empty):
    data = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(data).join(data.select("doc_id", "lang"), "doc_id")
    held = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert held > 0.9
    rows = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs).collect()}
    assert rows[16] == "und" and rows[19] == "und"
    assert langid.identify(empty).count() == 0


@pytest.mark.parametrize("others", [0, 70])
def test_bloom_filters_find_all_that_went_in(others):
    rng = np.random.default_rng(1)
    some = {name: rng.integers(0, 1 << 62, 5000).astype(np.uint64) for name in ["x", "y", *(f"z{i:02}" for i in range(others))]}
    f = langid.build(some)
    for i, name in enumerate(f.langs):
        assert f.having(f.find(some[name]), i).all()
        assert abs(f.having(f.find(rng.integers(0, 1 << 62, 20_000).astype(np.uint64)), i).mean() - f.false[i]) < 0.01


def test_more_languages_than_bits(spark):
    """70 languages, each with words of its own, and texts without letters of category L."""
    rng = random.Random(5)
    own = {f"l{i:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(40)] for i in range(70)}
    rows = [(i, " ".join(rng.choice(own[lang]) for _ in range(60)), lang) for i, lang in enumerate(sorted(own) * 8)]
    rows += [(1000, "²³ ½ 12 Ⅷ", None), (1001, None, None), (1002, "", "l00"), (1003, "ª", None)]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert got[1003]["lang_pred"] != "und"
    held = [(got[i]["lang_pred"], lang) for i, _, lang in rows if i < 1000 and got[i]["held_out"]]
    assert sum(a == b for a, b in held) > 0.95 * len(held) > 100


def test_toxicity(spark, docs, empty):
    rng = random.Random(6)
    rows, marks = [], []
    for i in range(400):
        bad = i % 5 == 0
        rows.append((i, words(rng, 40) + (" you idiot zzurk" if bad else "") + " " + words(rng, 20)))
        marks.append((i, 1, int(bad)))
    data, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.learn(data, toxicity.fold(labels))
    got = toxicity.score(data, model).join(labels, "doc_id").collect()
    assert all((r["score"] >= 0.5) == bool(r["toxic"]) for r in got)
    assert toxicity.score(docs, model).count() == len(table())
    assert toxicity.score(docs, model, carry=True).columns.count("score") == 1
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.score(empty, toxicity.learn(empty, labels.where("false"))).count() == 0


def test_queries_return_their_contracts(spark):
    want = {
        "op1": "doc_id piece start length ids_crc32 sequence_id offset", "op2": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op3": "doc_id n_words n_removed kept_sha256", "op4": "doc_id size text_crc32 law shard slot grown_shard",
        "op5": "doc_id held_out score predicted", "op7": "doc_id held_out lang_pred score", "op8": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op9": "doc_id n_shingles component_id kept",
        "op10": "doc_id n_words n_base first_word last_word base_labels labels score", "op11": "page_id payload_bytes payload_digest record_type refers_to", "op12": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256", "op13": "item_id rank doc_id score",
    }
    n, pages = (spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("documents", "pages"))
    for name, q in queries.queries().items():
        df = q(spark, SF)
        assert set(want.get(name.split("_")[0], "").split()) <= set(df.columns), name
        rows = df.count()
        assert rows > 0 if name.startswith(("op1_", "op6", "op13")) else rows == (pages if name.startswith("op11") else n), name
