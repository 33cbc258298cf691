"""Archives in packages, aligned tokenizers and ranked search against plain versions."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import math
import random
import re
import zipfile
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from siftloom.llm import alignment, kernels, lexical, queries, warc

SF = "/root/testdata/sf0.001"


# ---- archives


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


LONG = "<p>é" + "x" * 1200 + "</p>"
PAGES = [
    (1, "http://a.example/", LONG), (2, "http://www.b.example:8080/x?y=1", LONG), (7, "http://c.example/", LONG), (3, None, "short"), (4, "http://d.example/\r\nX: y", "short"), (5, "http://[::1", None), (6, "", ""),
    (8, "http://e.example/", LONG + "!"), (8, "http://e.example/", LONG + "!"), (None, "http://f.example/", LONG), (None, "http://g.example/", "z" * 2000), (9, "http://h.example/", "y" * 999), (10, "http://h.example/", "y" * 999),
]


def plain_pages(rows):
    keeper: dict[bytes, int] = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and i is not None:
            keeper[b] = max(i, keeper.get(b, i))
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        to = keeper.get(b)
        to = None if to == i else to
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "response" if to is None else "revisit", to, True))
    return sorted(out, key=repr)


def test_pages_come_back(spark):
    got = [tuple(r) for r in warc.round_trip(pages_of(spark, PAGES), package_bytes=700, member_bytes=300).collect()]
    assert sorted(got, key=repr) == plain_pages(PAGES)


def test_no_pages(spark):
    assert warc.round_trip(pages_of(spark, PAGES).where("false")).collect() == []


def test_ids_of_another_kind_and_columns_of_other_names(spark):
    rows = [("a b", LONG, "x"), ("c/d>", LONG, "y"), ("é", "", "z")]
    df = spark.createDataFrame(rows, "id string, text string, digest string").selectExpr("id as page_id", "text as html", "digest as url", "1 as size", "2 as keeper")
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect()}
    assert got == {"a b": ("revisit", "c/d>"), "c/d>": ("response", None), "é": ("response", None)}


def test_packages_are_sound(spark):
    manifest = warc.write_archives(pages_of(spark, PAGES), package_bytes=2000, member_bytes=500)
    paths = [r["path"].removeprefix("file:") for r in manifest.collect()]
    assert len(paths) > 1 and manifest.agg({"records": "sum"}).first()[0] == len(PAGES)
    for p in paths:
        with zipfile.ZipFile(p) as z:
            assert z.testzip() is None and all(x.compress_type == zipfile.ZIP_STORED for x in z.infolist())
            what = json.loads(z.read("datapackage.json"))
            assert all(f"sha256:{hashlib.sha256(z.read(r['path'])).hexdigest()}" == r["hash"] for r in what["resources"])
            lines = z.read("indexes/index.cdxj").decode().splitlines()
            assert lines == sorted(lines)
            for line in lines:
                x = json.loads(line.split(" ", 2)[2])
                raw = z.read(f"archive/{x['filename']}")[int(x["offset"]) : int(x["offset"]) + int(x["length"])]
                assert gzip.decompress(raw).startswith(b"WARC/1.1\r\n")
    got = warc.read_archives(manifest).collect()
    assert sorted(r["payload"] for r in got if r["page_id"] == "8") == [(LONG + "!").encode()] * 2
    assert all(r["payload"] is None for r in got if r["record_type"] == "revisit")


def memory(data: bytes) -> warc.Reader:
    return warc.Reader(lambda at, n: data[at : at + n], len(data))


def archive(records=3):
    return b"".join(gzip.compress(warc.record(str(i), f"http://a/{i}", b"p" * i, i, hashlib.sha1(b"p" * i).hexdigest(), None, "2024-01-01T00:00:00Z")) for i in range(records))


def zipped(members, comment=b"", prefix=b"", **kw):
    out = io.BytesIO()
    out.write(prefix)
    with zipfile.ZipFile(out, "a", **kw) as z:
        for name, data, how in members:
            z.writestr(zipfile.ZipInfo(name, warc.DAY), data, compress_type=how)
        z.comment = comment
    return out.getvalue()


@pytest.mark.parametrize("comment", [b"", b"a comment with PK\x05\x06 in it", b"c" * 65_535])
@pytest.mark.parametrize("prefix", [b"", b"bytes before the package"])
def test_members_without_an_index_are_walked(comment, prefix):
    data = zipped([("archive/a.warc.gz", archive(), zipfile.ZIP_STORED), ("notes.txt", b"n" * 100, zipfile.ZIP_DEFLATED)], comment, prefix)
    r = memory(data)
    assert [m.name for m in r.members()] == ["archive/a.warc.gz", "notes.txt"]
    got = [warc.parse(data[at : at + n]) for _, at, n in r.records()]
    assert [x["payload"] for x in got] == [b"", b"p", b"pp"] and [x["warc"]["warc-record-id"] for x in got] == ["<urn:page:0>", "<urn:page:1>", "<urn:page:2>"]


@pytest.mark.parametrize("prefix", [b"", b"bytes before the package"])
def test_zip64_directories(monkeypatch, prefix):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 40)  # every size and place is written as a long one
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    raw = archive(5)
    data = zipped([(f"archive/{n}.warc.gz", raw, zipfile.ZIP_STORED) for n in "ab"], prefix=prefix)
    assert b"PK\x06\x06" in data and b"PK\x06\x07" in data
    r = memory(data)
    assert [(m.name, m.size, data[m.begin : m.begin + m.packed] == raw) for m in r.members()] == [("archive/a.warc.gz", len(raw), True), ("archive/b.warc.gz", len(raw), True)]
    assert len(list(r.records())) == 10


def test_packed_indexes_are_read_and_packed_archives_are_not():
    first = gzip.compress(b"WARC/1.1\r\n\r\n")
    line = json.dumps({"filename": "a.warc.gz", "offset": "0", "length": str(len(first))})
    data = zipped([("archive/a.warc.gz", first + b"not listed", zipfile.ZIP_STORED), ("indexes/index.cdx.gz", gzip.compress(f"!meta\na 2024 {line}\n".encode()), zipfile.ZIP_DEFLATED)])
    (found,) = memory(data).records()
    assert data[found[1] : found[1] + found[2]] == first
    with pytest.raises(ValueError, match="stored"):
        list(memory(zipped([("archive/a.warc.gz", archive(), zipfile.ZIP_DEFLATED)])).records())
    with pytest.raises(ValueError, match="not a ZIP"):
        memory(b"x" * 100).members()


def test_archives_of_others_and_damage(spark, tmp_path):
    good = zipped([("archive/a.warc.gz", archive(4), zipfile.ZIP_STORED)])
    bad = gzip.compress(warc.record("9", "http://a/", b"changed", 7, "0" * 40, None, "2024-01-01T00:00:00Z"))
    (tmp_path / "a.wacz").write_bytes(good)
    (tmp_path / "b.wacz").write_bytes(zipped([("archive/b.warc.gz", bad, zipfile.ZIP_STORED)]))
    got = {r["page_id"]: (r["payload"], r["intact"]) for r in warc.read_archives(warc.packages_in(spark, str(tmp_path)), most=100).collect()}
    assert got == {str(i): (b"p" * i, True) for i in range(4)} | {"9": (b"changed", False)}


# ---- tokens


@pytest.fixture(scope="module")
def paths():
    return queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def models(paths):
    return alignment.Tokenizers(*paths)


AWKWARD = [
    "a  b   c\n d\n\n  e \t f", "  lead", "trail  ", " ", "   ", "\n", "é à  ü x", "日本語 テスト　 全角 空白", "<unk> <s> </s> <|endoftext|> x", "x\0y \0", "▁a ▁ b", "it's we'll 'quoted 's", "é ́ x", "a\r\n b\r\n", "<0x41> <0x0A>",
    "👩‍👩‍👧 ok", "\x7f a\x1f b \x85 c\x85 d", None, "", "x" * 9000, "word " * 4000,
]


def plain_tokens(t, text):
    """((n_a, n_b, n_groups, sha), links) by the tokenizers' own calls on the whole text."""
    none = ((0, 0, 0, ""), [])
    if not text:
        return none
    a, b = t.a_model.encode(" " + text, add_special_tokens=False).ids, t.b_model.encode(text)
    if any(b"".join(table[i] for i in x) != (" " + text).encode() for x, table in ((a, t.a_bytes), (b, t.b_bytes))):
        return none
    ends = [np.cumsum([len(table[i]) for i in x]).tolist() for x, table in ((a, t.a_bytes), (b, t.b_bytes))]
    groups, links, i, j = [], [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        x, y = ends[0].index(cut, i) + 1, ends[1].index(cut, j) + 1
        groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
        links.append((a[x - 1], b[y - 1]))
        i, j = x, y
    return (len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()), links


def test_segments_give_the_tokens_of_whole_texts(models):
    rng = random.Random(7)
    alphabet = [*" \n\t 　 ́abE'1é日👩.,-\r", "  ", "'s", "​", "\x1c", "\x85", "▁"]
    texts = AWKWARD + ["".join(rng.choices(alphabet, k=rng.randrange(1, 40))) for _ in range(1500)]
    for c in kernels.chunks(pa.array(texts, pa.string()), 4000):
        x = alignment.align(c, models)
        at = np.concatenate([[0], np.cumsum(x["per"])])
        for d in range(c.hi - c.lo):
            want, links = plain_tokens(models, texts[c.lo + d])
            assert (int(x["n_a"][d]), int(x["n_b"][d]), int(x["n_groups"][d]), x["sha"][d]) == want, texts[c.lo + d]
            own = dict(zip(x["codes"][at[d] : at[d + 1]].tolist(), x["times"][at[d] : at[d + 1]].tolist()))
            assert own == Counter(a * len(models.b_len) + b for a, b in links)


def test_a_worker_that_forgets(models, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 5)
    text = "one two three four five six seven"
    models.forget()
    for t in (text, text + " eight", "one"):
        (c,) = kernels.chunks(pa.array([t]))
        assert (alignment.align(c, models)["sha"][0]) == plain_tokens(models, t)[0][3]
    models.forget()


@pytest.mark.parametrize("head", [0, 3, 1 << 17])
def test_corpus_wide_numbers(spark, paths, models, head):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    rows += [(1000 + i, t) for i, t in enumerate(AWKWARD)] + [(rows[0][0], rows[0][1]), (None, "a row without an id")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, row int, codes int").repartition(4)
    plain = [(i, *plain_tokens(models, t)) for i, t in rows]
    count = Counter(x for _, _, links in plain for x in links)
    most: dict[int, int] = {}
    for (_, b), n in count.items():
        most[b] = max(n, most.get(b, 0))
    want = [(i, *p[:3], len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), p[3]) for i, p, links in plain]
    got = [tuple(r) for r in alignment.align_tokenizers(df, *paths, head=head).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_no_documents_to_align(spark, paths):
    assert alignment.align_tokenizers(spark.createDataFrame([], "doc_id long, text string"), *paths).collect() == []


# ---- search

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans(lexical.UPPER, lexical.LOWER)


def plain_search(docs, items, k):
    words = [(i, TERMS.findall((t or "").translate(FOLD))) for i, t in docs]
    words = [(i, w) for i, w in words if w]
    n, length = len(words), sum(len(w) for _, w in words)
    counts = [(i, Counter(w), 50 + 50 * len(w) * n // length) for i, w in words]
    df = Counter(t for _, c, _ in counts for t in c)
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERMS.findall((t or "").translate(FOLD)))
    out = []
    for i, terms in asked.items():
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in terms if t in df}
        scored = [(-sum(w * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t, w in weight.items() if t in c), d is None, d) for d, c, m in counts]
        best = sorted(x for x in scored if x[0] < 0)[:k] if not any(d is None for _, _, d in scored) else sorted((x for x in scored if x[0] < 0), key=lambda x: (x[0], x[1], x[2] or 0))[:k]
        out += [(i, r, d, -s) for r, (s, _, d) in enumerate(best, 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, k, shard_bytes=1 << 24, **kw):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, term string, shard int").repartition(3)
    q = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, score int")
    index, n = lexical.build_index(d, shard_bytes=shard_bytes)
    return sorted((tuple(r) for r in lexical.search(index, n, q, k=k, **kw).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("shard_bytes,kw", [(1 << 24, {}), (3000, {"first_part": 2}), (500, {"first_part": 3, "block_terms": 10})])
def test_same_ranks_as_all_scores(spark, shard_bytes, kw):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "naïve", "日本", "A1"]
    weight = [1 / (1 + i) for i in range(len(vocabulary))]
    docs = [(i, " ".join(rng.choices(vocabulary, weight, k=rng.randrange(1, 60)))) for i in range(700)]
    docs += [(700 + i, docs[5][1]) for i in range(30)] + [(900, None), (901, ""), (902, "!!! ..."), (903, "w1 " * 3000), (None, docs[5][1]), (5, docs[5][1])]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 9)))) for i in range(12)] + [(20, None), (21, ""), (22, "unheard"), (23, docs[5][1]), (None, "w2 w3"), (0, "w50")]
    assert found(spark, docs, items, 10, shard_bytes, **kw) == plain_search(docs, items, 10)


def test_nothing_to_search(spark):
    docs = [(1, "some words")]
    assert found(spark, docs, [], 5) == [] and found(spark, [], [(1, "some")], 5) == []
    assert found(spark, docs, [(1, "Some")], 5) == plain_search(docs, [(1, "Some")], 5)


def test_blocks_below_the_threshold_stay_packed():
    n = 40 * lexical.BLOCK
    docs = np.arange(n)
    rare = np.array([3, 900, 4000])
    of = np.concatenate([np.zeros(n, np.int64), np.ones(3, np.int64)])
    b = lexical._blocks(of, np.concatenate([docs, rare]), np.concatenate([np.full(n, 10), np.full(3, 1000)]))
    cut = np.searchsorted(b["term"], 1)
    at = lambda lo, hi: lexical.Postings(*[b[c][lo:hi].astype(np.int64) for c in ("first", "last", "n", "most")], b["offs"][lo : hi + 1], b["data"])
    common, seldom = at(0, cut), at(cut, len(b["term"]))
    got, scores = lexical.best([(1, common), (5, seldom)], 3, 0, n)
    assert got.tolist() == rare.tolist() and scores.tolist() == [5010] * 3
    assert common.ready.sum() == 3 < len(common.ready) and seldom.ready.all()


def test_numbers_as_bytes():
    x = np.array([0, 1, 127, 128, 16383, 16384, 1 << 21, (1 << 35) + 5, 1 << 40])
    raw, at = lexical.varints(x)
    assert lexical.unvarints(raw).tolist() == x.tolist() and at[0] == 0 and len(raw) == 1 + 1 + 1 + 2 + 2 + 3 + 4 + 6 + 6
