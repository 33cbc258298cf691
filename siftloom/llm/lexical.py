"""Ranked lexical search: an index of compressed posting blocks with their maximum impacts, searched by Block-Max WAND."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import ship, written

#: Postings of a block.
BLOCK = 128
TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms_of(text: Column) -> Column:
    """The terms of a text, in order and with repeats."""
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [K.words(c.data, c.offs, K.PUNCT).counts for c in K.chunks(batch.column(0))]
        yield pa.RecordBatch.from_arrays([pa.array([int(sum((x > 0).sum() for x in n))]), pa.array([int(sum(x.sum() for x in n))])], names=["docs", "terms"])


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes of seven bits each, the last below 128, and where each begins."""
    v = values.astype(np.uint64)
    size = 1 + sum((v >= (1 << 7 * k)).astype(np.int64) for k in range(1, 10))
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for k in range(int(size.max()) if len(v) else 0):
        some = size > k
        out[at[some] + k] = ((v[some] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | np.where(size[some] > k + 1, 128, 0).astype(np.uint8)
    return out, at


def unvarints(raw: np.ndarray) -> np.ndarray:
    if not len(raw):
        return np.zeros(0, np.int64)
    last = raw < 128
    at = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(at, np.diff(np.append(at, len(raw))))
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), at)


def _blocks(of_term: np.ndarray, docs: np.ndarray, impacts: np.ndarray) -> dict[str, np.ndarray]:
    """Blocks of BLOCK postings at most, of one term each; postings are sorted by term and document.

    A block is the distances of its documents from one to the next, then their impacts.
    """
    begin = np.flatnonzero(np.diff(of_term, prepend=-1))
    inside = np.arange(len(docs)) - np.repeat(begin, np.diff(np.append(begin, len(docs))))
    start = np.flatnonzero(inside % BLOCK == 0)
    n = np.diff(np.append(start, len(docs)))
    gaps = np.diff(docs, prepend=0)
    gaps[start] = 0
    place = np.arange(len(docs)) + np.repeat(start, n)
    values = np.empty(2 * len(docs), np.int64)
    values[place], values[place + np.repeat(n, n)] = gaps, impacts
    data, at = varints(values)
    return {"term": of_term[start], "first": docs[start], "last": docs[start + n - 1], "n": n, "most": np.maximum.reduceat(impacts, start), "data": data, "offs": np.append(at[2 * start], len(data))}


def _index(n_docs: int, n_terms: int, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not len(batch):
                continue
            batch = batch.take(pc.sort_indices(batch.column(0)))  # so that ties fall in the order of ids
            parts = -(-max(1, batch.column(1).nbytes) // shard_bytes)
            for c in K.chunks(batch.column(1), batch.column(1).nbytes // parts + 1):
                w = K.words(c.data, c.offs, K.PUNCT)
                if not len(w.starts):
                    continue
                edges = np.append(np.column_stack([w.starts, w.ends]).reshape(-1), w.ends[-1])
                spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(K.LOWER[c.data])])
                spans = spans.dictionary_encode()  # words, and what stands between them
                code = spans.indices.to_numpy()[::2].astype(np.int64)
                doc = np.repeat(np.arange(c.hi - c.lo), w.counts)
                key, tf = np.unique(code << 32 | doc, return_counts=True)
                doc = key & 0xFFFFFFFF
                m = 50 + 50 * w.counts[doc] * n_docs // n_terms
                b = _blocks(key >> 32, doc, 1_000_000_000 * tf // (1000 * tf + 20 * m))
                count = len(b["n"])
                term = spans.dictionary.take(pa.array(b["term"])).cast(pa.binary()).cast(pa.string())
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), count, [None, pa.py_buffer(b["offs"].astype(np.int64)), pa.py_buffer(b["data"])]).cast(pa.binary())
                ids = batch.column(0).slice(c.lo, c.hi - c.lo)
                cut = np.append(np.arange(0, len(ids), 1024), len(ids)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cut), ids)
                ints = lambda x: pa.array(x.astype(np.int32))
                for x in (
                    [term, *[ints(b[k]) for k in ("first", "last", "n", "most")], data, pa.nulls(count, lists.type)],
                    [pa.array([""] * len(lists)), ints(cut[:-1]), ints(cut[1:] - 1), ints(np.diff(cut)), ints(0 * cut[1:]), pa.nulls(len(lists), pa.binary()), lists],
                ):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x[0]), shard)), *x], names=["shard", "term", "first", "last", "n", "most", "data", "ids"])
                shard += 1

    return run


@dataclass
class Postings:
    """The blocks of one term in a shard; they are decompressed when they are needed, and once."""

    first: np.ndarray
    last: np.ndarray
    n: np.ndarray
    most: np.ndarray
    offs: np.ndarray
    data: np.ndarray
    ready: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.ready = np.zeros(len(self.n), bool)
        self.begin = np.cumsum(self.n) - self.n
        self.docs = np.repeat(self.last, self.n)  # stays sorted while only some blocks are there
        self.impacts = np.zeros(len(self.docs), np.int64)

    def need(self, blocks: np.ndarray) -> None:
        """Decompress these blocks, all at once."""
        b = blocks[~self.ready[blocks]]
        if not len(b):
            return
        size = self.offs[b + 1] - self.offs[b]
        values = unvarints(self.data[np.repeat(self.offs[b] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))])
        n = self.n[b]
        start = np.cumsum(n) - n
        own = np.arange(int(n.sum())) + np.repeat(start, n)
        gaps, impacts = values[own], values[own + np.repeat(n, n)]
        upto = np.cumsum(gaps)
        to = np.arange(len(gaps)) + np.repeat(self.begin[b] - start, n)
        self.docs[to] = upto - np.repeat(upto[start] - self.first[b], n)
        self.impacts[to] = impacts
        self.ready[b] = True

    def of(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.n[block]
        at = np.repeat(self.begin[block] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return self.docs[at], self.impacts[at]


def best(lists: list[tuple[int, Postings]], k: int, least: int, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The k documents of highest score that is at least least and above 0, and their scores; of equal scores the smallest documents.

    lists: (weight, postings) of the query's terms. A document's bound is the sum of the maxima of the blocks that span its place: the
    shallow pointers of all lists, moved over the shard at once. Lists are taken by falling maxima, and bounds give way to impacts.
    A block in whose span no bound reaches the threshold is never decompressed. The threshold is the k-th sum of impacts so far.
    """
    lists = sorted((x for x in lists if x[0] > 0), key=lambda x: -x[0] * int(x[1].most.max()))
    if not lists:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    floor, edges = max(1, least), np.zeros(n_docs + 1, np.int64)
    for w, p in lists:
        edges[p.first] += w * p.most
        edges[p.last + 1] -= w * p.most
    bound, score = np.cumsum(edges)[:-1], np.zeros(n_docs, np.int64)
    live = np.zeros(n_docs + 1, np.int64)
    for w, p in lists:
        np.cumsum(bound >= floor, out=live[1:])
        if not live[-1]:
            break
        blocks = np.flatnonzero(live[p.last + 1] > live[p.first])
        edges[:] = 0
        edges[p.first] += w * p.most
        edges[p.last + 1] -= w * p.most
        bound -= np.cumsum(edges)[:-1]
        if len(blocks):
            p.need(blocks)
            docs, impacts = p.of(blocks)
            score[docs] += w * impacts
            bound[docs] += w * impacts
        if n_docs >= k:
            floor = max(floor, int(np.partition(score, n_docs - k)[n_docs - k]))
    docs = np.flatnonzero((bound >= floor) & (score > 0))
    docs = docs[np.lexsort((docs, -score[docs]))[:k]]
    return docs, score[docs]


def _searched(queries, k: int):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        table = table.sort_by([("term", "ascending"), ("first", "ascending")]).combine_chunks()
        names = table.column("term").to_pylist()
        cut = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
        ints = {c: table.column(c).to_numpy().astype(np.int64) for c in ("first", "last", "n", "most")}
        data = table.column("data").cast(pa.large_binary()).combine_chunks()
        data = data.chunk(0) if isinstance(data, pa.ChunkedArray) else data
        offs = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
        raw = np.frombuffer(data.buffers()[2], np.uint8) if data.buffers()[2] is not None and data.buffers()[2].size else np.zeros(0, np.uint8)
        held = {names[a]: Postings(*[ints[c][a:b] for c in ("first", "last", "n", "most")], offs[a : b + 1], raw) for a, b in zip(cut, cut[1:]) if names[a]}
        n_docs = int(ints["n"][: cut[1]].sum())  # the first rows are those of the documents' ids
        items, docs, scores = [], [], []
        for item, (least, terms) in enumerate(queries.value):
            lists = [(w, held[t]) for t, w in terms if t in held]
            if lists:
                d, s = best(lists, k, least, n_docs)
                items.append(np.full(len(d), item))
                docs.append(d)
                scores.append(s)
        docs = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        ids = table.column("ids").slice(0, cut[1]).combine_chunks()
        ids = (pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids).flatten()
        whole = lambda x: pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64))
        return pa.table({"item": whole(items), "shard": pa.array(np.full(len(docs), shard)), "doc_id": ids.take(pa.array(docs)), "score": whole(scores)})

    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 1 << 24) -> tuple[DataFrame, int]:
    """The index of docs and the number of documents with a term: columns (shard, term, first, last, n, most, data, ids).

    A shard is a run of documents of shard_bytes at most (or one longer text), numbered from 0 in the order of their ids. A row is a block of 128
    postings of a term at most, with its first and last document and its maximum impact; rows of the term '' have the documents' ids.
    An impact is (1000000000 * tf) div (1000 * tf + 20 * m), with m = 50 + (50 * n * N) div L. The index is a table in the shared folder.
    """
    ship(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    n_docs, n_terms = base.select("text").mapInArrow(_sizes, "docs long, terms long").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    kind = dict(base.dtypes)["id"]
    rows = base.mapInArrow(_index(n_docs, max(1, n_terms), shard_bytes), f"shard long, term string, first int, last int, n int, most int, data binary, ids array<{kind}>")
    return written(rows), n_docs


def search(index: DataFrame, n_docs: int, items: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text", block_terms: int = 200_000, first_part: int = 16) -> DataFrame:
    """Columns (item_id, rank, doc_id, score): the k documents of highest score above 0 for each item, equal scores by ascending id.

    A term's weight is floor(1000 * ln((2 * N + 2) / (2 * df + 1))); a score sums weight * impact over an item's terms, once each.

    Items are taken in blocks of about block_terms terms, which go to every worker with their weights; any number of blocks may follow. Of each
    block, one shard of first_part is searched first, and the k-th score there is the threshold that the other shards begin with: it can
    only be too low, so no result is lost. Each shard gives k rows for an item at most, and only those that reach the threshold.

    Defined cases: an item without terms has no rows. Rows that repeat an item's id are one item with all their terms; so are those with a null
    id. Documents without terms are never found. Rows that repeat a document's id are documents of their own; a null id comes last among
    equal scores. Empty tables give an empty result. Other columns are ignored.
    """
    spark = index.sparkSession
    ship(spark)
    terms = items.groupBy(F.col(id_col).alias("item_id")).agg(F.array_distinct(F.flatten(F.collect_list(terms_of(F.col(text_col))))).alias("terms")).where("size(terms) > 0")
    terms = written(terms)
    kind = {c: t for c, t in index.dtypes}["ids"][len("array<") : -1]
    blocks = -(-(terms.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]) // block_terms)
    found = None
    for b in range(blocks):
        own = terms.where(F.pmod(F.xxhash64(F.to_json(F.struct("item_id"))), F.lit(blocks)) == b).orderBy("item_id").collect()  # a block of queries, bounded
        needed = spark.createDataFrame([(t,) for t in sorted({t for r in own for t in r["terms"]} | {""})], "term string")
        rows = index.join(F.broadcast(needed), "term", "left_semi")
        df = dict(rows.where("term <> ''").groupBy("term").agg(F.sum("n")).collect())  # no more than the block's terms
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
        queries = [[(t, weight[t]) for t in r["terms"] if t in weight] for r in own]

        def part(first: bool, least: list[int]) -> DataFrame:
            chosen = (F.pmod(F.xxhash64("shard"), F.lit(first_part)) == 0) == F.lit(first)
            shared = spark.sparkContext.broadcast(list(zip(least, queries)))
            return rows.where(chosen).groupBy("shard").applyInArrow(_searched(shared, k), f"item long, shard long, doc_id {kind}, score long")

        one = written(part(True, [0] * len(own)))
        ranked = one.withColumn("rank", F.expr("row_number() over (partition by item order by score desc)")).where(F.col("rank") == k)
        reached = dict(ranked.select("item", "score").collect())  # a number for each item of the block
        both = one.unionByName(part(False, [reached.get(i, 0) for i in range(len(own))]))
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(own)], terms.select(F.lit(0).cast("long").alias("item"), "item_id").schema)
        both = both.withColumn("rank", F.expr("row_number() over (partition by item order by score desc, doc_id asc nulls last)")).where(F.col("rank") <= k)
        both = both.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        found = both if found is None else found.unionByName(both)
    if found is None:
        return terms.select("item_id", F.lit(0).alias("rank"), F.lit(None).cast(kind).alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    return found
