"""Two tokenizers side by side: which tokens of a text end together, and how often a pair of ids does so in the whole corpus."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import ship, written

#: Segments that a worker remembers at most, about 200 bytes each.
REMEMBERED = 400_000


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@dataclass
class Ragged:
    """Lists of ids, one after the other."""

    ids: np.ndarray
    at: np.ndarray
    n: np.ndarray

    def plus(self, lists: list[list[int]]) -> Ragged:
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter(chain.from_iterable(lists), np.int32, int(n.sum()))
        return Ragged(np.concatenate([self.ids, ids]), np.concatenate([self.at, len(self.ids) + np.cumsum(n) - n]), np.concatenate([self.n, n]))

    def of(self, index: np.ndarray) -> np.ndarray:
        """The ids of the lists with these numbers."""
        at, n = self.at[index], self.n[index]
        return self.ids[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


class Tokenizers:
    """A byte-level BPE (A) and a sentence-piece model (B), with the length of each id's bytes and what short texts become."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tokenizers

        self.a_model = tokenizers.Tokenizer.from_file(a_path)
        self.a_model.encode_special_tokens = True
        self.b_model = sentencepiece.SentencePieceProcessor(model_file=b_path)
        value = byte_values()
        vocabulary = json.loads(self.a_model.to_str())["model"]["vocab"]
        self.a_bytes = [b""] * self.a_model.get_vocab_size()
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(value[c] for c in token)
        pieces = [self.b_model.id_to_piece(i) for i in range(self.b_model.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b_model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        self.forget()
        na, nb = len(self.a_bytes), len(self.b_bytes)
        # what is written for an id: A inside a group and at its begin, B at its begin and inside
        self.written = pa.array([f",{i}" for i in range(na)] + [f";{i}" for i in range(na)] + [f"|{i}" for i in range(nb)] + [f",{i}" for i in range(nb)], pa.large_string())

    def forget(self) -> None:
        none = np.zeros(0, np.int64)
        self.known: dict[str, int] = {}
        self.a, self.b, self.same = Ragged(none.astype(np.int32), none, none), Ragged(none.astype(np.int32), none, none), none.astype(bool)

    def encode(self, segments: list[str]) -> np.ndarray:
        """Where self.a, self.b and self.same have the ids of each segment, and whether both have its bytes. Segments begin with a space."""
        fresh = [s for s in segments if s not in self.known]
        if len(self.known) + len(fresh) > REMEMBERED and self.known:
            self.forget()
            fresh = segments
        if fresh:
            a = [x.ids for x in self.a_model.encode_batch(fresh, add_special_tokens=False)]
            b = self.b_model.encode([s[1:] for s in fresh], num_threads=1)
            b = [x if s != " " else [self.b_model.piece_to_id("▁")] for s, x in zip(fresh, b)]  # B adds no space to nothing
            of = lambda ids, table: b"".join([table[i] for i in ids])
            same = [of(x, self.a_bytes) == (raw := s.encode()) and of(y, self.b_bytes) == raw for s, x, y in zip(fresh, a, b)]
            self.a, self.b, self.same = self.a.plus(a), self.b.plus(b), np.concatenate([self.same, np.array(same, bool)])
            self.known |= zip(fresh, range(len(self.known), len(self.known) + len(fresh)))
        return np.fromiter(map(self.known.__getitem__, segments), np.int64, len(segments))


@lru_cache(maxsize=1)
def _loaded(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


def spaced(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a chunk with a space before each text that isn't empty, and the texts' offsets in these."""
    some = np.diff(offs) > 0
    shift = np.concatenate([[0], np.cumsum(some)])
    out = np.full(len(data) + int(shift[-1]), 0x20, np.uint8)
    out[np.arange(len(data)) + np.repeat(shift[1:], np.diff(offs))] = data
    return out, offs + shift


def segment_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where texts can be cut without changing a token of either tokenizer: before a space that follows what surely isn't white space.

    A's words begin there by its pattern, and none of B's pieces has a space after another character. After a character beyond ASCII that
    may be white space there is no cut.
    """
    n = len(data)
    cut = np.zeros(n, bool)
    p1 = data[:-1]
    plain = (p1 > 0x20) & (p1 != 0x7F)
    high = np.flatnonzero((p1 >= 0x80) & (data[1:] == 0x20))
    high = high[high >= 2]
    p2, p3 = data[high - 1], data[high - 2]
    plain[high[(p2 == 0xC2) | (np.isin(p3, (0xE1, 0xE2, 0xE3)) & np.isin(p2, (0x9A, 0x80, 0x81)))]] = False
    cut[1:] = (data[1:] == 0x20) & plain
    cut[offs[:-1][np.diff(offs) > 0]] = True
    return np.flatnonzero(cut)


def align(c: K.Chunk, t: Tokenizers) -> dict[str, np.ndarray | list]:
    """Of each document of a chunk n_a, n_b, n_groups, groups_sha256, and its distinct linked id pairs (code: A * |B| + B) with their numbers.

    All documents are one byte string. The ends of A's and of B's tokens are counted by place once; where both occur is a cut; sums of
    these counts up to each document's end give its numbers.
    """
    docs = c.hi - c.lo
    data, offs = spaced(c.data, c.offs)
    if not len(data):
        zero = np.zeros(docs, np.int64)
        return {"n_a": zero, "n_b": zero, "n_groups": zero, "sha": [""] * docs, "codes": zero[:0], "times": zero[:0], "per": zero}
    starts = segment_starts(data, offs)
    segments = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)).dictionary_encode()
    index = t.encode(segments.dictionary.to_pylist())[segments.indices.to_numpy()]
    # only documents all of whose segments come out as they are have tokens
    doc = np.searchsorted(offs, starts, "right") - 1
    fine = np.diff(offs) > 0
    fine[doc[~t.same[index]]] = False
    index = index[fine[doc]]
    ends = np.cumsum(np.where(fine, np.diff(offs), 0))
    total, begins = int(ends[-1]), np.concatenate([[0], ends[:-1]])
    a, b = t.a.of(index), t.b.of(index)
    a_end, b_end = np.cumsum(t.a_len[a]), np.cumsum(t.b_len[b])

    at_a, at_b = np.bincount(a_end, minlength=total + 1), np.bincount(b_end, minlength=total + 1)
    cut = (at_a > 0) & (at_b > 0)
    of_docs = lambda x: (s := np.cumsum(x))[ends] - s[begins]
    n_a, n_b, n_groups = of_docs(at_a), of_docs(at_b), of_docs(cut)

    # no token is empty, so a cut ends one token of A and one of B: a link
    a_cut, b_cut = cut[a_end], cut[b_end]
    code = a[a_cut].astype(np.int64) * len(t.b_len) + b[b_cut]
    of = np.repeat(np.arange(docs, dtype=np.int64), n_groups)
    key, times = np.unique(of << 40 | code, return_counts=True)

    # tokens in the order in which they are written: group by group, A's before B's
    a_group, b_group = np.cumsum(a_cut) - a_cut, np.cumsum(b_cut) - b_cut
    a_before, b_before = np.flatnonzero(a_cut) + 1, np.concatenate([[0], np.flatnonzero(b_cut) + 1])
    order = np.empty(len(a) + len(b), np.int64)
    first = lambda x: np.concatenate([[True], x[:-1]]) if len(x) else x
    order[np.arange(len(a)) + b_before[a_group]] = a + np.where(first(a_cut), len(t.a_len), 0)
    order[np.arange(len(b)) + a_before[b_group]] = 2 * len(t.a_len) + b + np.where(first(b_cut), 0, len(t.b_len))
    text = t.written.take(pa.array(order))
    place = np.frombuffer(text.buffers()[1], np.int64)[: len(order) + 1] if len(order) else np.zeros(1, np.int64)
    raw = memoryview(text.buffers()[2]) if len(order) else b""
    upto = np.concatenate([[0], np.cumsum(n_a + n_b)])
    lo, hi = place[upto[:-1]].tolist(), place[upto[1:]].tolist()
    sha = [hashlib.sha256(raw[x + 1 : y]).hexdigest() if y > x else "" for x, y in zip(lo, hi)]
    return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "sha": sha, "codes": key & ((1 << 40) - 1), "times": times, "per": np.bincount(key >> 40, minlength=docs)}


def _aligned(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _loaded(a_path, b_path)
        for batch in batches:
            for c in K.chunks(batch.column(1)):
                x = align(c, t)
                where = pa.array(np.concatenate([[0], np.cumsum(x["per"])]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(where, pa.array(x[n].astype(np.int64))) for n in ("codes", "times")]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(c.lo, c.hi - c.lo), *[pa.array(x[n].astype(np.int64)) for n in ("n_a", "n_b", "n_groups")], pa.array(x["sha"], pa.string()), *lists],
                    names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "codes", "times"],
                )

    return run


def _looked_up(head):
    """Sums over the pairs of the head, and the other pairs as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, count, best = head.value
        for batch in batches:
            codes, times = (batch.column(n) for n in ("codes", "times"))
            ptr = codes.offsets.to_numpy().astype(np.int64)
            c, k = codes.values.to_numpy()[ptr[0] : ptr[-1]], times.values.to_numpy()[ptr[0] : ptr[-1]]
            ptr = ptr - ptr[0]
            at = np.minimum(np.searchsorted(code, c), max(0, len(code) - 1))
            held = code[at] == c if len(code) else np.zeros(len(c), bool)
            sums = []
            for value in (k * (held & best[at]), k * held * count[at]) if len(code) else (k * 0, k * 0):
                s = np.concatenate([[0], np.cumsum(value)])
                sums.append(pa.array(s[ptr[1:]] - s[ptr[:-1]]))
            left = np.concatenate([[0], np.cumsum(~held)])[ptr].astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(left), pa.array(x[~held])) for x in (c, k)]
            own = [batch.column(n) for n in batch.schema.names if n not in ("codes", "times")]
            yield pa.RecordBatch.from_arrays([*own, *sums, *rest], names=[*[n for n in batch.schema.names if n not in ("codes", "times")], "n_best", "count_sum", "codes", "times"])

    return run


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", head: int = 1 << 17) -> DataFrame:
    """Columns (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of docs.

    A is a byte-level BPE and reads a space and the text, B a sentence-piece model that adds the space itself. Offsets where a token of A and
    one of B end cut the tokens into groups; these two are linked. n_best: links whose pair is linked as often in the whole corpus as any
    pair of its B id. count_sum: those corpus-wide numbers, summed over links. groups_sha256 is that of the groups as text.

    1. One pass over whole texts, a batch of documents as one byte string. Texts are cut where neither tokenizer can join anything,
       and each distinct segment of a batch is encoded once. The documents' distinct pairs are written as a table in the shared folder, so
       that texts are tokenized once.
    2. Numbers of all pairs, by partial aggregation; the most frequent of each B id by another one.
    3. The pairs linked most often, head of them at most (24 bytes each), go to every worker, which sums over them at once. A bound in powers
       of two, by a count of pairs for each, keeps to that number. All other pairs are joined with their numbers by pair; none of them is
       frequent. Both ways are always taken, and the bound changes no result.

    Defined cases: null and empty texts, and texts that don't come out as they went in (with U+2581, which B reads as a space), have no
    tokens: zeros and ''. Special tokens' strings are plain text. Rows that repeat an id are texts of their own, and so are rows with a null
    id. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = base.mapInArrow(_aligned(a_path, b_path), f"doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, codes array<long>, times array<long>")
    rows = written(found.withColumn("row", F.monotonically_increasing_id()))
    nb = len(_loaded(a_path, b_path).b_len)

    pairs = rows.select(F.inline(F.arrays_zip("codes", "times"))).toDF("code", "k").groupBy("code").agg(F.sum("k").alias("n"))
    pairs = written(pairs)
    most = pairs.groupBy((F.col("code") % nb).alias("b")).agg(F.max("n").alias("most"))  # a row for each id of B at most
    pairs = pairs.withColumn("b", F.col("code") % nb).join(F.broadcast(most), "b").select("code", "n", (F.col("n") == F.col("most")).alias("best"))
    power = F.length(F.bin("n"))
    held, least = 0, 65
    for p, n in sorted(pairs.groupBy(power.alias("p")).agg(F.count("*").alias("n")).collect(), reverse=True):  # 64 rows at most
        if held + n > head:
            break
        held, least = held + n, p
    top = pairs.where(power >= least).toArrow()
    code = top.column("code").to_numpy()
    order = np.argsort(code)
    values = (code[order], top.column("n").to_numpy()[order], top.column("best").to_numpy()[order].astype(bool))
    own = f"doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, row long"
    summed = rows.select("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "row", "codes", "times").mapInArrow(_looked_up(spark.sparkContext.broadcast(values)), f"{own}, n_best long, count_sum long, codes array<long>, times array<long>")
    summed = written(summed)
    tail = summed.select("row", F.inline(F.arrays_zip("codes", "times"))).toDF("row", "code", "k")
    tail = tail.join(pairs.where(power < least).hint("merge"), "code").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("more_best"), F.sum(F.col("k") * F.col("n")).alias("more_sum"))
    whole = lambda x, y: (F.col(x) + F.coalesce(y, F.lit(0))).alias(x)
    return summed.drop("codes", "times").join(tail.hint("merge"), "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), whole("n_best", "more_best"), whole("count_sum", "more_sum"), "groups_sha256"
    )
