"""Substring dedup: passages of many words that an earlier document has, found by difference-cover anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

#: Perfect difference sets: every number below the period is the difference of two members modulo the period.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52)}


def _anchors(size: int, period: int):
    anchor = size - period + 1
    cover = np.isin(np.arange(period), COVERS[period])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.invert(batch.column("copy")))
            for c in K.chunks(batch.column(1)):
                w = K.words(c.data, c.offs)
                h = K.window_hashes(K.word_hashes(c.data, w), anchor)
                place, counts = w.place()[: len(h)], np.repeat(w.counts, w.counts)[: len(h)]
                at = np.flatnonzero(cover[place % period] & (place + anchor <= counts) & (counts >= size))
                doc = np.repeat(np.arange(c.lo, c.hi), w.counts)[at]
                yield pa.RecordBatch.from_arrays([K.signed(h[at]), batch.column(0).take(pa.array(doc)), pa.array(place[at] | _row(batch)[doc] << 32)], names=["h", "id", "pos"])

    return run


def _row(batch: pa.RecordBatch) -> np.ndarray:
    """The number of each row among those of its id, which stands above a place's lower 32 bits."""
    return batch.column("row").to_numpy().astype(np.int64)


def _own(batch: pa.RecordBatch, c: K.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The places of a chunk's rows among those gathered for their ids, and how many each row has."""
    ends, where = batch.column("at").offsets.to_numpy(), batch.column("at").values.to_numpy()
    at = where[ends[c.lo] : ends[c.hi]]
    doc = np.repeat(np.arange(c.lo, c.hi), np.diff(ends[c.lo : c.hi + 1]))
    mine = at >> 32 == _row(batch)[doc]
    return at[mine] & 0xFFFFFFFF, np.bincount(doc[mine] - c.lo, minlength=c.hi - c.lo)


def _windows(size: int, period: int):
    """Hashes of the windows of size words around a document's shared anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in K.chunks(batch.column(1)):
                w = K.words(c.data, c.offs)
                h, g = (K.window_hashes(K.word_hashes(c.data, w, seed=k), size) for k in (0, 1))
                n = int(w.ptr[-1])
                mark = np.zeros(n + 1, np.int32)
                at, per = _own(batch, c)
                at = at + np.repeat(w.ptr[:-1], per)
                low = np.maximum(at - (period - 1), np.repeat(w.ptr[:-1], per))
                np.add.at(mark, low, 1)
                np.add.at(mark, at + 1, -1)
                near = np.cumsum(mark[:n])[: len(h)] > 0
                i = np.flatnonzero(near & (w.left()[: len(h)] >= size))
                doc = np.repeat(np.arange(c.lo, c.hi), w.counts)[i]
                yield pa.RecordBatch.from_arrays([K.signed(h[i]), K.signed(g[i]), batch.column(0).take(pa.array(doc)), pa.array(w.place()[i] | _row(batch)[doc] << 32)], names=["h", "g", "id", "pos"])

    return run


def _cut(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copy = batch.column("copy").to_numpy(zero_copy_only=False)
            for c in K.chunks(batch.column(1)):
                w = K.words(c.data, c.offs)
                n = int(w.ptr[-1])
                mark = np.zeros(n + size + 1, np.int32)
                at, per = _own(batch, c)
                at = at + np.repeat(w.ptr[:-1], per)
                np.add.at(mark, at, 1)
                np.add.at(mark, at + size, -1)
                gone = np.cumsum(mark)[:n] > 0
                gone |= np.repeat(copy[c.lo : c.hi] & (w.counts >= size), w.counts)
                raw = c.data.tobytes()
                texts, shas, removed = [], [], []
                for d in range(c.hi - c.lo):
                    a, b = int(w.ptr[d]), int(w.ptr[d + 1])
                    k = int(gone[a:b].sum())
                    own = raw[c.offs[d] : c.offs[d + 1]]
                    if k:  # words are bytes between ASCII spaces, so a run of kept words is one slice split anew
                        edge = np.flatnonzero(np.diff(np.concatenate([[True], gone[a:b], [True]]).astype(np.int8)))
                        runs = [raw[w.starts[a + x] : w.ends[a + y - 1]] for x, y in zip(edge[::2].tolist(), edge[1::2].tolist())]
                        kept = b" ".join(b" ".join(r.split()) for r in runs)
                        texts.append(kept.decode())
                    else:
                        kept = b" ".join(own.split())
                        texts.append(None if batch.column(1)[c.lo + d].as_py() is None else own.decode())
                    removed.append(k)
                    shas.append(hashlib.sha256(kept).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(c.lo, c.hi - c.lo), pa.array(w.counts), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string()), *[x.slice(c.lo, c.hi - c.lo) for x in batch.columns[5:]]],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", *batch.schema.names[5:]],
                )

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 50, period: int = 31, carry: tuple[str, ...] = ()) -> DataFrame:
    """Columns (doc_id, n_words, n_removed, kept_sha256, kept_text, *carry) for each row of docs.

    Words are runs of other characters than space and \\t \\n \\v \\f \\r. A word goes if a window of size words that covers
    it, judged on the input, also starts in a document with a smaller id. kept_text is the text unchanged if nothing
    goes, else the kept words joined by spaces; kept_sha256 is that of the kept words joined by spaces.

    Texts that equal one with a smaller id are set aside first: all their windows are there. For the others:

    1. Windows of size - period + 1 words are hashed only where their place modulo period is in a difference cover.
       Two equal passages of size words, whatever their places, have an anchor of each at the same distance.
    2. Anchors seen in two documents (by smallest and largest id, partial aggregates) are extended: all windows of size
       words that hold such an anchor are hashed, twice and independently, so that windows are told apart by 128 bits, and the
       smallest id that has each is found, again by aggregation.
    3. Each document marks the words of the windows that a smaller id has.
    No pairs of documents are made at any point, so a passage that a third of the documents share costs its occurrences. All
    occurrences of one window do meet in one task, though, as (hash, id, place) rows that are sorted with spilling.

    Defined cases: null and empty texts have no words (kept_text is as given). Words within one document never
    count against itself. Rows that repeat an id are one document for this purpose and aren't compared with each other;
    an id is taken to stand for one text.
    Rows with a null id lose nothing and make no others lose. An empty table gives an empty result.
    """
    if period not in COVERS or period > size:
        raise ValueError(f"period must be one of {sorted(COVERS)} and at most size")
    rest = [f"carry_{c}" for c in carry]
    whole = F.col(text_col) if dict(docs.dtypes)[text_col] == "string" else F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).alias("id"), whole if text_col == "text" else whole.alias("text"), *[F.col(c).alias(f"carry_{c}") for c in carry])
    kind = dict(base.dtypes)["id"]
    text = F.coalesce("text", F.lit(""))
    named = base.where("id is not null")
    digests = named.select("id", F.xxhash64(text).alias("d1"), F.xxhash64(text, F.lit(1)).alias("d2"))
    least = digests.groupBy("d1", "d2").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("d1", "d2", "lo")
    copies = digests.join(least, ["d1", "d2"]).where("id > lo").select("id", F.col("d1").alias("copied"), F.lit(None).cast("long").alias("several"))
    several = digests.groupBy("id").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi")).where("lo < hi").select("id")
    several = digests.join(several, "id", "left_semi").select("id", F.lit(None).cast("long").alias("copied"), F.col("d1").alias("several"))
    marks = copies.unionByName(several).groupBy("id").agg(F.collect_set("copied").alias("copied"), F.sort_array(F.collect_set("several")).alias("several"))
    # the same exchange of texts by id stands below all three uses, so texts are shuffled once; a filter that the planner
    # infers for only one of the joins would make exchanges differ, so rows without an id go their own way
    digest = F.xxhash64(text)
    row = F.greatest(F.coalesce(F.array_position("several", digest), F.lit(0)) - 1, F.lit(0)).cast("int").alias("row")
    dealt = named.join(marks, "id", "left").select("id", "text", F.coalesce(F.array_contains("copied", digest), F.lit(False)).alias("copy"), row, *rest)
    # dealt out by hash once, and both counted and looked up from there. The exchanges of both uses are the same one only if these have
    # the same filters and columns: so nulls are ruled out here, not where the planner infers it, and the counts take every column
    ids = [F.min("id").alias("lo"), F.max("id").alias("hi"), F.max("pos").alias("pos")]
    anchors = dealt.mapInArrow(_anchors(size, period), f"h long, id {kind}, pos long").where("h is not null and id is not null").repartition("h")
    shared = anchors.groupBy("h").agg(*ids).where("lo < hi and pos is not null").select("h")
    near = anchors.join(shared, "h").groupBy("id").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    windows = dealt.join(near, "id").select("id", "text", "copy", "row", "at", *rest).mapInArrow(_windows(size, period), f"h long, g long, id {kind}, pos long").where("h is not null and g is not null and id is not null").repartition("h", "g")
    first = windows.groupBy("h", "g").agg(*ids).where("lo < hi and pos is not null").select("h", "g", "lo")
    doubled = windows.join(first, ["h", "g"]).where("id > lo").groupBy("id").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    out = dealt.join(doubled, "id", "left").select("id", "text", "copy", "row", F.coalesce("at", F.array().cast("array<long>")).alias("at"), *rest)
    out = out.unionByName(base.where("id is null").select("id", "text", F.lit(False).alias("copy"), F.lit(0).alias("row"), F.array().cast("array<long>").alias("at"), *rest))
    kinds = "".join(f", {c} {dict(base.dtypes)[c]}" for c in rest)
    cut = out.mapInArrow(_cut(size), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string{kinds}")
    return cut.select("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", *[F.col(f"carry_{c}").alias(c) for c in carry])
