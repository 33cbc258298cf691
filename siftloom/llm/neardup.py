"""Near-duplicate documents: SuperMinHash, banding, verification on full sets, union-find."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import checkpoint
from .graph import components


def _signatures(size: int, slots: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in K.chunks(batch.column(2)):
                h, ptr = K.shingles(c.data, c.offs, size)
                n = np.diff(ptr)
                some = np.flatnonzero(n)
                name = np.zeros((c.hi - c.lo, 2), np.uint64)
                if len(some):
                    name[some, 0] = np.add.reduceat(K.mix64(h), ptr[:-1][some])
                    name[some, 1] = np.bitwise_xor.reduceat(K.mix64(h + np.uint64(1)), ptr[:-1][some])
                sig = K.superminhash(h, ptr, slots)
                keys, low = K.bands(sig, rows), np.ascontiguousarray(sig.astype(np.uint8))
                lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), K.signed(x.reshape(-1)))
                places = pa.py_buffer(np.arange(0, 16 * (len(n) + 1), 16, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*[x.slice(c.lo, c.hi - c.lo) for x in batch.columns[:2]], pa.Array.from_buffers(pa.binary(), len(n), [None, places, pa.py_buffer(name)]), pa.array(n), lists(keys), lists(low.view(np.uint64))],
                    names=["id", "digest", "key", "n", "bands", "low"],
                )

    return run


def _elements(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in K.chunks(batch.column(1)):
                h, ptr = K.shingles(c.data, c.offs, size)
                doc = np.repeat(np.arange(c.lo, c.hi), np.diff(ptr))
                yield pa.RecordBatch.from_arrays([K.signed(h), batch.column(0).take(pa.array(doc))], names=["h", "short"])

    return run


def _verify(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            left = K.chunks(batch.column(2), 1 << 20)
            for c in left:
                ha, pa_ = K.shingles(c.data, c.offs, size)
                for d in K.chunks(batch.column(3).slice(c.lo, c.hi - c.lo), 1 << 30):
                    hb, pb = K.shingles(d.data, d.offs, size)
                    for i in range(d.hi - d.lo):
                        k = d.lo + i
                        x, y = ha[pa_[k] : pa_[k + 1]], hb[pb[i] : pb[i + 1]]
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        keep.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keep, pa.bool_())], names=["a", "b", "linked"])

    return run


def _alike(a: str, b: str, slots: int) -> Column:
    """How many of the slots' low bytes are equal, eight to a number: the bits of each byte that differs are folded into its lowest."""
    differ = F.lit(0)
    for i in range(slots // 8):
        x = F.get(a, i).bitwiseXOR(F.get(b, i))
        for k in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, k))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return F.lit(slots) - differ


def _least_alike(slots: int, share: float) -> int:
    """Equal slots that a link has but for a small chance (3.0e-6 for 96 slots and 0.8): 4.75 standard deviations below the mean at the threshold."""
    return math.floor(slots * share - 4.75 * math.sqrt(slots * share * (1 - share)))


def _first_shared(a: str, b: str, n: int) -> Column:
    """The first bucket that two arrays of bands share, band by band."""
    return F.coalesce(*[F.when(F.get(a, i) == F.get(b, i), F.get(a, i)) for i in range(n)])


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, n_bands: int = 24, rows: int = 4, leaders: int = 4, rare: int = 64
) -> DataFrame:
    """Columns (id, n_shingles, component_id, kept, digest) for each row of docs.

    A document is the set of its distinct shingles of size lower-cased words (its whole sequence if it has fewer).
    Documents are linked if percent / 100 of the union of their sets is common to both, and component_id is the
    smallest id that a document reaches by links. digest is the xxhash64 of the text, so that rows can be told apart
    where an id repeats.

    1. Documents with equal sets become one class, named by two 64-bit sums of the set, before anything is compared.
    2. SuperMinHash of n_bands * rows slots for each class, banded. A link of exactly 0.8 shares no band with a chance
       of (1 - 0.8 ** rows) ** n_bands, 3e-6 by default.
    3. In each bucket all classes are compared on their full sets with its hub, the class that shares buckets most, which
       gives linear many pairs. The original that copies were made from is such a hub.
    4. Classes of buckets that still hold several components are compared by what they have in few: a shingle is rare if at
       most so many of these classes have it. The intersection of two sets is at most the smaller of their numbers of
       shingles that aren't rare, plus the rare ones that both have. So pairs are made from shared rare shingles,
       at most rare of them for each, counted, and compared where the count suffices. No link is lost by that.
    5. What is left are pairs whose shingles that aren't rare could make a link alone, as among texts between two thresholds of
       one original that isn't there. Each bucket gets more leaders (4, then 32 times as many each round), each compared
       with such classes of other components whose signatures agree in enough slots (a link of exactly 0.8 fails that with
       a chance of 3.0e-6 by default), in the first bucket that a pair shares, until every such pair is compared or connected.

    Defined cases: null and empty texts and texts of white space have n_shingles 0 and are their own component. Rows
    that repeat an id are texts of their own: each gets the component of its text and is kept if that has its id, so
    equal rows are kept together. A null id is in no component but its own (null; kept is true). An empty table gives an
    empty result. Other columns are ignored.
    """
    if n_bands * rows % 8:
        raise ValueError("n_bands * rows must be a multiple of 8")
    # both sides are shuffled before adaptive execution sees how small one is; turning such joins into broadcasts then only costs
    # the driver memory and threads, of which this many joins would keep hundreds
    merge = lambda df: df.hint("merge")
    text = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    kind = dict(base.dtypes)["id"]
    sig = checkpoint(base.mapInArrow(_signatures(size, n_bands * rows, rows), f"id {kind}, digest long, key binary, n long, bands array<long>, low array<long>"))
    known = sig.where("n > 0 and id is not null")
    classes = checkpoint(known.groupBy("key").agg(F.first("n").alias("n"), F.min(F.struct("id", "digest")).alias("one"), F.first("bands").alias("bands"), F.first("low").alias("low")))

    cells = classes.select(F.explode("bands").alias("bucket"), "key", "n")
    cells = cells.join(merge(cells.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1")), "bucket")
    hubs = cells.groupBy("key").agg(F.sum("k").alias("hub"))
    cells = checkpoint(cells.join(merge(hubs), "key").select("bucket", "key", "n", "hub"))
    wanted = classes.join(merge(cells.select("key").distinct()), "key", "left_semi").select("one.id", "one.digest", "key")
    texts = checkpoint(base.join(merge(wanted), ["id", "digest"]).groupBy("key").agg(F.first("text").alias("text")))
    verify = _verify(size, percent)

    def linked(pairs: DataFrame) -> DataFrame:
        left, right = texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), texts.select(F.col("key").alias("b"), F.col("text").alias("tb"))
        both = pairs.join(merge(left), "a").join(merge(right), "b").select("a", "b", "ta", "tb")
        return both.mapInArrow(verify, "a binary, b binary, linked boolean").where("linked").select("a", "b")

    near = lambda x, y: (F.least(x, y) * 100 >= F.greatest(x, y) * percent)  # noqa: E731  no link between sets of other sizes
    enough = lambda both, x, y: both * (100 + percent) >= (x + y) * percent  # noqa: E731  an intersection that makes a link
    lead = cells.groupBy("bucket").agg(F.max(F.struct("hub", "key", "n")).alias("lead")).select("bucket", F.col("lead.key").alias("leader"), F.col("lead.n").alias("leader_n"))
    first = cells.join(merge(lead), "bucket").where("key <> leader").where(near(F.col("n"), F.col("leader_n"))).select(F.least("leader", "key").alias("a"), F.greatest("leader", "key").alias("b")).distinct()
    edges = checkpoint(linked(first))
    roots = checkpoint(components(edges))

    def rooted(some: DataFrame) -> DataFrame:
        return some.join(merge(roots.select(F.col("node").alias("key"), "root")), "key", "left").withColumn("root", F.coalesce("root", "key"))

    def mixed(some: DataFrame) -> DataFrame:
        """Rows of buckets whose classes are in several components, under their roots of now."""
        now = rooted(some)
        several = now.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket")
        return now.join(merge(several), "bucket")

    rest = checkpoint(mixed(cells.join(merge(lead), "bucket").where("key <> leader").select("bucket", "key", "n", "hub")))
    # short stands for a key among the shingles; should two keys have the same, both are compared
    left = checkpoint(rest.select("key", "n", "root").distinct().withColumn("short", F.xxhash64("key")))
    sets = checkpoint(texts.join(merge(left), "key").select("short", "text").mapInArrow(_elements(size), "h long, short long"))
    shared = checkpoint(sets.groupBy("h").agg(F.count("*").alias("k")).where("k > 1"))
    held = sets.join(merge(shared), "h").groupBy("short").agg(F.count(F.when(F.col("k") > rare, 1)).alias("common"), F.count(F.when(F.col("k") <= rare, 1)).alias("few"))
    left = checkpoint(left.join(merge(held), "short").where((F.col("common") + F.col("few")) * 100 >= F.col("n") * percent))
    few = sets.join(merge(shared.where(F.col("k") <= rare).select("h")), "h").join(merge(left), "short").select("h", "key", "n", "root", "common")
    side = lambda x: few.select("h", *[F.col(c).alias(f"{c}_{x}") for c in ("key", "n", "root", "common")])
    pairs = side("a").join(merge(side("b")), "h").where((F.col("key_a") < F.col("key_b")) & (F.col("root_a") != F.col("root_b")) & near(F.col("n_a"), F.col("n_b")))
    pairs = pairs.groupBy(F.col("key_a").alias("a"), F.col("key_b").alias("b")).agg(F.count("*").alias("both"), F.first("n_a").alias("na"), F.first("n_b").alias("nb"), F.first(F.least("common_a", "common_b")).alias("common"))
    edges = checkpoint(edges.unionByName(linked(pairs.where(enough(F.col("both") + F.col("common"), F.col("na"), F.col("nb"))).select("a", "b"))))
    roots = checkpoint(components(edges))

    likely, more = _least_alike(n_bands * rows, percent / 100), leaders
    ranked = checkpoint(mixed(rest.drop("root", "n").join(merge(left.where(F.col("common") * 100 >= F.col("n") * percent).select("key", "n", "common")), "key")))
    sketches = checkpoint(classes.select("key", "bands", "low").join(merge(ranked.select("key").distinct()), "key", "left_semi"))
    fields = ("key", "n", "hub", "common", "root", "bands", "low")
    while ranked.count():
        head = checkpoint(ranked.withColumn("rank", F.expr("row_number() over (partition by bucket order by hub desc, key desc)")).where(F.col("rank") <= more).drop("rank"))
        one, two = (x.join(merge(sketches), "key").select("bucket", *[F.col(c).alias(f"{c}_{y}") for c in fields]) for x, y in ((head, "a"), (ranked, "b")))
        after = (F.col("hub_a") > F.col("hub_b")) | ((F.col("hub_a") == F.col("hub_b")) & (F.col("key_a") > F.col("key_b")))
        fits = after & (F.col("root_a") != F.col("root_b")) & enough(F.least("common_a", "common_b"), F.col("n_a"), F.col("n_b")) & near(F.col("n_a"), F.col("n_b"))
        fits = fits & (_alike("low_a", "low_b", n_bands * rows) >= likely) & (_first_shared("bands_a", "bands_b", n_bands) == F.col("bucket"))
        fresh = linked(one.join(merge(two), "bucket").where(fits).select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b")))
        edges = checkpoint(edges.unionByName(fresh))
        roots = checkpoint(components(edges))
        more *= 32
        ranked = checkpoint(mixed(ranked.join(merge(head.select("bucket", "key")), ["bucket", "key"], "left_anti").drop("root")))
    named = rooted(classes.select("key", "one.id"))
    least = named.groupBy("root").agg(F.min("id").alias("component"))
    found = named.select("key", "root").join(merge(least), "root").select("key", "component")
    return sig.select("id", F.when(F.col("id").isNotNull(), F.col("key")).alias("key"), "n", "digest").join(merge(found), "key", "left").select(
        "id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"), F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"), "digest"
    )
