"""Mixing sources to target weights by hash-seeded Poisson replication. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, let

#: What one hash draws: rates up to PART_RATE, of which more than PART_COPIES have a chance below 1e-18, less than a hash of
#: 48 bits can tell. Larger rates are drawn in parts.
PART_COPIES = 64
PART_RATE = 16.0


def uniform(text: Column) -> Column:
    """A number in [0, 1) from the first 48 bits of a text's MD5."""
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def poisson_inverse(u: Column, rate: Column) -> Column:
    """The number of Poisson steps whose cumulative chance is at most u: the inverse of the distribution at u. For rates up to PART_RATE."""
    start = F.struct(F.lit(0).alias("n"), F.exp(-rate).alias("term"), F.exp(-rate).alias("sum"))

    def step(a: Column, k: Column) -> Column:
        term = a["term"] * rate / k
        return F.struct((a["n"] + F.when(u >= a["sum"], 1).otherwise(0)).alias("n"), term.alias("term"), (a["sum"] + term).alias("sum"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(PART_COPIES)), start, step, lambda a: a["n"])


def poisson(seed: str, key: Column, rate: Column) -> Column:
    """A Poisson number of any rate, drawn by seed and key: the sum over equal parts of at most PART_RATE, each drawn by
    its own hash, which is a Poisson number of the whole rate. The first part's hash is that of a rate in one part."""
    parts = F.greatest(F.lit(1), F.ceil(rate / PART_RATE).cast("int"))

    def drawn(n: Column) -> Column:
        text = lambda i: F.concat(F.lit(seed), F.when(i > 0, F.concat(F.lit("#"), i.cast("string"))).otherwise(""), F.lit("|"), key)
        return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + let(F.struct(uniform(text(i)).alias("u"), (rate / n).alias("rate")), lambda x: poisson_inverse(x["u"], x["rate"])))

    return let(parts, drawn)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total: float = 1.0, seed: str = "mix-1", id_col: str = "doc_id", source_col: str = "source", order: bool = True, broadcast_rows: int = 100_000) -> DataFrame:
    """docs with each row repeated as often as a Poisson number drawn by its id, in a global random order.

    weights are the target shares of the sources (equal shares if None; a source that isn't named gets share 0 and goes;
    a null source is the source ''). The result has about total times the rows of docs, so a row of source s is drawn with
    the rate share(s) * total * rows / rows(s), however large. The draw inverts the distribution at hashes of
    seed and id, so it is the same in every run and on every cluster. Columns copy (int, from 0) and shuffle_key (32 hex
    digits of a hash of seed, id and copy) are appended; rows are sorted by shuffle_key if order.

    Rates are one number for each source. Their table is counted, and broadcast if it has at most broadcast_rows rows, so texts
    move once, in the sort by shuffle_key; beyond that texts are joined to rates by source, where adaptive execution splits
    hot sources. Sources are counted by partial aggregation.

    Defined cases: a null id draws as the id ''. Rows that repeat an id draw the same number. Texts aren't read. Other
    columns pass through, whatever their names, but for copy and shuffle_key, which the new ones replace. An empty table stays empty.
    """
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    if weights is not None and not weights:
        raise ValueError("weights name no source")
    own = "mix"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    of, n, part, rate, name, copies = (f"{own}_{x}" for x in ("source", "n", "share", "rate", "key", "copies"))
    counts = docs.groupBy(source.alias(of)).agg(F.count("*").alias(n))
    if weights is None:
        share = F.lit(1.0)
    else:
        share = F.lit(0.0)
        for known, weight in sorted(weights.items()):
            share = F.when(F.col(of) == known, F.lit(float(weight))).otherwise(share)
    counts = checkpoint(counts.withColumn(part, share))
    per_share = counts.agg((F.sum(n) / F.sum(part)).alias("x")).scalar()
    rates = counts.select(of, (F.col(part) * F.lit(float(total)) * per_share / F.col(n)).alias(rate))
    if counts.count() <= broadcast_rows:
        rates = F.broadcast(rates)
    names = [c for c in docs.columns if c.lower() not in ("copy", "shuffle_key")]
    rows = docs.select(*names, source.alias(of), key.alias(name)).join(rates, of)
    rows = rows.withColumn(copies, poisson(seed, F.col(name), F.col(rate))).where(F.col(copies) > 0)
    rows = rows.select(*names, name, F.explode(F.sequence(F.lit(0), F.col(copies) - 1)).alias("copy"))
    rows = rows.select(*names, "copy", F.md5(F.concat(F.lit(f"{seed}|"), F.col(name), F.lit("|"), F.col("copy").cast("string"))).alias("shuffle_key"))
    return rows.orderBy("shuffle_key") if order else rows
