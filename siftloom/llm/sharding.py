"""Weighted rendezvous sharding by a stable key. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shard_of(key: Column, weights: list[float], seed: int = 0) -> Column:
    """The shard i with the largest -weights[i] / ln(u), u a hash of key and i in (0, 1); key and weights decide alone.

    A further shard, or a greater weight, takes keys only for itself: no other score changes.
    """
    scores = []
    for i, weight in enumerate(weights):
        u = (F.pmod(F.xxhash64(key, F.lit(f"shard {seed} {i}")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        scores.append(F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(i).alias("shard")))
    return (F.greatest(*scores) if len(scores) > 1 else scores[0])["shard"].cast("int")


def shard(docs: DataFrame, weights: list[float], id_col: str = "doc_id", text_col: str = "text", seed: int = 0, chunk: int = 100_000) -> DataFrame:
    """Columns (doc_id, size, text_crc32, shard, slot, grown_shard) for each row of docs.

    size is the text's UTF-8 bytes plus 8; grown_shard is the shard with one more of weight 1; slots count the rows of
    a shard from 0 without gaps. Slots come from row numbers within hashed chunks of about chunk rows of each shard plus the
    counts of the chunks before, so no shard is ordered by one task. The text itself is never shuffled.

    Defined cases: null and empty texts have size 8 and crc 0. A null id is the key "null". Rows that repeat an id go
    to the same shard, to slots of their own. An empty table gives an empty result.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        shard_of(key, weights, seed).alias("shard"), shard_of(key, [*weights, 1.0], seed).alias("grown_shard"), F.xxhash64(key).alias("h"),
    )
    parts = docs.groupBy().agg(F.greatest(F.lit(1), F.ceil(F.count("*") / (chunk * len(weights)))).alias("parts"))
    rows = rows.withColumn("salt", F.pmod("h", parts.scalar()))
    before = rows.groupBy("shard", "salt").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.expr("sum(n) over (partition by shard order by salt rows between unbounded preceding and 1 preceding)"))
    rows = rows.withColumn("own", F.expr("row_number() over (partition by shard, salt order by h, doc_id, text_crc32)")).join(before.select("shard", "salt", "before"), ["shard", "salt"])
    return rows.select("doc_id", "size", "text_crc32", "shard", (F.coalesce("before", F.lit(0)) + F.col("own") - 1).cast("long").alias("slot"), "grown_shard")
