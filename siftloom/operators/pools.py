"""Pools of queries: all in order with dense numbers, and those of a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.functions.vocab import rotation

from .scan import numbered


def union_in_order(*pools: DataFrame) -> DataFrame:
    """(query, ord): all queries of pools (query, ord), those of earlier pools first, each once where it comes first, numbered from 0.

    Pools may have any size: they are numbered by ranges. Queries of equal place come in the order of their texts.
    """
    both = None
    for i, pool in enumerate(pools):
        part = pool.select("query", F.struct(F.lit(i).alias("pool"), F.col("ord").cast("long").alias("ord")).alias("at"))
        both = part if both is None else both.unionByName(part)
    first = both.groupBy("query").agg(F.min("at").alias("at")).select("query", "at.pool", "at.ord")
    return numbered(first.withColumnRenamed("ord", "_ord"), "pool", "_ord", "query", name="ord").select("query", "ord")


def queries_for_date(core: DataFrame, pool: DataFrame, date: Column, per_day: int = 24) -> DataFrame:
    """(query, ord): the core queries (query, ord), which run each day, then the slice of the pool whose turn it is."""
    rotating = max(0, per_day - core.count())
    turn = rotation(pool, date, rotating, pool.count()) if rotating else pool.where("false")
    return union_in_order(core, turn)
