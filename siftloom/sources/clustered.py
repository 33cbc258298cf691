"""A ledger of seen ids as a clustered table: bucketed and sorted by id, a partition for each day, with a Bloom filter of its ids."""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftloom.operators.ledger import SEEN_DAYS

from .files import delete, exists

#: Hash functions of a Bloom filter.
HASHES = 4


class SeenTable:
    """Ids by the day of their first sight, under a path that a cluster shares.

    * An entry's id is looked up without moving the ledger: its buckets stand as they were written, only entries are dealt out.
    * Entries that the filter rules out aren't dealt out either. It has bits bits, a row of 64 each, and goes to every worker as one array of bits / 8
      bytes, whatever the ledger's size. A ledger with more ids than bits / 10 lets more entries through to the join, which decides.
    * Days leave by the removal of their folders. A day that is added again replaces what it had.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, bits: int = 1 << 24, keep: int = SEEN_DAYS) -> None:
        self.spark, self.path, self.buckets, self.words, self.keep = spark, path.rstrip("/"), buckets, bits // 64, keep
        self.name = f"seen_{hashlib.sha256(self.path.encode()).hexdigest()[:16]}"
        if not spark.catalog.tableExists(self.name):
            spark.sql(f"CREATE TABLE {self.name} (id STRING, first_date DATE) USING parquet PARTITIONED BY (first_date) CLUSTERED BY (id) SORTED BY (id) INTO {buckets} BUCKETS LOCATION '{self.path}/ids'")

    def ids(self) -> DataFrame:
        return self.spark.table(self.name)

    def _places(self, id_: Column) -> list[Column]:
        """The bits of an id, by a 64-bit hash each."""
        return [F.pmod(F.xxhash64(id_, F.lit(i)), F.lit(64 * self.words)) for i in range(HASHES)]

    def add(self, fresh: DataFrame, date: dt.date) -> None:
        """fresh (id) under a date, and their bits; nulls and repeated ids are left out. Ids must not be in the table yet, or be of this date."""
        day = f"{self.path}/new/first_date={date}"
        rows = fresh.select(F.col("id").cast("string").alias("id")).where("id is not null").distinct()
        rows.write.mode("overwrite").parquet(day)  # once, for both
        rows = self.spark.read.schema("id string").parquet(day)
        target = f"{self.path}/ids/first_date={date}"
        if exists(self.spark, target):  # an earlier attempt of the same run
            delete(self.spark, target)
        dealt = rows.select("id", F.lit(date).alias("first_date")).repartition(self.buckets, "id")
        dealt.write.insertInto(self.name)
        places = rows.select(F.explode(F.array(*self._places(F.col("id")))).alias("p"))
        words = places.groupBy(F.expr("p div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))
        words.write.mode("overwrite").parquet(f"{self.path}/bits/first_date={date}")
        delete(self.spark, day)
        self.spark.catalog.refreshTable(self.name)

    def expire(self, today: dt.date) -> list[str]:
        """Remove the days that are over keep days old, and return them; no other file is touched."""
        gone = []
        if exists(self.spark, f"{self.path}/bits"):
            for (day,) in self.spark.read.parquet(f"{self.path}/bits").select(F.col("first_date").cast("string")).distinct().orderBy("first_date").collect():  # a row a day
                if (today - dt.date.fromisoformat(day)).days > self.keep:
                    delete(self.spark, f"{self.path}/ids/first_date={day}")
                    delete(self.spark, f"{self.path}/bits/first_date={day}")
                    gone.append(day)
            self.spark.catalog.refreshTable(self.name)
        return gone

    def filter(self) -> DataFrame:
        """One row: all bits, as an array of numbers."""
        all_ = self.spark.range(self.words).select(F.col("id").cast("int").alias("word"))
        if not exists(self.spark, f"{self.path}/bits"):
            held = all_.withColumn("bits", F.lit(0).cast("long"))
        else:
            # a day's folder may be empty, and says nothing then
            held = self.spark.read.schema("word int, bits long").parquet(f"{self.path}/bits").groupBy("word").agg(F.bit_or("bits").alias("bits"))
            held = all_.join(held, "word", "left").select("word", F.coalesce("bits", F.lit(0)).alias("bits"))
        return held.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("bloom"))

    def may_hold(self, id_: Column, bloom: Column) -> Column:
        """False only for ids that the table doesn't have."""
        out = F.lit(True)
        for p in self._places(id_):
            out = out & (F.getbit(F.get(bloom, F.floor(p / 64).cast("int")), (p % 64).cast("int")) == 1)
        return out

    def unseen(self, entries: DataFrame, id_col: str = "id") -> DataFrame:
        """The entries whose id the table doesn't have, and those with a null id."""
        bloom = F.broadcast(self.filter())
        hit = self.may_hold(F.col(id_col).cast("string"), F.col("bloom"))
        sure = entries.join(bloom, hit, "left_anti")
        maybe = entries.join(bloom, hit, "left_semi")
        known = self.ids().select(F.col("id").alias("_known")).hint("merge")
        return sure.unionByName(maybe.join(known, F.col(id_col).cast("string") == F.col("_known"), "left_anti"))
