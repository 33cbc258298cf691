"""The batch operators as streams: dedup within a watermark, counts, upserts by micro-batch, failures by source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siftloom.operators import ledger, state
from siftloom.sources.files import delete, exists

STATE = "user_email string, item_id string, is_read int, is_starred int, updated_at timestamp"


def first_seen(items: DataFrame, at: str = "published_at", days: int = ledger.SEEN_DAYS) -> DataFrame:
    """The first item of each id within a watermark of days. Near the batch ledger, whose time runs from the first sight."""
    return items.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, f"{days} days").dropDuplicatesWithinWatermark(["id"])


def day_counts(items: DataFrame, at: str = "published_at", late: str = "14 days") -> DataFrame:
    """Items by source and day, late ones counted up to a watermark."""
    return items.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, "1 day"), "source").agg(F.count("*").alias("n")).select(F.col("window.start").cast("date").alias("date"), "source", "n")


def snapshot(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """Reader state as upsert_into left it: of each bucket the newest version, or the newest before a batch; null if there is none."""
    if not exists(spark, path):
        return None
    rows = spark.read.schema(f"{STATE}, v int, bucket int").parquet(path)
    if before is not None:
        rows = rows.where(F.col("v") < before)
    newest = rows.groupBy("bucket").agg(F.max("v").alias("v"))
    return rows.join(F.broadcast(newest), ["bucket", "v"])  # a row for each bucket


def upsert_into(path: str, buckets: int = 64):
    """For foreachBatch: fold each batch of changes into a snapshot at path, in buckets by a hash of the user.

    A batch writes only the buckets of its users, as a version of these, so a small batch costs its buckets and not the whole
    state. A batch that is run again reads what was there before it and gives the same version, so a lost driver does no harm;
    versions older than the two newest of a bucket are removed.
    """
    bucket = F.pmod(F.xxhash64("user_email"), F.lit(buckets)).cast("int")

    def run(changes: DataFrame, batch: int) -> None:
        spark: SparkSession = changes.sparkSession
        old = snapshot(spark, path, batch)
        if old is None:
            old = spark.createDataFrame([], STATE)
        else:
            old = old.join(F.broadcast(changes.select(bucket.alias("bucket")).distinct()), "bucket", "left_semi").drop("bucket", "v")  # buckets rows at most
        new = state.upsert(old, changes, F.current_timestamp()).withColumn("bucket", bucket)
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v={batch}")
        versions = spark.read.schema(f"{STATE}, v int, bucket int").parquet(path).select("bucket", "v").distinct()
        for b, held in versions.groupBy("bucket").agg(F.sort_array(F.collect_list("v"), asc=False)).collect():
            for v in held[2:]:
                delete(spark, f"{path}/v={v}/bucket={b}")

    return run


def failures(attempts: DataFrame) -> DataFrame:
    """Consecutive failures of each source, kept as state; attempts: source, ord, ok.

    The order within a micro-batch doesn't matter, however many chunks a source's rows come in: only failures after the last
    success seen are held, 8 bytes each. Rows not newer than those of earlier micro-batches were counted there.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        n, last = held.get if held.exists else (0, -1)
        top, good, failed = last, last, np.zeros(0, np.int64)
        for rows in batches:
            ord_, ok = rows["ord"].to_numpy(np.int64), rows["ok"].to_numpy(bool)
            good = max(good, int(ord_[ok].max(initial=last)))
            failed = np.concatenate([failed, ord_[~ok & (ord_ > last)]])
            failed = failed[failed > good]
            top = max(top, int(ord_.max(initial=last)))
        n = (0 if good > last else n) + len(failed)
        held.update((n, top))
        yield pd.DataFrame({"source": [key[0]], "consecutive_failures": [n]})

    return attempts.groupBy("source").applyInPandasWithState(step, "source string, consecutive_failures int", "n int, last long", "update", GroupStateTimeout.NoTimeout)
