"""Small helpers shared by the operators: shared-folder checkpoints, let-bindings, temporary names."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftloom.sources.files import spread


def ship(spark: SparkSession) -> None:
    """Give the executors this package once, however the driver found it."""
    sc = spark.sparkContext
    if getattr(sc, "_siftloom_shipped", False):
        return
    top = Path(__file__).resolve().parents[2]
    path = Path(tempfile.mkdtemp(prefix="siftloom-")) / "siftloom.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((top / "siftloom").rglob("*.py")):
            z.write(p, p.relative_to(top))
    sc.addPyFile(str(path))
    sc._siftloom_shipped = True


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; a table of fewer files than cores is dealt to all of them, larger ones are read as they are."""
    ship(spark)
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the folder of spark.checkpoint.dir, which all executors share.

    Spark removes them once nothing refers to them if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder for files that all executors see: that of checkpoints."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "siftloom-checkpoints"))  # a session on this machine alone, as the bench's
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, which cuts the lineage: columns are compressed there, and later reads take only those they need."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def let(value: Column, body) -> Column:
    """body(value), with value computed once for a row however often the body and its lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def remainder(doc_id: Column, k: int) -> Column:
    """crc32 of an id's decimal text, modulo k: the folds of the contracts."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % k


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
