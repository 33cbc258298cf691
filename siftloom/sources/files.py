"""Day files, ledgers and candidate lists: readers that tolerate what is missing, and writers."""

from __future__ import annotations

import datetime as dt
import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from siftloom.functions.text import json_island
from siftloom.functions.url import with_scheme
from siftloom.operators import views

log = logging.getLogger(__name__)

DAY = "date string, generatedAt string, dailyNote string, reviewed int, dropped int, items array<struct<id:string,source:string,type:string,kind:string,lang:string,url:string,titleOriginal:string,titleZh:string,summaryZh:string,whyRead:string,rating:int,tools:array<string>,topics:array<string>,publishedAt:string,author:string,thin:boolean,brief:boolean>>, errors array<string>"


def spread(df: DataFrame) -> DataFrame:
    """df, dealt anew if it is read in fewer tasks than there are cores: a small table of one file, before its texts are worked on."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, whichever it is on."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = hadoop_path(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder and what is in it; nothing happens if it is gone."""
    p, fs = hadoop_path(spark, path)
    fs.delete(p, True)


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of JSON lines; empty if the path is missing, without the rows that can't be read, which are logged."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        log.warning("no state at %s: %s", path, e)
        return spark.createDataFrame([], schema)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    rows = lines.where("trim(value) <> ''").select(F.from_json("value", f"{schema}, _corrupt string", options).alias("j"))
    if bad := rows.where("j._corrupt is not null").count():
        log.error("%s unreadable rows in %s", bad, path)
    return rows.where("j._corrupt is null").select("j.*").drop("_corrupt")


def _day(column: str = "_metadata.file_name") -> Column:
    """The day in the name of a day file; '' for other files."""
    return F.regexp_extract(column, "(?:^|/)(\\d{4}-\\d\\d-\\d\\d)\\.json$", 1)


def read_days(spark: SparkSession, folder: str, today: Column, n: int) -> DataFrame:
    """The day files named YYYY-MM-DD.json of the last n days, newest first, without those that can't be read. Other files aren't opened."""
    last = spark.range(1).select(today.cast("string")).first()[0]
    names = ",".join(f"{dt.date.fromisoformat(last) - dt.timedelta(i)}.json" for i in range(n))
    raw = spark.read.schema(f"{DAY}, _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", f"{{{names}}}").json(folder)
    named = raw.withColumn("_file", _day()).where("_file <> '' and _corrupt is null")
    return views.within(named.withColumn("date", F.to_date("_file")), today, n).drop("_file", "_corrupt").orderBy(F.desc("date"))


def prune_days(spark: SparkSession, folder: str, today: Column, keep: int) -> list[str]:
    """Delete the day files that retention no longer keeps and return their days; other files and future days stay."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select("path", _day("path").alias("date")).where("date <> ''")
    old = views.expired(files.withColumn("date", F.to_date("date")), today, keep).select("path", F.col("date").cast("string")).orderBy("date").collect()  # a row for each file
    for path, _ in old:
        delete(spark, path)
    return [d for _, d in old]


def items_of(days: DataFrame) -> DataFrame:
    return days.select("date", F.explode("items").alias("i")).select("date", "i.*")


def errors_of(days: DataFrame) -> DataFrame:
    """(date, source, message, partial) of errors that were written as texts or as objects."""
    rows = days.select("date", F.explode("errors").alias("e"))
    x = F.from_json("e", "source string, message string, error string, partial boolean")
    return rows.select("date", x["source"].alias("source"), F.coalesce(x["message"], x["error"], F.col("e")).alias("message"), F.coalesce(x["partial"], F.lit(False)).alias("partial"))


def candidate_urls(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(with_scheme(F.col("value")).alias("url")).where("url is not null")


def write_table(df: DataFrame, path: str) -> None:
    """Replace a table that nobody reads meanwhile, and that df isn't read from; versions.Versions has neither limit."""
    df.write.mode("overwrite").parquet(path)


def write_days(df: DataFrame, path: str) -> None:
    """Replace only the days that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def page(days: DataFrame, most: int = 400) -> DataFrame:
    """One row: the days as JSON that may stand in a page, its size in bytes, and how many days and items it has. A page holds a window of days: most of them at most."""
    items = F.coalesce(F.sum(F.when(F.col("items").isNotNull(), F.size("items"))), F.lit(0))
    one = days.limit(most + 1).agg(F.count("*").alias("n"), items.alias("item_count"), F.to_json(F.sort_array(F.collect_list(F.struct("date", "items")), asc=False)).alias("j"))
    checked = F.when(F.col("n") <= most, F.col("j")).otherwise(F.raise_error(F.lit(f"a page holds at most {most} days")))
    return one.select(json_island(checked).alias("json"), F.col("n").alias("day_count"), "item_count").withColumn("bytes", F.octet_length("json"))
