"""A training corpus in five stages: what is toxic goes, one of each group of near copies stays, repeated passages go,
sources are mixed to equal shares, and what is left is packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftloom.llm import mixing, neardup, packing, substring, toxicity
from siftloom.llm.common import checkpoint, documents, labels, ship
from siftloom.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 stay, unchanged; nulls and empty texts have no evidence and stay, repeated rows are judged each by its text.
    An empty table stays empty; other columns go."""
    ship(spark)
    model = toxicity.learn(docs, toxicity.fold(labels(spark, sf_dir)))
    return toxicity.score(docs, model, carry=True).where("score < 0.5").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays; so do documents without words and those with a null id.
    Rows that repeat an id are told apart by the hash of their text, so none goes for what another row has."""
    ship(spark)
    gone = neardup.near_duplicates(docs).where("not kept").select(F.col("id").alias("doc_id"), "digest").distinct()
    return docs.withColumn("digest", F.xxhash64("text")).join(gone, ["doc_id", "digest"], "left_anti").select(*COLUMNS)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that an earlier document has in a passage of 50; a text that loses every word goes. Nulls, empty texts and rows with
    a null id stay as they are; repeated rows of one id don't count against each other. An empty table stays empty; other columns go."""
    ship(spark)
    cut = substring.dedup_substrings(docs, carry=("lang", "source", "n_chars")).where("n_removed = 0 or n_removed < n_words")
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source with an equal share of about as many rows as come in, in a global random order; ids repeat with the copies. A null source
    is a source, a null id draws as the id ''; repeated rows draw the same number. An empty table stays empty; other columns go."""
    return mixing.mix(docs).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each copy: its sequence of 4096 tokens at most and its place there. Null and empty texts are one end token; every
    row is packed, also repeated ones and those with a null id. An empty table gives no rows; other columns are ignored."""
    ship(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the classifier, the draw and the packing; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each stage's rows are checkpointed before the next reads them. The cases that a stage
    must bear are in its description; an empty table gives no rows."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpoint(docs)
    return docs
