"""Vocabularies given as tables: an index of their needles by rarest token, joined with the tokens of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A needle of ASCII characters must not touch these, nor follow &.
WORD = "[a-z0-9]+"
#: Characters whose pairs index needles that stand anywhere in a text.
PAIR_OF = "[^\\x00-\\x7F]"


def entries(rows: DataFrame, id_col: str = "id", name_col: str = "name", aka: str | None = None, masks: str | None = None) -> DataFrame:
    """(id, needle, masks): a row for each distinct lower-cased name and other name of an entry that isn't empty.

    aka: a column of other names, masks: one of phrases that hide the entry where they stand; both are arrays.
    """
    none = F.array().cast("array<string>")
    names = F.concat(F.array(F.col(name_col)), F.coalesce(F.col(aka), none) if aka else none)
    hidden = F.transform(F.coalesce(F.col(masks), none) if masks else none, F.lower)
    flat = rows.select(F.col(id_col).alias("id"), F.explode(F.transform(names, F.lower)).alias("needle"), F.filter(hidden, lambda m: m != "").alias("masks"))
    return flat.where("needle <> ''").groupBy("id", "needle").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("masks")))).alias("masks"))


def tokens(low: Column) -> Column:
    """The tokens of a lower-cased text that needles are indexed by: runs of a-z and 0-9, and pairs of neighbours of which one is beyond ASCII,
    or such a character at a text's end.

    A needle of ASCII characters can only be found where its runs stand as whole runs; another is found wherever its pairs are.
    """
    words = F.regexp_extract_all(low, F.lit(WORD), F.lit(0))
    # a run has characters beyond ASCII with single others between and around them, so all its pairs count
    runs = F.regexp_extract_all(low, F.lit("[\\x00-\\x7F]?" + PAIR_OF + "+(?:[\\x00-\\x7F]" + PAIR_OF + "+)*[\\x00-\\x7F]?"), F.lit(0))
    ones = F.filter(runs, lambda r: F.char_length(r) == 1)
    pairs = F.flatten(F.transform(F.filter(runs, lambda r: F.char_length(r) > 1), lambda r: F.transform(F.sequence(F.lit(1), F.char_length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.array_distinct(F.concat(words, ones, pairs))


def pairs(low: Column) -> Column:
    """All pairs of neighbours of a text."""
    return F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(low) - 1, F.lit(1))), lambda i: F.substring(low, i, F.lit(2))), lambda p: F.char_length(p) == 2)


def _own(needle: Column, anywhere: bool) -> Column:
    """The tokens by which a needle can be found; null if none surely is in a text that holds it."""
    if anywhere:
        return F.nullif(pairs(needle), F.array().cast("array<string>"))
    words = F.regexp_extract_all(needle, F.lit(WORD), F.lit(0))
    beyond = F.filter(pairs(needle), lambda p: p.rlike(PAIR_OF))
    return F.nullif(F.when(~needle.rlike(PAIR_OF), words).otherwise(beyond), F.array().cast("array<string>"))


def index(vocabulary: DataFrame, rarity: DataFrame | None = None, anywhere: bool = False) -> DataFrame:
    """(needle, masks, ids, anchor): each distinct needle and masks once, with the ids it stands for and its rarest token.

    anywhere: needles may stand inside words, and pairs of characters are the tokens. Rare are tokens that few needles have, or that are few in rarity (token, n), such as counts of a corpus; then long ones. The anchor is
    null for needles without a token (signs alone, or one character beyond ASCII), which are looked for everywhere.
    """
    needles = vocabulary.groupBy("needle", "masks").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    held = needles.select("needle", "masks", F.explode(_own(F.col("needle"), anywhere)).alias("token")).distinct()
    counts = held.groupBy("token").agg(F.count("*").alias("needles"))
    if rarity is not None:
        counts = counts.join(rarity.select("token", F.col("n").alias("texts")), "token", "left").withColumn("needles", F.coalesce("texts", F.lit(0)))
    best = held.join(counts.select("token", "needles"), "token").groupBy("needle", "masks").agg(F.min_by("token", F.struct("needles", -F.char_length("token"), "token")).alias("anchor"))
    return needles.join(best, ["needle", "masks"], "left")


def token_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(token, n): how many texts have each token, for the rarity of an index."""
    return texts.select(F.explode(tokens(F.lower(F.coalesce(text_col, F.lit(""))))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def holds(low: Column, needle: Column, masks: Column) -> Column:
    """Whether a lower-cased text holds a needle once its masks are spaces: an ASCII needle must not touch a letter or digit, nor follow &."""
    quoted = F.concat(F.lit("\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    masked = F.when(F.size(masks) == 0, low).otherwise(F.aggregate(masks, low, lambda text, m: F.replace(text, m, F.repeat(F.lit(" "), F.char_length(m)))))
    bounded = F.concat(F.lit("(?<![a-z0-9&])"), quoted, F.lit("(?![a-z0-9])"))
    return F.when(needle.rlike(PAIR_OF), F.contains(masked, needle)).otherwise(F.contains(masked, needle) & F.regexp_like(masked, bounded))


def match(texts: DataFrame, indexed: DataFrame, key: str = "id", text_col: str = "text", anywhere: bool = False) -> DataFrame:
    """(key, needle, ids): the needles of an index that each text holds, in any case of letters. key must tell texts apart.

    Texts are taken apart into distinct tokens, which meet the needles' anchors by an equi-join: narrow rows of key and token, of which only
    those with a needle go on. Texts are then joined with their candidates by key once, and each candidate is checked in place. Needles without
    an anchor are checked against every text; they stand in one row of that join's other side, so they should be few. anywhere is as in index; masks
    don't count then.

    Defined cases: a null text holds nothing, and so does a null key. Empty tables give an empty result.
    """
    low = texts.where(F.col(key).isNotNull() & F.col(text_col).isNotNull()).select(F.col(key).alias("key"), F.lower(F.col(text_col)).alias("low"))
    needle = F.struct("needle", "masks", "ids")
    spread = low.select("key", F.explode(F.array_distinct(pairs(F.col("low"))) if anywhere else tokens(F.col("low"))).alias("anchor"))
    hit = (lambda c: F.contains(F.col("low"), c["needle"])) if anywhere else (lambda c: holds(F.col("low"), c["needle"], c["masks"]))
    found = spread.join(indexed.where("anchor is not null"), "anchor").groupBy("key").agg(F.collect_list(needle).alias("candidates"))
    rest = indexed.where("anchor is null").agg(F.collect_list(needle).alias("always"))
    both = low.join(found, "key", "left").join(F.broadcast(rest))  # one row
    both = both.select("key", "low", F.concat(F.coalesce("candidates", F.array().cast(found.schema["candidates"].dataType)), "always").alias("candidates")).where("size(candidates) > 0")
    held = both.select("key", F.explode(F.filter("candidates", hit)).alias("c"))
    return held.select(F.col("key").alias(key), "c.needle", "c.ids")


def matched_ids(found: DataFrame, key: str = "id", entry: str = "entry") -> DataFrame:
    """(key, entry): the distinct entries of the needles found."""
    return found.select(key, F.explode("ids").alias(entry)).distinct()
