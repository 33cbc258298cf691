"""Quality rules: counts of a text, and a hashed n-gram log-likelihood ratio. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

SPACES = "[\\x20\\x09-\\x0D]+"
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def _after(a: Column, k: int) -> Column:
    """An array without its first k elements."""
    return F.slice(a, F.lit(k + 1), F.greatest(F.size(a) - k, F.lit(0)))


def windows_of(hashes: Column, size: int, body) -> Column:
    """body(hashes of the windows of size neighbours): each step joins two windows, so log2(size) + 1 steps make any size."""

    def grow(w: Column, have: int) -> Column:
        step = min(have, size - have)
        if not step:
            return body(w)
        joined = F.zip_with(_after(w, 0), _after(w, step), lambda x, y: F.xxhash64(x, y))
        return let(F.slice(joined, F.lit(1), F.greatest(F.size(w) - step, F.lit(0))), lambda v: grow(v, have + step))

    return grow(hashes, 1)


def repeated_words(hashes: Column, size: int = 5) -> Column:
    """How many words stand in a window of size words that the text has twice or more. Sorting, so n log n for any text."""

    def covered(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(p: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(p, j)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.filter(F.transform(p, lambda x, i: F.when(same(x, i - 1) | same(x, i + 1), x["i"])), lambda x: x.isNotNull()))

        step = lambda at: F.aggregate(F.transform(at, lambda x, j: F.least(F.lit(size), F.coalesce(F.get(at, j + 1) - x, F.lit(size)))), F.lit(0), lambda a, x: a + x)
        return let(pairs, lambda p: let(places(p), step))

    whole = lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w))
    return F.when(F.size(hashes) <= size, F.lit(0)).otherwise(windows_of(hashes, size, whole))


#: What n-grams of a text are hashed: each word, the two characters at each word's end, and each pair of neighbouring words.
KINDS = 3


def grams(word: Column, following: Column, buckets: int) -> list[Column]:
    """Buckets of the n-grams that begin at a word; the last word of a text has no pair (null)."""
    bucket = lambda *x: F.pmod(F.xxhash64(*x), F.lit(buckets)).cast("int")
    return [bucket(word), bucket(F.lit("end"), F.right(word, F.lit(2))), F.when(following.isNotNull(), bucket(F.lit("pair"), word, following))]


def trusted_ids(labels: DataFrame, bound: int, id_col: str = "doc_id", quality_col: str = "quality") -> DataFrame:
    """Ids of about bound labelled documents of quality 1 at most, chosen by hash: a sample with a size bound."""
    good = labels.where(F.col(quality_col) == 1).where(F.col(id_col).isNotNull()).select(id_col).distinct()
    n = good.count()
    if n > bound:
        good = good.where(F.pmod(F.xxhash64(id_col, F.lit("trusted")), F.lit(1 << 30)) < int((1 << 30) * (bound / n)))
    return good


def learn(docs: DataFrame, trusted: DataFrame, buckets: int, id_col: str, text_col: str) -> list[float]:
    """Each bucket's log ratio of its chance in the trusted texts to that in all.

    Raw counts are over all texts. trusted is bounded, so it is broadcast and no text is shuffled; counts are summed in
    the map tasks first, and the result has two numbers a bucket, whatever the input.
    """
    marked = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    marked = marked.join(F.broadcast(trusted.select(F.col(id_col).alias("id"), F.lit(1).alias("good"))), "id", "left")
    words = marked.select("good", words_of(F.col("text")).alias("w")).select("good", F.explode(F.arrays_zip(F.col("w").alias("word"), _after(F.col("w"), 1).alias("following"))).alias("x"))
    cells = words.select("good", F.explode(F.array(*grams(F.col("x.word"), F.col("x.following"), buckets))).alias("bucket")).where("bucket is not null")
    rows = cells.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("good").alias("target")).collect()  # at most buckets rows
    raw, target = [0] * buckets, [0] * buckets
    for r in rows:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    a, b = sum(target) + buckets, sum(raw) + buckets
    return [math.log((t + 1) / a) - math.log((r + 1) / b) for t, r in zip(target, raw)]


def rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 1 << 15, threshold: float = -0.7, least_words: int = 10, repeat_percent: int = 20, labelled: int = 20_000) -> DataFrame:
    """Columns (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, kept) for each row.

    ratio is the mean over a text's hashed n-grams (words, pairs of neighbouring words and word ends) of the log-likelihood ratio between the
    multinomial of trusted documents (labels.quality 1, a sample of about labelled at most) and that of the whole corpus.
    A document is kept if it passes the base rules and its ratio is at least threshold; no chance is involved.

    Defined cases: null and empty texts have no words, ratio 0, fail the base rules and aren't kept. Rows that repeat an
    id are judged each by its own text. A null id is never trusted. Without labels of quality 1 all ratios come from
    smoothed counts alone. An empty table gives an empty result.
    """
    weights = learn(docs, trusted_ids(labels, labelled, id_col), buckets, id_col, text_col)
    table = F.split(F.lit(",".join(f"{x:.5f}" for x in weights)), ",").cast("array<float>")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))

    def measured(w: Column) -> Column:
        of = lambda b: F.coalesce(F.get(table, b), F.lit(0.0).cast("float"))
        each = F.zip_with(w, _after(w, 1), lambda x, y: sum((of(b) for b in grams(x, y, buckets)[1:]), of(grams(x, y, buckets)[0])))
        total = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
        return F.struct(
            F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: repeated_words(h)).cast("long").alias("n_repeat_words"),
            F.when(F.size(w) > 0, total / (KINDS * F.size(w) - 1)).otherwise(0.0).alias("ratio"),
        )

    rows = rows.select(
        "doc_id", let(words_of(F.col("text")), measured).alias("m"), (F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select("doc_id", "m.n_words", "m.word_chars", "n_symbols", "n_dup_lines", "m.n_repeat_words", "m.ratio")
    failed = (F.col("n_words") < least_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(repeat_percent) * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", (~F.col("base_failed") & (F.col("ratio") >= threshold)).alias("kept"))
