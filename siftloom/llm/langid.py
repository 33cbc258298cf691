"""Language ID with a bit-sliced Bloom filter of n-grams."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import remainder

SIZES = (3, 4)
_PAD = max(SIZES) - 1
#: Bytes that aren't letters count as one space each.
_FOLD = np.where(K.PUNCT, 0x20, K.LOWER).astype(np.uint8)
_FOLD[0x30:0x3A] = 0x20
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def ngrams(c: K.Chunk) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size, the packed n-grams of lower-cased bytes of a chunk and the document of each; none crosses documents."""
    docs = c.hi - c.lo
    doc = np.repeat(np.arange(docs), np.diff(c.offs))
    buf = np.full(len(c.data) + _PAD * (docs + 1), 0x20, np.uint8)
    buf[np.arange(len(c.data)) + _PAD * (doc + 1)] = _FOLD[c.data]
    owner = np.repeat(np.arange(docs), np.diff(c.offs) + _PAD)
    for size in SIZES:
        gram = np.zeros(len(owner), np.uint64)
        for i in range(size):
            gram = (gram << np.uint64(8)) | buf[i + _PAD - size + 1 :][: len(owner)].astype(np.uint64)
        blank = int.from_bytes(b" " * size)
        keep = gram != np.uint64(blank)
        yield gram[keep] | np.uint64(size << 56), owner[keep]


def has_letter(text: str) -> bool:
    """Whether a character of Unicode category L is in it."""
    return any(unicodedata.category(x)[0] == "L" for x in text)


@dataclass
class Filters:
    """tables: for each 64 languages a number for each slot, with a bit for each of them; false: the chance that a strange
    n-gram is found in each language."""

    langs: list[str]
    tables: list[np.ndarray]
    false: np.ndarray

    def find(self, grams: np.ndarray) -> list[np.ndarray]:
        """The languages of each n-gram, as masks, by one look at each of two slots."""
        h = K.mix64(grams)
        low = np.uint64(len(self.tables[0]) - 1) if self.tables else np.uint64(0)
        one, two = h & low, (h >> np.uint64(32)) & low
        return [t[one] & t[two] for t in self.tables]

    def having(self, masks: list[np.ndarray], i: int) -> np.ndarray:
        """Which n-grams are found in language i."""
        mask = masks[i // 64]
        return (mask & mask.dtype.type(1 << i % 64)) != 0


def build(profiles: dict[str, np.ndarray], slots: int | None = None) -> Filters:
    """Filters of the languages' n-grams; slots is a power of two, by default such that no filter is fuller than an eighth."""
    langs = sorted(profiles)
    if slots is None:
        slots = 1 << max(16, int(16 * max((len(p) for p in profiles.values()), default=1) - 1).bit_length())
    low = np.uint64(slots - 1)
    tables, fill = [], []
    for first in range(0, len(langs), 64):
        some = langs[first : first + 64]
        table = np.zeros(slots, np.uint8 if len(some) <= 8 else np.uint64)
        for i, lang in enumerate(some):
            h = K.mix64(profiles[lang])
            for at in (h & low, (h >> np.uint64(32)) & low):
                table[at] |= table.dtype.type(1 << i)
        fill += [np.count_nonzero(table & table.dtype.type(1 << i)) / slots for i in range(len(some))]
        tables.append(table)
    return Filters(langs, tables, np.array(fill) ** 2)


def _count():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.array(batch.column(1).to_pylist(), object)
            for c in K.chunks(batch.column(0)):
                own = lang[c.lo : c.hi]
                for grams, doc in ngrams(c):
                    for name in sorted(set(own)):
                        some, n = np.unique(grams[np.isin(doc, np.flatnonzero(own == name))], return_counts=True)
                        yield pa.RecordBatch.from_arrays([K.signed(some), pa.array([name] * len(some), pa.string()), pa.array(n.astype(np.int64))], names=["gram", "lang", "n"])

    return run


def learn(docs: DataFrame, per_lang: int = 1500, least: int = 3, ratio: float = 0.3, text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Filters of the n-grams typical of each language, from about per_lang texts of each, chosen by a hash of the text.

    per_lang bounds the sample; nothing that it taught is dropped. An n-gram is typical of a language if it is seen least times in it and its rate is at least ratio of that in the
    language where it is most frequent, so a foreign passage in a text doesn't put its n-grams into the wrong filter.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return build({})
    rate = F.lit(1.0)
    for name, n in sorted(sizes.items()):
        rate = F.when(F.col("lang") == name, F.lit(min(1.0, per_lang / n))).otherwise(rate)
    picked = rows.where(F.pmod(F.xxhash64("text", F.lit("langid")), F.lit(1 << 30)) <= rate * F.lit(float(1 << 30)))
    counts = picked.select("text", "lang").mapInArrow(_count(), "gram long, lang string, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    table = counts.toArrow()  # bounded by per_lang texts of each language
    gram, lang, n = table.column("gram").to_numpy().view(np.uint64), np.array(table.column("lang").to_pylist(), object), table.column("n").to_numpy()
    names = sorted(sizes)
    at, inverse = np.unique(gram, return_inverse=True)
    rates = np.zeros((len(names), len(at)))
    for i, name in enumerate(names):
        own = lang == name
        rates[i, inverse[own]] = n[own] / max(1, n[own].sum())
    most = rates.max(axis=0) if len(at) else np.zeros(0)
    profiles = {}
    for i, name in enumerate(names):
        typical = np.flatnonzero((rates[i] > 0) & (rates[i] >= ratio * most))
        profiles[name] = at[typical]
    return build(profiles)


def _predict(filters: Filters):
    k = len(filters.langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in K.chunks(batch.column(1)):
                docs = c.hi - c.lo
                hits, total = np.zeros((docs, k)), np.zeros(docs)
                for grams, doc in ngrams(c):
                    masks = filters.find(grams)
                    total += np.bincount(doc, minlength=docs)
                    for i in range(k):
                        hits[:, i] += np.bincount(doc[filters.having(masks, i)], minlength=docs)
                true = np.maximum(0, (hits - total[:, None] * filters.false) / np.maximum(1e-9, 1 - filters.false))
                order = np.argsort(-true, axis=1, kind="stable")
                ascii_letters = np.concatenate([[0], np.cumsum(_ASCII_LETTER[c.data])])
                has = ascii_letters[c.offs[1:]] > ascii_letters[c.offs[:-1]]
                langs, scores = [], []
                for d in range(docs):
                    if not k or not has[d] and not has_letter(c.data[c.offs[d] : c.offs[d + 1]].tobytes().decode()):
                        langs.append("und")
                        scores.append(0.0)
                        continue
                    best = true[d, order[d, 0]]
                    second = true[d, order[d, 1]] if k > 1 else 0.0
                    langs.append(filters.langs[order[d, 0]])
                    scores.append(float(best / (best + second)) if best > 0 else 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.lo, docs), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns (doc_id, lang_pred, score) for each row: the language with the most n-grams, corrected for false positives.

    All languages of an n-gram come from one lookup. A language's count c of n is corrected to (c - n f) / (1 - f), f its
    filter's false positive rate. score is the best count's share of the two best.

    Defined cases: texts that are null or have no letter are "und" with score 0; a text whose n-grams are all unknown gets
    the first language by name and score 0; without learned languages all are "und". Ties go to the first by name.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(_predict(filters), f"doc_id {dict(base.dtypes)['doc_id']}, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 3, fold: int = 1, per_lang: int = 1500, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Columns (doc_id, held_out, lang_pred, score): predict() for all rows with filters learned from the rows whose id's crc32
    modulo folds isn't fold; held_out marks the rest.

    Defined cases: those of predict(). A null id counts as the id '' for its fold. Rows with a null text or language teach nothing; languages may
    be any number. Rows that repeat an id are each judged by their own text. Only the three columns are read, so others don't matter.
    """
    out = remainder(F.col(id_col), folds) == fold
    filters = learn(docs.where(~out), per_lang, text_col=text_col, lang_col=lang_col)
    return predict(docs, filters, id_col, text_col).select("doc_id", (remainder(F.col("doc_id"), folds) == fold).alias("held_out"), "lang_pred", "score")
