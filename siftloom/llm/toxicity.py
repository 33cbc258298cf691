"""Toxicity by weak supervision: voters, a generative label model, a linear classifier on its posteriors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import remainder

#: Common English words of abuse, a voter's lexicon for each kind.
LEXICONS = {
    "insults": ("idiot", "moron", "stupid", "dumb", "imbecile", "fool", "clown", "loser", "jerk"),
    "contempt": ("trash", "scum", "pathetic", "worthless", "disgusting", "pig", "ugly", "filthy", "vermin"),
    "threats": ("kill", "murder", "strangle", "hurt", "destroy", "punch", "threat", "suffer"),
    "hatred": ("hate", "despise", "loathe", "detest", "hateful", "hated"),
    "dismissal": ("useless", "garbage", "nonsense", "ridiculous", "shameful", "coward"),
}
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
STEM = 5
GROUPS, STEMS = 4, 2
#: Patterns that vote, in this order after the lexicons.
PATTERNS = ("shouting", "symbols", "repetition", "masked words", "exclamations")
WORDS = GROUPS + STEMS + len(LEXICONS)
VOTERS = WORDS + len(PATTERNS)
SPAN = 200


@dataclass
class Lexicon:
    """Sorted hashes of mined words and stems with the voter of each."""

    words: np.ndarray
    word_voter: np.ndarray
    stems: np.ndarray
    stem_voter: np.ndarray


def _lookup(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The place in table of each key, or -1."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def _hash(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    if not raw:
        return np.zeros(0, np.uint64)
    ends = np.cumsum([len(r) for r in raw])
    return K.word_hashes(np.frombuffer(b"".join(raw), np.uint8), K.Words(ends - [len(r) for r in raw], ends, np.array([0, len(raw)])))


def lexicon(words: list[str], stems: list[str]) -> Lexicon:
    """Mined words and stems, dealt to GROUPS and STEMS voters by their hashes, and the fixed lexicons, a voter each."""

    def table(items: list[str], first: int, groups: int) -> tuple[np.ndarray, np.ndarray]:
        h = _hash(items)
        return h, first + (K.mix64(h) % np.uint64(groups)).astype(np.int64)

    fixed = {w: GROUPS + STEMS + i for i, ws in enumerate(LEXICONS.values()) for w in ws}
    w, wv = table(sorted(set(words) - set(fixed)), 0, GROUPS)
    w, wv = np.concatenate([w, _hash(list(fixed))]), np.concatenate([wv, np.array(list(fixed.values()))])
    s, sv = table(sorted(set(stems)), GROUPS, STEMS)
    return Lexicon(np.sort(w), wv[np.argsort(w)], np.sort(s), sv[np.argsort(s)])


_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LOWER = np.zeros(256, bool)
_LOWER[0x61:0x7B] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER = _UPPER | _LOWER
_MASK = np.zeros(256, bool)
_MASK[list(b"*@#$")] = True


def hits(c: K.Chunk, lex: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """How often each voter's evidence stands in each document, and each document's number of words."""
    docs = c.hi - c.lo
    w = K.words(c.data, c.offs, K.PUNCT)
    h = K.word_hashes(c.data, w, fold=True)
    doc = np.repeat(np.arange(docs), w.counts)
    out = np.zeros((docs, VOTERS))
    at = _lookup(h, lex.words)
    np.add.at(out, (doc[at >= 0], lex.word_voter[at[at >= 0]]), 1)
    long = np.flatnonzero(w.ends - w.starts > STEM)
    stems = K.word_hashes(c.data, K.Words(w.starts[long], w.starts[long] + STEM, np.array([0, len(long)])), fold=True)
    at = _lookup(stems, lex.stems)
    np.add.at(out, (doc[long][at >= 0], lex.stem_voter[at[at >= 0]]), 1)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[c.offs[1:]] - total[c.offs[:-1]]).astype(float)

    upper, lower, d = share(_UPPER[c.data]), share(_LOWER[c.data]), c.data
    out[:, WORDS] = upper > np.maximum(4, lower)
    out[:, WORDS + 1] = share(_SYMBOL[d]) > 0.05 * np.maximum(1, np.diff(c.offs))
    same = np.zeros(docs)
    if len(h) > 1:
        np.add.at(same, doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], 1)
    out[:, WORDS + 2] = same > 0.2 * np.maximum(5, w.counts)
    inside, loud = np.zeros(len(d), bool), np.zeros(len(d), bool)
    inside[1:-1] = _MASK[d[1:-1]] & _LETTER[d[:-2]] & (_LETTER[d[2:]] | _MASK[d[2:]])
    loud[1:] = (d[1:] == 0x21) & (d[:-1] == 0x21)
    out[:, WORDS + 3] = share(inside) > 0
    out[:, WORDS + 4] = share(loud) > 0
    return out, w.counts


def features(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What the classifier sees: constant, each voter's vote and strength, how dense all lexicon hits are, and length."""
    words = counts[:, :WORDS]
    total = words.sum(axis=1, keepdims=True)
    dense = np.log1p(1000 * total / np.maximum(20, n)[:, None]) / 5
    return np.hstack([np.ones((len(n), 1)), counts > 0, np.log1p(words), total > 0, np.log1p(total), dense, np.log1p(n)[:, None] / 10])


def votes(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which voters vote for label 1, the others abstaining: a lexicon if its words stand once in every SPAN words or oftener, so that
    one of them in a long text is no vote; a pattern if it is there."""
    fires = counts > 0
    fires[:, :WORDS] &= counts[:, :WORDS] * SPAN >= n[:, None]
    return fires


def patterns(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (votes(counts, n) @ (1 << np.arange(VOTERS))).astype(np.int64)


@dataclass
class LabelModel:
    """A generative model of the votes: prior is the chance of label 1; parent[v] the voter that v depends on besides the label
    (-1: none); fires[y, p, v] the chance that v votes when the label is y and its parent's vote p. gold[y] is the chance that a
    given label is 1 when the true one is y."""

    prior: float
    parent: np.ndarray
    fires: np.ndarray
    gold: np.ndarray

    def posterior(self, votes: np.ndarray, given: np.ndarray | None = None) -> np.ndarray:
        """The chance of label 1 by the votes, and by the given label (-1: none) if one is passed."""
        votes = votes.astype(int)
        z = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        above = np.where(self.parent[None, :] >= 0, votes[:, np.maximum(self.parent, 0)], 0)
        cols = np.arange(votes.shape[1])
        for y, sign in ((1, 1), (0, -1)):
            p = self.fires[y][above, cols]
            z = z + sign * np.where(votes == 1, np.log(p), np.log(1 - p)).sum(axis=1)
        if given is not None:
            g = self.gold
            z = z + np.where(given == 1, np.log(g[1] / g[0]), np.where(given == 0, np.log((1 - g[1]) / (1 - g[0])), 0.0))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _pairs(votes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted counts [a, b, i, j] of voter i voting a and voter j voting b."""
    on, off = votes, 1 - votes
    return np.array([[(x * weight[:, None]).T @ y for y in (off, on)] for x in (off, on)])


def _tree(joint: list[np.ndarray]) -> np.ndarray:
    """The parents in the tree of voters that keeps most of their mutual information given the label (Prim's algorithm)."""
    k = joint[0].shape[2]
    gain = np.zeros((k, k))
    for j in joint:
        p = j + 0.1
        total = p.sum(axis=(0, 1))
        one, two = p.sum(axis=1), p.sum(axis=0)
        gain += (p * np.log(p * total / (one[:, None] * two[None, :]))).sum(axis=(0, 1))
    parent, inside = np.full(k, -1), {0}
    while len(inside) < k:
        i, j = max(((i, j) for i in inside for j in range(k) if j not in inside), key=lambda x: (gain[x], -x[1]))
        parent[j] = i
        inside.add(j)
    return parent


def fit_labels(counts: dict[tuple[int, int], int], rounds: int = 30) -> LabelModel:
    """EM over vote patterns with how many documents have each: keys are (pattern, label, or -1 without one).

    Voters abstain or vote for label 1. Given the label, votes form a tree: each voter's accuracy is estimated for both votes
    of the voter that it depends on most, so correlated voters don't count twice. Accuracies and tree begin from the
    labelled rows and are then estimated from all documents, where a given label is one more observation, itself with
    estimated errors.
    """
    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], float)
    votes = (np.array([k[0] for k in keys], int).reshape(-1, 1) >> np.arange(VOTERS)) & 1
    given = np.array([k[1] for k in keys], int)
    known = given >= 0

    def fitted(p: np.ndarray, weight: np.ndarray, gold: np.ndarray) -> LabelModel:
        joint = [_pairs(votes, weight * (1 - p)), _pairs(votes, weight * p)]
        parent = _tree(joint)
        fires = np.zeros((2, 2, VOTERS))
        for y, j in enumerate(joint):
            alone = (j[1, 1].diagonal() + (0.02, 0.1)[y]) / (j[0, 0].diagonal() + j[1, 1].diagonal() + 1)
            for v in range(VOTERS):
                for a in (0, 1):
                    u = parent[v]
                    on, all_ = (j[a, 1, u, v], j[a, :, u, v].sum()) if u >= 0 else (j[1, 1, v, v], j[0, 0, v, v] + j[1, 1, v, v])
                    fires[y, a, v] = (on + alone[v]) / (all_ + 1)
        prior = ((weight * p).sum() + 1) / (weight.sum() + 2)
        return LabelModel(float(np.clip(prior, 0.001, 0.999)), parent, np.clip(fires, 1e-4, 1 - 1e-4), gold)

    start = np.array([0.02, 0.9])
    model = fitted((given == 1).astype(float), n * known, start)
    for _ in range(rounds):
        p = model.posterior(votes, given)
        gold = start.copy()
        for y, q in ((0, n * (1 - p) * known), (1, n * p * known)):
            gold[y] = (q[given == 1].sum() + start[y]) / (q.sum() + 1)
        model = fitted(p, n, np.clip(gold, 1e-3, 1 - 1e-3))
    return model


def fit_linear(x: np.ndarray, target: np.ndarray, times: np.ndarray, ridge: float = 0.3, rounds: int = 30) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; times says how often each row counts."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (times * (p * (1 - p) + 1e-6))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (times * (p - target)) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def mine(train: DataFrame, least: int = 3, odds: float = 12.0) -> tuple[list[str], list[str]]:
    """Words and word beginnings that are far more common in toxic texts of the labelled sample, which bounds them."""
    n = {r[0]: r[1] for r in train.groupBy("toxic").count().collect()}
    pos, neg = n.get(1, 0) + 1.0, n.get(0, 0) + 1.0
    # A-Z only, as the scoring kernel folds
    folded = F.split(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), BETWEEN)

    def found(words: Column, floor: int) -> list[str]:
        t, c = F.count(F.when(F.col("toxic") == 1, 1)), F.count(F.when(F.col("toxic") == 0, 1))
        rated = train.select("toxic", F.explode(F.array_distinct(words)).alias("w")).groupBy("w").agg(t.alias("t"), c.alias("c"))
        rated = rated.where((F.col("t") >= floor) & ((F.col("t") + 0.1) / pos / ((F.col("c") + 0.1) / neg) >= odds))
        return sorted(r["w"] for r in rated.collect())

    begin = F.transform(F.filter(folded, lambda w: F.char_length(w) > STEM), lambda w: F.substring(w, 1, STEM))
    return found(F.filter(folded, lambda w: F.char_length(w) > 2), least), found(F.filter(begin, lambda w: F.octet_length(w) == STEM), 2 * least)


@dataclass
class Model:
    lex: Lexicon
    labels: LabelModel
    weights: np.ndarray


def _votes(lex: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in K.chunks(batch.column(1)):
                counts, n = hits(c, lex)
                rows = np.hstack([counts, n[:, None]])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(c.lo, c.hi - c.lo), pa.array(patterns(counts, n)), pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, VOTERS + 1, dtype=np.int32)), pa.array(rows.reshape(-1)))],
                    names=["toxic", "pattern", "counts"],
                )

    return run


def learn(docs: DataFrame, labels: DataFrame, bound: int = 20_000, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic") -> Model:
    """Mine lexicons from a sample of labelled texts, fit the label model on the votes on all docs, and the classifier on its
    posteriors for a sample of all docs, labelled or not.

    labels are the rows that may be learned from. bound is the parameter that bounds both samples: about so many labelled texts at
    most, chosen by a hash of their id, which can be broadcast; and about so many texts of all docs for the
    classifier, chosen by a hash of the text. Of the votes on all documents only the number of each pattern is gathered, at most
    3 * 2 ** VOTERS. The classifier's targets are the posteriors by the votes and, where a label is given, by that too.

    Defined cases: null and empty texts vote for nothing. A null id or label teaches nothing. An id with several labels counts as
    toxic if one of them says so; rows that repeat an id all get its label. Empty tables give a model of priors and fixed lexicons. Other columns are
    ignored.
    """
    given = labels.where(F.col(toxic_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(toxic_col)).cast("int").alias("toxic"))
    n = given.count()
    if n > bound:
        given = given.where(F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1 << 30)) < int((1 << 30) * (bound / n)))
    given = F.broadcast(given)  # about bound rows
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    lex = lexicon(*mine(rows.join(given, "id").select("toxic", "text")))
    kind = "toxic int, pattern long, counts array<double>"
    marked = rows.join(given, "id", "left").select(F.coalesce("toxic", F.lit(-1)).alias("toxic"), "text")
    counts = {(r[0], r[1]): r[2] for r in marked.mapInArrow(_votes(lex), kind).groupBy("pattern", "toxic").count().collect()}
    model = fit_labels(counts)
    total = sum(counts.values())
    part = int((1 << 30) * min(1.0, bound / max(1, total)))
    sample = marked.where(F.pmod(F.xxhash64("text", F.lit("classifier")), F.lit(1 << 30)) < part).mapInArrow(_votes(lex), kind)
    seen = sample.groupBy("toxic", "pattern", "counts").agg(F.count("*").alias("times")).toArrow()  # about bound texts, equal ones once
    if not seen.num_rows:
        return Model(lex, model, fit_linear(features(np.zeros((1, VOTERS)), np.zeros(1)), np.array([model.prior]), np.ones(1)))
    x = np.stack(seen.column("counts").to_numpy())
    target = model.posterior(votes(x[:, :VOTERS], x[:, VOTERS]), seen.column("toxic").to_numpy())
    return Model(lex, model, fit_linear(features(x[:, :VOTERS], x[:, VOTERS]), target, seen.column("times").to_numpy().astype(float)))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in K.chunks(batch.column(0)):
                counts, n = hits(c, model.lex)
                p = 1 / (1 + np.exp(-np.clip(features(counts, n) @ model.weights, -30, 30)))
                yield pa.RecordBatch.from_arrays([*[x.slice(c.lo, c.hi - c.lo) for x in batch.columns[1:]], pa.array(p)], names=[*batch.schema.names[1:], "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Columns (doc_id, score) for each row, or all of docs and score if carry: the linear classifier's chance that a whole
    text is toxic. A column of docs that is named score gives way to the new one.

    Defined cases: null and empty texts get the score of a text without any evidence. Rows that repeat an id are scored each by
    its own text. An empty table gives an empty result; without labels only the fixed lexicon and the priors speak.
    """
    rest = docs.drop("score") if carry else docs.select(F.col(id_col).alias("doc_id"))
    names = rest.columns
    free = "scored_text"
    while free in names:
        free += "_"
    text = F.col(text_col).cast("string").alias(free)
    base = docs.select(text, *[F.col(c) for c in names]) if carry else docs.select(text, F.col(id_col).alias("doc_id"))
    schema = base.drop(free).schema.add("score", "double")
    return base.mapInArrow(_score(model), schema)


def fold(labels: DataFrame, folds: int = 5, id_col: str = "doc_id") -> DataFrame:
    """The labels that may be learned from: not those of the held-out remainder 0."""
    return labels.where(remainder(F.col(id_col), folds) != 0)
