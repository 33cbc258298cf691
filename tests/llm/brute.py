"""Plain versions of the operators' contracts, for small tables only."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def substrings(docs: list[tuple], size: int = 50) -> dict:
    words = {d: WORD.findall(t or "") for d, t in docs}
    first: dict[tuple, int] = {}
    for d in sorted(words):
        for i in range(len(words[d]) - size + 1):
            first.setdefault(tuple(words[d][i : i + size]), d)
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < d:
                gone[i : i + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def shingles(text: str | None, size: int) -> set:
    w = WORD.findall((text or "").translate(FOLD))
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}


def near(docs: list[tuple], size: int = 4, percent: int = 80) -> dict:
    sets = {d: shingles(t, size) for d, t in docs}
    root = {d: d for d in sets}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    having: dict[tuple, list[int]] = {}
    for d in sorted(sets):
        seen: Counter = Counter()
        for s in sets[d]:
            seen.update(having.get(s, ()))
            having.setdefault(s, []).append(d)
        for e, both in seen.items():
            if 100 * both >= percent * (len(sets[d]) + len(sets[e]) - both):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def quality(text: str | None) -> tuple:
    w = WORD.findall(text or "")
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(windows)
    covered = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed


def licenses(text: str | None) -> tuple:
    w = LICENSE_WORD.findall((text or "").translate(FOLD))
    places, labels = [], set()
    for phrase, label in {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def pieces(docs: list[tuple], tokenizer, size: int) -> dict:
    out = {}
    for d, t in docs:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), size):
            part = ids[k : k + size]
            out[d, k // size] = (k, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)))
    return out


def spark_hash(*texts: str) -> int:
    """Spark's xxhash64 of strings: each hash is the seed of the next."""
    import xxhash

    h = 42
    for t in texts:
        h = xxhash.xxh64(t.encode(), seed=h).intdigest()
    return h - (1 << 64) if h >> 63 else h


def shard(key: str, weights: list[float], seed: int = 0) -> int:
    scores = [(-w / math.log(((spark_hash(key, f"shard {seed} {i}") % (1 << 52)) + 0.5) / (1 << 52)), i) for i, w in enumerate(weights)]
    return max(scores)[1]


def syncmers(text: str, k: int = 3) -> list[tuple]:
    """(run of word hashes, place) of the closed syncmers, with edge marks around the text."""
    edge = [(1 << 63) - 1] * (k - 1)
    h = edge + [spark_hash(w) for w in WORD.findall(text)] + edge
    runs = [tuple(h[i : i + k]) for i in range(len(h) - k + 1)]
    return [(r, i - (k - 1)) for i, r in enumerate(runs) if min(r) in (r[0], r[-1])]


def likeness(a: str, b: str) -> float:
    x, y = ({r for r, _ in syncmers(t)} for t in (a, b))
    return len(x & y) / len(x | y)


def ratios(docs: list[tuple], trusted: set, buckets: int) -> dict:
    """Mean log-likelihood ratio of each text's hashed words, word ends and pairs of words."""

    def grams(text: str) -> list[int]:
        w = WORD.findall(text or "")
        each = [spark_hash(x) for x in w] + [spark_hash("end", x[-2:]) for x in w] + [spark_hash("pair", x, y) for x, y in zip(w, w[1:])]
        return [g % buckets for g in each]

    raw, target = Counter(), Counter()
    for i, t in docs:
        raw.update(grams(t))
        if i in trusted:
            target.update(grams(t))
    a, b = sum(target.values()) + buckets, sum(raw.values()) + buckets
    out = {}
    for i, t in docs:
        g = grams(t)
        out[i] = sum(math.log((target[x] + 1) / a) - math.log((raw[x] + 1) / b) for x in g) / len(g) if g else 0.0
    return out


def license_labels(text: str | None, notices: list, share: float = 0.7, band: int = 6) -> tuple[str, float]:
    """Every notice at every place of a text where its longest mandatory phrase stands: labels and the score."""
    w = LICENSE_WORD.findall((text or "").translate(FOLD))
    labels, best, base = set(), 0.0, False
    for n in notices:
        own = max(n.spans, key=lambda s: len(s[1]))
        for i in range(len(w) - len(own[1]) + 1):
            if tuple(w[i : i + len(own[1])]) != own[1]:
                continue
            b = i - own[0]
            around = lambda at, k: w[(lo := max(0, b + at - band)) : lo + k + 2 * band]  # noqa: B023, E731
            phrase = lambda some, key: any(tuple(some[x : x + len(key)]) == key for x in range(len(some)))
            if not all(phrase(around(at, len(key)), key) for at, key in n.spans if (at, key) != own):
                continue
            value = 1.0 if n.base else len(set(n.words) & set(around(0, len(n.words)))) / len(set(n.words))
            if value >= share:
                labels.add(n.label)
                base |= n.base
                best = max(best, value)
    return ",".join(sorted(labels)), 1.0 if base else best
