"""Byte-pair encoding of many short words at once with numpy, for tokenizers whose pieces end at words."""

from __future__ import annotations

import json
import re

import numpy as np

NONE = np.iinfo(np.int32).max
LONGEST = 32
#: A run of lower-case Latin letters and then of ASCII punctuation without apostrophes: two pieces to the tokenizer, nothing to normalise.
PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def byte_chars() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Merges of a vocabulary file, in a hash table of pairs."""

    def __init__(self, path: str):
        with open(path) as f:
            model = json.load(f)["model"]
        end, vocab = model.get("end_of_word_suffix") or "", model["vocab"]
        if not end or len(vocab) >= 1 << 16:
            raise ValueError("not a vocabulary of words with ends")
        chars = byte_chars()
        self.base = np.array([vocab.get(c, 0) for c in chars], np.int32)
        self.last = np.array([vocab.get(c + end, 0) for c in chars], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.bits = 19
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        for rank, (a, b) in enumerate(pairs):
            key = vocab[a] << 16 | vocab[b]
            at = int(self._slot(np.array([key]))[0])
            while self.keys[at] >= 0:
                at = at + 1 & (1 << self.bits) - 1
            self.keys[at], self.ranks[at] = key, rank

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 16 | b
        at = self._slot(key)
        held = self.keys[at]
        out = np.where(held == key, self.ranks[at], NONE)
        left = np.flatnonzero((held != key) & (held >= 0))
        while len(left):
            at[left] = at[left] + 1 & (1 << self.bits) - 1
            held = self.keys[at[left]]
            hit = held == key[left]
            out[left[hit]] = self.ranks[at[left[hit]]]
            left = left[~hit & (held >= 0)]
        return out

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word of LONGEST bytes at most, little-endian 32-bit, as if each were a piece by itself."""
        lens = np.array([len(w) for w in words])
        out: list[bytes] = [b""] * len(words)
        edges = (0, 6, 10, 16, LONGEST)
        for low, high in zip(edges, edges[1:]):
            some = np.flatnonzero((lens > low) & (lens <= high))
            if len(some):
                raw = np.frombuffer(b"".join([words[i].ljust(high, b"\0") for i in some.tolist()]), np.uint8).reshape(len(some), high)
                for i, ids in zip(some.tolist(), self._encode(raw, lens[some])):
                    out[i] = ids
        return out

    def _encode(self, raw: np.ndarray, n: np.ndarray) -> list[bytes]:
        rows, width = raw.shape
        ids = self.base[raw]
        ids[np.arange(rows), n - 1] = self.last[raw[np.arange(rows), n - 1]]
        ranks = np.full((rows, width), NONE, np.int32)
        inner = np.arange(width - 1) < (n - 1)[:, None]
        ranks[:, :-1][inner] = self.rank(ids[:, :-1][inner], ids[:, 1:][inner])
        done, size, own = np.zeros((rows, width), "<u4"), np.zeros(rows, np.int64), np.arange(rows)
        cols = np.arange(width)
        n = n.copy()
        while len(own):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(own)), at]
            over = best == NONE
            if over.any():
                done[own[over]], size[own[over]] = ids[over], n[over]
                keep = ~over
                own, ids, ranks, n, at, best = own[keep], ids[keep], ranks[keep], n[keep], at[keep], best[keep]
                if not len(own):
                    break
            line = np.arange(len(own))
            ids[line, at] = self.made[best]
            source = np.minimum(cols + (cols > at[:, None]), width - 1)
            ids, ranks = np.take_along_axis(ids, source, 1), np.take_along_axis(ranks, source, 1)
            n -= 1
            ranks[:, -1] = NONE
            ranks[line, at] = NONE
            right, left = np.flatnonzero(at + 1 < n), np.flatnonzero(at > 0)
            ranks[right, at[right]] = self.rank(ids[right, at[right]], ids[right, at[right] + 1])
            ranks[left, at[left] - 1] = self.rank(ids[left, at[left] - 1], ids[left, at[left]])
        flat = done[cols < size[:, None]].tobytes()
        ends = (np.cumsum(size) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]
