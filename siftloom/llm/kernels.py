"""Vectorised text kernels on Arrow buffers: words, hashes of word windows, SuperMinHash.

All of them see a chunk of whole documents as one byte array with offsets, so the work per byte is
a handful of numpy passes and never a Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Words are runs of other bytes than space and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Words are runs of ASCII letters and digits and of bytes beyond ASCII.
PUNCT = np.ones(256, bool)
PUNCT[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_SPAN = 4096
_BLOCK = 1 << 19


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_PLACE = mix64(np.arange(1, _SPAN + 1, dtype=U64) * U64(0xD1342543DE82EF95)) | U64(1)
_BASE = U64(0x5851F42D4C957F2D)
_BASE_INV = U64(pow(0x5851F42D4C957F2D, -1, 1 << 64))


@dataclass
class Chunk:
    """Whole documents lo..hi of a batch: their bytes, and offsets that begin at 0."""

    lo: int
    hi: int
    data: np.ndarray
    offs: np.ndarray


def chunks(column: pa.Array, limit: int = 1 << 20) -> Iterator[Chunk]:
    """Cut a string column into runs of whole documents of about limit bytes. A null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offs = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield Chunk(lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


@dataclass
class Words:
    """starts, ends: byte places of each word; ptr: first word of each document, and the number of all."""

    starts: np.ndarray
    ends: np.ndarray
    ptr: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def place(self) -> np.ndarray:
        """Each word's number within its document."""
        return np.arange(len(self.starts)) - np.repeat(self.ptr[:-1], self.counts)

    def left(self) -> np.ndarray:
        """Words from each word to its document's end, itself included."""
        return np.repeat(self.ptr[1:], self.counts) - np.arange(len(self.starts))


def words(data: np.ndarray, offs: np.ndarray, sep: np.ndarray = SPACE) -> Words:
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(offs), np.int64))
    inside = ~sep[data]
    cuts = offs[(offs > 0) & (offs < n)]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[cuts], after[cuts - 1] = False, False
    starts = np.flatnonzero(inside & ~before)
    return Words(starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offs))


def word_hashes(data: np.ndarray, w: Words, fold: bool = False, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes (A-Z as a-z if fold), made in blocks so that memory stays small.

    Each byte counts by its place among 4096; a longer word is a chain of such pieces, each mixed with its number. Another seed
    gives a hash that is independent of the others.
    """
    out = np.empty(len(w.starts), U64)
    table = _BYTE if not seed else mix64(_BYTE + U64(seed) * U64(0xA24BAED4963EE407))
    i = 0
    while i < len(out):
        j = max(i + 1, int(np.searchsorted(w.ends, w.starts[i] + _BLOCK, "right")))
        a, lens = int(w.starts[i]), w.ends[i:j] - w.starts[i:j]
        total = int(lens.sum())
        first = np.cumsum(lens) - lens
        place = np.arange(total) - np.repeat(first, lens)
        byte = data[np.repeat(w.starts[i:j], lens) + place] if j - i > 1 else data[a : a + total]
        if fold:
            byte = LOWER[byte]
        pieces = first
        if long := int(lens.max()) > _SPAN:
            pieces = np.flatnonzero(place & (_SPAN - 1) == 0)
        sums = np.add.reduceat(table[byte] * _PLACE[place & (_SPAN - 1)], pieces)
        if long:
            later = (place[pieces] // _SPAN).astype(U64)
            chained = np.where(later > 0, mix64(sums + later * U64(0x9FB21C651E98DF25)), sums)
            sums = np.add.reduceat(chained, np.searchsorted(pieces, first))
        out[i:j] = sums + lens.astype(U64) * U64(0xA0761D6478BD642F)
        i = j
    return mix64(out)


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of h[i : i + size] for each i. Windows that run over a document's end are for the caller to leave out."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    powers = np.cumprod(np.full(len(h), _BASE, U64))
    back = np.cumprod(np.full(n, _BASE_INV, U64))
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(h * powers, dtype=U64)])
    return mix64((sums[size:] - sums[:-size]) * back + U64(size))


def shingles(data: np.ndarray, offs: np.ndarray, size: int, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted, and where each document's begin.

    A document of fewer words than size has one shingle, its whole sequence; one without words has none.
    """
    w = words(data, offs)
    h = word_hashes(data, w, fold)
    wins = window_hashes(h, size)
    sets = []
    for a, b in zip(w.ptr[:-1].tolist(), w.ptr[1:].tolist()):
        if b - a >= size:
            sets.append(np.unique(wins[a : b - size + 1]))
        elif b > a:
            sets.append(window_hashes(h[a:b], b - a))
        else:
            sets.append(np.zeros(0, U64))
    return (np.concatenate(sets) if sets else np.zeros(0, U64)), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def superminhash(h: np.ndarray, ptr: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signatures (one row of m for each document) of the elements h[ptr[d] : ptr[d + 1]].

    In round j each element puts the value j + r into the slot its own random permutation has at j, so its ranks
    differ from slot to slot, which lowers the variance. A document is done after the first round in which all its
    slots hold a value below j + 1, as later rounds only bring greater ones.
    """
    docs = len(ptr) - 1
    sig = np.full(docs * m, np.iinfo(np.uint64).max, U64)
    doc = np.repeat(np.arange(docs), np.diff(ptr))
    steps: list[np.ndarray] = []
    for j in range(m):
        if not len(h):
            break
        r = mix64(h + U64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        step = (j + (((r >> U64(32)) * U64(m - j)) >> U64(32)).astype(np.int64)).astype(np.int16)
        slot = step
        for i in range(j - 1, -1, -1):  # follow the swaps of the earlier rounds back
            slot = np.where(slot == steps[i], np.int16(i), slot)
        np.minimum.at(sig, doc * m + slot, (U64(j) << U64(56)) | (mix64(r ^ U64(0xE7037ED1A0B428DB)) >> U64(8)))
        steps.append(step)
        live = np.unique(doc) if j else np.flatnonzero(np.diff(ptr))
        done = np.zeros(docs, bool)
        done[live] = (sig.reshape(docs, m)[live].max(axis=1) >> U64(56)) <= U64(j)
        if done.any():
            keep = ~done[doc]
            h, doc, steps = h[keep], doc[keep], [s[keep] for s in steps]
    return sig.reshape(docs, m)


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of so many rows; the band's number is part of the key."""
    docs, m = sig.shape
    n = m // rows
    parts = sig[:, : n * rows].reshape(docs, n, rows)
    acc = np.broadcast_to(np.arange(1, n + 1, dtype=U64) * U64(0x8CB92BA72F3D8DD7), (docs, n)).copy()
    for i in range(rows):
        acc = mix64(acc ^ parts[:, :, i]) + U64(i + 1)
    return mix64(acc)


def signed(x: np.ndarray) -> pa.Array:
    """Spark has no unsigned longs."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))
