"""Best-fit packing of tokenised documents into fixed-length sequences by exact-complement hashing."""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import checkpoint
from .wordbpe import LONGEST, PLAIN, WordBpe

#: Runs of text whose ids a Python worker remembers: bytes of those met again, and of those met once of late, with what Python adds to each.
OFTEN_BYTES, RECENT_BYTES = 32 << 20, 16 << 20
_ENTRY = 200
_state: dict[str, tuple] = {}


def _tokenizer(path: str) -> tuple:
    """The tokenizer of a path, its fast way for plain words, whether it may read a text run by run, and what is remembered; kept for
    the worker's life."""
    if path not in _state:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
        by_runs = not any(c.split() != [c] for c in added) and ids(" the  cat\nsat don't ") == ids("the") + ids("cat") + ids("sat") + ids("don't")
        plain = by_runs and not any(PLAIN.fullmatch(c.lower()) for c in added)
        _state[path] = (tokenizer, _word_bpe(path, tokenizer) if plain else None, by_runs, Memory())
    return _state[path]


class Memory:
    """Ids of runs, bounded by bytes."""

    def __init__(self):
        self.often: dict[bytes, bytes] = {}
        self.recent: dict[bytes, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.sizes = [0, 0]

    def get(self, run: bytes) -> bytes | None:
        """A run that is met again is kept for good as long as there is room, so runs that occur once don't push it out."""
        known = self.often.get(run)
        if known is None:
            known = self.recent.get(run)
            if known is not None and self.sizes[0] < OFTEN_BYTES:
                self.often[run] = known
                self.sizes[0] += len(run) + len(known) + _ENTRY
        return known

    def add(self, new: dict[bytes, bytes]) -> None:
        for run, ids in new.items():
            if self.sizes[1] > RECENT_BYTES:
                self.recent.clear()
                self.sizes[1] = 0
            self.recent[run] = ids
            self.sizes[1] += len(run) + len(ids) + _ENTRY


#: Runs on which the fast way must agree with the tokenizer before it is used.
PROBES = ("a", "the", "licensed", "überprüft", "épaleelle", "ciónez.", "onthandndtiea,", "zz!!", "word***", "straße", "ñandú;", "it's", "İx", "don't!", "x" * 31, "thereandthenagainandagain")


def _word_bpe(path: str, tokenizer) -> WordBpe | None:
    """The fast way for plain words, if the file is of its kind and both agree on the probes."""
    try:
        bpe = WordBpe(path)
        plain = [m for m in map(PLAIN.fullmatch, PROBES) if m]
        same = all(bpe.encode([m[1].encode()])[0] == array("I", tokenizer.encode(m[1], add_special_tokens=False).ids).tobytes() for m in plain)
        apart = all(tokenizer.encode(m[0], add_special_tokens=False).ids == tokenizer.encode(m[1], add_special_tokens=False).ids + (tokenizer.encode(m[2], add_special_tokens=False).ids if m[2] else []) for m in plain)
    except (ValueError, KeyError, TypeError):
        return None
    return bpe if same and apart else None


def _encode_new(missing: list[bytes], tokenizer, bpe: WordBpe | None, marks: dict[str, bytes]) -> dict[bytes, bytes]:
    """Ids of runs that aren't remembered: plain words all at once, others by the tokenizer."""
    new: dict[bytes, bytes] = {}
    words: dict[str, int] = {}
    plain, rest = [], missing
    if bpe is not None:
        rest = []
        for run in missing:
            m = PLAIN.fullmatch(run.decode().lower()) if len(run) <= LONGEST else None
            if m is None or len(m[1]) > LONGEST // 2:
                rest.append(run)
            else:
                word, mark = m.groups()
                if mark not in marks:
                    if len(marks) > 10_000:
                        marks.clear()
                    marks[mark] = array("I", tokenizer.encode(mark, add_special_tokens=False).ids).tobytes() if mark else b""
                plain.append((run, words.setdefault(word, len(words)), marks[mark]))
        coded = bpe.encode([w.encode() for w in words])
        new = {run: coded[i] + mark for run, i, mark in plain}
    found = tokenizer.encode_batch_fast([r.decode() for r in rest], add_special_tokens=False)
    new.update((r, array("I", e.ids).tobytes()) for r, e in zip(rest, found))
    return new


def encode(texts: list[bytes], path: str, memory: Memory | None = None) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit numbers.

    A tokenizer that drops white space never joins across it, so a text's ids are those of its runs of other bytes,
    which repeat a lot. Each run is looked up once a call, and in what the worker remembers.
    """
    tokenizer, bpe, by_runs, held = _tokenizer(path)
    memory = memory or held
    if not by_runs:
        return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
    runs = [x.split() for x in texts]
    ids: dict[bytes, bytes] = {}
    missing = []
    for run in set().union(*runs):
        known = memory.get(run)
        if known is None:
            missing.append(run)
        else:
            ids[run] = known
    new = _encode_new(missing, tokenizer, bpe, memory.marks)
    memory.add(new)
    ids.update(new)
    return [b"".join(map(ids.__getitem__, x)) for x in runs]


def _pieces(path: str, size: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = int(end).to_bytes(4, "little")
        for batch in batches:
            for c in K.chunks(batch.column(1), 1 << 22):
                raw, offs = c.data.tobytes(), c.offs.tolist()
                rows: list[tuple] = []
                ids = encode([raw[a:b] for a, b in zip(offs, offs[1:])], path)
                for key, tokens in zip(batch.column(0).slice(c.lo, c.hi - c.lo).to_pylist(), ids):
                    tokens += last
                    for k in range(0, len(tokens), 4 * size):
                        part = tokens[k : k + 4 * size]
                        rows.append((key, k // (4 * size), k // 4, len(part) // 4, zlib.crc32(part)))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.column(0).type), pa.array(cols[1], pa.int32()), *[pa.array(x, pa.int64()) for x in cols[2:]]], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def plan(counts: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """(times, lengths) pairs: so many sequences hold pieces of these lengths; together they use up counts exactly.

    Lengths are taken from the longest down. While one has pieces, its gap is looked up in the index of single lengths,
    then in that of pair sums, then as a length and a pair sum (triples), and the combination found is used as often as
    all its members are available, which exhausts at least one of them. Pair sums are kept as numbers of available
    pairs, so losing a length updates one row. What no combination completes is packed best fit, longest first, into
    the open sequence with the smallest gap that is large enough; equal sequences are moved in bulk. Work and result
    are bounded by size, whatever the number of pieces.
    """
    have = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        have[length] += n
    out: list[tuple[int, list[int]]] = []
    if have[size]:
        out.append((int(have[size]), [size]))
        have[size] = 0
    alive = have > 0
    alive[0] = False
    pairs = np.zeros(size + 1, np.int64)  # available pairs a <= b by sum
    for a in np.flatnonzero(alive):
        sums = a + np.flatnonzero(alive[a:]) + a
        np.add.at(pairs, sums[sums <= size], 1)

    def lose(a: int) -> None:
        sums = a + np.flatnonzero(alive)
        np.subtract.at(pairs, sums[sums <= size], 1)
        alive[a] = False

    def pair(gap: int) -> Iterator[list[int]]:
        if gap >= 2 and pairs[gap]:
            half = np.arange(gap // 2, 0, -1)  # the most even pair first: short pieces stay for small gaps
            for a in half[alive[half] & alive[gap - half]].tolist():
                yield [gap - a, a]

    def complement(gap: int) -> Iterator[list[int]]:
        if alive[gap]:
            yield [gap]
        yield from pair(gap)
        third = np.arange(gap - 2, 0, -1)
        for a in third[alive[third] & (pairs[gap - third] > 0)].tolist():
            for two in pair(gap - a):
                yield [a, *two]

    def times(use: list[int]) -> int:
        return min(int(have[x]) // use.count(x) for x in use)

    for length in range(size - 1, 0, -1):
        while alive[length]:
            use = next((u for u in ([length, *c] for c in complement(size - length)) if times(u)), None)
            if use is None:
                break
            n = times(use)
            out.append((n, use))
            for x in use:
                have[x] -= n
            for x in set(use):
                if not have[x]:
                    lose(x)
    gaps: dict[int, list[tuple[int, list[int]]]] = {}
    open_gaps = np.zeros(size + 1, bool)

    def put(n: int, use: list[int]) -> None:
        gap = size - sum(use)
        gaps.setdefault(gap, []).append((n, use))
        open_gaps[gap] = True

    for length in range(size - 1, 0, -1):
        left = int(have[length])
        while left:
            fits = np.flatnonzero(open_gaps[length:])
            if not len(fits):
                each = min(left, size // length)
                n = left // each
                put(n, [length] * each)
                left -= n * each
                continue
            gap = length + int(fits[0])
            there, use = gaps[gap].pop()
            if not gaps[gap]:
                open_gaps[gap] = False
            each = min(gap // length, left)
            n = min(there, left // each)
            if n < there:
                put(there - n, use)
            put(n, use + [length] * each)
            left -= n * each
    return out + [x for group in gaps.values() for x in group]


def _slots(plan_: list[tuple[int, list[int]]], size: int) -> tuple[np.ndarray, ...]:
    """Where the pieces of each length go, as ranges of their ranks: (key, first sequence, offset, step)."""
    used = np.zeros(size + 1, np.int64)
    rows, base = [], 0
    for times, use in plan_:
        at = 0
        for length in use:
            rows.append((length, int(used[length]), base, at))
            used[length] += times
            at += length
        base += times
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows)) if rows else tuple(np.zeros(0, np.int64) for _ in range(4))


def _place(slots: tuple[np.ndarray, ...], size: int):
    lengths, ranks, firsts, offsets = slots
    begin = np.searchsorted(lengths, np.arange(size + 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cut = np.flatnonzero(np.diff(length[order])) + 1
            for some in np.split(order, cut) if len(order) else []:
                a, b = begin[length[some[0]]], begin[length[some[0]] + 1]
                at[some] = a + np.searchsorted(ranks[a:b], rank[some], "right") - 1
            keep = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(firsts[at] + rank - ranks[at]), pa.array(offsets[at])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, end: int = 1, id_col: str = "doc_id", text_col: str = "text", chunk: int = 50_000) -> DataFrame:
    """Pack the tokens of all documents into few sequences of at most size tokens.

    Columns (doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece. A document is its ids without
    added special tokens (a special token's own string in a text gets its id, as the tokenizer reads it) and then the id end; only one longer than size is cut, into pieces of size and a last of the rest.

    Pieces are counted by length, at most size numbers; from them the driver makes a plan whose size doesn't depend on
    the number of pieces (see plan). Each piece gets its rank among those of its length by counts of chunks of about
    chunk rows, so that a length that holds a third of all pieces is ranked by many tasks, and finds its sequence and
    offset by its rank.

    Defined cases: null and empty texts have the one id end. Repeated rows and repeated ids are packed once for each
    row. A null id is packed like others. An empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(base.dtypes)["doc_id"]
    pieces = checkpoint(base.mapInArrow(_pieces(tokenizer, size, end), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"))
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}  # at most size rows
    slots = _slots(plan(counts, size), size)

    of_length = pieces.groupBy("length").agg(F.ceil(F.count("*") / chunk).alias("parts"))
    salted = pieces.join(F.broadcast(of_length), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("parts")))
    before = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).withColumn("before", F.expr("sum(n) over (partition by length order by salt rows between unbounded preceding and 1 preceding)"))
    ranked = salted.withColumn("own", F.expr("row_number() over (partition by length, salt order by doc_id, piece)"))
    ranked = ranked.join(before.select("length", "salt", "before"), ["length", "salt"]).withColumn("rank", F.coalesce("before", F.lit(0)) + F.col("own") - 1)
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_place(slots, size), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
