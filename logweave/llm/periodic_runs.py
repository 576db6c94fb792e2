"""Periodic runs of words: maximal repetitions found by difference-cover LCE (op 12).

A run is a maximal stretch of words with smallest period q whose length is at least ``MIN_WORDS`` and
three periods.  For each period p the words at a grid of positions i are compared with those at
i + p; the grid's step, max(MIN_WORDS - p, 2p), is the least number of matching pairs that a run of
that period has, so no run slips through, and all grids together have O(n log n) pairs.  A pair
that matches is extended both ways by longest-common-extension queries, which gives the
maximal stretch with period p around it.  The same stretch found with a multiple of its period is
dropped: periods are taken in rising order.

Extensions (``Extension``) use a difference cover: of any two positions some shift below the
modulus takes both to sampled ones.  Up to that shift words are compared one by one; from there
on the longest common prefix of two sampled suffixes is a range minimum over the sorted samples,
from a sparse table.  Only sampled suffixes are sorted, by doubling, and only in texts where some
pair reaches a sampled position at all.  Extensions to the left are those of the reversed words.

Scale: one narrow pass, no shuffle; a text is one row of a task.  Words are numbered as they are read,
a few MB of the text at a time, the pairs are formed in blocks, and long texts take a sparser cover.

Defined results: null text has no words; null doc_ids and repeated rows each keep a row; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import once, rows_of, utf8

MIN_WORDS, MIN_PERIODS = 24, 3
#: Perfect difference covers, modulus: residues (fixed values), and the length from which each is taken.
COVERS = {13: [0, 1, 3, 9], 57: [1, 6, 7, 9, 19, 38, 42, 49]}
LONG_TEXT = 1 << 20
SLICE_BYTES = 1 << 22
PAIR_BLOCK = 1 << 20
WORD_BLOCK = 1 << 16
#: Grids up to this length are kept with the worker; longer texts form theirs in blocks.
KEPT_WORDS = 1 << 15

_GAPS = b" \t\n\r\x0b\x0c"


def words_of(raw: bytes) -> Iterator[list[bytes]]:
    """The words, a slice of the text at a time (``bytes.split`` parts at just these six bytes)."""
    at = 0
    while at < len(raw):
        stop = min(len(raw), at + SLICE_BYTES)
        while stop < len(raw) and raw[stop] not in _GAPS:
            stop += 1
        yield raw[at:stop].split()
        at = stop


def numbered(raw: bytes) -> np.ndarray:
    """Word numbers, equal for equal words, from 1."""
    seen: dict[bytes, int] = {}
    parts = []
    for words in words_of(raw):
        for w in dict.fromkeys(words):
            seen.setdefault(w, len(seen) + 1)
        parts.append(np.array(list(map(seen.__getitem__, words)), np.int32))
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def ranks_of(*columns: np.ndarray) -> np.ndarray:
    """Dense ranks of rows, first column first, from 1."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        held = c[order]
        new[1:] |= held[1:] != held[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) + 1
    return out


class Cover:
    """A difference cover: ``shift[a, b]`` takes residues a and b to sampled ones."""

    def __init__(self, modulus: int):
        sampled = np.zeros(modulus, bool)
        sampled[COVERS[modulus]] = True
        self.modulus, self.sampled = modulus, sampled
        turned = np.array([np.roll(sampled, -a) for a in range(modulus)])
        self.shift = np.argmax(turned[:, None, :] & turned[None, :, :], axis=2).astype(np.int32)

    @classmethod
    def of(cls, n: int) -> Cover:
        modulus = min(COVERS) if n < LONG_TEXT else max(COVERS)
        return once(("cover", modulus), lambda: cls(modulus))


class Extension:
    """Longest common extensions to the right of ``words``."""

    def __init__(self, words: np.ndarray):
        self.words, self.n = words, len(words)
        self.cover = Cover.of(self.n)
        self.built = False

    def _build(self) -> None:
        """Sort the sampled suffixes; longest common prefixes of neighbours; their sparse table."""
        n, v = self.n, self.cover.modulus
        place = np.flatnonzero(self.cover.sampled[np.arange(n) % v]).astype(np.int64)
        m = len(place)
        index = np.full(n + v, -1, np.int32)
        index[place] = np.arange(m)
        padded = np.concatenate([self.words, np.zeros(v, self.words.dtype)])
        ranks = ranks_of(*[padded[place + k] for k in range(v)])
        levels, step = [ranks], v
        # Samples stay samples when moved by the modulus, so doubling never leaves them.
        while step < n and ranks.max() < m:
            after = place + step
            then = index[np.minimum(after, n)]
            ranks = ranks_of(ranks, np.where((after < n) & (then >= 0), ranks[then], 0))
            levels.append(ranks)
            step *= 2
        order = np.argsort(ranks)
        a, b = place[order[:-1]], place[order[1:]]
        common = np.zeros(m - 1 if m else 0, np.int32)
        for k in range(len(levels) - 1, -1, -1):  # a level's step is taken at most once, longest first
            width = v << k
            x, y = a + common, b + common
            inside = (x + width <= n) & (y + width <= n)
            ix, iy = index[np.minimum(x, n)], index[np.minimum(y, n)]
            common += np.where(inside & (levels[k][ix] == levels[k][iy]), width, 0).astype(np.int32)
        common += self._stepped(a + common, b + common, np.full(len(a), v, np.int32))
        table = [common]
        while 2 << (len(table) - 1) <= len(common):
            half, last = 1 << (len(table) - 1), table[-1]
            table.append(np.minimum(last[:-half], last[half:]))
        self.index, self.table, self.built = index, table, True
        self.rank = np.empty(m, np.int64)
        self.rank[order] = np.arange(m)

    def _stepped(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words are equal, compared one by one and at most ``most``."""
        out = np.zeros(len(x), np.int32)
        live = np.arange(len(x))
        for k in range(int(most.max(initial=0))):
            i, j = x[live] + k, y[live] + k
            live = live[(most[live] > k) & (np.maximum(i, j) < self.n)]
            live = live[self.words[x[live] + k] == self.words[y[live] + k]]
            if not len(live):
                break
            out[live] += 1
        return out

    def of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The longest common extension of each pair of different positions (n: no word left)."""
        v = self.cover.modulus
        shift = self.cover.shift[x % v, y % v]
        out = self._stepped(x, y, shift)
        reach = np.flatnonzero((out == shift) & (np.maximum(x, y) + shift < self.n))
        # Most pairs of common words end at the sampled place itself.
        reach = reach[self.words[x[reach] + out[reach]] == self.words[y[reach] + out[reach]]]
        if not len(reach):
            return out
        if not self.built:
            self._build()
        a, b = (self.rank[self.index[p[reach] + out[reach]]] for p in (x, y))
        low, width = np.minimum(a, b), np.abs(a - b)
        level = np.frexp(width)[1] - 1
        for k in np.unique(level).tolist():
            at = level == k
            t = self.table[k]
            out[reach[at]] += np.minimum(t[low[at]], t[low[at] + width[at] - (1 << k)])
        return out


def grid(n: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, p) for periods first..last: positions i with i + p < n, a step of the least run apart."""
    p = np.arange(first, last + 1)
    step = np.maximum(MIN_WORDS - p, (MIN_PERIODS - 1) * p)
    count = -(-(n - p) // step)
    offset = np.cumsum(count) - count
    i = (np.arange(count.sum()) - np.repeat(offset, count)) * np.repeat(step, count)
    return i, np.repeat(p, count)


def _kept_grid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i, p = grid(KEPT_WORDS, 1, KEPT_WORDS // MIN_PERIODS)
    order = np.argsort(i + p, kind="stable")
    return i[order].astype(np.int32), p[order].astype(np.int32), (i + p)[order].astype(np.int32)


def pairs(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of grid pairs (i, i + p) of a text of n words."""
    if n <= KEPT_WORDS:
        i, _, j = once(("run grid",), _kept_grid)
        stop = np.searchsorted(j, np.int32(n))  # ordered by the second position: those inside come first
        yield i[:stop], j[:stop]
        return
    first = 1
    while first <= n // MIN_PERIODS:
        width = max(1, PAIR_BLOCK * max(MIN_WORDS - first, (MIN_PERIODS - 1) * first) // n)
        last = min(n // MIN_PERIODS, first + width - 1)
        i, p = grid(n, first, last)
        yield i, i + p
        first = last + 1


def runs_of(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period."""
    n = len(words)
    if n < MIN_WORDS:
        return []
    right = left = None
    found: dict[tuple[int, int], int] = {}
    for i, j in pairs(n):
        same = np.flatnonzero(words[i] == words[j])
        if not len(same):
            continue
        i, j = i[same].astype(np.int64), j[same].astype(np.int64)
        if right is None:
            right, left = Extension(words), Extension(words[::-1])
        after = right.of(i, j)
        before = np.zeros(len(i), np.int64)
        inner = np.flatnonzero(i > 0)
        before[inner] = left.of(n - i[inner], n - j[inner])  # the words before i and j, read backwards
        start, period = i - before, j - i
        length = before + after + period
        enough = length >= np.maximum(MIN_WORDS, MIN_PERIODS * period)
        if not enough.any():
            continue
        for s, e, p in np.unique(np.column_stack([start, start + length, period])[enough], axis=0).tolist():
            found[s, e] = min(p, found.get((s, e), p))
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether a word lies in some run behind that run's first period."""
    edge = np.zeros(n + 1, np.int32)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) > 0


Rewrite = Callable[[int | None, int], np.ndarray | None]


REPORT = pa.schema([*[(c, pa.int64()) for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")],
                    ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])


def report(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """One row a document: its runs' number and digest, the strongest run and the collapsed text's digest.

    ``rewrite(doc_id, n)`` may give the numbers of the words that stand in for a text's n words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc_id, *_reported(doc_id, raw, rewrite)) for doc_id, raw in rows_of([batch], "doc_id", "text")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(REPORT)],
                                             schema=REPORT)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_runs long, start long, length long, period long, "
                                  "exponent_milli long, runs_sha256 string, collapsed_sha256 string")


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, start, length, period) of every run; documents without runs have no row."""
    names = ["doc_id", "start", "length", "period"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, raw in rows_of(batches, "doc_id", "text"):
            rows = [(doc_id, *r) for r in runs_of(numbered(raw))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))
    return narrow.mapInArrow(run, "doc_id long, start long, length long, period long")


def collapse(docs: DataFrame) -> DataFrame:
    """``docs`` with every run cut to its first period; texts without a run keep their white space, null stays null."""

    def cut(raw: bytes) -> str:
        runs = runs_of(numbered(raw))
        if not runs:
            return raw.decode()
        starts, ends = word_bounds(raw)
        keep = ~dropped(len(starts), runs)
        return b" ".join([raw[s:e] for s, e in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)]).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None else cut(t.encode()) for (t,) in rows_of([batch], "text")]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    return docs.mapInArrow(run, docs.schema)


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of the words and the bytes behind them."""
    gap = np.zeros(256, bool)
    gap[list(_GAPS)] = True
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~gap[np.frombuffer(raw, np.uint8)]
    turn = np.diff(inside)
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)


def joined_digest(raw: bytes, keep: np.ndarray | None) -> str:
    """SHA-256 of the kept words (numbers in any order; None: all) joined by one space."""
    starts, ends = word_bounds(raw)
    if keep is not None:
        starts, ends = starts[keep], ends[keep]
    digest = hashlib.sha256()
    for at in range(0, len(starts), WORD_BLOCK):
        block = zip(starts[at:at + WORD_BLOCK].tolist(), ends[at:at + WORD_BLOCK].tolist(), strict=True)
        digest.update((b" " if at else b"") + b" ".join([raw[s:e] for s, e in block]))
    return digest.hexdigest()


def _reported(doc_id: int | None, raw: bytes, rewrite: Rewrite | None) -> tuple:
    words = numbered(raw)
    stand_in = rewrite(doc_id, len(words)) if rewrite else None
    if stand_in is not None:
        words = words[stand_in]
    runs = runs_of(words)
    listed = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    keep = stand_in
    if runs:
        kept = ~dropped(len(words), runs)
        keep = np.flatnonzero(kept) if stand_in is None else stand_in[kept]
    strongest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *strongest, hashlib.sha256(listed.encode()).hexdigest(), joined_digest(raw, keep))


def contract_rewrite(doc_id: int | None, n: int) -> np.ndarray | None:
    """The registered query's planted repetitions; rows without an id keep their text."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    i[a:] = a + (i[a:] - a) % p
    return i
