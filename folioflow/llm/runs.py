"""Periodic runs of words: every stretch that repeats its first words at least twice, found by the LPF array.

A run is a stretch of words with smallest period q and at least max(``least``, 2q) words that no neighbour extends. Per text:

1. Words become numbers. Doubling gives, level by level, the classes of equal stretches of 1, 2, 4, ... words, and in the end the suffix
   array. All extensions (how far two places agree to the right or to the left) are read off these classes by halving
   steps, for whole arrays of places at once; so is the LCP array.
2. A run of at least ``least`` words repeats ceil(least / 2) words a period later. Where no LCP is that large there is no run.
3. The longest previous factor of each place, and where it stands, from the suffix array's neighbours, taken out from the last place to the first.
4. Lempel-Ziv blocks: each the longest stretch that also starts earlier, or one new word.
5. Main's extensions at each border between blocks, for periods up to the two blocks' lengths together. A run that ends in a block and
   starts at or before its border has its period in that bound: were a block's border a period or more after the run's start, the
   block would reach the run's end, for those words stand a period earlier; so the run's last period lies in the block and the one before.
6. Runs strictly inside a block stand in its earlier copy too: runs are kept in buckets by their start, and those of the copy are
   written anew, from left to right, so that copies of copies come as well.

Two periods found for one stretch are multiples of its smallest, which is found too; the smallest is kept.

A text is worked on in one task, in memory of some dozens of bytes a word (4 for each level up to its longest repetition); texts do
not meet each other and nothing is shuffled.

Defined results: null and empty texts have no words, no run, and the digests of nothing; a null doc_id is rewritten by no rule; repeated rows
are treated each for itself; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST = 12


class Places:
    """Classes of equal stretches of a row of numbers, its suffix array, and extensions between places."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.n = n
        self.levels: list[np.ndarray] = []  # classes of stretches of 2^j words from each place; those cut by the end have their own
        now = np.zeros(n + 1, np.int32)
        now[:n] = words + 1
        width = 1
        while True:
            self.levels.append(now)
            key = now[:n].astype(np.int64) * (int(now.max()) + 1)
            key[: max(0, n - width)] += now[width:n]
            order = np.argsort(key, kind="stable")
            new = np.empty(n, bool)
            new[:1] = True
            new[1:] = key[order[1:]] != key[order[:-1]]
            now = np.zeros(n + 1, np.int32)
            now[order] = np.cumsum(new)
            width *= 2
            if new.all():
                break
        self.suffixes = order

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words from places a and b on, a != b."""
        a, b = a.copy(), b.copy()
        start = a.copy()
        for j in range(len(self.levels) - 1, -1, -1):
            same = self.levels[j][a] == self.levels[j][b]
            a += same << j
            b += same << j
        return a - start

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words before places a and b, a != b."""
        a, b = a.copy(), b.copy()
        start = a.copy()
        for j in range(len(self.levels) - 1, -1, -1):
            x, y = a - (1 << j), b - (1 << j)
            inside = (x >= 0) & (y >= 0)
            same = inside & (self.levels[j][np.where(inside, x, 0)] == self.levels[j][np.where(inside, y, 0)])
            a -= same << j
            b -= same << j
        return start - a


def previous_factors(suffixes: np.ndarray, common_prefix: np.ndarray) -> tuple[list[int], list[int]]:
    """Longest previous factor of each place and an earlier place where it stands (-1: none)."""
    n = len(suffixes)
    order, rank = suffixes.tolist(), np.empty(n, np.int64)
    rank[suffixes] = np.arange(n)
    rank = rank.tolist()
    lcp = [*common_prefix.tolist(), 0]  # with the one before in the suffix array
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    length, source = [0] * n, [-1] * n
    for place in range(n - 1, -1, -1):  # later places are gone: both neighbours stand earlier in the text
        r = rank[place]
        p, q = before[r], after[r]
        up, down = lcp[r], lcp[q]
        if up >= down:
            if up:
                length[place], source[place] = up, order[p]
        else:
            length[place], source[place] = down, order[q]
        if down > up:
            lcp[q] = up
        if q < n:
            before[q] = p
        if p >= 0:
            after[p] = q
    return length, source


def blocks_of(length: list[int], source: list[int]) -> list[tuple[int, int, int]]:
    """Lempel-Ziv blocks as (start, end, earlier place or -1)."""
    out, at = [], 0
    while at < len(length):
        size = max(1, length[at])
        out.append((at, at + size, source[at] if length[at] else -1))
        at += size
    return out


def at_borders(places: Places, blocks: list[tuple[int, int, int]], least: int, together: int = 1 << 16) -> dict[tuple[int, int], int]:
    """(start, end) -> smallest period found, for runs that reach over or touch a border from the left."""
    found: dict[tuple[int, int], int] = {}
    borders, limits = [], []
    for k in range(1, len(blocks) + 1):
        start, end = (blocks[k][:2]) if k < len(blocks) else (places.n, places.n)
        borders.append(start)
        limits.append(end - blocks[k - 1][0])
    i = 0
    while i < len(borders):
        # as many borders at once as come to about `together` periods; a border with more goes by itself in slices
        j, total = i, 0
        while j < len(borders) and (j == i or total + limits[j] <= together):
            total += limits[j]
            j += 1
        if j == i + 1:
            for low in range(1, limits[i] + 1, together):
                p = np.arange(low, min(low + together, limits[i] + 1))
                _extend(places, np.full(len(p), borders[i]), p, least, found)
        else:
            sizes = np.array(limits[i:j])
            p = np.arange(1, total + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            _extend(places, np.repeat(np.array(borders[i:j]), sizes), p, least, found)
        i = j
    return found


def _extend(places: Places, c: np.ndarray, p: np.ndarray, least: int, found: dict) -> None:
    for other in (c - p, c + p):
        inside = (other >= 0) & (other <= places.n)
        a, b, q = c[inside], other[inside], p[inside]
        right, left = places.right(a, b), places.left(a, b)
        low, high = np.minimum(a, b) - left, np.maximum(a, b) + right
        for start, end, period in zip(*(x[high - low >= np.maximum(least, 2 * q)].tolist() for x in (low, high, q)), strict=True):
            if period < found.get((start, end), period + 1):
                found[start, end] = period


def find_runs(words: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least max(least, 2 * period) words, by start, then period."""
    n = len(words)
    if n < max(2, least):
        return []
    places = Places(words)
    common_prefix = np.zeros(n, np.int64)
    common_prefix[1:] = places.right(places.suffixes[:-1], places.suffixes[1:])
    if common_prefix.max() < -(-least // 2):
        return []
    blocks = blocks_of(*previous_factors(places.suffixes, common_prefix))
    found = at_borders(places, blocks, least)
    buckets: dict[int, list[tuple[int, int]]] = {}
    for (start, end), period in found.items():
        buckets.setdefault(start, []).append((end, period))
    starts = sorted(buckets)
    for low, high, source in blocks:
        if source < 0 or high - low < least:
            continue
        shift, at = low - source, bisect_right(starts, source)
        while at < len(starts) and starts[at] + shift < high:
            for end, period in list(buckets[starts[at]]):
                start = starts[at] + shift
                if end + shift < high and (start, end + shift) not in found:
                    found[start, end + shift] = period
                    if start not in buckets:
                        buckets[start] = []
                        insort(starts, start)
                    buckets[start].append((end + shift, period))
            at += 1
    return sorted((start, end - start, period) for (start, end), period in found.items())


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each word stays: those of a run after its first period go."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def repeat_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """Texts of one id in ten get a periodic end, as a test of strong repetition; others stay."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def numbers_of(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))


FIELDS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def digest_runs(docs: DataFrame, least: int = LEAST, rewrite=repeat_tail) -> DataFrame:
    """docs(doc_id, text) -> FIELDS: number of runs, the longest one, digests of all runs and of the text without repetitions.

    rewrite: a change of (words, doc_id) made first; None for the texts as they are.
    """

    def row(doc: int | None, text: bytes | None):
        words = (text or b"").split()
        if rewrite is not None:
            words = rewrite(words, doc)
        runs = find_runs(numbers_of(words), least)
        lines = hashlib.sha256()
        for run in runs:
            lines.update(b"%d,%d,%d\n" % run)
        if runs:
            stays = kept_words(len(words), runs).tolist()
            words = [w for w, s in zip(words, stays, strict=True) if s]
            start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]))
            best = start, length, period, 1000 * length // period
        else:
            best = None, None, None, None
        return len(runs), *best, lines.hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()

    def run(batches):
        for b in batches:
            for low in range(0, b.num_rows, 200):
                part = b.slice(low, 200)
                rows = [row(d.as_py(), t.as_py()) for d, t in zip(part.column(0), part.column(1), strict=True)]
                columns = list(zip(*rows, strict=True))
                yield pa.record_batch([part.column(0), *(pa.array(c, pa.int64()) for c in columns[:5]), *(pa.array(c, pa.string()) for c in columns[5:])], [f.split()[0] for f in FIELDS.split(", ")])

    return common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), FIELDS, lambda: run)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_runs(common.table(spark, sf_dir, "documents"))
