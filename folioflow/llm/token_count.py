"""Token counts under a unigram model, by dynamic programming over a trie of distinct pre-tokens.

The pieces are the byte strings of a byte-level vocabulary (all 256 bytes are pieces, so every text can be written);
a piece of rank r has probability proportional to 1 / (r + 2), so its score is -ln(r + 2). A pre-token's segmentation
is the one with the largest sum of scores; of equal ones, that whose last piece is shortest, and so on backwards.

A text is cut into pre-tokens by the vocabulary's pattern. Each task keeps the counts of the pre-tokens it has seen;
the new ones of a batch are sorted, which lays out their trie: a node is a prefix, and its best score is worked out
once for all pre-tokens that share it. Short ones (up to ``LONG`` bytes) are worked out one depth at a time over all nodes
of that depth; longer ones follow their path through the trie, from where it leaves the one before. Counts are kept at
the terminals. Memory is bounded: at most ``remember`` pre-tokens are kept by a task, ``at_once`` go into one trie, and
a long one's scores are kept for its first ``SHARED`` bytes only (what is shared beyond them is worked out again).

Defined results: null or empty text has no pre-tokens and no tokens; repeated rows are counted separately; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .packing import byte_letters, default_vocabulary

LONG = 48
SHARED = 1 << 18
PIECE = 1 << 16  # bytes of a long pre-token whose matches are looked up at once
FACTOR = np.uint64(0x9E3779B97F4A7C15 | 1)


def read_pieces(path: str) -> dict[bytes, float]:
    spec = json.load(open(path, encoding="utf-8"))
    special = {x["content"] for x in spec.get("added_tokens", ())}
    letters = byte_letters()
    return {bytes(letters[c] for c in t): -float(np.log(rank + 2)) for t, rank in spec["model"]["vocab"].items() if t not in special}


def shared_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    unlike = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(unlike.argmax()) if unlike.any() else n


class TrieCounter:
    """Numbers of pieces in the best segmentations of byte strings."""

    def __init__(self, pieces: dict[bytes, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        lengths: dict[int, list[bytes]] = {}
        for p in pieces:
            lengths.setdefault(len(p), []).append(p)
        for n, group in lengths.items():
            m = np.frombuffer(b"".join(group), np.uint8).reshape(-1, n).astype(np.uint64) + np.uint64(1)
            h = np.zeros(len(group), np.uint64)
            for i in range(n):
                h = h * FACTOR + m[:, i]
            order = np.argsort(h)
            h = h[order]
            if len(np.unique(h)) != len(h):
                raise ValueError("two pieces share a hash")
            self.by_length[n] = h, np.array([pieces[p] for p in group])[order]

    def matches(self, word: bytes, start: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(where it ends, its length, its score) of each piece that ends in word[start:stop], by end and length."""
        low = max(0, start - self.longest)
        x = np.frombuffer(word, np.uint8)[low:stop].astype(np.uint64) + np.uint64(1)
        ends = np.arange(start + 1, stop + 1)
        h = np.zeros(len(ends), np.uint64)
        found = []
        power = np.uint64(1)
        for k in range(1, min(self.longest, stop) + 1):
            # one more byte on the left: those too near the word's start drop out
            if k > start + 1:
                ends, h = ends[1:], h[1:]
            h = h + x[ends - k - low] * power
            power = np.uint64(int(power) * int(FACTOR) & 0xFFFFFFFFFFFFFFFF)
            if k in self.by_length:
                known, scores = self.by_length[k]
                i = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = np.flatnonzero(known[i] == h)
                found.append((ends[hit], np.full(len(hit), k), scores[i[hit]]))
        end, length, score = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((length, end))
        return end[order], length[order], score[order]

    def long(self, word: bytes, at: int, best: list[float], count: list[int]) -> int:
        """The count of a long string, whose first `at` bytes best and count cover already; both are kept up to SHARED bytes."""
        del best[at + 1 :], count[at + 1 :]
        recent, number = best[-self.longest - 1 :], count[-self.longest - 1 :]
        for start in range(at, len(word), PIECE):
            stop = min(start + PIECE, len(word))
            now, top, n = start + 1, -np.inf, 0
            for end, k, s in zip(*(c.tolist() for c in self.matches(word, start, stop)), strict=True):
                if end != now:
                    recent.append(top)
                    number.append(n)
                    now, top, n = end, -np.inf, 0
                # recent ends with the state before `end`
                if recent[-k] + s > top:
                    top, n = recent[-k] + s, number[-k] + 1
            recent.append(top)
            number.append(n)
            if len(best) <= SHARED:
                best += recent[len(recent) - (stop - start) :]
                count += number[len(number) - (stop - start) :]
            del recent[: -self.longest - 1], number[: -self.longest - 1]
        return number[-1]

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """Counts for words, distinct, sorted and not empty."""
        out = np.zeros(len(words), np.int64)
        size = np.array([len(w) for w in words])
        before, best, counted = b"", [0.0], [0]
        for i in np.flatnonzero(size > LONG):
            shared = min(len(best) - 1, shared_prefix(before, words[i]))
            out[i], before = self.long(words[i], shared, best, counted), words[i]
        short = np.flatnonzero(size <= LONG)
        if not len(short):
            return out
        size = size[short]
        width = int(size.max())
        m = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in short), np.uint8).reshape(-1, width)
        # length of the prefix shared with the word before; padding never counts as shared
        same = m[1:] == m[:-1]
        shared = np.where(same.all(1), width, same.argmin(1))
        shared = np.concatenate([[-1], np.minimum(shared, np.minimum(size[1:], size[:-1]))])
        prefix = np.zeros((len(m), width + 1), np.uint64)
        for d in range(width):
            prefix[:, d + 1] = prefix[:, d] * FACTOR + (m[:, d].astype(np.uint64) + np.uint64(1))
        power = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(width, FACTOR))])
        # depth by depth: the first word of each node, its best score and count
        nodes, best, count = [np.zeros(1, np.int64)], [np.zeros(1)], [np.zeros(1, np.int64)]
        for d in range(1, width + 1):
            at = np.flatnonzero((size >= d) & (shared < d))
            top, n = np.full(len(at), -np.inf), np.zeros(len(at), np.int64)
            for k in range(1, d + 1):
                if k not in self.by_length:
                    continue
                h, scores = self.by_length[k]
                piece = prefix[at, d] - prefix[at, d - k] * power[k]
                i = np.minimum(np.searchsorted(h, piece), len(h) - 1)
                hit = np.flatnonzero(h[i] == piece)
                if not len(hit):
                    continue
                parent = np.searchsorted(nodes[d - k], at[hit], side="right") - 1
                s = best[d - k][parent] + scores[i[hit]]
                more = s > top[hit]
                hit, parent = hit[more], parent[more]
                top[hit], n[hit] = s[more], count[d - k][parent] + 1
            nodes.append(at)
            best.append(top)
            count.append(n)
            done = np.flatnonzero(size == d)
            out[short[done]] = n[np.searchsorted(at, done, side="right") - 1]
        return out


def count_tokens(docs: DataFrame, vocabulary: str | None = None, remember: int = 600_000, at_once: int = 100_000) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_pretokens, n_tokens."""
    path = vocabulary or default_vocabulary()

    def make():
        import public_tokenizers
        import regex

        split = regex.compile(public_tokenizers.PATTERN).findall
        counter, known = TrieCounter(read_pieces(path)), {}

        def learn(new):
            encoded = sorted((w.encode("utf-8", "surrogatepass"), w) for w in new)
            known.update(zip((w for _, w in encoded), counter([e for e, _ in encoded]).tolist(), strict=True))

        def run(batches):
            for b in batches:
                for lo in range(0, b.num_rows, 500):
                    part = b.slice(lo, 500)
                    texts = [split(t.as_py() or "") for t in part.column(1)]
                    if len(known) > remember:
                        known.clear()
                    new: set[str] = set()
                    for words in texts:
                        new.update(words)
                        if len(new) >= at_once:
                            new.difference_update(known)
                            if len(new) >= at_once:
                                learn(new)
                                new = set()
                    new.difference_update(known)
                    if new:
                        learn(new)
                    get = known.__getitem__
                    yield pa.record_batch([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([sum(map(get, t)) for t in texts], pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

        return run

    return common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, n_pretokens long, n_tokens long", make)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.table(spark, sf_dir, "documents"))
