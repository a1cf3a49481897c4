"""Toxic passages by maximum-scoring segment search.

* Tokens are words with marks at their ends stripped, and the first 4, 5 and 6 bytes of longer words, which stand in
  for inflected words never seen. Weights: log-odds in toxic against other labelled documents, with an informative
  Dirichlet prior: prior counts are ``strength`` times the token's share of *all* documents' words. A word weighs
  its log-odds, or those of its longest prefix, where they are at least ``least_z`` standard errors above 0.
  Copies would make every word of a copied toxic text look toxic, so a document counts as 1 / (documents of the
  sample that share one of its min-hashes).
* A token's score is weight - drift, and -drift for other words, so that scores are negative on average. One
  linear scan over a text's tokens (Ruzzo and Tompa's stack of candidates, fed with runs of one sign)
  finds all its maximal segments.
* Extreme values: with lambda the positive root of E[exp(lambda s)] = 1 over non-toxic tokens, a segment's
  normalised score is x = lambda*S - ln(n) for n tokens. The sample is dealt into ``FOLDS`` folds, copies into the same
  one, and each fold is scored with weights learned from the others. The best segments of its non-toxic documents fit a
  Gumbel law (its median and 95th percentile; where there are too few, its theoretical location 0 and spread 1), and with the share of
  those that have any segment that gives each segment a p-value: the chance that a non-toxic document holds one as good.
* A segment is significant when its p-value is at most ``significant``. A document's evidence is -ln p of its best
  segment, and -ln p of its r best together by sum statistics, for the r that says most. The score is a logistic
  regression on these two, fitted on the same held-out folds: nothing but p-values enters it. Both are taken up to ``MOST`` (12 and 24),
  in fitting and in scoring: a sample of some thousand documents has not seen chances below exp(-12), and beyond
  them the score stays what it is there. The weights that score documents come from all folds.

Labels are learned from a sample of at most ``max_rows`` ids per class, drawn by a hash of the id, and one text an id: of several, that
of the smallest hash. Equal rows are one text. The vocabulary is what that sample's toxic documents hold.

Defined results: null or empty text has no segments and the score of such texts; rows without a label, or with a
null one, are never learned from; of contradicting labels for one doc_id the larger holds; a null doc_id is
never learned from and not held out; extra columns are ignored; without labels of both kinds, or texts for them, the
score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


#: Marks that words lose at their ends.
MARKS = rb""".,;:!?*%$&#|"'()[]{}<>/\-_+=~`@^"""
PREFIXES = (6, 5, 4)
FOLDS = 5
NOTHING = -20.0  # the normalised score that stands for no segment
MOST = (12.0, 24.0)  # evidence beyond these says no more, whatever a sample of some thousand documents promises


def token_keys(word: bytes) -> list[bytes]:
    """A word's token and its prefixes', longest first; prefixes start with a byte that no word has."""
    w = word.strip(MARKS)
    return [w, *(b"\xff" + w[:n] for n in PREFIXES if len(w) > n)] if w else []


class TokenWeights(dict):
    """word as it stands -> weight, resolved at its first sight; forgets everything when it grows too large."""

    def __init__(self, weights: dict[bytes, float], limit: int = 400_000):
        super().__init__()
        self.weights, self.limit = weights, limit

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = next((self.weights[k] for k in token_keys(word) if k in self.weights), 0.0)
        return value


def copies(documents: list[list[bytes]], rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """For each document, 1 / the largest number of documents that share one of its min-hashes over three words, and its fold."""
    hashes = common.WordHashes()
    marks = []
    for words in documents:
        h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
        if len(h) < 3:
            marks.append([int(h.sum() & np.uint64(2**63 - 1))] * rounds)
            continue
        s = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
        marks.append([int(((s ^ (s >> np.uint64(31))) * np.uint64(m)).min()) for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xBF58476D1CE4E5B9)[:rounds]])
    sizes = [Counter(m[k] for m in marks) for k in range(rounds)]
    share = np.array([1 / max(sizes[k][m[k]] for k in range(rounds)) for m in marks])
    # documents that share their first min-hash lie in one fold: the largest groups first, each to the emptiest fold
    group, load = {}, [0] * FOLDS
    for m, n in sorted(sizes[0].items(), key=lambda x: (-x[1], x[0])):
        group[m] = load.index(min(load))
        load[group[m]] += n
    return share, np.array([group[m[0]] for m in marks], np.int64)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, stop, score), in order; linear time."""
    positive = scores > 0
    if not positive.any():
        return []
    # runs of one sign: only sums over them matter
    cut = np.flatnonzero(np.concatenate([[True], positive[1:] != positive[:-1]]))
    sums = np.add.reduceat(scores, cut)
    ends = np.append(cut[1:], len(scores))
    total, stack = 0.0, []  # of (left sum, right sum, start, stop)
    for start, stop, s in zip(cut.tolist(), ends.tolist(), sums.tolist(), strict=True):
        if not positive[start]:
            total += s
            continue
        left, right, first = total, total + s, start
        total = right
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= left:  # candidates that can't reach further left
                j = stack[j][4]
            if j < 0 or stack[j][1] >= right:
                stack.append((left, right, first, stop, j))
                break
            left, first = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, r - l) for l, r, a, b, _ in stack]


@dataclass
class Model:
    weights: dict[bytes, float] = field(default_factory=dict)
    drift: float = 0.5
    rate: float = 1.0  # lambda
    location: float = 0.0  # of the Gumbel law of non-toxic documents' best normalised score
    spread: float = 1.0
    any_share: float = 1.0  # of non-toxic documents that have a segment at all
    significant: float = 0.05
    logistic: tuple[float, float, float] = (0.0, 0.0, -50.0)
    cache: TokenWeights | None = field(default=None, repr=False)

    def spans(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(first word, word after the last, normalised score) of every maximal segment."""
        if not words:
            return []
        if self.cache is None:
            self.cache = TokenWeights(self.weights)
        s = np.fromiter(map(self.cache.__getitem__, words), float, len(words)) - self.drift
        log_n = np.log(len(words))
        return [(a, b, self.rate * x - log_n) for a, b, x in segments(s)]

    def standard(self, x: np.ndarray) -> np.ndarray:
        """Normalised scores as deviations of the Gumbel law."""
        return np.clip((x - self.location) / self.spread, -30, 700)

    def features(self, spans: list[tuple[int, int, float]]) -> tuple[float, float, int]:
        """-ln p of the best segment, -ln p of the best ones together, and the number of significant segments."""
        if not spans:
            return 0.0, 0.0, 0
        z = np.sort(self.standard(np.array([x for _, _, x in spans])))[::-1]
        one = -np.log(np.maximum(-np.expm1(-np.exp(-z)), 1e-300)) - np.log(self.any_share)
        # sum statistics: r segments of scores z come together with a chance of about exp(-T) T^(r-1) / (r! (r-1)!), T their sum
        up = np.cumsum(z[z > 0])
        r = np.arange(1, len(up) + 1)
        log_factorial = np.cumsum(np.log(r))
        several = up - (r - 1) * np.log(np.maximum(up, 1e-9)) + log_factorial + log_factorial - np.log(r)
        return float(one[0]), float(max(one[0], several.max(initial=0.0))), int((one >= -np.log(self.significant)).sum())

    def score(self, best: float, total: float) -> float:
        a, b, c = self.logistic
        return float(1 / (1 + np.exp(-np.clip(a * min(best, MOST[0]) + b * min(total, MOST[1]) + c, -50, 50))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Newton's method for a ridge-penalised logistic regression; the last weight is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), ridge * np.append(np.ones(x.shape[1] - 1), 0.0)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + penalty * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def weigh(vocabulary: list[bytes], toxic: np.ndarray, clean: np.ndarray, prior: np.ndarray, strength: float, least_z: float, drift: float) -> Model:
    """Weights and lambda from counts of the vocabulary in the sample's classes and in all documents."""
    alpha = strength * (prior + 0.5) / (prior.sum() + 0.5 * len(prior)) + 1e-3
    n1, n0, a0 = toxic.sum(), clean.sum(), alpha.sum()
    odds = lambda c, n: np.log((c + alpha) / np.maximum(n + a0 - c - alpha, 1e-9))
    delta = odds(toxic, n1) - odds(clean, n0)
    z = delta / np.sqrt(1 / (toxic + alpha) + 1 / (clean + alpha))
    good = (z >= least_z) & (delta > drift)
    weights = np.where(good, np.minimum(delta, 8.0), 0.0)
    model = Model({vocabulary[i]: float(weights[i]) for i in np.flatnonzero(good)}, drift)
    # lambda from the scores of non-toxic tokens; words never seen there count as half an occurrence together
    share = np.append((clean + 0.5 * good / max(1, good.sum())), max(1.0, n0))
    s = np.append(weights, 0.0) - drift
    share = share / share.sum()
    low, high = 0.0, 50.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if share @ np.exp(np.minimum(mid * s, 600)) < 1 else (low, mid)
    model.rate = max((low + high) / 2, 1e-3)
    return model


def gumbel(best: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """(location, spread, share with a segment) of non-toxic documents' best scores; NOTHING stands for no segment.

    The law goes through the weighted median and 95th percentile: neither minds the few documents whose label is wrong.
    """
    some = best > NOTHING
    share = (weight[some].sum() + 0.5) / (weight.sum() + 1) if len(best) else 1.0
    order = np.argsort(best[some])
    x, w = best[some][order], weight[some][order]
    if len(x) < 20:
        return 0.0, 1.0, float(share)
    middle, high = np.interp([0.5, 0.95], (np.cumsum(w) - w / 2) / w.sum(), x)
    at = -np.log(-np.log([0.5, 0.95]))
    spread = max((high - middle) / (at[1] - at[0]), 0.1)
    return float(middle - at[0] * spread), float(spread), float(share)


def train(rows: list[tuple[int, list[bytes]]], share: np.ndarray, fold: np.ndarray, vocabulary: list[bytes], counts: np.ndarray, prior: np.ndarray, strength: float, least_z: float, drift: float) -> Model:
    """rows: (label, words) of the sample, with each one's share and fold; counts: (fold, label, word) of the sample; prior: of all documents."""
    if not len(vocabulary):
        return Model()
    labels = np.array([y for y, _ in rows])
    whole = counts.sum(0)
    model = weigh(vocabulary, whole[1], whole[0], prior, strength, least_z, drift)
    aside: list[list] = [[] for _ in rows]
    for f in range(FOLDS):
        mine = np.flatnonzero(fold == f)
        if len(mine):
            others = weigh(vocabulary, whole[1] - counts[f][1], whole[0] - counts[f][0], prior, strength, least_z, drift)
            for i in mine:
                aside[i] = others.spans(rows[i][1])
    best = np.array([max((x for _, _, x in spans), default=NOTHING) for spans in aside])
    clean = labels == 0
    model.location, model.spread, model.any_share = gumbel(best[clean], share[clean])
    found = np.array([model.features(spans)[:2] for spans in aside])
    model.logistic = tuple(float(v) for v in logistic(np.minimum(found, MOST), labels.astype(float)))
    return model


def held_out():
    return common.crc_mod("doc_id", 3) == 1


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, strength: float = 2000.0, least_z: float = 3.0, drift: float = 0.5) -> Model:
    draw = F.xxhash64(F.col("doc_id"), F.lit(23))
    known = labels.select("doc_id", "toxic").filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = {}
    for kind in (1, 0):  # at most max_rows ids of each class
        picked |= {r["doc_id"]: kind for r in known.filter(F.col("toxic") == kind).select("doc_id").orderBy(draw, "doc_id").limit(max_rows).collect()}
    if len(set(picked.values())) < 2:
        return Model()
    wanted = docs.select("doc_id", "text").filter(F.col("doc_id").isin(list(picked)) & F.col("text").isNotNull())
    sample = wanted.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    rows = [(picked[r["doc_id"]], common.words_of(r["text"])) for r in sample.orderBy(draw, "doc_id").toLocalIterator()]
    share, fold = copies([w for _, w in rows])
    # words that could weigh: those of toxic documents
    vocabulary = sorted({k for y, words in rows if y for w in set(words) for k in token_keys(w)})
    index = {w: i for i, w in enumerate(vocabulary)}

    counts = np.zeros((FOLDS, 2, len(vocabulary)))
    for (y, words), part, f in zip(rows, share, fold, strict=True):
        for w, n in Counter(words).items():
            for k in token_keys(w):
                if k in index:
                    counts[f, y, index[k]] += n * part

    def add(total, seen):
        for w, n in seen.items():
            for k in token_keys(w):
                if k in index:
                    total[index[k]] += n
        seen.clear()

    def count_words():
        def run(batches):
            total = np.zeros(len(index), np.int64)
            for b in batches:
                seen: Counter = Counter()
                for text in b.column(0):
                    seen.update(common.words_of(text.as_py()))
                    if len(seen) > 500_000:
                        add(total, seen)
                add(total, seen)
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["word", "n"])

        return run

    prior = np.zeros(len(vocabulary))
    everywhere = common.map_arrow(docs.select("text"), "word int, n long", count_words).groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    prior[everywhere["word"]] = everywhere["n"]
    return train(rows, share, fold, vocabulary, counts, prior, strength, least_z, drift)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) -> doc_id, score, segments (significant ones), best_words (the best one's place), p_value."""

    def make():
        def run(batches):
            for b in batches:
                out = []
                for text in b.column(1):
                    words = common.words_of(text.as_py())
                    spans = model.spans(words)
                    top = max(spans, key=lambda x: (x[2], -x[0]), default=None)
                    best, total, n = model.features(spans)
                    out.append((model.score(best, total), n, top[0] if top else None, top[1] if top else None, float(np.exp(-best))))
                cols = list(zip(*out, strict=True)) or [()] * 5
                kinds = (pa.float64(), pa.int32(), pa.int64(), pa.int64(), pa.float64())
                yield pa.record_batch([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "score", "segments", "best_start", "best_stop", "p_value"])

        return run

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return common.map_arrow(ids, "doc_id long, score double, segments int, best_start long, best_stop long, p_value double", make)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = fit(docs.select("doc_id", "text"), labels)
    found = score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "segments", "p_value")
