"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

* Features: lower-cased text with every run of non-letters as one blank; its 1-, 2- and 3-grams are hashed into
  ``buckets`` places and counted; (1 + ln count) * idf, scaled to unit length. Counting is vectorised over
  code points, in pieces whose last two code points go into the next, so that grams span pieces.
* idf comes from the document frequencies of *all* training rows, summed by bucket on the executors.
* Weights: follow-the-regularised-leader with per-coordinate steps and elastic-net penalties (l1 makes them
  sparse), on a sample that a hash of id and text draws from each language: its ``per_class`` smallest, or max_rows / languages
  if that is less, but ``per_class_least`` at any rate. So every language that has labelled rows is learned, and the sample is
  bounded by max_rows, or per_class_least rows a language where there are very many.
* A fifth of the sample is kept from the weights and fits one temperature by likelihood; score is the largest
  calibrated probability.

What is sent to the executors is bounded: languages x buckets floats.

Defined results: ``und`` with score 0 for null text, text without letters, or when nothing could be learned;
null lang rows are never learned from; repeated doc_ids are separate rows; a null doc_id is never held out; extra
columns are ignored by ``predict`` and kept by ``keep_known``; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 15
PIECE = 1 << 20
UNKNOWN = "und"


class Grams:
    """Counts of hashed 1- to 3-grams of a text."""

    FACTORS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))

    def __init__(self, buckets: int = BUCKETS):
        self.buckets = buckets
        self.shift = np.uint32(32 - (buckets.bit_length() - 1))
        flags = np.frombuffer(b"".join(b"\1" if chr(i).isalpha() else b"\0" for i in range(0x323B0)), np.uint8)
        self.letter = np.zeros(0x110000, bool)
        self.letter[: len(flags)] = flags == 1

    def __call__(self, text: str | None) -> np.ndarray | None:
        """Counts by bucket; None if there is no letter."""
        total, low = None, (text or "").lower()
        tail = np.full(1, 32, np.uint32)  # the code points before a piece, of which no gram is counted again
        for at in range(0, len(low), PIECE):
            c = np.frombuffer(low[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
            letter = self.letter[c]
            c = np.where(letter, c, np.uint32(32))
            keep = letter.copy()
            keep[1:] |= letter[:-1]  # of a run of blanks, the first
            keep[0] |= tail[-1] != 32
            c = np.concatenate([tail, c[keep]]).astype(np.uint32)
            old = len(tail)
            if total is None and not letter.any():
                continue
            a, b, d = (c * f for f in self.FACTORS)
            two = (a[:-1] ^ (b[1:] + (b[1:] >> np.uint32(15)))) * np.uint32(0x27D4EB2F)
            three = (two[:-1] ^ (d[2:] + (d[2:] >> np.uint32(13)))) * np.uint32(0x165667B1)
            fresh = c[old:]
            codes = np.concatenate([a[old:][letter_of(fresh)], two[old - 1 :], three[max(old - 2, 0) :]]) >> self.shift
            counts = np.bincount(codes, minlength=self.buckets)
            total = counts if total is None else total + counts
            tail = c[-2:]
        return total


def letter_of(c: np.ndarray) -> np.ndarray:
    return c != 32


@dataclass
class Model:
    classes: list[str]
    weights: np.ndarray  # classes x buckets
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def features(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(counts)
        x = (1 + np.log(counts[at])) * self.idf[at]
        return at, x / max(np.sqrt(x @ x), 1e-12)

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.weights[:, at] @ x + self.bias

    def predict(self, counts: np.ndarray | None) -> tuple[str, float]:
        if counts is None or not self.classes:
            return UNKNOWN, 0.0
        p = softmax(self.logits(*self.features(counts)) / self.temperature)
        k = int(p.argmax())
        return self.classes[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


class Ftrl:
    """Follow-the-regularised-leader, proximal form, with l1 and l2 penalties, one row of coordinates a class."""

    def __init__(self, classes: int, size: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01):
        self.z, self.n = np.zeros((classes, size)), np.zeros((classes, size))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[:, at], self.n[:, at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(w @ x)
        p[label] -= 1
        g = p[:, None] * x
        n = self.n[:, at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[:, at] += g - sigma * w
        self.n[:, at] = n + g * g


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], df: np.ndarray, documents: int, epochs: int = 4, seed: int = 7) -> Model:
    """rows: (lang, buckets, counts) of the sample, in the sample's order."""
    classes = sorted({lang for lang, _, _ in rows})
    idf = np.log((1 + documents) / (1 + df)) + 1
    model = Model(classes, np.zeros((len(classes), len(df))), np.zeros(len(classes)), idf)
    if not classes:
        return model
    index = {c: i for i, c in enumerate(classes)}
    data = []
    for lang, at, counts in rows:
        x = (1 + np.log(counts)) * idf[at]
        x /= max(np.sqrt(x @ x), 1e-12)
        # the last coordinate is the bias
        data.append((index[lang], np.append(at, len(df)), np.append(x, 1.0)))
    kept = [d for i, d in enumerate(data) if i % 5] or data
    aside = [d for i, d in enumerate(data) if not i % 5]
    learner, rng = Ftrl(len(classes), len(df) + 1), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(kept)):
            learner.learn(kept[i][1], kept[i][2], kept[i][0])
    if not data:
        return Model([], np.zeros((0, len(df))), np.zeros(0), idf)
    w = learner.weights()
    model.weights, model.bias = w[:, :-1], w[:, -1]
    model.temperature = temperature([(y, w[:, at] @ x) for y, at, x in aside])
    return model


def temperature(scored: list[tuple[int, np.ndarray]]) -> float:
    """The temperature of largest likelihood, by golden section over its logarithm."""
    if not scored:
        return 1.0
    y, z = np.array([y for y, _ in scored]), np.array([z for _, z in scored])

    def loss(log_t: float) -> float:
        s = z / np.exp(log_t)
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]))

    low, high, golden = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(docs: DataFrame, held_out, per_class: int = 600, max_rows: int = 4000, per_class_least: int = 5, buckets: int = BUCKETS) -> Model:
    """Learn from text and non-null lang of the rows that are not held_out (a column expression)."""
    known = docs.select("doc_id", "text", "lang").filter(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return train([], np.zeros(buckets), 0)
    each = max(per_class_least, min(per_class, max_rows // len(sizes)))
    # document frequencies of all training rows

    def count_df():
        grams = Grams(buckets)

        def run(batches):
            df, n = np.zeros(buckets, np.int64), 0
            for b in batches:
                for text in b.column(0):
                    counts = grams(text.as_py())
                    n += 1
                    if counts is not None:
                        df += counts > 0
            at = np.flatnonzero(df)
            yield pa.record_batch([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], n), pa.int64())], ["bucket", "n"])

        return run

    totals = common.map_arrow(known.select("text"), "bucket int, n long", count_df).groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df, inside = np.zeros(buckets), totals["bucket"] >= 0
    df[totals["bucket"][inside]] = totals["n"][inside]
    documents = int(totals["n"][~inside].sum())
    # the sample: a language's rows of smallest draw, `each` at most, equal rows counted one by one. A draw that some three times as many rows have thins them out first
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11), F.col("text")), F.lit(1_000_000_007))
    share = F.create_map(*[x for lang, n in sorted(sizes.items()) for x in (F.lit(lang), F.lit(min(1.0, (3 * each + 60) / n)))])
    drawn = known.withColumn("draw", draw).filter(F.col("draw") < F.element_at(share, F.col("lang")) * 1_000_000_007)
    # equal rows are one row with a count before they are shuffled, and where they are ranked
    counted = drawn.groupBy("lang", "draw", "text").agg(F.count(F.lit(1)).alias("copies"))
    before = F.coalesce(F.sum("copies").over(W.partitionBy("lang").orderBy("draw", "text").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    picked = counted.withColumn("before", before).filter(F.col("before") < each).select("draw", "lang", "text", F.least(F.col("copies"), each - F.col("before")).alias("copies"))

    def sample_features():
        grams = Grams(buckets)

        def run(batches):
            for b in batches:
                out = []
                for draw, lang, text, copies in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                    counts = grams(text)
                    if counts is not None:
                        at = np.flatnonzero(counts)
                        out.append((draw, lang, at.astype(np.int32).tobytes(), counts[at].astype(np.int32).tobytes(), copies))
                cols = list(zip(*out, strict=True)) or [()] * 5
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.int64()), strict=True)], ["draw", "lang", "at", "counts", "copies"])

        return run

    sample = common.map_arrow(picked, "draw long, lang string, at binary, counts binary, copies long", sample_features).orderBy("draw", "lang", "at", "counts").collect()
    rows = [(sys.intern(r["lang"]), np.frombuffer(r["at"], np.int32), np.frombuffer(r["counts"], np.int32)) for r in sample for _ in range(r["copies"])]
    return train(rows, df, documents)


def predict(docs: DataFrame, model: Model, keep: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs(text, keep...) -> keep..., lang_pred, score (or other names, where kept columns have these)."""
    from pyspark.sql import types as T

    small = Model(model.classes, model.weights.astype(np.float32), model.bias.astype(np.float32), model.idf.astype(np.float32), model.temperature)
    # texts are handed over once, whether they are kept or only read
    sent = [F.col(f"`{c}`") for c in keep] + ([] if "text" in keep else [F.col("text").alias(common.fresh(docs, "read")[0])])
    where = keep.index("text") if "text" in keep else len(keep)
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def make():
        grams = Grams(len(small.idf))

        def run(batches):
            for b in batches:
                found = [small.predict(grams(t.as_py())) for t in b.column(where)]
                yield pa.record_batch([*(b.column(i) for i in range(len(keep))), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], [*keep, *names])

        return run

    return common.map_arrow(docs.select(*sent), schema, make)


def held_out(divisor: int = 4, rest: int = 2):
    return common.crc_mod("doc_id", divisor) == rest


def keep_known(docs: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """docs without those whose language can't be told: no letter, or a calibrated probability under `least`."""
    model = fit(docs, held_out(), **options)
    lang, score = common.fresh(docs, "lang_pred", "score")
    found = predict(docs, model, docs.columns, (lang, score))
    rejected = (F.col(lang) == UNKNOWN) | (F.col(score) < least)
    return found.filter(~rejected).select(*docs.columns)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs, held_out())
    return predict(docs.select("doc_id", "text"), model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
