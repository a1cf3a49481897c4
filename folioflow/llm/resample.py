"""Importance resampling towards a target distribution, over hashed word n-grams and overlapping chunks of texts.

Every n-gram of 1 to ``most`` words falls in one of ``buckets`` by crc32. A bucket's gain is the logarithm of how much more often the target
texts fall there than the corpus does; a document's weight is the mean gain of its n-grams; weight plus a seeded Gumbel draw is its score, and
the highest scores are drawn, which samples without replacement with chances in proportion to exp(weight).

Texts differ in length by orders of magnitude, so they are worked on in chunks of about ``chunk`` bytes. Chunks end at a border between words
and carry the next ``most`` - 1 words along; an n-gram belongs to the chunk that owns its first word, so each is counted once. A text of one
chunk is hashed where it is read; chunks of longer ones are dealt over the cluster first, so no task hashes a long text whole. What is kept of
a chunk is its row of bucket numbers; counts and weights are sums over chunks, added up by document.

A document is known by its id and its text's digest. Rows that repeat have equal chunks: their sums are divided by the number of first
chunks and written once a row at the end, so no group of equal rows is ever gathered.

Ranks need no sort of all documents in one place: scores are whole numbers, counts a score are summed, running sums over cells of scores and then
inside a cell say how many rows stand above a score, and rows of one score are ranked by doc_id.

Bounds: the gains, ``buckets`` whole numbers, are brought to the driver and sent with the tasks (80 kB for 10,000); a gain lies within
1000 * ln(2^64 * buckets) and a draw within -3,200 to 22,900, so that there are at most some 140,000 scores in 600 cells at any size of table.

Defined results: null and empty texts and those without words have no n-grams and weight 0; they are never drawn where ``min_words`` > 0; a null
doc_id draws as the empty string does and ranks before others of its score; repeated rows are rows of their own, with ranks next to each other;
words of any length stay whole; an empty corpus gives an empty result, an empty target negative gains; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

BUCKETS = 10_000
MOST = 2
CHUNK = 16_384
MIN_WORDS = 20
PERCENT = 25
SEED = "7"
CELL = 256
#: Bytes to what they count as: A-Z become small; digits, letters and all of UTF-8 beyond ASCII stay; the rest parts words.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
NEXT = re.compile(rb"[^ ]+")
CHUNKS = "doc_id long, digest binary, piece int, words long, text binary, buckets binary"


def chunks_of(text: bytes, size: int, carry: int) -> Iterator[tuple[bytes, bytes]]:
    """(words a chunk owns, words it carries of the next one) of a text whose words stand between blanks."""
    start = 0
    while True:
        end = text.find(b" ", start + size) if len(text) - start > size else -1
        if end < 0:
            yield text[start:], b""
            return
        following = []
        at = end
        while len(following) < carry and (found := NEXT.search(text, at)):
            following.append(found[0])
            at = found.end()
        yield text[start:end], b" ".join(following)
        start = end


def hashed(own: bytes, carried: bytes, most: int, buckets: int) -> tuple[int, np.ndarray]:
    """Number of words owned, and the bucket of each n-gram that starts at one of them."""
    mine = own.split()
    words = mine + carried.split()
    crc = zlib.crc32
    now, parts = [crc(w) for w in words], []
    for n in range(1, most + 1):
        if n > 1:
            now = [crc(b" " + w, c) for w, c in zip(words[n - 1 :], now, strict=False)]
        parts.append(np.fromiter(now[: len(mine)], np.uint32, min(len(now), len(mine))))
    return len(mine), np.concatenate(parts) % np.uint32(buckets)


def packed(values: np.ndarray, buckets: int) -> bytes:
    return values.astype("<u2" if buckets <= 1 << 16 else "<u4").tobytes()


def chunked(texts: DataFrame, most: int, buckets: int, chunk: int) -> DataFrame:
    """texts(doc_id, text) -> doc_id, digest, piece, words, buckets; one row a chunk, written to the shared folder."""
    names = [f.split()[0] for f in CHUNKS.split(", ")]
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]

    def table(rows):
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def cut(batches):
        rows, held = [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py() or b""
                digest = hashlib.sha256(text).digest()
                for piece, (own, carried) in enumerate(chunks_of(text.translate(LETTERS), chunk, most - 1)):
                    if piece or carried:
                        rows.append((doc, digest, piece, None, own + b"\n" + carried, None))
                        held += len(own)
                    else:
                        words, values = hashed(own, carried, most, buckets)
                        rows.append((doc, digest, 0, words, None, packed(values, buckets)))
                        held += 4 * len(values)
                    if held >= 1 << 22 or len(rows) >= 4096:
                        yield table(rows)
                        rows, held = [], 0
        if rows:
            yield table(rows)

    def hash_chunks(batches):
        for b in batches:
            rows = []
            for doc, digest, piece, text in zip(*(b.column(i) for i in (0, 1, 2, 4)), strict=True):
                words, values = hashed(*text.as_py().split(b"\n"), most, buckets)
                rows.append((doc.as_py(), digest.as_py(), piece.as_py(), words, None, packed(values, buckets)))
            if rows:
                yield table(rows)

    given = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    once = common.materialise(common.map_arrow(given, CHUNKS, lambda: cut), "resample-chunks")
    long = once.filter(F.col("text").isNotNull()).hint("rebalance")
    rest = common.materialise(common.map_arrow(long, CHUNKS, lambda: hash_chunks), "resample-long")
    return once.filter(F.col("text").isNull()).unionByName(rest).drop("text")


def bucket_counts(chunks: DataFrame, buckets: int) -> np.ndarray:
    """n-grams of each bucket; each task adds up its own first, and one whole number a bucket comes to the driver."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for values in b.column(0):
                total += np.bincount(np.frombuffer(values.as_py(), kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    summed = common.map_arrow(chunks.select("buckets"), "bucket long, n long", lambda: count).groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in summed.collect():
        out[bucket] = n
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket in thousandths, from the n-grams of corpus and target in it."""
    s, t, buckets = corpus.astype(float), target.astype(float), len(corpus)
    return np.floor(1000 * np.log(((t + 1) * (s.sum() + buckets)) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighed(chunks: DataFrame, gains: np.ndarray) -> DataFrame:
    """chunks -> doc_id, digest, copies, words, n_features, weight; one row a document."""
    kind = "<u2" if len(gains) <= 1 << 16 else "<u4"
    schema = "doc_id long, digest binary, piece int, words long, features long, gain long"

    def add(batches):
        for b in batches:
            features, gain = [], []
            for values in b.column(4):
                at = np.frombuffer(values.as_py(), kind)
                features.append(len(at))
                gain.append(int(gains[at].sum()))
            yield pa.record_batch([*b.columns[:4], pa.array(features, pa.int64()), pa.array(gain, pa.int64())], [f.split()[0] for f in schema.split(", ")])

    parts = common.map_arrow(chunks.select("doc_id", "digest", "piece", "words", "buckets"), schema, lambda: add)
    sums = parts.groupBy("doc_id", "digest").agg(
        F.sum((F.col("piece") == 0).cast("long")).alias("copies"), F.sum("words").alias("words"), F.sum("features").alias("features"), F.sum("gain").alias("gain")
    )
    n, gain = F.expr("features div copies"), F.expr("gain div copies")
    down = F.expr("((gain div copies) - pmod(gain div copies, features div copies)) div (features div copies)")
    return sums.select("doc_id", "digest", "copies", F.expr("words div copies").alias("words"), n.alias("n_features"), F.when(n > 0, down).otherwise(F.lit(0) * gain).cast("long").alias("weight"))


def gumbel(doc_id: Column, seed: str) -> Column:
    """A draw of the standard Gumbel law in thousandths, from 32 bits of a digest of the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, percent: int, min_words: int) -> DataFrame:
    """scored(doc_id, digest, copies, words, score, ...) -> plus above: rows that stand before this one's first, and wanted: rows drawn in all."""
    able = F.when(F.col("words") >= min_words, F.col("copies")).otherwise(F.lit(0))
    cell = F.floor(F.col("score") / CELL)
    by_score = scored.groupBy("score").agg(F.sum(able).alias("rows")).withColumn("cell", cell)
    before = W.unboundedPreceding, -1
    cells = by_score.groupBy("cell").agg(F.sum("rows").alias("in_cell")).select(
        "cell",
        F.coalesce(F.sum("in_cell").over(W.partitionBy().orderBy(F.desc("cell")).rowsBetween(*before)), F.lit(0)).alias("above_cell"),
        F.floor(F.sum("in_cell").over(W.partitionBy()) * percent / 100).alias("wanted"),
    )
    inside = F.coalesce(F.sum("rows").over(W.partitionBy("cell").orderBy(F.desc("score")).rowsBetween(*before)), F.lit(0))
    scores = by_score.withColumn("inside", inside).join(cells, "cell").select("score", (F.col("above_cell") + F.col("inside")).alias("above_score"), "wanted")
    same = W.partitionBy("score").orderBy(F.asc_nulls_first("doc_id"), "digest").rowsBetween(*before)
    return scored.join(scores, "score").withColumn("able", able > 0).withColumn("above", F.col("above_score") + F.coalesce(F.sum(able).over(same), F.lit(0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, most: int = MOST, buckets: int = BUCKETS, seed: str = SEED, chunk: int = CHUNK) -> DataFrame:
    """docs(doc_id, text), target(text) -> doc_id, n_features, weight, score, rank (null: not drawn)."""
    mine = chunked(docs, most, buckets, chunk)
    wanted = chunked(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), most, buckets, chunk)
    gains = gains_of(bucket_counts(mine, buckets), bucket_counts(wanted, buckets))
    scored = weighed(mine, gains).withColumn("score", (F.col("weight") + gumbel(F.col("doc_id"), seed)).cast("long"))
    placed = ranked(common.materialise(scored, "resample-scores"), percent, min_words)
    # each of a document's equal rows, in two steps so that no array grows with a third of all rows
    steps = F.sequence(F.lit(0), F.expr("(copies - 1) div 4096"))
    rows = placed.withColumn("block", F.explode(steps)).withColumn("copy", F.explode(F.expr("sequence(block * 4096, least(block * 4096 + 4095, copies - 1))")))
    rank = F.col("above") + F.col("copy") + 1
    return rows.select("doc_id", "n_features", "weight", "score", F.when(F.col("able") & (rank <= F.col("wanted")), rank).cast("long").alias("rank"))


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


#: The same in DuckDB; crc32 is folded over the bytes of each distinct word and of each distinct pair.
ORACLE = r"""
WITH
k AS (SELECT list(list_reduce([i, 0, 1, 2, 3, 4, 5, 6, 7], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents),
b AS (SELECT list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
df AS (
  SELECT r, f, count(*) AS n FROM (
    SELECT r, unnest(w) AS f FROM d UNION ALL
    SELECT r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM d) GROUP BY r, f),
bf AS (
  SELECT f, count(*) AS n FROM (
    SELECT unnest(w) AS f FROM b UNION ALL
    SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM b) GROUP BY f),
fs AS (SELECT DISTINCT f FROM (SELECT f FROM df UNION ALL SELECT f FROM bf)),
fh AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
              lambda a, y: xor(k.t[1 + (xor(a, y) & 255)], a >> 8)), 4294967295) % 10000 AS bucket
  FROM (SELECT f, hex(encode(f)) AS x FROM fs), k),
s AS (SELECT bucket, sum(n) AS n FROM df JOIN fh USING (f) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS n FROM bf JOIN fh USING (f) GROUP BY bucket),
z AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS S, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS T),
g AS (
  SELECT s.bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * (z.S + 10000)) / ((s.n + 1)::DOUBLE * (z.T + 10000))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), z),
w AS (SELECT r, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS g FROM df JOIN fh USING (f) JOIN g USING (bucket) GROUP BY r),
c AS (
  SELECT d.r, d.doc_id, len(d.w) AS words, coalesce(w.n, 0)::BIGINT AS n_features, coalesce(floor(w.g::DOUBLE / w.n), 0)::BIGINT AS weight,
         ('0x' || substr(sha256('7:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM d LEFT JOIN w USING (r)),
e AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM c),
p AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) OVER () AS n FROM e WHERE words >= 20)
SELECT e.doc_id, e.n_features, e.weight, e.score, CASE WHEN p.place <= floor(25 * p.n / 100) THEN p.place END AS rank
FROM e LEFT JOIN p USING (r)
"""
