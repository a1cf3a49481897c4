"""Language-model scores with stupid backoff; each document is scored by the counts of all *other* documents.

For word w after u, v (counts c without the document's own):

    S = c(u v w) / c(u v)              if c(u v w) > 0
        0.4 * c(v w) / c(v)            else if c(v w) > 0
        0.16 * c(w) / N                else if c(w) > 0
        0.16 / (N + 1)                 else

with one factor 0.4 less for a document's second word and two less for its first; N is the number of words. A score
is the sum of ln S over a document's words; its mean is given too.

It is an equi-join of exploded n-grams with n-gram count tables, done in blocks so that rows are packed:

1. Chunks of documents (about ``chunk_words`` words each) explode into n-grams of orders 0 to 3 as 56-bit hashes, and
   pre-aggregate them: one entry for each distinct n-gram of a chunk.
2. Entries are partitioned by hash: the top bits name one of 2^k buckets, whose number follows the corpus's size. A
   bucket sums its entries over chunks, which is its part of the count tables, and joins them back: every entry
   gets its total. An n-gram in all documents is only one entry a chunk.
3. Totals return to their chunk, beside its texts (compressed), where positions look them up and documents sum.

Counts cover all documents; what is shuffled grows in proportion. A chunk's name is its partition and its place there;
each answer carries a digest of the chunk that asked, ids and words in order, and is compared with the chunk it meets.

Defined results: null text or text without words has 0 words, sum 0 and a null mean; repeated rows are separate
documents, each of which counts for the other; extra columns are ignored; an empty table gives an empty result.
``docs`` must be a scan, or anything that gives the same rows in the same partitions when read twice; where it does not,
the digests differ and the job stops.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CHUNK_WORDS = 1_200_000
BUCKET_ENTRIES = 2_000_000
BACKOFF = 0.4
KEPT = np.uint64(0xFFFFFFFFFFFFFF00)  # 56 of 64 bits: what is packed and sent
NOTHING = np.uint64(0x243F6A8885A30800)  # the 0-gram, whose count is the number of words
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M2
    x = (x ^ (x >> np.uint64(29))) * _M3
    return (x ^ (x >> np.uint64(32))) & KEPT


def gram_hashes(h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the 1-, 2- and 3-gram that end at each word; starts: first word of each document. Positions without one hold 0."""
    one = _scramble(h + np.uint64(1))
    two, three = np.zeros_like(h), np.zeros_like(h)
    two[1:] = _scramble(h[:-1] * _M1 + h[1:] + np.uint64(2))
    three[2:] = _scramble((h[:-2] * _M1 + h[1:-1]) * _M1 + h[2:] + np.uint64(3))
    starts = starts[starts < len(h)]
    two[starts] = 0
    three[starts] = 0
    three[np.minimum(starts + 1, len(h) - 1)] = 0
    return one, two, three


def distinct_sorted(grams: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes with their counts; 0 stands for no n-gram, and the 0-gram counts the words."""
    x = np.concatenate(grams)
    x.sort()
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    values, counts = x[first], np.diff(np.append(first, len(x)))
    keep = (values != 0) & (values != NOTHING)
    values, counts = values[keep], counts[keep]
    at = np.searchsorted(values, NOTHING)
    return np.insert(values, at, NOTHING), np.insert(counts, at, len(grams[0]))


class Codec:
    """Packed forms of sorted hashes and of small numbers."""

    def __init__(self):
        import zstandard

        self._c, self._d = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()

    def pack(self, data: bytes) -> bytes:
        return self._c.compress(data)

    def unpack(self, data: bytes) -> bytes:
        return self._d.decompress(data)

    def numbers(self, x: np.ndarray) -> bytes:
        # bytes of equal weight together
        return self.pack(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())

    def read_numbers(self, data: bytes) -> np.ndarray:
        return np.ascontiguousarray(np.frombuffer(self.unpack(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()

    def hashes(self, x: np.ndarray) -> tuple[bytes, bytes]:
        """Gaps of the top 24 bits, compressed, and the next 32 bits as they are."""
        high = (x >> np.uint64(40)).astype(np.int64)
        low = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 1:5]).tobytes()
        return self.numbers(np.diff(high, prepend=0)), low

    def read_hashes(self, gaps: bytes, low: bytes) -> np.ndarray:
        high = np.cumsum(self.read_numbers(gaps).astype(np.uint64)) << np.uint64(40)
        full = np.zeros((len(high), 8), np.uint8)
        full[:, 1:5] = np.frombuffer(low, np.uint8).reshape(-1, 4)
        return high | full.view("<u8").ravel()


def chunks(batches, chunk_words: int, read):
    """(serial, doc ids, what read(text) gives) of each chunk of a task; both passes cut at the same documents."""
    serial, ids, got, n = 0, [], [], 0
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            words, value = read(text.as_py() or "")
            ids.append(doc)
            got.append(value)
            n += words + 1
            if n >= chunk_words:
                yield serial, ids, got
                serial, ids, got, n = serial + 1, [], [], 0
    if ids:
        yield serial, ids, got


def word_hashes(text: str, hashes: common.WordHashes) -> np.ndarray:
    words = common.words_of(text)
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def in_a_row(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All documents' word hashes in a row, and where each document starts (and the end)."""
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def chunk_digest(ids: list, h: np.ndarray, starts: np.ndarray) -> int:
    """Names a chunk's documents and words, in their order."""
    import pickle

    import xxhash

    return xxhash.xxh3_64_intdigest(pickle.dumps(ids) + starts.tobytes() + h.tobytes()) - (1 << 63)


def own_counts(i: np.ndarray) -> np.ndarray:
    """How often each element occurs."""
    order = np.argsort(i)
    y = i[order]
    first = np.flatnonzero(np.concatenate([[True], y[1:] != y[:-1]])) if len(y) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(y)))
    out = np.empty(len(i), np.int64)
    out[order] = np.repeat(n, n)
    return out


def numbered(grams: tuple[np.ndarray, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """distinct_sorted's values, and the number of each n-gram among them; one sort instead of a search for each."""
    x = np.concatenate([*grams, [NOTHING]])
    order = np.argsort(x)
    y = x[order]
    fresh = np.concatenate([[True], y[1:] != y[:-1]])
    values = y[fresh]
    place = np.empty(len(x), np.int32)
    place[order] = np.cumsum(fresh, dtype=np.int32) - np.int32(1)
    if values[0] == 0:  # no n-gram
        values = values[1:]
        place -= 1
    return values, np.split(place[:-1], len(grams))


def score_chunk(starts: np.ndarray, values: np.ndarray, at: list[np.ndarray], totals: np.ndarray) -> np.ndarray:
    """Sum of ln S of each document, given the total of each distinct hash of the chunk."""
    whole = float(totals[np.searchsorted(values, NOTHING)])
    out = np.zeros(len(starts) - 1)
    for d, (a, z) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
        n = z - a
        if not n:
            continue
        c = []
        for order in range(3):
            i = at[order][a + order : z] if n > order else np.zeros(0, np.int64)
            rest = np.zeros(n)
            rest[order:] = totals[i] - own_counts(i)
            c.append(rest)
        c1, c2, c3 = c
        size = whole - n
        s = np.where(c1 > 0, c1 / max(size, 1), 1 / (size + 1))
        place = np.arange(n)
        s *= BACKOFF ** np.minimum(place, 2)
        before = np.concatenate([[0], c1[:-1]])  # c(v)
        pair = np.concatenate([[0], c2[:-1]])  # c(u v)
        s = np.where(c2 > 0, c2 / np.maximum(before, 1) * np.where(place > 1, BACKOFF, 1.0), s)
        s = np.where(c3 > 0, c3 / np.maximum(pair, 1), s)
        out[d] = np.log(s).sum()
    return out


def score(docs: DataFrame, chunk_words: int = CHUNK_WORDS, bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, log_score, mean_log_score."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # about as many words as a fifth of the characters; only the number of buckets depends on it
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, size / 5 * 1.5 / bucket_entries)))))

    def explode():
        from pyspark import TaskContext

        hashes, codec, task = common.WordHashes(), Codec(), TaskContext.get().partitionId()

        def run(batches):
            def read(text):
                h = word_hashes(text, hashes)
                return len(h), h

            for serial, ids, parts in chunks(batches, chunk_words, read):
                h, starts = in_a_row(parts)
                name = chunk_digest(ids, h, starts)
                values, counts = distinct_sorted(gram_hashes(h, starts[:-1]))
                bucket = (values >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(values), np.int64)
                cuts = np.searchsorted(bucket, np.arange((1 << bits) + 1))
                rows = []
                for b in range(1 << bits):
                    if cuts[b] < cuts[b + 1]:
                        part = slice(cuts[b], cuts[b + 1])
                        rows.append((b, (task << 32) + serial, name, *codec.hashes(values[part]), codec.numbers(counts[part])))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "chunk", "name", "gaps", "low", "counts"])

        return run

    asked = common.map_arrow(docs, "bucket int, chunk long, name long, gaps binary, low binary, counts binary", explode)

    def count(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        codec = Codec()
        chunk = t.column("chunk").to_pylist()
        parts = [codec.read_hashes(a.as_py(), b.as_py()) for a, b in zip(t.column("gaps"), t.column("low"), strict=True)]
        counts = np.concatenate([codec.read_numbers(x.as_py()) for x in t.column("counts")]).astype(np.int64)
        every = np.concatenate(parts)
        order = np.argsort(every, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], every[order][1:] != every[order][:-1]]))
        sums = np.add.reduceat(counts[order], first)
        group = np.empty(len(every), np.int64)
        group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(every))))
        totals, cuts = sums[group], np.cumsum([len(p) for p in parts])[:-1]
        return pa.table({"chunk": pa.array(chunk, pa.int64()), "name": t.column("name"), "kind": pa.array([1] * len(chunk), pa.int32()), "bucket": pa.array([key[0].as_py()] * len(chunk), pa.int32()), "data": pa.array([codec.pack(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()) for x in np.split(totals, cuts)], pa.binary())})

    answers = asked.groupBy("bucket").applyInArrow(count, "chunk long, name long, kind int, bucket int, data binary")

    def keep_texts():
        import pickle

        from pyspark import TaskContext

        codec, task = Codec(), TaskContext.get().partitionId()

        def run(batches):
            for serial, ids, texts in chunks(batches, chunk_words, lambda t: (len(common.words_of(t)), t)):
                data = codec.pack(pickle.dumps((ids, texts)))
                yield pa.record_batch([pa.array([(task << 32) + serial]), pa.array([None], pa.int64()), pa.array([0], pa.int32()), pa.array([0], pa.int32()), pa.array([data], pa.binary())], ["chunk", "name", "kind", "bucket", "data"])

        return run

    texts = common.map_arrow(docs, "chunk long, name long, kind int, bucket int, data binary", keep_texts)
    laid = texts.unionByName(answers).repartition("chunk").sortWithinPartitions("chunk", "kind", "bucket")

    def total():
        import pickle

        hashes, codec = common.WordHashes(), Codec()

        def finish(docs, totals, names):
            ids, texts = pickle.loads(codec.unpack(docs))
            h, starts = in_a_row([word_hashes(t, hashes) for t in texts])
            values, at = numbered(gram_hashes(h, starts[:-1]))
            totals = np.concatenate(totals)
            if names != {chunk_digest(ids, h, starts)} or len(totals) != len(values):
                raise RuntimeError("the documents came in other partitions when read again")
            n = np.diff(starts)
            logs = score_chunk(starts, values, at, totals)
            mean = [float(s / k) if k else None for s, k in zip(logs, n, strict=True)]
            return pa.record_batch([pa.array(ids, pa.int64()), pa.array(n), pa.array(logs), pa.array(mean, pa.float64())], ["doc_id", "n_words", "log_score", "mean_log_score"])

        def run(batches):
            now, docs, totals, names = None, None, [], set()
            for b in batches:
                for chunk, name, kind, data in zip(*(b.column(c) for c in ("chunk", "name", "kind", "data")), strict=True):
                    chunk = chunk.as_py()
                    if chunk != now:
                        if now is not None:
                            yield finish(docs, totals, names)
                        now, docs, totals, names = chunk, None, [], set()
                    if kind.as_py() == 0:
                        docs = data.as_py()
                    else:
                        names.add(name.as_py())
                        totals.append(np.ascontiguousarray(np.frombuffer(codec.unpack(data.as_py()), np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.int64))
            if now is not None:
                yield finish(docs, totals, names)

        return run

    return common.map_arrow(laid, "doc_id long, n_words long, log_score double, mean_log_score double", total)


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"))
