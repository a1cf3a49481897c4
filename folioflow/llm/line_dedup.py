"""Line dedup with a sharded minimal perfect hash over the corpus's distinct lines.

1. One pass over the texts hashes each line's key to 128 bits (two longs). Keys under ``min_chars`` code points
   can never be dropped and are left out. Distinct (key, document) pairs are counted by key: the number
   of documents and the largest doc_id holding it.
2. Keys are dealt to shards by hash, about ``keys_per_shard`` each, and every shard becomes one index
   row: a minimal perfect hash (levels of bit arrays; a key that is alone at its place in a level stays
   there, others go on to the next) that numbers the shard's keys 0..n-1, and arrays in that order: a
   32-bit fingerprint, a count that saturates at 255, the largest doc_id.
3. Documents probe: their (shard, key) rows are laid beside the shard's index row and stream past it in
   bounded batches; position by the hash, fingerprint compared, count and doc_id read. Lines are never
   joined with lines.
4. What is found goes back as an array of dropped keys per document, and a second pass over the texts
   rebuilds them.

Every answer comes from the arrays. Skew: a shard that gets more than ``most`` probes, which is PROBES or one HOT_PART-th of
all probes if that is more, has its index row copied, and its probes are dealt over the copies by document. By counting alone
fewer than HOT_PART shards can be that hot, so their list is broadcast, and there are fewer than 2 * HOT_PART copies.

Defined results: null or empty text is one empty line; repeated doc_ids hold lines as one document but
are rebuilt row by row; a row without doc_id is no holder of its lines and keeps them all; extra columns are kept by
``dedup_lines``; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_CHARS = 40
MIN_DOCS = 5
KEYS_PER_SHARD = 200_000
PROBES = 2_000_000
HOT_PART = 4096
STRIP = common.BLANKS.encode()


# -- minimal perfect hash ------------------------------------------------------------------------

MASK = (1 << 64) - 1


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    """Another 64-bit hash of each key for each level."""
    x = keys ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & MASK)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Numbers distinct 64-bit keys 0..n-1 in about 3.7 bits a key; other keys get some number or -1."""

    GAMMA = 2.0

    def __init__(self, levels: list[np.ndarray], sizes: list[int]):
        self.levels, self.sizes = levels, sizes
        ones = [np.bincount(np.arange(len(b)) >> 3, weights=np.bitwise_count(b)).astype(np.int64) if len(b) else np.zeros(0, np.int64) for b in levels]
        self.ranks, base = [], 0
        for n in ones:  # set bits before each block of 64
            total = np.concatenate([[0], np.cumsum(n)])
            self.ranks.append(total[:-1] + base)
            base += int(total[-1])
        self.n = base

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, sizes, left = [], [], np.unique(keys.astype(np.uint64))
        while len(left):
            size = max(64, int(cls.GAMMA * len(left)) + 63 & ~63)
            place = (_mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            sizes.append(size)
            left = left[~alone[place]]
        return cls(levels, sizes)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64)
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, (bits, size, rank) in enumerate(zip(self.levels, self.sizes, self.ranks, strict=True)):
            if not len(left):
                break
            place = (_mix(keys[left], k) % np.uint64(size)).astype(np.int64)
            hit = (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
            at, p = left[hit], place[hit]
            word, block = p >> 3, p >> 6
            out[at] = rank[block]
            for i in range(7):  # whole bytes of the block before this one
                byte = (block << 3) + i
                out[at] += np.where(byte < word, np.bitwise_count(bits[np.minimum(byte, len(bits) - 1)]), 0)
            out[at] += np.bitwise_count(bits[word] & ((1 << (p & 7)) - 1).astype(np.uint8))
            left = left[~hit]
        return out

    def dump(self) -> tuple[list[bytes], list[int]]:
        return [b.tobytes() for b in self.levels], self.sizes

    @classmethod
    def load(cls, levels: list[bytes], sizes: list[int]) -> PerfectHash:
        return cls([np.frombuffer(b, np.uint8) for b in levels], list(sizes))


# -- lines ---------------------------------------------------------------------------------------


def _keys(text: str, min_chars: int):
    """(line, 128-bit key as two signed longs or None) of each line."""
    import xxhash

    digest = xxhash.xxh3_128_intdigest
    for line in text.split("\n"):
        if len(line) < min_chars:
            yield line, None
            continue
        key = line.encode("utf-8", "surrogatepass").strip(STRIP).lower()
        if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "surrogatepass")) < min_chars:
            yield line, None
            continue
        h = digest(key)
        yield line, ((h >> 64) - (1 << 63), (h & MASK) - (1 << 63))


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """docs(doc_id, text) -> (h1, h2, doc_id): distinct keys of each row."""

    def make():
        def run(batches):
            for b in batches:
                ids, a, c = [], [], []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    if doc is None or (t := text.as_py()) is None:
                        continue
                    seen = {k for _, k in _keys(t, min_chars) if k}
                    ids += [doc] * len(seen)
                    for x, y in seen:
                        a.append(x)
                        c.append(y)
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(ids, pa.int64())], ["h1", "h2", "doc_id"])

        return run

    return common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "h1 long, h2 long, doc_id long", make)


INDEX = "data binary"  # one value: many null arrays beside each probe are slow to hand over


def build_index(counts: DataFrame, shards: int) -> DataFrame:
    """counts(h1, h2, n, top) -> one row a shard: the perfect hash and its arrays. Group size is bounded by the choice of shards."""

    def shard(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        h1, h2 = (t.column(c).to_numpy().astype(np.uint64) for c in ("h1", "h2"))
        mixed = h1 ^ _mix(h2, 63)
        mph = PerfectHash.build(mixed)
        at = mph(mixed)
        prints, n, docs = np.zeros(mph.n, np.uint32), np.zeros(mph.n, np.uint8), np.zeros(mph.n, np.int64)
        prints[at] = (h2 >> np.uint64(32)).astype(np.uint32)
        n[at] = np.minimum(t.column("n").to_numpy(), 255)
        docs[at] = t.column("top").to_numpy()
        levels, sizes = mph.dump()
        data = pickle.dumps((levels, sizes, prints.tobytes(), n.tobytes(), docs.tobytes()))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([data], pa.binary())})

    return counts.withColumn("shard", F.pmod("h1", F.lit(shards))).groupBy("shard").applyInArrow(shard, f"shard long, {INDEX}")


def probe(index: DataFrame, probes: DataFrame, loads: DataFrame, shards: int, most: int, least: int) -> DataFrame:
    """probes(h1, h2, doc_id) against the arrays of their shard -> (doc_id, h1, h2) to drop; loads(shard, probes)."""
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in index.schema.fields[1:]]
    hot = loads.filter(F.col("probes") > most).select("shard", F.ceil(F.col("probes") / F.lit(most)).cast("int").alias("copies"))
    copy = F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))
    laid = index.join(F.broadcast(hot), "shard", "left").withColumn("copy", copy).drop("copies")
    laid = laid.withColumns({c: F.lit(None).cast("long") for c in ("h1", "h2", "doc_id")}).withColumn("kind", F.lit(0))
    asked = probes.withColumn("shard", F.pmod("h1", F.lit(shards))).join(F.broadcast(hot), "shard", "left")
    dealt = F.pmod(F.xxhash64("doc_id"), F.coalesce("copies", F.lit(1))).cast("int")
    asked = asked.select("shard", *empty, dealt.alias("copy"), "h1", "h2", "doc_id", F.lit(1).alias("kind"))
    both = laid.unionByName(asked).repartition("shard", "copy").sortWithinPartitions("shard", "copy", "kind").drop("copy")

    def make():
        state: dict = {}

        def run(batches):
            for b in batches:
                shard, kind = b.column("shard").to_numpy(), b.column("kind").to_numpy()
                cuts = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])]))
                for i, start in enumerate(cuts):
                    stop = cuts[i + 1] if i + 1 < len(cuts) else len(shard)
                    if kind[start] == 0:
                        levels, sizes, prints, n, docs = pickle.loads(b.column("data")[start].as_py())
                        state.update(mph=PerfectHash.load(levels, sizes), prints=np.frombuffer(prints, np.uint32), n=np.frombuffer(n, np.uint8), docs=np.frombuffer(docs, np.int64))
                        continue
                    part = b.slice(start, stop - start)
                    h1, h2 = (part.column(c).to_numpy().astype(np.uint64) for c in ("h1", "h2"))
                    doc = part.column("doc_id").to_numpy()
                    at = state["mph"](h1 ^ _mix(h2, 63))
                    found = at >= 0
                    at = np.where(found, at, 0)
                    found &= state["prints"][at] == (h2 >> np.uint64(32)).astype(np.uint32)
                    drop = found & (state["n"][at] >= least) & (state["docs"][at] != doc)
                    part = part.filter(pa.array(drop))
                    yield pa.record_batch([part.column("doc_id"), part.column("h1"), part.column("h2")], ["doc_id", "h1", "h2"])

        return run

    return common.map_arrow(both, "doc_id long, h1 long, h2 long", make)


def find_drops(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, h1, h2): keys whose lines that document loses."""
    if not 1 <= min_docs <= 255:
        raise ValueError("min_docs must be from 1 to 255: the count array saturates there")
    pairs = common.materialise(line_keys(docs, min_chars).distinct(), "line-keys")
    counts = common.materialise(pairs.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top")), "line-counts")
    sums = counts.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs")).first()
    shards = max(1, -(-sums["keys"] // KEYS_PER_SHARD))
    loads = counts.groupBy(F.pmod("h1", F.lit(shards)).alias("shard")).agg(F.sum("n").alias("probes"))
    most = max(PROBES, sums["pairs"] // HOT_PART)
    return probe(build_index(counts, shards), pairs, loads, shards, most, min_docs)


def rebuild(docs: DataFrame, drops: DataFrame, min_chars: int, fields: str, emit) -> DataFrame:
    """Each row of docs (doc_id and text first) with its lines kept; emit(kept lines, all lines, dropped) -> values of fields."""
    import pyspark.sql.types as T

    key, known, gone_keys = common.fresh(docs, "key", "known", "lost")
    # one row a document that loses lines, written so that adaptive execution can split a document's many rows on the other side
    lost = drops.groupBy(F.col("doc_id").alias(key)).agg(F.collect_list(F.struct("h1", "h2")).alias(gone_keys)).withColumn(known, F.lit(True))
    lost = common.materialise(lost, "line-drops")
    # rows without doc_id lose nothing: they meet no key, and are dealt out by their texts and where they are read
    apart = F.xxhash64(F.col("text"), F.spark_partition_id())
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), apart)).withColumn(known, F.col("doc_id").isNotNull())
    names = docs.columns
    # one kind of join at every size: texts are dealt by document and merged, whether what they lose is small or not
    joined = keyed.join(lost.hint("merge"), [key, known], "left").select(*[F.col(f"`{c}`") for c in names], gone_keys)
    added = T._parse_datatype_string(fields)
    schema = T.StructType([*docs.schema.fields, *added.fields])
    where = names.index("text")

    def make():
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(added)

        def run(batches):
            for b in batches:
                out = []
                for text, lost in zip(b.column(where), b.column(len(names)), strict=True):
                    lines = list(_keys(text.as_py() or "", min_chars))
                    gone = {(x["h1"], x["h2"]) for x in lost.as_py()} if lost.is_valid else ()
                    kept = [line for line, key in lines if key is None or key not in gone]
                    out.append(emit(kept, len(lines)))
                more = [pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)]
                yield pa.record_batch([*(b.column(c) for c in range(len(names))), *more], names=[*names, *arrow.names])

        return run

    return common.map_arrow(joined, schema, make)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs(doc_id, text, ...) with repeated lines dropped; same columns."""
    columns = docs.columns
    drops = find_drops(docs.select("doc_id", "text"), min_chars, min_docs)
    (text,) = common.fresh(docs, "kept_text")
    out = rebuild(docs, drops, min_chars, f"{text} string", lambda kept, n: ("\n".join(kept),))
    # a text that loses nothing stays as it was, null included
    out = out.withColumn("text", F.when(F.col("text").isNotNull(), F.col(text)))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)


def digests(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_lines, n_dropped, kept_sha256."""
    docs = docs.select("doc_id", "text")
    drops = find_drops(docs, min_chars, min_docs)

    def emit(kept, n):
        return n, n - len(kept), hashlib.sha256("\n".join(kept).encode("utf-8", "surrogatepass")).hexdigest()

    return rebuild(docs, drops, min_chars, "n_lines long, n_dropped long, kept_sha256 string", emit).drop("text")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"))


ORACLE = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
c AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.top AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
