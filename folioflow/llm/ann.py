"""Nearest neighbours by inner product with randomly rotated one-bit codes.

* Index: every vector is centred on the mean of all vectors, scaled to unit length, rotated by one seeded random
  rotation, and kept as the signs of its coordinates (packed bits) with correction scalars: its distance from the
  centre, and the inner product of the unit vector with its own code, which makes the estimate unbiased.
* Estimate: <q, x> = <q, c> + |x-c| * <code, R q> / <code, R o>. Its error is below
  |x-c| * |q| * eps * sqrt((1 - f^2) / f^2 / (d - 1)) for f = <code, R o> with a probability that eps sets.
* Search: blocks of queries meet blocks of codes. A block first reranks the ``probe`` best estimates of each query to
  get a floor for its k-th score, then every vector whose upper bound reaches the floor; reranking computes the
  measure itself in double precision on the original vectors. The best k of each block are merged per query.

Blocks bound memory: ``block`` vectors each. Equal vectors of a block are indexed once, with their k+1 smallest
ids; others can't be among k results, as ties go to the smaller id. Queries are a stated set (ids divisible by
``every``). Blocks of queries meet blocks of codes on a grid: each cell is a group of up to ``GROUP`` query blocks, held in
memory, past which a group of code blocks streams. What is shuffled is codes x groups of queries and queries x groups of codes.

The centre is the mean of a dimension's vectors for the ``CENTRES`` dimensions that most vectors have, and 0 for others; it
sharpens estimates and decides nothing.

Defined results: vectors that are null, of length 0, zero, or hold null or non-finite components take no part; only
vectors of equal dimension are compared; a query's own id is no candidate, in any row; a query with fewer than k
candidates gets all; repeated ids are separate candidates, but are asked once, with their smallest vector (by its first
component, then the next); extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

BLOCK = 4096
GROUP = 16
CELLS = 256  # wanted at least, before groups become larger than one block
CENTRES = 64
EPS = 3.0  # the bound then fails for about one vector in four hundred on the side that matters


def rotation(d: int, seed: int = 13) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed + d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


class Frames:
    """Centre and rotation of each dimension, made when first asked for."""

    def __init__(self, centre: dict[int, np.ndarray]):
        self.centre, self.turns = centre, {}

    def __call__(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        if d not in self.turns:
            if len(self.turns) >= CENTRES:
                self.turns.clear()
            self.turns[d] = rotation(d)
        centre = self.centre.get(d)
        return np.zeros(d) if centre is None else centre, self.turns[d]


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>, d): vectors that take part."""
    v = F.col("v")
    nan_or_inf = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
        .filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~nan_or_inf & F.exists(v, lambda x: x != 0))
        .withColumn("d", F.size(v))
    )


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, distance from the centre, and f = <code, rotated unit vector>."""
    rest = x - centre
    far = np.sqrt((rest * rest).sum(1))
    unit = rest / np.where(far > 0, far, 1)[:, None]
    turned = unit @ turn
    bits = turned > 0
    f = np.abs(turned).sum(1) / np.sqrt(x.shape[1])
    return np.packbits(bits, axis=1), far, np.where(far > 0, f, 1.0)


def blocks(vectors: DataFrame, centre: dict[int, np.ndarray], block: int, copies: int) -> DataFrame:
    """(vec_id, v, d) -> blocks of codes: d, block, n, ids (list per distinct vector), vectors, bits, far, f as bytes."""

    def make():
        from pyspark import TaskContext

        frames = Frames(centre)
        task = TaskContext.get().partitionId()

        def flush(d, ids, x, serial):
            ids, x = np.concatenate(ids), np.concatenate(x)
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            _, first, which = np.unique(x.view(np.dtype((np.void, x.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
            # the copies of each distinct vector by id; the smallest are enough
            by = np.argsort(which, kind="stable")
            start = np.searchsorted(which[by], np.arange(len(first)))
            rank = np.arange(len(by)) - start[which[by]]
            by, rank = by[rank < copies], rank[rank < copies]
            held = np.full((len(first), int(rank.max()) + 1), -1, np.int64)
            mask = np.zeros(held.shape, bool)
            held[which[by], rank], mask[which[by], rank] = ids[by], True
            x = np.ascontiguousarray(x[first])
            bits, far, f = encode(x, *frames(d))
            return d, (task << 32) + serial, len(x), held.tobytes(), mask.tobytes(), x.tobytes(), bits.tobytes(), far.tobytes(), f.tobytes()

        def batch(rows):
            kinds = (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 6)
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["d", "block", "n", "ids", "mask", "x", "bits", "far", "f"])

        def run(batches):
            waiting: dict[int, list] = {}
            serial = 0
            for b in batches:
                dims, ids = b.column("d").to_numpy(), b.column("vec_id").to_numpy()
                flat = b.column("v").flatten().to_numpy()
                offsets = np.concatenate([[0], np.cumsum(dims)])
                for d in np.unique(dims):
                    at = np.flatnonzero(dims == d)
                    x = np.stack([flat[offsets[i] : offsets[i + 1]] for i in at])
                    for lo in range(0, len(at), block):
                        w = waiting.setdefault(int(d), [[], [], 0])
                        w[0].append(ids[at[lo : lo + block]])
                        w[1].append(x[lo : lo + block])
                        w[2] += len(w[0][-1])
                        if w[2] >= block:
                            yield batch([flush(int(d), w[0], w[1], serial)])
                            serial += 1
                            del waiting[int(d)]
            for d, w in waiting.items():
                yield batch([flush(d, w[0], w[1], serial)])
                serial += 1

        return run

    return common.map_arrow(vectors, "d int, block long, n int, ids binary, mask binary, x binary, bits binary, far binary, f binary", make)


def best(q_ids: np.ndarray, q: np.ndarray, c: dict, centre: np.ndarray, turn: np.ndarray, k: int, probe: int) -> tuple[np.ndarray, ...]:
    """The k best candidates of one block for each query: (query index, vec_id, score)."""
    n, d = c["x"].shape
    code = (np.unpackbits(c["bits"], axis=1, count=d).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(d))
    scale = c["far"] / c["f"]
    bound = (c["far"] * EPS * np.sqrt(np.maximum(1 - c["f"] ** 2, 0) / c["f"] ** 2 / max(d - 1, 1)) + 1e-6 * (1 + c["far"])).astype(np.float32)
    code *= scale.astype(np.float32)[:, None]
    out = []
    for lo in range(0, len(q), 256):
        part = q[lo : lo + 256]
        guess = (part @ turn).astype(np.float32) @ code.T
        guess += (part @ centre).astype(np.float32)[:, None]
        length = np.sqrt((part * part).sum(1)).astype(np.float32)[:, None]
        exact = lambda i, j: np.concatenate([(part[i[s : s + 100_000]] * c["x"][j[s : s + 100_000]]).sum(1) for s in range(0, max(1, len(i)), 100_000)])  # noqa: E731, B023
        count = c["mask"].sum(1)
        if n > probe:
            # a floor for the k-th score: the probe best estimates, by their exact scores; its own row may be among them
            near = np.argpartition(-guess, probe - 1, axis=1)[:, :probe]
            i = np.repeat(np.arange(len(part)), probe)
            s = exact(i, near.ravel()).reshape(len(part), probe)
            floor = np.partition(s, probe - k - 1, axis=1)[:, probe - k - 1]  # the (k+1)-th best
            i, j = np.nonzero(guess + length * bound >= floor[:, None].astype(np.float32))
            s = exact(i, j)
            # what the probe has shown to be too low goes before ids are looked up
            high = s >= floor[i]
            i, j, s = i[high], j[high], s[high]
        else:
            i, j = (x.ravel() for x in np.indices((len(part), n)))
            s = exact(i, j)
        rep = count[j]
        i, s = np.repeat(i, rep), np.repeat(s, rep)
        at = np.repeat(np.arange(len(j)), rep)
        copy = np.arange(len(at)) - np.repeat(np.cumsum(rep) - rep, rep)
        ids = c["ids"][j[at], copy]
        other = ids != q_ids[lo + i]
        i, s, ids = i[other], s[other], ids[other]
        order = np.lexsort((ids, -s, i))
        i, s, ids = i[order], s[order], ids[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        top = rank < k
        out.append((lo + i[top], ids[top], s[top]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def search(vectors: DataFrame, every: int = 20, k: int = 20, block: int = BLOCK, probe: int = 64) -> DataFrame:
    """vectors(vec_id, embedding) -> query_id, rank, vec_id, score."""
    vectors = usable(vectors)
    sizes = [r["d"] for r in vectors.groupBy("d").count().orderBy(F.desc("count"), "d").limit(CENTRES).collect()]
    means = vectors.filter(F.col("d").isin(sizes)).select("d", F.posexplode("v").alias("i", "x")).groupBy("d", "i").agg(F.avg("x").alias("x")).toPandas()
    centre = {d: part.sort_values("i")["x"].to_numpy(float) for d, part in means.groupby("d")}
    codes = common.materialise(blocks(vectors, centre, block, k + 1), "codes")
    queries = vectors.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("d", F.size("v"))

    def gather():
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()

        def run(batches):
            serial = 0
            for b in batches:
                dims, ids = b.column("d").to_numpy(), b.column("vec_id").to_numpy()
                flat = b.column("v").flatten().to_numpy()
                offsets = np.concatenate([[0], np.cumsum(dims)])
                for d in np.unique(dims):
                    at = np.flatnonzero(dims == d)
                    for lo in range(0, len(at), 1024):
                        w = at[lo : lo + 1024]
                        x = np.stack([flat[offsets[i] : offsets[i + 1]] for i in w])
                        yield pa.record_batch([pa.array([d], pa.int32()), pa.array([(task << 32) + serial], pa.int64()), pa.array([ids[w].tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["d", "qblock", "qids", "q"])
                        serial += 1

        return run

    asked = common.materialise(common.map_arrow(queries, "d int, qblock long, qids binary, q binary", gather), "query-blocks")
    n_codes, n_asked = codes.count(), asked.count()
    group = max(1, min(GROUP, int((n_codes * n_asked / CELLS) ** 0.5)))
    rows, columns = max(1, -(-n_codes // group)), max(1, -(-n_asked // group))
    # blocks meet in the cells of a grid, queries first
    names = ["block", "n", "ids", "mask", "x", "bits", "far", "f"]
    place = lambda block, n: F.pmod(F.xxhash64(block), F.lit(n)).cast("int")
    every_one = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    kinds = dict(codes.dtypes)
    left = asked.select("d", F.lit(0).alias("kind"), place("qblock", columns).alias("column"), every_one(rows).alias("row"), "qblock", "qids", "q", *[F.lit(None).cast(kinds[c]).alias(c) for c in names])
    right = codes.select("d", F.lit(1).alias("kind"), every_one(columns).alias("column"), place("block", rows).alias("row"), F.lit(None).cast("long").alias("qblock"), F.lit(None).cast("binary").alias("qids"), F.lit(None).cast("binary").alias("q"), *names)
    work = left.unionByName(right).repartition("d", "row", "column").sortWithinPartitions("d", "row", "column", "kind")

    def run_blocks():
        frames = Frames(centre)

        def run(batches):
            cell, held = None, []
            for b in batches:
                for r in range(b.num_rows):
                    row = {c: b.column(c)[r].as_py() for c in b.schema.names}
                    d = row["d"]
                    if (here := (d, row["row"], row["column"])) != cell:
                        cell, held = here, []
                    if row["kind"] == 0:
                        ids = np.frombuffer(row["qids"], np.int64)
                        held.append((ids, np.frombuffer(row["q"], float).reshape(len(ids), d)))
                        continue
                    n = row["n"]
                    c = {"x": np.frombuffer(row["x"], float).reshape(n, d), "bits": np.frombuffer(row["bits"], np.uint8).reshape(n, -1), "far": np.frombuffer(row["far"]), "f": np.frombuffer(row["f"]), "ids": np.frombuffer(row["ids"], np.int64).reshape(n, -1), "mask": np.frombuffer(row["mask"], bool).reshape(n, -1)}
                    for q_ids, q in held:
                        i, ids, s = best(q_ids, q, c, *frames(d), k, probe)
                        for lo in range(0, len(i), 50_000):
                            e = slice(lo, lo + 50_000)
                            yield pa.record_batch([pa.array(q_ids[i[e]]), pa.array(ids[e]), pa.array(s[e])], ["query_id", "vec_id", "score"])

        return run

    found = common.map_arrow(work, "query_id long, vec_id long, score double", run_blocks)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings"))
