"""Near-duplicate detection with SetSketch registers.

1. A text's set: distinct hashes of its word shingles. Rows with equal sets form a class (digest of the whole set), which
   has a number; from here on only the text of its smallest doc_id is worked with.
2. Sketch: register i is the largest, over the set, of floor(1 - log_b h_i) for hashes h_i with an exponential law,
   cut to [0, q+1]: exponentially spaced truncated minima. Two sketches merge by taking the larger of each
   register (``merge``).
3. Bands of registers make keys; texts that share a key may be similar. A key's members are compared with one of them
   only, its hub, not with each other: no pairs within a group.
4. For each pair the number of registers that are larger, smaller and equal, with both set sizes, gives the
   likelihood of the similarity; pairs whose estimate is ``slack`` below the threshold or further are dropped, and so
   are pairs whose sizes alone rule it out. The rest are verified on full sets.
5. Links make components. Members of one key that are still in different components have not all been compared;
   comparing goes on with another hub per key, while that settles a tenth of the open pairs or more and
   these are more than ``OPEN`` for each band key of all texts; then every open pair is estimated, once, in blocks of a key's
   members, and those that may be similar are verified on full sets inside the block. A block puts out links only, and those
   between parts that it has not joined yet: fewer than it has members. So no link that banding shows is missed.

Full sets are read again from the texts (only texts in some pair), sent to where the hub's set is: a hub's pairs are
dealt over several groups, so a hub of very many texts is no hot spot, and its pairs stream past it. Where one side of a
join is an aggregate by the same key, it is written first: both sides are then plain shuffles, whose hot partitions
adaptive execution splits.

What banding may miss: two texts at a similarity of exactly 0.8 share no key with a chance of (1 - 0.8^6)^42, 3 in a
million, and less above; the estimate has a standard error of 0.025 there, and pairs are verified within five of them
(``slack``); with a slack of 1 all pairs that share a key are.

Defined results: texts without words (or null) have an empty set, are linked with nothing and are kept; with fewer
words than the shingle the sequence is the one element; rows with the same doc_id are one document, which is linked where
any of its texts is (n_shingles is each row's own); a null doc_id is linked with nothing, has no component and is kept;
extra columns are kept by ``keep_one``; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

REGISTERS, BANDS = 252, 42
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 2
SALT_PAIRS = 256
#: A block has about so many members at most, and so many elements of their sets.
BLOCK, BLOCK_ELEMENTS = 1024, 2_000_000
OPEN = 32
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _B
    x = (x ^ (x >> np.uint64(29))) * _C
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, hashes: common.WordHashes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of k words."""
    words = common.words_of(text)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    out = np.zeros(max(1, len(h) - k + 1), np.uint64)
    for i in range(min(k, len(h))):
        out = (out ^ h[i : i + len(out)]) * _A + np.uint64(i + 1)
        out ^= out >> np.uint64(29)
    return np.unique(_scramble(out + np.uint64(min(len(h), k))))


class Sketcher:
    """SetSketch registers of sets of hashes."""

    ROWS = 1024

    def __init__(self, m: int = REGISTERS, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.factors = rng.integers(0, 1 << 31, m, np.uint32) * np.uint32(2) + np.uint32(1)
        self.m = m

    def __call__(self, elements: np.ndarray) -> np.ndarray:
        # 32 bits of each hash, by an odd factor for each register; the smallest product over the set
        x = (elements ^ (elements >> np.uint64(32))).astype(np.uint32)[:, None]
        least = np.full(self.m, np.iinfo(np.uint32).max, np.uint32)
        for at in range(0, len(x), self.ROWS):
            np.minimum(least, (x[at : at + self.ROWS] * self.factors).min(0), out=least)
        # smallest of uniform hashes -> smallest of exponential ones -> exponentially spaced register
        h = -np.log1p(-(least.astype(float) + 0.5) / 2.0**32) / RATE
        return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def compare_registers(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row by row, how many registers are larger in a, and how many are larger in b."""
    return (a > b).sum(1), (a < b).sum(1)


def estimate(larger: np.ndarray, smaller: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, m: int = REGISTERS, steps: int = 200) -> np.ndarray:
    """Similarity of largest likelihood, given the numbers of larger and smaller registers and the sets' sizes."""
    equal = m - larger - smaller
    total = (n_a + n_b).astype(float)
    u, v = n_a / total, n_b / total
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
    best, found = np.full(len(larger), -np.inf), np.zeros(len(larger))
    for j in np.linspace(0, 1, steps + 1):
        # what is in one set alone makes its register larger
        inside = j <= np.minimum(u / v, v / u) + 1e-12
        more, less = p(u - v * j), p(v - u * j)
        same = np.clip(1 - more - less, 1e-12, 1)
        like = larger * np.log(more) + smaller * np.log(less) + equal * np.log(same)
        like = np.where(inside, like, -np.inf)
        found = np.where(like > best, j, found)
        best = np.maximum(best, like)
    return found


def reaches(larger: np.ndarray, smaller: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least: float, step: float = 0.005) -> np.ndarray:
    """Whether ``estimate`` is ``least`` or more: the likelihood has one top, and does not fall up to there."""
    total = (n_a + n_b).astype(float)
    u, v = n_a / total, n_b / total
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def like(j):
        more, less = p(u - v * j), p(v - u * j)
        return larger * np.log(more) + smaller * np.log(less) + (REGISTERS - larger - smaller) * np.log(np.clip(1 - more - less, 1e-12, 1))

    return np.full(len(u), True) if least <= 0 else like(least) >= like(max(least - step, 0.0))


def alike(a: np.ndarray, b: np.ndarray, per_hundred: int) -> bool:
    """Whether sorted sets have 100 * intersection >= per_hundred * union; empty ones do not."""
    if not len(a) or not len(b):
        return False
    both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return 100 * both >= per_hundred * (len(a) + len(b) - both)


SETS = "doc_id long, mark long, n long, d1 long, d2 long, registers binary"


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """docs(doc_id, text) -> SETS: one row a document row."""

    def make():
        hashes, sketch = common.WordHashes(), Sketcher()

        def run(batches):
            for b in batches:
                n, d1, d2, regs = [], [], [], []
                for text in b.column(1):
                    s = shingles(text.as_py(), hashes, k)
                    n.append(len(s))
                    one, two = digest(s)
                    d1.append(one)
                    d2.append(two)
                    regs.append(sketch(s).tobytes() if len(s) else None)
                yield pa.record_batch([b.column(0), b.column(2), *(pa.array(x, pa.int64()) for x in (n, d1, d2)), pa.array(regs, pa.binary())], ["doc_id", "mark", "n", "d1", "d2", "registers"])

        return run

    return common.map_arrow(marked(docs), SETS, make)


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text: which of a document's texts a class stands for."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))


def digest(elements: np.ndarray) -> tuple[int, int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(elements.tobytes())
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


class Bander:
    """Keys of registers: one 64-bit hash of each band."""

    def __init__(self):
        self.rows = REGISTERS // BANDS
        self.odd = np.random.default_rng(9).integers(0, 1 << 63, (1, BANDS, self.rows), np.uint64) * np.uint64(2) + np.uint64(1)
        self.number = np.arange(BANDS, dtype=np.uint64) * _A

    def __call__(self, registers: np.ndarray) -> np.ndarray:
        r = registers.reshape(-1, BANDS, self.rows).astype(np.uint64)
        return _scramble((_scramble(r + np.uint64(1)) * self.odd).sum(2, dtype=np.uint64) + self.number).view(np.int64)


def band_keys(sets: DataFrame) -> DataFrame:
    """(doc_id, first, n, registers) -> (key, doc_id, first, n), one row a band."""

    def make():
        keys_of = Bander()

        def run(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                keys = keys_of(np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint16))
                yield pa.record_batch([pa.array(keys.reshape(-1)), *(pa.array(np.repeat(b.column(i).to_numpy(), BANDS)) for i in range(3))], ["key", "doc_id", "first", "n"])

        return run

    return common.map_arrow(sets.select("doc_id", "first", "n", "registers"), "key long, doc_id long, first long, n long", make)


def likely(pairs: DataFrame, sets: DataFrame, threshold: float, slack: float) -> DataFrame:
    """pairs(hub, doc_id) whose joint estimate may reach the threshold."""
    s = sets.select("doc_id", "n", "registers")
    both = pairs.join(s, "doc_id").join(s.select(F.col("doc_id").alias("hub"), F.col("n").alias("hub_n"), F.col("registers").alias("hub_registers")), "hub")
    both = both.filter(F.least("n", "hub_n") >= F.greatest("n", "hub_n") * F.lit(threshold)).select("hub", "doc_id", "n", "hub_n", "registers", "hub_registers")

    def make():
        def run(batches):
            for b in batches:
                for at in range(0, b.num_rows, 2000):
                    c = b.slice(at, 2000)
                    regs = [np.frombuffer(b"".join(c.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (4, 5)]
                    j = estimate(*compare_registers(*regs), c.column(2).to_numpy(), c.column(3).to_numpy())
                    yield c.select(["hub", "doc_id"]).filter(pa.array(j >= threshold - slack))

        return run

    return common.map_arrow(both, "hub long, doc_id long", make)


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, per_hundred: int) -> DataFrame:
    """pairs(hub, doc_id) of classes, checked on full sets -> those with 100 * intersection >= per_hundred * union."""
    pairs = common.materialise(pairs.distinct(), "pairs")
    sizes = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("pairs"))
    spread = common.materialise(sizes.select("hub", F.ceil(F.col("pairs") / F.lit(SALT_PAIRS)).cast("int").alias("parts")), "hubs")
    asked = pairs.join(spread, "hub").select("doc_id", "hub", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"))
    # a hub's own set goes to each of its parts: one entry that names their number
    hubs = spread.select(F.col("hub").alias("doc_id"), "hub", F.col("parts").alias("part"), F.lit(0).alias("kind"))
    wanted = asked.unionByName(hubs).groupBy("doc_id").agg(F.collect_list(F.struct("hub", "part", "kind")).alias("to"))
    where = classes.select(F.col("class"), F.col("doc_id").alias("id"), "mark", "d1", "d2").join(wanted.withColumnRenamed("doc_id", "class"), "class")
    texts = marked(docs).withColumnRenamed("doc_id", "id").join(where, ["id", "mark"]).select("class", "text", "d1", "d2", "to")

    def expand():
        hashes = common.WordHashes()
        seen: set[int] = set()

        def run(batches):
            for b in batches:
                rows, size = [], 0
                for number, text, d1, d2, to in zip(*(b.column(c) for c in ("class", "text", "d1", "d2", "to")), strict=True):
                    number = number.as_py()
                    if number in seen:  # a repeated row
                        continue
                    s = shingles(text.as_py(), hashes, k)
                    if digest(s) != (d1.as_py(), d2.as_py()):  # another text of that document, under the same mark
                        continue
                    seen.add(number)
                    s = s.tobytes()
                    for t in to.as_py():
                        for part in [t["part"]] if t["kind"] else range(t["part"]):
                            rows.append((t["hub"], part, t["kind"], number, s))
                            size += len(s)
                            if size > 8_000_000 or len(rows) >= 1000:
                                yield batch(rows)
                                rows, size = [], 0
                if rows:
                    yield batch(rows)

        def batch(rows):
            cols = list(zip(*rows, strict=True))
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["hub", "part", "kind", "doc_id", "elements"])

        return run

    sent = common.map_arrow(texts, "hub long, part int, kind int, doc_id long, elements binary", expand)
    laid = sent.repartition("hub", "part").sortWithinPartitions("hub", "part", "kind")

    def compare():
        state: dict = {"at": None}

        def run(batches):
            for b in batches:
                hub_out, doc_out = [], []
                for hub, part, kind, doc, raw in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                    s = np.frombuffer(raw, np.uint64)
                    if kind == 0:
                        state.update(at=(hub, part), set=s)
                        continue
                    if alike(state["set"], s, per_hundred):
                        hub_out.append(hub)
                        doc_out.append(doc)
                yield pa.record_batch([pa.array(hub_out, pa.int64()), pa.array(doc_out, pa.int64())], ["a", "b"])

        return run

    return common.map_arrow(laid, "a long, b long", compare)


def find(docs: DataFrame, k: int = 5, per_hundred: int = 80, slack: float = 0.13) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id, kept: one row a row of docs."""
    docs = docs.select("doc_id", "text")
    threshold = per_hundred / 100
    rows = common.materialise(sketches(docs, k), "sketches")
    some = rows.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    least = some.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "mark", "n", "registers")).alias("s"))
    classes = common.materialise(least.select(F.monotonically_increasing_id().alias("class"), "d1", "d2", "s.*"), "classes")
    sets = classes.select(F.col("class").alias("doc_id"), F.col("doc_id").alias("first"), "n", "registers")
    owned = common.materialise(some.select("doc_id", "d1", "d2").join(classes.select("d1", "d2", "class"), ["d1", "d2"]).select("doc_id", "class").distinct(), "owned")
    # a document with several texts ties their classes together
    several = common.materialise(owned.groupBy("doc_id").agg(F.min("class").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id", "b"), "several")
    edges = owned.join(several, "doc_id").filter(F.col("class") != F.col("b")).select(F.col("class").alias("a"), "b").distinct()
    keys = common.materialise(shared_keys(band_keys(sets)), "bands")

    tried = None
    roots = keys.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("root")).distinct()
    all_keys = BANDS * sets.count()
    turn, last, open_pairs = 0, False, None
    while True:
        if last:
            found = block_links(keys, roots, classes, docs, k, per_hundred, slack)
        else:
            pairs = hub_pairs(keys, roots, turn)
            if tried is not None:
                pairs = pairs.join(tried, ["hub", "doc_id"], "left_anti")
            pairs = common.materialise(pairs.distinct(), "candidates")
            tried = pairs if tried is None else tried.unionByName(pairs)
            found = verify(likely(pairs, sets, threshold, slack), classes, docs, k, per_hundred)
        edges = common.materialise(edges.unionByName(found), "links")
        joined = components(edges)
        roots = common.materialise(roots.select("id").join(joined, "id", "left").select("id", F.coalesce("root", "id").alias("root")), "roots")
        if last:
            break
        before, open_pairs = open_pairs, unsettled(keys, roots)
        if not open_pairs:
            break
        turn, last = turn + 1, open_pairs <= OPEN * all_keys or before is not None and open_pairs > 0.9 * before
    # components named by their smallest document, then back from classes to rows
    rooted = classes.select("class", "d1", "d2", "doc_id").join(joined.withColumnRenamed("id", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    names = common.materialise(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "names")
    named = common.materialise(rooted.select("d1", "d2", "root").join(names, "root").select("d1", "d2", "component_id"), "named")
    linked = rows.filter((F.col("n") > 0) & F.col("doc_id").isNotNull()).join(named, ["d1", "d2"]).select("doc_id", "n", "component_id")
    # an empty text stands alone, unless its document has others
    empty = rows.filter((F.col("n") == 0) & F.col("doc_id").isNotNull()).select("doc_id", "n")
    others = linked.join(empty.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "component_id").distinct()
    alone = empty.join(others, "doc_id", "left").select("doc_id", "n", F.coalesce("component_id", "doc_id").alias("component_id"))
    nobody = rows.filter(F.col("doc_id").isNull()).select("doc_id", "n", F.lit(None).cast("long").alias("component_id"))
    out = linked.unionByName(alone).unionByName(nobody)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def shared_keys(keys: DataFrame) -> DataFrame:
    """Rows of keys with more than one member."""
    keys = common.materialise(keys, "all-bands")
    several = common.materialise(keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > 1), "shared-bands")
    return keys.join(several, "key")


def hub_pairs(keys: DataFrame, roots: DataFrame, turn: int) -> DataFrame:
    """Each member with its key's hub, where their components differ.

    First the hub is the smallest document, which copies were often made from; later one drawn by the turn.
    """
    now = keys.join(roots, keys["doc_id"] == roots["id"]).select("key", "doc_id", "root", "first")
    order = F.col("first") if not turn else F.xxhash64("doc_id", "key", F.lit(turn))
    hubs = now.groupBy("key").agg(F.min(F.struct(order.alias("o"), "doc_id", "root")).alias("h"), F.max("root").alias("top"), F.min("root").alias("low"))
    # keys whose members are all in one component have nothing to compare
    hubs = common.materialise(hubs.filter("low < top").select("key", F.col("h.doc_id").alias("hub"), F.col("h.root").alias("hub_root")), "key-hubs")
    pairs = now.join(hubs, "key").filter((F.col("root") != F.col("hub_root")))
    return pairs.select(F.least("hub", "doc_id").alias("hub"), F.greatest("hub", "doc_id").alias("doc_id"))


def unsettled(keys: DataFrame, roots: DataFrame) -> int:
    """Pairs of members of one key in different components; a pair counts once for each key."""
    now = keys.join(roots, keys["doc_id"] == roots["id"]).groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    by_key = now.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"))
    return int(by_key.agg(F.sum((F.col("n") * F.col("n") - F.col("same")) / 2)).first()[0] or 0)


class Pieces:
    """Members of two blocks of a key, and which of them may be similar to one of another component.

    A pair is looked at in the first key that it shares.
    """

    COLUMNS = ["key", "i", "j", "mine", "doc_id", "root", "n", "registers"]

    def __init__(self, threshold: float, slack: float):
        self.keys_of, self.threshold, self.least = Bander(), threshold, threshold - slack

    def __call__(self, batches):
        """Sorted batches of COLUMNS and perhaps one more, a piece at a time: name, columns."""
        now, rows = None, []
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(c).to_numpy() for c in range(7)]
            cols.append(np.frombuffer(b"".join(b.column(7).to_pylist()), np.uint16).reshape(-1, REGISTERS))
            if b.num_columns > 8:
                full = np.empty(b.num_rows, object)
                full[:] = [np.frombuffer(x, np.uint64) for x in b.column(8).to_pylist()]
                cols.append(full)
            key, i, j = cols[:3]
            cuts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
            for start, stop in zip(cuts, np.append(cuts[1:], len(key)), strict=True):
                name = (key[start], i[start], j[start])
                if name != now:
                    if rows:
                        yield now, [np.concatenate(c) for c in zip(*rows, strict=True)]
                    now, rows = name, []
                rows.append([c[start:stop] for c in cols[3:]])
        if rows:
            yield now, [np.concatenate(c) for c in zip(*rows, strict=True)]

    def likely(self, name, mine, root, n, regs):
        """Positions (x, y) of open pairs whose joint estimate may reach the threshold, some at a time."""
        key, i, j = name
        keys = self.keys_of(regs)
        band = int(np.argmax(keys[0] == key))
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        for lo in range(0, len(left), 32):
            a = left[lo : lo + 32]
            for ro in range(0, len(right), 512):
                b = right[ro : ro + 512]
                open_pair = root[a][:, None] != root[b]
                open_pair &= np.minimum(n[a][:, None], n[b]) >= self.threshold * np.maximum(n[a][:, None], n[b])
                if i == j:
                    open_pair &= a[:, None] < b
                x, y = (at[hit] for at, hit in zip((a, b), np.nonzero(open_pair), strict=True))
                first = ~(keys[x, :band] == keys[y, :band]).any(1)
                x, y = x[first], y[first]
                if not len(x):
                    continue
                good = reaches(*compare_registers(regs[x], regs[y]), n[x], n[y], self.least)
                if good.any():
                    yield x[good], y[good]


def block_links(keys: DataFrame, roots: DataFrame, classes: DataFrame, docs: DataFrame, k: int, per_hundred: int, slack: float) -> DataFrame:
    """Links (a, b) between members of one key in different components.

    All such pairs are estimated, in blocks of a key's members: each pair of blocks is one piece of work. Members with a
    partner that they may be similar to come together again, in the same pieces, with their full sets.
    """
    threshold = per_hundred / 100
    now = keys.join(roots, keys["doc_id"] == roots["id"]).select("key", "doc_id", "root", "n")
    sizes = now.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("elements"))
    blocks = F.ceil(F.greatest(F.col("m") / F.lit(BLOCK), F.least("m", F.col("elements") / F.lit(BLOCK_ELEMENTS)))).cast("int")
    mixed = common.materialise(sizes.filter(F.col("lo") != F.col("hi")).select("key", blocks.alias("blocks")), "mixed-keys")
    members = now.join(mixed, "key").withColumn("mine", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    # each block meets itself and every other once: the pair is named by the smaller and the larger
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
    registers = classes.select(F.col("class").alias("doc_id"), "registers")
    laid = dealt.join(registers, "doc_id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "mine").select(Pieces.COLUMNS)

    def look():
        pieces = Pieces(threshold, slack)

        def run(batches):
            for name, (mine, ids, root, n, regs) in pieces(batches):
                some = np.zeros(len(ids), bool)
                for x, y in pieces.likely(name, mine, root, n, regs):
                    some[x] = some[y] = True
                if some.any():
                    fixed = [pa.array(np.full(int(some.sum()), v), t) for v, t in zip(name, (pa.int64(), pa.int32(), pa.int32()), strict=True)]
                    yield pa.record_batch([*fixed, *(pa.array(c[some]) for c in (mine, ids, root, n))], Pieces.COLUMNS[:7])

        return run

    busy = common.materialise(common.map_arrow(laid, "key long, i int, j int, mine int, doc_id long, root long, n long", look), "busy")
    wanted = busy.select("doc_id").distinct()
    sets = common.materialise(full_sets(wanted, classes, docs, k), "full-sets")
    again = busy.join(sets, "doc_id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "mine").select(*Pieces.COLUMNS, "elements")

    def settle():
        pieces = Pieces(threshold, slack)

        def run(batches):
            for name, (mine, ids, root, n, regs, elements) in pieces(batches):
                parent: dict[int, int] = {}
                out = []

                def top(r, parent=parent):
                    while r in parent:
                        r = parent[r]
                    return r

                for xs, ys in pieces.likely(name, mine, root, n, regs):
                    for x, y in zip(xs.tolist(), ys.tolist(), strict=True):
                        a, b = top(root[x]), top(root[y])
                        if a != b and alike(elements[x], elements[y], per_hundred):
                            parent[max(a, b)] = min(a, b)
                            out.append((ids[x], ids[y]))
                if out:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

        return run

    return common.map_arrow(again, "a long, b long", settle)


def full_sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """wanted(doc_id) of classes -> doc_id, registers, elements."""
    where = classes.select(F.col("class"), F.col("doc_id").alias("id"), "mark", "d1", "d2", "registers").join(wanted.withColumnRenamed("doc_id", "class"), "class")
    texts = marked(docs).withColumnRenamed("doc_id", "id").join(where, ["id", "mark"]).select("class", "text", "d1", "d2", "registers")

    def make():
        hashes = common.WordHashes()

        def run(batches):
            for b in batches:
                rows, size = [], 0
                for number, text, d1, d2, regs in zip(*b.columns, strict=True):
                    s = shingles(text.as_py(), hashes, k)
                    if digest(s) == (d1.as_py(), d2.as_py()):  # else another text of that document, under the same mark
                        rows.append((number.as_py(), regs.as_py(), s.tobytes()))
                        size += 8 * len(s)
                    if size > 8_000_000:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

        def batch(rows):
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["doc_id", "registers", "elements"])

        return run

    return common.map_arrow(texts, "doc_id long, registers binary, elements binary", make)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs without all but the first of each component; same columns."""
    found = find(docs, **options)
    (name,) = common.fresh(docs, "gone")
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(common.table(spark, sf_dir, "documents"), k=4, per_hundred=80)
