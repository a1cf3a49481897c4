"""Packing documents into windows of fixed length by the sum-of-squares rule, online.

Each task reads its share of the documents once, in the order of its input, and keeps its own array
of fill levels: count[h] is the number of open windows with h tokens. A document of s tokens (whole windows
are cut off it first) goes into the level h that makes the sum of squared counts after placing smallest:
moving a window from h to h+s changes it by (h > 0) * (1 - 2 count[h]) + (h+s < size) * (1 + 2 count[h+s]);
equal changes go to the fuller window.

Windows that are still open at a task's end go on, as items of their fill, to fewer tasks that place them by the same rule
(about ``MERGE_TOKENS`` tokens each), and so on until one task is left. What no rule has closed by then, at most some
windows a level, is cut and joined until at most one window stays partly filled. ``how`` tells how a window was closed:
``slice`` (1024 tokens of one document), ``rule`` or ``joined``. What is open at once is the only memory. Which
documents share a window depends on the input's partitions; the same partitions give the same windows.

ids equal those of the tokenizers file; a fast encoder with the same vocabulary makes them (tests compare
both), and texts that hold a special token's string go through the tokenizers library itself.

Defined results: null text is an empty document with the end id alone; repeated doc_ids are separate
documents; a null doc_id is a document like others; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 1024
END_ID = 0
MERGE_TOKENS = 32_000_000
FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
#: A piece, how its window was closed, and its ids while that is open.
PIECES = ", ".join(f"{c} long" for c in FIELDS) + ", how string, ids binary"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids of texts as the tokenizers library gives them for a byte-level BPE file."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self.path, self.slow = path, None
        spec = json.load(open(path, encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        special = {x["content"] for x in spec.get("added_tokens", ())}
        self.special = tuple(special)
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself, the others for code points from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Packer:
    """Online packing; every method gives finished pieces as (doc, start, ids, doc_tokens, sequence, offset, how)."""

    def __init__(self, size: int = WINDOW):
        self.size = size
        self.count = np.zeros(size + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(size)]  # windows by fill level, each a list of pieces
        self.sequence = 0
        self._level = np.arange(size)

    def _emit(self, window: list, how: str):
        offset = 0
        for doc, start, ids, total in window:
            yield doc, start, ids, total, self.sequence, offset, how
            offset += len(ids)
        self.sequence += 1

    def place(self, s: int) -> int:
        """The fill level for a piece of s tokens, 0 for a new window."""
        h = self._level[: self.size - s + 1]
        now, then = self.count[h], self.count[h + s]
        change = np.where(h > 0, 1 - 2 * now, 0) + np.where(h + s < self.size, 1 + 2 * then, 0)
        change[(now == 0) & (h > 0)] = np.iinfo(np.int64).max  # no window there
        return int(len(change) - 1 - np.argmin(change[::-1]))

    def add(self, doc, ids: np.ndarray):
        """A document."""
        total, whole = len(ids), len(ids) // self.size * self.size
        for start in range(0, whole, self.size):
            yield from self._emit([(doc, start, ids[start : start + self.size], total)], "slice")
        if total > whole:
            yield from self.merge([(doc, whole, ids[whole:], total)], total - whole)

    def merge(self, pieces: list[tuple], s: int):
        """Pieces of s tokens, less than a window, that stay together."""
        h = self.place(s)
        window = self.open[h].pop() if h else []
        window.extend(pieces)
        if h:
            self.count[h] -= 1
        if h + s == self.size:
            yield from self._emit(window, "rule")
        else:
            self.count[h + s] += 1
            self.open[h + s].append(window)

    def leave(self):
        """What is open, as it is."""
        for level in range(self.size - 1, 0, -1):
            for window in self.open[level]:
                yield from self._emit(window, None)

    def close(self):
        """Cut and join what is open: full windows, and at most one that isn't."""
        room, current = self.size, []
        for level in range(self.size - 1, 0, -1):
            for window in self.open[level]:
                for doc, start, ids, total in window:
                    while len(ids):
                        take = ids[:room]
                        current.append((doc, start, take, total))
                        start, ids, room = start + len(take), ids[len(take) :], room - len(take)
                        if not room:
                            yield from self._emit(current, "joined")
                            room, current = self.size, []
        if current:
            yield from self._emit(current, "joined")
        self.count[:] = 0
        self.open = [[] for _ in range(self.size)]


def batch(rows: list[tuple], base: int) -> pa.RecordBatch:
    docs, starts, ids, totals, sequences, offsets, how = zip(*rows, strict=True)
    raw = [x.astype("<u4").tobytes() for x in ids]
    numbers = (docs, starts, [len(x) for x in ids], [zlib.crc32(x) for x in raw], totals, [base + s for s in sequences], offsets)
    kept = [None if h else x for h, x in zip(how, raw, strict=True)]
    return pa.record_batch([*(pa.array(x, pa.int64()) for x in numbers), pa.array(how, pa.string()), pa.array(kept, pa.binary())], [*FIELDS, "how", "ids"])


def in_batches(pieces, turn: int, most: int = 5000):
    """Rows of pieces; a window's number holds the turn, the task and a count."""
    from pyspark import TaskContext

    base, rows = (turn << 59) + (TaskContext.get().partitionId() << 36), []
    for piece in pieces:
        rows.append(piece)
        if len(rows) >= most:
            yield batch(rows, base)
            rows = []
    if rows:
        yield batch(rows, base)


def pack(docs: DataFrame, vocabulary: str | None = None, size: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """docs(doc_id, text) -> one row a piece: FIELDS, how."""
    path = vocabulary or default_vocabulary()

    def first():
        encoder, packer = Encoder(path), Packer(size)
        end = np.array([end_id], np.uint32)

        def place(batches):
            for b in batches:
                for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    yield from packer.add(doc, np.concatenate([encoder(text.as_py() or ""), end]))
            yield from packer.leave()

        return lambda batches: in_batches(place(batches), 0)

    def again(turn: int, last: bool):
        def make():
            packer = Packer(size)

            def place(batches):
                now, pieces, s = None, [], 0
                for b in batches:
                    for doc, start, total, sequence, ids in zip(*(b.column(c) for c in ("doc_id", "start", "doc_tokens", "sequence_id", "ids")), strict=True):
                        sequence, ids = sequence.as_py(), np.frombuffer(ids.as_py(), "<u4")
                        if sequence != now:
                            if pieces:
                                yield from packer.merge(pieces, s)
                            now, pieces, s = sequence, [], 0
                        pieces.append((doc.as_py(), start.as_py(), ids, total.as_py()))
                        s += len(ids)
                if pieces:
                    yield from packer.merge(pieces, s)
                yield from packer.close() if last else packer.leave()

            return lambda batches: in_batches(place(batches), turn)

        return make

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    placed = common.materialise(common.map_arrow(given, PIECES, first), "packed")
    done, turn, before = placed.filter(F.col("how").isNotNull()), 0, None
    while True:
        left = placed.filter(F.col("how").isNull())
        tokens = left.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
        tasks = max(1, -(-tokens // MERGE_TOKENS))
        # one task's open windows are bounded by the rule; were they not, each task would join its own
        last = tasks == 1 or before is not None and 2 * tokens > before
        turn, before = turn + 1, tokens
        laid = left.repartition(tasks, F.xxhash64("sequence_id")).sortWithinPartitions("sequence_id", "offset")
        placed = common.map_arrow(laid, PIECES, again(turn, last))
        if last:
            return done.unionByName(placed).drop("ids")
        placed = common.materialise(placed, "packed")
        done = done.unionByName(placed.filter(F.col("how").isNotNull()))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
