"""What the training-text operators share: tables, shared storage, words."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import BATCH_BYTES, bound_batches, materialise, shared_folder, table

__all__ = ["BATCH_BYTES", "bound_batches", "materialise", "shared_folder", "table"]

#: Characters between words, as every contract here states them.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: The same as a regular expression's set, without brackets.
BLANK_SET = r"\x20\x09-\x0D"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores in front as it takes to clash with no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def map_arrow(df: DataFrame, schema: str, make: Callable[[], Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]]) -> DataFrame:
    """mapInArrow with per-task set-up, on batches bounded in bytes: make() runs once in each task, and what it held goes back to the machine after it."""
    bound_batches(df.sparkSession)

    def run(batches):
        yield from make()(batches)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Hand a worker's free memory back: it stays for later tasks, idle, beside the executor's heap and the other workers."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def crc_mod(column: str, divisor: int):
    """crc32 of the id's decimal text, modulo divisor; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % divisor, F.lit(0))


class WordHashes(dict):
    """word (bytes) -> 64-bit hash; forgets everything when it grows too large."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        import xxhash

        self._hash, self._limit = xxhash.xxh3_64_intdigest, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self._limit:
            self.clear()
        value = self[word] = self._hash(word)
        return value


def words_of(text: str | None) -> list[bytes]:
    """A text's words with A-Z lower-cased: runs of anything but the six blanks, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []
