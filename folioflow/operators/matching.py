"""Blocks of a stored cut matched to a fresh one, and quotes found again in texts whose blanks and case differ."""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.registry import Registry
from ..session import table
from .blocks import BLOCKS, blocks

R = Registry()


def first_unused(stored: list, fresh: list) -> list[int | None]:
    """For each of stored, in order, the place in fresh of an equal item: the first unused one at or after the place behind the last match, else the first unused one.

    The places of an item are linked over used ones, so a long run of equal items costs no more than a short one.
    """
    places: dict[object, list[int]] = defaultdict(list)
    for at, item in enumerate(fresh):
        places[item].append(at)
    onward = {item: list(range(len(p) + 1)) for item, p in places.items()}

    def free(item, k: int) -> int:
        link = onward[item]
        end = k
        while link[end] != end:
            end = link[end]
        while link[k] != end:
            link[k], k = end, link[k]
        return end

    out, cursor = [], 0
    for item in stored:
        mine = places.get(item, ())
        k = free(item, bisect_left(mine, cursor)) if mine else 0
        if mine and k == len(mine):
            k = free(item, 0)
        if k < len(mine):
            onward[item][k] = k + 1
            out.append(mine[k])
            cursor = mine[k] + 1
        else:
            out.append(None)
    return out


MATCHES = "was long, now long, backwards boolean"


def nearest_unused(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """stored(key, pos, text), fresh(key, pos, text) -> key, was, now, backwards: each stored block's place in the fresh cut (null: lost), and fresh blocks that none took (was null).

    The cursor makes this a walk through one book after the other; blocks travel as 16 bytes of digest and a place, so a book of a million blocks
    is some tens of megabytes. backwards tells matches that stand before the one before them. Null and empty texts match nothing.
    """
    side = lambda d: d.filter(F.length("text") > 0).select(F.col(key).alias("key"), F.col("pos").cast("long").alias("pos"), F.unhex(F.md5("text")).alias("digest"))
    kind = stored.schema[key].dataType.simpleString()

    def walk(a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = a.sort_by("pos"), b.sort_by("pos")
        was, now = a["pos"].to_pylist(), b["pos"].to_pylist()
        found = first_unused(a["digest"].to_pylist(), b["digest"].to_pylist())
        rows, last = [], -1
        for p, at in zip(was, found, strict=True):
            rows.append((p, None if at is None else now[at], at is not None and at < last))
            last = last if at is None else at
        used = set(found)
        rows += [(None, p, False) for at, p in enumerate(now) if at not in used]
        k = (a if len(a) else b)["key"][0]
        columns = list(zip(*rows, strict=True)) or [()] * 3
        return pa.table({"key": pa.array([k.as_py()] * len(rows), k.type), "was": pa.array(columns[0], pa.int64()), "now": pa.array(columns[1], pa.int64()), "backwards": pa.array(columns[2], pa.bool_())})

    return side(stored).groupBy("key").cogroup(side(fresh).groupBy("key")).applyInArrow(walk, f"key {kind}, {MATCHES}").withColumnRenamed("key", key)


@R.query("JOIN-16 MUT-07")
def recut_places(spark, sf_dir):
    """Where each block of a stored cut stands in a fresh one that reads parts in another order, drops the shortest and finds headings too."""
    b = blocks(spark, sf_dir)
    stored = b.filter("kind = 'paragraph'").select("doc_id", "pos", "text")
    fresh = b.filter(F.length("text") >= 10).select("doc_id", (F.floor(F.col("pos") / 7) * 7 + F.col("pos") * 3 % 7).alias("pos"), "text")
    return nearest_unused(stored, fresh, "doc_id")


def locate(text: Column, quote: Column) -> Column:
    """(start, stop) of a quote in a text: as it stands, else whatever the blanks and the case; null where it is not there or has nothing but blanks.

    The squeezed text is searched; the places of the characters that were left in it lead back.
    """
    blank = r"[ \t\n\x0B\f\r]+"
    small, wanted = F.lower(text), F.regexp_replace(F.lower(quote), blank, "")
    at, loose = F.instr(text, quote), F.instr(F.regexp_replace(small, blank, ""), wanted)
    letters = F.transform(F.split(small, ""), lambda c, i: F.when(~c.rlike(blank), i))
    kept = F.filter(letters, lambda i: i.isNotNull())
    span = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("stop"))
    return F.when(wanted == "", None).when(at > 0, span(at - 1, at - 1 + F.length(quote))).when(loose > 0, span(F.get(kept, loose - 1), F.get(kept, loose - 2 + F.length(wanted)) + 1))


@R.query("STR-08 TXT-25", """WITH q AS (SELECT conv_id, turn, text, CASE conv_id % 3 WHEN 0 THEN substr(text, 3, 20) WHEN 1 THEN regexp_replace(lower(substr(text, 3, 20)), '(..)', '\\1 ', 'g') ELSE reverse(substr(text, 1, 30)) END AS quote FROM conversations),
s AS (SELECT *, lower(text) AS small, regexp_replace(lower(quote), '[ \\t\\n\\x0B\\f\\r]+', '', 'g') AS wanted, regexp_replace(lower(text), '[ \\t\\n\\x0B\\f\\r]+', '', 'g') AS squeezed FROM q),
k AS (SELECT *, strpos(text, quote) AS at_once, strpos(squeezed, wanted) AS loose, list_filter(range(0, length(small)), lambda i: NOT contains(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), small[i + 1])) AS kept FROM s)
SELECT conv_id, turn, CASE WHEN wanted = '' THEN NULL WHEN at_once > 0 THEN at_once - 1 WHEN loose > 0 THEN kept[loose] END::INT AS start, CASE WHEN wanted = '' THEN NULL WHEN at_once > 0 THEN at_once - 1 + length(quote) WHEN loose > 0 THEN kept[loose - 1 + length(wanted)] + 1 END::INT AS stop FROM k""")
def located_quotes(spark, sf_dir):
    """Quotes of turns, some with other blanks and small letters, some that are not there, found again."""
    c = table(spark, sf_dir, "conversations")
    part = F.substring("text", 3, 20)
    quote = F.when(F.col("conv_id") % 3 == 0, part).when(F.col("conv_id") % 3 == 1, F.regexp_replace(F.lower(part), "(..)", "$1 ")).otherwise(F.reverse(F.substring("text", 1, 30)))
    q = c.withColumn("quote", quote).withColumn("span", locate(F.col("text"), F.col("quote")))
    return q.select("conv_id", "turn", "span.start", "span.stop")
