"""Mixing sources to target weights by capped water-filling; DataFrame operations only.

Two parts, both without Python on the executors:

* ``water_fill`` works on one row a source. With weights w and caps c (``max_epochs`` times the
  source's size), the fill level L solves sum(min(w*L, c)) = budget. Sources sorted by c/w fill up in
  that order, so L follows from running sums; no loop is needed.
* ``mix`` turns targets into repetitions. Every document gets floor(target/size) whole repetitions.
  For the rest, a seeded hash of id and text deals a source's documents into ``slots`` slots; running sums over the
  slots (not over documents) find the slot in which the target is reached. Documents in earlier slots
  get one more whole repetition, later ones none. In that slot documents, in the order of their ids, take the same
  fraction by running rounding: each gets what the rounded running sum grows by. A source's words come within one of its target.

Only (source) and (source, slot) sums are shuffled, both pre-aggregated, so a source with a third of
all rows costs no more than others. Of documents, those in the slots that are cut are shuffled, about 1 in ``slots``, and written first; equal
ones among them (the same id and text, which share any slot) are counted where they are read, and share no task. Reruns agree.

Defined results: null text has size 0; sources of size 0 get target 0; null source is a source, last in
order; repeated doc_ids and repeated rows are separate rows; a null doc_id comes first in a slot; an empty table gives an empty result; extra
columns are ignored by ``mix`` and kept by ``repeat_texts``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

WORD = rf"[^{common.BLANK_SET}]+"
WEIGHTS = (5.0, 2.0, 1.0)
SLOTS = 4096


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 if null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """sources(source, size, weight) -> plus target. One row a source, so one sorted pass over them is enough."""
    cap = F.col("size") * F.lit(max_epochs)
    everything = W.partitionBy()
    upto = W.partitionBy().orderBy(F.col("cap") / F.col("weight"), F.col("place")).rowsBetween(W.unboundedPreceding, -1)
    filled = (
        sources.withColumn("cap", cap)
        .withColumn("budget", F.sum("size").over(everything) * F.lit(share))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(upto), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
        # the level that this source and all later ones would share, if those before it are at their caps
        .withColumn("level", (F.col("budget") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before")))
        .withColumn("full", F.col("level") * F.col("weight") >= F.col("cap"))
    )
    last = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), F.col("place"), F.col("level")).alias("s"))).over(everything)
    return filled.withColumn("final", last).select(
        "source", "size", "weight",
        F.when(F.col("full") | F.col("final").isNull(), F.col("cap")).otherwise(F.col("final.level") * F.col("weight")).alias("target"),
    )


def by_code_point(sizes: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """sizes(source, size): weights in turn, sources by code point with null last."""
    place = F.row_number().over(W.partitionBy().orderBy(F.col("source").asc_nulls_last()))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    return sizes.withColumn("place", place).withColumn("weight", F.element_at(cycle, ((F.col("place") - 1) % len(weights) + 1).cast("int")))


def plan(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, max_epochs: float = 2.0, slots: int = SLOTS) -> DataFrame:
    """sized(source, slot, size) -> one row a source: source_size, target, whole, edge (the slot that is cut), part (its fraction)."""
    cells = sized.groupBy("source", "slot").agg(F.sum("size").alias("size"))
    sizes = cells.groupBy("source").agg(F.sum("size").alias("size"))
    targets = water_fill(by_code_point(sizes, weights), share, max_epochs).select(
        "source", F.col("size").alias("source_size"), "target",
        F.when(F.col("size") > 0, F.least(F.floor(F.col("target") / F.col("size")), F.lit(int(max_epochs)))).otherwise(F.lit(0)).cast("long").alias("whole"),
    )
    rest = F.col("t.target") - F.col("t.whole") * F.col("t.source_size")
    before = F.coalesce(F.sum("c.size").over(W.partitionBy("c.source").orderBy("c.slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = (
        cells.alias("c")
        .join(targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source")))
        .select(F.col("c.source").alias("source"), "t.source_size", "t.target", "t.whole", "c.slot", F.col("c.size").alias("size"), rest.alias("rest"), before.alias("before"))
    )
    # the slot where the rest ends; slots before it go in whole
    inside = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("size") >= F.col("rest"))
    edge = F.min(F.when(inside, F.struct("slot", ((F.col("rest") - F.col("before")) / F.col("size")).alias("part"))))
    return cut.groupBy("source").agg(
        F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.max("whole").alias("whole"), F.max("rest").alias("rest"), edge.alias("edge")
    ).select(
        "source", "source_size", "target", "whole",
        # a rest that rounding puts beyond the last slot takes all slots
        F.when(F.col("edge").isNotNull(), F.col("edge.slot")).otherwise(F.when(F.col("rest") > 0, F.lit(slots)).otherwise(F.lit(-1))).alias("edge_slot"),
        F.coalesce(F.col("edge.part"), F.lit(0.0)).alias("part"),
    )


def slot_of(doc_id: Column, digest: Column, seed: str, slots: int) -> Column:
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), digest)
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % slots).cast("int")


def in_cut_slots(rows: DataFrame) -> DataFrame:
    """rows(doc_id, source, digest, size, part, ...) of the slots that are cut -> plus more: the words each takes of its last repetition.

    A running sum over cells, one for equal documents read in one place, then the place in the cell.
    """
    rows = common.materialise(rows.withColumn("at", F.spark_partition_id()), "mixing-cut")
    key = ["source", "doc_id", "digest", "at"]
    order = W.partitionBy("source").orderBy(F.asc_nulls_first("doc_id"), "digest", "at").rowsBetween(W.unboundedPreceding, -1)
    cells = rows.groupBy(*key).agg(F.sum("size").alias("words")).withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0)))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in key]
    placed = rows.alias("r").join(cells.alias("c"), same[0] & same[1] & same[2] & same[3]).select("r.*", "c.before")
    nth = F.row_number().over(W.partitionBy(*key).orderBy("digest"))
    upto = F.col("before") + (nth - 1) * F.col("size")
    rounded = lambda x: F.floor(x * F.col("part") + F.lit(0.5))
    return placed.withColumn("more", rounded(upto + F.col("size")) - rounded(upto)).drop("before", "at")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, max_epochs: float = 2.0, seed: str = "mix", slots: int = SLOTS, keep: list[str] | None = None) -> DataFrame:
    """docs(doc_id, text, source) -> doc_id, size, source_size, target, whole, source, taken.

    taken = whole repetitions times size plus the words of the last one; never above max_epochs times size.
    keep: further columns of docs to carry along, none of which may have a name of the result's.
    """
    keep = [c for c in keep or [] if c not in ("doc_id", "source")]
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    base = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), digest.alias("digest"), slot_of(F.col("doc_id"), digest, seed, slots).alias("slot"), *keep)
    # one row a source, written so that the planner knows its size: it is broadcast where that allows, and no text is shuffled; else both sides are
    chosen = common.materialise(plan(base.select("source", "slot", "size"), weights, share, max_epochs, slots), "mixing-plan")
    joined = base.alias("d").join(chosen.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    joined = joined.select("d.*", F.col("p.source_size").cast("long").alias("source_size"), "p.target", "p.whole", "p.edge_slot", "p.part")
    outside = joined.filter(F.col("slot") != F.col("edge_slot")).withColumn("more", F.when(F.col("slot") < F.col("edge_slot"), F.col("size")).otherwise(F.lit(0).cast("long")))
    inside = in_cut_slots(joined.filter(F.col("slot") == F.col("edge_slot")))
    taken = (F.col("whole") * F.col("size") + F.col("more")).cast("long").alias("taken")
    return outside.unionByName(inside).select("doc_id", "size", "source_size", "target", "whole", "source", *keep, taken)


def repeat_texts(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: docs' rows repeated whole, and a first part of the text for the fraction; docs' columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    mixed = mix(docs.select("doc_id", "text", "source", row), keep=["text", "row"], **options)
    part = F.col("taken") - F.col("whole") * F.col("size")
    # copies: `whole` full rows and one of `part` words (full again if the fraction is 1)
    lengths = F.concat(F.array_repeat(F.col("size"), F.col("whole").cast("int")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    rows = mixed.withColumn("length", F.explode(lengths))
    pieces = F.regexp_extract_all(F.col("text"), F.lit(rf"[{common.BLANK_SET}]*{WORD}"), F.lit(0))
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("length").cast("int")), "")
    text = F.when(F.col("length") >= F.col("size"), F.col("text")).otherwise(cut)
    fresh = {"text": text}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[fresh.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


#: The same in DuckDB: running sums over sources, then over slots.
ORACLE = """
WITH x AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(text, '')) AS digest
  FROM documents),
d AS (
  SELECT *, row_number() OVER () AS r, CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || digest), 1, 8)) AS BIGINT) % 4096 AS slot
  FROM x),
cells AS (SELECT source, slot, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY source, slot),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM cells GROUP BY source),
w AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, size * 2.0::DOUBLE AS cap FROM s),
f AS (
  SELECT *, sum(size) OVER () * 1.5::DOUBLE AS budget, sum(weight) OVER () AS all_weight,
         coalesce(sum(cap) OVER o, 0) AS cap_before, coalesce(sum(weight) OVER o, 0) AS weight_before
  FROM w WINDOW o AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (budget - cap_before) / (all_weight - weight_before) AS level FROM f),
g AS (SELECT *, level * weight >= cap AS is_full FROM l),
t AS (
  SELECT source, size AS source_size,
         CASE WHEN is_full OR x.level IS NULL THEN cap ELSE x.level * weight END AS target
  FROM g LEFT JOIN (SELECT level FROM g WHERE NOT is_full ORDER BY cap / weight, place LIMIT 1) x ON true),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END AS whole FROM t),
r AS (
  SELECT c.source, c.slot, c.size, e.target - e.whole * e.source_size AS rest,
         coalesce(sum(c.size) OVER (PARTITION BY c.source ORDER BY c.slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM cells c JOIN e ON c.source IS NOT DISTINCT FROM e.source),
edge AS (
  SELECT source, min(slot) AS slot, arg_min((rest - before) / size, slot) AS part
  FROM r WHERE before < rest AND before + size >= rest GROUP BY source),
tops AS (SELECT source, max(rest) AS rest FROM r GROUP BY source),
cut AS (
  SELECT d.r, d.size, edge.part, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.doc_id NULLS FIRST, d.digest, d.r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS upto
  FROM d JOIN edge ON d.source IS NOT DISTINCT FROM edge.source AND d.slot = edge.slot),
more AS (SELECT r, floor((upto + size) * part + 0.5::DOUBLE) - floor(upto * part + 0.5::DOUBLE) AS more FROM cut)
SELECT d.doc_id, d.size, e.source_size, e.target,
       CAST(e.whole * d.size + CASE
         WHEN d.slot < coalesce(edge.slot, CASE WHEN tops.rest > 0 THEN 4096 ELSE -1 END) THEN d.size
         WHEN d.slot = edge.slot THEN more.more ELSE 0 END AS BIGINT) AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
JOIN tops ON d.source IS NOT DISTINCT FROM tops.source
LEFT JOIN edge ON d.source IS NOT DISTINCT FROM edge.source
LEFT JOIN more ON d.r = more.r
"""
