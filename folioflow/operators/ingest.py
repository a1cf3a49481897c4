"""Queries that read documents into blocks and edit text: no SQL states them, tests compare them with plain versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import editing as E
from ..plans.registry import Registry
from ..session import table
from .blocks import BLOCKS
from ..sources.html import html_blocks

R = Registry()


@R.query("ING-01 ING-04 ING-06 ING-10 UDF-04")
def html_block_rows(spark, sf_dir):
    return html_blocks(table(spark, sf_dir, "pages"), "page_id").select("page_id", "seq", "kind", "block_id", "text")


@R.query("STR-09 STR-10 UDF-01")
def turn_diffs(spark, sf_dir):
    """Word differences between a user's turn and the answer to it."""
    c = table(spark, sf_dir, "conversations")
    u = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("a"))
    v = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    diff = E.column(lambda a, b: [{"op": o, "text": t} for o, t in E.word_diff(a, b)], "array<struct<op:string,text:string>>")
    ratio = E.column(E.change_ratio, "double")
    return u.join(v, ["conv_id", "turn"]).select("conv_id", "turn", F.size(diff("a", "b")).alias("pieces"), F.round(ratio("a", "b"), 6).alias("changed"))


@R.query("STR-18")
def clause_spans(spark, sf_dir):
    spans = E.column(lambda t: [{"start": a, "stop": z} for a, z in E.clauses(t)], "array<struct<start:int,stop:int>>")
    return table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(spans("text")).alias("n", "s")).select("item_id", "n", "s.*")


@R.query("TXT-20 TXT-28")
def fitted_blocks(spark, sf_dir, limit=1500):
    """Long texts as exact slices at sentence ends; sentences over the limit are reported instead of cut."""

    def cut(t):
        try:
            return [{"offset": a, "piece": p} for a, p in E.fitted(t, limit)]
        except ValueError:
            return None

    parts = E.column(cut, "array<struct<offset:int,piece:string>>")
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.posexplode_outer(parts("text")).alias("part", "s")).select("conv_id", "turn", "part", "s.offset", F.length("s.piece").alias("chars"))


@R.query("HSH-04")
def natural_keys(spark, sf_dir):
    key = E.column(lambda a, b: E.natural_uuid(a, b), "string")
    return table(spark, sf_dir, "nation").select("n_nationkey", key("n_name", F.col("n_regionkey").cast("string")).alias("key"))


@R.query("MUT-07", f"""WITH {BLOCKS}, s AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id, text ORDER BY pos) AS nth FROM blocks WHERE kind = 'paragraph'), f AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id, text ORDER BY pos) AS nth FROM blocks WHERE length(text) >= 10),
m AS (SELECT coalesce(s.doc_id, f.doc_id) AS doc_id, s.text IS NOT NULL AS was, f.text IS NOT NULL AS now FROM s FULL JOIN f ON s.doc_id = f.doc_id AND s.text = f.text AND s.nth = f.nth),
c AS (SELECT doc_id, count(*) FILTER (was AND now) AS kept, count(*) FILTER (NOT now) AS lost, count(*) FILTER (NOT was) AS new FROM m GROUP BY doc_id) SELECT *, lost > 0.02 * (kept + lost) OR new > 0.05 * (kept + new) AS refused FROM c""")
def recut_matches(spark, sf_dir):
    """Stored blocks matched to a fresh cut by text: the n-th occurrence of a text to its n-th; lost and new ones show as nulls."""
    from pyspark.sql import Window as W

    from .blocks import blocks

    b = blocks(spark, sf_dir)
    nth = F.row_number().over(W.partitionBy("doc_id", "text").orderBy("pos"))
    # the stored cut knew no headings, the fresh one drops the shortest blocks
    stored = b.filter("kind = 'paragraph'").withColumn("nth", nth).select("doc_id", "text", "nth", F.col("pos").alias("was"))
    fresh = b.filter(F.length("text") >= 10).withColumn("nth", nth).select("doc_id", "text", "nth", F.col("pos").alias("now"))
    m = stored.join(fresh, ["doc_id", "text", "nth"], "full")
    return m.groupBy("doc_id").agg(F.count_if(F.col("was").isNotNull() & F.col("now").isNotNull()).alias("kept"), F.count_if(F.col("now").isNull()).alias("lost"), F.count_if(F.col("was").isNull()).alias("new")).withColumn("refused", (F.col("lost") > 0.02 * (F.col("kept") + F.col("lost"))) | (F.col("new") > 0.05 * (F.col("kept") + F.col("new"))))
