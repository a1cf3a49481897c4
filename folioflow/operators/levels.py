"""Levels, panels, gates, calibration and comparisons: ordinal logic over judges' readings.

A line of a document is a window that three judges read; a reading's level follows from the window's length, so that the
readings are given data, not a model's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ordinal as O
from ..functions import text as T
from ..plans.registry import Registry
from ..session import table
from .blocks import BLOCKS, blocks

R = Registry()
LV = "['A1', 'A2', 'B1', 'B2', 'C1', 'C2']"

READINGS = BLOCKS + f""",
readings AS (SELECT doc_id, source, chapter, pos, judge, CAST((length(text) * 7 + judge * (doc_id % 3) + pos) % 6 + 1 AS INTEGER) AS ord, CAST(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS BIGINT) AS w FROM blocks, range(3) j(judge))"""


def readings(spark, sf_dir) -> DataFrame:
    b = blocks(spark, sf_dir)
    r = b.select("doc_id", "source", "chapter", "pos", F.length("text").alias("n"), T.word_count(F.col("text")).alias("w"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("judge"))
    return r.withColumn("ord", ((F.col("n") * 7 + F.col("judge") * (F.col("doc_id") % 3) + F.col("pos")) % 6 + 1).cast("int"))


@R.query("LVL-01 AGG-15", f"WITH {READINGS} SELECT doc_id, {LV}[min(ord)] AS lowest, {LV}[max(ord)] AS highest FROM readings GROUP BY doc_id")
def level_range(spark, sf_dir):
    r = readings(spark, sf_dir).withColumn("level", O.level(F.col("ord")))
    g = r.groupBy("doc_id").agg(F.min(O.ordinal(F.col("level"))).alias("lo"), F.max(O.ordinal(F.col("level"))).alias("hi"))
    return g.select("doc_id", O.level(F.col("lo")).alias("lowest"), O.level(F.col("hi")).alias("highest"))


@R.query("LVL-02 LVL-03", f"WITH {READINGS} SELECT doc_id, pos, list_sort(list(ord))[count(*) // 2 + 1] AS middle, max(ord) AS verdict, count(DISTINCT ord) = 1 AND count(*) > 1 AS agreed FROM readings GROUP BY doc_id, pos")
def panel_verdict(spark, sf_dir):
    """The middle reading, the panel's verdict (the highest), and whether all agree."""
    g = readings(spark, sf_dir).groupBy("doc_id", "pos").agg(F.collect_list("ord").alias("r"), F.max("ord").alias("verdict"), ((F.countDistinct("ord") == 1) & (F.count(F.lit(1)) > 1)).alias("agreed"))
    return g.select("doc_id", "pos", O.upper_median(F.col("r")).alias("middle"), "verdict", "agreed")


@R.query("LVL-04", f"WITH {READINGS}, v AS (SELECT doc_id, chapter, max(ord) AS v, count(*) AS n FROM readings GROUP BY ALL) SELECT doc_id, chapter, v FROM v WHERE n = 9")
def standing_verdicts(spark, sf_dir):
    """Verdicts that rest on as many readings as their chapter needs."""
    v = readings(spark, sf_dir).groupBy("doc_id", "chapter").agg(F.max("ord").alias("v"), F.count(F.lit(1)).alias("n"))
    return v.filter("n = 9").select("doc_id", "chapter", "v")


@R.query("AGG-14", f"WITH {READINGS} SELECT doc_id, quantile_disc(ord, 0.75) AS p75 FROM readings WHERE judge = 0 GROUP BY doc_id")
def p75(spark, sf_dir):
    """Nearest-rank third quartile of the ordinal."""
    return readings(spark, sf_dir).filter("judge = 0").groupBy("doc_id").agg(F.expr("percentile_disc(0.75) WITHIN GROUP (ORDER BY ord)").cast("int").alias("p75"))


_WEIGHTED = """c AS (SELECT doc_id, chapter, ord, sum(w) AS w FROM readings WHERE judge = 0 GROUP BY ALL),
s AS (SELECT *, sum(w) OVER (PARTITION BY doc_id, chapter ORDER BY ord) AS upto, sum(w) OVER (PARTITION BY doc_id, chapter) AS total FROM c),
chapters AS (SELECT doc_id, chapter, min(ord) AS level FROM s WHERE upto >= ceil(0.75 * total) GROUP BY ALL)"""


def chapter_levels(r: DataFrame) -> DataFrame:
    """The first level by which three quarters of a chapter's words are reached."""
    c = r.filter("judge = 0").groupBy("doc_id", "chapter", "ord").agg(F.sum("w").alias("w"))
    w = W.partitionBy("doc_id", "chapter")
    s = c.withColumns({"upto": F.sum("w").over(w.orderBy("ord")), "total": F.sum("w").over(w)})
    return s.filter(F.col("upto") >= F.ceil(F.col("total") * 3 / 4)).groupBy("doc_id", "chapter").agg(F.min("ord").alias("level"))


@R.query("AGG-14 AGG-17", f"WITH {READINGS}, {_WEIGHTED} SELECT doc_id, chapter, {LV}[level] AS level FROM chapters")
def weighted_p75(spark, sf_dir):
    return chapter_levels(readings(spark, sf_dir)).select("doc_id", "chapter", O.level(F.col("level")).alias("level"))


@R.query("AGG-17 LVL-11", f"WITH {READINGS}, {_WEIGHTED}, b AS (SELECT doc_id, quantile_disc(level, 0.75) AS estimate, count(*) = 3 AS complete FROM chapters GROUP BY doc_id) SELECT b.doc_id, complete, coalesce(CASE WHEN l.quality = 1 THEN 'C2' END, CASE WHEN complete THEN {LV}[estimate] END) AS label FROM b LEFT JOIN labels l USING (doc_id)")
def book_level(spark, sf_dir):
    """A complete book's estimate labels it, unless an editor chose."""
    b = chapter_levels(readings(spark, sf_dir)).groupBy("doc_id").agg(F.expr("percentile_disc(0.75) WITHIN GROUP (ORDER BY level)").cast("int").alias("estimate"), (F.count(F.lit(1)) == 3).alias("complete"))
    return b.join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "complete", F.coalesce(F.when(F.col("quality") == 1, "C2"), F.when(F.col("complete"), O.level(F.col("estimate")))).alias("label"))


@R.query("AGG-16", f"WITH {READINGS} SELECT doc_id, round(sum(w * ord) / sum(w), 4) AS archaism FROM readings WHERE judge = 0 GROUP BY doc_id")
def weighted_mean(spark, sf_dir):
    return readings(spark, sf_dir).filter("judge = 0").groupBy("doc_id").agg(F.round(F.sum(F.col("w") * F.col("ord")) / F.sum("w"), 4).alias("archaism"))


@R.query("AGG-12", f"WITH {READINGS}, n AS (SELECT ord, count(*) AS n FROM readings GROUP BY ord) SELECT {LV}[o] AS level, coalesce(n, 0) AS n FROM range(1, 7) l(o) LEFT JOIN n ON n.ord = l.o")
def level_distribution(spark, sf_dir):
    n = readings(spark, sf_dir).groupBy("ord").agg(F.count(F.lit(1)).alias("n"))
    return spark.range(1, 7).withColumnRenamed("id", "o").join(n, F.col("o") == F.col("ord"), "left").select(O.level(F.col("o")).alias("level"), F.coalesce("n", F.lit(0)).alias("n"))


_GATE = """g AS (SELECT doc_id, chapter, max(ord) AS hi, min(ord) AS lo, count(DISTINCT judge) AS judges FROM readings GROUP BY ALL),
f AS (SELECT *, hi > 4 AS above, judges > 1 AND lo <= 4 AND hi = 5 AS split, hi >= 6 AS far FROM g),
e AS (SELECT doc_id, count(*) AS body, count(*) FILTER (above AND NOT split) AS above, count(*) FILTER (split) AS split, count(*) FILTER (far) AS far FROM f GROUP BY doc_id),
h AS (SELECT *, CASE WHEN split > floor(0.10 * body) THEN above + split ELSE above END AS held FROM e)"""


@R.query("LVL-05", f"WITH {READINGS}, {_GATE} SELECT doc_id, body, held, far, held > 0 AND NOT (far = 0 AND held <= floor(0.20 * body)) AS blocked FROM h")
def adaptation_gate(spark, sf_dir, target=4):
    """Chapters above the target hold a book back, unless they are few and none is two levels above; split ones join them if many."""
    g = readings(spark, sf_dir).groupBy("doc_id", "chapter").agg(F.max("ord").alias("hi"), F.min("ord").alias("lo"), F.countDistinct("judge").alias("judges"))
    split = (F.col("judges") > 1) & (F.col("lo") <= target) & (F.col("hi") == target + 1)
    e = g.groupBy("doc_id").agg(F.count(F.lit(1)).alias("body"), F.count_if((F.col("hi") > target) & ~split).alias("above"), F.count_if(split).alias("split"), F.count_if(F.col("hi") >= target + 2).alias("far"))
    h = e.withColumn("held", F.when(F.col("split") > F.floor(F.col("body") / 10), F.col("above") + F.col("split")).otherwise(F.col("above")))
    return h.select("doc_id", "body", "held", "far", ((F.col("held") > 0) & ~((F.col("far") == 0) & (F.col("held") <= F.floor(F.col("body") / 5)))).alias("blocked"))


@R.query("LVL-06", f"WITH {READINGS}, t AS (SELECT DISTINCT doc_id, ord FROM readings WHERE pos = 0 UNION SELECT doc_id, ord FROM readings WHERE pos = 1) SELECT doc_id, CAST(CASE WHEN count(*) = 1 THEN min(ord) END AS DOUBLE) AS target FROM t GROUP BY doc_id")
def target_resolution(spark, sf_dir):
    """The one target that runs and blocks agree on, else null."""
    r = readings(spark, sf_dir)
    t = r.filter("pos = 0").select("doc_id", "ord").union(r.filter("pos = 1").select("doc_id", "ord")).distinct()
    return t.groupBy("doc_id").agg(F.when(F.count(F.lit(1)) == 1, F.min("ord")).cast("double").alias("target"))


@R.query("LVL-08", f"WITH {READINGS}, e AS (SELECT source, ord, max(CASE WHEN judge = 0 THEN 2 WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END) AS evidence FROM readings GROUP BY ALL) SELECT source, min(ord) FILTER (evidence > 0) AS floor FROM e GROUP BY source")
def adaptation_floor(spark, sf_dir):
    """The lowest level a work has reached, published evidence first."""
    rank = F.when(F.col("judge") == 0, 2).when(F.col("doc_id") % 2 == 0, 1).otherwise(0)
    e = readings(spark, sf_dir).groupBy("source", "ord").agg(F.max(rank).alias("evidence"))
    return e.groupBy("source").agg(F.min(F.when(F.col("evidence") > 0, F.col("ord"))).alias("floor"))


@R.query("LVL-09", f"""WITH {READINGS}, r AS (SELECT doc_id, ord, bool_or(judge = 0) AS reached FROM readings GROUP BY ALL), a AS (SELECT d.doc_id, o, coalesce(reached, false) AS reached FROM (SELECT DISTINCT doc_id FROM readings) d CROSS JOIN range(1, 7) l(o) LEFT JOIN r ON r.doc_id = d.doc_id AND r.ord = o)
SELECT doc_id, CAST(o AS INTEGER) AS rung, CASE WHEN reached THEN 'reached' WHEN coalesce(lead(reached) OVER (PARTITION BY doc_id ORDER BY o), true) THEN 'open' ELSE 'closed' END AS state FROM a""")
def ladder_states(spark, sf_dir):
    """A rung opens when the one above it is reached."""
    r = readings(spark, sf_dir).groupBy("doc_id").agg(F.collect_set(F.when(F.col("judge") == 0, F.col("ord"))).alias("got"))
    rungs = r.select("doc_id", "got", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("rung"))
    has = lambda n: F.array_contains("got", n)
    return rungs.select("doc_id", "rung", F.when(has(F.col("rung")), "reached").when((F.col("rung") == 6) | has(F.col("rung") + 1), "open").otherwise("closed").alias("state"))


@R.query("LVL-10", f"WITH {READINGS}, h AS (SELECT doc_id, chapter, count(*) FILTER (ord = 6 AND judge = 2) AS material FROM readings GROUP BY ALL) SELECT doc_id, count(*) AS chapters, count(*) FILTER (material = 0) = count(*) AS faithful FROM h GROUP BY doc_id")
def fidelity_gate(spark, sf_dir):
    h = readings(spark, sf_dir).groupBy("doc_id", "chapter").agg(F.count_if((F.col("ord") == 6) & (F.col("judge") == 2)).alias("material"))
    return h.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chapters"), F.bool_and(F.col("material") == 0).alias("faithful"))


@R.query("AGG-21 LVL-12", """WITH f AS (SELECT doc_id, source, n_chars % 6 + 1 AS expected FROM documents), p AS (SELECT doc_id, quality * 3 + toxic + 1 AS got, CASE WHEN doc_id % 11 = 0 THEN 'failed' ELSE 'ok' END AS status FROM labels)
SELECT source, count(*) AS expected, count(p.doc_id) AS submitted, count(*) FILTER (status = 'failed') AS failed, count(*) - count(p.doc_id) AS missing, count(*) FILTER (status = 'ok' AND got = expected) AS exact,
 count(*) FILTER (status = 'ok' AND abs(got - expected) <= 1) AS within_one, round(avg(abs(got - expected)) FILTER (status = 'ok'), 6) AS mae FROM f LEFT JOIN p USING (doc_id) GROUP BY source""")
def calibration_report(spark, sf_dir):
    """Expected, submitted, failed and missing predictions, exact ones, ones within a level, and the mean error."""
    f = table(spark, sf_dir, "documents").select("doc_id", "source", (F.col("n_chars") % 6 + 1).alias("expected"))
    p = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 3 + F.col("toxic") + 1).alias("got"), F.when(F.col("doc_id") % 11 == 0, "failed").otherwise("ok").alias("status"))
    ok, off = F.col("status") == "ok", F.abs(F.col("got") - F.col("expected"))
    return f.join(p, "doc_id", "left").groupBy("source").agg(
        F.count(F.lit(1)).alias("expected"), F.count("got").alias("submitted"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("got").isNull()).alias("missing"),
        F.count_if(ok & (off == 0)).alias("exact"), F.count_if(ok & (off <= 1)).alias("within_one"), F.round(F.avg(F.when(ok, off)), 6).alias("mae"),
    )


_RANKS = """s AS (SELECT user_id % 8 AS passage, event_type AS judge, user_id % 5 AS writer, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS score FROM events GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY passage, judge ORDER BY score DESC, writer) AS place FROM s)"""


def rankings(spark, sf_dir) -> DataFrame:
    """Writers ranked by each judge on each passage."""
    e = table(spark, sf_dir, "events")
    s = e.groupBy((F.col("user_id") % 8).alias("passage"), F.col("event_type").alias("judge"), (F.col("user_id") % 5).alias("writer")).agg(F.sum(F.col("value").cast("decimal(12,2)")).cast("double").alias("score"))
    return s.withColumn("place", F.row_number().over(W.partitionBy("passage", "judge").orderBy(F.desc("score"), "writer")))


@R.query("AGG-19", f"WITH {_RANKS} SELECT writer, round(avg(place), 6) AS mean_rank, count(*) FILTER (place = 1) AS wins, round(avg(score), 6) AS mean_score, round(avg(place) FILTER (judge = 'view'), 6) AS self_rank, round(avg(place) FILTER (judge <> 'view'), 6) AS others_rank, round(avg(CASE WHEN place = 5 THEN 1 ELSE 0 END), 6) AS flagged FROM k GROUP BY writer")
def rank_table(spark, sf_dir):
    own = F.col("judge") == "view"
    return rankings(spark, sf_dir).groupBy("writer").agg(
        F.round(F.avg("place"), 6).alias("mean_rank"), F.count_if(F.col("place") == 1).alias("wins"), F.round(F.avg("score"), 6).alias("mean_score"),
        F.round(F.avg(F.when(own, F.col("place"))), 6).alias("self_rank"), F.round(F.avg(F.when(~own, F.col("place"))), 6).alias("others_rank"), F.round(F.avg(F.when(F.col("place") == 5, 1).otherwise(0)), 6).alias("flagged"),
    )


@R.query("AGG-20", f"WITH {_RANKS}, b AS (SELECT passage, judge, writer FROM k WHERE place = 1) SELECT x.judge AS judge_a, y.judge AS judge_b, count(*) AS passages, round(avg(CASE WHEN x.writer = y.writer THEN 1 ELSE 0 END), 6) AS agreement FROM b x JOIN b y ON x.passage = y.passage AND x.judge < y.judge GROUP BY ALL")
def judge_agreement(spark, sf_dir):
    """How often two judges call the same writer best, over passages both judged."""
    b = rankings(spark, sf_dir).filter("place = 1").select("passage", "judge", "writer")
    x, y = b.alias("x"), b.alias("y")
    j = x.join(y, (F.col("x.passage") == F.col("y.passage")) & (F.col("x.judge") < F.col("y.judge")))
    return j.groupBy(F.col("x.judge").alias("judge_a"), F.col("y.judge").alias("judge_b")).agg(F.count(F.lit(1)).alias("passages"), F.round(F.avg(F.when(F.col("x.writer") == F.col("y.writer"), 1).otherwise(0)), 6).alias("agreement"))


@R.query("MUT-05", f"WITH {BLOCKS}, old AS (SELECT doc_id, chapter, string_agg(text, ' ' ORDER BY pos) AS t FROM blocks GROUP BY ALL), new AS (SELECT doc_id, chapter, CASE WHEN doc_id % 2 = 0 THEN t ELSE t || ' and' END AS t FROM old) SELECT n.doc_id, n.chapter, sha256(o.t) = sha256(n.t) AS same FROM new n JOIN old o USING (doc_id, chapter)")
def carried_windows(spark, sf_dir):
    """Windows whose text is unchanged keep their answer."""
    b = blocks(spark, sf_dir).groupBy("doc_id", "chapter").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("b"))
    old = b.select("doc_id", "chapter", F.array_join(F.transform("b", lambda x: x["text"]), " ").alias("t"))
    new = old.select("doc_id", "chapter", F.when(F.col("doc_id") % 2 == 0, F.col("t")).otherwise(F.concat("t", F.lit(" and"))).alias("n"))
    return new.join(old, ["doc_id", "chapter"]).select("doc_id", "chapter", (F.sha2("t", 256) == F.sha2("n", 256)).alias("same"))
