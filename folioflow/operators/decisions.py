"""Ordered decisions over joined facts: what a work's page offers next, why a chapter can't be applied, whether an edition is faithful, what identifies a specification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import editing as E
from ..plans.registry import Registry
from ..session import table
from .relations import merged_findings

R = Registry()


def first_reason(checks: list[tuple[Column, Column | str]]) -> Column:
    """What the first check that holds says; a check that is null does not hold."""
    return F.coalesce(*[F.when(c, F.lit(why) if isinstance(why, str) else why) for c, why in checks])


def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as editions with a status, and what their lines and owners say about them."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.bool_or((F.col("l_linenumber") == 7) & (F.col("l_tax") > 0.07)).alias("active"), F.count_if(F.col("l_returnflag") == "R").alias("open_items"), F.count_if(F.col("l_discount") > 0.08).alias("above"), F.bool_or(F.col("l_tax") > 0.075).alias("pending")
    )
    status = F.when(F.col("o_orderpriority") == "5-LOW", "failed").when(F.col("o_orderstatus") == "P", "processing").when(F.col("o_orderstatus") == "F", "review").when(F.col("o_orderpriority") == "1-URGENT", "published").otherwise("ready")
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("edition"), status.alias("status"), "active", F.coalesce("open_items", F.lit(0)).alias("open_items"), F.coalesce("above", F.lit(0)).alias("above"), "pending",
        (F.col("c_acctbal") < 0).alias("private"), (F.col("c_mktsegment") == "MACHINERY").alias("blocked"), (F.col("o_totalprice") > 300000).alias("stale"),
    )


@R.query("FLT-15", """WITH l AS (SELECT l_orderkey, bool_or(l_linenumber = 7 AND l_tax > 0.07) AS active, count(*) FILTER (l_returnflag = 'R') AS open_items, count(*) FILTER (l_discount > 0.08) AS above, bool_or(l_tax > 0.075) AS pending FROM lineitem GROUP BY 1),
f AS (SELECT o_orderkey AS edition, CASE WHEN o_orderpriority = '5-LOW' THEN 'failed' WHEN o_orderstatus = 'P' THEN 'processing' WHEN o_orderstatus = 'F' THEN 'review' WHEN o_orderpriority = '1-URGENT' THEN 'published' ELSE 'ready' END AS status, active, coalesce(open_items, 0) AS open_items, coalesce(above, 0) AS above, pending, c_acctbal < 0 AS private, c_mktsegment = 'MACHINERY' AS blocked, o_totalprice > 300000 AS stale
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN l ON o_orderkey = l_orderkey)
SELECT edition, CASE WHEN active THEN 'running: a job is under way' WHEN status = 'failed' THEN 'retry: processing failed' WHEN status = 'processing' THEN 'wait: processing is not finished'
 WHEN status = 'review' AND open_items > 0 THEN CASE WHEN private THEN 'repair: ' ELSE 'resolve: ' END || open_items || CASE WHEN open_items = 1 THEN ' review item' ELSE ' review items' END
 WHEN status = 'review' AND private THEN 'repair: make it available' WHEN status = 'review' AND above > 1 THEN 'gate: ' || above || ' chapters above the level' WHEN status = 'review' THEN 'approve: nothing is open'
 WHEN private THEN 'available: to its owner' WHEN status = 'ready' AND blocked THEN 'publish: blocked' WHEN status = 'ready' AND pending THEN 'wait: publication is running' WHEN status = 'ready' THEN 'publish: it is ready'
 WHEN stale AND pending THEN 'wait: the update is running' WHEN stale THEN 'update: the text has changed' ELSE 'published: nothing to do' END AS step FROM f""")
def next_step(spark, sf_dir):
    """The one thing an edition's page offers next: the first state that holds, with its text."""
    f = page_facts(spark, sf_dir)
    review, ready, many = F.col("status") == "review", F.col("status") == "ready", F.col("open_items") > 0
    items = F.concat(F.col("open_items").cast("string"), F.when(F.col("open_items") == 1, " review item").otherwise(" review items"))
    steps: list[tuple[Column, Column | str]] = [
        (F.col("active"), "running: a job is under way"),
        (F.col("status") == "failed", "retry: processing failed"),
        (F.col("status") == "processing", "wait: processing is not finished"),
        (review & many, F.concat(F.when(F.col("private"), "repair: ").otherwise("resolve: "), items)),
        (review & F.col("private"), "repair: make it available"),
        (review & (F.col("above") > 1), F.concat(F.lit("gate: "), F.col("above").cast("string"), F.lit(" chapters above the level"))),
        (review, "approve: nothing is open"),
        (F.col("private"), "available: to its owner"),
        (ready & F.col("blocked"), "publish: blocked"),
        (ready & F.col("pending"), "wait: publication is running"),
        (ready, "publish: it is ready"),
        (F.col("stale") & F.col("pending"), "wait: the update is running"),
        (F.col("stale"), "update: the text has changed"),
        (F.lit(True), "published: nothing to do"),
    ]
    return f.select("edition", first_reason(steps).alias("step"))


_APPLY = [
    ("trim(coalesce(notes, '')) = ''", "no review is recorded"), ("run_status <> 'succeeded'", "the pilot is not complete"), ("NOT whole", "only whole chapters can be replaced"), ("target NOT IN ('B1', 'B2')", "the pilot must ask for B1 or B2"),
    ("source <> target_source", "the edition is not made from this source"), ("published", "the edition is published"), ("busy", "the edition's jobs are not finished"), ("revision <> expected", "the chapter has changed"),
    ("source_hash <> pilot_hash", "the source has changed"), ("level > target", "the pilot reads above its target"),
]
_PILOTS = """SELECT l_orderkey AS edition, l_linenumber AS chapter, CASE WHEN l_quantity < 3 THEN ' ' ELSE 'read' END AS notes, CASE WHEN l_returnflag = 'R' AND l_discount > 0.08 THEN 'failed' ELSE 'succeeded' END AS run_status, l_tax < 0.075 AS whole,
  CASE WHEN l_linenumber = 6 THEN 'C1' WHEN l_linenumber % 2 = 0 THEN 'B1' ELSE 'B2' END AS target, l_suppkey % 11 AS source, CASE WHEN l_partkey % 17 = 0 THEN l_suppkey % 7 ELSE l_suppkey % 11 END AS target_source, o_orderpriority = '1-URGENT' AS published, o_orderstatus = 'P' AS busy,
  l_partkey % 13 AS revision, CASE WHEN l_suppkey % 9 = 0 THEN l_partkey % 12 ELSE l_partkey % 13 END AS expected, l_partkey % 19 AS source_hash, CASE WHEN l_quantity > 45 THEN l_partkey % 18 ELSE l_partkey % 19 END AS pilot_hash, CASE WHEN l_discount > 0.06 THEN 'B2' ELSE 'B1' END AS level FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


@R.query("FLT-16", f"WITH p AS ({_PILOTS}) SELECT edition, chapter, coalesce({', '.join(f'CASE WHEN {c} THEN {chr(39)}{why.replace(chr(39), chr(39) * 2)}{chr(39)} END' for c, why in _APPLY)}, 'can be applied') AS reason FROM p")
def apply_reason(spark, sf_dir):
    """The first precondition that keeps a pilot's chapter from being applied: review, run, extent, target, lineage, state, hashes, level."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")  # noqa: E741
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    columns = _PILOTS.removeprefix("SELECT ").rsplit(" FROM ", 1)[0]
    pilots = j.selectExpr(*_top_level(columns))
    return pilots.select("edition", "chapter", first_reason([(F.expr(c), why) for c, why in _APPLY] + [(F.lit(True), "can be applied")]).alias("reason"))


def _top_level(columns: str) -> list[str]:
    """A select list's columns; commas in brackets part nothing."""
    out, depth = [""], 0
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


_MERGED = """f AS (SELECT l_orderkey AS k, l_linenumber AS n, min(l_partkey) FILTER (l_returnflag = 'A') AS p1, min(l_partkey) FILTER (l_returnflag = 'R') AS p2 FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2)"""


@R.query("LVL-07", f"""WITH {_MERGED}, m AS (SELECT k, count(*) FILTER (greatest(coalesce(p1, p2), coalesce(p2, p1)) % 5 = 0) AS material FROM f GROUP BY k),
b AS (SELECT l_orderkey AS edition, count(*) AS blocks FROM lineitem GROUP BY 1) SELECT edition, blocks, coalesce(material, 0) AS material, coalesce(material, 0) * 10 <= blocks AS faithful FROM b LEFT JOIN m ON k = edition""")
def faithful_editions(spark, sf_dir):
    """An edition is faithful when its material findings, of two reviewers' merged ones, are a tenth of its blocks at most."""
    material = merged_findings(spark, sf_dir).groupBy("k").agg(F.count_if(F.col("stricter") % 5 == 0).alias("material"))
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("edition")).agg(F.count(F.lit(1)).alias("blocks"))
    m = F.coalesce("material", F.lit(0))
    return b.join(material, F.col("k") == F.col("edition"), "left").select("edition", "blocks", m.alias("material"), (m * 10 <= F.col("blocks")).alias("faithful"))


@R.query("JSN-02 HSH-02", """WITH s AS (SELECT user_id, '{"kind":"' || event_type || '","limits":{"k":' || json_extract_string(props, '$.k') || '}}' AS spec, value FROM events)
SELECT user_id, sha256(spec) AS identity, count(*) AS n, count(DISTINCT value) AS prices FROM s GROUP BY ALL""")
def spec_identities(spark, sf_dir):
    """Specifications with their prices: the identity is the digest of canonical JSON, whatever the order of keys, and without prices at any depth."""
    k = F.get_json_object("props", "$.k")
    spec = F.concat(F.lit('{"pricing_per_million": {"input": '), F.col("value"), F.lit('}, "limits": {"pricing_per_million": 1, "k": '), k, F.lit('}, "kind": "'), F.col("event_type"), F.lit('"}'))
    identity = E.column(lambda text: E.spec_identity(E.json.loads(text)), "string")
    e = table(spark, sf_dir, "events").select("user_id", "value", identity(spec).alias("identity"))
    return e.groupBy("user_id", "identity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("prices"))


@R.query("STR-06 STR-11")
def edited_spans(spark, sf_dir):
    """A span of each long turn, the sentence around it, and what a replacement that repeats its neighbours grows to."""
    c = table(spark, sf_dir, "conversations").filter("length(text) > 60")
    bounds = E.column(lambda t: list(E.sentence_bounds(t, 20, 40)), "array<int>")
    around = lambda t: f"{' '.join(t[:20].split()[-1:])} new words {' '.join(t[40:].split()[:1])}"
    grown = E.column(lambda t: [dict(zip(("start", "stop", "new"), E.replacement_span(t, 20, 40, around(t)), strict=True))], "array<struct<start:int,stop:int,new:string>>")
    out = c.select("conv_id", "turn", bounds("text").alias("b"), grown("text")[0].alias("g"))
    return out.select("conv_id", "turn", F.col("b")[0].alias("first"), F.col("b")[1].alias("last"), "g.*")
