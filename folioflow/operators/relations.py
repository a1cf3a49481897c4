"""Joins, gates, pages, sets and rollups over the star schema, which stands for the catalogue's works, editions and notes.

customer = work, orders = editions of a work, lineitem = spans and revisions of an edition, part = titles, nation -> region = lineage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.registry import Registry
from ..session import table
from ..sources.files import unanswered

R = Registry()


@R.query("JOIN-01 JOIN-03", "SELECT c_custkey, c_name, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' AND c_acctbal > 5000")
def foreign_keys(spark, sf_dir):
    """Chained joins to dimensions; they are small enough for the planner to broadcast by their measured size."""
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 5000")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region").filter("r_name <> 'ASIA'")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "c_name", "n_name", "r_name")


@R.query("JOIN-02 AGG-28", "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey) AS editions FROM orders GROUP BY o_custkey")
def prefetch_children(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("e"))
    return g.select("o_custkey", F.array_join(F.transform("e", lambda x: x["o_orderkey"].cast("string")), ",").alias("editions"))


@R.query("JOIN-04", """SELECT c_custkey, coalesce(o.n, 0) AS editions, coalesce(l.n, 0) AS spans FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey AS k, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) l ON k = c_custkey""")
def fan_out_safe(spark, sf_dir):
    """Each child is counted before it is joined, so neither multiplies the other."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")  # noqa: E741
    editions = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("editions"))
    by_order = l.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    spans = o.join(by_order, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("k")).agg(F.sum("n").alias("spans"))
    c = table(spark, sf_dir, "customer").select("c_custkey")
    out = c.join(editions, F.col("c_custkey") == F.col("o_custkey"), "left").join(spans, F.col("c_custkey") == F.col("k"), "left")
    return out.select("c_custkey", F.coalesce("editions", F.lit(0)).alias("editions"), F.coalesce("spans", F.lit(0)).alias("spans"))


@R.query("JOIN-06 SRC-10", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_missing(spark, sf_dir):
    """Work that the log of answers doesn't hold yet: accounts without an order in progress."""
    work, log = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    return unanswered(work, log.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@R.query("JOIN-07", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def stale_publications(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    done, open_ = o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'P'")
    return c.join(done, F.col("c_custkey") == done["o_custkey"], "left_semi").join(open_, F.col("c_custkey") == open_["o_custkey"], "left_anti").select("c_custkey")


_SIDES = "u AS (SELECT conv_id, turn AS seq, text FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn - 1 AS seq, text FROM conversations WHERE role = 'assistant')"


def sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "conversations")
    return (
        c.filter("role = 'user'").select("conv_id", F.col("turn").alias("seq"), F.col("text").alias("primary")),
        c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("seq"), F.col("text").alias("secondary")),
    )


@R.query("JOIN-08 SET-04", f"""WITH {_SIDES}, f AS (SELECT coalesce(u.conv_id, a.conv_id) AS conv_id, coalesce(u.seq, a.seq) AS seq, u.text AS "primary", a.text AS secondary FROM u FULL JOIN a ON u.conv_id = a.conv_id AND u.seq = a.seq),
g AS (SELECT conv_id FROM f GROUP BY conv_id HAVING NOT bool_or(("primary" IS NULL OR secondary IS NULL) AND trim(coalesce("primary", secondary)) <> ''))
SELECT f.conv_id, f.seq, length("primary") AS left_chars, length(secondary) AS right_chars FROM f JOIN g USING (conv_id) WHERE "primary" IS NOT NULL AND secondary IS NOT NULL""")
def inherited_pairs(spark, sf_dir):
    """Pairs of two editions by group; one block with text on one side only empties the edition's result."""
    u, a = sides(spark, sf_dir)
    f = u.join(a, ["conv_id", "seq"], "full")
    one_sided = (F.col("primary").isNull() | F.col("secondary").isNull()) & (F.trim(F.coalesce("primary", "secondary")) != "")
    whole = f.groupBy("conv_id").agg(F.bool_or(one_sided).alias("torn")).filter("not torn").select("conv_id")
    return f.join(whole, "conv_id", "left_semi").filter("primary is not null and secondary is not null").select("conv_id", "seq", F.length("primary").cast("long").alias("left_chars"), F.length("secondary").cast("long").alias("right_chars"))


@R.query("JOIN-09 STR-22 STR-20", f"""WITH {_SIDES} SELECT u.conv_id, u.seq, round(length(a.text) / greatest(1, length(u.text)), 6) AS ratio, length(a.text) / greatest(1, length(u.text)) NOT BETWEEN 0.65 AND 1.5 AS outside,
regexp_replace(lower(u.text), '[^\\p{{L}}\\p{{N}}]+', '', 'g') = regexp_replace(lower(a.text), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS same_letters FROM u JOIN a ON u.conv_id = a.conv_id AND u.seq = a.seq""")
def length_ratio(spark, sf_dir):
    u, a = sides(spark, sf_dir)
    ratio = T.length_ratio(F.col("secondary"), F.col("primary"))
    return u.join(a, ["conv_id", "seq"]).select("conv_id", "seq", F.round(ratio, 6).alias("ratio"), (~ratio.between(0.65, 1.5)).alias("outside"), (T.letters_only(F.col("primary")) == T.letters_only(F.col("secondary"))).alias("same_letters"))


@R.query("JOIN-10 VEC-14 HSH-01", f"""WITH {_SIDES}, h AS (SELECT conv_id, seq, sha256("l" || chr(0) || r) AS pair FROM (SELECT u.conv_id, u.seq, u.text AS l, a.text AS r FROM u JOIN a ON u.conv_id = a.conv_id AND u.seq = a.seq)),
s AS (SELECT pair, min(conv_id) AS first_conv FROM h GROUP BY pair) SELECT h.conv_id, count(*) AS pairs, count(*) FILTER (s.first_conv < h.conv_id) AS reusable FROM h JOIN s USING (pair) GROUP BY h.conv_id""")
def hash_freshness(spark, sf_dir):
    """Pairs whose texts were already answered elsewhere, by the digest of both sides."""
    u, a = sides(spark, sf_dir)
    h = u.join(a, ["conv_id", "seq"]).select("conv_id", F.sha2(F.concat("primary", F.lit("\0"), "secondary"), 256).alias("pair"))
    s = h.groupBy("pair").agg(F.min("conv_id").alias("first_conv"))
    return h.join(s, "pair").groupBy("conv_id").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("first_conv") < F.col("conv_id")).alias("reusable"))


@R.query("JOIN-11", """WITH s AS (SELECT l_orderkey AS k, l_linenumber AS n, CAST(l_quantity AS INTEGER) AS a, CAST(l_quantity + l_discount * 100 AS INTEGER) AS z, l_partkey AS p, l_suppkey AS q FROM lineitem)
SELECT x.k, x.n AS n1, y.n AS n2, x.p AS p1, y.p AS p2 FROM s x JOIN s y ON x.k = y.k AND (x.n, x.p, x.q) < (y.n, y.p, y.q) AND x.a < y.z AND y.a < x.z""")
def range_overlap(spark, sf_dir):
    """Spans of one block that overlap: an equi-join on the block with a condition on the ends."""
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("q")).alias("id"), F.col("l_quantity").cast("int").alias("a"), F.bround(F.col("l_quantity") + F.col("l_discount") * 100).cast("int").alias("z"))
    x, y = s.alias("x"), s.alias("y")
    on = (F.col("x.k") == F.col("y.k")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.a") < F.col("y.z")) & (F.col("y.a") < F.col("x.z"))
    return x.join(y, on).select("x.k", F.col("x.id.n").alias("n1"), F.col("y.id.n").alias("n2"), F.col("x.id.p").alias("p1"), F.col("y.id.p").alias("p2"))


@R.query("JOIN-12 AGG-10", "SELECT source, lang, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS twins FROM documents GROUP BY ALL HAVING count(*) > 1")
def twins(spark, sf_dir):
    """Editions of one work in one language, together."""
    g = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("doc_id")).alias("ids")).filter("n > 1")
    return g.select("source", "lang", "n", F.array_join(F.col("ids").cast("array<string>"), ",").alias("twins"))


@R.query("JOIN-13", "SELECT k, CAST(sum(spent) AS DOUBLE) AS spent FROM (SELECT o_custkey AS k, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS spent FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1 UNION ALL SELECT o_custkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' GROUP BY 1) GROUP BY k")
def alternate_keys(spark, sf_dir):
    """Spending that is found under one key for some works and under another for the rest."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")  # noqa: E741
    a = o.filter("o_orderstatus <> 'P'").groupBy(F.col("o_custkey").alias("k")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("spent"))
    b = l.join(o.filter("o_orderstatus = 'P'"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("k")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("spent"))
    return a.unionByName(b).groupBy("k").agg(F.sum("spent").cast("double").alias("spent"))


@R.query("JOIN-14 ARR-02", "SELECT a.conv_id, a.turn AS source_turn, b.turn AS target_turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.role = 'user' AND b.role = 'assistant'")
def group_members(spark, sf_dir):
    """An aligned group of n and m members as n * m rows, from two arrays of one row."""
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.when(F.col("role") == "user", F.col("turn"))).alias("s"), F.collect_list(F.when(F.col("role") == "assistant", F.col("turn"))).alias("t"))
    return g.select("conv_id", F.explode("s").alias("source_turn"), "t").select("conv_id", "source_turn", F.explode("t").alias("target_turn"))


@R.query("JOIN-17 MUT-12", "SELECT o_orderkey, count(l_orderkey) FILTER (l_shipdate > o_orderdate) AS since, CASE WHEN count(l_orderkey) = 0 THEN 'never' WHEN count(*) FILTER (l_shipdate > o_orderdate) > 0 THEN 'behind' ELSE 'current' END AS state FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def since_counts(spark, sf_dir):
    """Changes after each release, and what state the release is in."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")  # noqa: E741
    g = o.join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderkey").agg(F.count_if(F.col("l_shipdate") > F.col("o_orderdate")).alias("since"), F.count("l_orderkey").alias("n"))
    return g.select("o_orderkey", "since", F.when(F.col("n") == 0, "never").when(F.col("since") > 0, "behind").otherwise("current").alias("state"))


@R.query("JOIN-19", "SELECT l_orderkey AS k, arg_min(l_returnflag, (l_shipdate, l_linenumber, l_partkey, l_suppkey)) <> max(o_orderstatus) AS changed FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > TIMESTAMP '1998-06-01' GROUP BY l_orderkey")
def changed_since(spark, sf_dir):
    """The first revision after a moment holds what was read; it differs from the present or not."""
    l = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") > F.lit("1998-06-01").cast("timestamp_ntz"))  # noqa: E741
    first = l.groupBy("l_orderkey").agg(F.min_by("l_returnflag", F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")).alias("was"))
    return first.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("k"), (F.col("was") != F.col("o_orderstatus")).alias("changed"))


@R.query("JOIN-20", "SELECT e.n_nationkey AS edition, count(*) AS runs FROM nation e JOIN customer r ON r.c_nationkey = e.n_nationkey OR r.c_nationkey = (e.n_nationkey + 1) % 25 GROUP BY 1")
def work_runs(spark, sf_dir):
    """Runs of an edition or of the one made from it: a union of keys, so that no OR is left in the join."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("edition"))
    keys = n.select("edition", F.explode(F.array("edition", (F.col("edition") + 1) % 25)).alias("key")).distinct()
    runs = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return keys.join(runs, F.col("key") == F.col("c_nationkey")).groupBy("edition").agg(F.sum("n").alias("runs"))


@R.query("FLT-09 FLT-10", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'still running' WHEN NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) THEN 'no content'
  WHEN c_acctbal < 0 THEN 'owner over budget' WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') THEN 'open review' END AS reason FROM orders JOIN customer ON o_custkey = c_custkey""")
def gate_reason(spark, sf_dir):
    """The first reason, in order, why an edition cannot be published; null if there is none."""
    facts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("open_review"))
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(facts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    checks = [(F.col("o_orderstatus") == "P", "still running"), (F.col("l_orderkey").isNull(), "no content"), (F.col("c_acctbal") < 0, "owner over budget"), (F.col("open_review"), "open review")]
    return o.select("o_orderkey", F.coalesce(*[F.when(c, why) for c, why in checks]).alias("reason"))


@R.query("FLT-14", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN l_linestatus = 'O' WHEN l_discount > 0.08 THEN true ELSE l_quantity > 40 END AS backed FROM lineitem")
def backed_findings(spark, sf_dir):
    """A ruling decides if there is one, else agreement, else how many raised it."""
    backed = F.coalesce(F.when(F.col("l_returnflag") == "R", F.col("l_linestatus") == "O"), F.when(F.col("l_discount") > 0.08, True), F.col("l_quantity") > 40)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", backed.alias("backed"))


@R.query("FLT-07", """WITH e AS (SELECT o_custkey, bool_or(o_orderpriority ILIKE '%urgent%') AS hit FROM orders GROUP BY 1)
SELECT c_custkey, c_name, NOT contains(lower(c_mktsegment), 'auto') AS through_edition FROM customer LEFT JOIN e ON o_custkey = c_custkey WHERE contains(lower(c_mktsegment), 'auto') OR hit""")
def catalogue_search(spark, sf_dir):
    """Works whose own text matches, or one of whose editions does; and which it was."""
    e = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_or(F.lower("o_orderpriority").contains("urgent")).alias("hit"))
    own = F.lower("c_mktsegment").contains("auto")
    c = table(spark, sf_dir, "customer").join(e, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.filter(own | F.col("hit")).select("c_custkey", "c_name", (~own).alias("through_edition"))


@R.query("FLT-08 AGG-23", """WITH g AS (SELECT o_custkey, bool_or(o_orderstatus = 'P') AS attention, bool_or(o_orderstatus = 'O') AS processing, bool_and(o_orderstatus = 'F') AS final, min(list_position(['P', 'O', 'F'], o_orderstatus)) AS worst, count(*) AS n FROM orders GROUP BY 1)
SELECT count(*) FILTER (attention) AS attention, count(*) FILTER (processing) AS processing, count(*) FILTER (final) AS final, count(*) AS all_works, count(*) FILTER (worst = 1) AS worst_open FROM g""")
def facet_counts(spark, sf_dir):
    s = F.col("o_orderstatus")
    worst = F.min(F.array_position(F.array(F.lit("P"), F.lit("O"), F.lit("F")), s))
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_or(s == "P").alias("attention"), F.bool_or(s == "O").alias("processing"), F.bool_and(s == "F").alias("final"), worst.alias("worst"))
    return g.agg(*[F.count_if(c).alias(c) for c in ("attention", "processing", "final")], F.count(F.lit(1)).alias("all_works"), F.count_if(F.col("worst") == 1).alias("worst_open"))


@R.query("AGG-23 ORD-02", "WITH g AS (SELECT o_custkey, min(list_position(['P', 'O', 'F'], o_orderstatus)) AS w FROM orders GROUP BY 1) SELECT o_custkey, ['P', 'O', 'F'][w] AS worst, (SELECT count(*) FROM orders o WHERE o.o_custkey = g.o_custkey AND o.o_orderstatus = ['P', 'O', 'F'][w]) AS how_many FROM g")
def urgency_rollup(spark, sf_dir):
    """Each work's most urgent status and how many editions have it."""
    order = F.array(F.lit("P"), F.lit("O"), F.lit("F"))
    g = table(spark, sf_dir, "orders").groupBy("o_custkey", F.array_position(order, F.col("o_orderstatus")).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    worst = g.groupBy("o_custkey").agg(F.min(F.struct("w", "n")).alias("s"))
    return worst.select("o_custkey", F.element_at(order, F.col("s.w").cast("int")).alias("worst"), F.col("s.n").alias("how_many"))


@R.query("AGG-24", "WITH t AS (SELECT o_orderkey, unnest(string_split(o_orderpriority, '-')) AS token, o_orderstatus FROM orders) SELECT o_orderstatus AS state, token, count(*) AS n FROM t GROUP BY ALL")
def promotion_rollup(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("state"), F.explode(F.split("o_orderpriority", "-")).alias("token"))
    return t.groupBy("state", "token").agg(F.count(F.lit(1)).alias("n"))


@R.query("FLT-17 MUT-09", """WITH RECURSIVE e AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey = 0 THEN NULL ELSE (n_nationkey - 1) // 2 END AS parent, n_nationkey % 7 <> 6 AS reviewed FROM nation),
w AS (SELECT id, id AS node, parent, reviewed, 0 AS depth FROM e UNION ALL SELECT w.id, e.id, e.parent, e.reviewed, w.depth + 1 FROM w JOIN e ON e.id = w.parent)
SELECT id, max(depth) AS depth, arg_max(node, depth) AS root, bool_and(reviewed) AS exportable FROM w GROUP BY id""")
def lineage_closure(spark, sf_dir, most: int = 50):
    """Each edition's chain of sources up to its root; it may be exported if the whole chain is reviewed. A cycle is an error."""
    k = F.col("n_nationkey")
    e = table(spark, sf_dir, "nation").select(k.alias("id"), F.when(k != 0, F.floor((k - 1) / 2).cast("int")).alias("parent"), (k % 7 != 6).alias("reviewed"))
    e.createOrReplaceTempView("lineage_editions")
    return spark.sql(f"""WITH RECURSIVE w(id, node, parent, reviewed, depth) AS (
      SELECT id, id, parent, reviewed, 0 FROM lineage_editions UNION ALL
      SELECT w.id, e.id, e.parent, e.reviewed, w.depth + 1 FROM w JOIN lineage_editions e ON e.id = w.parent WHERE if(w.depth < {most}, true, raise_error('the lineage has a cycle')))
    SELECT id, max(depth) AS depth, max_by(node, depth) AS root, bool_and(reviewed) AS exportable FROM w GROUP BY id""")


@R.query("ORD-06", "SELECT c_custkey, lower(regexp_extract(trim(c_name), '([^#]+)$', 1)) AS surname FROM customer ORDER BY surname, c_custkey")
def surname_sort(spark, sf_dir):
    s = F.lower(F.element_at(F.split(F.trim("c_name"), "#"), -1))
    return table(spark, sf_dir, "customer").select("c_custkey", s.alias("surname")).orderBy("surname", "c_custkey")


@R.query("SET-02 SET-03", "SELECT k, 'both' AS side FROM (SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N') UNION ALL SELECT k, 'first' FROM (SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N') UNION ALL SELECT k, 'second' FROM (SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'N' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def set_sides(spark, sf_dir):
    """Keys of two sets by the side they are on: one grouped pass instead of three set operations."""
    l = table(spark, sf_dir, "lineitem").filter("l_returnflag in ('R', 'N')")  # noqa: E741
    g = l.groupBy(F.col("l_partkey").alias("k")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("a"), F.bool_or(F.col("l_returnflag") == "N").alias("b"))
    return g.select("k", F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "first").otherwise("second").alias("side"))


@R.query("SET-05 EXT-02", """WITH a AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p FROM lineitem WHERE l_returnflag = 'R'),
x AS (SELECT k, n, min(p) AS p FROM a GROUP BY ALL), y AS (SELECT k, n, min(p) AS p FROM b GROUP BY ALL)
SELECT coalesce(x.k, y.k) AS k, coalesce(x.n, y.n) AS n, CASE WHEN x.k IS NULL THEN 0.4 WHEN y.k IS NULL THEN 0.6 ELSE 0.9 END::DOUBLE AS confidence, greatest(x.p, y.p) AS stricter FROM x FULL JOIN y ON x.k = y.k AND x.n = y.n""")
def merged_findings(spark, sf_dir):
    """Two reviewers' findings: both 0.9, the outside one alone 0.6, the author's alone 0.4; the stricter severity holds."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    one = lambda flag, name: l.filter(F.col("l_returnflag") == flag).groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias(name))
    f = one("A", "p1").join(one("R", "p2"), ["k", "n"], "full")
    c = F.when(F.col("p1").isNull(), 0.4).when(F.col("p2").isNull(), 0.6).otherwise(0.9)
    return f.select("k", "n", c.alias("confidence"), F.greatest("p1", "p2").alias("stricter"))


@R.query("SRC-12 SET-05", """WITH stored AS (SELECT doc_id AS id, quality AS v FROM labels), fresh AS (SELECT doc_id AS id, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS v FROM documents WHERE lang <> 'fr')
SELECT coalesce(f.id, s.id) AS id, coalesce(f.v, s.v) AS v, CASE WHEN s.id IS NULL THEN 'inserted' WHEN f.id IS NULL THEN 'stale' WHEN s.v = f.v THEN 'equal' ELSE 'updated' END AS action FROM stored s FULL JOIN fresh f ON s.id = f.id""")
def upsert_merge(spark, sf_dir):
    """Stored rows against a bundle's: inserted, updated, equal (skipped) or stale."""
    stored = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("s"))
    fresh = table(spark, sf_dir, "documents").filter("lang <> 'fr'").select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "en", 1).otherwise(0).alias("f"))
    action = F.when(F.col("s").isNull(), "inserted").when(F.col("f").isNull(), "stale").when(F.col("s") == F.col("f"), "equal").otherwise("updated")
    return stored.join(fresh, "id", "full").select("id", F.coalesce("f", "s").alias("v"), action.alias("action"))


@R.query("MUT-10", "SELECT d.doc_id, coalesce(CASE WHEN l.toxic = 1 THEN 'user' END, CASE WHEN l.quality = 1 THEN 'model' END, 'file') AS provenance, coalesce(CASE WHEN l.toxic = 1 THEN 'x' || lang END, CASE WHEN l.quality = 1 THEN lang END, source) AS value FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def metadata_priority(spark, sf_dir):
    """A typed value wins over a proposed one, that over the file's; and which it was."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    typed, proposed = F.col("toxic") == 1, F.col("quality") == 1
    pick = lambda a, b, c: F.coalesce(F.when(typed, a), F.when(proposed, b), c)
    return d.select("doc_id", pick(F.lit("user"), F.lit("model"), F.lit("file")).alias("provenance"), pick(F.concat(F.lit("x"), "lang"), F.col("lang"), F.col("source")).alias("value"))


@R.query("MUT-03 MUT-04 STR-12", """WITH r AS (SELECT conv_id, count(*) AS n, arg_max(turn, turn) AS turn FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
SELECT c.conv_id, c.turn, CASE WHEN r.n = 1 AND substr(c.text, 1, 3) <> '' THEN 'The' || substr(c.text, 4) ELSE c.text END AS text FROM conversations c LEFT JOIN r ON r.conv_id = c.conv_id AND r.turn = c.turn""")
def bulk_apply(spark, sf_dir):
    """Replacements are applied to blocks that have exactly one and whose span still reads the same."""
    c = table(spark, sf_dir, "conversations")
    r = c.filter("role = 'assistant'").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max("turn").alias("turn"))
    out = c.join(r, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", F.when((F.col("n") == 1) & (F.substring("text", 1, 3) != ""), F.overlay("text", F.lit("The"), 1, 3)).otherwise(F.col("text")).alias("text"))


@R.query("MUT-06", "SELECT c_custkey, CASE WHEN strpos(c_name, '00012') > 0 THEN CAST(strpos(c_name, '00012') - 1 AS DOUBLE) END AS start FROM customer")
def relocate_findings(spark, sf_dir):
    """Where a quote now stands, or null."""
    at = F.instr("c_name", F.lit("00012"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(at > 0, at - 1).cast("double").alias("start"))


@R.query("MUT-08", "SELECT o_orderkey AS id, 'tombstone' AS kind FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, 'edition' FROM orders WHERE o_orderstatus <> 'P'")
def purge_to_tombstones(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "tombstone").otherwise("edition").alias("kind"))


@R.query("MUT-11", "WITH n AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS runs, min(l_suppkey) AS only_run FROM lineitem GROUP BY 1) SELECT l_orderkey, l_linenumber, l_partkey, CAST(coalesce(CASE WHEN l_discount > 0 THEN l_suppkey END, CASE WHEN runs = 1 THEN only_run END) AS DOUBLE) AS run FROM lineitem JOIN n USING (l_orderkey)")
def passage_provenance(spark, sf_dir):
    """The run that is linked to a block, else the edition's only run."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    n = l.groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("runs"), F.min("l_suppkey").alias("only_run"))
    return l.join(n, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce(F.when(F.col("l_discount") > 0, F.col("l_suppkey")), F.when(F.col("runs") == 1, F.col("only_run"))).cast("double").alias("run"))


@R.query("ARR-05 WIN-06", """WITH o AS (SELECT l_orderkey, list({a: l_quantity::INT, z: (l_quantity + 8)::INT, stop: 0, kept: []::STRUCT(a INT, z INT)[]} ORDER BY l_quantity) AS s FROM lineitem GROUP BY 1),
k AS (SELECT l_orderkey, list_reduce(list_prepend({a: 0, z: 0, stop: -1, kept: []::STRUCT(a INT, z INT)[]}, s), lambda k, x: {a: x.a, z: x.z, stop: CASE WHEN x.a >= k.stop THEN x.z ELSE k.stop END, kept: CASE WHEN x.a >= k.stop THEN list_append(k.kept, {a: x.a, z: x.z}) ELSE k.kept END}).kept AS kept FROM o)
SELECT l_orderkey, x.a AS a, x.z AS z FROM (SELECT l_orderkey, unnest(kept) AS x FROM k)""")
def span_select(spark, sf_dir):
    """Spans kept in order when they start at or after the end of the last kept one: a fold over each block's sorted spans."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_quantity").cast("int").alias("a"), (F.col("l_quantity") + 8).cast("int").alias("z")))).alias("s"))  # noqa: E741
    fold = F.expr("aggregate(s, named_struct('stop', -1, 'out', cast(array() as array<struct<a:int,z:int>>)), (k, x) -> if(x.a >= k.stop, named_struct('stop', x.z, 'out', array_append(k.out, x)), k), k -> k.out)")
    return l.select("l_orderkey", F.inline(fold))


def segments(text: Column, spans: Column) -> Column:
    """A text's pieces for kept spans."""
    return F.transform(spans, lambda s: T.span(text, s["a"], s["z"]))


@R.query("ARR-04", "SELECT p_partkey, i, i * p_size // 4 AS start, (i + 1) * p_size // 4 AS stop FROM part, range(4) t(i) WHERE p_size >= 4")
def proportional_slices(spark, sf_dir, k=4):
    """n items in k consecutive slices of about equal size."""
    cut = lambda i: F.floor(i * F.col("p_size") / k)
    slices = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.struct(i.cast("long").alias("i"), cut(i).alias("start"), cut(i + 1).alias("stop")))
    return table(spark, sf_dir, "part").filter("p_size >= 4").select("p_partkey", F.inline(slices))


SMALL = ("of", "the", "and", "in", "a")


@R.query("STR-01 STR-03", "SELECT p_partkey, CASE WHEN t = upper(t) AND t <> lower(t) THEN array_to_string([CASE WHEN i > 1 AND w[i] IN ('of', 'the', 'and', 'in', 'a') THEN w[i] ELSE upper(left(w[i], 1)) || substr(w[i], 2) END for i in range(1, len(w) + 1)], ' ') ELSE t END AS calm, CASE WHEN strpos(s, '. ') > 1 AND length(s) > strpos(s, '. ') + 1 THEN left(s, strpos(s, '. ') - 1) ELSE s END AS short FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS t, string_split(lower(p_name), ' ') AS w, p_name || '. ' || p_type AS s FROM part)")
def calm_titles(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("t"), F.concat("p_name", F.lit(". "), "p_type").alias("s"))
    return p.select("p_partkey", T.calm_title(F.col("t"), SMALL).alias("calm"), T.short_title(F.col("s")).alias("short"))


ALIASES = {"iw": "he", "sh": "hr", "nb": "no"}


@R.query("STR-04 STR-23", "SELECT doc_id, CASE split_part(replace(lower(trim(code)), '_', '-'), '-', 1) WHEN 'iw' THEN 'he' WHEN 'sh' THEN 'hr' WHEN 'nb' THEN 'no' ELSE split_part(replace(lower(trim(code)), '_', '-'), '-', 1) END AS code, regexp_replace('model-' || doc_id % 9 || '-' || doc_id % 4, '-([0-9]+)-([0-9]+)', '-\\1.\\2') AS version FROM (SELECT doc_id, ' ' || CASE WHEN doc_id % 5 = 0 THEN 'iw' ELSE upper(lang) END || '_XX ' AS code FROM documents)")
def language_codes(spark, sf_dir):
    code = F.concat(F.lit(" "), F.when(F.col("doc_id") % 5 == 0, "iw").otherwise(F.upper("lang")), F.lit("_XX "))
    primary = F.split_part(F.replace(F.lower(F.trim(code)), F.lit("_"), F.lit("-")), F.lit("-"), F.lit(1))
    known = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    version = F.regexp_replace(F.concat(F.lit("model-"), (F.col("doc_id") % 9).cast("string"), F.lit("-"), (F.col("doc_id") % 4).cast("string")), "-(\\d+)-(\\d+)", "-$1.$2")
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.try_element_at(known, primary), primary).alias("code"), version.alias("version"))


@R.query("STR-05 STR-07 STR-17 STR-19", r"""SELECT item_id, CASE WHEN greatest(20 - 9, 0) > 0 THEN '…' ELSE '' END || trim(regexp_replace(substr(text, 12, 40 + 9 - 11), '[ \t\n\x0B\f\r]+', ' ', 'g')) || CASE WHEN least(49, length(text)) < length(text) THEN '…' ELSE '' END AS context,
 array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ') AS term,
 regexp_replace(lower(trim(regexp_replace(translate(text, '“”„«»‘’—', repeat(chr(34), 5) || repeat(chr(39), 2) || '-'), '[ \t\n\x0B\f\r]+', ' ', 'g'))), '^["'' ]+|["'' .,;:!?]+$', '', 'g') AS quote,
 round(length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) / length(regexp_replace(text, '[^\p{L}]', '', 'g')), 6) AS capitals FROM benchmark""")
def text_scalars(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "benchmark").select("item_id", T.context(t, F.lit(20), F.lit(40), 9).alias("context"), T.term_key(t).alias("term"), T.normal_quote(t).alias("quote"), F.round(T.capitals_share(t), 6).alias("capitals"))


@R.query("STR-14 STR-15 STR-21", """SELECT p_partkey, regexp_matches(replace(p_name, ' ', '-'), '^[a-z0-9]+(-[a-z0-9]+)*$') AS valid, replace(p_name, ' ', '-') || CASE WHEN row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1 THEN '' ELSE '-' || row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) END AS slug,
 starts_with(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', '', 'g'), 'redw') AS same_title FROM part""")
def slugs(spark, sf_dir):
    """Slugs, unique by a counter for each base."""
    base = F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))
    n = F.row_number().over(W.partitionBy("p_name").orderBy("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", base.rlike("^[a-z0-9]+(-[a-z0-9]+)*$").alias("valid"), F.concat(base, F.when(n == 1, "").otherwise(F.concat(F.lit("-"), n.cast("string")))).alias("slug"), T.letters_only(F.col("p_name")).startswith("redw").alias("same_title"))


@R.query("SRC-04 STR-24", "SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/:?#]+)', 1) AS host, starts_with(url, 'https://') AND regexp_matches(url, '://[^/:?#]*example[.]com/') AND NOT contains(url, '?') AS allowed FROM pages")
def url_predicate(spark, sf_dir):
    u = F.col("url")
    ok = (F.parse_url(u, F.lit("PROTOCOL")) == "https") & F.parse_url(u, F.lit("HOST")).endswith("example.com") & F.parse_url(u, F.lit("QUERY")).isNull()
    return table(spark, sf_dir, "pages").select("page_id", F.parse_url(u, F.lit("PROTOCOL")).alias("scheme"), F.parse_url(u, F.lit("HOST")).alias("host"), ok.alias("allowed"))


@R.query("DT-02 DT-04", "SELECT o_orderkey, CAST(CAST(o_orderdate + INTERVAL 1 month AS DATE) AS VARCHAR) AS next_month, CAST(CAST(date_trunc('month', o_orderdate) + INTERVAL 1 month AS DATE) AS VARCHAR) AS month_end, CAST(CAST(date_trunc('week', o_orderdate) AS DATE) AS VARCHAR) AS monday, o_orderpriority ~ '^[0-9]{4}-' AS dated FROM orders")
def month_arithmetic(spark, sf_dir):
    d = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.add_months(d, 1).cast("string").alias("next_month"), F.date_add(F.last_day(d), 1).cast("string").alias("month_end"), F.to_date(F.date_trunc("week", "o_orderdate")).cast("string").alias("monday"), F.col("o_orderpriority").rlike("^[0-9]{4}-").alias("dated"))


@R.query("PRJ-02 PRJ-03", "SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'in progress' WHEN 'F' THEN 'final' ELSE 'open' END AS status_label, right(o_orderpriority, length(o_orderpriority) - 2) AS short_label FROM orders")
def label_columns(spark, sf_dir):
    keys = ["o_orderkey", "status_label", "short_label"]
    label = F.when(F.col("o_orderstatus") == "P", "in progress").when(F.col("o_orderstatus") == "F", "final").otherwise("open")
    return table(spark, sf_dir, "orders").withColumns({"status_label": label, "short_label": F.expr("substring(o_orderpriority, 3)")}).select(*keys)
