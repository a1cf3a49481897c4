"""Queries over the call ledger: spending, budgets, meters, retries, pages of calls.

`events` is the ledger: a call has a time, an account, a purpose, a model key inside its JSON and a cost; errors are failed
calls. Costs are decimals, so sums don't depend on order. "Now" is always an argument.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import money, time
from ..plans.registry import Registry
from ..session import table

R = Registry()
NOW = "2024-01-31 00:00:00"
PROVIDERS = ("click", "purchase", "signup", "view")

#: The ledger in SQL, for the statements below.
LEDGER = """ledger AS (
  SELECT event_id AS call_id, ts, CAST(ts AS DATE) AS day, user_id AS account, event_type AS purpose,
         CAST(json_extract(props, '$.k') AS INTEGER) AS model, CAST(value AS DECIMAL(12,6)) AS cost, event_type <> 'error' AS ok
  FROM events)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("call_id"), "ts", F.col("user_id").alias("account"), F.col("event_type").alias("purpose"),
        F.get_json_object("props", "$.k").cast("int").alias("model"), F.col("value").cast("decimal(12,6)").alias("cost"), (F.col("event_type") != "error").alias("ok"),
    )


def usd(c: Column) -> Column:
    return F.coalesce(c, F.lit(0)).cast("double")


def between(df: DataFrame, since: str, until: str) -> DataFrame:
    """Half-open, so that neighbouring reports share no row; reaches the scan."""
    return df.filter((F.col("ts") >= F.lit(since).cast("timestamp_ntz")) & (F.col("ts") < F.lit(until).cast("timestamp_ntz")))


@R.query("FLT-01 AGG-01 JSN-01 SRC-05 SRC-06 PRJ-01 ORD-01", f"""
WITH {LEDGER} SELECT purpose, model, count(*) AS calls, count(*) FILTER (NOT ok) AS failed, count(DISTINCT account) AS accounts,
  CAST(sum(cost) AS DOUBLE) AS usd, CAST(min(cost) AS DOUBLE) AS least, CAST(max(cost) AS DOUBLE) AS most
FROM ledger WHERE ts >= '2024-01-05' AND ts < '2024-01-20' GROUP BY purpose, model ORDER BY usd DESC, purpose, model""")
def spend_lines(spark, sf_dir):
    calls = between(ledger(spark, sf_dir), "2024-01-05", "2024-01-20")
    return calls.groupBy("purpose", "model").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("ok")).alias("failed"), F.countDistinct("account").alias("accounts"),
        usd(F.sum("cost")).alias("usd"), F.min("cost").cast("double").alias("least"), F.max("cost").cast("double").alias("most"),
    ).orderBy(F.desc("usd"), "purpose", "model")


@R.query("AGG-02", f"WITH {LEDGER} SELECT count(*) AS calls, CAST(coalesce(sum(cost), 0) AS DOUBLE) AS usd FROM ledger WHERE purpose = 'no such purpose'")
def totals_of_nothing(spark, sf_dir):
    return ledger(spark, sf_dir).filter(F.col("purpose") == "no such purpose").agg(F.count(F.lit(1)).alias("calls"), usd(F.sum("cost")).alias("usd"))


@R.query("AGG-03 AGG-04 AGG-05 AGG-27", f"""
WITH {LEDGER} SELECT account, count(*) AS calls, count(*) FILTER (NOT ok) AS failed, count(DISTINCT model) AS models, max(ts) AS latest,
  bool_and(ok) AS all_ok, bool_or(cost > 200) AS any_dear FROM ledger GROUP BY account""")
def account_counts(spark, sf_dir):
    return ledger(spark, sf_dir).groupBy("account").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("ok")).alias("failed"), F.countDistinct("model").alias("models"), F.max("ts").alias("latest"),
        F.bool_and("ok").alias("all_ok"), F.bool_or(F.col("cost") > 200).alias("any_dear"),
    )


def buckets(spark: SparkSession, period: str, count: int, now: str = NOW) -> DataFrame:
    """The last `count` calendar buckets up to now, oldest first."""
    last = time.floor(F.lit(now).cast("timestamp"), period)
    return spark.range(count).select(time.step(last, period, 0).alias("last"), "id").select(
        (F.add_months("last", -F.col("id").cast("int")) if period == "month" else F.date_sub("last", (F.col("id") * (7 if period == "week" else 1)).cast("int"))).alias("bucket")
    )


def spend_by(spark: SparkSession, sf_dir: str, period: str, count: int) -> DataFrame:
    """Dense buckets by provider, zero-filled; calls of other providers are left out."""
    spine = buckets(spark, period, count)
    calls = ledger(spark, sf_dir).filter(F.col("purpose").isin(*PROVIDERS)).withColumn("bucket", time.floor(F.col("ts"), period))
    wide = calls.groupBy("bucket").pivot("purpose", list(PROVIDERS)).agg(F.sum("cost"))
    return spine.join(wide, "bucket", "left").select(F.col("bucket").cast("string").alias("bucket"), *[usd(F.col(p)).alias(p) for p in PROVIDERS])


def _bucket_sql(period: str, count: int) -> str:
    sums = ", ".join(f"CAST(coalesce(sum(cost) FILTER (purpose = '{p}'), 0) AS DOUBLE) AS {p}" for p in PROVIDERS)
    return f"""WITH {LEDGER}, spine AS (
  SELECT CAST(date_trunc('{period}', TIMESTAMP '{NOW}') - i * INTERVAL 1 {period} AS DATE) AS bucket FROM range({count}) t(i))
SELECT CAST(spine.bucket AS VARCHAR) AS bucket, {sums} FROM spine LEFT JOIN ledger ON CAST(date_trunc('{period}', ts) AS DATE) = spine.bucket GROUP BY spine.bucket"""


@R.query("AGG-06 DT-01 DT-02", _bucket_sql("day", 30))
def spend_by_day(spark, sf_dir):
    return spend_by(spark, sf_dir, "day", 30)


@R.query("AGG-06 DT-01", _bucket_sql("week", 12))
def spend_by_week(spark, sf_dir):
    return spend_by(spark, sf_dir, "week", 12)


@R.query("AGG-06 DT-01", _bucket_sql("month", 12))
def spend_by_month(spark, sf_dir):
    return spend_by(spark, sf_dir, "month", 12)


@R.query("AGG-07", f"""WITH {LEDGER} SELECT span, count(*) AS calls, CAST(sum(cost) AS DOUBLE) AS usd
FROM ledger JOIN (VALUES ('today', TIMESTAMP '2024-01-30'), ('week', TIMESTAMP '2024-01-29'), ('month', TIMESTAMP '2024-01-01'), ('all', TIMESTAMP '1970-01-01')) s(span, since) ON ts >= since
GROUP BY span""")
def spend_spans(spark, sf_dir):
    """Today, this week, this month and everything in one pass over the ledger."""
    now = F.lit("2024-01-30 12:00:00").cast("timestamp")
    spans = {"today": time.floor(now, "day"), "week": time.floor(now, "week"), "month": time.floor(now, "month"), "all": F.lit("1970-01-01").cast("date")}
    inside = {k: F.col("ts") >= v.cast("timestamp_ntz") for k, v in spans.items()}
    one = ledger(spark, sf_dir).agg(*[F.struct(F.count_if(c).alias("calls"), usd(F.sum(F.when(c, F.col("cost")))).alias("usd")).alias(k) for k, c in inside.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("span"), F.col(f"{k}.calls").alias("calls"), F.col(f"{k}.usd").alias("usd")) for k in spans])))


@R.query("AGG-08 ORD-02", f"""WITH {LEDGER} SELECT purpose IN ('purchase', 'signup') AS metered, purpose, model, CAST(sum(cost) AS DOUBLE) AS usd
FROM ledger GROUP BY ALL ORDER BY metered DESC, usd DESC, purpose, model""")
def spend_breakdown(spark, sf_dir):
    lines = ledger(spark, sf_dir).groupBy(F.col("purpose").isin("purchase", "signup").alias("metered"), "purpose", "model").agg(usd(F.sum("cost")).alias("usd"))
    return lines.orderBy(F.desc("metered"), F.desc("usd"), "purpose", "model")


def attempts(calls: DataFrame) -> DataFrame:
    """Each call's place in its key, and that of the key's first success."""
    key = W.partitionBy("account", "purpose_key", "model")
    n = F.row_number().over(key.orderBy("ts", "call_id"))
    return calls.withColumn("purpose_key", F.col("account") % 3).withColumn("n", n).withColumn("first_ok", F.min(F.when(F.col("ok"), F.col("n"))).over(key))


_ATTEMPTS = """a AS (SELECT *, account % 3 AS purpose_key, row_number() OVER (PARTITION BY account, account % 3, model ORDER BY ts, call_id) AS n FROM ledger),
b AS (SELECT *, min(CASE WHEN ok THEN n END) OVER (PARTITION BY account, purpose_key, model) AS first_ok FROM a)"""


@R.query("AGG-09 WIN-02 WIN-03 ORD-03", f"""WITH {LEDGER}, {_ATTEMPTS},
g AS (SELECT account, model, count(*) AS n_rows, count(*) FILTER (n > first_ok) AS extras, count(*) FILTER (n > 1 AND (first_ok IS NULL OR n <= first_ok)) AS retries,
  CAST(coalesce(sum(cost) FILTER (n > first_ok), 0) AS DOUBLE) AS extra_usd, CAST(coalesce(sum(cost) FILTER (n > first_ok AND ts >= TIMESTAMP '2024-01-30'), 0) AS DOUBLE) AS new_usd
  FROM b GROUP BY account, model HAVING count(*) FILTER (n > first_ok) > 0 OR (count(*) > 2 AND max(first_ok) IS NULL))
SELECT * FROM g ORDER BY extra_usd DESC, account, model LIMIT 20""")
def spend_duplicates(spark, sf_dir):
    """Calls repeated after their key's first success are waste, those before it retries; the dearest twenty keys."""
    after = F.col("n") > F.col("first_ok")
    before = (F.col("n") > 1) & (F.col("first_ok").isNull() | (F.col("n") <= F.col("first_ok")))
    recent = F.col("ts") >= F.lit("2024-01-30").cast("timestamp_ntz")
    groups = attempts(ledger(spark, sf_dir)).groupBy("account", "model").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(after).alias("extras"), F.count_if(before).alias("retries"),
        usd(F.sum(F.when(after, F.col("cost")))).alias("extra_usd"), usd(F.sum(F.when(after & recent, F.col("cost")))).alias("new_usd"), F.max("first_ok").alias("first_ok"),
    )
    listed = groups.filter((F.col("extras") > 0) | ((F.col("n_rows") > 2) & F.col("first_ok").isNull()))
    return listed.drop("first_ok").orderBy(F.desc("extra_usd"), "account", "model").limit(20)


@R.query("AGG-11 COST-02", f"WITH {LEDGER} SELECT account, CAST(sum(cost) AS DOUBLE) AS usd, CAST(coalesce(sum(cost) FILTER (NOT ok), 0) AS DOUBLE) AS failed_usd, CAST(sum(model) AS BIGINT) AS seconds FROM ledger WHERE purpose IN ('error', 'view') GROUP BY account")
def attempt_costs(spark, sf_dir):
    runs = ledger(spark, sf_dir).filter(F.col("purpose").isin("error", "view"))
    return runs.groupBy("account").agg(usd(F.sum("cost")).alias("usd"), usd(F.sum(F.when(~F.col("ok"), F.col("cost")))).alias("failed_usd"), F.sum("model").alias("seconds"))


@R.query("AGG-12", f"""WITH {LEDGER} SELECT level, count(call_id) AS n FROM (VALUES ('0'), ('1'), ('2'), ('3'), ('99')) l(level)
LEFT JOIN ledger ON CAST(model % 4 AS VARCHAR) = level GROUP BY level""")
def level_histogram(spark, sf_dir):
    """Counts by level, with zeros for levels that don't occur."""
    levels = spark.createDataFrame([(x,) for x in ("0", "1", "2", "3", "99")], "level string")
    counts = ledger(spark, sf_dir).groupBy((F.col("model") % 4).cast("string").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return levels.join(counts, "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("n"))


@R.query("AGG-25 HSH-01 STRM-02", f"""WITH {LEDGER} SELECT purpose, left(sha256(string_agg(CAST(call_id AS VARCHAR) || ':' || CAST(account AS VARCHAR), ',' ORDER BY call_id)), 16) AS fingerprint FROM ledger GROUP BY purpose""")
def activity_fingerprint(spark, sf_dir):
    """Order-sensitive digest of a scope's rows; any change shows."""
    rows = ledger(spark, sf_dir).groupBy("purpose").agg(F.array_sort(F.collect_list(F.struct("call_id", "account"))).alias("r"))
    text = F.array_join(F.transform("r", lambda x: F.concat_ws(":", x["call_id"], x["account"])), ",")
    return rows.select("purpose", F.substring(F.sha2(text, 256), 1, 16).alias("fingerprint"))


@R.query("WIN-01 COST-07 JOIN-05", f"""WITH {LEDGER} SELECT account, purpose, CAST(cost AS DOUBLE) AS reading, ts AS read_at, ts < TIMESTAMP '2024-01-30 23:00:00' AS stale
FROM ledger QUALIFY row_number() OVER (PARTITION BY account, purpose ORDER BY ts DESC, call_id DESC) = 1""")
def latest_reading(spark, sf_dir):
    """The newest reading of each meter, without sorting its whole history: a maximum, pre-aggregated before the shuffle."""
    newest = ledger(spark, sf_dir).groupBy("account", "purpose").agg(F.max_by(F.struct("cost", "ts"), F.struct("ts", "call_id")).alias("r"))
    return newest.select("account", "purpose", F.col("r.cost").cast("double").alias("reading"), F.col("r.ts").alias("read_at"), (F.col("r.ts") < F.lit("2024-01-30 23:00:00").cast("timestamp_ntz")).alias("stale"))


@R.query("ORD-04", f"WITH {LEDGER} SELECT call_id, ts, purpose FROM ledger WHERE ts < TIMESTAMP '2024-01-15 12:00:00' ORDER BY ts DESC, call_id DESC LIMIT 51")
def keyset_page(spark, sf_dir, cursor="2024-01-15 12:00:00", page=50):
    """One page before a cursor and one row more, which tells whether there is a next page."""
    calls = ledger(spark, sf_dir).filter(F.col("ts") < F.lit(cursor).cast("timestamp_ntz"))
    return calls.select("call_id", "ts", "purpose").orderBy(F.desc("ts"), F.desc("call_id")).limit(page + 1)


@R.query("ORD-05", f"WITH {LEDGER} SELECT call_id, purpose, CAST(cost AS DOUBLE) AS usd FROM ledger ORDER BY cost DESC, call_id LIMIT 75")
def cumulative_page(spark, sf_dir, page=3, size=25):
    return ledger(spark, sf_dir).select("call_id", "purpose", F.col("cost").cast("double").alias("usd")).orderBy(F.desc("usd"), "call_id").limit(page * size)


CAPS = [("click", "20000.00"), ("view", None), ("purchase", "1000000.00"), ("signup", "1.00"), ("error", "0.00")]


@R.query("COST-03 MTH-05", f"""WITH {LEDGER}, caps(purpose, cap) AS (VALUES ('click', 20000.00::DECIMAL(10,2)), ('view', NULL), ('purchase', 1000000.00), ('signup', 1.00), ('error', 0.00)),
s AS (SELECT purpose, sum(cost) AS spent FROM ledger GROUP BY purpose)
SELECT c.purpose, CAST(spent AS DOUBLE) AS spent, CAST(cap AS DOUBLE) AS cap, CASE WHEN cap > 0 THEN CAST(least(100, floor(CAST(spent * 100 AS DOUBLE) / CAST(cap AS DOUBLE))) AS DOUBLE) END AS share,
  cap IS NULL OR spent + 5 <= cap AS fits FROM caps c LEFT JOIN s USING (purpose)""")
def budget_overview(spark, sf_dir):
    caps = spark.createDataFrame(CAPS, "purpose string, cap string").withColumn("cap", F.col("cap").cast("decimal(10,2)"))
    spent = ledger(spark, sf_dir).groupBy("purpose").agg(F.sum("cost").alias("spent"))
    share = money.clamped_share(F.col("spent").cast("double"), F.col("cap").cast("double"))
    return caps.join(spent, "purpose", "left").select("purpose", F.col("spent").cast("double").alias("spent"), F.col("cap").cast("double").alias("cap"), share.cast("double").alias("share"), (F.col("cap").isNull() | (F.col("spent") + 5 <= F.col("cap"))).alias("fits"))


@R.query("COST-01 MTH-01 MAP-01", f"""WITH {LEDGER}, t AS (SELECT call_id, purpose, model * 1000 + account AS n_in, model * 100 AS cached, account * 7 AS n_out,
  CASE purpose WHEN 'click' THEN 2.5 WHEN 'view' THEN 0.8 ELSE 3.0 END::DECIMAL(10,4) AS p_in, CASE purpose WHEN 'click' THEN 0.25 WHEN 'view' THEN 0.08 ELSE 0.3 END::DECIMAL(10,4) AS p_c,
  CASE purpose WHEN 'click' THEN 10 WHEN 'view' THEN 4 ELSE 15 END::DECIMAL(10,4) AS p_out, CASE WHEN purpose = 'view' THEN 0.5 ELSE 1 END::DECIMAL(6,4) AS share FROM ledger)
SELECT call_id, CAST(CAST(CASE WHEN exact - floor(exact) = 0.5 THEN floor(exact) + CAST(floor(exact) AS BIGINT) % 2 ELSE floor(exact + 0.5) END AS DOUBLE) / 1000000 AS DOUBLE) AS usd
FROM (SELECT call_id, CAST(greatest(0, n_in - cached) * p_in + cached * p_c + n_out * p_out AS DECIMAL(20,4)) * share AS exact FROM t)""")
def call_cost(spark, sf_dir):
    """Each call priced by its model's list prices; unknown purposes take the default."""
    prices = {"click": (2.5, 0.25, 10.0), "view": (0.8, 0.08, 4.0)}
    kinds = F.create_map(*[x for k, v in prices.items() for x in (F.lit(k), F.struct(*[F.lit(p).alias(n) for p, n in zip(v, ("i", "c", "o"), strict=True)]))])
    chosen = F.coalesce(F.try_element_at(kinds, F.col("purpose")), F.struct(F.lit(3.0).alias("i"), F.lit(0.3).alias("c"), F.lit(15.0).alias("o")))
    t = ledger(spark, sf_dir).select("call_id", (F.col("model") * 1000 + F.col("account")).alias("n_in"), (F.col("model") * 100).alias("cached"), (F.col("account") * 7).alias("n_out"), chosen.alias("p"), F.when(F.col("purpose") == "view", 0.5).otherwise(1.0).alias("share"))
    return t.select("call_id", money.call_cost(F.col("n_in"), F.col("cached"), F.col("n_out"), F.col("p.i"), F.col("p.c"), F.col("p.o"), F.col("share")).cast("double").alias("usd"))


@R.query("COST-04 COST-05 MTH-03 JOIN-06", """
WITH w AS (SELECT doc_id, source, length(text) AS chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
SELECT source, count(*) AS windows, CAST(sum(ceil(chars / 4.0)) AS BIGINT) AS tokens_in, CAST(sum(ceil(ceil(chars / 4.0) * 1.15) + 24) AS BIGINT) AS tokens_out,
  round(CAST(sum(ceil(chars / 4.0)) * 2.5 + sum(ceil(ceil(chars / 4.0) * 1.15) + 24) * 10.0 AS DOUBLE) / 1000000 * 0.5, 9) AS usd
FROM w GROUP BY source""")
def work_estimate(spark, sf_dir):
    """What the documents without an answer yet would cost in batch mode, at half price."""
    open_docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    t = open_docs.select("source", money.tokens(F.length("text")).alias("t")).withColumn("o", F.ceil(F.col("t") * F.lit(1.15).cast("decimal(4,2)")).cast("long") + 24)
    g = t.groupBy("source").agg(F.count(F.lit(1)).alias("windows"), F.sum("t").alias("tokens_in"), F.sum("o").alias("tokens_out"))
    return g.withColumn("usd", F.round((F.col("tokens_in") * 2.5 + F.col("tokens_out") * 10.0) / 1000000 * 0.5, 9))


@R.query("COST-06", f"WITH {LEDGER} SELECT call_id, round(CASE model % 3 WHEN 0 THEN 0.000306 WHEN 1 THEN 0.000222 ELSE 0.000164 END::DOUBLE * (account + 20) * 1.1, 9) AS usd FROM ledger WHERE purpose = 'view'")
def gpu_cost(spark, sf_dir):
    """Card seconds, with 20 s of start and idle a call, at the card's price and a tenth more."""
    card = F.when(F.col("model") % 3 == 0, 0.000306).when(F.col("model") % 3 == 1, 0.000222).otherwise(0.000164)
    return ledger(spark, sf_dir).filter("purpose = 'view'").select("call_id", F.round(card * (F.col("account") + 20) * 1.1, 9).alias("usd"))


@R.query("COST-08", f"WITH {LEDGER}, l AS (SELECT purpose, account, arg_max(cost, ts) AS last FROM ledger GROUP BY ALL) SELECT purpose, bool_or(last < 10) AS room FROM l GROUP BY purpose")
def room_test(spark, sf_dir):
    """A provider has room while any of its accounts' latest readings is below the limit."""
    last = ledger(spark, sf_dir).groupBy("purpose", "account").agg(F.max_by("cost", "ts").alias("last"))
    return last.groupBy("purpose").agg(F.bool_or(F.col("last") < 10).alias("room"))


@R.query("COST-09", f"WITH {LEDGER} SELECT account, round(CAST(sum(cost) AS DOUBLE) / 50 * 100, 6) AS week_percent FROM ledger WHERE ts >= TIMESTAMP '2024-01-30 20:00:00' AND ts < TIMESTAMP '2024-01-30 21:00:00' GROUP BY account")
def last_hour_share(spark, sf_dir):
    hour = between(ledger(spark, sf_dir), "2024-01-30 20:00:00", "2024-01-30 21:00:00")
    return hour.groupBy("account").agg(F.round(F.sum("cost").cast("double") / 50 * 100, 6).alias("week_percent"))


@R.query("FLT-05 FLT-06 STRM-03", f"""WITH {LEDGER}, n AS (SELECT account, purpose, max(ts) AS last FROM ledger GROUP BY ALL)
SELECT account, purpose, last < TIMESTAMP '2024-01-30 12:00:00' - greatest(INTERVAL 2 hour, 2 * INTERVAL 1 hour + INTERVAL 900 second) AS abandoned FROM n""")
def abandoned_runs(spark, sf_dir, call_timeout_s=3600):
    """Keys silent for longer than two hours, or twice the call timeout and a quarter of an hour."""
    limit = max(7200, 2 * call_timeout_s + 900)
    last = ledger(spark, sf_dir).groupBy("account", "purpose").agg(F.max("ts").alias("last"))
    return last.select("account", "purpose", (F.col("last") < F.lit("2024-01-30 12:00:00").cast("timestamp_ntz") - F.expr(f"INTERVAL {limit} SECONDS")).alias("abandoned"))


@R.query("FLT-02 FLT-03", f"""WITH {LEDGER} SELECT call_id, purpose, model FROM ledger
WHERE (purpose IN ('click', 'view') OR purpose LIKE 'sign%') AND (model IS DISTINCT FROM 5) AND model IS NOT NULL AND NOT (account > 140 OR purpose = 'view')""")
def negated_filters(spark, sf_dir):
    """Exclusion keeps rows where the excluded column is null, as object-relational layers do."""
    c = ledger(spark, sf_dir)
    keep = (F.col("purpose").isin("click", "view") | F.col("purpose").startswith("sign")) & ~F.col("model").eqNullSafe(5) & F.col("model").isNotNull()
    return c.filter(keep & ~((F.col("account") > 140) | (F.col("purpose") == "view"))).select("call_id", "purpose", "model")


@R.query("FLT-04 PRJ-04 JSN-01", """SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, json_extract(props, '$.missing') IS NOT NULL AS has_missing
FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) > 90""")
def json_predicates(spark, sf_dir):
    parsed = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k INT").getField("k").alias("k"), F.coalesce(F.array_contains(F.json_object_keys("props"), "missing"), F.lit(False)).alias("has_missing"))
    return parsed.filter(F.col("k") > 90)


@R.query("WIN-05", f"""WITH {LEDGER}, p AS (SELECT call_id, account, purpose, ts, model % 2 AS note FROM ledger),
l AS (SELECT *, lag(note) OVER w AS before, lag(CAST(ts AS DATE)) OVER w AS day_before FROM p WINDOW w AS (PARTITION BY account, purpose ORDER BY ts, call_id))
SELECT call_id, note, CAST(ts AS DATE) IS DISTINCT FROM day_before AS new_day FROM l WHERE note IS DISTINCT FROM before""")
def log_dedupe(spark, sf_dir):
    """Log lines that say something new in their step; repeated notes go."""
    w = W.partitionBy("account", "purpose").orderBy("ts", "call_id")
    lines = ledger(spark, sf_dir).withColumn("note", F.col("model") % 2)
    lines = lines.withColumns({"before": F.lag("note").over(w), "day_before": F.lag(F.to_date("ts")).over(w)})
    return lines.filter(~F.col("note").eqNullSafe(F.col("before"))).select("call_id", "note", (~F.to_date("ts").eqNullSafe(F.col("day_before"))).alias("new_day"))


@R.query("WIN-06", f"""WITH {LEDGER}, f AS (SELECT *, model % 5 < 2 AS unsure, lag(model % 5 < 2) OVER w AS before FROM ledger WINDOW w AS (PARTITION BY account ORDER BY ts, call_id)),
g AS (SELECT *, sum(CASE WHEN unsure AND NOT coalesce(before, false) THEN 1 ELSE 0 END) OVER (PARTITION BY account ORDER BY ts, call_id) AS region FROM f)
SELECT account, CAST(region AS BIGINT) AS region, count(*) AS members, min(call_id) AS first_call, max(call_id) AS last_call FROM g WHERE unsure GROUP BY account, region""")
def uncertain_regions(spark, sf_dir):
    """Adjacent uncertain rows form one region: gaps and islands by a running sum of starts."""
    w = W.partitionBy("account").orderBy("ts", "call_id")
    f = ledger(spark, sf_dir).withColumn("unsure", F.col("model") % 5 < 2)
    starts = F.col("unsure") & ~F.coalesce(F.lag("unsure").over(w), F.lit(False))
    g = f.withColumn("start", starts.cast("int")).withColumn("region", F.sum("start").over(w))
    return g.filter("unsure").groupBy("account", "region").agg(F.count(F.lit(1)).alias("members"), F.min("call_id").alias("first_call"), F.max("call_id").alias("last_call"))


@R.query("SET-01", f"""WITH {LEDGER} SELECT 'call' AS kind, ts AS at, purpose AS label, CAST(cost AS DOUBLE) AS usd FROM ledger
UNION ALL SELECT 'step', o_orderdate, o_orderpriority, NULL FROM orders""")
def union_timeline(spark, sf_dir):
    """Two feeds of unlike columns as one timeline."""
    calls = ledger(spark, sf_dir).select(F.lit("call").alias("kind"), F.col("ts").alias("at"), F.col("purpose").alias("label"), F.col("cost").cast("double").alias("usd"))
    steps = table(spark, sf_dir, "orders").select(F.lit("step").alias("kind"), F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("label"))
    return calls.unionByName(steps, allowMissingColumns=True)


@R.query("DT-03 STR-16", f"WITH {LEDGER}, d AS (SELECT account, CAST(epoch(max(ts)) - epoch(min(ts)) AS BIGINT) AS s, sum(cost) AS c FROM ledger GROUP BY account) SELECT account, CASE WHEN s >= 3600 THEN format('{{}}h {{:02d}}m', s // 3600, s % 3600 // 60) ELSE format('{{}}m {{:02d}}s', s // 60, s % 60) END AS lasted, '$' || format('{{:,.2f}}', CAST(round(c, 2) AS DOUBLE)) AS spent FROM d")
def durations(spark, sf_dir):
    """Time from an account's first call to its last, to the nearest second, and what it spent."""
    at = lambda ts: F.unix_micros(ts.cast("timestamp")) / 1000000
    g = ledger(spark, sf_dir).groupBy("account").agg(F.rint(at(F.max("ts")) - at(F.min("ts"))).cast("long").alias("s"), F.sum("cost").alias("c"))
    return g.select("account", time.duration(F.col("s")).alias("lasted"), money.format_usd(F.round("c", 2)).alias("spent"))


@R.query("MTH-04 SRC-15", f"""WITH {LEDGER}, m AS (SELECT purpose, max(day_sum) AS top FROM (SELECT purpose, day, sum(cost) AS day_sum FROM ledger GROUP BY ALL) GROUP BY purpose)
SELECT purpose, (SELECT min(4 * s * pow(10, k)) FROM (VALUES (1.0), (2.0), (2.5), (5.0)) a(s), range(-4, 12) b(k) WHERE 4 * s * pow(10, k) >= CAST(top AS DOUBLE)) AS axis FROM m""")
def chart_axis(spark, sf_dir):
    days = ledger(spark, sf_dir).groupBy("purpose", F.to_date("ts").alias("day")).agg(F.sum("cost").alias("s"))
    return days.groupBy("purpose").agg(F.max("s").cast("double").alias("top")).select("purpose", money.nice_max(F.col("top")).alias("axis"))


@R.query("AGG-32", f"""WITH {LEDGER} SELECT purpose AS code, count(*) AS items, min(confidence) AS least, max(confidence) AS most, min(account) AS first_chapter, max(account) AS last_chapter
FROM (SELECT *, CASE WHEN model % 7 = 0 THEN NULL ELSE model END AS confidence FROM ledger) GROUP BY purpose ORDER BY items DESC, code""")
def review_groups(spark, sf_dir):
    items = ledger(spark, sf_dir).withColumn("confidence", F.when(F.col("model") % 7 != 0, F.col("model")))
    g = items.groupBy(F.col("purpose").alias("code")).agg(F.count(F.lit(1)).alias("items"), F.min("confidence").alias("least"), F.max("confidence").alias("most"), F.min("account").alias("first_chapter"), F.max("account").alias("last_chapter"))
    return g.orderBy(F.desc("items"), "code")


@R.query("ORD-01 AGG-32", f"""WITH {LEDGER} SELECT purpose, call_id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY purpose ORDER BY CASE WHEN model % 7 = 0 THEN NULL ELSE model END ASC NULLS LAST, account, call_id) AS place FROM ledger)""")
def review_order(spark, sf_dir):
    """In a group the lowest confidence first, unknown last."""
    c = F.when(F.col("model") % 7 != 0, F.col("model"))
    place = F.row_number().over(W.partitionBy("purpose").orderBy(c.asc_nulls_last(), "account", "call_id"))
    return ledger(spark, sf_dir).withColumn("place", place).select("purpose", "call_id", "place")


@R.query("AGG-33 ARR-02", f"""WITH {LEDGER}, v AS (SELECT call_id, unnest(list_filter([CASE WHEN model > 80 THEN 'large' END, CASE WHEN account < 20 THEN 'new' END, CASE WHEN NOT ok THEN 'failed' END], lambda x: x IS NOT NULL)) AS reason FROM ledger)
SELECT reason, count(*) AS n FROM v GROUP BY reason ORDER BY n DESC, reason""")
def reason_histogram(spark, sf_dir):
    reasons = F.array_compact(F.array(F.when(F.col("model") > 80, "large"), F.when(F.col("account") < 20, "new"), F.when(~F.col("ok"), "failed")))
    return ledger(spark, sf_dir).select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason")


STAGES = ("signup", "view", "click", "purchase")


@R.query("AGG-34", f"""WITH {LEDGER} SELECT account, array_to_string(list_filter(['signup', 'view', 'click', 'purchase'], lambda x: list_contains(s, x)), ',') AS done, newest FROM
(SELECT account, list(DISTINCT purpose) AS s, arg_max(purpose, (ts, call_id)) AS newest FROM ledger GROUP BY account)""")
def stage_progress(spark, sf_dir):
    """Finished stages in pipeline order and the newest one."""
    g = ledger(spark, sf_dir).groupBy("account").agg(F.collect_set("purpose").alias("s"), F.max_by("purpose", F.struct("ts", "call_id")).alias("newest"))
    return g.select("account", F.array_join(F.array_intersect(F.array(*[F.lit(x) for x in STAGES]), "s"), ",").alias("done"), "newest")


@R.query("ORD-07", f"""WITH {LEDGER}, a AS (SELECT account, CASE WHEN account % 4 = 0 THEN NULL ELSE account % 4 END AS priority, sum(cost) AS used FROM ledger GROUP BY account)
SELECT account, CAST(priority AS DOUBLE) AS priority, CAST(row_number() OVER (ORDER BY priority NULLS LAST, used, account) AS INTEGER) AS turn FROM a""")
def call_order(spark, sf_dir):
    """Accounts by priority, unset last, then by least used; one row an account."""
    a = ledger(spark, sf_dir).groupBy("account").agg(F.sum("cost").alias("used")).withColumn("priority", F.when(F.col("account") % 4 != 0, F.col("account") % 4))
    return a.select("account", F.col("priority").cast("double").alias("priority"), F.row_number().over(W.partitionBy().orderBy(F.col("priority").asc_nulls_last(), "used", "account")).alias("turn"))
