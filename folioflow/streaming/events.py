"""The ledger as a stream: buckets, sessions, idempotent runs, silent keys. Every query is the batch form of what a cluster runs forever;
`availableNow` reads what there is and stops."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import Registry
from ..session import shared_folder, table
from ..sources.store import Store

R = Registry()


def stream(spark: SparkSession, sf_dir: str, late: str = "1 hour") -> DataFrame:
    """events as a stream with event time; times without a zone are UTC."""
    schema = table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)


def drain(df: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what there is now and give its result as a table. State and result lie in the shared folder."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/folioflow/stream-{uuid.uuid4().hex}"
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{folder}/rows")
    else:  # the whole result with each batch; the last one stays
        spark.createDataFrame([], df.schema).write.parquet(f"{folder}/rows")
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/rows"))
    writer.start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/rows")


def daily(events: DataFrame) -> DataFrame:
    return events.groupBy(F.window("at", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(12,2)")).alias("usd"))


@R.query("STRM-06 STRM-01", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS usd FROM events GROUP BY ALL")
def tumbling_days(spark, sf_dir):
    out = drain(daily(stream(spark, sf_dir)), "complete")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", F.col("usd").cast("double").alias("usd"))


@R.query("STRM-06", """WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 hour THEN 0 ELSE 1 END AS fresh FROM events),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM s)
SELECT user_id, count(*) AS n, min(ts) AS first_at FROM g GROUP BY user_id, session""")
def user_sessions(spark, sf_dir):
    """Sessions that an hour of silence ends; the same expression runs on a stream."""
    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    g = e.groupBy("user_id", F.session_window("at", "1 hour")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_at"))
    return g.select("user_id", "n", "first_at")


@R.query("STRM-01 MUT-01", "SELECT count(DISTINCT event_id) AS runs FROM events")
def deduplicated_runs(spark, sf_dir):
    """At-least-once delivery made idempotent: a key that came before is dropped while the watermark remembers it."""
    e = stream(spark, sf_dir)
    twice = e.union(e).dropDuplicatesWithinWatermark(["event_id"])
    return drain(twice.select("event_id"), "append").agg(F.count(F.lit(1)).alias("runs"))


def upserting(store: Store, order: list[str]):
    """foreachBatch into a store: of a key's rows the last by order wins, over micro-batches too. A batch that comes again writes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(store.key).agg(F.max_by(F.struct(*store.schema.names), F.struct(*order)).alias("r")).select("r.*")
        have = store.read().select(store.key, F.struct(*order).alias("have"))
        fresh = newest.join(have, store.key, "left").filter(F.col("have").isNull() | (F.struct(*order) > F.col("have"))).select(*store.schema.names)
        store.upsert(fresh)

    return write


@R.query("STRM-01 SRC-13", "SELECT user_id, arg_max(event_id, {a: ts, b: event_id}) AS event_id, arg_max(event_type, {a: ts, b: event_id}) AS event_type, max(ts) AS ts FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def streamed_latest(spark, sf_dir):
    """Each account's last call, kept in a stored table by a stream."""
    folder = f"{shared_folder(spark)}/folioflow/latest-{uuid.uuid4().hex}"
    store = Store(spark, f"{folder}/table", "user_id long, event_id long, event_type string, ts timestamp_ntz", "user_id", "user_id", buckets=8)
    calls = stream(spark, sf_dir).filter("user_id is not null").select(*store.schema.names)
    calls.writeStream.foreachBatch(upserting(store, ["ts", "event_id"])).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return store.read()


STEPS = {"queued": "ingest", "ingest": "split", "split": "lexical", "lexical": "review", "review": "published"}


@R.query("STRM-05", """WITH t(state, nxt) AS (VALUES ('queued', 'ingest'), ('ingest', 'split'), ('split', 'lexical'), ('lexical', 'review'), ('review', 'published')), s0 AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'review' ELSE 'queued' END AS state FROM documents),
s1 AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN s0.state ELSE coalesce(nxt, s0.state) END AS state FROM s0 LEFT JOIN t ON t.state = s0.state), s2 AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN s1.state ELSE coalesce(nxt, s1.state) END AS state FROM s1 LEFT JOIN t ON t.state = s1.state)
SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN s2.state ELSE coalesce(nxt, s2.state) END AS state FROM s2 LEFT JOIN t ON t.state = s2.state""")
def stepped_states(spark, sf_dir, ticks=3):
    """Editions move one step a tick through a table of transitions; failed ones wait. The loop is over ticks, not rows."""
    moves = spark.createDataFrame(list(STEPS.items()), "state string, then string")
    now = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "review").otherwise("queued").alias("state"))
    for _ in range(ticks):
        now = now.join(moves, "state", "left").select("doc_id", F.when(F.col("doc_id") % 11 == 0, F.col("state")).otherwise(F.coalesce("then", "state")).alias("state"))
    return now
