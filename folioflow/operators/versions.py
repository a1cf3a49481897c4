"""Results in versions: what was made from which input, which of it is current, and bundles imported into a stored table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.registry import Registry
from ..session import shared_folder, table
from ..sources.store import Store

R = Registry()


def neighbour(rows: DataFrame, keys: list[str], cell: str, order: list[str], value: str, name: str, ahead: bool = False) -> DataFrame:
    """rows plus name: the value of the row before (or ahead) in the same keys, by cell and then order.

    A window over keys and cell, and one over the first (last) values of the cells: a key with a third of all rows is as many windows as
    it has cells, and of the second it takes one row a cell. Cells must not overlap in order.
    """
    inside = W.partitionBy(*keys, cell).orderBy(*order)
    step = F.lead if ahead else F.lag
    edge = step(F.lit(1)).over(inside).isNull()
    given = rows.withColumn("inside", step(value).over(inside)).withColumn("edge", edge)
    pick = F.min_by if ahead else F.max_by
    ends = rows.groupBy(*keys, cell).agg(pick(value, F.struct(*order)).alias("end"))
    ends = ends.select(*keys, cell, step("end").over(W.partitionBy(*keys).orderBy(cell)).alias("beyond"))
    same = [F.col(f"g.{c}").eqNullSafe(F.col(f"e.{c}")) for c in (*keys, cell)]
    on = same[0]
    for s in same[1:]:
        on = on & s
    joined = given.alias("g").join(ends.alias("e"), on)
    return joined.select(*[F.col(f"g.{c}") for c in rows.columns], F.when(F.col("g.edge"), F.col("e.beyond")).otherwise(F.col("g.inside")).alias(name))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger as results: an edition's processing of a kind, with the digest of what went in."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    return e.select(F.col("user_id").alias("edition"), F.col("event_type").alias("kind"), F.sha2(F.concat_ws("/", "event_type", k), 256).alias("hash"), F.col("ts").alias("at"), F.col("event_id").alias("run"))


def artifacts(made: DataFrame) -> DataFrame:
    """made(edition, kind, hash, at, run) -> one row for each edition, kind and hash, numbered by when it first came; the one made last is current.

    Making the same again gives no new version; going back to an earlier input makes its version current again.
    """
    when = F.struct("at", "run")
    a = made.groupBy("edition", "kind", "hash").agg(F.min(when).alias("first"), F.max(when).alias("last"), F.count(F.lit(1)).alias("times"))
    w = W.partitionBy("edition", "kind")
    return a.select(
        "edition", "kind", "hash", F.row_number().over(w.orderBy("first")).alias("version"), F.col("first.at").alias("created_at"), F.col("last.at").alias("updated_at"),
        F.col("last.run").alias("run"), "times", (F.row_number().over(w.orderBy(F.desc("last"))) == 1).alias("is_current"),
    )


def history(made: DataFrame) -> DataFrame:
    """made -> the stretches of time in which one hash was current: runs of equal hashes folded, each valid until the next begins."""
    keys, order = ["edition", "kind"], ["at", "run"]
    rows = made.withColumn("day", F.date_trunc("day", "at"))
    before = neighbour(rows, keys, "day", order, "hash", "before")
    begun = before.filter(~F.col("before").eqNullSafe(F.col("hash")) | F.col("before").isNull()).drop("before")
    ends = neighbour(begun, keys, "day", order, "at", "valid_to", ahead=True)
    return ends.select("edition", "kind", "hash", F.col("at").alias("valid_from"), "valid_to", "run")


_MADE = "made AS (SELECT user_id AS edition, event_type AS kind, sha256(event_type || '/' || json_extract_string(props, '$.k')) AS hash, ts AS made_at, event_id AS run FROM events)"


@R.query("MUT-02", f"""WITH {_MADE}, a AS (SELECT edition, kind, hash, min({{a: made_at, b: run}}) AS f, max({{a: made_at, b: run}}) AS l, count(*) AS times FROM made GROUP BY ALL)
SELECT edition, kind, hash, row_number() OVER (PARTITION BY edition, kind ORDER BY f)::INT AS version, f.a AS created_at, l.a AS updated_at, l.b AS run, times, l = max(l) OVER (PARTITION BY edition, kind) AS is_current FROM a""")
def artifact_versions(spark, sf_dir):
    return artifacts(results(spark, sf_dir))


@R.query("MUT-02 WIN-05", f"""WITH {_MADE}, b AS (SELECT *, lag(hash) OVER (PARTITION BY edition, kind ORDER BY made_at, run) AS before FROM made), c AS (SELECT * FROM b WHERE before IS NULL OR before <> hash)
SELECT edition, kind, hash, made_at AS valid_from, lead(made_at) OVER (PARTITION BY edition, kind ORDER BY made_at, run) AS valid_to, run FROM c""")
def artifact_history(spark, sf_dir):
    return history(results(spark, sf_dir))


def new_store(spark: SparkSession, name: str, schema: str, key: str, group: str, carried: tuple[str, ...] = (), buckets: int = 16) -> Store:
    """A store of its own in the shared folder."""
    return Store(spark, f"{shared_folder(spark)}/folioflow/{name}-{uuid.uuid4().hex}", schema, key, group, carried, buckets)


def bundles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two bundles of fifty works: all documents; and some of the works later, in which texts changed, were taken out, or stayed as they are."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 50).alias("work"), "text", F.lit(1).alias("made"))
    later = d.filter(F.col("work") % 5 < 3).withColumn("made", F.lit(2))
    touched: Column = F.col("work") % 5 < 2
    later = later.filter(~(touched & (F.col("id") % 7 == 0)))
    return d, later.withColumn("text", F.when(touched & (F.col("id") % 3 == 0), F.concat("text", F.lit(" revised"))).otherwise(F.col("text")))


@R.query("SRC-12 SRC-13 MUT-01", """SELECT doc_id AS id, doc_id % 50 AS work, sha256(CASE WHEN doc_id % 50 % 5 < 2 AND doc_id % 3 = 0 THEN text || ' revised' ELSE text END) AS text_hash, 1 AS made, 2 AS version
FROM documents WHERE NOT (doc_id % 50 % 5 < 2 AND doc_id % 7 = 0)""")
def imported_bundles(spark, sf_dir):
    """Bundles imported one after the other, the second one twice: works that are equal are passed over, rows keep when they were made, and rows that a work lost go."""
    first, second = bundles(spark, sf_dir)
    store = new_store(spark, "works", "id long, work long, text string, made int", "id", "work", ("made",))
    store.upsert(first)
    store.upsert(second)
    version, _ = store.upsert(second)  # nothing to do: no third version
    return store.read().select("id", "work", F.sha2("text", 256).alias("text_hash"), "made", F.lit(version).alias("version"))
