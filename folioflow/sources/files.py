"""JSON files with strict schemas, resumable logs, and bundles with fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def strict_json(spark: SparkSession, path: str, schema: str, many: bool = False) -> DataFrame:
    """JSON whose rows must fit the schema: a malformed row or an unknown key is an error. many: one document a file."""
    raw = spark.read.text(path, wholetext=many)
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    keys = F.json_object_keys("value")
    extra = F.size(F.array_except(keys, F.array(*[F.lit(n) for n in names]))) > 0
    checked = raw.withColumn("value", F.when(keys.isNull() | extra, F.raise_error(F.concat(F.lit("row doesn't fit the schema: "), F.substring("value", 1, 80))).cast("string")).otherwise(F.col("value")))
    return checked.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def unanswered(work: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Rows of work whose key the append-only log doesn't hold yet."""
    return work.join(log.select(key).distinct(), key, "left_anti")


def fingerprints(rows: DataFrame, key: str) -> DataFrame:
    """key, fingerprint: digest of each group's rows as canonical JSON, the same in whatever order they come.

    Each row is digested where it is read; four 60-bit parts of the digests are summed, which is done before and after the shuffle,
    and the sums and the number of rows are digested again. So a group is never in one place.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)
    parts = [F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)").alias(f"__p{i}") for i in range(4)]
    sums = rows.select(key, *parts).groupBy(key).agg(F.count(F.lit(1)).alias("__n"), *[F.sum(f"__p{i}").cast("decimal(38,0)").alias(f"__p{i}") for i in range(4)])
    return sums.select(key, F.sha2(F.concat_ws(",", "__n", *[f"__p{i}" for i in range(4)]), 256).alias("fingerprint"))


def write_bundle(rows: DataFrame, path: str, key: str) -> None:
    """A bundle: the rows by key, and a manifest with each key's fingerprint."""
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    fingerprints(rows, key).write.mode("overwrite").parquet(f"{path}/manifest")


def import_bundle(spark: SparkSession, path: str, stored: DataFrame, key: str) -> DataFrame:
    """The stored table after a bundle's import: keys with an equal fingerprint are left alone, others replaced as a whole."""
    rows, manifest = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/manifest")
    have = fingerprints(stored, key).withColumnRenamed("fingerprint", "__have")
    changed = manifest.join(have, key, "left").filter(~F.col("fingerprint").eqNullSafe(F.col("__have"))).select(key)
    return stored.join(changed, key, "left_anti").unionByName(rows.join(changed, key, "left_semi"))
