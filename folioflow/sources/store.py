"""A table that is upserted by group and key, in versions, on any store that Spark writes to.

Rows lie in buckets by a hash of their key: ``data/<write>/bucket=<n>``. A version is one small file, ``versions/<number>``, which names the
write that each bucket is to be read from. An upsert writes the buckets it changes to a folder of their own, and then renames a
finished version file into its place, which only one writer can do: readers see the old version or the new one, and a write that was killed
leaves files that no version names.

``upsert`` takes whole groups. A group whose digest (``files.fingerprints``, sums of row digests, so no group is gathered) equals the stored
one's is passed over. Of the others, rows are matched by key: columns named in ``carried`` stay as they are stored, other columns come from the
new row, and stored rows of the group that are not there any more go. Groups that are not in the upsert stay. Where nothing changes,
nothing is written.

A table with N buckets has version files of N entries; N is fixed when the table is made. A hot group's rows lie in all buckets, as
any group's do. One bucket is rewritten as a whole where a row of it changes: choose N so that a bucket is some hundred megabytes.

Defined results: a key that comes twice in an upsert is an error, and so is a null key; a null group is a group; an empty upsert changes
nothing; columns that the stored table lacks are an error.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import fingerprints


class Conflict(RuntimeError):
    """Another writer made the version first; read again and repeat."""


class Store:
    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, key: str, group: str, carried: tuple[str, ...] = (), buckets: int = 16):
        self.spark, self.path, self.key, self.group, self.carried, self.buckets = spark, path.rstrip("/"), key, group, carried, buckets
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        hadoop = spark._jvm.org.apache.hadoop
        self._conf = spark._jsc.hadoopConfiguration()
        self._path = hadoop.fs.Path
        self._files = hadoop.fs.FileContext.getFileContext(self._path(self.path).toUri(), self._conf)
        self._rename = hadoop.fs.Options.Rename

    # -- versions

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.path}/{folder}")
        if not self._files.util().exists(path):
            return []
        return [s.getPath().getName() for s in self._files.util().listStatus(path)]

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self._names("versions") if n.isdigit())

    def _places(self, version: int | None) -> dict[str, str]:
        """bucket -> write of a version, the newest one without a number."""
        known = self.versions()
        version = version if version is not None else known[-1] if known else None
        if version is None:
            return {}
        (row,) = self.spark.read.text(f"{self.path}/versions/{version}", wholetext=True).collect()
        return json.loads(row["value"])

    def _commit(self, version: int, places: dict[str, str]) -> None:
        """Make a version, or fail where it is there already; a rename without overwriting is one step on the stores that Hadoop knows."""
        from_here = self._path(f"{self.path}/pending/{uuid.uuid4().hex}")
        util = self._files.util()
        self._files.mkdir(from_here.getParent(), None, True)
        self._files.mkdir(self._path(f"{self.path}/versions"), None, True)
        fs = from_here.getFileSystem(self._conf)
        out = fs.create(from_here, False)
        out.write(bytearray(json.dumps(places, sort_keys=True).encode()))
        out.close()
        to = self._path(f"{self.path}/versions/{version}")
        never = self.spark.sparkContext._gateway.new_array(self._rename, 1)
        never[0] = self._rename.NONE
        try:
            self._files.rename(from_here, to, never)
        except Exception as problem:
            if util.exists(to):
                raise Conflict(f"version {version} is there already") from problem
            raise

    # -- rows

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self._places(version))

    def _read(self, places: dict[str, str], only: set[str] | None = None) -> DataFrame:
        paths = [f"{self.path}/data/{write}/bucket={b}" for b, write in sorted(places.items()) if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def changed_groups(self, rows: DataFrame, stored: DataFrame) -> DataFrame:
        """Groups of rows whose content differs from what is stored, carried columns aside."""
        plain = [c for c in self.schema.names if c not in self.carried]
        new = fingerprints(rows.select(*plain), self.group).withColumnRenamed("fingerprint", "new")
        old = fingerprints(stored.select(*plain), self.group).withColumnRenamed("fingerprint", "old")
        both = new.alias("n").join(old.alias("o"), F.col(f"n.{self.group}").eqNullSafe(F.col(f"o.{self.group}")), "left")
        return both.filter(~F.col("new").eqNullSafe(F.col("old"))).select(F.col(f"n.{self.group}").alias(self.group))

    def upsert(self, rows: DataFrame) -> tuple[int | None, int]:
        """The newest version after an upsert of whole groups, and how many buckets were written for it."""
        if {c.lower() for c in rows.columns} != {c.lower() for c in self.schema.names}:
            raise ValueError(f"rows have {sorted(rows.columns)}, the table has {sorted(self.schema.names)}")
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])
        bad = rows.groupBy(self.key).agg(F.count(F.lit(1)).alias("n")).filter(F.col(self.key).isNull() | (F.col("n") > 1)).head(1)
        if bad:
            raise ValueError(f"the key {self.key} is null or comes twice: {bad[0][0]}")
        known = self.versions()
        places = self._places(known[-1]) if known else {}
        stored = self._read(places)
        changed = self.changed_groups(rows, stored)
        same = lambda a, b: F.col(f"{a}.{self.group}").eqNullSafe(F.col(f"{b}.{self.group}"))
        coming = rows.alias("r").join(changed.alias("c"), same("r", "c"), "left_semi")
        going = stored.alias("s").join(changed.alias("c"), same("s", "c"), "left_semi")
        # one number a bucket comes to the driver
        touched = {str(r["b"]) for r in coming.select(self._bucket().alias("b")).union(going.select(self._bucket().alias("b"))).distinct().collect()}
        if not touched:
            return (known[-1] if known else None), 0
        before = self._read(places, touched)
        # of the groups that stay as they are, a row whose key now comes in another group goes too
        staying = before.alias("s").join(changed.alias("c"), same("s", "c"), "left_anti").join(coming.select(self.key), self.key, "left_anti").select(*self.schema.names)
        kept = before.select(self.key, *self.carried)
        merged = coming.alias("r").join(kept.alias("k"), F.col(f"r.{self.key}") == F.col(f"k.{self.key}"), "left")
        merged = merged.select(*[F.coalesce(f"k.{c}", f"r.{c}").alias(c) if c in self.carried else F.col(f"r.{c}") for c in self.schema.names])
        write = uuid.uuid4().hex
        whole = staying.unionByName(merged).withColumn("bucket", self._bucket()).hint("rebalance", "bucket")
        whole.write.partitionBy("bucket").parquet(f"{self.path}/data/{write}")
        written = {n.removeprefix("bucket=") for n in self._names(f"data/{write}") if n.startswith("bucket=")}
        # a bucket that lost its last row is named no more
        places = {b: w for b, w in places.items() if b not in touched} | {b: write for b in written}
        number = known[-1] + 1 if known else 1
        self._commit(number, places)
        return number, len(touched)
