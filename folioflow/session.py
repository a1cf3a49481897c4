"""Session and storage helpers shared by the whole engine."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def local_session(cores: int | str = "*", app: str = "folioflow", **extra: str) -> SparkSession:
    """A single-machine session for tests and benchmarks; a cluster brings its own settings."""
    conf = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        # small files still make a task for each core
        "spark.sql.files.openCostInBytes": "512k",
    } | extra
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the catalogue's tables; only Spark opens the path, so any store it can read will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; where it names none, a temporary one for a session on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='folioflow-')}"
    return _OWN[context.applicationId]


#: Bytes of an Arrow batch where whole files or texts travel in it.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session hold BATCH_BYTES at most, or one row; a bound that it has already stays. No result depends on where batches end."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def materialise(df: DataFrame, tag: str, **options: str | int) -> DataFrame:
    """A table written to the shared folder and read back: lineage ends there, and a lost executor costs nothing that was done before. options are the writer's."""
    path = f"{shared_folder(df.sparkSession)}/folioflow/{tag}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
