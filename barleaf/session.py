"""Session settings and the shared folder used to cut long plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "8", app: str = "barleaf", **extra: str) -> SparkSession:
    """Session for tests and the bench; a cluster job brings its own session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **extra,
    }
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a scratch one only where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="barleaf-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


_stages: dict[tuple[str, str], str] = {}


def staged(spark: SparkSession, key: str, build) -> DataFrame:
    """Write ``build()`` once per application as Parquet and read it back.

    The written table replaces the plan behind it: later readers prune columns
    and push filters into it, and a lost executor costs one re-read, not the
    whole chain of windows.
    """
    slot = (spark.sparkContext.applicationId, key)
    if slot not in _stages:
        path = f"{shared_folder(spark)}/stage-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:12]}"
        build().write.option("compression", "zstd").parquet(path)
        _stages[slot] = path
    return spark.read.parquet(_stages[slot])


def written(df: DataFrame) -> DataFrame:
    """Write to the shared folder as Parquet and read back: for wide rows of which later steps read some columns."""
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (never an executor-local one)."""
    shared = shared_folder(df.sparkSession)
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared)
    return df.checkpoint()
