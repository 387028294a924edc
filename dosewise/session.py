"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: With a `local[...]` master driver and executors are one process, so any folder is shared.
LOCAL_MASTER_FOLDER = "/tmp/checkpoints"

#: What `tune` sets in the caller's session.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # rows and bytes handed to a Python worker at once
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}

_stages: list[str] = []


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings the joins rely on: AQE splits hot keys even where the
    split costs one more exchange. Dates are compared in UTC."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Unset, it is an error on a cluster;
    only a `local[...]` master falls back to LOCAL_MASTER_FOLDER."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return LOCAL_MASTER_FOLDER
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name below the shared folder, deleted by `release_stages`
    or when the driver's Python ends."""
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    if not _stages:
        atexit.register(_release_at_exit)
    _stages.append(path)
    return path


def stage(df: DataFrame) -> DataFrame:
    """df written once as Parquet to the shared folder and read back with its
    own schema: lineage is cut and lost executors re-read the files."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_so_far() -> int:
    """How many staged tables there are."""
    return len(_stages)


def release_stages(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Delete the staged tables written so far (from the since-th on, but for the
    last keep ones): call it when no DataFrame reads them any more. Returns how many went."""
    gone = 0
    stop = len(_stages) - keep
    for path in _stages[since:stop]:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
        gone += bool(fs.delete(target, True))
    del _stages[since:stop]
    return gone


def _release_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        release_stages(spark)
