"""Session settings the transforms are written for."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

#: Runtime SQL settings.  AQE sizes the reducers, turns small sides into
#: broadcast joins from *measured* shuffle sizes, and splits skewed join
#: partitions; the rest pins date semantics.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(app: str = "stratafin", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Folder of a local session whose configuration names none, per application.
_LOCAL_FOLDERS: dict[str, str] = {}


def stage_folder(spark: SparkSession) -> str:
    """Shared folder for staged tables: the one the cluster names in
    ``spark.checkpoint.dir``.  Only a local session without that setting gets a
    folder of its own; elsewhere the missing setting is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is not None:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="stratafin-")
    return _LOCAL_FOLDERS[context.applicationId]


def stage(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a table once to the shared folder and read it back.

    Used where a derived table feeds several branches (ranks, as-of joins,
    configuration fan-out).  The branches then scan columns of a stored table
    instead of repeating the whole derivation, the plan stays short, and a lost
    executor costs a re-read, not a recomputation from the raw tables.
    """
    spark = df.sparkSession
    path = f"{stage_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_stages(spark: SparkSession) -> None:
    """Delete what this application has staged.  Call it when no result that reads a staged table is
    still to be computed."""
    jvm, folder = spark._jvm, f"{stage_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}"
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
