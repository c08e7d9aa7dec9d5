"""Session settings the jobs rely on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Read at run time by the jobs; none of them is about sizing, which stays with
# whoever owns the cluster.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # the CSV reader refuses windows-1252 without it
    "spark.sql.legacy.javaCharsets": "true",
}


# Fixed when the session starts: call sites are not recorded for every column
# expression, which is most of the time it takes to build the extraction plans.
START_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def prepare_session(spark: SparkSession) -> SparkSession:
    """Apply the settings the jobs need to a session that already exists."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


# Only for sessions whose executors live in the driver's own process.
LOCAL_SCRATCH = "/tmp/checkpoints"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    A local session without that setting gets a fixed folder; any other session
    without it is refused, because executors could not see each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = LOCAL_SCRATCH
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; Spark's file system drops it when the driver ends."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    handle = spark._jvm.org.apache.hadoop.fs.Path(path)
    handle.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(handle)
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder made by :func:`scratch_folder` whose readers are done."""
    handle = spark._jvm.org.apache.hadoop.fs.Path(path)
    handle.getFileSystem(spark._jsc.hadoopConfiguration()).delete(handle, True)


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a result below the shared folder and read it back: computed once, lineage cut.

    ``options`` are those of the Parquet writer, such as ``compression``."""
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def build_session(
    app_name: str = "listingloom", master: str | None = None, conf: dict[str, str] | None = None
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **START_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return prepare_session(builder.getOrCreate())
