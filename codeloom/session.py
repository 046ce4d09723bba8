"""Session factory, the settings that the operators rely on, and tables in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(app: str = "codeloom", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings above; keyword settings use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else that of the context.

    Where neither is set a temporary folder is made and set, but only if all executors are threads of this machine; else
    that is an error.
    """
    root, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not root:
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            root = current.get()
        elif context.master == "local" or context.master.startswith("local["):
            root = f"file://{tempfile.mkdtemp(prefix='codeloom-')}"
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(root)
    return root.rstrip("/")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the shared one; it is deleted when the driver's JVM ends."""
    path, context = f"{shared_root(spark)}/{purpose}-{uuid.uuid4().hex}", spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(context._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return path


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows as a table in the shared folder, which cuts the lineage."""
    path = f"{shared_folder(df.sparkSession, purpose)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
