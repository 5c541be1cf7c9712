"""Shared scratch tables: how a plan's lineage is cut so that it survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is ``spark.checkpoint.dir`` where the cluster sets it. Otherwise a plain local session gets a
    temporary folder of its own and a cluster gets a folder in the warehouse, which then must not be a
    folder of one machine.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master.startswith("local") and not master.startswith("local-cluster"):
            found = "file://" + tempfile.mkdtemp(prefix="photolake-")
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
            if found.startswith(("file:", "/")):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


def exists(spark: SparkSession, uri: str, folder: bool = False) -> bool:
    """Whether a file or folder, or only a folder, is there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return there.exists(path) and (not folder or there.getFileStatus(path).isDirectory())


def discard(df: DataFrame) -> None:
    """Remove the files of a table that :func:`materialize` wrote and nothing reads any more."""
    root = shared_dir(df.sparkSession)
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        there = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if there.toUri().getPath().startswith(df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath()):
            there.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it back.

    The result has no lineage but the files, so a lost executor costs no earlier stage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
