"""Cutting the lineage of iterative jobs, and tables that lie beside a job in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares: spark.checkpoint.dir, or the one set by setCheckpointDir. A local one only where none is set and Spark runs on one machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("tessera.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("tessera.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Spark's setting that a query's shuffle files go as soon as it has ended. Without it they stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again. Shuffle files of the job that writes it are deleted when it has ended."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_stored"] = path
    return out


def cut(df: DataFrame) -> DataFrame:
    """The rows without their lineage: a table in the shared folder, in compressed columns. A checkpoint holds whole rows, many times the size, and makes its last stage twice."""
    return stored(df, "cut")


def owning(df: DataFrame, table: DataFrame) -> DataFrame:
    """Rows made from a stored table and from nothing else, to be given to dropped() in its place."""
    df.__dict__["_stored"] = table.__dict__["_stored"]
    return df


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that stored() or cut() made, where nothing reads them any more. Loops call it, so that they take the disk of a step and not of all steps."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.__dict__["_stored"])
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
