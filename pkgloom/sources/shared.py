"""Tables and files in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme that it has by default, as other libraries than Spark's name it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file:///" + out[len("file:") :].lstrip("/") if out.startswith("file:") else out


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset the warehouse, and in local mode a temporary folder. A warehouse on the
    machines' own disks is refused on a cluster, as executors would not see each other's files."""
    path = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_pkgloom_files", None)
    if path is None:
        master = spark.sparkContext.master
        if master.startswith("local") and not master.startswith("local-cluster"):
            path = spark._pkgloom_files = f"file://{tempfile.mkdtemp(prefix='pkgloom-')}"
        else:
            path = spark.conf.get("spark.sql.warehouse.dir")
            if qualified(spark, path).startswith("file:"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return qualified(spark, path).rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{folder(spark)}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written once as Parquet and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, "table")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop(*tables: DataFrame) -> None:
    """Deletes what stored() wrote, once nothing that is still to run reads it."""
    for df in tables:
        remove(df.sparkSession, df._stored_at)
