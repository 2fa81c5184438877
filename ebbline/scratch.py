"""Folders and tables for intermediate results, which driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class ScratchError(RuntimeError):
    """A cluster without a shared folder."""


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir.

    Where that setting is absent, a session on one machine (master local) takes a folder
    below the warehouse; on a cluster it is an error, as a local folder there is not shared.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master or ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ScratchError("spark.checkpoint.dir must name a folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there and survives lost executors. It is deleted when the driver ends."""
    spark = df.sparkSession
    target = shared_dir(spark, label)
    df.write.parquet(target)
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(target)
