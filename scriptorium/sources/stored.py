"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def settle(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder in spark.checkpoint.dir and read again: what is used several times is computed once.

    In local mode, as in tests, a folder of our own takes the place of an absent setting; on a cluster,
    whose executors would then write to disks of their own, that is an error.
    """
    path = _place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """As :func:`settle`, dealt out by ``key``: what groups or joins such tables by the key and others moves no rows.

    For keys with few rows each. The session then lets joins use a dealing by some of their keys.
    """
    spark = df.sparkSession
    path, n = _place(spark, name), int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table)


def _place(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="scriptorium-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
