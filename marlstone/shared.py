"""Tables that driver and executors pass to each other through the folder that they share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from marlstone.shipping import ship

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of the warehouse, or on a single machine a temporary one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local:")) and spark.sparkContext.master != "local":
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/marlstone-tables"
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="marlstone-"))
    return _own_dir[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again.

    Cuts lineage in a way that outlives lost executors: the files are in shared
    storage and a task that is run twice writes its part once.
    """
    spark = df.sparkSession
    ship(spark)
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
