"""Tables that a job writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, or a temporary one in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidewatch-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
    """df written as Parquet and read again: computed once, and the same for each reader whatever executors are lost.

    group_rows: rows of a Parquet row group at most, where single values are large, as a reader takes thousands of rows of a group at once.
    """
    path = scratch(df.sparkSession, name)
    writer = df.write if group_rows is None else df.write.option("parquet.block.row.count.limit", str(group_rows))
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
