"""Sinks: result tables as Parquet or CSV, models and settings as JSON, the stream log."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Parquet; with by, only the partitions that df has are replaced, so repeats and quantiles can be added one by one."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, byte_order_mark: bool = False) -> None:
    """CSV files with a header, in UTF-8; spreadsheets know it by a byte order mark."""
    if byte_order_mark:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    df.write.mode("overwrite").option("header", True).csv(path)


def write_settings(spark: SparkSession, settings: dict, path: str) -> None:
    """One JSON document, in a text file."""
    spark.createDataFrame([(json.dumps(settings, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_settings(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))


def run_once(spark: SparkSession, path: str, settings: dict, stage) -> bool:
    """Runs stage() unless the marker at path says it ran with these settings; True if it ran."""
    try:
        if read_settings(spark, path) == json.loads(json.dumps(settings)):
            return False
    except Exception as e:  # no marker yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    stage()
    write_settings(spark, settings, path)
    return True


def append_once(stream: DataFrame, path: str, checkpoint: str, after_write=None, **options):
    """Appends the rows of a stream to Parquet, each once whatever is repeated; returns the running query.

    A micro-batch is written as the partition of its number, which replaces what an earlier attempt at it left, and is entered in
    a ledger then. read_ledger reads the batches that are entered. after_write(batch) is called in between.
    """

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch_id={batch}")
        if after_write is not None:
            after_write(batch)
        entry = rows.sparkSession.createDataFrame([(batch,)], "batch_id long").coalesce(1)
        entry.write.mode("overwrite").parquet(f"{path}/ledger/entry={batch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).options(**options).start()


def read_ledger(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of append_once, with batch_id, of the batches that were completed."""
    done = spark.read.schema("batch_id long, entry long").parquet(f"{path}/ledger").select("batch_id").distinct()
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch_id", LongType())])).parquet(f"{path}/rows")
    return rows.join(F.broadcast(done), "batch_id")


def stream_log(stream: DataFrame, path: str, checkpoint: str, **options):
    """Appends the rows of a stream to Parquet; returns the running query."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).options(**options).outputMode("append").start()


def pick(summary: DataFrame, **where) -> dict | None:
    """The first row of a small summary table with these values, as a dict; None where there is none."""
    for column, value in where.items():
        summary = summary.where(F.col(column).eqNullSafe(F.lit(value)))
    row = summary.first()
    return row.asDict() if row else None


def digest_line(stage: str, row: dict | None, digits: int = 4) -> str:
    """What one row of a stage's results says, on one line."""
    if row is None:
        return f"{stage}: no result"
    return f"{stage}: " + ", ".join(f"{k}={v:.{digits}g}" if isinstance(v, float) else f"{k}={v}" for k, v in row.items())


def report(df: DataFrame, title: str, digits: int = 4, limit: int = 200) -> str:
    """A plain-text table of the first rows of a small result."""
    rows = [tuple(f"{v:.{digits}f}" if isinstance(v, float) else str(v) for v in r) for r in df.limit(limit).collect()]
    widths = [max(map(len, x)) for x in zip(df.columns, *rows, strict=True)]
    line = lambda r: "  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip()
    return "\n".join([title, "=" * len(title), line(df.columns), *map(line, rows), ""])
