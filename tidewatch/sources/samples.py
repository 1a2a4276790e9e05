"""Batch sources: raw samples from CSV or any table, window datasets, saved models."""

from __future__ import annotations

import platform
import subprocess
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.scalar import finite, label_of, micros, seconds
from tidewatch.operators.sessions import infer_step
from tidewatch.schema import SENSOR_CHANNELS, Roles, infer_features, require

SENSOR_ROLES = Roles("TimeStamp", {c: c for c in SENSOR_CHANNELS}, seq="seq", source="source", state="Equipment_state", idle="Idle")
#: Bytes, as a power of two, that no two splits of a file start within.
_SPLIT_BITS = 20


def read_sensor_csv(spark: SparkSession, path: str, source: str = "normal") -> DataFrame:
    """Raw samples of a sensor CSV with a header: bad times are dropped, bad numbers become null.

    Equipment_state (default 1 for fault, else 0) and Idle (default 0) may be missing; has_truth tells whether there is an
    Equipment_state. Column order is free; a byte order mark is skipped. seq follows the order of the file's rows: where
    the row's split starts in the file, then its place in the split.
    """
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    require(raw, ("TimeStamp", *SENSOR_CHANNELS))
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    raw = raw.withColumn("seq", F.shiftleft(F.shiftright(F.col("_metadata.file_block_start"), _SPLIT_BITS), 33) + place)
    number = lambda c, t: F.expr(f"try_cast(`{c}` as {t})")
    state = number("Equipment_state", "double").cast("int") if "Equipment_state" in raw.columns else F.lit(int(source == "fault"))
    idle = number("Idle", "double").cast("int") if "Idle" in raw.columns else F.lit(0)
    return raw.select(
        F.expr("try_cast(TimeStamp as timestamp)").alias("TimeStamp"),
        *(finite(number(c, "double")).alias(c) for c in SENSOR_CHANNELS),
        F.coalesce(state, F.lit(0)).alias("Equipment_state"),
        F.coalesce(idle, F.lit(0)).alias("Idle"),
        F.lit(source).alias("source"),
        "seq",
        F.lit("Equipment_state" in raw.columns).alias("has_truth"),
    ).where("TimeStamp is not null")


def read_sources(spark: SparkSession, normal: str, fault: str) -> DataFrame:
    """Both CSVs, as one table with their source."""
    return read_sensor_csv(spark, normal, "normal").unionByName(read_sensor_csv(spark, fault, "fault"))


def read_external(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of an external run, in the order of its rows; without Equipment_state all states are 0 and has_truth is false."""
    return read_sensor_csv(spark, path, "external")


def to_samples(df: DataFrame, roles: Roles) -> DataFrame:
    """The canonical sample columns of a table. Rows without a time are dropped; channels that aren't finite are null."""
    time = F.expr(roles.time)
    return df.select(
        F.expr(roles.source).alias("source"),
        F.expr(roles.series).alias("series"),
        micros(time).alias("t_us"),
        F.expr(roles.seq).cast("long").alias("seq"),
        *(finite(F.expr(e).cast("double")).alias(c) for c, e in roles.channels.items()),
        F.coalesce(F.expr(roles.state).cast("int"), F.lit(0)).alias("state"),
        F.coalesce(F.expr(roles.idle).cast("int"), F.lit(0)).alias("idle"),
    ).where("t_us is not null")


def quality_counts(raw: DataFrame, channels: tuple[str, ...] = SENSOR_CHANNELS, time: str = "TimeStamp", idle: str = "Idle") -> DataFrame:
    """One row: rows, rows with a valid time, rows with a channel that isn't finite, and idle rows."""
    bad = F.lit(False)
    for c in channels:
        bad = bad | finite(F.col(c).cast("double")).isNull()
    valid = F.col(time).isNotNull()
    count = lambda cond: F.coalesce(F.sum(cond.cast("long")), F.lit(0))
    return raw.agg(F.count(F.lit(1)).alias("rows"), count(valid).alias("valid_times"), count(~valid).alias("invalid_times"), count(valid & bad).alias("invalid_sensors"), count(valid & (F.coalesce(F.col(idle), F.lit(0)) == 1)).alias("idle_rows"))


def assert_finite(samples: DataFrame, channels: tuple[str, ...]) -> DataFrame:
    """samples, which fail when read if a channel is null or not finite."""
    for c in channels:
        samples = samples.withColumn(c, F.coalesce(finite(F.col(c)), F.raise_error(F.lit(f"{c} must be finite")).cast("double")))
    return samples


def read_windows(spark: SparkSession, path: str, features: list[str] | None = None) -> DataFrame:
    """A window dataset (Parquet, or CSV with a header): times parsed, features numeric and finite, labels 0 or 1."""
    if path.endswith(".csv"):
        df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    else:
        df = spark.read.parquet(path)
    require(df, ("window_start", "window_end", "group_id", "source", "label"))
    features = features or infer_features(df)
    times = [c for c in ("window_start", "window_end", "fault_onset_time") if c in df.columns]
    df = df.withColumns({c: F.expr(f"try_cast({c} as timestamp)") for c in times} | {c: finite(F.col(c).cast("double")) for c in features})
    return df.withColumn("label", F.col("label").cast("int")).where(F.col("label").isin(0, 1))


@dataclass(frozen=True)
class Scale:
    """The windows of one length (model and idle ones), the events, and the usual step and length in seconds."""

    windows: DataFrame
    events: DataFrame
    step_sec: float
    window_sec: float


def read_scale(spark: SparkSession, folder: str) -> Scale:
    """The datasets model_windows, idle_windows and event_manifest of a folder."""
    both = read_windows(spark, f"{folder}/model_windows.parquet").unionByName(read_windows(spark, f"{folder}/idle_windows.parquet"), allowMissingColumns=True)
    both = both.withColumns({"start_us": micros(F.col("window_start")), "end_us": micros(F.col("window_end"))})
    found = infer_step(both).first()
    return Scale(both.withColumn("window_sec", F.lit(found["window_sec"])), spark.read.parquet(f"{folder}/event_manifest.parquet"), found["step_sec"], found["window_sec"])


def read_optional(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame | None:
    """A Parquet table, of these columns only; None where there is none."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return df.select(*columns) if columns else df


def line_count(spark: SparkSession, path: str) -> DataFrame:
    """One row: the lines of a text file below its header."""
    return spark.read.text(path).agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(0)).alias("rows"))


def label_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    return df.limit(n)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """For each file the first 16 digits of its SHA-256, for provenance."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.substring(F.sha2("content", 256), 1, 16).alias("sha256"))


def provenance(spark: SparkSession, path: str, code: str | None = None) -> DataFrame:
    """kind, name, value: the digests of the input files, the versions of what they are read with, and the commit of the
    folder `code`."""
    known = [("version", "python", platform.python_version()), ("version", "spark", spark.version), ("version", "numpy", np.__version__), ("version", "pandas", pd.__version__)]
    if code:
        said = subprocess.run(["git", "rev-parse", "--short", "HEAD"], cwd=code, capture_output=True, text=True, timeout=10)
        known.append(("commit", "code", said.stdout.strip() or None))
    files = file_digests(spark, path).select(F.lit("sha256").alias("kind"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("sha256").alias("value"))
    return files.unionByName(spark.createDataFrame(known, "kind string, name string, value string"))


def drop_unknown(samples: DataFrame, channels: tuple[str, ...]) -> DataFrame:
    """samples with all channels known, and t_sec: seconds since the first of them."""
    rows = samples.dropna(subset=list(channels))
    first = rows.agg(F.min("t_us")).first()[0]
    return rows.withColumn("t_sec", seconds(F.col("t_us"), F.lit(first).cast("long")))


def with_label(samples: DataFrame) -> DataFrame:
    return samples.withColumn("label", label_of(F.col("state")))
