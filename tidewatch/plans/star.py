"""Roles of the star-schema tables: which of their columns serve as stream, channels, state and idle mark."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tidewatch.operators.sessions import sessionize
from tidewatch.schema import Roles, Settings
from tidewatch.sources.samples import to_samples
from tidewatch.sources.scratch import scratch
from tidewatch.streaming.detector import BUCKETS
from tidewatch.streaming.stateful import ROCKS

#: A day between events of a user and kind breaks a segment; errors are the fault source, views the idle rows.
EVENTS = Roles(
    "ts",
    {"value": "value", "k": "cast(get_json_object(props, '$.k') as double)", "spread": "value - cast(get_json_object(props, '$.k') as double)"},
    series="user_id",
    seq="event_id",
    source="case when event_type = 'error' then 'fault' else 'normal' end",
    state="case when event_type = 'error' then 1 else 0 end",
    idle="case when event_type = 'view' then 1 else 0 end",
)
EVENT_SETTINGS = Settings(gap_sec=86_400.0, window_sec=86_400.0, step_sec=21_600.0, sampling_sec=34_560.0, short_size=3, long_size=5, quantile=0.95, channels=("value", "k", "spread"))

#: Ten days between shipments of a supplier break a segment; returned lines are the fault source, open lines idle.
LINES = Roles(
    "l_shipdate",
    {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount"},
    series="l_suppkey",
    seq="l_orderkey * 1000000000 + l_linenumber * 100000000 + l_partkey",
    source="case when l_returnflag = 'R' then 'fault' else 'normal' end",
    state="case when l_returnflag = 'R' then 1 else 0 end",
    idle="case when l_linestatus = 'O' then 1 else 0 end",
)
LINE_SETTINGS = Settings(gap_sec=864_000.0, window_sec=864_000.0, step_sec=172_800.0, sampling_sec=172_800.0, quantile=0.99, channels=("quantity", "price", "discount"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_samples(table(spark, sf_dir, "events"), EVENTS)


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessionize(event_samples(spark, sf_dir), EVENT_SETTINGS.gap_sec)


def line_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_samples(table(spark, sf_dir, "lineitem"), LINES)


def line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessionize(line_samples(spark, sf_dir), LINE_SETTINGS.gap_sec)


@contextmanager
def stream_conf(spark: SparkSession, **also: str) -> Iterator[None]:
    """Settings of the session while streams run. Each partition of a stateful step opens and writes a state of its own in each micro-batch, so there is
    one for each core, and none of them is without a bucket of series."""
    conf = {"spark.sql.shuffle.partitions": str(max(1, min(BUCKETS, spark.sparkContext.defaultParallelism))), **also}
    before = {c: spark.conf.get(c) for c in conf}
    try:
        for c, value in conf.items():
            spark.conf.set(c, value)
        yield
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)


def run_stream(stream: DataFrame, name: str) -> DataFrame:
    """What a stream over the files that are there gives in append mode, as a table."""
    spark, folder = stream.sparkSession, scratch(stream.sparkSession, name)
    with stream_conf(spark):
        stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def run_parts(parts: list[DataFrame], build: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """What build(stream) gives in append mode for parts that arrive one after another, as a table.

    The stream is started anew from its checkpoint for each part, so each is a micro-batch of its own behind a restart. Typed state
    is kept in the RocksDB store, which the session is set to meanwhile.
    """
    spark = parts[0].sparkSession
    folder = scratch(spark, name)
    with stream_conf(spark, **{"spark.sql.streaming.stateStore.providerClass": ROCKS}):
        for part in parts:
            part.write.mode("append").parquet(f"{folder}/in")
            out = build(spark.readStream.schema(parts[0].schema).parquet(f"{folder}/in"))
            out.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/rows")
