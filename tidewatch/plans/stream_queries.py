"""Queries over the events as a stream that arrives in parts, out of order, late and across restarts."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.plans.queries import DETECTOR, EVENT_SAMPLES, GAPS, P2, SEGMENTS, STEP_COLUMNS, TRACKS, final_rows, plain_detector, query, rounded
from tidewatch.plans.star import event_samples, run_parts, table
from tidewatch.sources.scratch import scratch, written
from tidewatch.sources.sinks import append_once, read_ledger
from tidewatch.sources.tail import tail_folder
from tidewatch.streaming.progress import BatchLog, batch_latency, counted, observed
from tidewatch.streaming.stateful import ordered_detection, track_events

DAY = 86_400_000_000
#: 2024-01-01, the day on which arrivals are counted from; a part is what arrives in four days.
START = 1_704_067_200_000_000
PARTS = 10
DELAY_MS = 43_200_000


def arriving(samples: DataFrame) -> DataFrame:
    """samples with part: each event arrives up to six hours after its time, and each 50th five days later."""
    at = F.col("t_us") + F.pmod(F.col("seq") * 7919, F.lit(21_600)) * 1_000_000 + F.when(F.pmod("seq", F.lit(50)) == 0, 5 * DAY).otherwise(0)
    part = F.floor((at - START) / (4 * DAY))
    return samples.withColumn("part", F.least(F.lit(PARTS - 1), F.greatest(F.lit(0), part)).cast("int"))


def ends(samples: DataFrame, days: tuple[int, ...]) -> list[DataFrame]:
    """Parts of one row each, of a series of its own, so many days after the start: they move the watermark past all that waits."""
    row = samples.agg(F.lit("normal").alias("source"), F.lit(-1).cast(samples.schema["series"].dataType).alias("series"))
    fixed = {c: F.lit(0.0) for c in ("value", "k", "spread")} | {"state": F.lit(0), "idle": F.lit(0), "seq": F.lit(0).cast("long")}
    return [row.withColumns(fixed | {"t_us": F.lit(START + d * DAY).cast("long")}).select(*(F.col(c).cast(samples.schema[c].dataType) for c in samples.columns)) for d in days]


ARRIVING = f"""raw AS (SELECT *, least({PARTS - 1}, greatest(0, CAST(floor((t_us + (seq * 7919 % 21600) * 1000000 + CASE WHEN seq % 50 = 0 THEN {5 * DAY} ELSE 0 END - {START}) / {4 * DAY}) AS INT))) AS part FROM samples_all),
  tops AS (SELECT part, max(max(t_us)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM raw GROUP BY part),
  marked AS (SELECT raw.*, coalesce(t_us < (top // 1000 - {DELAY_MS}) * 1000, false) AS late FROM raw JOIN tops USING (part)), samples AS (SELECT * EXCLUDE (part, late) FROM marked WHERE NOT late)"""


@query(f"""WITH {EVENT_SAMPLES.replace('samples AS', 'samples_all AS')}, {ARRIVING}, {GAPS}, {SEGMENTS.format(gap=86400)}, {DETECTOR}
  SELECT source, CAST(series AS VARCHAR) AS series, t_us, seq, segment_id, round(sample_score, 6) AS sample_score, round(short_score, 6) AS short_score, round(long_score, 6) AS long_score, sample_alarm, short_alarm, long_alarm, or_3, final_alarm, CAST(persistence_count AS BIGINT) AS persistence_count, CAST(NULL AS VARCHAR) AS note FROM st
  UNION ALL SELECT source, CAST(series AS VARCHAR), t_us, seq, NULL, 0, NULL, NULL, false, false, false, false, false, 0, 'late' FROM marked WHERE late""")
def stream_reordered(spark, sf_dir):
    """The detector over ten parts that arrive out of order, with a restart before each: as over the rows in order, but for the late ones."""
    samples = event_samples(spark, sf_dir)
    placed = arriving(samples)
    parts = [placed.where(F.col("part") == p).drop("part") for p in range(PARTS)] + ends(samples, (90,))
    steps = run_parts(parts, lambda stream: ordered_detection(stream, plain_detector(), "12 hours"), "reordered").where("series <> '-1'")
    out = rounded(steps.select(*STEP_COLUMNS, "note"))
    return out.withColumn("segment_id", F.when(F.col("note").isNull(), F.col("segment_id")))


@query(f"""WITH {EVENT_SAMPLES}, {GAPS}, {SEGMENTS.format(gap=86400)}, {TRACKS}, {P2}, o AS (SELECT *, kind = 'fault' AS f FROM p2), c AS (SELECT *, sum(CASE WHEN f <> coalesce(pf, false) THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY t_us, seq ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(f) OVER (PARTITION BY series ORDER BY t_us, seq) AS pf FROM o)),
  n AS (SELECT *, row_number() OVER (PARTITION BY series, run ORDER BY t_us, seq) - 1 AS i FROM c WHERE f),
  e AS (SELECT series, run, min(t_us) AS fault_start_us, max(t_us) AS fault_end_us, count(*) AS fault_rows, count(*) FILTER (WHERE final_alarm) AS alarm_rows, min(CASE WHEN final_alarm THEN t_us END) AS first_alarm_us, min(CASE WHEN final_alarm THEN i END) AS delay_samples FROM n GROUP BY 1, 2)
  SELECT CAST(series AS VARCHAR) AS series, row_number() OVER (PARTITION BY series ORDER BY run) AS event_id, fault_start_us, fault_end_us, fault_rows, first_alarm_us IS NOT NULL AS detected, first_alarm_us, round((first_alarm_us - fault_start_us) / 1e6, 6) AS delay_sec, delay_samples, alarm_rows FROM e""")
def stream_events(spark, sf_dir):
    """Events tracked along ten parts of the log, with a restart before each, every one written once."""
    log = final_rows(spark, sf_dir).select("series", "t_us", "seq", "kind", "final_alarm")
    part = F.floor((F.col("t_us") - START) / (3 * DAY))
    placed = log.withColumn("part", F.least(F.lit(PARTS - 1), F.greatest(F.lit(0), part)))
    end = log.agg(F.lit(-1).cast(log.schema["series"].dataType).alias("series")).select("series", F.lit(START + 200 * DAY).cast("long").alias("t_us"), F.lit(0).cast(log.schema["seq"].dataType).alias("seq"), F.lit("normal").alias("kind"), F.lit(False).alias("final_alarm"))
    parts = [placed.where(F.col("part") == p).drop("part") for p in range(PARTS)] + [end]
    return rounded(run_parts(parts, lambda stream: track_events(stream, "60 days", "1 second"), "events"))


def _growing(spark, sf_dir: str, parts: int, name: str):
    """A folder of Parquet files of the events, a function that adds part number p of them, and the stream over it."""
    events, folder = table(spark, sf_dir, "events").select("event_id", "event_type", "value"), scratch(spark, name)
    add = lambda p: events.where(F.pmod("event_id", F.lit(parts)) == p).write.mode("append").parquet(f"{folder}/in")
    return folder, add, lambda: spark.readStream.schema(events.schema).parquet(f"{folder}/in")


@query("SELECT event_type, count(*) AS rows, count(DISTINCT event_id) AS events, 4::BIGINT AS batches FROM events GROUP BY 1")
def exactly_once_log(spark, sf_dir):
    """Four micro-batches, each of which dies once behind its write and is repeated: no row is there twice."""
    folder, add, stream = _growing(spark, sf_dir, 4, "once")
    died: set[int] = set()

    def die_once(batch: int) -> None:
        if batch not in died:
            died.add(batch)
            raise RuntimeError("stopped before the batch was entered")

    for p in range(4):
        add(p)
        for _ in range(2):
            try:
                _finish(append_once(stream(), f"{folder}/log", f"{folder}/state", die_once))
            except StreamingQueryException:
                continue
    rows = read_ledger(spark, f"{folder}/log", stream().schema)
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("event_id").alias("events")).withColumn("batches", F.lit(len(died)).cast("long"))


def _finish(q) -> None:
    """Lets a query do what is there, and stops it; its error is raised."""
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def _watched(spark, sf_dir):
    """The log of a stream over five parts of the events, with counts of what passes."""
    folder, add, stream = _growing(spark, sf_dir, 5, "watched")
    with BatchLog(spark) as log:
        for p in range(5):
            add(p)
            counts = {"errors": F.col("event_type") == "error", "high": F.col("value") >= 60}
            q = observed(stream(), counts).writeStream.format("noop").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
            q.awaitTermination()
            log.wait_for(str(q.runId))
    return log.table()


@query("SELECT count(*) AS rows, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE value >= 60) AS high, 5::BIGINT AS batches FROM events")
def stream_observed_counts(spark, sf_dir):
    """Counters of a running stream, as its batches' progress told them."""
    full = _watched(spark, sf_dir).where("rows > 0")
    return full.agg(F.sum("rows").alias("rows"), F.sum(F.col("observed")["errors"]).alias("errors"), F.sum(F.col("observed")["high"]).alias("high"), F.count(F.lit(1)).alias("batches"))


@query()
def stream_batch_latency(spark, sf_dir):
    """Measured times of micro-batches."""
    return batch_latency(_watched(spark, sf_dir))


@query("SELECT count(*) AS rows, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE value IS NULL) AS without_value FROM events")
def observed_quality(spark, sf_dir):
    """Counters taken beside the main pass, which here writes the rows."""
    rows, seen = counted(table(spark, sf_dir, "events"), {"errors": F.col("event_type") == "error", "without_value": F.col("value").isNull()})
    written(rows, "observed")
    return spark.createDataFrame([tuple(int(seen.get[k] or 0) for k in ("rows", "errors", "without_value"))], "rows long, errors long, without_value long")


@query("SELECT CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS state, count(*) AS rows, round(sum(value), 4) AS total, count(DISTINCT ts) AS times FROM events GROUP BY 1")
def tailed_folder(spark, sf_dir):
    """The events as CSV files of a folder, followed by a stream that reads them on executors."""
    folder = scratch(spark, "tailed")
    rows = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("TimeStamp"), F.col("value").alias("AI0_Vibration"), F.lit(0.0).alias("AI1_Vibration"), F.lit(0.0).alias("AI2_Current"), (F.col("event_type") == "error").cast("int").alias("Equipment_state"), F.lit(0).alias("Idle"))
    rows.write.option("header", True).csv(f"{folder}/in")
    stream = tail_folder(spark, f"{folder}/in/*.csv".removeprefix("file://"))
    _finish(stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").start())
    found = spark.read.schema(stream.schema).parquet(f"{folder}/rows")
    return found.groupBy(F.col("Equipment_state").alias("state")).agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("AI0_Vibration"), 4).alias("total"), F.countDistinct("TimeStamp").alias("times"))
