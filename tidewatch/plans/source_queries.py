"""Queries on sources and sinks: the events written as sensor files, window datasets and models, with unknown values, and read again."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scalar import micros, seconds
from tidewatch.operators import analysis, windows
from tidewatch.operators.models import fit_gaussians
from tidewatch.plans.queries import EV_ROWS, STEP_COLUMNS, STEPS, plain_detector, query, rounded
from tidewatch.plans.star import EVENT_SETTINGS, event_rows, event_samples, run_stream, table
from tidewatch.sources import samples, sinks
from tidewatch.sources.scratch import scratch, written
from tidewatch.streaming.detector import Detector, detect, feature_snapshot, replay, write_replay

DAY = 86_400_000_000

# sensor files, in which some times and channels can't be read

SENSORS = """raw AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
  sensors AS (SELECT CASE WHEN k = 7 THEN NULL ELSE epoch_us(ts) END AS t_us, CASE WHEN k = 50 THEN NULL ELSE value END AS vibration_0, CASE WHEN k = 3 THEN NULL ELSE CAST(k AS DOUBLE) END AS vibration_1,
    CASE WHEN k = 11 THEN NULL ELSE value - k END AS current_2, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END::BIGINT AS state, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END::BIGINT AS idle, CASE WHEN event_type = 'error' THEN 'fault' ELSE 'normal' END AS source FROM raw)"""


def sensor_table(spark, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    is_kind = lambda kind: (F.col("event_type") == kind).cast("int")
    return table(spark, sf_dir, "events").select(
        F.when(k == 7, "no time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("TimeStamp"),
        F.when(k == 50, None).otherwise(F.col("value")).alias("AI0_Vibration"),
        F.when(k == 3, "NaN").otherwise(k.cast("string")).alias("AI1_Vibration"),
        F.when(k == 11, "broken").otherwise((F.col("value") - k).cast("string")).alias("AI2_Current"),
        is_kind("error").alias("Equipment_state"),
        is_kind("view").alias("Idle"),
    )


def sensor_files(spark, sf_dir: str) -> tuple[str, str]:
    """The normal and the fault rows as CSVs; the first with byte order marks."""
    rows, folder = sensor_table(spark, sf_dir), scratch(spark, "sensors")
    sinks.write_csv(rows.where("Equipment_state = 0"), f"{folder}/normal.csv", byte_order_mark=True)
    sinks.write_csv(rows.where("Equipment_state = 1"), f"{folder}/fault.csv")
    return f"{folder}/normal.csv", f"{folder}/fault.csv"


def _sensor_columns(rows: DataFrame) -> DataFrame:
    names = {"AI0_Vibration": "vibration_0", "AI1_Vibration": "vibration_1", "AI2_Current": "current_2", "Equipment_state": "state", "Idle": "idle"}
    return rounded(rows.select(micros(F.col("TimeStamp")).alias("t_us"), *(F.col(c).alias(n) for c, n in names.items()), "source", "has_truth"))


_VALUES = "t_us, round(vibration_0, 6) AS vibration_0, round(vibration_1, 6) AS vibration_1, round(current_2, 6) AS current_2"


@query(f"WITH {SENSORS} SELECT {_VALUES}, state, idle, source, true AS has_truth FROM sensors WHERE t_us IS NOT NULL")
def sensor_csv_samples(spark, sf_dir):
    return _sensor_columns(samples.read_sources(spark, *sensor_files(spark, sf_dir)))


@query(f"WITH {SENSORS} SELECT {_VALUES}, 0::BIGINT AS state, idle, 'external' AS source, false AS has_truth FROM sensors WHERE t_us IS NOT NULL")
def external_csv_samples(spark, sf_dir):
    """A run without a known state."""
    path = scratch(spark, "external")
    sinks.write_csv(sensor_table(spark, sf_dir).drop("Equipment_state"), path)
    return _sensor_columns(samples.read_external(spark, path))


@query(f"WITH {SENSORS} SELECT count(*) AS rows, count(*) AS valid_times, 0::BIGINT AS invalid_times, count(*) FILTER (WHERE vibration_0 IS NULL OR vibration_1 IS NULL OR current_2 IS NULL) AS invalid_sensors, count(*) FILTER (WHERE idle = 1) AS idle_rows FROM sensors WHERE t_us IS NOT NULL")
def sensor_csv_quality(spark, sf_dir):
    return rounded(samples.quality_counts(samples.read_sources(spark, *sensor_files(spark, sf_dir))))


# samples with unknown channels

UNKNOWN = f"""{EV_ROWS}, u AS (SELECT source, series, t_us, seq, CASE WHEN k = 50 THEN NULL ELSE value END AS value, CASE WHEN k = 3 THEN NULL ELSE k END AS k FROM seg_rows)"""


def unknown_samples(spark, sf_dir: str) -> DataFrame:
    rows, k = event_samples(spark, sf_dir), F.col("k")
    return rows.withColumns({"value": F.when(k == 50, None).otherwise(F.col("value")), "k": F.when(k == 3, None).otherwise(k)})


@query(f"WITH {UNKNOWN} SELECT source, seq, round((t_us - min(t_us) OVER ()) / 1e6, 6) AS t_sec, round(value, 6) AS value, k FROM u WHERE value IS NOT NULL AND k IS NOT NULL")
def known_samples(spark, sf_dir):
    """Rows with unknown channels are dropped; those that are left are finite, or reading them fails."""
    rows = samples.drop_unknown(unknown_samples(spark, sf_dir), ("value", "k"))
    return rounded(samples.assert_finite(rows, ("value", "k")).select("source", "seq", "t_sec", "value", "k"))


@query(f"""WITH {UNKNOWN}, f AS (SELECT source, 'value' AS feature, value AS v FROM u UNION ALL SELECT source, 'k', k FROM u), m AS (SELECT source, feature, median(v) AS median FROM f GROUP BY ALL),
  x AS (SELECT source, feature, median, coalesce(v, median) AS v FROM f JOIN m USING (source, feature))
  SELECT source, feature, round(median, 6) AS median, round(avg(sign(v) * ln(1 + abs(v))), 6) AS mean FROM x GROUP BY ALL""")
def imputed_models(spark, sf_dir):
    """Models by source in which medians stand in for what is unknown."""
    rows = unknown_samples(spark, sf_dir)
    models = fit_gaussians(rows, ["value", "k"], ["source"], "empirical", among=rows)
    found = [(key[0], f, m.medians[i], m.location[i]) for key, m in models.items() for i, f in enumerate(m.features)]
    return rounded(spark.createDataFrame(found, "source string, feature string, median double, mean double"))


# window datasets: a window a user and day, with unknown features where it holds one row

DAYS = f"""days AS (SELECT CAST(user_id AS VARCHAR) AS group_id, CAST(floor(epoch_us(ts) / {DAY}) AS BIGINT) AS day, count(*) AS sample_count, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 AS actual_duration_sec,
    CASE WHEN count(*) > 1 THEN (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 END AS max_gap_sec, avg(value) AS ai0_mean, stddev_samp(value) AS ai0_std, max(CASE WHEN event_type = 'error' THEN value END) AS ai1_max,
    count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY ALL),
  described AS (SELECT *, CASE WHEN sample_count % 4 = 0 THEN 2 WHEN errors > 0 THEN 1 ELSE 0 END AS label, CASE WHEN views * 2 >= sample_count THEN 1 ELSE 0 END AS idle_majority,
    CASE WHEN views = sample_count THEN 'EXCLUDED_IDLE' WHEN sample_count = 1 THEN 'EXCLUDED_SHORT' ELSE 'TRAIN' END AS split FROM days),
  stored AS (SELECT * FROM described WHERE label IN (0, 1))"""
_WINDOW = "group_id, day, sample_count, label::BIGINT AS label, round(ai0_mean, 4) AS ai0_mean, round(ai0_std, 4) AS ai0_std, round(ai1_max, 4) AS ai1_max"


def day_windows(spark, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").withColumn("t_us", micros(F.col("ts")))
    n, kind = F.count(F.lit(1)), F.col("event_type")
    span = seconds(F.max("t_us"), F.min("t_us"))
    days = ev.groupBy(F.col("user_id").cast("string").alias("group_id"), F.floor(F.col("t_us") / DAY).alias("day")).agg(
        n.alias("sample_count"),
        span.alias("actual_duration_sec"),
        F.when(n > 1, span).alias("max_gap_sec"),
        F.avg("value").alias("ai0_mean"),
        F.when(n > 1, F.stddev_samp("value")).alias("ai0_std"),
        F.max(F.when(kind == "error", F.col("value"))).alias("ai1_max"),
        F.count(F.when(kind == "view", 1)).alias("views"),
        F.count(F.when(kind == "error", 1)).alias("errors"),
    )
    label = F.when(F.col("sample_count") % 4 == 0, 2).when(F.col("errors") > 0, 1).otherwise(0)
    split = F.when(F.col("views") == F.col("sample_count"), "EXCLUDED_IDLE").when(F.col("sample_count") == 1, "EXCLUDED_SHORT").otherwise("TRAIN")
    idle = (F.col("views") * 2 >= F.col("sample_count")).cast("int")
    times = {f"window_{e}": F.timestamp_micros((F.col("day") + i) * DAY) for i, e in enumerate(("start", "end"))}
    return days.withColumns({"label": label, "split": split, "idle_majority": idle, "source": F.lit("normal")} | times).drop("views", "errors")


def stored_windows(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "windows") + ".parquet"
    sinks.write_table(day_windows(spark, sf_dir), path)
    return samples.read_windows(spark, path, ["ai0_mean", "ai0_std", "ai1_max"])


def _window_columns(df: DataFrame) -> DataFrame:
    day = F.floor(micros(F.col("window_start")) / DAY).alias("day")
    return rounded(df.select(F.col("group_id").cast("string").alias("group_id"), day, "sample_count", "label", "ai0_mean", "ai0_std", "ai1_max"), 4)


@query(f"WITH {DAYS} SELECT {_WINDOW} FROM stored")
def window_dataset_csv(spark, sf_dir):
    """A window dataset as CSV: times parsed, features numeric, labels 0 or 1 only."""
    path = scratch(spark, "windows") + ".csv"
    sinks.write_csv(day_windows(spark, sf_dir), path)
    return _window_columns(samples.read_windows(spark, path, ["ai0_mean", "ai0_std", "ai1_max"]))


@query(f"WITH {DAYS} SELECT {_WINDOW} FROM stored WHERE ai0_std IS NOT NULL AND ai1_max IS NOT NULL AND max_gap_sec IS NOT NULL")
def complete_windows(spark, sf_dir):
    return _window_columns(windows.drop_incomplete(stored_windows(spark, sf_dir), ["ai0_mean", "ai0_std", "ai1_max"]))


@query(f"WITH {DAYS} SELECT 'model' AS part, {_WINDOW} FROM stored WHERE idle_majority = 0 AND split NOT IN ('EXCLUDED_IDLE', 'EXCLUDED_SHORT') UNION ALL SELECT 'idle', {_WINDOW} FROM stored WHERE split = 'EXCLUDED_IDLE'")
def model_and_idle_windows(spark, sf_dir):
    model, idle = (_window_columns(w) for w in windows.split_idle(stored_windows(spark, sf_dir)))
    return model.withColumn("part", F.lit("model")).unionByName(idle.withColumn("part", F.lit("idle")))


@query(f"WITH {DAYS} SELECT CAST(label AS BIGINT) AS label, f AS feature, count(v) AS known FROM (SELECT label, unnest(['ai0_mean', 'ai0_std', 'ai1_max']) AS f, unnest([ai0_mean, ai0_std, ai1_max]) AS v FROM stored) GROUP BY ALL")
def inferred_feature_coverage(spark, sf_dir):
    """The feature columns, by type and name, and their known values."""
    rows = stored_windows(spark, sf_dir)
    return rounded(analysis.feature_coverage(rows, samples.infer_features(rows, expect=None), "label"))


@query(f"""WITH {DAYS}, s AS (SELECT day - lag(day) OVER (PARTITION BY group_id ORDER BY day) AS step FROM stored WHERE (idle_majority = 0 AND split NOT LIKE 'EXCLUDED%') OR split = 'EXCLUDED_IDLE')
  SELECT windows, (SELECT count(DISTINCT group_id) FROM stored WHERE label = 1) AS events, step_sec, 86400.0::DOUBLE AS window_sec FROM (SELECT count(*) AS windows, round(86400 * median(step), 6) AS step_sec FROM s)""")
def stored_scale(spark, sf_dir):
    """The datasets of a scale written as a folder, and read as one."""
    folder, rows = scratch(spark, "scale"), stored_windows(spark, sf_dir)
    model, idle = windows.split_idle(rows)
    sinks.write_table(_features16(model), f"{folder}/model_windows.parquet")
    sinks.write_table(_features16(idle), f"{folder}/idle_windows.parquet")
    sinks.write_table(rows.where("label = 1").select("group_id").distinct(), f"{folder}/event_manifest.parquet")
    scale = samples.read_scale(spark, folder)
    ones = lambda df, windows, events: df.select(F.lit(windows).alias("windows"), F.lit(events).alias("events"))
    found = ones(scale.windows, 1, 0).unionByName(ones(scale.events, 0, 1)).agg(F.sum("windows").alias("windows"), F.sum("events").alias("events"))
    return rounded(found.withColumns({"step_sec": F.lit(scale.step_sec), "window_sec": F.lit(scale.window_sec)}))


def _features16(df: DataFrame) -> DataFrame:
    """df with the 16 features that a scale's datasets must have; those that it lacks are 0."""
    return df.withColumns({f"ai2_{i}": F.lit(0.0) for i in range(13)})


# sinks, markers, models


@query("SELECT event_type, user_id, CASE WHEN event_type = 'error' THEN count(*) ELSE 0 END AS n FROM events GROUP BY event_type, user_id")
def replaced_partitions(spark, sf_dir):
    """A partitioned table of which one partition is written again: the others stay."""
    path, ev = scratch(spark, "parts"), table(spark, sf_dir, "events")
    counts = ev.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    sinks.write_table(counts.withColumn("n", F.lit(0).cast("long")), path, ["event_type"])
    sinks.write_table(counts.where("event_type = 'error'"), path, ["event_type"])
    return spark.read.schema("user_id long, n long, event_type string").parquet(path)


@query("SELECT event_type, n, 'events: event_type=' || event_type || ', n=' || n || ', users=' || users AS line, true AS first_ran, false AS second_ran FROM (SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE event_type = 'error' GROUP BY 1)")
def stage_marker(spark, sf_dir):
    """A stage that runs once for its settings, and a line that says what it found."""
    ev, folder = table(spark, sf_dir, "events"), scratch(spark, "stage")
    counts = written(ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users")), "counts")
    row = sinks.pick(counts, event_type="error")
    if row is None:
        return spark.createDataFrame([], "event_type string, n long, line string, first_ran boolean, second_ran boolean")
    stage = lambda: sinks.write_settings(spark, row, f"{folder}/result")
    ran = [sinks.run_once(spark, f"{folder}/marker", {"kind": "error"}, stage) for _ in range(2)]
    again = sinks.read_settings(spark, f"{folder}/result")
    line = sinks.digest_line("events", {k: again[k] for k in ("event_type", "n", "users")})
    return spark.createDataFrame([(again["event_type"], again["n"], line, *ran)], "event_type string, n long, line string, first_ran boolean, second_ran boolean")


@query(STEPS + " FROM st")
def saved_detection(spark, sf_dir):
    """A detector written as JSON and read again."""
    path = scratch(spark, "detector")
    sinks.write_settings(spark, json.loads(plain_detector().to_json()), path)
    detector = Detector.from_json(json.dumps(sinks.read_settings(spark, path)))
    out = detect(event_rows(spark, sf_dir), detector).withColumn("series", F.col("series").cast("string"))
    return rounded(out.select(*STEP_COLUMNS))


@query(f"WITH {EV_ROWS} SELECT source, series, t_us, seq, round(value, 6) AS value, k, CAST(state AS BIGINT) AS state, CAST(idle AS BIGINT) AS idle FROM seg_rows")
def replayed_samples(spark, sf_dir):
    """The events written by parts of thirty days and replayed as a stream, a part a trigger."""
    rows, path = event_samples(spark, sf_dir), scratch(spark, "replay")
    write_replay(rows, path, 30 * 86_400.0)
    return rounded(run_stream(replay(rows, path), "replayed").select("source", "series", "t_us", "seq", "value", "k", "state", "idle"))


def _snapshot(prefix: str, size: int) -> str:
    over = f"OVER (PARTITION BY group_id ORDER BY t_us, seq ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW)"
    full = f"count(*) {over} = {size}"
    of = lambda x: {"mean": f"avg({x}) {over}", "std": f"stddev_samp({x}) {over}", "rms": f"sqrt(avg({x} * {x}) {over})", "ptp": f"max({x}) {over} - min({x}) {over}"}
    return ", ".join(f"round(CASE WHEN {full} THEN {v} END, 4) AS {prefix}_{x}_{k}" for x in EVENT_SETTINGS.channels for k, v in of(x).items())


@query(f"WITH {EV_ROWS} SELECT group_id, t_us, seq, {_snapshot('short', EVENT_SETTINGS.short_size)}, {_snapshot('long', EVENT_SETTINGS.long_size)} FROM seg_rows")
def row_feature_snapshot(spark, sf_dir):
    out = feature_snapshot(event_rows(spark, sf_dir), EVENT_SETTINGS)
    names = [f"{p}_{x}_{k}" for p in ("short", "long") for x in EVENT_SETTINGS.channels for k in ("mean", "std", "rms", "ptp")]
    return rounded(out.select("group_id", "t_us", "seq", *names), 4)
