"""The queries over the star-schema tables, each with its SQL where SQL can express it.

Every query is a function of (spark, sf_dir) registered by @query, with the DuckDB text of the same rows. Doubles are
rounded in both, as sums differ in their last digits by order.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions import scalar
from tidewatch.operators import alarms, analysis, metrics, sessions, splits, thresholds, windows
from tidewatch.operators.models import Gaussian, fit_forest, fit_gaussian
from tidewatch.plans.star import EVENT_SETTINGS, EVENTS, LINE_SETTINGS, event_rows, event_samples, line_rows, line_samples, run_stream, table
from tidewatch.sources.samples import drop_unknown, quality_counts, to_samples
from tidewatch.sources.scratch import written
from tidewatch.streaming.detector import Detector, detect, detect_stream, features_of, running_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = " ".join(sql.split())
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """df with doubles rounded, and counts as long."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c).cast("bigint").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes))


# the common parts of the SQL

EVENT_SAMPLES = """samples AS (
  SELECT CASE WHEN event_type = 'error' THEN 'fault' ELSE 'normal' END AS source, user_id AS series, epoch_us(ts) AS t_us, event_id AS seq,
    value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, value - CAST(json_extract_string(props, '$.k') AS DOUBLE) AS spread,
    CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS state, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS idle
  FROM events)"""
LINE_SAMPLES = """samples AS (
  SELECT CASE WHEN l_returnflag = 'R' THEN 'fault' ELSE 'normal' END AS source, l_suppkey AS series, epoch_us(l_shipdate) AS t_us,
    l_orderkey * 1000000000 + l_linenumber * 100000000 + l_partkey AS seq,
    l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount,
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS state, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS idle
  FROM lineitem)"""
GAPS = """gaps AS (
  SELECT *, (t_us - lag(t_us) OVER (PARTITION BY source, series ORDER BY t_us, seq)) / 1e6 AS gap_sec FROM samples)"""
SEGMENTS = """numbered AS (
  SELECT *, CAST(sum(CASE WHEN gap_sec > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY source, series ORDER BY t_us, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment_id FROM gaps),
  seg_rows AS (
  SELECT *, source || '_' || series || '_' || segment_id AS group_id,
    CASE WHEN source = 'fault' THEN 'fault' WHEN avg(CASE WHEN idle = 1 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY source, series, segment_id) >= 0.5 THEN 'idle' ELSE 'normal' END AS kind,
    CASE WHEN state >= 1 THEN 1 ELSE 0 END AS label FROM numbered)"""
EV_ROWS = f"{EVENT_SAMPLES}, {GAPS}, {SEGMENTS.format(gap=86400)}"
LI_ROWS = f"{LINE_SAMPLES}, {GAPS}, {SEGMENTS.format(gap=864000)}"
MANIFEST = """manifest AS (
  SELECT source, series, segment_id, group_id, min(t_us) AS start_us, max(t_us) AS end_us, (max(t_us) - min(t_us)) / 1e6 AS duration_sec, count(*) AS n_rows,
    max(CASE WHEN NOT first_row THEN gap_sec END) AS max_gap_sec, avg(CASE WHEN idle = 1 THEN 1.0 ELSE 0.0 END) AS idle_ratio,
    CASE WHEN avg(CASE WHEN idle = 1 THEN 1.0 ELSE 0.0 END) >= 0.5 THEN 1 ELSE 0 END AS idle_majority,
    CASE WHEN avg(CASE WHEN state >= 1 THEN 1.0 ELSE 0.0 END) >= 0.5 THEN 1 ELSE 0 END AS label, min(CASE WHEN state >= 1 THEN t_us END) AS onset_us
  FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY t_us, seq) = 1 AS first_row FROM seg_rows) GROUP BY ALL)"""
#: Fixed-threshold alarms of three channels stand in for the detectors in queries on combinations.
TRACKS = """tracks AS (
  SELECT *, value >= 60 AS long_alarm, k >= 70 AS short_alarm, spread <= -40 AS sample_alarm,
    (value >= 60 OR k >= 70 OR spread <= -40) AS or_3, row_number() OVER (PARTITION BY group_id ORDER BY t_us, seq) AS place FROM seg_rows)"""
P2 = """p2 AS (
  SELECT *, (or_3 AND coalesce(lag(or_3) OVER (PARTITION BY group_id ORDER BY t_us, seq), false)) AS final_alarm FROM tracks)"""


def tracks(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"long_alarm": F.col("value") >= 60, "short_alarm": F.col("k") >= 70, "sample_alarm": F.col("spread") <= -40}).withColumn("or_3", F.col("long_alarm") | F.col("short_alarm") | F.col("sample_alarm"))


def final_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks(event_rows(spark, sf_dir)).withColumn("final_alarm", alarms.persistent(F.col("or_3"), 2))


# sources and quality


@query("SELECT count(*) AS rows, count(ts) AS valid_times, count(*) - count(ts) AS invalid_times, count(*) FILTER (WHERE value IS NULL) AS invalid_sensors, count(*) FILTER (WHERE event_type = 'view') AS idle_rows FROM events")
def raw_quality(spark, sf_dir):
    raw = table(spark, sf_dir, "events").withColumn("idle", (F.col("event_type") == "view").cast("int"))
    return rounded(quality_counts(raw, ("value",), "ts", "idle"))


@query(f"WITH {EV_ROWS}, g AS (SELECT group_id, count(*) AS n, count(*) FILTER (WHERE gap_sec > 86400) AS gaps, sum(idle) AS idle FROM seg_rows GROUP BY 1) SELECT count(*) AS segments, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(gaps) AS BIGINT) AS gaps_over, CAST(sum(idle) AS BIGINT) AS idle_rows, count(*) FILTER (WHERE idle * 2 >= n) AS idle_segments FROM g")
def segment_quality(spark, sf_dir):
    return sessions.segment_quality(event_rows(spark, sf_dir), EVENT_SETTINGS.gap_sec)


@query(f"WITH {EVENT_SAMPLES} SELECT source, c AS channel, min(v) AS low, max(v) AS high, min(CASE WHEN idle = 1 THEN v END) AS idle_low, max(CASE WHEN idle = 1 THEN v END) AS idle_high FROM (SELECT source, idle, 'value' AS c, value AS v FROM samples UNION ALL SELECT source, idle, 'k', k FROM samples) GROUP BY ALL")
def channel_ranges(spark, sf_dir):
    return analysis.channel_ranges(event_samples(spark, sf_dir), ("value", "k"))


# time structure


@query(f"WITH {EVENT_SAMPLES}, {GAPS} SELECT source, count(gap_sec) AS n, round(avg(gap_sec), 4) AS mean, round(stddev_samp(gap_sec), 4) AS std, round(min(gap_sec), 4) AS min, round(max(gap_sec), 4) AS max, "
       + ", ".join(f"round(quantile_cont(gap_sec, {q}), 4) AS q{round(q * 100):02d}" for q in analysis.QUANTILES) + " FROM gaps GROUP BY 1")
def gap_stats(spark, sf_dir):
    return rounded(analysis.gap_statistics(event_samples(spark, sf_dir)), 4)


@query(f"WITH {EVENT_SAMPLES}, {GAPS} SELECT source, round(avg(CASE WHEN gap_sec BETWEEN 9999.999999999 AND 30000.000000001 THEN 1.0 ELSE 0.0 END), 6) AS share FROM gaps WHERE gap_sec IS NOT NULL GROUP BY 1")
def gap_in_tolerance(spark, sf_dir):
    return rounded(analysis.in_tolerance(event_samples(spark, sf_dir), 20_000.0, 10_000.0))


@query(f"WITH {EVENT_SAMPLES}, {GAPS}, b AS (SELECT CASE WHEN gap_sec <= 0 THEN NULL WHEN gap_sec <= 600 THEN 0 WHEN gap_sec <= 3600 THEN 1 WHEN gap_sec <= 21600 THEN 2 WHEN gap_sec <= 86400 THEN 3 WHEN gap_sec <= 604800 THEN 4 ELSE 5 END AS bin FROM gaps WHERE gap_sec IS NOT NULL) SELECT CAST(r.bin AS BIGINT) AS bin, count(b.bin) AS n, round(100.0 * count(b.bin) / (SELECT count(*) FROM b), 6) AS pct FROM range(6) r(bin) LEFT JOIN b ON b.bin = r.bin GROUP BY r.bin")
def gap_histogram(spark, sf_dir):
    return rounded(analysis.gap_histogram(event_samples(spark, sf_dir), (600.0, 3600.0, 21_600.0, 86_400.0, 604_800.0)))


@query(f"WITH {EVENT_SAMPLES}, {GAPS}, t(threshold_sec) AS (VALUES (3600.0::DOUBLE), (21600.0), (86400.0), (259200.0), (604800.0)) SELECT threshold_sec, count(*) FILTER (WHERE gap_sec > threshold_sec) AS large_gaps, round(100.0 * count(*) FILTER (WHERE gap_sec > threshold_sec) / count(gap_sec), 6) AS pct, count(*) FILTER (WHERE gap_sec > threshold_sec OR gap_sec IS NULL) AS segments FROM gaps, t GROUP BY 1")
def gap_threshold_sweep(spark, sf_dir):
    return rounded(analysis.gap_threshold_sweep(event_samples(spark, sf_dir), (3600.0, 21_600.0, 86_400.0, 259_200.0, 604_800.0)))


@query(f"WITH {EVENT_SAMPLES}, {GAPS} SELECT source, series, t_us - CAST(round(gap_sec * 1e6) AS BIGINT) AS start_us, t_us AS end_us, round(gap_sec, 6) AS gap_sec FROM gaps WHERE gap_sec > 259200")
def large_gaps(spark, sf_dir):
    return rounded(analysis.large_gaps(event_samples(spark, sf_dir), 259_200.0))


@query(f"WITH {EVENT_SAMPLES}, {GAPS} SELECT CAST(idle AS BIGINT) AS idle, count(*) AS n, round(coalesce(sum(gap_sec), 0), 3) AS duration_sec, round(100.0 * count(*) / sum(count(*)) OVER (), 3) AS pct FROM gaps GROUP BY idle")
def idle_counts(spark, sf_dir):
    return rounded(analysis.idle_counts(event_samples(spark, sf_dir)), 3)


@query(f"WITH {EVENT_SAMPLES}, c AS (SELECT source, idle <> lag(idle) OVER (PARTITION BY source, series ORDER BY t_us, seq) AS ch FROM samples) SELECT source, count(*) FILTER (WHERE ch) AS transitions FROM c GROUP BY 1")
def idle_transitions(spark, sf_dir):
    return analysis.idle_transitions(event_samples(spark, sf_dir))


ISLANDS = f"""WITH {EVENT_SAMPLES}, c AS (SELECT *, CASE WHEN idle IS DISTINCT FROM lag(idle) OVER w THEN 1 ELSE 0 END AS ch FROM samples WINDOW w AS (PARTITION BY source, series ORDER BY t_us, seq)),
  r AS (SELECT *, sum(ch) OVER (PARTITION BY source, series ORDER BY t_us, seq ROWS UNBOUNDED PRECEDING) AS run FROM c),
  i AS (SELECT source, series, CAST(idle AS BIGINT) AS idle, min(t_us) AS start_us, max(t_us) AS end_us, count(*) AS rows, round((max(t_us) - min(t_us)) / 1e6, 6) AS duration_sec FROM r GROUP BY source, series, run, idle) SELECT * FROM i"""


@query(ISLANDS)
def idle_islands(spark, sf_dir):
    return rounded(analysis.idle_islands(event_samples(spark, sf_dir), None))


@query(ISLANDS + " ORDER BY duration_sec DESC, source, series, start_us LIMIT 20")
def idle_islands_longest(spark, sf_dir):
    return rounded(analysis.idle_islands(event_samples(spark, sf_dir), 20))


# sessions


@query(f"WITH {EV_ROWS} SELECT source, series, t_us, seq, segment_id, group_id, kind, CAST(label AS BIGINT) AS label, round(gap_sec, 6) AS gap_sec FROM seg_rows")
def sessionize(spark, sf_dir):
    return rounded(event_rows(spark, sf_dir).select("source", "series", "t_us", "seq", "segment_id", "group_id", "kind", "label", "gap_sec"))


@query(f"WITH {EV_ROWS}, {MANIFEST} SELECT source, series, segment_id, group_id, start_us, end_us, round(duration_sec, 6) AS duration_sec, n_rows AS rows, round(max_gap_sec, 6) AS max_gap_sec, round(idle_ratio, 6) AS idle_ratio, CAST(idle_majority AS BIGINT) AS idle_majority, CAST(label AS BIGINT) AS label, onset_us FROM manifest")
def segment_manifest(spark, sf_dir):
    return rounded(sessions.segment_manifest(event_rows(spark, sf_dir)))


@query(f"WITH {LI_ROWS}, {MANIFEST} SELECT group_id, round(duration_sec, 6) AS duration_sec, onset_us, duration_sec >= 864000 AS evaluable_common, duration_sec >= 1728000 AS evaluable_this_w FROM manifest WHERE source = 'fault' AND onset_us IS NOT NULL")
def event_manifest(spark, sf_dir):
    m = sessions.event_manifest(sessions.segment_manifest(line_rows(spark, sf_dir)), 1_728_000.0, 864_000.0)
    return rounded(m.select("group_id", "duration_sec", "onset_us", "evaluable_common", "evaluable_this_w"))


@query(f"WITH {LI_ROWS} SELECT kind, count(DISTINCT group_id) AS segments, count(*) AS samples FROM seg_rows GROUP BY 1")
def kind_summary(spark, sf_dir):
    return sessions.kind_summary(line_rows(spark, sf_dir))


@query(f"WITH {EVENT_SAMPLES}, {GAPS} SELECT round(median(gap_sec), 6) AS interval_sec FROM gaps WHERE gap_sec > 0 AND gap_sec <= 86400")
def nominal_interval(spark, sf_dir):
    return rounded(sessions.nominal_interval(event_samples(spark, sf_dir), 86_400.0))


@query(f"""WITH {EVENT_SAMPLES}, b AS (SELECT *, CASE event_type_block WHEN 'fault' THEN 1 ELSE 0 END AS block FROM (SELECT *, source AS event_type_block FROM samples)),
  e AS (SELECT block, min(t_us) AS low, max(t_us) AS high FROM b GROUP BY 1),
  m AS (SELECT block, low, first_value(low) OVER (ORDER BY block) + coalesce(sum(high - low + 2000000) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM e)
  SELECT CAST(b.block AS BIGINT) AS block, seq, t_us AS original_us, CAST(t_us - low + start AS BIGINT) AS t_us FROM b JOIN m USING (block)""")
def demo_stream(spark, sf_dir):
    blocks = event_samples(spark, sf_dir).withColumn("block", (F.col("source") == "fault").cast("int"))
    return rounded(sessions.demo_stream(blocks, 2.0).select("block", "seq", "original_us", "t_us"))


@query(f"WITH {EV_ROWS}, i AS (SELECT * FROM seg_rows WHERE idle = 1), g AS (SELECT group_id FROM i GROUP BY 1 ORDER BY count(*) DESC, group_id LIMIT 1) SELECT group_id, t_us, seq FROM i WHERE group_id IN (SELECT group_id FROM g) ORDER BY t_us, seq LIMIT 200")
def demo_idle(spark, sf_dir):
    return sessions.first_of_longest_idle(event_rows(spark, sf_dir), 200).select("group_id", "t_us", "seq")


@query(f"WITH {EV_ROWS} SELECT group_id, t_us, seq FROM seg_rows WHERE idle <> 1 ORDER BY t_us DESC, seq DESC LIMIT 800")
def demo_normal(spark, sf_dir):
    return sessions.last_of_kind(event_rows(spark, sf_dir), 800).select("group_id", "t_us", "seq")


# windows and features


@query(f"WITH {LI_ROWS} SELECT group_id, seq, round(sign(quantity) * ln(1 + abs(quantity)), 9) AS quantity, round(sign(discount - 0.05) * ln(1 + abs(discount - 0.05)), 9) AS discount FROM seg_rows")
def signed_log(spark, sf_dir):
    rows = line_rows(spark, sf_dir)
    return rows.select("group_id", "seq", F.round(scalar.signed_log1p(F.col("quantity")), 9).alias("quantity"), F.round(scalar.signed_log1p(F.col("discount") - 0.05), 9).alias("discount"))


@query(f"""WITH {LI_ROWS} SELECT group_id, seq, round(quantity - lag(quantity, 1, quantity) OVER w, 6) AS quantity_diff, round(price - lag(price, 1, price) OVER w, 6) AS price_diff, round(discount - lag(discount, 1, discount) OVER w, 6) AS discount_diff,
  round(coalesce(stddev_samp(quantity) OVER r, 0), 4) AS quantity_roll3, round(coalesce(stddev_samp(price) OVER r, 0), 2) AS price_roll3, round(coalesce(stddev_samp(discount) OVER r, 0), 4) AS discount_roll3
  FROM seg_rows WINDOW w AS (PARTITION BY group_id ORDER BY t_us, seq), r AS (PARTITION BY group_id ORDER BY t_us, seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def sample_features(spark, sf_dir):
    c = LINE_SETTINGS.channels
    out = windows.sample_features(line_rows(spark, sf_dir), c, True).select("group_id", "seq", *(f"{x}_diff" for x in c), *(f"{x}_roll3" for x in c))
    digits = {"quantity_roll3": 4, "price_roll3": 2, "discount_roll3": 4}
    return out.select(*(F.round(c, digits.get(c, 6)).alias(c) if t == "double" else c for c, t in out.dtypes))


#: A factor that keeps slopes of whole numbers from lying halfway between two roundings, where sums in another order decide.
ODD = 0.7320508


def _frame_sql(x: str) -> str:
    return f"round(avg({x}) OVER r, 4) AS {x}_mean, round(stddev_samp({x}) OVER r, 4) AS {x}_std, round(sqrt(avg({x} * {x}) OVER r), 4) AS {x}_rms, round(max({x}) OVER r - min({x}) OVER r, 4) AS {x}_ptp, round(1e6 * regr_slope({x}, day) OVER r / 86400, 8) AS {x}_slope_um"


@query(f"""WITH {LI_ROWS}, d AS (SELECT *, (t_us - min(t_us) OVER (PARTITION BY group_id)) / 86400e6 AS day, row_number() OVER (PARTITION BY group_id ORDER BY t_us, seq) AS place FROM seg_rows),
  f AS (SELECT group_id, seq, place, {', '.join(_frame_sql(x) for x in ('quantity', 'discount'))},
    round(avg(price) OVER r, 4) AS price_mean, round(stddev_samp(price) OVER r, 4) AS price_std, round(sqrt(avg(price * price) OVER r), 4) AS price_rms, round(max(price) OVER r - min(price) OVER r, 4) AS price_ptp, round({ODD} * 1e6 * regr_slope(price, day) OVER r / 86400, 4) AS price_slope_um,
    round(coalesce(covar_pop(quantity, price) OVER r / nullif(stddev_pop(quantity) OVER r * stddev_pop(price) OVER r, 0), 0), 4) AS quantity_price_corr
    FROM d WINDOW r AS (PARTITION BY group_id ORDER BY t_us, seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT * EXCLUDE (place) FROM f WHERE place >= 5""")
def window_count_features(spark, sf_dir):
    out = windows.count_windows(line_rows(spark, sf_dir), 5, LINE_SETTINGS.channels).where("window_start_us is not null")
    cols = [f"{x}_{s}" for x in LINE_SETTINGS.channels for s in ("mean", "std", "rms", "ptp")]
    slopes = [F.round(1e6 * F.col(f"{x}_slope"), 8).alias(f"{x}_slope_um") for x in ("quantity", "discount")]
    slopes.append(F.round(ODD * 1e6 * F.col("price_slope"), 4).alias("price_slope_um"))
    return out.select("group_id", "seq", *(F.round(c, 4).alias(c) for c in cols), *slopes, F.round("quantity_price_corr", 4).alias("quantity_price_corr"))


STARTS = f"""WITH RECURSIVE {LI_ROWS}, p AS (SELECT group_id, t_us, row_number() OVER (PARTITION BY group_id ORDER BY t_us, seq) AS place, max(t_us) OVER (PARTITION BY group_id) AS last FROM seg_rows),
  n AS (SELECT p.group_id, p.place, any_value(p.t_us) AS t_us, count(*) FILTER (WHERE q.t_us < p.t_us + 864000000000) AS inside, coalesce(min(q.place) FILTER (WHERE q.t_us >= p.t_us + 172800000000), 0) AS hop, any_value(p.last) AS last
    FROM p JOIN p q ON p.group_id = q.group_id AND q.place >= p.place GROUP BY 1, 2),
  chase AS (SELECT group_id, place, t_us, inside, hop, last FROM n WHERE place = 1
    UNION ALL SELECT n.group_id, n.place, n.t_us, n.inside, n.hop, n.last FROM chase c JOIN n ON n.group_id = c.group_id AND n.place = CASE WHEN c.inside >= 4 THEN c.hop ELSE c.place + 1 END WHERE c.t_us + 864000000000 <= c.last),
  starts AS (SELECT DISTINCT group_id, t_us AS start_us, t_us + 864000000000 AS end_us FROM chase WHERE inside >= 4 AND t_us + 864000000000 <= last)"""


@query(STARTS + " SELECT * FROM starts")
def window_starts(spark, sf_dir):
    s = LINE_SETTINGS
    return windows.window_starts(line_rows(spark, sf_dir), s.window_sec, s.step_sec, s.min_samples)


def _window_sql(x: str) -> str:
    return f"round(avg({x}), 6) AS {x}_mean, round(coalesce(stddev_samp({x}), 0), 4) AS {x}_std, round(sqrt(avg({x} * {x})), 4) AS {x}_rms, round(max({x}) - min({x}), 4) AS {x}_ptp, round({ODD} * 1e6 * regr_slope({x}, day) / 86400, 4) AS {x}_slope_um"


@query(STARTS + f""", g AS (SELECT *, (t_us - lag(t_us) OVER (PARTITION BY group_id ORDER BY t_us, seq)) / 1e6 AS inner_gap, min(CASE WHEN state >= 1 THEN t_us END) OVER (PARTITION BY group_id) AS onset FROM seg_rows),
  m AS (SELECT s.start_us, s.end_us, r.*, (r.t_us - s.start_us) / 86400e6 AS day FROM starts s JOIN g r ON r.group_id = s.group_id AND r.t_us >= s.start_us AND r.t_us < s.end_us)
  SELECT group_id, start_us, end_us, count(*) AS sample_count, round((max(t_us) - min(t_us)) / 1e6, 4) AS actual_duration_sec, round(coalesce(max(CASE WHEN t_us > start_us THEN inner_gap END), 0), 4) AS max_gap_sec,
  {', '.join(_window_sql(x) for x in ('quantity', 'price', 'discount'))},
  round(coalesce(covar_pop(quantity, price) / nullif(stddev_pop(quantity) * stddev_pop(price), 0), 0), 4) AS quantity_price_corr, round(avg(CAST(idle AS DOUBLE)), 6) AS idle_ratio, CAST(CASE WHEN avg(CAST(idle AS DOUBLE)) >= 0.5 THEN 1 ELSE 0 END AS BIGINT) AS idle_majority,
  round(avg(CAST(state AS DOUBLE)), 6) AS fault_ratio, CAST(CASE WHEN avg(CAST(state AS DOUBLE)) >= 0.5 THEN 1 ELSE 0 END AS BIGINT) AS label, any_value(onset) AS onset_us FROM m GROUP BY group_id, start_us, end_us""")
def time_window_features(spark, sf_dir):
    w = windows.time_windows(line_rows(spark, sf_dir), LINE_SETTINGS)
    slopes = [F.round(ODD * 1e6 * F.col(f"{x}_slope"), 4).alias(f"{x}_slope_um") for x in LINE_SETTINGS.channels]
    cols = [F.round(f"{x}_{k}", 6 if k == "mean" else 4).alias(f"{x}_{k}") for x in LINE_SETTINGS.channels for k in ("mean", "std", "rms", "ptp")]
    # more digits where shares and means of few rows could lie halfway between two
    digits = {"actual_duration_sec": 4, "max_gap_sec": 4, "quantity_price_corr": 4, "idle_ratio": 6, "fault_ratio": 6}
    known = ["group_id", "start_us", "end_us", "sample_count", "onset_us", *(F.round(c, n).alias(c) for c, n in digits.items()), *(F.col(c).cast("bigint").alias(c) for c in ("idle_majority", "label"))]
    return w.select(*known, *cols, *slopes)


@query(STARTS + ", l AS (SELECT (start_us - lag(start_us) OVER (PARTITION BY group_id ORDER BY start_us)) / 1e6 AS step, (end_us - start_us) / 1e6 AS length FROM starts) SELECT round(median(step), 6) AS step_sec, round(median(length), 6) AS window_sec FROM l")
def infer_step(spark, sf_dir):
    s = LINE_SETTINGS
    return rounded(sessions.infer_step(windows.window_starts(line_rows(spark, sf_dir), s.window_sec, s.step_sec, s.min_samples)))


@query("WITH w AS (SELECT l_suppkey || '_' || l_returnflag AS group_id, CASE WHEN l_returnflag = 'N' AND l_linenumber <= 2 THEN 1.0 ELSE 0.5 END AS window_sec FROM lineitem) SELECT group_id, CAST(max(window_sec) AS DOUBLE) AS window_sec, count(*) AS n FROM w WHERE (group_id, window_sec) IN (SELECT group_id, max(window_sec) FROM w GROUP BY 1) GROUP BY 1")
def scale_routing(spark, sf_dir):
    group = F.concat_ws("_", F.col("l_suppkey").cast("string"), "l_returnflag")
    length = F.when((F.col("l_returnflag") == "N") & (F.col("l_linenumber") <= 2), 1.0).otherwise(0.5)
    w = table(spark, sf_dir, "lineitem").select(group.alias("group_id"), length.alias("window_sec"))
    return sessions.route_scales(w).groupBy("group_id").agg(F.max("window_sec").alias("window_sec"), F.count(F.lit(1)).alias("n"))


# thresholds and models


@query(f"WITH {LI_ROWS} SELECT round(quantile_cont(price, 0.9999), 4) AS threshold, count(*) AS n FROM seg_rows WHERE label = 0")
def quantile_threshold(spark, sf_dir):
    return rounded(thresholds.normal_quantile_of_table(line_rows(spark, sf_dir), 0.9999, score="price"), 4)


F1 = f"""WITH {LI_ROWS}, e AS (SELECT quantity AS threshold, sum(label) AS p, count(*) AS n FROM seg_rows GROUP BY 1),
  s AS (SELECT threshold, sum(p) OVER (ORDER BY threshold DESC) AS tp, sum(n) OVER (ORDER BY threshold DESC) AS called, sum(p) OVER () AS positives FROM e),
  m AS (SELECT *, tp / called AS precision, tp / positives AS recall, 2.0 * tp / (called + positives) AS f1 FROM s)"""


@query(F1 + " SELECT round(threshold, 6) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(called - tp AS BIGINT) AS fp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM m")
def f1_sweep(spark, sf_dir):
    return rounded(thresholds.threshold_sweep(line_rows(spark, sf_dir), score="quantity").select("threshold", "tp", "fp", "precision", "recall", "f1"))


@query(F1 + " SELECT round(threshold, 6) AS threshold, round(f1, 6) AS f1, round(precision, 6) AS precision, round(recall, 6) AS recall, CAST(tp AS BIGINT) AS tp, CAST(called - tp AS BIGINT) AS fp FROM m ORDER BY round(f1, 12) DESC, round(precision, 12) DESC, threshold LIMIT 1")
def f1_threshold(spark, sf_dir):
    return rounded(thresholds.best_f1(line_rows(spark, sf_dir), score="quantity"))


@query(f"""WITH {LI_ROWS}, x AS (SELECT group_id, seq, kind, sign(quantity) * ln(1 + abs(quantity)) AS a, sign(price) * ln(1 + abs(price)) AS b, sign(discount) * ln(1 + abs(discount)) AS c FROM seg_rows),
  u AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, covar_pop(a, a) AS aa, covar_pop(a, b) AS ab, covar_pop(a, c) AS ac, covar_pop(b, b) AS bb, covar_pop(b, c) AS bc, covar_pop(c, c) AS cc FROM x WHERE kind = 'normal'),
  v AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM u)
  SELECT group_id, seq, round(((a - ma) * (a - ma) * (bb * cc - bc * bc) + (b - mb) * (b - mb) * (aa * cc - ac * ac) + (c - mc) * (c - mc) * (aa * bb - ab * ab)
    + 2 * (a - ma) * (b - mb) * (ac * bc - ab * cc) + 2 * (a - ma) * (c - mc) * (ab * bc - ac * bb) + 2 * (b - mb) * (c - mc) * (ab * ac - aa * bc)) / det, 5) AS score FROM x, v""")
def empirical_mahalanobis_3d(spark, sf_dir):
    rows = line_rows(spark, sf_dir)
    model = fit_gaussian(rows.where("kind = 'normal'"), list(LINE_SETTINGS.channels), "empirical", rows)
    return rows.select("group_id", "seq", F.round(model.score(), 5).alias("score"))


def _distance_sql(aa: str, bb: str, cc: str, ab: str, ac: str, bc: str) -> str:
    """The squared Mahalanobis distance of (a, b, c) by the adjugate of a 3 x 3 covariance."""
    det = f"({aa} * ({bb} * {cc} - {bc} * {bc}) - {ab} * ({ab} * {cc} - {bc} * {ac}) + {ac} * ({ab} * {bc} - {bb} * {ac}))"
    return f"""((a - ma) * (a - ma) * ({bb} * {cc} - {bc} * {bc}) + (b - mb) * (b - mb) * ({aa} * {cc} - {ac} * {ac}) + (c - mc) * (c - mc) * ({aa} * {bb} - {ab} * {ab})
      + 2 * (a - ma) * (b - mb) * ({ac} * {bc} - {ab} * {cc}) + 2 * (a - ma) * (c - mc) * ({ab} * {bc} - {ac} * {bb}) + 2 * (b - mb) * (c - mc) * ({ab} * {ac} - {aa} * {bc})) / {det}"""


def _shrunk_sql(share: str) -> str:
    diagonal = [f"((1 - {share}) * {v} + {share} * m)" for v in ("aa", "bb", "cc")]
    return _distance_sql(*diagonal, *(f"((1 - {share}) * {v})" for v in ("ab", "ac", "bc")))


@query(f"""WITH {LI_ROWS}, x AS (SELECT group_id, seq, kind, sign(quantity) * ln(1 + abs(quantity)) AS a, sign(price) * ln(1 + abs(price)) AS b, sign(discount) * ln(1 + abs(discount)) AS c FROM seg_rows),
  u AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, covar_pop(a, a) AS aa, covar_pop(a, b) AS ab, covar_pop(a, c) AS ac, covar_pop(b, b) AS bb, covar_pop(b, c) AS bc, covar_pop(c, c) AS cc FROM x WHERE kind = 'normal'),
  q AS (SELECT sum(power((a - ma) * (a - ma) + (b - mb) * (b - mb) + (c - mc) * (c - mc), 2)) AS q4 FROM x, u WHERE kind = 'normal'),
  v AS (SELECT *, (aa + bb + cc) / 3 AS m, aa * aa + bb * bb + cc * cc + 2 * (ab * ab + ac * ac + bc * bc) AS ss FROM u, q),
  w AS (SELECT *, (ss - 3 * m * m) / 3 AS d2, (n + 1 - 2.0 / 3) * (ss - 3 * m * m) AS below FROM v),
  z AS (SELECT *, greatest(0, least(q4 / (3 * n * n) - ss / (3 * n), d2)) / d2 AS lw, least(1, ((1 - 2.0 / 3) * ss + 9 * m * m) / below) AS oas FROM w)
  SELECT group_id, seq, round({_shrunk_sql('lw')}, 5) AS ledoit_wolf, round({_shrunk_sql('oas')}, 5) AS oas FROM x, z""")
def shrunk_mahalanobis_3d(spark, sf_dir):
    rows = line_rows(spark, sf_dir)
    normal, channels = rows.where("kind = 'normal'"), list(LINE_SETTINGS.channels)
    models = {kind: fit_gaussian(normal, channels, kind, rows) for kind in ("ledoit_wolf", "oas")}
    return rows.select("group_id", "seq", *(F.round(m.score(), 5).alias(kind) for kind, m in models.items()))


@query()
def ledoit_wolf_score(spark, sf_dir):
    rows = line_rows(spark, sf_dir)
    from tidewatch.schema import feature_names

    names = feature_names(LINE_SETTINGS.channels)
    w = windows.count_windows(rows, 5, LINE_SETTINGS.channels).where("window_start_us is not null")
    w = written(w.select("group_id", "seq", "kind", *names), "ledoit-wolf")

    model = fit_gaussian(w.where("kind = 'normal'"), names, among=w)
    return w.select("group_id", "seq", F.round(model.score(), 4).alias("score"))


@query()
def isolation_forest_score(spark, sf_dir):
    # written, as several passes read them
    rows = written(line_rows(spark, sf_dir).select("group_id", "t_us", "seq", "kind", *LINE_SETTINGS.channels), "forest-rows")
    model = fit_forest(rows.where("kind = 'normal'"), list(LINE_SETTINGS.channels), 100, key=["group_id", "t_us", "seq"], among=rows)
    return rows.select("group_id", "seq", F.round(model.score(), 6).alias("score"))


@query(f"WITH {LI_ROWS} SELECT count(*) AS rows, count(*) FILTER (WHERE label = 0) AS normal, count(*) FILTER (WHERE label = 1) AS fault, count(price) AS finite, count(price) FILTER (WHERE label = 0) AS finite_normal, count(price) FILTER (WHERE label = 1) AS finite_fault FROM seg_rows")
def score_audit(spark, sf_dir):
    return thresholds.score_audit(line_rows(spark, sf_dir), "price")


# alarms


@query(f"WITH {EV_ROWS}, {TRACKS}, {P2} SELECT group_id, seq, or_3, final_alarm FROM p2")
def persistence_p2(spark, sf_dir):
    return final_rows(spark, sf_dir).select("group_id", "seq", "or_3", "final_alarm")


@query(f"WITH {EV_ROWS}, {TRACKS} SELECT group_id, seq, max(CAST(sample_alarm AS INT)) OVER (PARTITION BY group_id ORDER BY t_us, seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 1 AS tolerant FROM tracks")
def temporal_tolerance(spark, sf_dir):
    return tracks(event_rows(spark, sf_dir)).select("group_id", "seq", alarms.tolerant(F.col("sample_alarm"), 3).alias("tolerant"))


def _tol(c: str, n: int) -> str:
    return f"(max(CAST({c} AS INT)) OVER (PARTITION BY group_id ORDER BY t_us, seq ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = 1)"


@query(f"""WITH {EV_ROWS}, {TRACKS} SELECT group_id, seq, long_alarm AS long_only, short_alarm AS short_only, sample_alarm AS sample_only, or_3,
  place >= 2 AND min(CAST(or_3 AS INT)) OVER (PARTITION BY group_id ORDER BY t_us, seq ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) = 1 AS or_3_p2,
  place >= 3 AND min(CAST(or_3 AS INT)) OVER (PARTITION BY group_id ORDER BY t_us, seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 1 AS or_3_p3,
  CAST(long_alarm AS INT) + CAST(short_alarm AS INT) + CAST(sample_alarm AS INT) >= 2 AS two_of_3_exact,
  CAST({_tol('long_alarm', 3)} AS INT) + CAST({_tol('short_alarm', 3)} AS INT) + CAST({_tol('sample_alarm', 3)} AS INT) >= 2 AS two_of_3_tol3,
  long_alarm OR short_alarm OR (sample_alarm AND {_tol('(long_alarm OR short_alarm)', 5)}) AS or_3_sample_corrob FROM tracks""")
def ensemble_combos(spark, sf_dir):
    return alarms.combine(tracks(event_rows(spark, sf_dir))).select("group_id", "seq", *alarms.COMBINATIONS)


#: Trailing windows of 3 rows, as intervals, with their mean value as score.
WINDOWS3 = """w3 AS (SELECT source, group_id, kind, seq, t_us, first_value(t_us) OVER r AS start_us, t_us AS end_us, avg(value) OVER r AS score, count(*) OVER r AS n, min(CASE WHEN state >= 1 THEN t_us END) OVER (PARTITION BY group_id) AS onset_us, label
  FROM seg_rows WINDOW r AS (PARTITION BY group_id ORDER BY t_us, seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)), win AS (SELECT *, score >= 40 AS alarm FROM w3 WHERE n = 3)"""


def windows3(rows: DataFrame) -> DataFrame:
    r = windows.in_segment().rowsBetween(-2, 0)
    whole = Window.partitionBy("group_id")
    out = rows.withColumns({"start_us": F.first("t_us").over(r), "end_us": F.col("t_us"), "score": F.avg("value").over(r), "onset_us": F.min(F.when(F.col("state") >= 1, F.col("t_us"))).over(whole), "_n": F.count(F.lit(1)).over(r)})
    return out.where("_n = 3").withColumn("alarm", F.col("score") >= 40).select("source", "group_id", "kind", "seq", "start_us", "end_us", "score", "onset_us", "label", "alarm")


@query(f"""WITH {EV_ROWS}, {WINDOWS3}, s AS (SELECT *, (start_us - lag(start_us) OVER (PARTITION BY group_id ORDER BY start_us, end_us)) / 1e6 AS step FROM win),
  e AS (SELECT *, median(CASE WHEN step > 0 THEN step END) OVER (PARTITION BY group_id) AS expected FROM s),
  f AS (SELECT *, alarm AS high, coalesce(step IS NULL OR expected IS NULL OR abs(step - expected) <= greatest(1e-6, expected * 0.02), false) AS follows FROM e),
  r AS (SELECT *, sum(CASE WHEN high AND follows THEN 0 ELSE 1 END) OVER (PARTITION BY group_id ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS run FROM f)
  SELECT group_id, seq, high AND sum(CAST(high AS INT)) OVER (PARTITION BY group_id, run ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) >= 2 AS alarm_k FROM r""")
def k_consecutive(spark, sf_dir):
    return alarms.k_consecutive(windows3(event_rows(spark, sf_dir)), F.lit(40.0), 2).select("group_id", "seq", "alarm_k")


@query(f"WITH {EV_ROWS}, {WINDOWS3} SELECT r.group_id, r.seq, EXISTS (SELECT 1 FROM win w WHERE w.alarm AND w.group_id = r.group_id AND r.t_us >= w.end_us AND r.t_us < w.end_us + (w.end_us - w.start_us)) AS on_row FROM seg_rows r")
def window_alarm_range_join(spark, sf_dir):
    rows = event_rows(spark, sf_dir)
    return alarms.alarms_to_rows(rows, windows3(rows), "alarm", "on_row").select("group_id", "seq", "on_row")


@query(f"WITH {EV_ROWS}, {TRACKS}, {P2}, {WINDOWS3} SELECT w.group_id, w.seq, EXISTS (SELECT 1 FROM p2 r WHERE r.final_alarm AND r.kind = 'normal' AND r.group_id = w.group_id AND r.t_us >= w.end_us AND r.t_us < w.end_us + (w.end_us - w.start_us)) AS fp_context FROM win w")
def alarm_overlap_semi(spark, sf_dir):
    rows = final_rows(spark, sf_dir)
    return alarms.windows_with_alarms(windows3(event_rows(spark, sf_dir)), rows, "final_alarm", "fp_context").select("group_id", "seq", "fp_context")


# events and metrics


@query(f"""WITH {EV_ROWS}, {WINDOWS3}, h AS (SELECT group_id, min(onset_us) AS onset_us, min(CASE WHEN alarm AND end_us >= onset_us THEN end_us END) AS alarm_end_us FROM win WHERE source = 'fault' GROUP BY 1)
  SELECT group_id, onset_us, alarm_end_us IS NOT NULL AS detected, alarm_end_us, round(greatest(0.0, (alarm_end_us - onset_us) / 1e6), 6) AS delay_sec, CASE WHEN onset_us IS NULL THEN 'missing_fault_onset_time' WHEN alarm_end_us IS NOT NULL THEN 'detected' ELSE 'not_detected' END AS note FROM h""".replace("round(greatest(0.0, (alarm_end_us - onset_us) / 1e6), 6)", "CASE WHEN alarm_end_us IS NOT NULL THEN round(greatest(0.0, (alarm_end_us - onset_us) / 1e6), 6) END"))
def event_details(spark, sf_dir):
    return rounded(metrics.window_events(windows3(event_rows(spark, sf_dir)), "alarm").drop("alarm_start_us"))


@query(f"""WITH {EV_ROWS}, {WINDOWS3}, h AS (SELECT group_id, min(onset_us) AS onset_us, min(CASE WHEN alarm AND end_us >= onset_us THEN end_us END) AS hit FROM win WHERE source = 'fault' GROUP BY 1), d AS (SELECT hit IS NOT NULL AS detected, (hit - onset_us) / 1e6 AS delay FROM h)
  SELECT count(*) AS n_events, count(*) FILTER (WHERE detected) AS detected_events, round(avg(delay), 4) AS delay_mean_sec, round(median(delay), 4) AS delay_median_sec, round(min(delay), 4) AS delay_min_sec, round(max(delay), 4) AS delay_max_sec, round(count(*) FILTER (WHERE detected) / count(*), 4) AS event_detection_rate FROM d""")
def event_metrics(spark, sf_dir):
    return rounded(metrics.event_metrics(metrics.window_events(windows3(event_rows(spark, sf_dir)), "alarm")), 4)


@query(f"WITH {EV_ROWS}, {WINDOWS3} SELECT count(*) AS windows, count(DISTINCT group_id) AS events, count(DISTINCT CASE WHEN onset_us IS NOT NULL THEN group_id END) AS events_with_onset, round(100.0 * count(DISTINCT CASE WHEN onset_us IS NOT NULL THEN group_id END) / count(DISTINCT group_id), 6) AS coverage_pct FROM win WHERE source = 'fault'")
def onset_coverage(spark, sf_dir):
    return rounded(metrics.onset_coverage(windows3(event_rows(spark, sf_dir))))


@query(f"""WITH {EV_ROWS}, {TRACKS}, {P2}, c AS (SELECT kind, count(*) FILTER (WHERE label = 1 AND final_alarm) AS tp, count(*) FILTER (WHERE label = 0 AND final_alarm) AS fp, count(*) FILTER (WHERE label = 0 AND NOT final_alarm) AS tn, count(*) FILTER (WHERE label = 1 AND NOT final_alarm) AS fn FROM p2 GROUP BY 1)
  SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(fp / nullif(fp + tn, 0), 6) AS fpr FROM c""")
def confusion_metrics(spark, sf_dir):
    return rounded(metrics.confusion(final_rows(spark, sf_dir), "final_alarm", ["kind"]))


CYCLES = f"""WITH {EV_ROWS}, {TRACKS}, {P2}, st AS (SELECT *, final_alarm AND NOT coalesce(lag(final_alarm) OVER (PARTITION BY group_id ORDER BY t_us, seq), false) AS st FROM p2),
  cyc AS (SELECT group_id, kind, count(*) AS n, count(*) FILTER (WHERE final_alarm) AS alarm_rows, count(*) FILTER (WHERE st) AS episodes, min(t_us) AS onset, min(CASE WHEN final_alarm THEN t_us END) AS hit FROM st GROUP BY 1, 2)"""


@query(CYCLES + " SELECT group_id, kind, n AS rows, alarm_rows, episodes FROM cyc")
def alarm_episodes(spark, sf_dir):
    return metrics.cycles(final_rows(spark, sf_dir), "final_alarm")


@query(CYCLES + """, m AS (SELECT count(*) FILTER (WHERE label = 1 AND final_alarm) AS tp, count(*) FILTER (WHERE label = 0 AND final_alarm) AS fp, count(*) FILTER (WHERE label = 1 AND NOT final_alarm) AS fn FROM p2 WHERE kind <> 'idle')
  SELECT round((SELECT coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) FROM m), 6) AS sample_f1, round((SELECT coalesce(tp / nullif(tp + fp, 0), 0) FROM m), 6) AS sample_precision, round((SELECT coalesce(tp / nullif(tp + fn, 0), 0) FROM m), 6) AS sample_recall,
  count(*) FILTER (WHERE kind = 'fault') AS n_events, count(hit) FILTER (WHERE kind = 'fault') AS detected_events, round(count(hit) FILTER (WHERE kind = 'fault') / count(*) FILTER (WHERE kind = 'fault'), 6) AS event_detection_rate, round(avg((hit - onset) / 1e6) FILTER (WHERE kind = 'fault'), 6) AS delay_mean_sec,
  """ + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}_cycles, count(hit) FILTER (WHERE kind = '{k}') AS {k}_fa_cycles, CAST(coalesce(sum(episodes) FILTER (WHERE kind = '{k}'), 0) AS BIGINT) AS {k}_fa_episodes, round(count(hit) FILTER (WHERE kind = '{k}') / nullif(count(*) FILTER (WHERE kind = '{k}'), 0), 6) AS {k}_fa_cycle_rate" for k in ("normal", "idle")) + " FROM cyc")
def raw_alarm_metrics(spark, sf_dir):
    return rounded(metrics.raw_alarm_metrics(final_rows(spark, sf_dir), "final_alarm"))


@query(CYCLES + " SELECT group_id, n AS n_samples, onset AS onset_us, hit IS NOT NULL AS detected, round((hit - onset) / 1e6, 6) AS delay_sec FROM cyc WHERE kind = 'fault'")
def sample_events(spark, sf_dir):
    return rounded(metrics.sample_events(final_rows(spark, sf_dir), "final_alarm").select("group_id", "n_samples", "onset_us", "detected", F.when(F.col("detected"), F.col("delay_sec")).alias("delay_sec")))


@query(f"""WITH {EV_ROWS}, {WINDOWS3}, z AS (SELECT * FROM win WHERE NOT coalesce(source = 'fault' AND onset_us IS NOT NULL AND end_us >= onset_us, false)),
  y AS (SELECT *, alarm AND NOT coalesce(lag(alarm) OVER o AND (start_us - lag(start_us) OVER o) / 1e6 <= 64800, false) AS new, max(end_us) OVER (PARTITION BY group_id ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM z WINDOW o AS (PARTITION BY group_id ORDER BY start_us, end_us)),
  g AS (SELECT group_id, count(*) FILTER (WHERE new) AS e, sum(greatest(0, end_us - greatest(start_us, coalesce(reached, start_us)))) / 1e6 AS x FROM y GROUP BY 1)
  SELECT CAST(sum(e) AS BIGINT) AS n_episodes, round(sum(x), 3) AS exposure_sec, count(*) AS n_groups, count(*) FILTER (WHERE e > 0) AS n_fa_groups FROM g""")
def false_alarm_episodes(spark, sf_dir):
    return rounded(metrics.window_false_alarms(windows3(event_rows(spark, sf_dir)), "alarm", 43_200.0), 3)


@query(f"WITH {EV_ROWS}, {TRACKS}, {P2}, t AS (SELECT *, (t_us - min(t_us) OVER (PARTITION BY group_id)) / 1e6 AS t FROM p2 WHERE kind = 'fault') SELECT group_id, track, round(min(CASE WHEN is_on THEN t END), 6) AS first_sec FROM (SELECT group_id, t, 'or_3' AS track, or_3 AS is_on FROM t UNION ALL SELECT group_id, t, 'final_alarm', final_alarm FROM t UNION ALL SELECT group_id, t, 'long_alarm', long_alarm FROM t) GROUP BY 1, 2")
def first_detection(spark, sf_dir):
    return rounded(metrics.first_detection(final_rows(spark, sf_dir), ["or_3", "final_alarm", "long_alarm"]))


@query(f"""WITH {EV_ROWS}, {TRACKS}, {P2}, o AS (SELECT *, kind = 'fault' AS f, row_number() OVER (PARTITION BY series ORDER BY t_us, seq) AS i FROM p2), c AS (SELECT *, sum(CASE WHEN f <> coalesce(pf, false) THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY t_us, seq ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(f) OVER (PARTITION BY series ORDER BY t_us, seq) AS pf FROM o)),
  e AS (SELECT series, run, min(t_us) AS fault_start_us, min(i) AS first_i, count(*) AS fault_rows, count(*) FILTER (WHERE final_alarm) AS alarm_rows, min(CASE WHEN final_alarm THEN t_us END) AS first_alarm_us, min(CASE WHEN final_alarm THEN i END) AS hit_i FROM c WHERE f GROUP BY 1, 2)
  SELECT series, row_number() OVER (PARTITION BY series ORDER BY run) AS event_id, fault_start_us, fault_rows, first_alarm_us IS NOT NULL AS detected, first_alarm_us, round((first_alarm_us - fault_start_us) / 1e6, 6) AS delay_sec, hit_i - first_i AS delay_samples, alarm_rows FROM e""")
def realtime_event_runs(spark, sf_dir):
    return rounded(metrics.realtime_events(final_rows(spark, sf_dir)))


@query(f"WITH {EV_ROWS}, {TRACKS}, {P2} SELECT count(*) AS rows, " + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}_rows, count(*) FILTER (WHERE kind = '{k}' AND final_alarm) AS {k}_alarm_rows, round(count(*) FILTER (WHERE kind = '{k}' AND final_alarm) / nullif(count(*) FILTER (WHERE kind = '{k}'), 0), 6) AS {k}_alarm_rate" for k in ("normal", "idle", "fault")) + ", round(max(value / 60), 6) AS max_score_ratio FROM p2")
def realtime_summary(spark, sf_dir):
    return rounded(metrics.realtime_summary(final_rows(spark, sf_dir).withColumn("max_ratio", F.col("value") / 60)))


@query("SELECT round(avg(value), 6) AS mean_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms, max(value) AS max_ms FROM events")
def latency(spark, sf_dir):
    return rounded(metrics.latency(table(spark, sf_dir, "events"), "value"))


# splits


FOLDS = "folds AS (SELECT group_id, kind, (row_number() OVER (PARTITION BY kind ORDER BY group_id) - 1) % 5 AS fold FROM (SELECT DISTINCT group_id, kind FROM seg_rows))"


@query(f"WITH {EV_ROWS}, {FOLDS} SELECT group_id, kind, fold FROM folds")
def fold_map_ranked(spark, sf_dir):
    return rounded(splits.ranked_fold_map(event_rows(spark, sf_dir), 5))


@query()
def fold_map_seeded(spark, sf_dir):
    return rounded(splits.fold_map(event_rows(spark, sf_dir), 5, 0))


@query(f"WITH {EV_ROWS}, {FOLDS}, r AS (SELECT f.kind, t.test_fold, CASE WHEN fold = test_fold THEN 'test' WHEN f.kind = 'normal' AND fold = (test_fold + 1) % 5 THEN 'validation' WHEN f.kind = 'normal' THEN 'train' ELSE 'unused' END AS role FROM seg_rows s JOIN folds f USING (group_id), range(5) t(test_fold)) SELECT test_fold, kind, role, count(*) AS n FROM r GROUP BY ALL")
def fold_roles(spark, sf_dir):
    rows = event_rows(spark, sf_dir)
    out = splits.fold_roles(rows, splits.ranked_fold_map(rows, 5), 5)
    return rounded(out.groupBy("test_fold", "kind", "role").agg(F.count(F.lit(1)).alias("n")))


def _share(seed: int) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || group_id), 1, 8) AS BIGINT) / 4294967296.0"


SPLITS = f"""WITH {LI_ROWS}, {MANIFEST}, sp AS (SELECT *, CASE WHEN idle_majority = 1 THEN 'EXCLUDED_IDLE' WHEN source = 'fault' AND onset_us IS NOT NULL AND duration_sec < 432000 THEN 'EXCLUDED_SHORT'
  WHEN {_share(0)} < 0.6 THEN 'train' WHEN {_share(0)} < 0.8 THEN 'val' ELSE 'test' END AS split FROM manifest)"""


@query(f"WITH {EV_ROWS} SELECT DISTINCT group_id, kind, CAST(floor({_share(3)} * 5) AS BIGINT) AS fold FROM seg_rows")
def fold_map_hashed(spark, sf_dir):
    return rounded(splits.hashed_fold_map(event_rows(spark, sf_dir), 5, 3))


def split_manifest(spark, sf_dir):
    return splits.hashed_splits(sessions.segment_manifest(line_rows(spark, sf_dir)), 432_000.0)


@query()
def split_seeded(spark, sf_dir):
    m = sessions.segment_manifest(line_rows(spark, sf_dir))
    return analysis.split_label_pivot(splits.assign_splits(m, 432_000.0))


@query(SPLITS + " SELECT split, count(*) FILTER (WHERE label = 0) AS normal, count(*) FILTER (WHERE label = 1) AS fault FROM sp GROUP BY 1")
def split_label_pivot(spark, sf_dir):
    return analysis.split_label_pivot(split_manifest(spark, sf_dir))


@query(SPLITS + " SELECT count(*) AS leaking FROM (SELECT group_id FROM sp GROUP BY 1 HAVING count(DISTINCT split) > 1)")
def split_leaks(spark, sf_dir):
    return splits.leaking_groups(split_manifest(spark, sf_dir)).agg(F.count(F.lit(1)).alias("leaking"))


@query(SPLITS + ", x AS (SELECT r.* FROM seg_rows r WHERE r.kind = 'normal' AND r.idle <> 1 AND r.group_id NOT IN (SELECT group_id FROM sp WHERE split = 'test')) SELECT group_id, count(*) AS n, round(sum(quantity), 4) AS quantity FROM x GROUP BY 1")
def training_rows(spark, sf_dir):
    rows = splits.training_rows(line_rows(spark, sf_dir), split_manifest(spark, sf_dir).where("split = 'test'"), LINE_SETTINGS.channels)
    return rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("quantity"), 4).alias("quantity"))


@query("SELECT CAST(greatest(2, round(count(*) * 0.3)) AS BIGINT) AS n, count(*) >= greatest(2, round(count(*) * 0.3)) AS fits FROM events")
def subsample_size(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id")
    return splits.subsample(rows, 0.3, 7).agg(F.count(F.lit(1)).alias("n"), (F.count_distinct("event_id") == F.count(F.lit(1))).alias("fits"))


@query(f"WITH {EV_ROWS} SELECT CAST(least(greatest(1, ceil(count(DISTINCT group_id) * 0.2)), count(DISTINCT group_id) - 1) AS BIGINT) AS n FROM seg_rows WHERE kind = 'normal'")
def calibration_size(spark, sf_dir):
    return splits.calibration_groups(event_rows(spark, sf_dir).where("kind = 'normal'"), 0.2, 0).agg(F.count_distinct("group_id").alias("n"))


@query(SPLITS + " SELECT split, CAST(label AS BIGINT) AS label, count(*) AS segments, CAST(sum(n_rows) AS BIGINT) AS rows, round(sum(duration_sec), 3) AS duration_sec FROM sp GROUP BY 1, 2")
def split_summary(spark, sf_dir):
    return rounded(analysis.split_summary(split_manifest(spark, sf_dir)), 3)


# joins, sets, duplicates


@query("SELECT c_custkey, count(o_orderkey) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def left_join_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("total"))
    c = table(spark, sf_dir, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def dimension_lookup(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return rounded(n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name"))


@query("WITH a AS (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.1), b AS (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_quantity >= 50) SELECT (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS either, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS both, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_a, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_b")
def set_ops(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "group_id")
    return analysis.group_overlaps(li.where("l_returnflag = 'R' and l_discount >= 0.1"), li.where("l_quantity >= 50"))


@query("SELECT l_suppkey, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) = 1")
def dedup_keep_first(spark, sf_dir):
    li = analysis.keep_first(table(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"])
    return rounded(li.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey"))


# analysis


COHORTS = f"WITH {LI_ROWS}, u AS (SELECT kind, 'quantity' AS feature, quantity AS v FROM seg_rows UNION ALL SELECT kind, 'price', price FROM seg_rows UNION ALL SELECT kind, 'discount', discount FROM seg_rows), q AS (SELECT feature, " + ", ".join(f"quantile_cont(v, {p}) FILTER (WHERE kind = '{k}') AS {k}{i}" for k in ("normal", "fault") for i, p in enumerate((0.25, 0.5, 0.75))) + " FROM u GROUP BY 1)"


@query(COHORTS + " SELECT feature, round(normal1, 5) AS base_median, round(normal2 - normal0, 5) AS base_iqr, round(fault1, 5) AS target_median, round(fault1 - normal1, 5) AS delta, round((fault1 - normal1) / nullif((normal2 - normal0) / 1.349, 0), 5) AS effect, CASE WHEN fault1 - normal1 > 1e-12 THEN '↑' WHEN fault1 - normal1 < -1e-12 THEN '↓' ELSE '≈' END AS direction FROM q")
def robust_effect(spark, sf_dir):
    e = analysis.robust_effects(line_rows(spark, sf_dir), list(LINE_SETTINGS.channels), "kind", "normal", "fault")
    return rounded(e.select("feature", "base_median", "base_iqr", "target_median", "delta", "effect", "direction"), 5)


EFFECTS = COHORTS.replace("'fault')", "'fault')").replace(" FROM u GROUP BY 1)", ", " + ", ".join(f"quantile_cont(v, {p}) FILTER (WHERE kind = 'idle') AS idle{i}" for i, p in enumerate((0.25, 0.5, 0.75))) + " FROM u GROUP BY 1)")


def _effect_sql(name: str) -> str:
    d = f"({name}1 - normal1)"
    return f"round(normal1, 5) AS {name}_base_median, round({name}1, 5) AS {name}_target_median, round({d}, 5) AS {name}_delta, round({d} / nullif((normal2 - normal0) / 1.349, 0), 5) AS {name}_effect, CASE WHEN {d} > 1e-12 THEN '↑' WHEN {d} < -1e-12 THEN '↓' ELSE '≈' END AS {name}_direction"


@query(EFFECTS + f" SELECT feature, {_effect_sql('fault')}, {_effect_sql('idle')}, round(greatest(abs((fault1 - normal1) / nullif((normal2 - normal0) / 1.349, 0)), abs((idle1 - normal1) / nullif((normal2 - normal0) / 1.349, 0))), 5) AS max_abs_effect FROM q")
def effect_table(spark, sf_dir):
    return rounded(analysis.effect_table(line_rows(spark, sf_dir), list(LINE_SETTINGS.channels), "kind", {"fault": ("normal", "fault"), "idle": ("normal", "idle")}), 5)


@query(f"WITH {LI_ROWS} SELECT group_id, round(median(quantity), 6) AS quantity, round(median(price), 4) AS price FROM seg_rows WHERE source = 'fault' GROUP BY 1")
def event_medians(spark, sf_dir):
    out = analysis.event_medians(line_rows(spark, sf_dir), ["quantity", "price"])
    return out.select("group_id", F.round("quantity", 6).alias("quantity"), F.round("price", 4).alias("price"))


@query(f"WITH {LI_ROWS} SELECT kind, a AS sensor_a, b AS sensor_b, round(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)), 6) AS correlation FROM (" + " UNION ALL ".join(f"SELECT kind, '{a}' AS a, '{b}' AS b, {a} AS x, {b} AS y FROM seg_rows" for a in ("quantity", "price", "discount") for b in ("quantity", "price", "discount")) + ") GROUP BY ALL")
def correlation_matrix(spark, sf_dir):
    return rounded(analysis.correlations(line_rows(spark, sf_dir), LINE_SETTINGS.channels, "kind"))


@query(f"WITH {LI_ROWS}, {MANIFEST} SELECT coalesce(CASE WHEN duration_sec < 86400 THEN '<1d' WHEN duration_sec < 864000 THEN '1-<10d' ELSE '>=10d' END) AS duration_bin, count(*) AS events FROM manifest WHERE source = 'fault' GROUP BY 1")
def duration_bins(spark, sf_dir):
    m = sessions.segment_manifest(line_rows(spark, sf_dir)).where("source = 'fault'")
    return m.groupBy(scalar.duration_bin(F.col("duration_sec"), (86_400.0, 864_000.0), ("<1d", "1-<10d", ">=10d")).alias("duration_bin")).agg(F.count(F.lit(1)).alias("events"))


DELAYS = f"""WITH {EV_ROWS}, {TRACKS}, {P2}, t AS (SELECT *, (t_us - min(t_us) OVER (PARTITION BY group_id)) / 1e6 AS t FROM p2 WHERE kind = 'fault'),
  d AS (SELECT group_id, count(*) AS n_samples, max(t) AS duration_sec, bool_or(final_alarm) AS detected, min(CASE WHEN final_alarm THEN t END) AS delay_sec, min(CASE WHEN sample_alarm THEN t END) AS s, min(CASE WHEN short_alarm THEN t END) AS h, min(CASE WHEN long_alarm THEN t END) AS l, max(CASE WHEN place > 2 THEN spread / -40 END) AS max_ratio_event_sample FROM t GROUP BY 1),
  e AS (SELECT *, CASE WHEN least(s, h, l) IS NULL THEN 'none' ELSE concat_ws('+', CASE WHEN abs(s - least(s, h, l)) < 1e-9 THEN 'sample' END, CASE WHEN abs(h - least(s, h, l)) < 1e-9 THEN 'win05' END, CASE WHEN abs(l - least(s, h, l)) < 1e-9 THEN 'win1' END) END AS "leading" FROM d)"""


def delay_rows(spark, sf_dir):
    rows = final_rows(spark, sf_dir).withColumns({"sample_score": F.col("spread"), "short_score": F.col("k"), "long_score": F.col("value")})
    return analysis.delay_decomposition(rows, {"sample": F.lit(-40.0), "win05": F.lit(70.0), "win1": F.lit(60.0)})


@query(DELAYS + ' SELECT group_id, n_samples, round(duration_sec, 6) AS duration_sec, detected, round(delay_sec, 6) AS delay_sec, round(s, 6) AS first_sample_sec, round(h, 6) AS first_win05_sec, round(l, 6) AS first_win1_sec, round(max_ratio_event_sample, 6) AS max_ratio_event_sample, "leading" FROM e')
def delay_decomposition(spark, sf_dir):
    return rounded(delay_rows(spark, sf_dir).select("group_id", "n_samples", "duration_sec", "detected", "delay_sec", "first_sample_sec", "first_win05_sec", "first_win1_sec", "max_ratio_event_sample", "leading"))


@query(DELAYS + ' SELECT "leading", count(*) AS evaluations, count(DISTINCT group_id) AS events, round(avg(delay_sec), 4) AS mean_delay, round(min(delay_sec), 4) AS min_delay, round(max(delay_sec), 4) AS max_delay, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS share_pct FROM e WHERE detected GROUP BY 1')
def leading_detector_summary(spark, sf_dir):
    return rounded(analysis.leading_summary(delay_rows(spark, sf_dir)), 4)


@query(DELAYS.replace("max(CASE WHEN place > 2 THEN spread / -40 END) AS max_ratio_event_sample", "max(CASE WHEN place > 2 AND t <= 1 THEN spread / -40 END) AS r1, max(CASE WHEN place > 4 AND t <= 1 THEN k / 70 END) AS r2, max(CASE WHEN place > 9 AND t <= 1 THEN value / 60 END) AS r3") + """, x AS (SELECT split_part(group_id, '_', 2) AS user_id, * FROM e), c AS (SELECT user_id, "leading", count(*) AS n FROM x GROUP BY 1, 2), m AS (SELECT user_id, "leading" FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, "leading") = 1)
  SELECT x.user_id AS group_id, any_value(m."leading") AS leading_mode, count(*) AS repeats, count(*) FILTER (WHERE detected) AS detected, round(avg(delay_sec), 4) AS mean_delay, round(median(s), 4) AS first_sample_med, round(median(h), 4) AS first_win05_med, round(median(l), 4) AS first_win1_med,
  round(median(r1), 4) AS ratio1s_sample, round(median(r2), 4) AS ratio1s_win05, round(median(r3), 4) AS ratio1s_win1 FROM x JOIN m USING (user_id) GROUP BY 1""")
def leading_detector_mode(spark, sf_dir):
    d = delay_rows(spark, sf_dir).withColumn("group_id", F.split("group_id", "_")[1])
    return rounded(analysis.delay_summary(d).drop("n_samples", "duration_sec"), 4)


@query(DELAYS + ", x AS (SELECT split_part(group_id, '_', 2) AS user_id, detected, delay_sec FROM e) SELECT user_id AS group_id, count(*) AS repeats, count(*) FILTER (WHERE detected) AS detected, round(avg(delay_sec), 4) AS delay_mean_sec, count(*) FILTER (WHERE NOT detected) AS missed, round(count(*) FILTER (WHERE detected) / count(*), 4) AS detection_rate FROM x GROUP BY 1")
def detection_frequency(spark, sf_dir):
    d = delay_rows(spark, sf_dir).withColumn("group_id", F.split("group_id", "_")[1])
    return rounded(metrics.detection_frequency(d), 4)


@query("SELECT l_returnflag AS system, round(avg(l_discount), 6) AS l_discount_mean, round(stddev_samp(l_discount), 6) AS l_discount_std, round(avg(l_tax), 6) AS l_tax_mean, round(stddev_samp(l_tax), 6) AS l_tax_std FROM lineitem GROUP BY 1")
def repeat_summary(spark, sf_dir):
    return rounded(metrics.mean_and_std(table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "system"), ["system"], ["l_discount", "l_tax"]))


# row expressions


@query("SELECT event_id, CAST(CASE WHEN ts BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00' THEN 1 ELSE 0 END AS BIGINT) AS idle FROM events")
def idle_between(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalar.between_times(F.col("ts"), datetime(2024, 1, 2), datetime(2024, 1, 20)).cast("bigint").alias("idle"))


@query(f"WITH {EV_ROWS}, {TRACKS}, {P2} SELECT group_id, seq, round(CASE WHEN k > 0 THEN value / k END, 9) AS score_ratio, CASE WHEN final_alarm THEN 'ALARM' WHEN or_3 THEN 'WARNING' ELSE 'normal' END AS shown, CASE WHEN source = 'fault' THEN 'fault' WHEN idle = 1 THEN 'idle' ELSE 'normal' END AS row_kind, CAST(regexp_extract(group_id, '[0-9]+$') AS BIGINT) AS number FROM p2")
def row_states(spark, sf_dir):
    rows = final_rows(spark, sf_dir)
    return rows.select("group_id", "seq", F.round(scalar.score_ratio(F.col("value"), F.col("k")), 9).alias("score_ratio"), scalar.alarm_state(F.col("final_alarm"), F.col("or_3")).alias("shown"), scalar.stream_kind(F.col("source"), F.col("state"), F.col("idle")).alias("row_kind"), F.regexp_extract("group_id", "[0-9]+$", 0).cast("long").alias("number"))


@query("SELECT l_orderkey, l_partkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_linenumber / 7.0 AS step, round(l_discount, 4) AS percent, NULL::DOUBLE AS nothing FROM lineitem")
def log_progress(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    step = F.concat(F.lit("on 2024/11/28 fold "), F.col("l_linenumber"), F.lit(" / 7 of "), F.col("l_partkey"))
    percent = F.concat(F.format_string("%.2f", 100 * F.col("l_discount")), F.lit("% of step "), F.col("l_linenumber"), F.lit("/7"))
    return li.select("l_orderkey", "l_partkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), scalar.log_progress(step).alias("step"), F.round(scalar.log_progress(percent), 4).alias("percent"), scalar.log_progress(F.concat(F.lit("line "), F.col("l_linenumber"), F.lit(" at 2024/11/28"))).alias("nothing"))


@query(f"WITH {EV_ROWS} SELECT r.group_id, seq, round((t_us - (SELECT min(t_us) FROM seg_rows)) / 1e6, 6) AS t_sec FROM seg_rows r WHERE value IS NOT NULL AND k IS NOT NULL")
def known_rows(spark, sf_dir):
    return rounded(drop_unknown(event_rows(spark, sf_dir), ("value", "k")).select("group_id", "seq", "t_sec"))


@query(f"WITH {EV_ROWS}, g AS (SELECT group_id FROM seg_rows WHERE kind = 'fault' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT group_id, seq, value, round((t_us - min(CASE WHEN state >= 1 THEN t_us END) OVER ()) / 1e6, 6) AS t_sec FROM seg_rows WHERE group_id IN (SELECT group_id FROM g)")
def event_slice(spark, sf_dir):
    rows = event_rows(spark, sf_dir)
    top = rows.where("kind = 'fault'").groupBy("group_id").count().orderBy(F.desc("count"), "group_id").first()
    return rounded(analysis.event_slice(rows, top["group_id"] if top else "").select("group_id", "seq", "value", "t_sec"))


@query(f"WITH {EV_ROWS}, {TRACKS}, {P2} SELECT r.group_id, r.seq, r.value, p.final_alarm FROM seg_rows r JOIN p2 p USING (group_id, t_us, seq)")
def rows_with_results(spark, sf_dir):
    return analysis.with_results(event_rows(spark, sf_dir), final_rows(spark, sf_dir), ["final_alarm"]).select("group_id", "seq", "value", "final_alarm")


@query("SELECT 'final_alarm' AS column, 0::BIGINT AS differing UNION ALL SELECT 'gap_sec', 0 UNION ALL SELECT 'segment_id', 0")
def sessions_in_cells_differ(spark, sf_dir):
    """Sessionization in cells of time against that of whole series: no row may differ."""
    a = final_rows(spark, sf_dir)
    b = tracks(sessions.sessionize_in_cells(event_samples(spark, sf_dir), EVENT_SETTINGS.gap_sec, 604_800.0)).withColumn("final_alarm", alarms.persistent(F.col("or_3"), 2))
    return analysis.differences(a, b, ["final_alarm", "gap_sec", "segment_id"])


@query(f"WITH {EV_ROWS} SELECT source, series, t_us, seq, segment_id, group_id, kind, CAST(label AS BIGINT) AS label, round(gap_sec, 6) AS gap_sec FROM seg_rows")
def sessionize_in_cells(spark, sf_dir):
    rows = sessions.sessionize_in_cells(event_samples(spark, sf_dir), EVENT_SETTINGS.gap_sec, 604_800.0)
    return rounded(rows.select("source", "series", "t_us", "seq", "segment_id", "group_id", "kind", "label", "gap_sec"))


@query("SELECT count(*) AS n, count(value) AS values, count(total) AS totals FROM (SELECT event_id, value, NULL AS total FROM events UNION ALL SELECT o_orderkey, NULL, o_totalprice FROM orders)")
def union_differing(spark, sf_dir):
    a = table(spark, sf_dir, "events").select("event_id", "value")
    b = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_totalprice").alias("total"))
    return a.unionByName(b, allowMissingColumns=True).agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("values"), F.count("total").alias("totals"))


# datasets and errors


@query(f"WITH {LI_ROWS} SELECT kind, f AS feature, count(v) AS known FROM (SELECT kind, 'quantity' AS f, quantity AS v FROM seg_rows UNION ALL SELECT kind, 'price', price FROM seg_rows) GROUP BY ALL")
def feature_coverage(spark, sf_dir):
    return analysis.feature_coverage(line_rows(spark, sf_dir), ["quantity", "price"], "kind")


@query(f"WITH {EV_ROWS}, {WINDOWS3} SELECT f AS feature, count(*) FILTER (WHERE v IS NULL) AS unknown FROM (SELECT 'score' AS f, score AS v FROM win UNION ALL SELECT 'onset', CAST(onset_us AS DOUBLE) FROM win) GROUP BY 1")
def unknown_features(spark, sf_dir):
    w = windows3(event_rows(spark, sf_dir)).withColumn("onset", F.col("onset_us").cast("double"))
    return analysis.unknown_features(w, ["score", "onset"])


@query(f"WITH {LI_ROWS}, {MANIFEST} SELECT group_id FROM manifest WHERE source = 'fault' AND onset_us IS NOT NULL AND duration_sec >= 86400 EXCEPT SELECT group_id FROM seg_rows WHERE quantity >= 25")
def lost_events(spark, sf_dir):
    rows = line_rows(spark, sf_dir)
    events = sessions.event_manifest(sessions.segment_manifest(rows), 864_000.0, 86_400.0)
    return analysis.lost_events(events, rows.where("quantity >= 25"))


#: The delays of each user's events, as evaluations of one event.
MISSES = DELAYS + """, x AS (SELECT split_part(group_id, '_', 2) AS group_id, duration_sec, detected, delay_sec FROM e),
  m AS (SELECT group_id, max(duration_sec) AS duration_sec, count(*) AS evaluations, count(*) FILTER (WHERE detected) AS detected, avg(delay_sec) AS delay_mean_sec, count(*) FILTER (WHERE NOT detected) AS missed FROM x GROUP BY 1),
  b AS (SELECT *, detected / evaluations AS detection_rate, CASE WHEN duration_sec < 0.5 THEN '<0.5s' WHEN duration_sec < 1 THEN '0.5-<1.0s' ELSE '>=1.0s' END AS duration_bin FROM m)"""


def misses(spark, sf_dir):
    return analysis.missed_event_summary(delay_rows(spark, sf_dir).withColumn("group_id", F.split("group_id", "_")[1]))


@query(MISSES + " SELECT group_id, round(duration_sec, 4) AS duration_sec, evaluations, detected, round(delay_mean_sec, 4) AS delay_mean_sec, missed, round(detection_rate, 4) AS detection_rate, duration_bin, CASE WHEN missed > 0 THEN 'any_miss' WHEN evaluations > 0 THEN 'stable_detected' ELSE 'unclassified' END AS status FROM b")
def missed_events(spark, sf_dir):
    return rounded(misses(spark, sf_dir).withColumn("status", scalar.event_status(F.col("evaluations"), F.col("missed"))), 4)


@query(MISSES + " SELECT n.name AS duration_bin, count(b.group_id) AS events, CAST(coalesce(sum(evaluations), 0) AS BIGINT) AS evaluations, CAST(coalesce(sum(detected), 0) AS BIGINT) AS detected, round(sum(detected) / nullif(sum(evaluations), 0), 4) AS detection_rate FROM (VALUES ('<0.5s'), ('0.5-<1.0s'), ('>=1.0s')) n(name) LEFT JOIN b ON b.duration_bin = n.name GROUP BY 1")
def duration_summary(spark, sf_dir):
    return rounded(analysis.duration_summary(misses(spark, sf_dir)).drop("position"), 4)


@query(MISSES + " SELECT group_id, format('{} ({:.2f} s): missed in {} of {} evaluations', group_id, duration_sec, missed, evaluations) AS sentence FROM b WHERE missed > 0 ORDER BY missed DESC, duration_sec, group_id LIMIT 3")
def missed_sentences(spark, sf_dir):
    return analysis.missed_sentences(misses(spark, sf_dir))


@query(DELAYS + " SELECT group_id, round(delay_sec, 1) IN (0.3, 0.5, 1.0) AS at_floor FROM e WHERE detected")
def delay_floor(spark, sf_dir):
    return analysis.at_floor(delay_rows(spark, sf_dir)).select("group_id", "at_floor")


@query("WITH t AS (SELECT l_returnflag AS g, CAST(l_linenumber AS DOUBLE) / 10 AS quantile, max(l_extendedprice) AS threshold FROM lineitem GROUP BY 1, 2), b AS (SELECT *, lag(threshold) OVER (PARTITION BY g ORDER BY quantile) AS before FROM t) SELECT g, quantile, threshold FROM b WHERE threshold < before - 1e-12")
def threshold_breaks(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("g"), (F.col("l_linenumber").cast("double") / 10).alias("quantile")).agg(F.max("l_extendedprice").alias("threshold"))
    return thresholds.monotone(t, ["g"])


FOLD_WINDOWS = f"WITH {EV_ROWS}, {WINDOWS3}, fw AS (SELECT w.*, CAST(floor({_share(0).replace('group_id', 'w.group_id')} * 3) AS BIGINT) AS fold FROM win w)"


@query(FOLD_WINDOWS + " SELECT fold, count(*) FILTER (WHERE label = 1 AND alarm AND kind <> 'idle') AS tp, count(*) FILTER (WHERE label = 0 AND alarm AND kind <> 'idle') AS fp, count(*) FILTER (WHERE label = 0 AND NOT alarm AND kind <> 'idle') AS tn, count(*) FILTER (WHERE label = 1 AND NOT alarm AND kind <> 'idle') AS fn, count(*) FILTER (WHERE kind = 'idle') AS idle_windows, count(*) FILTER (WHERE kind = 'idle' AND alarm) AS idle_alarm_windows FROM fw GROUP BY 1")
def fold_counts(spark, sf_dir):
    w = windows3(event_rows(spark, sf_dir)).withColumn("fold", F.floor(splits.hash_share(F.col("group_id")) * 3))
    out = metrics.fold_counts(w, "alarm", 43_200.0, ["fold"])
    return out.select("fold", *(F.col(c).cast("bigint").alias(c) for c in ("tp", "fp", "tn", "fn", "idle_windows", "idle_alarm_windows")))


@query(FOLD_WINDOWS + """, c AS (SELECT count(*) FILTER (WHERE label = 1 AND alarm) AS tp, count(*) FILTER (WHERE label = 0 AND alarm) AS fp, count(*) FILTER (WHERE label = 0 AND NOT alarm) AS tn, count(*) FILTER (WHERE label = 1 AND NOT alarm) AS fn FROM fw WHERE kind <> 'idle'),
  i AS (SELECT count(*) FILTER (WHERE alarm) / nullif(count(*), 0) AS idle_window_fpr FROM fw WHERE kind = 'idle'),
  h AS (SELECT group_id, min(onset_us) AS onset_us, min(CASE WHEN alarm AND end_us >= onset_us THEN end_us END) AS hit FROM fw WHERE source = 'fault' GROUP BY 1)
  SELECT (SELECT count(*) FROM h) AS n_events, (SELECT count(hit) FROM h) AS detected_events, round((SELECT avg((hit - onset_us) / 1e6 - 100) FROM h), 4) AS delay_minus_window_mean_sec, round(2 * tp / nullif(2 * tp + fp + fn, 0), 4) AS pooled_f1, round(tp / nullif(tp + fp, 0), 4) AS pooled_precision, round(tp / nullif(tp + fn, 0), 4) AS pooled_recall, round(fp / nullif(fp + tn, 0), 4) AS normal_window_fpr, round(idle_window_fpr, 4) AS idle_window_fpr FROM c, i""")
def fold_totals(spark, sf_dir):
    w = windows3(event_rows(spark, sf_dir)).withColumns({"fold": F.floor(splits.hash_share(F.col("group_id")) * 3), "system": F.lit("one")})
    counts = metrics.fold_counts(w, "alarm", 43_200.0, ["system", "fold"])
    events = metrics.window_events(w, "alarm", ["system"]).withColumn("window_sec", F.lit(100.0))
    out = metrics.fold_totals(counts, events, ["system"])
    return rounded(out.select("n_events", "detected_events", "delay_minus_window_mean_sec", "pooled_f1", "pooled_precision", "pooled_recall", "normal_window_fpr", "idle_window_fpr"), 4)


@query(CYCLES + """, f AS (SELECT *, (hit - onset) / 1e6 AS delay FROM cyc WHERE kind = 'fault'), d AS (SELECT group_id, (max(t_us) - min(t_us)) / 1e6 AS duration_sec, min(CASE WHEN final_alarm THEN place END) AS samples FROM p2 WHERE kind = 'fault' GROUP BY 1)
  SELECT (SELECT count(*) FROM f) AS n_events, round((SELECT count(hit) / count(*) FROM f), 4) AS event_detection_rate, (SELECT count(*) FROM d WHERE duration_sec >= 3600 - 1e-9) AS n_events_long, round((SELECT avg(delay) FROM f), 4) AS delay_mean_sec, round((SELECT median(delay) FROM f), 4) AS delay_median_sec, round((SELECT avg(samples) FROM d), 4) AS samples_to_alarm_mean,
  count(*) FILTER (WHERE kind = 'normal') AS normal_cycles, count(*) FILTER (WHERE kind = 'normal' AND episodes > 0) AS fa_cycles, CAST(coalesce(sum(episodes) FILTER (WHERE kind = 'normal'), 0) AS BIGINT) AS fa_episodes, CAST(coalesce(sum(n) FILTER (WHERE kind = 'normal'), 0) * 60 AS DOUBLE) AS exposure_sec, count(*) FILTER (WHERE kind = 'idle') AS idle_cycles,
  round(sum(alarm_rows) FILTER (WHERE kind = 'idle') / nullif(sum(n) FILTER (WHERE kind = 'idle'), 0), 4) AS idle_sample_fpr FROM cyc""")
def sample_fold_metrics(spark, sf_dir):
    out = metrics.sample_fold_metrics(final_rows(spark, sf_dir), "final_alarm", 60.0, 3600.0, [])
    return rounded(out.select("n_events", "event_detection_rate", "n_events_long", "delay_mean_sec", "delay_median_sec", "samples_to_alarm_mean", "normal_cycles", "fa_cycles", "fa_episodes", "exposure_sec", "idle_cycles", "idle_sample_fpr"), 4)


@query(f"WITH {LI_ROWS} SELECT kind, round(quantile_cont(quantity, 0.25), 4) AS q25, round(quantile_cont(quantity, 0.5), 4) AS q50, round(quantile_cont(price, 0.99), 4) AS p99, count(*) AS n FROM seg_rows GROUP BY 1")
def exact_quantiles(spark, sf_dir):
    rows = line_rows(spark, sf_dir)
    a = thresholds.exact_quantiles(rows, "quantity", (0.25, 0.5), ["kind"]).select("kind", F.col("quantiles")[0].alias("q25"), F.col("quantiles")[1].alias("q50"), "n")
    b = thresholds.exact_quantiles(rows, "price", (0.99,), ["kind"]).select("kind", F.col("quantiles")[0].alias("p99"))
    return rounded(a.join(b, "kind"), 4)


# the detector, with models so plain that SQL has their scores: the squared log of the value, or of its mean over a window

DETECTOR = """sc AS (SELECT *, ln(1 + abs(value)) * ln(1 + abs(value)) AS raw, count(*) OVER w3 AS n3, count(*) OVER w5 AS n5, power(ln(1 + abs(avg(value) OVER w3)), 2) AS s3, power(ln(1 + abs(avg(value) OVER w5)), 2) AS s5
    FROM seg_rows WINDOW w3 AS (PARTITION BY group_id ORDER BY t_us, seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), w5 AS (PARTITION BY group_id ORDER BY t_us, seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
  sm AS (SELECT *, CASE WHEN n3 = 3 THEN avg(raw) OVER (PARTITION BY group_id ORDER BY t_us, seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) ELSE 0 END AS sample_score, CASE WHEN n3 = 3 THEN s3 END AS short_score, CASE WHEN n5 = 5 THEN s5 END AS long_score FROM sc),
  al AS (SELECT *, n3 = 3 AND sample_score >= 16 AS sample_alarm, coalesce(short_score >= 17, false) AS short_alarm, coalesce(long_score >= 16.5, false) AS long_alarm FROM sm),
  r3 AS (SELECT *, sample_alarm OR short_alarm OR long_alarm AS or_3 FROM al),
  st AS (SELECT *, or_3 AND coalesce(lag(or_3) OVER (PARTITION BY group_id ORDER BY t_us, seq), false) AS final_alarm, CAST(or_3 AS INT) + CAST(coalesce(lag(or_3) OVER (PARTITION BY group_id ORDER BY t_us, seq), false) AS INT) AS persistence_count FROM r3)"""
STEPS = f"WITH {EV_ROWS}, {DETECTOR} SELECT source, CAST(series AS VARCHAR) AS series, t_us, seq, segment_id, round(sample_score, 6) AS sample_score, round(short_score, 6) AS short_score, round(long_score, 6) AS long_score, sample_alarm, short_alarm, long_alarm, or_3, final_alarm, CAST(persistence_count AS BIGINT) AS persistence_count"


def plain_detector() -> Detector:
    names = features_of(EVENT_SETTINGS)
    models = {}
    for name, features in names.items():
        n = len(features)
        models[name] = Gaussian(features, [0.0] * n, [[float(i == j == 0) for j in range(n)] for i in range(n)], [0.0] * n)
    return Detector(models, {"sample": 16.0, "short": 17.0, "long": 16.5}, EVENT_SETTINGS)


STEP_COLUMNS = ("source", "series", "t_us", "seq", "segment_id", "sample_score", "short_score", "long_score", "sample_alarm", "short_alarm", "long_alarm", "or_3", "final_alarm", "persistence_count")


@query(STEPS + " FROM st")
def detection(spark, sf_dir):
    out = detect(event_rows(spark, sf_dir), plain_detector()).withColumn("series", F.col("series").cast("string"))
    return rounded(out.select(*STEP_COLUMNS))


def _steps(spark, sf_dir):
    samples = event_samples(spark, sf_dir)
    raw = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    return run_stream(detect_stream(to_samples(raw, EVENTS).select(*samples.columns), plain_detector()), "steps")


@query(STEPS + ", CASE WHEN source = 'fault' THEN 'fault' WHEN idle = 1 THEN 'idle' ELSE 'normal' END AS kind, CAST(state AS BIGINT) AS ground_truth, round(gap_sec, 6) AS gap_sec FROM st")
def stream_detection(spark, sf_dir):
    """The detector over the events as a stream, against the same rows at once."""
    return rounded(_steps(spark, sf_dir).select(*STEP_COLUMNS, "kind", "ground_truth", "gap_sec"))


@query(f"WITH {EV_ROWS}, {DETECTOR} SELECT source, CASE WHEN source = 'fault' THEN 'fault' WHEN idle = 1 THEN 'idle' ELSE 'normal' END AS kind, count(*) AS rows, count(*) FILTER (WHERE final_alarm) AS alarm_rows, 0::BIGINT AS late_rows, 0::BIGINT AS invalid_rows FROM st GROUP BY ALL")
def stream_counts(spark, sf_dir):
    out = running_counts(_steps(spark, sf_dir))
    return out.select("source", "kind", "rows", "alarm_rows", F.coalesce("late_rows", F.lit(0)).alias("late_rows"), F.coalesce("invalid_rows", F.lit(0)).alias("invalid_rows"))


# the queries over series of any length, sources and streams register themselves
from tidewatch.plans import cv_queries, long_queries, source_queries, split_queries, stream_queries  # noqa: E402, F401
