"""Queries over the whole event table as one single series, which no task holds: in cells of rows."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import alarms, cells, windows
from tidewatch.plans.queries import query, rounded, tracks
from tidewatch.plans.star import EVENT_SETTINGS, event_samples

HOUR = 3_600_000_000
#: Windows of an hour that start at least ten minutes apart and hold at least 12 samples.
ONE_SETTINGS = replace(EVENT_SETTINGS, window_sec=3600.0, step_sec=600.0, sampling_sec=240.0, fill=0.8)

ONE = """samples AS (SELECT 'all' AS group_id, 'normal' AS source, 'normal' AS kind, epoch_us(ts) AS t_us, event_id AS seq,
    value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, value - CAST(json_extract_string(props, '$.k') AS DOUBLE) AS spread,
    CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS state, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS idle FROM events)"""
ONE_TRACKS = """tracks AS (SELECT *, value >= 60 AS long_alarm, k >= 70 AS short_alarm, spread <= -40 AS sample_alarm, (value >= 60 OR k >= 70 OR spread <= -40) AS or_3 FROM samples)"""
#: The walk over one series: each row's window and hop are counts of a range, and the recursion follows them.
ONE_STARTS = f"""{ONE}, e AS (SELECT t_us, row_number() OVER (ORDER BY t_us, seq) AS i, count(*) OVER (ORDER BY t_us RANGE BETWEEN CURRENT ROW AND {HOUR - 1} FOLLOWING) AS inside,
    count(*) OVER (ORDER BY t_us RANGE BETWEEN CURRENT ROW AND {HOUR // 6 - 1} FOLLOWING) AS hop, max(t_us) OVER () AS last FROM samples),
  chase AS (SELECT i, t_us, inside, hop, last FROM e WHERE i = 1 UNION ALL
    SELECT e.i, e.t_us, e.inside, e.hop, e.last FROM chase c JOIN e ON e.i = CASE WHEN c.inside >= 12 THEN c.i + c.hop ELSE c.i + 1 END WHERE c.t_us + {HOUR} <= c.last),
  starts AS (SELECT 'all' AS group_id, t_us AS start_us, t_us + {HOUR} AS end_us FROM chase WHERE inside >= 12 AND t_us + {HOUR} <= last)"""


def one_series(spark, sf_dir: str) -> DataFrame:
    rows = event_samples(spark, sf_dir)
    return rows.withColumns({"group_id": F.lit("all"), "source": F.lit("normal"), "series": F.lit(0), "segment_id": F.lit(0), "kind": F.lit("normal")})


@query(f"WITH RECURSIVE {ONE_STARTS} SELECT * FROM starts")
def window_starts_one_series(spark, sf_dir):
    s = ONE_SETTINGS
    return cells.window_starts_in_cells(one_series(spark, sf_dir), s.window_sec, s.step_sec, s.min_samples)


def _stats(x: str) -> str:
    return f"round(avg({x}), 6) AS {x}_mean, round(coalesce(stddev_samp({x}), 0), 5) AS {x}_std, round(sqrt(avg({x} * {x})), 5) AS {x}_rms, round(max({x}) - min({x}), 5) AS {x}_ptp, round(86400 * regr_slope({x}, sec), 4) AS {x}_slope_day"


@query(f"""WITH RECURSIVE {ONE_STARTS}, g AS (SELECT *, (t_us - lag(t_us) OVER (ORDER BY t_us, seq)) / 1e6 AS gap FROM samples),
  m AS (SELECT s.start_us, s.end_us, g.*, (g.t_us - s.start_us) / 1e6 AS sec FROM starts s JOIN g ON g.t_us >= s.start_us AND g.t_us < s.end_us)
  SELECT start_us, end_us, count(*) AS sample_count, round((max(t_us) - min(t_us)) / 1e6, 6) AS actual_duration_sec, round(coalesce(max(CASE WHEN t_us > start_us THEN gap END), 0), 6) AS max_gap_sec,
  {', '.join(_stats(x) for x in EVENT_SETTINGS.channels)}, round(coalesce(covar_pop(value, k) / nullif(stddev_pop(value) * stddev_pop(k), 0), 0), 6) AS value_k_corr,
  round(avg(CAST(idle AS DOUBLE)), 6) AS idle_ratio, round(avg(CAST(state AS DOUBLE)), 6) AS fault_ratio, (SELECT min(t_us) FROM samples WHERE state >= 1) AS onset_us FROM m GROUP BY start_us, end_us""")
def time_windows_one_series(spark, sf_dir):
    w = windows.time_windows(one_series(spark, sf_dir), ONE_SETTINGS, in_cells=True)
    digits = {"actual_duration_sec": 6, "max_gap_sec": 6, "value_k_corr": 6, "idle_ratio": 6, "fault_ratio": 6}
    digits |= {f"{x}_{k}": n for x in EVENT_SETTINGS.channels for k, n in (("mean", 6), ("std", 5), ("rms", 5), ("ptp", 5))}
    slopes = [F.round(86400 * F.col(f"{x}_slope"), 4).alias(f"{x}_slope_day") for x in EVENT_SETTINGS.channels]
    return w.select("start_us", "end_us", "sample_count", "onset_us", *(F.round(c, n).alias(c) for c, n in digits.items()), *slopes)


def _frame(x: str) -> str:
    return f"round(avg({x}) OVER r, 6) AS {x}_mean, round(stddev_samp({x}) OVER r, 5) AS {x}_std, round(sqrt(avg({x} * {x}) OVER r), 5) AS {x}_rms, round(max({x}) OVER r - min({x}) OVER r, 5) AS {x}_ptp, round(86400 * regr_slope({x}, sec) OVER r, 4) AS {x}_slope_day"


@query(f"""WITH {ONE}, s AS (SELECT *, (t_us - min(t_us) OVER ()) / 1e6 AS sec FROM samples), f AS (SELECT seq, {', '.join(_frame(x) for x in EVENT_SETTINGS.channels)},
    round(coalesce(covar_pop(value, k) OVER r / nullif(stddev_pop(value) OVER r * stddev_pop(k) OVER r, 0), 0), 6) AS value_k_corr, count(*) OVER r AS n FROM s WINDOW r AS (ORDER BY t_us, seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) SELECT * EXCLUDE (n) FROM f WHERE n = 10""")
def count_windows_one_series(spark, sf_dir):
    rows = cells.numbered(one_series(spark, sf_dir))
    w = cells.over_cells(rows, 9, lambda r: windows.count_windows(r, 10, EVENT_SETTINGS.channels)).where("window_start_us is not null")
    digits = {"value_k_corr": 6} | {f"{x}_{k}": n for x in EVENT_SETTINGS.channels for k, n in (("mean", 6), ("std", 5), ("rms", 5), ("ptp", 5))}
    slopes = [F.round(86400 * F.col(f"{x}_slope"), 4).alias(f"{x}_slope_day") for x in EVENT_SETTINGS.channels]
    return w.select("seq", *(F.round(c, n).alias(c) for c, n in digits.items()), *slopes)


@query(f"""WITH {ONE}, {ONE_TRACKS} SELECT seq, coalesce(min(CAST(or_3 AS INT)) OVER (o ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 1 AND count(*) OVER (o ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 3, false) AS p3,
  max(CAST(or_3 AS INT)) OVER (o ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 1 AS tolerant5, or_3 AND NOT coalesce(lag(or_3) OVER o, false) AS rising,
  CASE WHEN count(*) OVER (o ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 3 THEN max(value) OVER (o ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS max3 FROM tracks WINDOW o AS (ORDER BY t_us, seq)""")
def alarm_frames_one_series(spark, sf_dir):
    rows = cells.numbered(tracks(one_series(spark, sf_dir)))
    c = F.col("or_3")
    new = {"p3": alarms.persistent(c, 3), "tolerant5": alarms.tolerant(c, 5), "rising": alarms.rising(c), "max3": alarms.smoothed(F.col("value"), 3, "max")}
    return cells.over_cells(rows, 4, lambda r: r.withColumns(new)).select("seq", *new)


#: Windows of three rows of the one series, with their mean value as score.
ONE_WINDOWS = """win AS (SELECT * FROM (SELECT source, group_id, kind, seq, first_value(t_us) OVER r AS start_us, t_us AS end_us, avg(value) OVER r AS score, count(*) OVER r AS n, CAST(NULL AS BIGINT) AS onset_us FROM samples
    WINDOW r AS (ORDER BY t_us, seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) WHERE n = 3)"""


def one_windows(spark, sf_dir: str) -> DataFrame:
    r = windows.in_segment().rowsBetween(-2, 0)
    rows = cells.numbered(one_series(spark, sf_dir))
    new = {"start_us": F.first("t_us").over(r), "end_us": F.col("t_us"), "score": F.avg("value").over(r), "_n": F.count(F.lit(1)).over(r)}
    out = cells.over_cells(rows, 2, lambda x: x.withColumns(new)).where("_n = 3").withColumns({"onset_us": F.lit(None).cast("long"), "alarm": F.col("score") >= 40})
    return out.select("source", "group_id", "kind", "seq", "start_us", "end_us", "score", "onset_us", "alarm")


@query(f"""WITH {ONE}, {ONE_WINDOWS}, s AS (SELECT *, (start_us - lag(start_us) OVER (ORDER BY start_us, end_us)) / 1e6 AS step FROM win), e AS (SELECT *, (SELECT median(step) FROM s WHERE step > 0) AS expected FROM s),
  f AS (SELECT *, score >= 40 AS high, coalesce(step IS NULL OR expected IS NULL OR abs(step - expected) <= greatest(1e-6, expected * 0.02), false) AS follows FROM e),
  r AS (SELECT *, sum(CASE WHEN high AND follows THEN 0 ELSE 1 END) OVER (ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS run FROM f)
  SELECT seq, high AND sum(CAST(high AS INT)) OVER (PARTITION BY run ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) >= 2 AS alarm_k FROM r""")
def k_consecutive_one_series(spark, sf_dir):
    return cells.k_consecutive_in_cells(one_windows(spark, sf_dir), F.lit(40.0), 2).select("seq", "alarm_k")


@query(f"""WITH {ONE}, {ONE_WINDOWS}, y AS (SELECT *, score >= 40 AND NOT coalesce(lag(score >= 40) OVER o AND (start_us - lag(start_us) OVER o) / 1e6 <= 450, false) AS new, max(end_us) OVER (ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM win WINDOW o AS (ORDER BY start_us, end_us))
  SELECT count(*) FILTER (WHERE new) AS n_episodes, round(sum(greatest(0, end_us - greatest(start_us, coalesce(reached, start_us)))) / 1e6, 3) AS exposure_sec, 1::BIGINT AS n_groups, CAST(bool_or(new) AS BIGINT) AS n_fa_groups FROM y""")
def exposure_one_series(spark, sf_dir):
    return rounded(cells.window_false_alarms_in_cells(one_windows(spark, sf_dir), "alarm", 300.0), 3)


@query(f"""WITH {ONE}, {ONE_WINDOWS}, a AS (SELECT end_us AS t0, 2 * end_us - start_us AS t1 FROM win WHERE score >= 40),
  b AS (SELECT t_us, seq, true AS is_row, CAST(NULL AS BIGINT) AS t1 FROM samples UNION ALL SELECT t0, 0, false, t1 FROM a), c AS (SELECT *, max(t1) OVER (ORDER BY t_us, is_row, seq ROWS UNBOUNDED PRECEDING) AS reached FROM b)
  SELECT seq, coalesce(reached > t_us, false) AS on_row FROM c WHERE is_row""")
def window_alarms_one_series(spark, sf_dir):
    rows = one_series(spark, sf_dir)
    return cells.alarms_to_rows_in_cells(rows, one_windows(spark, sf_dir), "alarm", "on_row").select("seq", "on_row")
