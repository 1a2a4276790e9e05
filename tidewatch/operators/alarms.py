"""Alarms over rows of a segment: smoothing, persistence, tolerance, combinations, and alarms between windows and rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.scalar import seconds
from tidewatch.operators.windows import in_segment


def smoothed(score: Column, k: int, how: str = "mean", least: int | None = None) -> Column:
    """The trailing mean or max of k rows; null before there are `least` (default k) rows."""
    frame = in_segment().rowsBetween(1 - k, 0)
    value = (F.max if how == "max" else F.avg)(score).over(frame)
    return F.when(F.count(F.lit(1)).over(frame) >= (least or k), value)


def persistent(alarm: Column, p: int) -> Column:
    """True where the last p rows of the segment all have the alarm; never before there are p rows."""
    frame = in_segment().rowsBetween(1 - p, 0)
    return (F.min(alarm.cast("int")).over(frame) == 1) & (F.count(F.lit(1)).over(frame) >= p)


def tolerant(alarm: Column, n: int) -> Column:
    """True where any of the last n rows has the alarm."""
    return F.max(alarm.cast("int")).over(in_segment().rowsBetween(1 - n, 0)) == 1


def rising(alarm: Column) -> Column:
    """True where an alarm starts."""
    return alarm & ~F.coalesce(F.lag(alarm).over(in_segment()), F.lit(False))


def combine(rows: DataFrame, tolerance: int = 3, corroboration: int = 5) -> DataFrame:
    """The nine combinations of the alarms long_alarm, short_alarm and sample_alarm."""
    long, short, sample = F.col("long_alarm"), F.col("short_alarm"), F.col("sample_alarm")
    votes = lambda cols: sum((c.cast("int") for c in cols), F.lit(0)) >= 2
    rows = rows.withColumns({"or_3": long | short | sample})
    either = F.col("or_3")
    return rows.withColumns(
        {
            "long_only": long,
            "short_only": short,
            "sample_only": sample,
            "or_3_p2": persistent(either, 2),
            "or_3_p3": persistent(either, 3),
            "two_of_3_exact": votes((long, short, sample)),
            "two_of_3_tol3": votes([tolerant(c, tolerance) for c in (long, short, sample)]),
            "or_3_sample_corrob": long | short | (sample & tolerant(long | short, corroboration)),
        }
    )


COMBINATIONS = ("long_only", "short_only", "sample_only", "or_3", "or_3_p2", "or_3_p3", "two_of_3_exact", "two_of_3_tol3", "or_3_sample_corrob")


def k_consecutive(windows: DataFrame, threshold: Column, k: int, out: str = "alarm_k", tolerance_sec: float = 1e-6) -> DataFrame:
    """out: true on the k-th and later of consecutive high-score windows of a group.

    Windows follow each other if their start step is the group's median positive step, within 2 %. A high window that
    doesn't follow starts a run of its own.
    """
    along = Window.partitionBy("group_id").orderBy("start_us", "end_us")
    high = F.coalesce(F.col("score") >= threshold, F.lit(False))
    if k <= 1:
        return windows.withColumn(out, high)
    rows = windows.withColumns({"_high": high, "_step": seconds(F.col("start_us"), F.lag("start_us").over(along))})
    rows = rows.withColumn("_expected", F.median(F.when(F.col("_step") > 0, F.col("_step"))).over(Window.partitionBy("group_id")))
    near = F.abs(F.col("_step") - F.col("_expected")) <= F.greatest(F.lit(tolerance_sec), F.col("_expected") * 0.02)
    follows = F.coalesce(F.col("_step").isNull() | F.col("_expected").isNull() | near, F.lit(False))
    rows = rows.withColumn("_run", F.sum((~F.col("_high") | ~follows).cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    # a low window opens a run that it isn't counted in
    length = F.sum(F.col("_high").cast("int")).over(Window.partitionBy("group_id", "_run").orderBy("start_us", "end_us").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(out, F.col("_high") & (length >= k)).drop("_high", "_step", "_expected", "_run")


def alarms_to_rows(rows: DataFrame, windows: DataFrame, alarm: str, out: str) -> DataFrame:
    """out: true for rows in [end, end + length) of an alarmed window of their segment, when its alarm is known.

    The intervals are put among the rows where they begin; a row is in one if the latest end so far lies behind it. Nothing is
    joined, so many intervals of a long segment cost no more than their rows.
    """
    width = F.col("end_us") - F.col("start_us")
    marks = windows.where(F.col(alarm)).select("group_id", F.col("end_us").alias("t_us"), (F.col("end_us") + width).alias("_to"))
    both = rows.withColumn("_to", F.lit(None).cast("long")).unionByName(marks, allowMissingColumns=True)
    # of one time, the intervals come first
    so_far = Window.partitionBy("group_id").orderBy("t_us", F.col("_to").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn(out, F.coalesce(F.max("_to").over(so_far) > F.col("t_us"), F.lit(False)))
    return both.where("_to is null").select(*rows.columns, out)


def windows_with_alarms(windows: DataFrame, rows: DataFrame, alarm: str, out: str) -> DataFrame:
    """out: true for windows in whose interval after the end (as above) a row of kind normal has the alarm.

    The alarmed rows are put among the windows by time; each window looks at the first of them from its end on.
    """
    hits = rows.where(F.col(alarm) & (F.col("kind") == "normal")).select("group_id", F.col("t_us").alias("_hit"))
    both = windows.withColumn("_hit", F.lit(None).cast("long")).unionByName(hits, allowMissingColumns=True)
    at = F.coalesce("_hit", "end_us")
    ahead = Window.partitionBy("group_id").orderBy(at, F.col("_hit").isNotNull()).rowsBetween(0, Window.unboundedFollowing)
    until = 2 * F.col("end_us") - F.col("start_us")
    both = both.withColumn(out, F.coalesce(F.min("_hit").over(ahead) < until, F.lit(False)))
    return both.where("_hit is null").select(*windows.columns, out)


def derive_alarms(scored: DataFrame, thresholds: dict[str, Column], settings) -> DataFrame:
    """All alarms of the streaming detector from its stored scores, by window functions only.

    scored has sample_raw, short_score and long_score (null before the windows are full).
    """
    sample = smoothed(F.col("sample_raw"), settings.smooth)
    rows = scored.withColumn("sample_score", F.coalesce(sample, F.lit(0.0))).withColumn("_ready", sample.isNotNull())
    at = lambda c, name: F.coalesce(F.col(c) >= thresholds[name], F.lit(False))
    rows = rows.withColumns({"sample_alarm": F.col("_ready") & at("sample_score", "sample"), "short_alarm": at("short_score", "short"), "long_alarm": at("long_score", "long")})
    rows = rows.withColumn("or_3", F.col("sample_alarm") | F.col("short_alarm") | F.col("long_alarm"))
    p = settings.persistence
    active = F.array_compact(F.array(F.when(F.col("sample_alarm"), "sample"), F.when(F.col("short_alarm"), "0.5s"), F.when(F.col("long_alarm"), "1.0s")))
    count = F.sum(F.col("or_3").cast("int")).over(in_segment().rowsBetween(1 - p, 0))
    return rows.withColumns({"final_alarm": persistent(F.col("or_3"), p), "active_detectors": active, "persistence_count": count}).drop("_ready")
