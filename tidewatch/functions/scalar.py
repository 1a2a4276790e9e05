"""Scalar expressions: Column in, Column out."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(later: Column, earlier: Column) -> Column:
    """Seconds between two times in microseconds."""
    return (later - earlier) / F.lit(1e6)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def signed_log1p(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite: NaN compares above all numbers in Spark, so none may reach a threshold."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def score_ratio(score: Column, threshold: Column) -> Column:
    """score / threshold, null unless the threshold is finite and above 0."""
    good = finite(threshold)
    return F.when(good > 0, finite(score) / good)


def between_times(ts: Column, low, high) -> Column:
    """1 where low <= ts <= high, else 0."""
    return F.when(ts.between(F.lit(low), F.lit(high)), 1).otherwise(0)


def label_of(state: Column) -> Column:
    return (F.coalesce(state, F.lit(0)) >= 1).cast("int")


def kind_of(source: Column, idle_ratio: Column) -> Column:
    return F.when(source == "fault", "fault").when(idle_ratio >= 0.5, "idle").otherwise("normal")


def stream_kind(source: Column, state: Column, idle: Column) -> Column:
    """The kind of one row of a stream, before its segment is known."""
    fault = (source == "fault") | ((source == "external") & (F.coalesce(state, F.lit(0)) >= 1))
    return F.when(fault, "fault").when(F.coalesce(idle, F.lit(0)) == 1, "idle").otherwise("normal")


DURATION_BINS = ("<0.5s", "0.5-<1.0s", ">=1.0s")


def duration_bin(sec: Column, ends: tuple[float, ...] = (0.5, 1.0), names: tuple[str, ...] = DURATION_BINS) -> Column:
    """The name of the bin of a duration: below the first end, from each end on, from the last end on."""
    out = F.when(sec < ends[0], names[0])
    for end, name in zip(ends[1:], names[1:], strict=False):
        out = out.when(sec < end, name)
    return out.when(sec.isNotNull(), names[-1])


def direction(delta: Column, tolerance: float = 1e-12) -> Column:
    return F.when(delta > tolerance, "↑").when(delta < -tolerance, "↓").when(delta.isNotNull(), "≈")


def alarm_state(final: Column, base: Column) -> Column:
    return F.when(final, "ALARM").when(base, "WARNING").otherwise("normal")


def event_status(evaluations: Column, missed: Column) -> Column:
    return F.when(missed > 0, "any_miss").when(evaluations > 0, "stable_detected").otherwise("unclassified")


def evaluable(duration: Column, least: float) -> Column:
    return F.coalesce(duration >= least, F.lit(False))


def in_fault_zone(source: Column, onset: Column, end: Column) -> Column:
    return F.coalesce((source == "fault") & onset.isNotNull() & (end >= onset), F.lit(False))


def short_feature_name(name: Column) -> Column:
    """AI0_Vibration_mean -> AI0 mean."""
    return F.regexp_replace(F.regexp_replace(name, "_(Vibration|Current)", ""), "_", " ")


def mean_std_text(mean: Column, std: Column, digits: int = 2, suffix: str = "") -> Column:
    return F.when(mean.isNull(), "n/a").when(std.isNull(), F.format_string(f"%.{digits}f%s", mean, F.lit(suffix))).otherwise(F.format_string(f"%.{digits}f ± %.{digits}f%s", mean, std, F.lit(suffix)))


def clock_text(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss.SSS")


def log_progress(line: Column) -> Column:
    """The progress, 0 to 1, that a log line tells: its first percentage up to 100 %, else its last fraction done/total.

    A fraction is two whole numbers alone: no date, path or time of which they are a part. Its total is 2 or more, done at
    most that. Null where a line tells none.
    """
    # what a regular expression found is used several times, but looked for once
    once = lambda found, use: F.get(F.transform(F.array(found), use), F.lit(0))
    percent = F.regexp_extract(line, r"(?<![0-9.%])([0-9]{1,3}(?:[.][0-9]+)?)\s*%", 1)
    share = once(F.when(line.contains("%"), percent), lambda p: F.when(p.try_cast("double") <= 100, p.try_cast("double") / 100))
    # the last of them, as the text before takes all it can
    pair = F.regexp_extract(F.regexp_replace(line, r"\s*/\s*", "/"), r"(?s)^.*(?<![0-9/.:-])([0-9]+/[0-9]+)(?![0-9/.:-])", 1)
    number = lambda parts, k: F.get(parts, F.lit(k)).try_cast("double")
    fraction = once(F.when(line.contains("/"), F.split(pair, "/")), lambda p: F.when((number(p, 1) >= 2) & (number(p, 0) <= number(p, 1)), number(p, 0) / number(p, 1)))
    return F.coalesce(share, fraction)


def group_number(group_id: str) -> int:
    """The segment number at the end of a group id."""
    return int(re.search(r"(\d+)$", group_id)[1])
