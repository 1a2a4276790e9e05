"""Events, false alarms and sample metrics from alarms."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.scalar import in_fault_zone, ratio, seconds
from tidewatch.operators.alarms import rising
from tidewatch.operators.thresholds import exact_median


def count_if(cond: Column) -> Column:
    return F.coalesce(F.sum(F.coalesce(cond, F.lit(False)).cast("long")), F.lit(0))


def confusion(rows: DataFrame, alarm: str, by: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """tp, fp, tn, fn, precision, recall, f1 (0 where undefined) and the false positive rate."""
    if where is not None:
        rows = rows.where(where)
    y, hit = F.col("label") == 1, F.col(alarm)
    out = rows.groupBy(*(by or [])).agg(count_if(y & hit).alias("tp"), count_if(~y & hit).alias("fp"), count_if(~y & ~hit).alias("tn"), count_if(y & ~hit).alias("fn"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return out.withColumns({"precision": zero(ratio(tp, tp + fp)), "recall": zero(ratio(tp, tp + fn)), "f1": zero(ratio(2 * tp, 2 * tp + fp + fn)), "fpr": ratio(fp, fp + tn)})


def window_events(windows: DataFrame, alarm: str, by: list[str] | None = None) -> DataFrame:
    """For each fault group: onset, the first alarmed window that ends at or after it, the delay, and a note."""
    keys = [*(by or []), "group_id"]
    fault = windows.where("source = 'fault'")
    onset = F.min("onset_us").over(Window.partitionBy(*keys))
    fault = fault.withColumn("onset_us", onset)
    hit = F.when(F.col(alarm) & (F.col("end_us") >= F.col("onset_us")), F.struct("end_us", "start_us"))
    out = fault.groupBy(*keys).agg(F.first("onset_us").alias("onset_us"), F.min(hit).alias("_h"))
    detected = F.col("_h").isNotNull()
    return out.select(
        *keys,
        "onset_us",
        detected.alias("detected"),
        F.col("_h.start_us").alias("alarm_start_us"),
        F.col("_h.end_us").alias("alarm_end_us"),
        F.when(detected, F.greatest(F.lit(0.0), seconds(F.col("_h.end_us"), F.col("onset_us")))).alias("delay_sec"),
        F.when(F.col("onset_us").isNull(), "missing_fault_onset_time").when(detected, "detected").otherwise("not_detected").alias("note"),
    )


def event_metrics(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Events, detected events, their share, and delays of the detected."""
    delay = F.when(F.col("detected"), F.col("delay_sec"))
    out = events.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n_events"), count_if(F.col("detected")).alias("detected_events"), F.avg(delay).alias("delay_mean_sec"), F.min(delay).alias("delay_min_sec"), F.max(delay).alias("delay_max_sec"))
    out = _only_row([out, exact_median(events.where("detected"), F.col("delay_sec"), by, "delay_median_sec")], by or [])
    return out.withColumn("event_detection_rate", ratio(F.col("detected_events"), F.col("n_events")))


def onset_coverage(windows: DataFrame) -> DataFrame:
    fault = windows.where("source = 'fault'")
    known = F.when(F.col("onset_us").isNotNull(), F.col("group_id"))
    out = fault.agg(F.count(F.lit(1)).alias("windows"), F.countDistinct("group_id").alias("events"), F.countDistinct(known).alias("events_with_onset"))
    return out.withColumn("coverage_pct", 100 * ratio(F.col("events_with_onset"), F.col("events")))


def sample_events(rows: DataFrame, alarm: str, by: list[str] | None = None) -> DataFrame:
    """For each fault segment: rows, whether a row alarms, the delay from its first row, and rows until the alarm."""
    fault = rows.where("kind = 'fault'").withColumn("_place", F.row_number().over(Window.partitionBy(*(by or []), "group_id").orderBy("t_us", "seq")))
    hit = F.when(F.col(alarm), F.struct("t_us", "_place"))
    out = fault.groupBy(*(by or []), "group_id").agg(F.count(F.lit(1)).alias("n_samples"), F.min("t_us").alias("onset_us"), F.min(hit).alias("_h"))
    return out.select(*(by or []), "group_id", "n_samples", "onset_us", F.col("_h").isNotNull().alias("detected"), F.greatest(F.lit(0.0), seconds(F.col("_h.t_us"), F.col("onset_us"))).alias("delay_sec"), F.col("_h._place").alias("samples_to_alarm"))


def cycles(rows: DataFrame, alarm: str, by: list[str] | None = None) -> DataFrame:
    """For each segment: kind, rows, alarmed rows, alarm episodes."""
    order = Window.partitionBy(*(by or []), "group_id").orderBy("t_us", "seq")
    starts = F.col(alarm) & ~F.coalesce(F.lag(alarm).over(order), F.lit(False))
    marked = rows.withColumn("_start", starts)
    return marked.groupBy(*(by or []), "group_id", "kind").agg(F.count(F.lit(1)).alias("rows"), count_if(F.col(alarm)).alias("alarm_rows"), count_if(F.col("_start")).alias("episodes"))


def raw_alarm_metrics(rows: DataFrame, alarm: str, by: list[str] | None = None) -> DataFrame:
    """F1, precision and recall without idle rows; events and delay; false-alarm cycles and episodes of normal and idle segments.

    One aggregate by segment, and one of the segments.
    """
    by = by or []
    order = Window.partitionBy(*by, "group_id").orderBy("t_us", "seq")
    y, hit = F.col("label") == 1, F.coalesce(F.col(alarm), F.lit(False))
    marked = rows.withColumn("_start", hit & ~F.coalesce(F.lag(alarm).over(order), F.lit(False)))
    each = marked.groupBy(*by, "group_id", "kind").agg(
        count_if(y & hit).alias("_tp"),
        count_if(~y & hit).alias("_fp"),
        count_if(y & ~hit).alias("_fn"),
        count_if(F.col("_start")).alias("_episodes"),
        F.min("t_us").alias("_onset"),
        F.min(F.when(hit, F.col("t_us"))).alias("_hit"),
    )
    of = lambda kind: F.col("kind") == kind
    found = F.col("_hit").isNotNull()
    aggs = [F.coalesce(F.sum(F.when(~of("idle"), F.col(c))), F.lit(0)).alias(c) for c in ("_tp", "_fp", "_fn")]
    aggs += [count_if(of("fault")).alias("n_events"), count_if(of("fault") & found).alias("detected_events"), F.avg(F.when(of("fault"), seconds(F.col("_hit"), F.col("_onset")))).alias("delay_mean_sec")]
    for kind in ("normal", "idle"):
        aggs += [count_if(of(kind)).alias(f"{kind}_cycles"), count_if(of(kind) & found).alias(f"{kind}_fa_cycles"), F.coalesce(F.sum(F.when(of(kind), F.col("_episodes"))), F.lit(0)).alias(f"{kind}_fa_episodes")]
    return alarm_rates(each.groupBy(*by).agg(*aggs), by)


def alarm_rates(out: DataFrame, by: list[str]) -> DataFrame:
    """The columns of raw_alarm_metrics from the sums of segments: _tp, _fp, _fn, events, their mean delay, cycles and episodes."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    tp, fp, fn = F.col("_tp"), F.col("_fp"), F.col("_fn")
    out = out.withColumns({"sample_f1": zero(ratio(2 * tp, 2 * tp + fp + fn)), "sample_precision": zero(ratio(tp, tp + fp)), "sample_recall": zero(ratio(tp, tp + fn)), "event_detection_rate": ratio(F.col("detected_events"), F.col("n_events")), **{f"{k}_fa_cycle_rate": ratio(F.col(f"{k}_fa_cycles"), F.col(f"{k}_cycles")) for k in ("normal", "idle")}})
    parts = [f"{k}_{x}" for k in ("normal", "idle") for x in ("cycles", "fa_cycles", "fa_episodes")]
    return out.select(*by, "sample_f1", "sample_precision", "sample_recall", "n_events", "detected_events", "event_detection_rate", "delay_mean_sec", *parts, "normal_fa_cycle_rate", "idle_fa_cycle_rate")


def window_false_alarms(windows: DataFrame, alarm: str, step_sec: float, by: list[str] | None = None) -> DataFrame:
    """False-alarm episodes, exposure in seconds (the union of the windows), groups, and groups with a false alarm,
    over windows outside the fault zone."""
    by = by or []
    zone = windows.where(~in_fault_zone(F.col("source"), F.col("onset_us"), F.col("end_us")))
    along = Window.partitionBy(*by, "group_id").orderBy("start_us", "end_us")
    near = seconds(F.col("start_us"), F.lag("start_us").over(along)) <= step_sec * 1.5
    before = F.coalesce(F.lag(alarm).over(along) & near, F.lit(False))
    reached = F.max("end_us").over(along.rowsBetween(Window.unboundedPreceding, -1))
    zone = zone.withColumns({"_new": F.col(alarm) & ~before, "_more": F.greatest(F.lit(0.0), seconds(F.col("end_us"), F.greatest("start_us", F.coalesce(reached, F.col("start_us")))))})
    each = zone.groupBy(*by, "group_id").agg(count_if(F.col("_new")).alias("_e"), F.sum("_more").alias("_x"))
    return each.groupBy(*by).agg(F.coalesce(F.sum("_e"), F.lit(0)).alias("n_episodes"), F.coalesce(F.sum("_x"), F.lit(0.0)).alias("exposure_sec"), F.count(F.lit(1)).alias("n_groups"), count_if(F.col("_e") > 0).alias("n_fa_groups"))


#: What window folds add up.
FOLD_COUNTS = ("tp", "fp", "tn", "fn", "fa_episodes", "exposure_sec", "cycles", "fa_cycles", "idle_windows", "idle_alarm_windows", "idle_cycles", "idle_fa_cycles", "idle_fa_episodes", "idle_exposure_sec")


def _only_row(parts: list[DataFrame], by: list[str]) -> DataFrame:
    """Tables of one row for each `by`, side by side."""
    keyed = [p if by else p.withColumn("_k", F.lit(1)) for p in parts]
    out = functools.reduce(lambda a, b: a.join(b, by or ["_k"], "full_outer"), keyed)
    return out if by else out.drop("_k")


def fold_counts(windows: DataFrame, alarm: str, step_sec: float, by: list[str]) -> DataFrame:
    """FOLD_COUNTS of the test windows of each fold (by): sample counts, false alarms and exposure, of idle windows apart."""
    main, idle = windows.where("kind <> 'idle'"), windows.where("kind = 'idle'")
    sample = confusion(main, alarm, by).select(*by, "tp", "fp", "tn", "fn")
    false = lambda rows: window_false_alarms(rows, alarm, step_sec, by)
    names = {"n_episodes": "fa_episodes", "exposure_sec": "exposure_sec", "n_groups": "cycles", "n_fa_groups": "fa_cycles"}
    own = false(main).withColumnsRenamed(names)
    apart = false(idle).withColumnsRenamed({k: f"idle_{v}" for k, v in names.items()})
    rows = idle.groupBy(*by).agg(F.count(F.lit(1)).alias("idle_windows"), count_if(F.col(alarm)).alias("idle_alarm_windows"))
    out = _only_row([sample, own, apart, rows], by)
    return out.select(*by, *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FOLD_COUNTS))


def fold_totals(counts: DataFrame, events: DataFrame, by: list[str]) -> DataFrame:
    """The rates of FOLD_COUNTS summed over folds, and of the events (detected, delay_sec, window_sec) of all of them."""
    total = counts.groupBy(*by).agg(*(F.sum(c).alias(c) for c in FOLD_COUNTS))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    total = total.withColumns(
        {
            "pooled_f1": zero(ratio(2 * tp, 2 * tp + fp + fn)),
            "pooled_precision": zero(ratio(tp, tp + fp)),
            "pooled_recall": zero(ratio(tp, tp + fn)),
            "normal_window_fpr": ratio(fp, fp + tn),
            "fa_cycle_rate": ratio(F.col("fa_cycles"), F.col("cycles")),
            "normal_exposure_min": F.col("exposure_sec") / 60.0,
            "fa_per_hour": ratio(F.col("fa_episodes") * 3600, F.col("exposure_sec")),
            "idle_fa_cycle_rate": ratio(F.col("idle_fa_cycles"), F.col("idle_cycles")),
            "idle_window_fpr": ratio(F.col("idle_alarm_windows"), F.col("idle_windows")),
        }
    )
    over = events.groupBy(*by).agg(F.avg(F.when(F.col("detected"), F.col("delay_sec") - F.col("window_sec"))).alias("delay_minus_window_mean_sec"))
    return _only_row([event_metrics(events, by), over, total], by)


def sample_fold_metrics(rows: DataFrame, alarm: str, dt: float, long_sec: float, by: list[str]) -> DataFrame:
    """Metrics of sample alarms over test rows: events (also those of long_sec or more), delays in seconds and samples, sample
    counts without idle rows, false alarms of normal segments over their exposure (rows times dt), and of idle segments."""
    events = sample_events(rows, alarm, by)
    spans = rows.where("kind = 'fault'").groupBy(*by, "group_id").agg(seconds(F.max("t_us"), F.min("t_us")).alias("duration_sec"))
    events = events.join(spans, [*by, "group_id"])
    found, long = F.col("detected"), F.col("duration_sec") >= long_sec - 1e-9
    each = events.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.avg(found.cast("double")).alias("event_detection_rate"),
        count_if(long).alias("n_events_long"),
        F.avg(F.when(long, found.cast("double"))).alias("event_detection_rate_long"),
        F.avg(F.when(found, F.col("delay_sec"))).alias("delay_mean_sec"),
        F.avg("samples_to_alarm").alias("samples_to_alarm_mean"),
    )
    each = _only_row([each, exact_median(events.where(found), F.col("delay_sec"), by, "delay_median_sec")], by)
    sample = confusion(rows, alarm, by, F.col("kind") != "idle").select(*by, F.col("f1").alias("sample_f1"), F.col("precision").alias("sample_precision"), F.col("recall").alias("sample_recall"), F.col("fpr").alias("normal_sample_fpr"))
    of = lambda kind: F.col("kind") == kind
    total = lambda kind, c: F.coalesce(F.sum(F.when(of(kind), F.col(c))), F.lit(0))
    false = cycles(rows, alarm, by).groupBy(*by).agg(
        count_if(of("normal")).alias("normal_cycles"),
        count_if(of("normal") & (F.col("episodes") > 0)).alias("fa_cycles"),
        total("normal", "episodes").alias("fa_episodes"),
        (total("normal", "rows") * F.lit(dt)).alias("exposure_sec"),
        count_if(of("idle")).alias("idle_cycles"),
        ratio(count_if(of("idle") & (F.col("episodes") > 0)), count_if(of("idle"))).alias("idle_fa_cycle_rate"),
        ratio(total("idle", "alarm_rows"), total("idle", "rows")).alias("idle_sample_fpr"),
    )
    false = false.withColumns({"fa_cycle_rate": ratio(F.col("fa_cycles"), F.col("normal_cycles")), "fa_per_hour": ratio(F.col("fa_episodes") * 3600, F.col("exposure_sec"))})
    return _only_row([each, sample, false], by)


def mean_and_std(repeats: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """Mean and sample standard deviation over repeats; null with one repeat."""
    return repeats.groupBy(*by).agg(*(a for m in measures for a in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"))))


def detection_frequency(events: DataFrame, by: list[str] | None = None, scale: str | None = None) -> DataFrame:
    """For each event over repeats: evaluations, detections, misses, rate, mean delay, and the longest scale that judged it."""
    keys = [*(by or []), "group_id"]
    more = [F.max(scale).alias(scale)] if scale else []
    out = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("repeats"), count_if(F.col("detected")).alias("detected"), F.avg("delay_sec").alias("delay_mean_sec"), *more)
    out = out.withColumn("missed", F.col("repeats") - F.col("detected"))
    return out.withColumn("detection_rate", ratio(F.col("detected"), F.col("repeats"))).orderBy(F.desc("missed"), *keys)


def realtime_events(log: DataFrame, alarm: str = "final_alarm", by_segment: bool = False) -> DataFrame:
    """Runs of fault rows along a stream: rows, first alarm, delay in seconds and rows.

    Runs pass over segment breaks, as one event; with by_segment a break starts a new one.
    """
    along = Window.partitionBy("series").orderBy("t_us", "seq")
    fault = F.col("kind") == "fault"
    new = fault != F.coalesce(F.lag(fault).over(along), F.lit(False))
    if by_segment:
        new = new | (F.col("segment_id") != F.coalesce(F.lag("segment_id").over(along), F.col("segment_id")))
    rows = log.withColumns({"_run": F.sum(new.cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)), "_index": F.row_number().over(along)})
    hit = F.when(F.col(alarm), F.struct("t_us", "_index"))
    out = rows.where(fault).groupBy("series", "_run").agg(F.min("t_us").alias("fault_start_us"), F.min("_index").alias("_first"), F.count(F.lit(1)).alias("fault_rows"), count_if(F.col(alarm)).alias("alarm_rows"), F.min(hit).alias("_h"))
    event = F.row_number().over(Window.partitionBy("series").orderBy("_run"))
    return out.select("series", event.alias("event_id"), "fault_start_us", "fault_rows", F.col("_h").isNotNull().alias("detected"), F.col("_h.t_us").alias("first_alarm_us"), seconds(F.col("_h.t_us"), F.col("fault_start_us")).alias("delay_sec"), (F.col("_h._index") - F.col("_first")).alias("delay_samples"), "alarm_rows")


def realtime_summary(log: DataFrame, alarm: str = "final_alarm") -> DataFrame:
    """One row of counts and rates by kind, and the largest score ratio."""
    own = lambda k: F.col("kind") == k
    out = log.agg(F.count(F.lit(1)).alias("rows"), *(count_if(own(k)).alias(f"{k}_rows") for k in ("normal", "idle", "fault")), *(count_if(own(k) & F.col(alarm)).alias(f"{k}_alarm_rows") for k in ("normal", "idle", "fault")), F.max("max_ratio").alias("max_score_ratio"))
    return out.withColumns({f"{k}_alarm_rate": ratio(F.col(f"{k}_alarm_rows"), F.col(f"{k}_rows")) for k in ("normal", "idle", "fault")})


def latency(log: DataFrame, column: str = "infer_ms") -> DataFrame:
    """One row: mean, 95th percentile and largest value of a column of times."""
    sides = log.agg(F.avg(column).alias("mean_ms"), F.max(column).alias("max_ms"))
    return _only_row([sides, exact_median(log, F.col(column), out="p95_ms", q=0.95)], []).select("mean_ms", "p95_ms", "max_ms")


def first_detection(rows: DataFrame, alarms: list[str]) -> DataFrame:
    """For each fault segment and alarm track, seconds from the segment's first row to the track's first alarm."""
    fault = rows.where("kind = 'fault'").withColumn("_t", seconds(F.col("t_us"), F.min("t_us").over(Window.partitionBy("group_id"))))
    long = fault.select("group_id", "_t", F.explode(F.map_from_arrays(F.array(*map(F.lit, alarms)), F.array(*map(F.col, alarms)))).alias("track", "_on"))
    return long.groupBy("group_id", "track").agg(F.min(F.when(F.col("_on"), F.col("_t"))).alias("first_sec"))


def episodes_of(rows: DataFrame, alarm: str) -> DataFrame:
    """One row: rising edges of the alarm within segments."""
    return rows.withColumn("_r", rising(F.col(alarm))).agg(count_if(F.col("_r")).alias("episodes"))


