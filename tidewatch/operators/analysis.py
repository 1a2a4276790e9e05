"""Descriptive analysis: time structure, datasets, effects, missed events, delays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.scalar import DURATION_BINS, direction, duration_bin, evaluable, ratio, seconds
from tidewatch.operators.metrics import count_if
from tidewatch.operators.sessions import along, with_gaps
from tidewatch.operators.thresholds import exact_quantiles

QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
#: Upper ends of the gap bins after the first (0, 0.15]; the last bin has none (fixed values).
GAP_BINS = (0.15, 0.3, 0.5, 1.0, 2.0, 5.0)
#: Gap thresholds to compare (fixed values).
GAP_THRESHOLDS = (0.2, 0.3, 0.5, 1.0, 2.0, 5.0)


# time structure


def gap_statistics(samples: DataFrame) -> DataFrame:
    """Count, mean, median, deviation, extremes and quantiles of the gaps of each source."""
    g = F.col("gap_sec")
    rows = with_gaps(samples).where(g.isNotNull())
    out = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg(g).alias("mean"), F.stddev_samp(g).alias("std"), F.min(g).alias("min"), F.max(g).alias("max"))
    out = out.join(exact_quantiles(rows, "gap_sec", QUANTILES, ["source"]).select("source", F.col("quantiles").alias("_q")), "source")
    return out.select("source", "n", "mean", "std", "min", "max", *(F.col("_q")[i].alias(f"q{round(q * 100):02d}") for i, q in enumerate(QUANTILES)))


def in_tolerance(samples: DataFrame, nominal: float = 0.1, tolerance: float = 0.01) -> DataFrame:
    """The share of gaps within the tolerance of the nominal interval, ends included."""
    g = F.col("gap_sec")
    return with_gaps(samples).where(g.isNotNull()).groupBy("source").agg(F.avg(g.between(nominal - tolerance - 1e-9, nominal + tolerance + 1e-9).cast("double")).alias("share"))


def gap_histogram(samples: DataFrame, ends: tuple[float, ...] = GAP_BINS) -> DataFrame:
    """Count and percentage of gaps in (0, e0], (e0, e1], ... and above the last; a gap of 0 is in no bin. Empty bins are kept."""
    spark, g = samples.sparkSession, F.col("gap_sec")
    bins = spark.createDataFrame([(i,) for i in range(len(ends) + 1)], "bin int")
    number: Column = F.when(g <= 0, None)
    for i, e in enumerate(ends):
        number = number.when(g <= e, i)
    rows = with_gaps(samples).where(g.isNotNull()).select(number.otherwise(len(ends)).alias("bin"))
    counts = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    counted = counts.join(F.broadcast(total.withColumn("_one", F.lit(1))), F.col("_one") == 1)
    out = F.broadcast(bins).join(counted, "bin", "left")
    return out.select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(100 * ratio(F.col("n"), F.col("_t")), F.lit(0.0)).alias("pct"))


def gap_threshold_sweep(samples: DataFrame, thresholds: tuple[float, ...] = GAP_THRESHOLDS) -> DataFrame:
    """For each threshold: gaps above it, their percentage, and the segments that it makes (one pass over the data)."""
    g = F.col("gap_sec")
    sums = with_gaps(samples).agg(F.count(g).alias("_n"), count_if(g.isNull()).alias("_first"), *(count_if(g > t).alias(f"_c{i}") for i, t in enumerate(thresholds)))
    rows = F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold_sec"), F.col(f"_c{i}").alias("large_gaps")) for i, t in enumerate(thresholds))))
    return sums.select("_n", "_first", rows.alias("_r")).select("_r.*", (100 * ratio(F.col("_r.large_gaps"), F.col("_n"))).alias("pct"), (F.col("_r.large_gaps") + F.col("_first")).alias("segments"))


def large_gaps(samples: DataFrame, least: float) -> DataFrame:
    """Gaps above least: where they start and end, longest first."""
    rows = with_gaps(samples).where(F.col("gap_sec") > least)
    start = F.col("t_us") - F.round(F.col("gap_sec") * 1e6).cast("long")
    return rows.select("source", "series", start.alias("start_us"), F.col("t_us").alias("end_us"), "gap_sec").orderBy(F.desc("gap_sec"), "source", "series", "end_us")


def idle_counts(samples: DataFrame) -> DataFrame:
    """Rows and percentage for each value of idle, and the time between its rows and those before."""
    rows = with_gaps(samples).groupBy("idle").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("gap_sec"), F.lit(0.0)).alias("duration_sec"))
    return rows.withColumn("pct", 100 * ratio(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(1)))))


def _idle_changes(samples: DataFrame) -> DataFrame:
    before = F.lag("idle").over(along())
    first = F.row_number().over(along()) == 1
    return samples.withColumn("_new", first | ~F.col("idle").eqNullSafe(before)).withColumn("_first", first)


def idle_transitions(samples: DataFrame) -> DataFrame:
    """Changes of idle along each series."""
    return _idle_changes(samples).groupBy("source").agg(count_if(F.col("_new") & ~F.col("_first")).alias("transitions"))


def idle_islands(samples: DataFrame, top: int | None = 20) -> DataFrame:
    """Runs of equal idle: start, end, rows and duration; the longest ones, if top is set."""
    rows = _idle_changes(samples).withColumn("_run", F.sum(F.col("_new").cast("long")).over(along().rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy("source", "series", "_run", "idle").agg(F.min("t_us").alias("start_us"), F.max("t_us").alias("end_us"), F.count(F.lit(1)).alias("rows"))
    out = out.withColumn("duration_sec", seconds(F.col("end_us"), F.col("start_us"))).drop("_run")
    return out if top is None else out.orderBy(F.desc("duration_sec"), "source", "series", "start_us").limit(top)


# datasets


def split_summary(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("split", "label").agg(F.count(F.lit(1)).alias("segments"), F.sum("rows").alias("rows"), F.sum("duration_sec").alias("duration_sec"))


def window_summary(windows: DataFrame) -> DataFrame:
    n = F.col("sample_count")
    return windows.groupBy("split", "label").agg(F.count(F.lit(1)).alias("windows"), F.avg(n).alias("mean_samples"), F.min(n).alias("min_samples"), F.max(n).alias("max_samples"))


def split_label_pivot(manifest: DataFrame) -> DataFrame:
    """Normal and fault segments of each split."""
    out = manifest.groupBy("split").pivot("label", [0, 1]).count()
    return out.select("split", F.coalesce("0", F.lit(0)).alias("normal"), F.coalesce("1", F.lit(0)).alias("fault"))


def unknown_features(windows: DataFrame, features: list[str]) -> DataFrame:
    """feature, unknown: how many windows lack it."""
    sums = windows.agg(*(count_if(F.col(f).isNull() | F.isnan(f)).alias(f) for f in features))
    return sums.unpivot([], features, "feature", "unknown")


def lost_events(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Events that should have windows and have none."""
    return events.where("evaluable_common").select("group_id").subtract(windows.select("group_id"))


def group_overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: groups in either, in both, and in one only."""
    x, y = a.select("group_id").distinct(), b.select("group_id").distinct()
    count = lambda d, n: d.agg(F.count(F.lit(1)).alias(n)).withColumn("_k", F.lit(1))
    out = count(x.union(y).distinct(), "either").join(count(x.intersect(y), "both"), "_k")
    return out.join(count(x.subtract(y), "only_a"), "_k").join(count(y.subtract(x), "only_b"), "_k").drop("_k")


# effects


def unpivoted(rows: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    return rows.select(*keep, *(F.col(f).cast("double") for f in features)).unpivot(keep, features, "feature", "value").where("value is not null")


def robust_effects(rows: DataFrame, features: list[str], cohort: str, base: str, target: str) -> DataFrame:
    """For each feature the medians and quartiles of two cohorts, the difference of medians, and it over IQR / 1.349 of the base."""
    long = unpivoted(rows.where(F.col(cohort).isin(base, target)), features, [cohort])
    q = exact_quantiles(long, "value", (0.25, 0.5, 0.75), ["feature", cohort])
    q = q.groupBy("feature").agg(*(F.max(F.when(F.col(cohort) == c, F.col("quantiles"))).alias(n) for c, n in ((base, "_b"), (target, "_t"))))
    b, t = F.col("_b"), F.col("_t")
    delta, iqr = t[1] - b[1], b[2] - b[0]
    out = q.select("feature", b[1].alias("base_median"), b[0].alias("base_q25"), b[2].alias("base_q75"), iqr.alias("base_iqr"), t[1].alias("target_median"), t[0].alias("target_q25"), t[2].alias("target_q75"), delta.alias("delta"), (100 * ratio(delta, F.abs(b[1]))).alias("delta_pct"), ratio(delta, iqr / 1.349).alias("effect"), direction(delta).alias("direction"))
    return out.orderBy(F.desc_nulls_last(F.abs("effect")), "feature")


def effect_table(rows: DataFrame, features: list[str], cohort: str, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """The effects of several cohort pairs side by side, and the largest."""
    out = None
    for name, (base, target) in pairs.items():
        e = robust_effects(rows, features, cohort, base, target).select("feature", *(F.col(c).alias(f"{name}_{c}") for c in ("base_median", "target_median", "delta", "effect", "direction")))
        out = e if out is None else out.join(e, "feature", "full_outer")
    sizes = [F.coalesce(F.abs(F.col(f"{n}_effect")), F.lit(-1.0)) for n in pairs]
    top = F.greatest(*sizes) if len(sizes) > 1 else sizes[0]
    return out.withColumn("max_abs_effect", F.when(top >= 0, top)).orderBy(F.desc_nulls_last("max_abs_effect"), "feature")


def event_medians(rows: DataFrame, features: list[str]) -> DataFrame:
    return rows.where("source = 'fault'").groupBy("group_id").agg(*(F.median(f).alias(f) for f in features))


def correlations(rows: DataFrame, columns: tuple[str, ...], by: str) -> DataFrame:
    """Pearson's r of each pair of columns for each value of by, as rows; null where a column is constant."""
    pairs = [(a, b) for a in columns for b in columns]
    r = lambda a, b: F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    wide = rows.groupBy(by).agg(*(r(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)))
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("sensor_a"), F.lit(b).alias("sensor_b"), F.col(f"_{i}").alias("correlation")) for i, (a, b) in enumerate(pairs))))
    return wide.select(by, each.alias("_e")).select(by, "_e.*")


def feature_coverage(rows: DataFrame, features: list[str], cohort: str) -> DataFrame:
    """The known values of each feature in each cohort, 0 where there are none."""
    wide = rows.groupBy(cohort).agg(*(F.count(f).alias(f) for f in features))
    return wide.unpivot([cohort], features, "feature", "known")


def channel_ranges(samples: DataFrame, channels: tuple[str, ...]) -> DataFrame:
    """Smallest and largest value of each channel, of all rows and of idle ones."""
    idle = F.col("idle") == 1
    wide = samples.groupBy("source").agg(*(f(v).alias(f"{n}_{i}") for i, c in enumerate(channels) for n, f, v in (("min", F.min, F.col(c)), ("max", F.max, F.col(c)), ("imin", F.min, F.when(idle, F.col(c))), ("imax", F.max, F.when(idle, F.col(c))))))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), *(F.col(f"{n}_{i}").alias(m) for n, m in (("min", "low"), ("max", "high"), ("imin", "idle_low"), ("imax", "idle_high")))) for i, c in enumerate(channels))))
    return wide.select("source", each.alias("_e")).select("source", "_e.*")


# rows of results


def event_slice(rows: DataFrame, group_id: str, before_sec: float = 0.0) -> DataFrame:
    """The rows of one segment with t_sec, seconds since its first faulty row (its first row where there is none), from
    before_sec before that on."""
    own = rows.where(F.col("group_id") == group_id)
    whole = Window.partitionBy("group_id")
    onset = F.coalesce(F.min(F.when(F.col("state") >= 1, F.col("t_us"))).over(whole), F.min("t_us").over(whole))
    out = own.withColumn("t_sec", seconds(F.col("t_us"), onset))
    return out.where(F.col("t_sec") >= -before_sec) if before_sec else out


ROW_KEY = ("group_id", "t_us", "seq")


def with_results(rows: DataFrame, results: DataFrame, columns: list[str], key: tuple[str, ...] = ROW_KEY) -> DataFrame:
    """rows with these columns of the results of the same rows; rows without results fall out."""
    return rows.join(results.select(*key, *columns), list(key))


def differences(a: DataFrame, b: DataFrame, columns: list[str], key: tuple[str, ...] = ROW_KEY, tolerance: float = 1e-6) -> DataFrame:
    """column, differing: for each column how many rows of two results of the same rows differ (numbers by more than the
    tolerance, relative above 1); rows that one side lacks differ in all."""
    side = lambda df, x: df.select(*key, F.lit(True).alias(f"_{x}"), *(F.col(c).alias(f"{x}_{c}") for c in columns))
    both = side(a, "a").join(side(b, "b"), list(key), "full_outer")
    counts = []
    for c in columns:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        if dict(a.dtypes)[c] in ("double", "float"):
            same = (x.isNull() & y.isNull()) | F.coalesce(F.abs(x - y) <= tolerance * F.greatest(F.lit(1.0), F.abs(x)), F.lit(False))
        else:
            same = x.eqNullSafe(y)
        counts.append(count_if(F.col("_a").isNull() | F.col("_b").isNull() | ~same).alias(c))
    return both.agg(*counts).unpivot([], columns, "column", "differing")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row in `order` of each key: which one doesn't depend on how rows are dealt, if orders differ."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(first)).where("_place = 1").drop("_place")


# missed events and delays


def missed_event_summary(evaluations: DataFrame, window_counts: DataFrame | None = None) -> DataFrame:
    """For each event over evaluations (group_id, duration_sec, detected, delay_sec): misses, rate, duration bin, windows."""
    out = evaluations.groupBy("group_id").agg(F.max("duration_sec").alias("duration_sec"), F.count(F.lit(1)).alias("evaluations"), count_if(F.col("detected")).alias("detected"), F.avg("delay_sec").alias("delay_mean_sec"))
    out = out.withColumns({"missed": F.col("evaluations") - F.col("detected"), "detection_rate": ratio(F.col("detected"), F.col("evaluations")), "duration_bin": duration_bin(F.col("duration_sec"))})
    if window_counts is not None:
        counts = [c for c in window_counts.columns if c != "group_id"]
        out = out.join(window_counts, "group_id", "left").fillna(0, counts)
    return out.orderBy(F.desc("missed"), "duration_sec", "group_id")


def duration_summary(events: DataFrame) -> DataFrame:
    """Evaluations, detections and their rate by duration bin; bins without events are kept."""
    bins = events.sparkSession.createDataFrame(list(enumerate(DURATION_BINS)), "position int, duration_bin string")
    sums = events.groupBy("duration_bin").agg(F.count(F.lit(1)).alias("events"), F.sum("evaluations").alias("evaluations"), F.sum("detected").alias("detected"))
    out = F.broadcast(bins).join(sums, "duration_bin", "left").fillna(0, ["events", "evaluations", "detected"])
    return out.withColumn("detection_rate", ratio(F.col("detected"), F.col("evaluations"))).orderBy("position")


#: Detector name -> (alarm column, score column, first place with a score).
DETECTORS = {"sample": ("sample_alarm", "sample_score", 2), "win05": ("short_alarm", "short_score", 4), "win1": ("long_alarm", "long_score", 9)}


def delay_decomposition(rows: DataFrame, thresholds: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """For each fault segment: when each detector first alarms, how often, its largest score ratio (first second, whole
    event), and which is first; ties are joined by +."""
    keys = [*(by or []), "group_id"]
    whole = Window.partitionBy(*keys)
    order = whole.orderBy("t_us", "seq")
    fault = rows.where("kind = 'fault'").withColumns({"_t": seconds(F.col("t_us"), F.min("t_us").over(whole)), "_place": F.row_number().over(order) - 1})
    aggs = [F.count(F.lit(1)).alias("n_samples"), F.max("_t").alias("duration_sec"), F.coalesce(F.max(F.col("final_alarm")), F.lit(False)).alias("detected"), F.min(F.when(F.col("final_alarm"), F.col("_t"))).alias("delay_sec"), F.min(F.when(F.col("or_3"), F.col("_t"))).alias("first_or3_sec")]
    for name, (alarm, score, first) in DETECTORS.items():
        r = F.when(F.col("_place") >= first, ratio(F.col(score), thresholds[name]))
        aggs += [F.min(F.when(F.col(alarm), F.col("_t"))).alias(f"first_{name}_sec"), count_if(F.col(alarm)).alias(f"alarm_rows_{name}"), F.max(F.when(F.col("_t") <= 1.0, r)).alias(f"max_ratio_first1s_{name}"), F.max(r).alias(f"max_ratio_event_{name}")]
    out = fault.groupBy(*keys).agg(*aggs)
    firsts = [F.col(f"first_{n}_sec") for n in DETECTORS]
    least = F.least(*firsts)
    leading = F.concat_ws("+", *(F.when(F.abs(c - least) < 1e-9, n) for n, c in zip(DETECTORS, firsts, strict=True)))
    return out.withColumn("leading", F.when(least.isNull(), "none").otherwise(leading))


def delay_summary(details: DataFrame) -> DataFrame:
    """Over repeats of an event: detections, mean delay, medians, and the most frequent leading detector (of equals, the first by name)."""
    counts = details.groupBy("group_id", "leading").agg(F.count(F.lit(1)).alias("_n"))
    mode = counts.groupBy("group_id").agg(F.min_by("leading", F.struct(-F.col("_n"), "leading")).alias("leading_mode"))
    out = details.groupBy("group_id").agg(
        F.first("n_samples").alias("n_samples"),
        F.first("duration_sec").alias("duration_sec"),
        count_if(F.col("detected")).alias("detected"),
        F.count(F.lit(1)).alias("repeats"),
        F.avg("delay_sec").alias("mean_delay"),
        *(F.median(f"first_{n}_sec").alias(f"first_{n}_med") for n in DETECTORS),
        *(F.median(f"max_ratio_first1s_{n}").alias(f"ratio1s_{n}") for n in DETECTORS),
    )
    return out.join(mode, "group_id").orderBy(F.asc_nulls_first("mean_delay"), F.asc_nulls_first("duration_sec"))


def leading_summary(details: DataFrame) -> DataFrame:
    """By leading detector, over detected events: evaluations, events, delays, share."""
    out = details.where("detected").groupBy("leading").agg(F.count(F.lit(1)).alias("evaluations"), F.countDistinct("group_id").alias("events"), F.avg("delay_sec").alias("mean_delay"), F.min("delay_sec").alias("min_delay"), F.max("delay_sec").alias("max_delay"))
    return out.withColumn("share_pct", 100 * ratio(F.col("evaluations"), F.sum("evaluations").over(Window.partitionBy(F.lit(1)))))


def earliest_alarm(first_place: int, persistence: int = 2, step: float = 0.1) -> float:
    """The earliest second at which a detector can raise the final alarm."""
    return round((first_place + persistence - 1) * step, 3)


def at_floor(details: DataFrame, persistence: int = 2, step: float = 0.1) -> DataFrame:
    """detected rows, with whether their delay is one of the earliest possible ones."""
    floors = sorted({round(earliest_alarm(first, persistence, step), 1) for _, _, first in DETECTORS.values()})
    return details.where("detected").withColumn("at_floor", F.round("delay_sec", 1).isin(*floors))


def evaluable_events(manifest: DataFrame, lengths: tuple[float, ...]) -> DataFrame:
    return manifest.where("source = 'fault'").select("group_id", "duration_sec", *(evaluable(F.col("duration_sec"), w).alias(f"fits_{str(w).replace('.', '_')}") for w in lengths))


def missed_sentences(events: DataFrame, n: int = 3) -> DataFrame:
    """The n events that are missed most often, as text."""
    top = events.where("missed > 0").orderBy(F.desc("missed"), "duration_sec", "group_id").limit(n)
    return top.select("group_id", F.format_string("%s (%.2f s): missed in %d of %d evaluations", "group_id", "duration_sec", "missed", "evaluations").alias("sentence"))


def bin_sentences(bins: DataFrame) -> DataFrame:
    """The detection rate of each duration bin, as text."""
    rate = F.when(F.col("detection_rate").isNull(), "no evaluation").otherwise(F.format_string("%.1f %% of %d evaluations", 100 * F.col("detection_rate"), F.col("evaluations")))
    return bins.select("duration_bin", F.format_string("%s: %s", "duration_bin", rate).alias("sentence"))


def effect_sentences(effects: DataFrame, n: int = 3) -> DataFrame:
    """The n largest effects, as text."""
    top = effects.where("effect is not null").orderBy(F.desc(F.abs("effect")), "feature").limit(n)
    return top.select("feature", F.format_string("%s %s: median %.4f -> %.4f, effect %.2f", "feature", "direction", "base_median", "target_median", "effect").alias("sentence"))
