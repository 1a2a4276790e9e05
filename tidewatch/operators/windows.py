"""Sliding windows: time windows that start at samples, trailing windows of a fixed number of samples, their features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tidewatch.functions.scalar import seconds
from tidewatch.schema import Settings, correlation_name, feature_names

def in_segment():
    """A segment, in the order of its rows."""
    return Window.partitionBy("group_id").orderBy("t_us", "seq")


def window_starts(rows: DataFrame, window_sec: float, step_sec: float, min_samples: int) -> DataFrame:
    """group_id, start_us, end_us of each time window.

    From a segment's first sample: a window [start, start + window) that ends by the segment's last sample and holds
    min_samples is kept, and the next starts at the first sample a step or more later; with fewer samples, the next starts at the next
    sample. Which samples could start a window is told for all segments of a batch at once; only these are walked in order, so a segment without
    any costs no step of its own. No more rows are held than a window spans.
    """
    width, step, ahead = round(window_sec * 1e6), round(step_sec * 1e6), max(min_samples - 1, 0)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # held: the last segment's rows that more rows may yet make a window of; wanted: no window of it starts before
        name, held, wanted = None, np.zeros(0, np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0).dictionary_encode()
            code, times = names.indices.to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            if names.dictionary[int(code[0])].as_py() != name:
                held, wanted = np.zeros(0, np.int64), None
            code, times = np.append(np.full(len(held), code[0]), code), np.append(held, times)
            n = len(code)
            cuts = np.append(np.flatnonzero(np.diff(code, prepend=-1)), n)
            end = np.repeat(cuts[1:], np.diff(cuts))
            at = np.arange(n) + ahead
            full = (at < end) & (times[np.minimum(at, n - 1)] < times + width) & (times + width <= times[end - 1])
            found, before = [], -1
            places = np.flatnonzero(full)
            for i, t, g in zip(places.tolist(), times[places].tolist(), code[places].tolist(), strict=True):
                if g != before:
                    least, before = wanted if g == code[0] else None, g
                if least is None or t >= least:
                    found.append(i)
                    least = t + step
            last = int(code[-1])
            wanted = least if before == last else wanted if last == code[0] else None
            name = names.dictionary[last].as_py()
            # what is decided is let go: a window that the segment's last sample so far ends
            own = times[cuts[-2] :]
            held = own[int(np.searchsorted(own, own[-1] - width, "right")) :]
            if found:
                yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(code[found])).cast(pa.string()), pa.array(times[found])], ["group_id", "start_us"])

    walked = rows.select("group_id", "t_us").repartition("group_id").sortWithinPartitions("group_id", "t_us").mapInArrow(walk, "group_id string, start_us long")
    return walked.withColumn("end_us", F.col("start_us") + width)


def _correlation(x: Column, y: Column) -> Column:
    """Pearson's r, 0 where either is constant (Spark's corr fails there)."""
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))


def time_windows(rows: DataFrame, settings: Settings, manifest: DataFrame | None = None, in_cells: bool = False) -> DataFrame:
    """The 16 features and the description of each time window of segmented rows.

    With a manifest that has splits, segments that are EXCLUDED_SHORT have no windows. in_cells: for segments too long for a task.
    """
    if manifest is not None:
        rows = rows.join(manifest.where("split = 'EXCLUDED_SHORT'").select("group_id"), "group_id", "left_anti")
    if in_cells:
        from tidewatch.operators import cells

        starts = cells.window_starts_in_cells(rows, settings.window_sec, settings.step_sec, settings.min_samples)
    else:
        starts = window_starts(rows, settings.window_sec, settings.step_sec, settings.min_samples)
    onset = rows.groupBy("group_id").agg(F.min(F.when(F.col("state") >= 1, F.col("t_us"))).alias("onset_us"))
    gap = seconds(F.col("t_us"), F.lag("t_us").over(in_segment()))
    inner = cells.over_cells(cells.numbered(rows), 1, lambda r: r.withColumn("_gap", gap)) if in_cells else rows.withColumn("_gap", gap)
    # a window lies in two cells of time, of its own length, at most; rows meet the windows of their cell only, so a long
    # segment costs no more for each row than a short one
    width = round(settings.window_sec * 1e6)
    cell = lambda t: F.floor(t / width).cast("long")
    wide = starts.withColumnRenamed("group_id", "_g").withColumn("_c", F.explode(F.array_distinct(F.array(cell(F.col("start_us")), cell(F.col("end_us") - 1)))))
    met = inner.withColumn("_cell", cell(F.col("t_us"))).join(wide, (F.col("group_id") == F.col("_g")) & (F.col("_cell") == F.col("_c")) & (F.col("t_us") >= F.col("start_us")) & (F.col("t_us") < F.col("end_us")))
    sec = seconds(F.col("t_us"), F.col("start_us"))
    c = settings.channels
    stats = []
    for x in c:
        col = F.col(x)
        stats += [
            F.avg(col).alias(f"{x}_mean"),
            F.coalesce(F.stddev_samp(col), F.lit(0.0)).alias(f"{x}_std"),
            F.sqrt(F.avg(col * col)).alias(f"{x}_rms"),
            (F.max(col) - F.min(col)).alias(f"{x}_ptp"),
            F.regr_slope(col, sec).alias(f"{x}_slope"),
        ]
    stats.append(_correlation(F.col(c[0]), F.col(c[1])).alias(correlation_name(c)))
    out = met.groupBy("source", "series", "segment_id", "group_id", "start_us", "end_us").agg(
        F.count(F.lit(1)).alias("sample_count"),
        seconds(F.max("t_us"), F.min("t_us")).alias("actual_duration_sec"),
        F.coalesce(F.max(F.when(F.col("t_us") > F.col("start_us"), F.col("_gap"))), F.lit(0.0)).alias("max_gap_sec"),
        F.avg((F.col("idle") == 1).cast("double")).alias("idle_ratio"),
        F.avg((F.col("state") >= 1).cast("double")).alias("fault_ratio"),
        *stats,
    )
    out = out.withColumns({"idle_majority": (F.col("idle_ratio") >= 0.5).cast("int"), "label": (F.col("fault_ratio") >= 0.5).cast("int")})
    return out.join(onset, "group_id")


def full_windows(size: int) -> Column:
    """True from a segment's size-th row on."""
    return F.row_number().over(in_segment()) >= size


def run_features(times: np.ndarray, values: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """The 16 features of the runs of size rows that end at the rows `ends`, a row for each run: of what is known (not NaN), NaN where there is too little."""
    at = ends[:, None] - np.arange(size - 1, -1, -1)
    t = times[at]
    sec = (t - t[:, :1]) / 1e6
    out, parts = [], []
    with np.errstate(divide="ignore", invalid="ignore"):
        for x in values.T:
            w = x[at]
            known = ~np.isnan(w)
            n = known.sum(1)
            # from the first known value on, so equal values deviate by nothing
            base = w[np.arange(len(w)), known.argmax(1)]
            w = np.where(known, w, base[:, None])
            c = w - base[:, None]
            mean = c.sum(1, where=known) / n
            c = np.where(known, c - mean[:, None], 0.0)
            s = np.where(known, sec - (sec.sum(1, where=known) / n)[:, None], 0.0)
            squares, spread = (c * c).sum(1), (s * s).sum(1)
            slope = np.where(spread > 0, (s * c).sum(1) / spread, np.nan)
            out += [base + mean, np.where(n > 1, np.sqrt(squares / (n - 1)), np.nan), np.sqrt((w * w).sum(1, where=known) / n), np.ptp(w, 1), slope]
            parts.append((known, c, np.sqrt(squares / n)))
        (ka, a, da), (kb, b, db) = parts[:2]
        both = ka & kb
        m = both.sum(1)
        covariance = (a * b).sum(1, where=both) / m - a.sum(1, where=both) / m * (b.sum(1, where=both) / m)
        scale = da * db
        out.append(np.where((m > 0) & (scale > 0), covariance / scale, 0.0))
    return np.column_stack(out)


def count_windows_of(rows: DataFrame, sizes: dict[str, int], channels: tuple[str, ...], diffs: bool = False, starts: bool = False) -> DataFrame:
    """rows with the 16 features of the last samples of the segment for each prefix and size; null before there are so many.

    diffs: also sample_features; starts: also window_start_us, the first time of the last size. A segment is read in order once for all of
    them, a batch of many segments at a time, and no more of it is held than the longest window.
    """
    names, given = feature_names(channels), list(rows.columns)
    places = [given.index(c) for c in ("group_id", "t_us", *channels)]
    fields = [StructField(f"{c}_diff", DoubleType()) for c in channels] if diffs else []
    for prefix in sizes:
        fields += [StructField(prefix + f, DoubleType()) for f in names] + ([StructField(prefix + "window_start_us", LongType())] if starts else [])
    back = max(max(sizes.values()) - 1, 1)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, old_t, old = None, np.zeros(0, np.int64), np.zeros((0, len(channels)))
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            groups = batch.column(places[0]).dictionary_encode()
            code = groups.indices.to_numpy(zero_copy_only=False)
            if groups.dictionary[int(code[0])].as_py() != name:
                old_t, old = old_t[:0], old[:0]
            k = len(old_t)
            t = np.append(old_t, batch.column(places[1]).to_numpy())
            x = np.vstack([old, np.column_stack([batch.column(p).to_numpy(zero_copy_only=False).astype(float) for p in places[2:]])])
            first = np.append(True, code[1:] != code[:-1])
            begin = np.maximum.accumulate(np.where(first, np.arange(k, n + k), 0))
            begin[begin == k] = 0
            ends = np.arange(k, n + k)
            more = []
            if diffs:
                d = x[k:] - x[np.where(ends > begin, ends - 1, ends)]
                more += [pa.array(c) for c in np.where(np.isnan(d), 0.0, d).T]
            for size in sizes.values():
                full = np.flatnonzero(ends - begin >= size - 1)
                found = np.full((n, len(names)), np.nan)
                found[full] = run_features(t, x, ends[full], size)
                more += [pa.array(c, mask=np.isnan(c)) for c in found.T]
                if starts:
                    at, none = np.zeros(n, np.int64), np.ones(n, bool)
                    at[full], none[full] = t[ends[full] - size + 1], False
                    more.append(pa.array(at, mask=none))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*given, *(f.name for f in fields)])
            name = groups.dictionary[int(code[-1])].as_py()
            since = max(int(begin[-1]), n + k - back)
            old_t, old = t[since:], x[since:]

    ordered = rows.repartition("group_id").sortWithinPartitions("group_id", "t_us", "seq")
    return ordered.mapInArrow(features, StructType([*rows.schema.fields, *fields]))


def count_windows(rows: DataFrame, size: int, channels: tuple[str, ...]) -> DataFrame:
    """rows with the 16 features of the last size samples of the segment, and window_start_us; null before there are so many."""
    return count_windows_of(rows, {"": size}, channels, starts=True)


def sample_features(rows: DataFrame, channels: tuple[str, ...], rolling: bool = False) -> DataFrame:
    """Each channel's difference to the row before in the segment (0 for the first), and optionally its standard
    deviation over the last 3 rows (0 before there are 2)."""
    frame = in_segment().rowsBetween(-2, 0)
    out = {f"{c}_diff": F.coalesce(F.col(c) - F.lag(c).over(in_segment()), F.lit(0.0)) for c in channels}
    if rolling:
        out |= {f"{c}_roll3": F.coalesce(F.stddev_samp(c).over(frame), F.lit(0.0)) for c in channels}
    return rows.withColumns(out)


def sample_feature_names(channels: tuple[str, ...], rolling: bool = False) -> list[str]:
    return [*channels, *(f"{c}_diff" for c in channels), *([f"{c}_roll3" for c in channels] if rolling else [])]


def drop_incomplete(windows: DataFrame, features: list[str]) -> DataFrame:
    """Windows of which all features and the description are known."""
    return windows.dropna(subset=[*features, "sample_count", "actual_duration_sec", "max_gap_sec"])


def split_idle(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(model windows, idle windows) of windows with their group's split."""
    idle = F.col("split") == "EXCLUDED_IDLE"
    return windows.where((F.col("idle_majority") == 0) & ~F.col("split").isin("EXCLUDED_IDLE", "EXCLUDED_SHORT")), windows.where(idle)
