"""Gap sessionization and what is known of each segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.scalar import evaluable, kind_of, label_of, seconds
from tidewatch.operators.thresholds import exact_median


def along():
    """A series of one source, in the order of its rows."""
    return Window.partitionBy("source", "series").orderBy("t_us", "seq")


def with_gaps(samples: DataFrame) -> DataFrame:
    """gap_sec: seconds since the row before in the series; null for the first."""
    return samples.withColumn("gap_sec", seconds(F.col("t_us"), F.lag("t_us").over(along())))


def sessionize(samples: DataFrame, gap_sec: float = 0.5) -> DataFrame:
    """segment_id (from 0 in each series), group_id, kind and label. A gap strictly above gap_sec starts a segment."""
    rows = with_gaps(samples)
    breaks = F.when(F.col("gap_sec") > gap_sec, 1).otherwise(0)
    rows = rows.withColumn("segment_id", F.sum(breaks).over(along().rowsBetween(Window.unboundedPreceding, 0)))
    # both windows have the series' partitioning: segments need no other shuffle
    of_segment = Window.partitionBy("source", "series", "segment_id")
    return rows.withColumns(
        {
            "group_id": F.concat_ws("_", "source", F.col("series").cast("string"), F.col("segment_id").cast("string")),
            "kind": kind_of(F.col("source"), F.avg((F.col("idle") == 1).cast("double")).over(of_segment)),
            "label": label_of(F.col("state")),
        }
    )


def sessionize_in_cells(samples: DataFrame, gap_sec: float, cell_sec: float) -> DataFrame:
    """As sessionize, for series of any length: a series is dealt by time into cells of cell_sec, each ordered by itself.

    What crosses a cell's start, the gap to the row before and the number of breaks so far, comes from one row for each cell
    and its neighbour. The rows that idle shares are taken of are counted by segment, so no window spans a whole series.
    """
    keys = ["source", "series"]
    rows = samples.withColumn("_cell", F.floor(F.col("t_us") / round(cell_sec * 1e6)).cast("long"))
    inside = Window.partitionBy(*keys, "_cell").orderBy("t_us", "seq")
    rows = rows.withColumn("_gap", seconds(F.col("t_us"), F.lag("t_us").over(inside)))
    cells = rows.groupBy(*keys, "_cell").agg(F.min("t_us").alias("_first"), F.max("t_us").alias("_last"), F.sum(F.coalesce((F.col("_gap") > gap_sec).cast("long"), F.lit(0))).alias("_inner"))
    by_cell = Window.partitionBy(*keys).orderBy("_cell")
    cells = cells.withColumn("_enter", seconds(F.col("_first"), F.lag("_last").over(by_cell)))
    opens = F.coalesce((F.col("_enter") > gap_sec).cast("long"), F.lit(0))
    cells = cells.withColumn("_before", F.sum(opens + F.col("_inner")).over(by_cell.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_inner"))
    rows = rows.join(cells.select(*keys, "_cell", "_enter", "_before"), [*keys, "_cell"])
    breaks = F.coalesce((F.col("_gap") > gap_sec).cast("long"), F.lit(0))
    rows = rows.withColumns({"segment_id": F.col("_before") + F.sum(breaks).over(inside.rowsBetween(Window.unboundedPreceding, 0)), "gap_sec": F.when(F.row_number().over(inside) == 1, F.col("_enter")).otherwise(F.col("_gap"))})
    segments = rows.groupBy(*keys, "segment_id").agg(F.avg((F.col("idle") == 1).cast("double")).alias("_idle"))
    rows = rows.join(segments, [*keys, "segment_id"])
    group = F.concat_ws("_", "source", F.col("series").cast("string"), F.col("segment_id").cast("string"))
    out = rows.withColumns({"group_id": group, "kind": kind_of(F.col("source"), F.col("_idle")), "label": label_of(F.col("state"))})
    return out.select(*samples.columns, "gap_sec", "segment_id", "group_id", "kind", "label")


def segment_manifest(rows: DataFrame) -> DataFrame:
    """One row for each segment: times, length, largest gap within, idle and fault shares, and the first faulty time."""
    idle, state = (F.col("idle") == 1).cast("double"), (F.col("state") >= 1).cast("double")
    out = rows.withColumn("_inner", F.when(F.lag("segment_id").over(along()) == F.col("segment_id"), F.col("gap_sec")))
    out = out.groupBy("source", "series", "segment_id", "group_id").agg(
        F.min("t_us").alias("start_us"),
        F.max("t_us").alias("end_us"),
        F.count(F.lit(1)).alias("rows"),
        F.max("_inner").alias("max_gap_sec"),
        F.avg(idle).alias("idle_ratio"),
        F.avg(state).alias("state_ratio"),
        F.min(F.when(F.col("state") >= 1, F.col("t_us"))).alias("onset_us"),
    )
    return out.select(
        "source",
        "series",
        "segment_id",
        "group_id",
        "start_us",
        "end_us",
        seconds(F.col("end_us"), F.col("start_us")).alias("duration_sec"),
        "rows",
        "max_gap_sec",
        "idle_ratio",
        (F.col("idle_ratio") >= 0.5).cast("int").alias("idle_majority"),
        (F.col("state_ratio") >= 0.5).cast("int").alias("label"),
        "onset_us",
    )


def event_manifest(manifest: DataFrame, window_sec: float, common_sec: float) -> DataFrame:
    """Fault segments with an onset, and whether windows of this or of the common length fit in them."""
    events = manifest.where("source = 'fault' and onset_us is not null")
    return events.withColumns({"evaluable_common": evaluable(F.col("duration_sec"), common_sec), "evaluable_this_w": evaluable(F.col("duration_sec"), window_sec)})


def kind_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind").agg(F.countDistinct("group_id").alias("segments"), F.count(F.lit(1)).alias("samples"))


def segment_quality(rows: DataFrame, gap_sec: float) -> DataFrame:
    """One row: segments, gaps over the threshold, idle rows and segments that are mostly idle."""
    each = rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("gap_sec") > gap_sec).cast("long")).alias("gaps"), F.sum((F.col("idle") == 1).cast("long")).alias("idle"))
    return each.agg(F.count(F.lit(1)).alias("segments"), F.sum("n").alias("rows"), F.coalesce(F.sum("gaps"), F.lit(0)).alias("gaps_over"), F.sum("idle").alias("idle_rows"), F.sum((F.col("idle") * 2 >= F.col("n")).cast("long")).alias("idle_segments"))


def nominal_interval(samples: DataFrame, longest: float = 0.5, default: float = 0.1) -> DataFrame:
    """One row: the median of gaps above 0 and up to longest."""
    gaps = with_gaps(samples).where((F.col("gap_sec") > 0) & (F.col("gap_sec") <= longest))
    return exact_median(gaps, F.col("gap_sec")).select(F.coalesce("median", F.lit(default)).alias("interval_sec"))


def infer_step(windows: DataFrame) -> DataFrame:
    """One row: the median step between window starts of a group, and the median length."""
    along = Window.partitionBy("group_id").orderBy("start_us")
    step = seconds(F.col("start_us"), F.lag("start_us").over(along))
    rows = windows.select(F.when(step > 0, step).alias("step_sec"), seconds(F.col("end_us"), F.col("start_us")).alias("window_sec"))
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("v")) for c in ("step_sec", "window_sec")))).alias("e")).select("e.name", "e.v")
    found = exact_median(long, F.col("v"), ["name"])
    return found.agg(*(F.max(F.when(F.col("name") == c, F.col("median"))).alias(c) for c in ("step_sec", "window_sec")))


def route_scales(windows: DataFrame) -> DataFrame:
    """The windows of the longest scale that each group has."""
    longest = windows.groupBy("group_id").agg(F.max("window_sec").alias("window_sec"))
    return windows.join(longest, ["group_id", "window_sec"], "left_semi")


def last_of_kind(rows: DataFrame, n: int) -> DataFrame:
    """The last n rows that aren't idle, for a demonstration."""
    return rows.where("coalesce(idle, 0) <> 1").orderBy(F.desc("t_us"), F.desc("seq")).limit(n)


def first_of_longest_idle(rows: DataFrame, n: int) -> DataFrame:
    """The first n rows of the group with most idle rows."""
    idle = rows.where("idle = 1")
    top = idle.groupBy("group_id").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), "group_id").limit(1)
    return idle.join(F.broadcast(top.select("group_id")), "group_id", "left_semi").orderBy("t_us", "seq").limit(n)


def demo_stream(blocks: DataFrame, join_gap_sec: float) -> DataFrame:
    """Rows of numbered blocks (block, t_us) moved so that each block starts join_gap_sec after the one before ends."""
    each = blocks.groupBy("block").agg(F.min("t_us").alias("_low"), F.max("t_us").alias("_high"))
    # as many rows as blocks
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    gap = F.lit(round(join_gap_sec * 1e6))
    first = F.first("_low").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, 0))
    moved = each.withColumn("_start", first + F.coalesce(F.sum(F.col("_high") - F.col("_low") + gap).over(before), F.lit(0)))
    rows = blocks.join(F.broadcast(moved.select("block", "_low", "_start")), "block").withColumn("original_us", F.col("t_us"))
    return rows.withColumn("t_us", F.col("t_us") - F.col("_low") + F.col("_start")).drop("_low", "_start")
