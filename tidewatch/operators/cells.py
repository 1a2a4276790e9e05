"""Segments of any length: rows numbered in one order of the whole table and cut into cells of as many rows.

A window function over a segment needs the segment in one task. Here rows are dealt by ranges of (segment, time), so a long
segment is many tasks. What crosses a cell's start is brought to it: the last rows before it, for frames of a fixed number of rows
(over_cells); the largest or summed value of the cells before it (carried); and for windows whose start depends on the one before,
where a walk that enters a cell leaves it (window_starts_in_cells).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.scalar import in_fault_zone, seconds
from tidewatch.operators.thresholds import exact_quantiles
from tidewatch.sources.scratch import written

#: Rows of a cell: what one task holds at a time.
CELL_ROWS = 65_536
ORDER = ("group_id", "t_us", "seq")


def _offsets(counts: DataFrame) -> DataFrame:
    """_part and _before: the rows of the partitions before it. counts has a row for each partition of a range shuffle."""
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    return F.broadcast(counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before")))


def numbered(rows: DataFrame, order: tuple[str, ...] = ORDER, name: str = "numbered") -> DataFrame:
    """rows, written, with place: from 0, in the order of the whole table."""
    # the id counts the rows of a partition in their order, which is sorted
    ranged = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), name)
    part = F.shiftrightunsigned("_id", 33).alias("_part")
    counts = ranged.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    placed = ranged.withColumn("_part", F.shiftrightunsigned("_id", 33)).join(_offsets(counts), "_part")
    return placed.select(*rows.columns, (F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).alias("place"))


def cell_of_place(size: int, place: str = "place") -> Column:
    return F.floor(F.col(place) / size).cast("long")


def over_cells(rows: DataFrame, back: int, f: Callable[[DataFrame], DataFrame], size: int = CELL_ROWS) -> DataFrame:
    """f(rows), for window functions within a segment (group_id) that look back at most `back` rows, cell by cell.

    rows are numbered. Each cell is given the `back` rows before it; f sees a segment's part in a cell under a group_id of its
    own, and must return all rows it is given.
    """
    if back > size:
        raise ValueError("a cell must hold the rows that are looked back at")
    cell = cell_of_place(size)
    lent = F.explode(F.when(F.pmod("place", F.lit(size)) >= size - back, F.array(cell, cell + 1)).otherwise(F.array(cell)))
    parts = rows.withColumn("_cell", lent).withColumn("_group", F.col("group_id"))
    out = f(parts.withColumn("group_id", F.concat_ws("|", "group_id", F.col("_cell").cast("string"))))
    return out.where(F.col("_cell") == cell).withColumn("group_id", F.col("_group")).drop("_cell", "_group")


def carried(rows: DataFrame, value: Column, how: Callable, order: list[str], out: str, size: int = CELL_ROWS) -> DataFrame:
    """rows with out: `how` (F.max, F.min or F.sum) of the value over the segment's rows before, of any number; null for none.

    rows are numbered in an order that begins with group_id. Each cell's own value and those of the cells before it are one row for each
    cell, and a cell's rows add what lies before them in it.
    """
    held = rows.withColumns({"_v": value, "_cell": cell_of_place(size)})
    each = held.groupBy("group_id", "_cell").agg(how("_v").alias("_all"))
    before = how("_all").over(Window.partitionBy("group_id").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    each = each.select("group_id", "_cell", before.alias("_carry"))
    inside = how("_v").over(Window.partitionBy("group_id", "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    both = {F.max: F.greatest, F.min: F.least, F.sum: lambda a, b: F.coalesce(a + b, a, b)}[how]
    return held.withColumn("_in", inside).join(each, ["group_id", "_cell"]).withColumn(out, both("_carry", "_in")).drop("_v", "_cell", "_in", "_carry")


def window_false_alarms_in_cells(windows: DataFrame, alarm: str, step_sec: float, size: int = CELL_ROWS) -> DataFrame:
    """One row as metrics.window_false_alarms: episodes, exposure, groups and groups with a false alarm, for segments of any length."""
    zone = windows.where(~in_fault_zone(F.col("source"), F.col("onset_us"), F.col("end_us")))
    order = ("group_id", "start_us", "end_us")
    placed = numbered(zone, order, "exposure")
    along = Window.partitionBy("group_id").orderBy("start_us", "end_us")

    def starts(rows: DataFrame) -> DataFrame:
        near = seconds(F.col("start_us"), F.lag("start_us").over(along)) <= step_sec * 1.5
        return rows.withColumn("_new", F.col(alarm) & ~F.coalesce(F.lag(alarm).over(along) & near, F.lit(False)))

    rows = carried(over_cells(placed, 1, starts, size), F.col("end_us"), F.max, ["start_us", "end_us"], "_reached", size)
    more = F.greatest(F.lit(0.0), seconds(F.col("end_us"), F.greatest("start_us", F.coalesce("_reached", "start_us"))))
    each = rows.groupBy("group_id").agg(F.sum(F.col("_new").cast("long")).alias("_e"), F.sum(more).alias("_x"))
    return each.agg(F.coalesce(F.sum("_e"), F.lit(0)).alias("n_episodes"), F.coalesce(F.sum("_x"), F.lit(0.0)).alias("exposure_sec"), F.count(F.lit(1)).alias("n_groups"), F.sum((F.col("_e") > 0).cast("long")).alias("n_fa_groups"))


def k_consecutive_in_cells(windows: DataFrame, threshold: Column, k: int, out: str = "alarm_k", tolerance_sec: float = 1e-6, size: int = CELL_ROWS) -> DataFrame:
    """As alarms.k_consecutive: a window is the k-th or later of its run if it and the k - 1 before it are high, and each of the last k - 1
    follows the one before. The median step of a group is an exact quantile by cells."""
    along = Window.partitionBy("group_id").orderBy("start_us", "end_us")
    placed = numbered(windows, ("group_id", "start_us", "end_us"), "consecutive")
    if k <= 1:
        return placed.withColumn(out, F.coalesce(F.col("score") >= threshold, F.lit(False))).drop("place")
    step = seconds(F.col("start_us"), F.lag("start_us").over(along))
    # the step needs one row back, and the run k - 1 more
    stepped = over_cells(placed, 1, lambda rows: rows.withColumn("_step", step), size)
    stepped = written(stepped, "steps")
    median = exact_quantiles(stepped.where("_step > 0"), "_step", (0.5,), ["group_id"], many=True).select("group_id", F.col("quantiles")[0].alias("_expected"))
    # a long segment's rows meet its median cell by cell
    keys = stepped.select("group_id", cell_of_place(size).alias("_c")).distinct().join(median, "group_id")
    rows = stepped.withColumn("_c", cell_of_place(size)).join(keys, ["group_id", "_c"], "left").drop("_c")
    near = F.abs(F.col("_step") - F.col("_expected")) <= F.greatest(F.lit(tolerance_sec), F.col("_expected") * 0.02)
    rows = rows.withColumns({"_high": F.coalesce(F.col("score") >= threshold, F.lit(False)), "_follows": F.coalesce(F.col("_step").isNull() | F.col("_expected").isNull() | near, F.lit(False))})

    def runs(part: DataFrame) -> DataFrame:
        last, but_first = along.rowsBetween(1 - k, 0), along.rowsBetween(2 - k, 0)
        whole = (F.count(F.lit(1)).over(last) >= k) & F.min("_high").over(last) & F.min("_follows").over(but_first)
        return part.withColumn(out, whole)

    return over_cells(rows, k - 1, runs, size).drop("place", "_step", "_expected", "_high", "_follows")


def alarms_to_rows_in_cells(rows: DataFrame, windows: DataFrame, alarm: str, out: str, size: int = CELL_ROWS) -> DataFrame:
    """As alarms.alarms_to_rows: true for rows in [end, end + length) of an alarmed window of their segment."""
    marks = windows.where(F.col(alarm)).select("group_id", F.col("end_us").alias("t_us"), (2 * F.col("end_us") - F.col("start_us")).alias("_to"))
    both = rows.withColumn("_to", F.lit(None).cast("long")).unionByName(marks, allowMissingColumns=True).withColumn("_row", F.col("_to").isNull())
    # of one time, the intervals come first
    placed = numbered(both, ("group_id", "t_us", "_row"), "intervals")
    reached = carried(placed, F.col("_to"), F.max, ["t_us", "_row", "place"], "_reached", size)
    return reached.where("_row").withColumn(out, F.coalesce(F.col("_reached") > F.col("t_us"), F.lit(False))).select(*rows.columns, out)


# time windows


def _counts_before(rows: DataFrame, width: int, step: int) -> DataFrame:
    """place, which, value: for each row how many rows of the table come before its group's first one at or after its time and the step
    (which 1) or the width (2), whatever lies between. One sort of the rows and these questions together, questions first at equal times."""
    ask = F.explode(F.array(*(F.struct(F.lit(w).alias("which"), (F.col("t_us") + d).alias("at")) for w, d in ((0, 0), (1, step), (2, width)))))
    points = rows.select("group_id", "place", ask.alias("q")).select("group_id", "q.at", (F.col("q.which") == 0).alias("_row"), "place", "q.which")
    order = ("group_id", "at", "_row", "place")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, part = 0, -1
        for batch in batches:
            if not batch.num_rows:
                continue
            place, which, ids = (c.to_numpy() for c in batch.columns)
            part = int(ids[0]) >> 33
            before = seen + np.cumsum(which == 0)
            asks = np.flatnonzero(which > 0)
            seen = int(before[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(asks), part)), pa.array(place[asks]), pa.array(which[asks]), pa.array(before[asks])], ["_part", "place", "which", "value"])
        if part >= 0:
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([None], pa.int64()), pa.array([0], pa.int32()), pa.array([seen])], ["_part", "place", "which", "value"])

    ranged = points.repartitionByRange(*order).sortWithinPartitions(*order).select("place", "which", F.monotonically_increasing_id().alias("_id"))
    found = written(ranged.mapInArrow(count, "_part long, place long, which int, value long"), "questions")
    offsets = _offsets(found.where("which = 0").select("_part", F.col("value").alias("_n")))
    return found.where("which > 0").join(offsets, "_part").select("place", "which", (F.col("value") + F.col("_before")).alias("value"))


def window_starts_in_cells(rows: DataFrame, window_sec: float, step_sec: float, min_samples: int, size: int = CELL_ROWS) -> DataFrame:
    """group_id, start_us, end_us as windows.window_starts, for segments of any length.

    Where a walk goes from a row depends on that row only, so each cell tells for all its rows where a walk that is there leaves the cell.
    Of these, the rows that a walk can enter at (targets from other cells, and the first rows of segments) form a graph of a few
    rows for each cell, in which the rows really entered are found by doubling: as many rounds as the number of cells has binary digits.
    Each cell then walks from where it is entered.
    """
    width, step = round(window_sec * 1e6), round(step_sec * 1e6)
    placed = numbered(rows.select("group_id", "t_us"), ("group_id", "t_us"), "walk")
    groups = placed.groupBy("group_id").agg(F.min("place").alias("first"), (F.max("place") + 1).alias("end"))
    # where each group's part of a cell begins, and where the group ends
    parts = placed.groupBy("group_id", cell_of_place(size).alias("cell")).agg(F.min("place").alias("place")).join(groups, "group_id")
    asked = _counts_before(placed, width, step).select(cell_of_place(size).alias("cell"), "place", "which", "value")
    asked = asked.unionByName(parts.select("cell", "place", F.lit(3).alias("which"), F.col("end").alias("value")))

    def point(table: pa.Table) -> pa.Table:
        """place, next (-1: the walk ends), keep, leave: the first place outside the cell."""
        place, which, value = (table.column(c).to_numpy() for c in ("place", "which", "value"))
        low = int(table.column("cell")[0].as_py()) * size
        n = int(place.max()) - low + 1
        hop, end, last = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for w, a in ((1, hop), (2, end), (3, last)):
            a[place[which == w] - low] = value[which == w]
        last = np.maximum.accumulate(last)  # group ends rise with the places
        own = np.arange(low, low + n)
        inside = end < last
        keep = inside & (end - own >= min_samples)
        after = np.where(keep, hop, own + 1)
        after[~inside | (after >= last)] = -1
        leave = after.copy()
        while True:
            at = np.flatnonzero((leave >= low) & (leave < low + n))
            if not len(at):
                break
            leave[at] = leave[leave[at] - low]
        return pa.table({"cell": pa.array(np.full(n, low // size)), "place": pa.array(own), "next": pa.array(after), "keep": pa.array(keep), "leave": pa.array(leave)})

    pointers = written(asked.groupBy("cell").applyInArrow(point, "cell long, place long, next long, keep boolean, leave long"), "pointers")
    roots = groups.select(F.col("first").alias("place"))
    entries = pointers.where((F.col("next") >= 0) & (cell_of_place(size, "next") != F.col("cell"))).select(F.col("next").alias("place")).union(roots).distinct()
    jumps = written(pointers.join(entries, "place").where("leave >= 0").select(F.col("place").alias("a"), F.col("leave").alias("b")), "jumps")
    entered = written(roots, "entered")
    while not jumps.isEmpty():
        entered = written(entered.union(entered.join(jumps, entered["place"] == jumps["a"]).select("b")).distinct(), "entered")
        second = jumps.select(F.col("a").alias("b"), F.col("b").alias("c"))
        jumps = written(jumps.join(second, "b").select("a", F.col("c").alias("b")), "jumps")

    def walk(pointers: pa.Table, entered: pa.Table) -> pa.Table:
        if not pointers.num_rows:
            return pa.table({"place": pa.array([], pa.int64())})
        place = pointers.column("place").to_numpy()
        order = np.argsort(place)
        low, n = int(place[order[0]]), len(place)
        after = pointers.column("next").to_numpy()[order].tolist()
        keep = pointers.column("keep").to_numpy(zero_copy_only=False)[order].tolist()
        found = []
        for at in entered.column("place").to_pylist():
            while 0 <= at - low < n:
                if keep[at - low]:
                    found.append(at)
                at = after[at - low]
        return pa.table({"place": pa.array(found, pa.int64())})

    into = entered.select(cell_of_place(size).alias("cell"), "place")
    starts = pointers.select("cell", "place", "next", "keep").groupBy("cell").cogroup(into.groupBy("cell")).applyInArrow(walk, "place long")
    found = placed.join(starts.distinct(), "place").select("group_id", F.col("t_us").alias("start_us"))
    return found.withColumn("end_us", F.col("start_us") + width)
