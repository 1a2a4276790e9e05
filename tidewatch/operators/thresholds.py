"""Thresholds from calibration scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.scalar import finite, ratio
from tidewatch.sources.scratch import written


#: Cells for each doubling of a value.
CELLS = 64


def cell_of(value: Column, cells: int = CELLS) -> Column:
    """The number of a value's cell: ranges of about 1 % each, in the order of the values, below and above zero."""
    place = lambda x: F.floor(F.log2(x) * cells).cast("long") + 2048 * cells
    return F.when(value > 0, place(value)).when(value < 0, -place(-value)).otherwise(F.lit(0).cast("long"))


def _join_cells(rows: DataFrame, cells: DataFrame, by: list[str]) -> DataFrame:
    """rows with the other columns of their cells.

    Cells are never null; the comparison that allows for nulls keeps Spark from testing for them below, where the value may
    be a long expression.
    """
    renamed = cells.withColumnsRenamed({c: f"_of_{c}" for c in [*by, "_cell"]})
    same = F.col("_cell").eqNullSafe(F.col("_of__cell"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return rows.join(renamed, same).drop(*(f"_of_{c}" for c in [*by, "_cell"]))


def exact_quantiles(rows: DataFrame, value: str, quantiles: tuple[float, ...], by: list[str] | None = None, many: bool = False) -> DataFrame:
    """by, quantiles (an array) and n: exact, linearly interpolated quantiles of the values that are known.

    Values are counted by cell; only the different values of the cells that hold a wanted rank are shuffled and ordered, each cell
    by itself. So no task holds all values of a group. many: there are too many groups to send the wanted cells to all tasks.
    """
    by = by or []
    known = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    # written, as it is read twice and what gives the values may be a long plan
    each = written(known.withColumn("_cell", cell_of(F.col("_v"))), "values")
    sizes = each.groupBy(*by, "_cell").agg(F.count(F.lit(1)).alias("_size"))
    return quantiles_by_cells(sizes, lambda keys: _join_cells(each, keys if many else F.broadcast(keys), by), quantiles, by)


def quantiles_by_cells(sizes: DataFrame, values_of: Callable[[DataFrame], DataFrame], quantiles: tuple[float, ...], by: list[str]) -> DataFrame:
    """What exact_quantiles returns, of values that are counted by cell already (by, _cell, _size).

    values_of: by, _cell, _before and each value _v in some cells (by, _cell, _before); cells are in the order of their values.
    """
    whole = Window.partitionBy(*by, F.lit(0))
    before = F.coalesce(F.sum("_size").over(whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumns({"_before": before, "n": F.sum("_size").over(whole)})
    places = F.array(*(F.struct(F.lit(i).alias("i"), ((F.col("n") - 1) * F.lit(float(q))).alias("at")) for i, q in enumerate(quantiles)))
    sizes = sizes.withColumn("_p", F.explode(places)).select(*by, "_cell", "_before", "_size", "n", "_p.i", "_p.at")
    wanted = sizes.where((F.floor("at") < F.col("_before") + F.col("_size")) & (F.ceil("at") >= F.col("_before")))
    # a few cells for each group and quantile: the values of these only
    cell_keys = wanted.select(*by, "_cell", "_before").distinct()
    inside = values_of(cell_keys).groupBy(*by, "_cell", "_before", "_v").agg(F.count(F.lit(1)).alias("_k"))
    upto = F.sum("_k").over(Window.partitionBy(*by, "_cell").orderBy("_v")) + F.col("_before")
    inside = inside.withColumn("_upto", upto).withColumn("_from", F.col("_upto") - F.col("_k"))
    met = _join_cells(inside.drop("_before"), wanted.drop("_before", "_size"), by)
    covers = lambda rank: (F.col("_from") <= rank) & (rank < F.col("_upto"))
    low, high = (F.max(F.when(covers(f(F.col("at"))), F.col("_v"))) for f in (F.floor, F.ceil))
    found = met.groupBy(*by, "i").agg(low.alias("_low"), high.alias("_high"), F.first("at").alias("at"), F.first("n").alias("n"))
    found = found.withColumn("v", F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("at") - F.floor("at")))
    return found.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("quantiles"), F.first("n").alias("n"))


def exact_median(rows: DataFrame, value: Column, by: list[str] | None = None, out: str = "median", q: float = 0.5) -> DataFrame:
    """by and out: the exact median (or quantile) of the known values, by cells. Without by one row, null where there are no values."""
    found = exact_quantiles(rows.select(*(by or []), value.alias("_value")), "_value", (q,), by)
    return found.select(*(by or []), F.get("quantiles", F.lit(0)).alias(out))


def normal_quantile(scored: DataFrame, q: float, by: list[str] | None = None, score: str = "score") -> DataFrame:
    """threshold and n: the exact, linearly interpolated quantile of the scores of label 0, for each group of `by`."""
    found = exact_quantiles(scored.where(F.col("label") == 0), score, (q,), by)
    return found.select(*(by or []), F.get("quantiles", F.lit(0)).alias("threshold"), F.coalesce("n", F.lit(0)).alias("n"))


#: As normal_quantile, by its earlier name for stored scores.
normal_quantile_of_table = normal_quantile


def threshold_sweep(scored: DataFrame, by: list[str] | None = None, score: str = "score") -> DataFrame:
    """For each different score as threshold: true and false positives, precision, recall, F1.

    Scores are counted first; the running sums go over the different scores of a cell, on top of the sums of the cells above, so
    no task holds all scores.
    """
    by = by or []
    known = scored.where(F.col(score).isNotNull() & F.col("label").isin(0, 1))
    each = known.groupBy(*by, F.col(score).alias("threshold")).agg(F.sum("label").alias("_p"), F.count(F.lit(1)).alias("_n"))
    each = each.withColumn("_cell", cell_of(F.col("threshold")))
    whole = Window.partitionBy(*by, F.lit(0))
    above = whole.orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    sums = each.groupBy(*by, "_cell").agg(F.sum("_p").alias("_cp"), F.sum("_n").alias("_cn"))
    sums = sums.select(*by, "_cell", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("_cp", "_cn")), F.sum("_cp").over(whole).alias("positives"))
    down = Window.partitionBy(*by, "_cell").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumns({"_tp": F.sum("_p").over(down), "_called": F.sum("_n").over(down)})
    each = _join_cells(each, sums, by)
    each = each.withColumns({"tp": F.col("_tp") + F.col("_cp_above"), "called": F.col("_called") + F.col("_cn_above")})
    each = each.withColumns({"precision": ratio(F.col("tp"), F.col("called")), "recall": F.coalesce(ratio(F.col("tp"), F.col("positives")), F.lit(0.0))})
    f1 = F.coalesce(ratio(2 * F.col("tp"), F.col("called") + F.col("positives")), F.lit(0.0))
    return each.withColumns({"fp": F.col("called") - F.col("tp"), "f1": f1}).select(*by, "threshold", "tp", "called", "positives", "precision", "recall", "fp", "f1")


def best_f1(scored: DataFrame, by: list[str] | None = None, score: str = "score") -> DataFrame:
    """The threshold with the largest F1; of equals that of the larger precision, then the smaller threshold."""
    by = by or []
    sweep = threshold_sweep(scored, by, score)
    key = F.struct(F.round("f1", 12), F.round("precision", 12), -F.col("threshold"))
    best = sweep.groupBy(*by).agg(F.max_by(F.struct("threshold", "f1", "precision", "recall", "tp", "fp"), key).alias("_b"))
    return best.select(*by, "_b.*")


def monotone(thresholds: DataFrame, by: list[str]) -> DataFrame:
    """Rows (quantile, threshold) that fall below the one of the next lower quantile: none should."""
    before = F.lag("threshold").over(Window.partitionBy(*by).orderBy("quantile"))
    return thresholds.withColumn("_before", before).where(F.col("threshold") < F.col("_before") - 1e-12).drop("_before")


def score_audit(scored: DataFrame, score: str = "score") -> DataFrame:
    """One row: rows, labels, and finite scores by label."""
    known = finite(F.col(score).cast("double")).isNotNull()
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    normal, fault = F.col("label") == 0, F.col("label") == 1
    return scored.agg(F.count(F.lit(1)).alias("rows"), count(normal).alias("normal"), count(fault).alias("fault"), count(known).alias("finite"), count(known & normal).alias("finite_normal"), count(known & fault).alias("finite_fault"))
