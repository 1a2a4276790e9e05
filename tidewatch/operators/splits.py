"""Splits by group.

The seeded forms shuffle groups in order as numpy does, so the reference protocol's folds can be repeated; the hashed forms rank
groups by a hash. Both take any number of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.scalar import finite
from tidewatch.sources.scratch import written

#: Positions of a shuffle that are passed on together.
DRAWN = 100_000


def shuffled(groups: DataFrame, by: Column, order: tuple[str, ...], seed: int) -> DataFrame:
    """groups (distinct) with position, from 0 within equal `by`, as numpy's generator with the seed shuffles each class in order, and n,
    how many share it. by: small whole numbers; the classes are shuffled from the lowest on by one generator.

    Rows are ordered and numbered by Spark. A shuffle depends on all draws before, so one task draws it, of numbers alone: eight bytes for
    each group of a class.
    """
    from tidewatch.operators.cells import numbered

    placed = numbered(groups.withColumn("_by", by.cast("long")), ("_by", *order), "shuffled")
    sizes = sorted((r["_by"], r["first"], r["n"]) for r in placed.groupBy("_by").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).collect())

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not sum(batch.num_rows for batch in batches):
            return
        rng = np.random.default_rng(seed)
        for _, first, n in sizes:
            index = np.arange(n)
            rng.shuffle(index)
            for at in range(0, n, DRAWN):
                part = index[at : at + DRAWN]
                yield pa.RecordBatch.from_arrays([pa.array(first + part), pa.array(np.arange(at, at + len(part))), pa.array(np.full(len(part), n))], ["place", "position", "n"])

    drawn = written(groups.sparkSession.range(0, 1, 1, 1).mapInArrow(draw, "place long, position long, n long"), "positions")
    return placed.join(drawn, "place").drop("_by", "place")


def fold_map(rows: DataFrame, k: int, seed: int) -> DataFrame:
    """group_id, fold: groups of each kind shuffled (fault, normal, idle, by one generator) and dealt in turn."""
    kind = F.when(F.col("kind") == "fault", 0).when(F.col("kind") == "normal", 1).when(F.col("kind") == "idle", 2)
    groups = rows.select(F.col("group_id").cast("string").alias("group_id"), kind.alias("_kind")).where("_kind is not null").distinct()
    return shuffled(groups, F.col("_kind"), ("group_id",), seed).select("group_id", (F.col("position") % k).cast("int").alias("fold"))


def hash_share(group_id: Column, seed: int = 0) -> Column:
    """A number from 0 to below 1 for each group: the first 32 bits of the MD5 of seed:group_id."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), group_id)), 1, 8), 16, 10).cast("double") / 2**32


def hashed_fold_map(rows: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """group_id, kind, fold: a fold for each group by its hash with the seed; needs no order of the groups."""
    groups = rows.select("group_id", "kind").distinct()
    return groups.withColumn("fold", F.floor(hash_share(F.col("group_id"), seed) * k).cast("int"))


def ranked_fold_map(rows: DataFrame, k: int) -> DataFrame:
    """group_id, kind, fold: the groups of each kind in order, dealt in turn."""
    groups = rows.select("group_id", "kind").distinct()
    return groups.withColumn("fold", ((F.row_number().over(Window.partitionBy("kind").orderBy("group_id")) - 1) % k).cast("int"))


def fold_role(kind: Column, fold: Column, test: Column, k: int) -> Column:
    """test for the test fold; else validation for normal rows of the next fold, train for the other normal rows."""
    normal = kind == "normal"
    return F.when(fold == test, "test").when(normal & (fold == (test + 1) % k), "validation").when(normal, "train").otherwise("unused")


def fold_roles(rows: DataFrame, folds: DataFrame, k: int) -> DataFrame:
    """rows once for each test fold, with the role they have in it: folds are a column, not a loop."""
    every = rows.join(folds.select("group_id", "fold"), "group_id").withColumn("test_fold", F.explode(F.array(*(F.lit(i) for i in range(k)))))
    return every.withColumn("role", fold_role(F.col("kind"), F.col("fold"), F.col("test_fold"), k))


def assign_splits(manifest: DataFrame, common_sec: float, train: float = 0.6, validation: float = 0.2, seed: int = 42) -> DataFrame:
    """manifest with split: train, val, test by label after a seeded shuffle, EXCLUDED_IDLE, EXCLUDED_SHORT.

    Groups are shuffled in the order of their source (normal first), series and segment.
    """
    idle = F.col("idle_majority") == 1
    short = (F.col("source") == "fault") & F.col("onset_us").isNotNull() & (F.col("duration_sec") < common_sec)
    rows = manifest.withColumn("_out", F.when(idle, "EXCLUDED_IDLE").when(short, "EXCLUDED_SHORT"))
    free = rows.where("_out is null").select("group_id", "label", (F.col("source") == "fault").alias("_fault"), "series", "segment_id")
    a, b = _sizes(F.col("n"), train, validation)
    chosen = shuffled(free, F.col("label"), ("_fault", "series", "segment_id"), seed).select("group_id", _split(F.col("position"), a, b).alias("_in"))
    return rows.join(chosen, "group_id", "left").withColumn("split", F.coalesce("_out", "_in")).drop("_out", "_in")


def _sizes(n: Column, train: float, validation: float) -> tuple[Column, Column]:
    """split_sizes of a column; bround rounds half to even, as Python does."""
    many = n >= 3
    a = F.when(many, F.greatest(F.lit(1), F.least(F.bround(n * train).cast("long"), n - 2))).otherwise(F.bround(n * train).cast("long"))
    b = F.when(many, F.greatest(F.lit(1), F.least(F.bround(n * validation).cast("long"), n - a - 1))).otherwise(F.bround(n * validation).cast("long"))
    return a, b


def _split(rank: Column, a: Column, b: Column) -> Column:
    return F.when(rank < a, "train").when(rank < a + b, "val").otherwise("test")


def split_sizes(n: int, train: float, validation: float) -> tuple[int, int]:
    """How many of n groups are for training and validation: one or more each, and one for testing, from three on."""
    a, b = round(n * train), round(n * validation)
    if n >= 3:
        a = max(1, min(a, n - 2))
        b = max(1, min(b, n - a - 1))
    return a, b


def hashed_splits(manifest: DataFrame, common_sec: float, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """As assign_splits, with each group's split by its hash."""
    idle = F.col("idle_majority") == 1
    short = (F.col("source") == "fault") & F.col("onset_us").isNotNull() & (F.col("duration_sec") < common_sec)
    u = hash_share(F.col("group_id"))
    return manifest.withColumn("split", F.when(idle, "EXCLUDED_IDLE").when(short, "EXCLUDED_SHORT").when(u < train, "train").when(u < train + validation, "val").otherwise("test"))


def calibration_groups(rows: DataFrame, fraction: float, seed: int) -> DataFrame:
    """group_id of a seeded share of the groups, from 5 % to below a half, at least one and not all."""
    if not 0.05 <= fraction < 0.5:
        raise ValueError("fraction must be 0.05 or more and below 0.5")
    groups = rows.select(F.col("group_id").cast("string").alias("group_id")).distinct()
    placed = shuffled(groups, F.lit(0), ("group_id",), seed)
    if len(placed.limit(2).collect()) < 2:
        raise ValueError("at least two groups are needed")
    n = F.least(F.greatest(F.lit(1), F.ceil(F.col("n") * fraction)), F.col("n") - 1)
    return placed.where(F.col("position") < n).select("group_id")


def training_rows(rows: DataFrame, exclude: DataFrame | None = None, channels: tuple[str, ...] | None = None) -> DataFrame:
    """Normal rows that aren't idle, without the groups to exclude. With channels, it is an error if there are no such rows (at
    once) or a channel of them is unknown (when they are read)."""
    out = rows.where("kind = 'normal' and coalesce(idle, 0) <> 1 and t_us is not null")
    if exclude is not None:
        out = out.join(exclude.select("group_id").distinct(), "group_id", "left_anti")
    if channels:
        if out.isEmpty():
            raise ValueError("no normal rows to train on")
        for c in channels:
            out = out.withColumn(c, F.coalesce(finite(F.col(c)), F.raise_error(F.lit(f"{c} must be finite")).cast("double")))
    return out


def subsample(rows: DataFrame, fraction: float, seed: int) -> DataFrame:
    """max(2, round(n * fraction)) rows without replacement."""
    if fraction >= 1.0:
        return rows
    return rows.orderBy(F.rand(seed)).limit(max(2, round(rows.count() * fraction)))


def leaking_groups(windows: DataFrame) -> DataFrame:
    """Groups with more than one split: none should be."""
    return windows.groupBy("group_id").agg(F.countDistinct("split").alias("splits")).where("splits > 1")


# exact sizes by a keyed permutation: groups are ranked by a hash with the seed, in ranges, so any number of them


def permuted(groups: DataFrame, seed: int, by: str, key: str = "group_id") -> DataFrame:
    """groups (distinct) with rank, from 0 in a seeded order within equal `by`, and n, how many share it."""
    from tidewatch.operators.cells import numbered

    order = (by, "_h", key)
    placed = numbered(groups.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))), order, "permuted")
    sizes = placed.groupBy(F.col(by).alias("_by")).agg(F.min("place").alias("_first"), F.count(F.lit(1)).alias("n"))
    return placed.join(sizes, F.col(by).eqNullSafe(F.col("_by"))).withColumn("rank", F.col("place") - F.col("_first")).drop("_h", "_by", "_first", "place")


def exact_fold_map(rows: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """group_id, kind, fold: the groups of each kind in a seeded order, dealt in turn, so fold sizes differ by one at most."""
    groups = rows.select("group_id", "kind").distinct()
    return permuted(groups, seed, "kind").select("group_id", "kind", (F.col("rank") % k).cast("int").alias("fold"))


def exact_splits(manifest: DataFrame, common_sec: float, train: float = 0.6, validation: float = 0.2, seed: int = 42) -> DataFrame:
    """As assign_splits: the same sizes by label, for any number of groups."""
    idle = F.col("idle_majority") == 1
    short = (F.col("source") == "fault") & F.col("onset_us").isNotNull() & (F.col("duration_sec") < common_sec)
    rows = manifest.withColumn("_out", F.when(idle, "EXCLUDED_IDLE").when(short, "EXCLUDED_SHORT"))
    a, b = _sizes(F.col("n"), train, validation)
    chosen = permuted(rows.where("_out is null").select("group_id", "label"), seed, "label").select("group_id", _split(F.col("rank"), a, b).alias("_in"))
    return rows.join(chosen, "group_id", "left").withColumn("split", F.coalesce("_out", "_in")).drop("_out", "_in")


def exact_calibration_groups(rows: DataFrame, fraction: float, seed: int) -> DataFrame:
    """group_id of a seeded share of the groups, as calibration_groups, for any number of groups."""
    if not 0.05 <= fraction < 0.5:
        raise ValueError("fraction must be 0.05 or more and below 0.5")
    groups = permuted(rows.select("group_id").distinct().withColumn("_all", F.lit(0)), seed, "_all")
    n = F.least(F.greatest(F.lit(1), F.ceil(F.col("n") * fraction)), F.col("n") - 1)
    return groups.where(F.col("rank") < n).select("group_id")


def exact_subsample(rows: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """max(2, round(n * fraction)) rows without replacement, by a seeded order of their key, whose values differ; no row order is needed."""
    if fraction >= 1.0:
        return rows
    chosen = permuted(rows.select(key).withColumn("_all", F.lit(0)), seed, "_all", key)
    kept = chosen.where(F.col("rank") < F.greatest(F.lit(2), F.bround(F.col("n") * fraction).cast("long"))).select(key)
    return rows.join(kept, key, "left_semi")
