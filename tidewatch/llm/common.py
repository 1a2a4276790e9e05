"""What the corpus operators share: tables in the shared folder, ranks within a key, spread over tasks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A-Z and a-z, for lower-casing ASCII letters only (fixed values).
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: bytes.translate table that lower-cases A-Z and leaves all other bytes.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidewatch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back.

    Cuts the lineage: rows that are used twice, or whose order must not change on a retry, are computed once and
    survive the loss of any executor. The tables stay in the folder, as results may still read them; a cluster clears it by age.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_batches(spark: SparkSession, n_bytes: int) -> Iterator[None]:
    """What is run in here hands rows to Python in batches of about n_bytes at most, however large a partition is."""
    conf = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(conf)
    spark.conf.set(conf, str(n_bytes))
    try:
        yield
    finally:
        spark.conf.set(conf, before)


def new_name(df: DataFrame, name: str) -> str:
    """name, or with as many _ behind it as make it the name of no column of df."""
    known = {c.lower() for c in df.columns}
    while name.lower() in known:
        name += "_"
    return name


def with_row_key(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """docs, materialized with a key of its own for each row, and the name of the key's column, which is new."""
    key = new_name(docs, "_row_key")
    return materialize(docs.withColumn(key, F.monotonically_increasing_id()), name), key


#: A key is hot if more than one row in so many has it: there are at most so many hot keys.
HOT = 1000


def look_up(rows: DataFrame, found: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """rows with the other columns of found, null where found lacks the key.

    found has a row for each key, which isn't null, and in the column n how many of the `total` rows have it. The
    hot keys, at most HOT of them, are broadcast; their rows then take no part in the join by key, but are spread.
    """
    values = [c for c in found.columns if c not in (key, n)]
    part = lambda hot, tag: found.where((F.col(n) * HOT > total) == F.lit(hot)).select(F.col(key).alias(f"_{tag}"), *(F.col(c).alias(f"_{tag}_{c}") for c in values))
    out = rows.join(F.broadcast(part(True, "hot")), F.col(key) == F.col("_hot"), "left")
    out = out.withColumn("_cold_key", F.when(F.col("_hot").isNull(), F.col(key))).withColumn("_spread", F.when(F.col("_hot").isNotNull() | F.col(key).isNull(), F.monotonically_increasing_id()))
    cold = part(False, "cold").withColumn("_none", F.lit(None).cast("long"))
    out = out.join(cold, F.col("_cold_key").eqNullSafe(F.col("_cold")) & F.col("_spread").eqNullSafe(F.col("_none")), "left")
    return out.select(*rows.columns, *(F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in values))


def with_position(rows: DataFrame, order: list, out: str, name: str) -> DataFrame:
    """Materializes rows with out: the place of each, from 0, in the order of all rows by `order`, which has no ties.

    Rows are dealt by ranges of that order, placed within their range and shifted by the counts of the ranges before.
    The counts are as many as there are shuffle partitions, so they may be broadcast.
    """
    ranged = materialize(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))
    placed = ranged.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(*order))).join(F.broadcast(offsets), "_part")
    return placed.select(*rows.columns, (F.col("_before") + F.col("_rank") - 1).cast("long").alias(out))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def rank_within(df: DataFrame, keys: list[str], order: list[str], out: str, n_rows: int | None = None) -> DataFrame:
    """Adds out: a rank from 0, gapless, within equal keys. df must be materialized, and no two rows equal in `order`: rows
    that may repeat need a key of their own in it.

    No key is ranked in one task: rows are hashed into about sqrt(n) buckets by their order columns, ranked within
    (keys, bucket), and shifted by the counts of the key's buckets before it. Any one window therefore has about
    sqrt(n) rows, for a key that holds all rows too.
    """
    n = df.count() if n_rows is None else n_rows
    buckets = max(16, int(n**0.5))
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    by = [*keys, "_bucket"]
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(*(F.col(k).alias(f"_{k}_o") for k in by), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    same = None
    for k in by:
        eq = F.col(k).eqNullSafe(F.col(f"_{k}_o"))
        same = eq if same is None else same & eq
    kept = [c for c in df.columns if c != "_bucket"]
    return ranked.join(offsets, same).select(*kept, (F.col("_before") + F.col("_rank") - 1).cast("long").alias(out))
