"""Sharding by longest-processing-time scheduling.

Documents of equal text stay together. Groups sorted by size, largest first, go to the least-loaded shard of a heap.
A heap over every group would put the corpus on the driver, so the groups are handled at two grains:

* Groups of more than 1 / (shards * HEAVY_PER_SHARD) of all bytes (at most shards * HEAVY_PER_SHARD of them) are
  scheduled one by one.
* Lighter groups are counted in size classes 1/128 octave wide (at most a few thousand classes, whatever the input).
  A class is dealt as count equal jobs of its mean size, many at a time, just as a heap would deal them one at a time;
  the groups of a class then take the shards by their rank in it. A shard's load so differs from the exact schedule by
  less than one heavy group.

Nulls: a null text has no bytes, so size 1 and CRC 0; all null texts are one group, apart from the empty text's.
A null doc_id is kept. Repeated rows are separate documents of one group, each with a slot.
Groups of equal size are taken in the order of their digest, equally loaded shards in the order of their number. An empty table gives no
rows. Other columns of the input are ignored. Texts of any length are handled whole and only as digests.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import look_up, materialize, rank_within

HEAVY_PER_SHARD = 2048
CLASSES_PER_OCTAVE = 128


def deal(heavy: list[tuple[object, int]], classes: list[tuple[int, int, int]], shards: int) -> tuple[list[tuple[object, int]], list[tuple[int, int, int, int]], list[float]]:
    """Schedules heavy groups (key, bytes) and classes (class, count, bytes), largest first.

    Returns (key, shard) pairs, runs (class, first rank, end rank, shard) and the loads.
    """
    jobs = [(size, 1, 0, key) for key, size in heavy] + [(size / count, count, 1, c) for c, count, size in classes if count]
    jobs.sort(key=lambda j: (-j[0], j[2], str(j[3])))
    loads = [(0.0, s) for s in range(shards)]
    single, runs = [], []
    for size, count, kind, key in jobs:
        if not kind:
            load, s = heapq.heappop(loads)
            heapq.heappush(loads, (load + size, s))
            single.append((key, s))
            continue
        given = [0] * shards
        while count:
            loads.sort()
            low = sum(1 for load, _ in loads if load <= loads[0][0] + size)
            rounds = count // low
            if low < shards:
                rounds = min(rounds, int((loads[low][0] - loads[low - 1][0]) // size))
            take, rounds = (low, rounds) if rounds else (1, 1)
            for i in range(take):
                load, s = loads[i]
                loads[i] = (load + rounds * size, s)
                given[s] += rounds
            count -= take * rounds
        heapq.heapify(loads)
        first = 0
        for s, k in enumerate(given):
            if k:
                runs.append((key, first, first + k, s))
                first += k
    out = [0.0] * shards
    for load, s in loads:
        out[s] = load
    return single, runs, out


def shard_documents(docs: DataFrame, shards: int = 8, heavy_per_shard: int = HEAVY_PER_SHARD) -> DataFrame:
    """doc_id, size, text_crc32, group (SHA-256 of the text, null for a null text), shard, slot for each row of docs."""
    spark = docs.sparkSession
    rows = materialize(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.unhex(F.sha2(F.col("text"), 256)).alias("group"),
        ),
        "shard-rows",
    )
    groups = materialize(rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "shard-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    limit = max(1, total // (shards * heavy_per_shard))
    groups = groups.withColumn("class", F.floor(F.log2("bytes") * CLASSES_PER_OCTAVE).cast("int"))
    is_heavy = F.col("bytes") > limit
    heavy = [(r["group"] if r["group"] is None else bytes(r["group"]), r["bytes"]) for r in groups.where(is_heavy).select("group", "bytes").collect()]
    light = groups.where(~is_heavy)
    classes = [tuple(r) for r in light.groupBy("class").agg(F.count(F.lit(1)), F.sum("bytes")).collect()]
    single, runs, _ = deal(heavy, classes, shards)
    heavy_df = spark.createDataFrame(single, "_group binary, _shard int")
    runs_df = spark.createDataFrame(runs, "_class int, _first long, _end long, _shard int")
    # both bounded above: shards * heavy_per_shard rows, and at most shards runs for each class
    ranked = rank_within(light, ["class"], ["group"], "rank")
    placed = ranked.join(F.broadcast(runs_df), (F.col("class") == F.col("_class")) & (F.col("rank") >= F.col("_first")) & (F.col("rank") < F.col("_end"))).select(F.col("group").alias("_group"), "_shard")
    placed = placed.unionByName(heavy_df)
    # a key for the join that is never null; a text's digest has 32 bytes, so the empty one is free for nulls
    key = lambda c: F.coalesce(c, F.lit(b""))
    known = groups.select(key(F.col("group")).alias("_key"), "n").join(placed.select(key(F.col("_group")).alias("_key"), "_shard"), "_key")
    known = materialize(known, "shard-of-group")
    out = look_up(rows.withColumn("_key", key(F.col("group"))), known, "_key", "n", rows.count())
    out = materialize(out.select("doc_id", "size", "text_crc32", "group", F.col("_shard").alias("shard"), F.monotonically_increasing_id().alias("_row")), "shard-placed")
    return rank_within(out, ["shard"], ["doc_id", "group", "_row"], "slot").drop("_row")
