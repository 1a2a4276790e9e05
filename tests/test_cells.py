"""Segments cut into cells against whole segments."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import alarms, cells, metrics, windows


def samples(spark, seed=1, n=900):
    rng = random.Random(seed)
    rows = []
    for g, count in (("a", n), ("b", 1), ("c", 40), ("d", n // 2), ("e", 3)):
        t = 0
        for i in range(count):
            t += rng.choice([0, 0, 1, 20_000, 100_000, 100_000, 150_000, 400_000])
            rows.append((g, t, i, rng.random(), rng.random() < 0.7, "normal", "normal"))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "group_id string, t_us long, seq long, value double, alarm boolean, kind string, source string")


@pytest.mark.parametrize(("size", "minimum", "width", "step"), [(64, 3, 1.0, 0.1), (5, 4, 0.5, 0.2), (64, 2, 0.3, 1.5), (100_000, 6, 1.0, 0.3), (1, 3, 1.0, 0.1)])
def test_window_starts_equal_those_of_whole_segments(spark, size, minimum, width, step):
    rows = samples(spark)
    got = Counter(tuple(r) for r in cells.window_starts_in_cells(rows, width, step, minimum, size).collect())
    want = Counter(tuple(r) for r in windows.window_starts(rows, width, step, minimum).collect())
    assert got == want and len(want) > 50


def test_window_starts_of_nothing(spark):
    assert cells.window_starts_in_cells(samples(spark).where("false"), 1.0, 0.1, 3).collect() == []


@pytest.mark.parametrize("size", [7, 50, 100_000])
def test_frames_equal_those_of_whole_segments(spark, size):
    rows = samples(spark)
    place = cells.numbered(rows)
    assert sorted(r["place"] for r in place.select("place").collect()) == list(range(rows.count()))

    def features(r):
        return r.withColumns({"p3": alarms.persistent(F.col("alarm"), 3), "t4": alarms.tolerant(F.col("alarm"), 4), "up": alarms.rising(F.col("alarm")), "mean": F.round(alarms.smoothed(F.col("value"), 5), 9), "top": alarms.smoothed(F.col("value"), 5, "max"), "full": windows.full_windows(6)})

    got = Counter(tuple(r) for r in cells.over_cells(place, 5, features, size).drop("place").collect())
    assert got == Counter(tuple(r) for r in features(rows).collect())
    with pytest.raises(ValueError):
        cells.over_cells(place, 9, features, 8)


def three_row_windows(rows):
    frame = windows.in_segment().rowsBetween(-2, 0)
    out = rows.withColumns({"start_us": F.first("t_us").over(frame), "end_us": F.col("t_us"), "score": F.avg("value").over(frame), "n": F.count(F.lit(1)).over(frame), "onset_us": F.lit(None).cast("long")})
    return out.where("n = 3").select("source", "group_id", "kind", "seq", "start_us", "end_us", "score", "alarm", "onset_us").dropDuplicates(["group_id", "start_us", "end_us"])


@pytest.mark.parametrize("size", [6, 40, 100_000])
@pytest.mark.parametrize("k", [1, 2, 5])
def test_consecutive_windows(spark, size, k):
    w = three_row_windows(samples(spark, 2))
    w = w.dropDuplicates(["group_id", "start_us"]).dropDuplicates(["group_id", "end_us"]).persist()
    got = Counter(tuple(r) for r in cells.k_consecutive_in_cells(w, F.lit(0.45), k, size=size).select("group_id", "seq", "alarm_k").collect())
    assert got == Counter(tuple(r) for r in alarms.k_consecutive(w, F.lit(0.45), k).select("group_id", "seq", "alarm_k").collect())
    w.unpersist()


@pytest.mark.parametrize("size", [6, 100_000])
def test_exposure_and_intervals(spark, size):
    rows = samples(spark, 3)
    w = three_row_windows(rows).persist()
    got, want = cells.window_false_alarms_in_cells(w, "alarm", 0.2, size).first(), metrics.window_false_alarms(w, "alarm", 0.2).first()
    assert tuple(got)[0::2] == tuple(want)[0::2] and abs(got["exposure_sec"] - want["exposure_sec"]) < 1e-6 and got["n_fa_groups"] == want["n_fa_groups"]
    a = Counter(tuple(r) for r in cells.alarms_to_rows_in_cells(rows, w, "alarm", "hit", size).collect())
    assert a == Counter(tuple(r) for r in alarms.alarms_to_rows(rows, w, "alarm", "hit").collect())
    w.unpersist()
