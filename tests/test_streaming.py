import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators.sessions import sessionize
from tidewatch.schema import Settings
from tidewatch.sources.tail import TailReader, parse, tail_csv
from tidewatch.streaming.detector import Detector, Stepper, detect, detect_stream, fit_detector, log_columns, replay, running_counts, write_replay

SETTINGS = Settings(channels=("x", "y", "z"), quantile=0.9)
COLUMNS = "source string, series long, t_us long, seq long, x double, y double, z double, state int, idle int"


def rows(seed, n=260, series=2):
    rng, out = random.Random(seed), []
    for s in range(series):
        t = 0.0
        for i in range(n):
            t += 2.0 if rng.random() < 0.04 else rng.choice([0.099, 0.1, 0.102])
            lift = 6.0 if 100 < i % 150 < 112 else 0.0
            out.append(("normal", s, round(t * 1e6), i, rng.gauss(0, 1) + lift, rng.gauss(5, 1), rng.gauss(1, 0.2) + lift, 0, 0))
    return out


@pytest.fixture(scope="module")
def detector(spark):
    train = sessionize(spark.createDataFrame(rows(1), COLUMNS), SETTINGS.gap_sec)
    calibration = sessionize(spark.createDataFrame(rows(2), COLUMNS), SETTINGS.gap_sec)
    return fit_detector(train, calibration, SETTINGS)


ALARMS = ("sample_alarm", "short_alarm", "long_alarm", "or_3", "final_alarm")


def test_stream_equals_batch_and_ignores_the_future(spark, detector, tmp_path):
    data = rows(3)
    batch = detect(sessionize(spark.createDataFrame(data, COLUMNS), SETTINGS.gap_sec), detector)
    want = {(str(r["series"]), r["seq"]): r for r in batch.collect()}
    assert sum(r["final_alarm"] for r in want.values()) > 5
    early = [r for r in data if r[3] < 150]
    for r in detect(sessionize(spark.createDataFrame(early, COLUMNS), SETTINGS.gap_sec), detector).collect():
        assert all(r[a] == want[str(r["series"]), r["seq"]][a] for a in ALARMS)
    for k in range(3):  # three micro-batches, each out of order
        part = [r for r in data if r[3] * 3 // 260 == k]
        random.Random(k).shuffle(part)
        spark.createDataFrame(part, COLUMNS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken by their time
    stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = detect_stream(stream, detector).writeStream.format("memory").queryName("steps").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = spark.table("steps").collect()
    assert len(got) == len(data)
    for r in got:
        w = want[r["series"], r["seq"]]
        assert r["note"] is None and r["segment_id"] == w["segment_id"]
        assert all(r[a] == w[a] for a in ALARMS) and r["active_detectors"] == w["active_detectors"] and r["persistence_count"] == w["persistence_count"]
        for s in ("sample_score", "short_score", "long_score"):
            assert (r[s] is None) == (w[s] is None) and (r[s] is None or abs(r[s] - w[s]) < 1e-6 * max(1, abs(w[s])))


def test_subset_order_of_alarms(spark, detector):
    df = detect(sessionize(spark.createDataFrame(rows(5), COLUMNS), SETTINGS.gap_sec), detector)
    assert df.where("final_alarm and not or_3").count() == 0
    assert Detector.from_json(detector.to_json()) == detector


def test_late_and_invalid_rows_are_marked(detector):
    s = Stepper(detector)
    assert s.step(1_000_000, [0.0, 5.0, 1.0])["note"] is None
    assert s.step(900_000, [0.0, 5.0, 1.0])["note"] == "late"
    assert s.step(1_100_000, [float("nan"), 5.0, 1.0])["note"] == "invalid"
    out = s.step(1_600_001, [0.0, 5.0, 1.0])
    assert out["segment_reset"] and out["segment_id"] == 1
    s.reset()
    assert s.step(5, [0.0, 5.0, 1.0])["segment_id"] == 0
    with pytest.raises(ValueError, match="late or have unknown"):
        Stepper(detector, s.memory, strict=True).step(4, [0.0, 5.0, 1.0])


def test_many_rows_at_once_are_as_one_by_one(detector):
    data = [r for r in rows(11, 150, 1)]
    times, values = np.array([r[2] for r in data]), np.array([r[4:7] for r in data])
    values[40, 1] = np.nan
    one, want = Stepper(detector), []
    for t, v in zip(times, values, strict=True):
        want.append(one.step(int(t), v.tolist()))
    for cuts in ([], [1, 2, 50], list(range(7, 150, 7))):
        stepper, got = Stepper(detector), []
        for part in np.split(np.arange(len(times)), cuts):
            found = stepper.many(times[part], values[part])
            got += [{k: v[i] for k, v in found.items()} for i in range(len(part))]
        for g, w in zip(got, want, strict=True):
            assert all(g[k] == w[k] for k in w if not k.endswith("score")), (g, w)
            assert all(g[k] is None and w[k] is None or abs(g[k] - w[k]) < 1e-6 * max(1, abs(w[k])) for k in w if k.endswith("score"))


def test_a_stream_of_a_forest_with_kinds_resets_and_a_log(spark, tmp_path):
    train = sessionize(spark.createDataFrame(rows(1), COLUMNS), SETTINGS.gap_sec)
    d = Detector.from_json(fit_detector(train, train, SETTINGS, "forest").to_json())
    with pytest.raises(ValueError):
        Detector.from_json(d.to_json().replace('"short"', '"other"'))
    samples = spark.createDataFrame([(*r[:7], int(r[3] % 90 > 80), int(r[3] % 50 == 0)) for r in rows(4, 120)], COLUMNS)
    want = {(str(r["series"]), r["seq"]): r for r in detect(sessionize(samples, SETTINGS.gap_sec), d).collect()}
    write_replay(samples, str(tmp_path / "in"), 4.0)
    stream = replay(samples, str(tmp_path / "in"))
    steps = detect_stream(stream.withColumn("reset", F.lit(False)), d)
    q = steps.writeStream.format("memory").queryName("forest_steps").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = spark.table("forest_steps").collect()
    assert len(got) == len(want) and q.lastProgress is not None
    notes = [r for r in got if r["note"]]
    # files of one folder may be taken in another order than that of time: then rows are late, and marked
    if not notes:
        for r in got:
            w = want[r["series"], r["seq"]]
            assert r["final_alarm"] == w["final_alarm"] and r["ground_truth"] == w["state"] and r["kind"] == ("idle" if w["idle"] else "normal")
    log = log_columns(spark.table("forest_steps"), samples, d)
    assert len(log.columns) == 30 and log.count() == len(got)
    counts = {r["kind"]: r["rows"] for r in running_counts(spark.table("forest_steps")).collect()}
    assert sum(counts.values()) == len(got) and counts["idle"] == 6
    again = spark.createDataFrame([("a", 0, 10, 0, 1.0, 2.0, 3.0, True), ("a", 0, 20, 1, 1.0, 2.0, 3.0, True)], "source string, series long, t_us long, seq long, x double, y double, z double, reset boolean")
    again.write.parquet(str(tmp_path / "again"))
    s2 = detect_stream(spark.readStream.schema(again.schema).parquet(str(tmp_path / "again")), d)
    q = s2.writeStream.format("memory").queryName("resets").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert [(r["gap_sec"], r["ground_truth"], r["kind"]) for r in spark.table("resets").collect()] == [(None, None, "normal")] * 2


def test_a_growing_csv_is_followed(spark, tmp_path):
    path = tmp_path / "tail.csv"
    head = "TimeStamp,AI0_Vibration,AI1_Vibration,AI2_Current\n"
    path.write_bytes("﻿".encode() + head.encode() + b"a,1,2,3\nb,1,2\nc,4,5,6\nd,7,")
    q = tail_csv(spark, str(path)).writeStream.format("memory").queryName("tail").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        assert [(r["TimeStamp"], r["skipped"]) for r in spark.table("tail").orderBy("TimeStamp").collect()] == [("a", 0), ("c", 1)]
        with path.open("ab") as f:
            f.write(b"8,9\ne,1,1,1\n")
        time.sleep(1)
        q.processAllAvailable()
        got = spark.table("tail").orderBy("TimeStamp").collect()
        assert [r["TimeStamp"] for r in got] == ["a", "c", "d", "e"] and not got[0]["has_truth"]
        path.write_text(head + "z,0,0,0\n")
        time.sleep(1)
        q.processAllAvailable()
        assert {r["TimeStamp"] for r in spark.table("tail").collect()} == {"a", "c", "d", "e", "z"}
    finally:
        q.stop()
    odd = parse(["TimeStamp", "AI0_Vibration", "Equipment_state", "Idle"], ["x,inf,inf,nan", "y,1e400,1e300,1", "z,\u20281,0,\u2028"])
    assert [r[1] for r in odd] == [None, None, 1.0] and [r[4:6] for r in odd] == [(0, 0), (0, 1), (0, 0)]
    long = tmp_path / "long.csv"
    long.write_text(head + "a," + "1" * (3 << 20) + ",2,3\nb,1,2,3\n")
    lines, end = TailReader(str(long))._lines(len(head), None)
    assert len(lines[0]) > 3 << 20 and end > 3 << 20 and [*lines[1:], *TailReader(str(long))._lines(end, None)[0]] == ["b,1,2,3"]
    assert parse(["TimeStamp", "Idle"], ["x,1", "y"]) == [("x", None, None, None, 0, 1, False, 0)]


def test_forest_detector(spark):
    train = sessionize(spark.createDataFrame(rows(1), COLUMNS), SETTINGS.gap_sec)
    d = fit_detector(train, train, SETTINGS, "forest")
    out = detect(train, d)
    assert out.where("final_alarm").count() > 0 and out.agg(F.max("sample_score")).first()[0] <= 1.0


def test_streaming_cross_validation(spark):
    from tidewatch.operators import splits
    from tidewatch.operators.thresholds import monotone
    from tidewatch.plans.protocol import comparison_table, fold_alarms, fold_scores, fold_thresholds, streaming_cv

    data = rows(7, 300, 1)
    fault = [("fault", s, t, q, x + 8, y, z + 8, 1, 0) for _, s, t, q, x, y, z, _, _ in rows(8, 120, 1)]
    df = sessionize(spark.createDataFrame(data + fault, COLUMNS), SETTINGS.gap_sec).persist()
    scores = fold_scores(df, 3, 1, SETTINGS, fold_map=splits.fold_map).persist()
    limits = fold_thresholds(scores, SETTINGS, (0.8, 0.9, 0.99))
    for n in ("sample", "short", "long"):
        assert monotone(limits.select("test_fold", "quantile", F.col(f"{n}_threshold").alias("threshold")), ["test_fold"]).count() == 0
    found = fold_alarms(scores, limits, SETTINGS)
    assert found.where("quantile = 0.9").count() == df.count()
    assert found.where("final_alarm and not or_3").count() == 0
    result = streaming_cv(df, SETTINGS, k=3, repeats=1, quantiles=(0.9,), variants=("final_alarm", "or_3"), fold_map=splits.fold_map)
    out = result.collect()
    by = {r["variant"]: r for r in out}
    assert by["or_3"]["event_detection_rate"] >= by["final_alarm"]["event_detection_rate"] > 0
    text = comparison_table(spark.createDataFrame(out, result.schema)).first()
    assert text["sample_f1_std"] is None and "±" not in text["sample_f1_text"]
    forest = streaming_cv(df, SETTINGS, k=3, repeats=2, quantiles=(0.9, 0.95), variants=("or_3",), kind="forest")
    assert {(r["repeat"], r["quantile"], r["sample_f1"] > 0) for r in forest.collect()} == {(r, q, True) for r in (0, 1) for q in (0.9, 0.95)}


def test_window_runs(spark):
    from tidewatch.operators import sessions, splits, windows
    from tidewatch.plans.protocol import window_cv, window_run
    from tidewatch.schema import feature_names

    fault = [("fault", s, t, q, x + 8, y, z + 8, 1, 0) for _, s, t, q, x, y, z, _, _ in rows(8, 150, 1)]
    df = sessionize(spark.createDataFrame(rows(7, 300, 2) + fault, COLUMNS), SETTINGS.gap_sec)
    manifest = splits.assign_splits(sessions.segment_manifest(df), 0.0)
    w = windows.time_windows(df, SETTINGS).join(manifest.select("group_id", "split"), "group_id").persist()
    names = feature_names(SETTINGS.channels)
    for mode, kind in (("f1", "ledoit_wolf"), ("quantile", "forest")):
        run = window_run(w, names, kind, mode, 0.9, 2)
        assert run["windows"].where("alarm_k_consecutive and not alarm_immediate").count() == 0
        assert run["event_metrics"].first()["n_events"] >= 0 and run["window_metrics"].first()["tp"] >= 0 and run["audit"].first()["rows"] > 0
    folds = splits.ranked_fold_map(df, 3)
    kinds = df.select("group_id", "kind").distinct()
    r = window_cv(w.join(kinds, "group_id"), names, folds, 3, 0.1, quantile=0.9).first()
    assert r["n_events"] >= 0 and 0 <= r["fa_cycle_rate"] <= 1


def test_cross_validation_of_scales_samples_and_ensembles(spark):
    from tidewatch.operators import splits, windows
    from tidewatch.plans.protocol import ensemble_cv, multi_scale_cv, replay_errors, sample_alarms, sample_cv
    from tidewatch.schema import feature_names

    fault = [("fault", s, t, q, x + 8, y, z + 8, 1, 0) for _, s, t, q, x, y, z, _, _ in rows(8, 150, 1)]
    df = sessionize(spark.createDataFrame(rows(7, 300, 1) + fault, COLUMNS), SETTINGS.gap_sec).persist()
    folds = splits.hashed_fold_map(df, 3, 1).persist()
    names, kinds = feature_names(SETTINGS.channels), df.select("group_id", "kind").distinct()
    half = Settings(channels=SETTINGS.channels, window_sec=0.5, quantile=0.9)
    long, short = (windows.time_windows(df, s).join(kinds, "group_id").persist() for s in (SETTINGS, half))
    found = {r["system"]: r for r in multi_scale_cv({"1.0": (long, 1.0, 0.1), "0.5": (short, 0.5, 0.1)}, names, folds, 3, quantile=0.9).collect()}
    assert set(found) == {"1.0", "0.5", "multi"} and all(0 <= r["pooled_f1"] <= 1 and r["n_events"] > 0 for r in found.values())
    assert found["multi"]["n_events"] >= found["1.0"]["n_events"]
    one = sample_cv(df, SETTINGS, folds, 3, 0.1, quantile=0.9).first()
    events = df.where("kind = 'fault'").select("group_id").distinct().count()
    assert one["n_events"] == events and one["event_detection_rate"] > 0.3 and one["exposure_sec"] > 0
    assert sample_alarms(df, SETTINGS, folds, 3, quantile=0.9).count() == df.count()
    combos = {r["combination"]: r for r in ensemble_cv(df, long, short, names, SETTINGS, folds, 3, quantile=0.9).collect()}
    assert len(combos) == 9 and combos["or_3"]["detected_events"] >= combos["or_3_p2"]["detected_events"] >= combos["or_3_p3"]["detected_events"]
    missed, context = replay_errors(df.withColumn("or_3_p2", F.col("x") > 3), long)
    assert missed.count() == events and context.where("fp_context").count() >= 0
