import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import scalar
from tidewatch.operators import alarms, analysis, metrics, sessions, splits, thresholds, windows
from tidewatch.operators.models import PRIME, Forest, Gaussian, _grow, fit_forest, fit_gaussian, shrink, tree_keys, tree_samples
from tidewatch.schema import Roles, Settings, infer_features, require
from tidewatch.sources.samples import SENSOR_ROLES, assert_finite, drop_unknown, line_count, provenance, quality_counts, read_external, read_optional, read_scale, read_sensor_csv, read_sources, to_samples
from tidewatch.sources.sinks import digest_line, pick, read_settings, report, run_once, write_csv, write_table

ROWS = "source string, series long, t_us long, seq long, x double, y double, z double, state int, idle int"


def samples(spark, times, source="normal", series=0, **columns):
    n = len(times)
    get = lambda c, d: columns.get(c, [d] * n)
    rows = [(source, series, round(t * 1e6), i, *(float(v[i]) for v in (get("x", 1.0), get("y", 2.0), get("z", 3.0))), get("state", 0)[i], get("idle", 0)[i]) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, ROWS)


def ordered(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("source", "series", "t_us", "seq").collect()]


def test_a_gap_at_the_threshold_does_not_split(spark):
    df = sessions.sessionize(samples(spark, [0, 0.5, 1.001, 1.1]), 0.5)
    assert [r[0] for r in ordered(df, "segment_id")] == [0, 0, 1, 1]
    m = {r["segment_id"]: r for r in sessions.segment_manifest(df).collect()}
    assert m[0]["max_gap_sec"] == 0.5 and m[1]["rows"] == 2 and abs(m[1]["duration_sec"] - 0.099) < 1e-9


def test_half_idle_is_idle(spark):
    df = sessions.sessionize(samples(spark, [0, 0.1, 0.2, 0.3], idle=[1, 1, 0, 0]), 0.5)
    assert {r["kind"] for r in df.collect()} == {"idle"}
    assert {r["kind"] for r in sessions.sessionize(samples(spark, [0, 0.1, 0.2], idle=[1, 0, 0]), 0.5).collect()} == {"normal"}
    q = sessions.segment_quality(df, 0.5).first()
    assert (q["segments"], q["idle_rows"], q["idle_segments"]) == (1, 2, 1)


def plain_starts(times, width, step, least):
    """The starts of one segment, with the whole array at hand."""
    t, out, i = np.round(np.array(times) * 1e6).astype(np.int64), [], 0
    w, h = round(width * 1e6), round(step * 1e6)
    while i < len(t) and t[i] + w <= t[-1]:
        if np.searchsorted(t, t[i] + w) - i < least:
            i += 1
            continue
        out.append(int(t[i]))
        i = int(np.searchsorted(t, t[i] + h))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_window_starts_with_jitter(spark, seed):
    rng = random.Random(seed)
    times = np.cumsum([rng.choice([0.099, 0.1, 0.102, 0.3, 0.0]) for _ in range(120)]).tolist()
    df = sessions.sessionize(samples(spark, times), 0.5)
    got = sorted(r["start_us"] for r in windows.window_starts(df, 1.0, 0.1, 8).collect())
    assert got == plain_starts(times, 1.0, 0.1, 8)


def test_time_window_features_equal_numpy(spark):
    rng = np.random.default_rng(0)
    times = np.cumsum(rng.choice([0.09, 0.1, 0.12], 60))
    x, y, z = rng.normal(size=60), rng.normal(size=60), np.full(60, 4.0)
    s = Settings(channels=("x", "y", "z"))
    df = sessions.sessionize(samples(spark, times, x=x, y=y, z=z), 0.5)
    got = {r["start_us"]: r for r in windows.time_windows(df, s).collect()}
    t = np.round(times * 1e6).astype(np.int64)
    assert len(got) > 20
    for start, r in got.items():
        own = (t >= start) & (t < start + 1_000_000)
        sec = (t[own] - start) / 1e6
        assert r["sample_count"] == own.sum()
        for name, v in (("x", x), ("y", y), ("z", z)):
            v = v[own]
            want = (v.mean(), v.std(ddof=1), np.sqrt((v * v).mean()), np.ptp(v), np.polyfit(sec, v, 1)[0])
            assert np.allclose([r[f"{name}_{k}"] for k in ("mean", "std", "rms", "ptp", "slope")], want, atol=1e-8)
        assert abs(r["x_y_corr"] - np.corrcoef(x[own], y[own])[0, 1]) < 1e-9


def test_count_windows_of_a_constant_channel_and_short_segments(spark):
    df = sessions.sessionize(samples(spark, [0, 0.1, 0.2, 2, 2.1], x=[1, 1, 1, 5, 6]), 0.5)
    out = ordered(windows.count_windows(df, 3, ("x", "y", "z")), "x_mean", "x_std", "x_y_corr", "window_start_us")
    assert out[2] == (1.0, 0.0, 0.0, 0) and [r[0] for r in out] == [None, None, 1.0, None, None]
    diffs = ordered(windows.sample_features(df, ("x",), True), "x_diff", "x_roll3")
    assert diffs[0] == (0.0, 0.0) and diffs[4] == (1.0, pytest.approx(math.sqrt(0.5)))


def alarm_rows(spark, pattern):
    df = sessions.sessionize(samples(spark, [i * 0.1 for i in range(len(pattern))]), 0.5)
    return df.withColumn("a", F.element_at(F.lit(None).cast("array<boolean>"), 1)).withColumn("a", F.array(*(F.lit(bool(p)) for p in pattern))[F.col("seq").cast("int")])


def test_persistence_tolerance_and_episodes(spark):
    df = alarm_rows(spark, [1, 0, 1, 1, 0, 1, 1, 1])
    out = df.withColumns({"p2": alarms.persistent(F.col("a"), 2), "p3": alarms.persistent(F.col("a"), 3), "t3": alarms.tolerant(F.col("a"), 3)})
    p2, p3, t3 = zip(*ordered(out, "p2", "p3", "t3"), strict=True)
    assert list(map(int, p2)) == [0, 0, 0, 1, 0, 0, 1, 1]
    assert list(map(int, p3)) == [0, 0, 0, 0, 0, 0, 0, 1]
    assert list(map(int, t3)) == [1, 1, 1, 1, 1, 1, 1, 1]
    assert metrics.episodes_of(df, "a").first()["episodes"] == 3


def runs_by_definition(starts, high, k):
    """A window alarms if it ends k windows in a row that are high, each a usual step after the one before."""
    steps = [b - a for a, b in zip(starts, starts[1:], strict=False)]
    usual = np.median([x for x in steps if x > 0])
    usual_step = [abs(x - usual) <= max(1e-6, usual / 50) for x in steps]
    return [i >= k - 1 and all(high[i - k + 1 : i + 1]) and all(usual_step[i - k + 1 : i]) for i in range(len(starts))]


@pytest.mark.parametrize("seed", range(3))
def test_k_consecutive_windows(spark, seed):
    rng = random.Random(seed)
    starts = np.cumsum([rng.choice([0.1, 0.1, 0.1, 0.3]) for _ in range(60)])
    high = [rng.random() < 0.7 for _ in starts]
    df = spark.createDataFrame([("g", round(s * 1e6), round(s * 1e6) + 10**6, float(h)) for s, h in zip(starts, high, strict=True)], "group_id string, start_us long, end_us long, score double")
    for k in (1, 2, 3):
        got = [r["alarm_k"] for r in alarms.k_consecutive(df, F.lit(0.5), k).orderBy("start_us").collect()]
        assert got == runs_by_definition((np.round(starts * 1e6) / 1e6).tolist(), high, k)


def test_exposure_is_a_union_and_fault_zone_is_left_out(spark):
    rows = [("normal", "a", 0, 10, None, True), ("normal", "a", 1, 11, None, True), ("normal", "a", 5, 15, None, True), ("normal", "a", 30, 40, None, False), ("fault", "b", 0, 10, 5, True)]
    df = spark.createDataFrame([(s, g, a * 10**6, b * 10**6, o and o * 10**6, x) for s, g, a, b, o, x in rows], "source string, group_id string, start_us long, end_us long, onset_us long, alarm boolean")
    r = metrics.window_false_alarms(df, "alarm", 1.0).first()
    assert (r["n_episodes"], r["exposure_sec"], r["n_groups"], r["n_fa_groups"]) == (2, 25.0, 1, 1)
    e = metrics.window_events(df, "alarm").first()
    assert e["detected"] and e["delay_sec"] == 5.0 and e["note"] == "detected"


def test_f1_threshold_by_trying_all(spark):
    rng = random.Random(1)
    for _ in range(3):
        data = [(round(rng.random(), 1), int(rng.random() < 0.4)) for _ in range(60)]
        best = None
        for t in sorted({s for s, _ in data}):
            tp = sum(y for s, y in data if s >= t)
            called, pos = sum(s >= t for s, _ in data), sum(y for _, y in data)
            key = (round(2 * tp / (called + pos), 12), round(tp / called, 12), -t)
            best = max(best, key) if best else key
        got = thresholds.best_f1(spark.createDataFrame(data, "score double, label int")).first()
        assert got["threshold"] == -best[2] and abs(got["f1"] - best[0]) < 1e-9


def ledoit_wolf(x):
    """The estimator by its definition: mean distance of single outer products from the covariance."""
    x = x - x.mean(0)
    n, p = x.shape
    s = x.T @ x / n
    m = np.trace(s) / p
    d2 = ((s - m * np.eye(p)) ** 2).sum() / p
    b2 = min(sum(((np.outer(r, r) - s) ** 2).sum() / p for r in x) / n**2, d2)
    return (1 - b2 / d2) * s + b2 / d2 * m * np.eye(p)


def test_covariance_and_distance_equal_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3)) @ np.array([[3.0, 1, 0], [0, 2, 1], [0, 0, 0.5]])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x] + [(None, 1.0, 2.0)], "a double, b double, c double")
    model = fit_gaussian(df, ["a", "b", "c"])
    filled = np.vstack([x, [np.median(x[:, 0]), 1.0, 2.0]])
    logged = np.sign(filled) * np.log1p(np.abs(filled))
    assert np.allclose(np.linalg.inv(np.array(model.precision)), ledoit_wolf(logged), rtol=1e-6)
    d = logged - logged.mean(0)
    want = np.einsum("ij,jk,ik->i", d, np.linalg.inv(ledoit_wolf(logged)), d)
    got = df.select(model.score().alias("s")).toPandas()["s"].to_numpy()
    assert np.allclose(got, want, rtol=1e-6)
    assert np.allclose(model.numpy_score(np.vstack([x, [np.nan, 1.0, 2.0]])), want, rtol=1e-6)
    assert Gaussian.from_json(model.to_json()) == model
    for kind in ("empirical", "oas"):
        assert 0 <= fit_gaussian(df, ["a", "b", "c"], kind).shrinkage <= 1
    assert shrink(np.eye(2), 10, 5.0, "oas")[1] <= 1.0
    with pytest.raises(ValueError):
        shrink(np.eye(2), 10, 5.0, "none")


def test_forest_ranks_outliers_high(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(500, 2)), [[9.0, 9.0], [-9.0, 8.0]]])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double")
    model = fit_forest(df, ["a", "b"], 60)
    s = df.select(model.score().alias("s")).toPandas()["s"].to_numpy()
    assert ((s > 0) & (s <= 1)).all() and set(np.argsort(s)[-2:]) == {500, 501}
    assert isinstance(model, Forest) and len(model.trees) == 60


def test_forest_samples_are_the_smallest_hashes_of_each_tree(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 2))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double")
    found = tree_samples(df.repartition(7), ["a", "b"], ["id"], 5, 32, 9).toPandas()
    numbers = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) % PRIME for i in range(3000)}
    for tree, (a, b) in enumerate(tree_keys(5, 9)):
        want = sorted((a * n + b) % PRIME for n in numbers.values())[:32]
        assert sorted(found[found["tree"] == tree]["hash"])[:32] == want
    a, b = (fit_forest(df.repartition(p), ["a", "b"], 9, key=["id"]) for p in (1, 6))
    assert a.to_json() == b.to_json()
    for own in (tree_keys(5, 9),):
        sample = sorted(range(3000), key=lambda i: (own[0][0] * numbers[i] + own[0][1]) % PRIME)[:32]
        grown = _grow(np.sign(x[sample]) * np.log1p(np.abs(x[sample])), 5, np.random.default_rng([9, 0, 0]))
        tree = fit_forest(df, ["a", "b"], 5, 32, 9, ["id"]).trees[0]
        assert all(np.array_equal(grown[c], tree[c]) for c in grown)


def test_splits(spark):
    df = sessions.sessionize(samples(spark, [i * 2.0 for i in range(40)], state=[0] * 40), 0.5).unionByName(sessions.sessionize(samples(spark, [i * 2.0 for i in range(9)], "fault", state=[1] * 9), 0.5))
    folds = {r["group_id"]: r["fold"] for r in splits.fold_map(df, 4, 7).collect()}
    rng = np.random.default_rng(7)
    want = {}
    for prefix, n in (("fault", 9), ("normal", 40)):
        ids = np.array(sorted(f"{prefix}_0_{i}" for i in range(n)))
        rng.shuffle(ids)
        want |= {g: i % 4 for i, g in enumerate(ids.tolist())}
    assert folds == want
    roles = splits.fold_roles(df, splits.ranked_fold_map(df, 4), 4)
    assert roles.where("role = 'train' and kind <> 'normal'").count() == 0
    assert roles.groupBy("group_id").agg(F.sum((F.col("role") == "test").cast("int")).alias("n")).where("n <> 1").count() == 0
    m = splits.assign_splits(sessions.segment_manifest(df), 0.0)
    counts = {(r["label"], r["split"]): r["count"] for r in m.groupBy("label", "split").count().collect()}
    assert counts == {(0, "train"): 24, (0, "val"): 8, (0, "test"): 8, (1, "train"): 5, (1, "val"): 2, (1, "test"): 2}
    assert splits.split_sizes(3, 0.6, 0.2) == (1, 1) and splits.split_sizes(2, 0.6, 0.2) == (1, 0)
    assert splits.calibration_groups(df.where("source = 'normal'"), 0.2, 0).count() == 8
    assert splits.leaking_groups(m).count() == 0
    assert splits.subsample(df, 0.5, 1).count() == round(49 * 0.5)


def test_delays_with_a_tie(spark):
    df = sessions.sessionize(samples(spark, [i * 0.1 for i in range(12)], "fault", state=[1] * 12), 0.5)
    at = lambda k: F.col("seq") >= k
    df = df.withColumns({"sample_alarm": at(3), "short_alarm": at(3), "long_alarm": at(9), "or_3": at(3), "final_alarm": at(4), "sample_score": F.lit(2.0), "short_score": F.lit(1.0), "long_score": F.lit(1.0)})
    r = analysis.delay_decomposition(df, {"sample": F.lit(4.0), "win05": F.lit(2.0), "win1": F.lit(1.0)}).first()
    assert r["leading"] == "sample+win05" and r["delay_sec"] == pytest.approx(0.4) and r["max_ratio_event_sample"] == 0.5
    missed = df.withColumns({c: F.lit(False) for c in ("sample_alarm", "short_alarm", "long_alarm", "or_3", "final_alarm")})
    r = analysis.delay_decomposition(missed, {k: F.lit(1.0) for k in ("sample", "win05", "win1")}).first()
    assert r["leading"] == "none" and r["delay_sec"] is None and not r["detected"]
    assert analysis.earliest_alarm(2) == 0.3


def test_scalars(spark):
    df = spark.createDataFrame([(float("nan"), 1.0), (float("inf"), 0.0), (2.0, 4.0), (None, None)], "a double, b double")
    assert [r[0] for r in df.select(scalar.finite(F.col("a"))).collect()] == [None, None, 2.0, None]
    assert [r[0] for r in df.select(scalar.ratio(F.lit(1), F.col("b"))).collect()] == [1.0, None, 0.25, None]
    assert [r[0] for r in df.select(scalar.score_ratio(F.col("a"), F.col("b"))).collect()] == [None, None, 0.5, None]
    one = spark.range(1)
    get = lambda c: one.select(c.alias("c")).first()[0]
    assert [get(scalar.duration_bin(F.lit(x))) for x in (0.4, 0.5, 1.0)] == ["<0.5s", "0.5-<1.0s", ">=1.0s"]
    assert [get(scalar.direction(F.lit(x))) for x in (1.0, -1.0, 0.0)] == ["↑", "↓", "≈"]
    told = {"fold 3/12 done": 0.25, "42.5% of 7/9": 0.425, "nothing": None, "250% in 1/4": 0.25, "on 2024/11/28": None, "1/2 then 3 / 4": 0.75, "[2/10]": 0.2, "5/3": None, "1/1": None, "45 %|###": 0.45, "1250%": None, "a/b 10:20/30": None, "100%": 1.0}
    lines = spark.createDataFrame([(k,) for k in told], "line string")
    assert {r["line"]: r["p"] for r in lines.select("line", scalar.log_progress(F.col("line")).alias("p")).collect()} == told
    assert get(scalar.mean_std_text(F.lit(1.5), F.lit(0.25))) == "1.50 ± 0.25" and get(scalar.mean_std_text(F.lit(1.5), F.lit(None).cast("double"))) == "1.50"
    assert get(scalar.short_feature_name(F.lit("AI0_Vibration_mean"))) == "AI0 mean"
    assert get(scalar.stream_kind(F.lit("external"), F.lit(1), F.lit(0))) == "fault"


def test_sources_and_sinks(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text("﻿TimeStamp,AI0_Vibration,AI1_Vibration,AI2_Current,Idle\n2024-01-01 00:00:00.100,1,2,3,0\nbad,1,2,3,0\n2024-01-01 00:00:00.200,x,2,inf,1\n", encoding="utf-8")
    df = read_sensor_csv(spark, str(path), "fault")
    got = df.orderBy("TimeStamp").collect()
    assert len(got) == 2 and got[1]["AI0_Vibration"] is None and got[1]["AI2_Current"] is None and got[0]["Equipment_state"] == 1
    q = quality_counts(df).first()
    assert (q["rows"], q["invalid_sensors"], q["idle_rows"]) == (2, 1, 1)
    roles = Roles("TimeStamp", {"x": "AI0_Vibration"}, source="source", state="Equipment_state", idle="Idle")
    assert to_samples(df, roles).count() == 2
    with pytest.raises(Exception, match="finite"):
        assert_finite(df, ("AI0_Vibration",)).collect()
    with pytest.raises(ValueError, match="missing columns: b"):
        require(spark.createDataFrame([(1,)], "a int"), ("a", "b"))
    with pytest.raises(ValueError):
        infer_features(df)
    out = spark.createDataFrame([(0.9, 1.0), (0.99, 2.0)], "quantile double, v double")
    write_table(out, str(tmp_path / "t"), ["quantile"])
    write_table(out.where("quantile < 0.95").withColumn("v", F.lit(7.0)), str(tmp_path / "t"), ["quantile"])
    assert {r["v"] for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {7.0, 2.0}
    write_csv(out, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    runs = []
    for settings in ({"q": 1}, {"q": 1}, {"q": 2}):
        run_once(spark, str(tmp_path / "marker"), settings, lambda: runs.append(1))
    assert len(runs) == 2 and read_settings(spark, str(tmp_path / "marker")) == {"q": 2}
    assert "quantile" in report(out, "Title")


def test_sensor_files_keep_their_source_and_the_order_of_their_rows(spark, tmp_path):
    head = "TimeStamp,AI0_Vibration,AI1_Vibration,AI2_Current,Equipment_state,Idle\n"
    line = lambda sec, v, state: f"2024-01-01 00:00:{sec:06.3f},{v},{v},{v},{state},0\n"
    (tmp_path / "normal.csv").write_text(head + "".join(line(i / 10, i, 0) for i in range(30)) + line(2.9, 99, 0) * 2)
    (tmp_path / "fault.csv").write_text(head + "".join(line(20 + i / 10, i, int(i >= 4)) for i in range(20)))
    raw = read_sources(spark, str(tmp_path / "normal.csv"), str(tmp_path / "fault.csv"))
    rows = sessions.sessionize(to_samples(raw, SENSOR_ROLES), 0.5)
    found = {(r["source"], r["kind"]): r["n"] for r in rows.groupBy("source", "kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert found == {("normal", "normal"): 32, ("fault", "fault"): 20}
    assert [r[0] for r in ordered(rows.where("source = 'normal'"), "AI0_Vibration")] == [*map(float, range(30)), 99.0, 99.0]
    assert rows.select("source", "seq").distinct().count() == 52
    m = metrics.raw_alarm_metrics(rows.withColumn("alarm", F.col("AI0_Vibration") == 6), "alarm").first()
    assert (m["n_events"], m["detected_events"], m["normal_fa_cycles"]) == (1, 1, 1) and m["delay_mean_sec"] == pytest.approx(0.6)
    (tmp_path / "external.csv").write_text("TimeStamp,AI0_Vibration,AI1_Vibration,AI2_Current\n2024-01-01 00:00:00,1,2,3\n2024-01-01 00:00:00,,2,3\n")
    outside = read_external(spark, str(tmp_path / "external.csv"))
    assert [(r["source"], r["has_truth"], r["Equipment_state"], r["AI0_Vibration"]) for r in outside.orderBy("seq").collect()] == [("external", False, 0, 1.0), ("external", False, 0, None)]
    assert drop_unknown(to_samples(outside, SENSOR_ROLES), ("AI0_Vibration",)).first()["t_sec"] == 0.0
    assert line_count(spark, str(tmp_path / "fault.csv")).first()["rows"] == 20
    assert read_optional(spark, str(tmp_path / "none.parquet")) is None
    known = {(r["kind"], r["name"]) for r in provenance(spark, str(tmp_path / "*.csv"), str(tmp_path)).collect()}
    assert {("sha256", "fault.csv"), ("version", "spark"), ("commit", "code")} <= known


def test_spreadsheet_csv_summaries_and_scales(spark, tmp_path):
    out = spark.createDataFrame([("or_3", 0.5, None), ("or_3_p2", 0.25, 3)], "combo string, f1 double, n int")
    write_csv(out, str(tmp_path / "c"), byte_order_mark=True)
    assert any(p.read_bytes().startswith(b"\xef\xbb\xbfcombo,") for p in (tmp_path / "c").glob("*.csv"))
    assert digest_line("ensemble", pick(out, combo="or_3_p2")) == "ensemble: combo=or_3_p2, f1=0.25, n=3"
    assert digest_line("ensemble", pick(out, combo="none")) == "ensemble: no result" and pick(out, n=None)["combo"] == "or_3"
    w = spark.range(4).selectExpr("timestamp_micros(id * 100000) as window_start", "timestamp_micros(id * 100000 + 1000000) as window_end", "'g' as group_id", "'normal' as source", "0 as label", "1.0D as a_corr")
    w.write.parquet(str(tmp_path / "s" / "model_windows.parquet"))
    w.limit(0).write.parquet(str(tmp_path / "s" / "idle_windows.parquet"))
    out.write.parquet(str(tmp_path / "s" / "event_manifest.parquet"))
    import tidewatch.sources.samples as sources

    kept = sources.infer_features
    sources.infer_features = lambda df: ["a_corr"]
    try:
        scale = read_scale(spark, str(tmp_path / "s"))
    finally:
        sources.infer_features = kept
    assert (scale.step_sec, scale.window_sec, scale.windows.count(), scale.events.count()) == (0.1, 1.0, 4, 2)
    with pytest.raises(ValueError, match="quantile"):
        Settings(quantile=1.5)
    with pytest.raises(ValueError, match="0.05"):
        splits.calibration_groups(spark.createDataFrame([("a",), ("b",)], "group_id string"), 0.5, 0)
    none = samples(spark, [0.0], source="fault")
    with pytest.raises(ValueError, match="no normal rows"):
        splits.training_rows(sessions.sessionize(none, 0.5), None, ("x",))


@pytest.mark.parametrize("cell", [0.35, 1.0, 100.0])
def test_sessions_in_cells_of_any_length(spark, cell):
    rng = random.Random(2)
    times = np.cumsum([rng.choice([0.1, 0.1, 0.5, 0.6, 3.0]) for _ in range(150)]).tolist()
    df = samples(spark, times, idle=[rng.randint(0, 1) for _ in times])
    columns = ("segment_id", "gap_sec", "kind", "group_id")
    assert ordered(sessions.sessionize_in_cells(df, 0.5, cell), *columns) == ordered(sessions.sessionize(df, 0.5), *columns)


def test_quantiles_by_cells_equal_numpy(spark):
    rng = np.random.default_rng(5)
    for values in (rng.normal(size=301), np.exp(rng.normal(size=50) * 9), np.round(rng.normal(size=200), 1), np.full(9, 3.0), np.array([0.0, -1.0, 0.0, 1e-300, -1e300])):
        df = spark.createDataFrame([(float(v), "a") for v in values] + [(None, "a"), (7.0, "b")], "v double, g string")
        got = {r["g"]: r for r in thresholds.exact_quantiles(df, "v", (0.0, 0.13, 0.5, 0.9999, 1.0), ["g"]).collect()}
        assert np.allclose(got["a"]["quantiles"], np.quantile(values, [0.0, 0.13, 0.5, 0.9999, 1.0]), rtol=1e-9) and got["a"]["n"] == len(values)
        assert got["b"]["quantiles"] == [7.0] * 5
