"""Steps whose cost grew faster than it had to: each in the form that large tables need, with the same rows."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidewatch.functions import scalar
from tidewatch.operators import windows
from tidewatch.operators.models import Gaussian, _fourth_moments, _moments
from tidewatch.plans.queries import plain_detector
from tidewatch.plans.star import stream_conf
from tidewatch.streaming.detector import BUCKETS, step_series


def test_progress_looks_for_each_expression_once(spark):
    lines = spark.createDataFrame([("5 % of 3/4",), ("a/ 3/4 then 1 /8 x",), ("150% 3/4",), ("12.5.7% 2/3/4",), ("99999999999999999999/99999999999999999999",), ("",), (None,)], "line string")
    told = lines.select(scalar.log_progress(F.col("line")).alias("p"))
    assert [r["p"] for r in told.collect()] == [0.05, 0.125, 0.75, None, 1.0, None, None]
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 2 and plan.count("regexp_replace(") == 1


def test_streams_keep_one_state_for_each_core(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        with stream_conf(spark):
            assert int(spark.conf.get("spark.sql.shuffle.partitions")) == min(BUCKETS, spark.sparkContext.defaultParallelism)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "200"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_series_of_a_bucket_are_scored_by_few_calls(monkeypatch):
    calls, score = [], Gaussian.numpy_score
    monkeypatch.setattr(Gaussian, "numpy_score", lambda self, x: calls.append(len(x)) or score(self, x))
    n, rng = 3000, np.random.default_rng(2)
    frame = pd.DataFrame({"source": "normal", "series": rng.integers(0, 200, n).astype(str), "t_us": rng.integers(0, 10**12, n), "seq": np.arange(n), "kind": "normal", "truth": 0})
    got = step_series(frame.assign(**{f"c{i}": rng.random(n) * 90 for i in range(3)}), plain_detector(), {})
    assert len(got) == n and len(calls) <= 3


def test_windows_of_many_segments_take_one_pass_and_leave_out_what_is_unknown(spark):
    rows = [(f"g{i % 40}", i * 1000, i, None if i % 7 == 0 else float(i % 5), 0.1, float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "group_id string, t_us long, seq long, x double, y double, z double")
    out = windows.count_windows(df, 5, ("x", "y", "z"))
    assert "Window [" not in out._jdf.queryExecution().optimizedPlan().toString()
    found = out.toPandas()
    want = df.toPandas().sort_values(["group_id", "t_us"]).set_index("seq")
    mean = want.groupby("group_id")["x"].rolling(5, min_periods=1).mean().droplevel(0)
    full = found["window_start_us"].notna()
    assert full.sum() == 400 - 40 * 4
    np.testing.assert_allclose(found["x_mean"][full].to_numpy(), mean.loc[found["seq"][full]].to_numpy())
    assert (found["x_y_corr"][full] == 0).all() and (found["y_std"][full] == 0).all()


def test_covariances_come_from_one_row_for_each_task_and_group(spark):
    v = np.random.default_rng(3).normal(5, 1, (500, 2))
    x = spark.createDataFrame([(i % 2, *r) for i, r in enumerate(v.tolist())], "g int, a double, b double").repartition(3)
    found = _moments(x, ["g"])
    for g in range(2):
        n, mean, covariance = found[(g,)]
        assert n == 250
        np.testing.assert_allclose(mean, v[g::2].mean(0))
        np.testing.assert_allclose(covariance, np.cov(v[g::2].T, ddof=0))
        np.testing.assert_allclose(_fourth_moments(x, ["g"], {k: m for k, (_, m, _) in found.items()})[(g,)], (((v[g::2] - mean) ** 2).sum(1) ** 2).sum())
