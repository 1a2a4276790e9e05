"""Streaming cross-validation by blocks against the plain form by rows, and its ties."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import metrics, models, sessions, thresholds
from tidewatch.operators.models import Forest, _grow, all_cuts
from tidewatch.plans import cv_blocks, cv_queries, protocol
from tidewatch.schema import Settings

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SETTINGS = Settings(gap_sec=40.0, short_size=3, long_size=5, channels=("a", "b", "c"))
VARIANTS = ("final_alarm", "or_3", "long_alarm")


def samples(spark, n=700):
    rng = np.random.default_rng(3)
    rows, t = [], 0
    for i in range(n):
        t += int(rng.choice([1, 1, 1, 1, 1, 1, 1, 1, 1, 90])) * 1_000_000
        source = "fault" if i % 7 == 0 else "normal"
        rows.append((source, i % 5, t, i, *rng.integers(0, 9, 3).astype(float).tolist(), int(source == "fault"), int(rng.random() < 0.2)))
    return sessions.sessionize(spark.createDataFrame(rows, "source string, series long, t_us long, seq long, a double, b double, c double, state int, idle int"), 40.0)


@pytest.mark.parametrize("size", [3, 50, 2000])
def test_blocks_equal_rows_and_no_row_is_repeated(spark, monkeypatch, size):
    monkeypatch.setattr(cv_blocks, "BLOCK_ROWS", size)
    rows, quantiles = samples(spark), (0.7, 0.9)
    scores = protocol.fold_scores(rows, 3, 2, SETTINGS).persist()
    found = protocol.fold_alarms(scores, protocol.fold_thresholds(scores, SETTINGS, quantiles), SETTINGS)
    each = F.explode(F.array(*(F.struct(F.lit(v).alias("variant"), F.col(v).alias("alarm")) for v in VARIANTS)))
    want = metrics.raw_alarm_metrics(found.select("*", each.alias("_v")).select("*", "_v.variant", "_v.alarm"), "alarm", ["repeat", "quantile", "variant"])
    kept, plain = {}, protocol.written

    def counting(df, name, *group_rows):
        kept[name] = plain(df, name, *group_rows)
        return kept[name]

    monkeypatch.setattr(protocol, "written", counting)
    got = protocol.streaming_cv(rows, SETTINGS, 3, 2, quantiles=quantiles, variants=VARIANTS)
    close = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*want.columns).collect())
    assert close(got) == close(want)
    # before, each row was kept once for each fold that it is tested in or validates
    assert kept["cv-scores"].count() <= rows.count()


def test_equal_scores_are_on_one_side_of_a_threshold(spark):
    """0.1 + 0.2 and 0.3 are one score: with a threshold of either, both alarm."""
    rows = spark.createDataFrame([(f"g{i}", i, i, "normal", 0, [0], [1.0, v, 1.0], [1.0, v, 1.0]) for i, v in enumerate((0.1 + 0.2, 0.3))], "group_id string, t_us long, seq long, kind string, label int, folds array<int>, test array<double>, validation array<double>")
    kept = cv_blocks.blocks(rows, SETTINGS)
    limits = {(0, 0): np.array([[9.0, np.round(0.1 + 0.2, 8), 9.0]])}
    found = cv_blocks.alarm_table(cv_blocks.block_sums(kept, limits, 1, SETTINGS, ("short_alarm",), 8), (0.5,), ("short_alarm",)).first()
    assert (found["normal_cycles"], found["normal_fa_cycles"]) == (2, 2)
    assert cv_blocks.validation_scores(kept, 1, 1, SETTINGS, 8).where("name = 'short'").select("score").distinct().count() == 1


def test_forest_scores_equal_a_walk():
    rng = np.random.default_rng(0)
    x = np.log1p(rng.random((64, 3)))
    forest = Forest(["a", "b", "c"], [0.1, 0.2, 0.3], [_grow(x, 6, rng) for _ in range(5)], 64)
    rows = rng.random((200, 3))
    rows[::9, 1] = np.nan
    logged = np.log1p(np.where(np.isnan(rows), np.array(forest.medians), rows))
    for got, v in zip(forest.numpy_score(rows), logged, strict=True):
        total = 0.0
        for t in forest.trees:
            k = 0
            while t["feature"][k] >= 0:
                k = t["left"][k] if v[t["feature"][k]] < t["value"][k] else t["right"][k]
            total += t["path"][k]
        from tidewatch.operators.models import _average_path

        assert got == pytest.approx(2 ** (-total / 5 / _average_path(64)))


def test_forests_share_ranks_and_no_row_is_walked_by_itself():
    """Ranks among the cuts of several forests give each forest's own; a value at a cut goes right."""
    rng = np.random.default_rng(1)
    forests = [Forest(["a", "b"], [0.5, 0.5], [_grow(rng.integers(0, 9, (64, 2)).astype(float), 6, rng) for _ in range(7)], 64) for _ in range(2)]
    x = np.vstack([rng.random((150, 2)) * 9, np.column_stack([forests[0].cuts[0][:20], forests[0].cuts[1][:20]])])
    every = all_cuts(forests)
    ranks = [np.searchsorted(cuts, c, "right") for cuts, c in zip(every, x.T)]
    for f in forests:
        total = np.zeros(len(x))
        for t in f.trees:
            node = np.zeros(len(x), int)
            for _ in range(7):
                right = x[np.arange(len(x)), np.maximum(t["feature"][node], 0)] >= t["value"][node]
                node = np.where(t["feature"][node] < 0, node, np.where(right, t["right"][node], t["left"][node]))
            total = total + t["path"][node]
        got = f.ranked_score([table.take(r) for table, r in zip(f.rank_tables(every), ranks)])
        assert (got == f.logged_score(x)).all()
        np.testing.assert_allclose(got, 2 ** (-total / 7 / models._average_path(64)))


def test_models_and_thresholds_come_from_blocks(spark):
    """As from rows: forests have the same trees, thresholds are exact, though of all scores only those of a few cells leave the blocks."""
    rows = samples(spark)
    inputs, want, names = protocol.fold_fits(rows, 3, 1, SETTINGS, "forest")
    kept = cv_blocks.blocks(inputs, SETTINGS).persist()
    got = cv_blocks.block_models(kept, dict(inputs.dtypes), names, 3, 1, SETTINGS, "forest")
    trees = lambda models: {(key, n): m.to_json() for key, by in models.items() for n, m in by.items()}
    assert trees(got) == trees(want) and any(len(by) == len(names) for by in got.values())
    scored = cv_blocks.scored_blocks(kept, got, names, 3, 1, SETTINGS).persist()
    by, every = ["repeat", "test_fold", "name"], cv_blocks.validation_scores(scored, 3, 1, SETTINGS)
    told = lambda df: {tuple(r[c] for c in by): (r["quantiles"], r["n"]) for r in df.collect()}
    assert told(cv_blocks.validation_quantiles(scored, 3, 1, SETTINGS, (0.5, 0.93))) == told(thresholds.exact_quantiles(every, "score", (0.5, 0.93), by))


def test_comparison_has_all_quantiles_and_variants(spark):
    found = cv_queries.streaming_cv_comparison(spark, SF_DIR).toPandas().set_index(["quantile", "variant"]).sort_index()
    repeats = cv_queries.streaming_cv_sweep(spark, SF_DIR).toPandas().groupby(["quantile", "variant"])
    assert sorted(found.index) == sorted((q, v) for q in cv_queries.QUANTILES for v in protocol.VARIANTS)
    for m in ("event_detection_rate", "delay_mean_sec", "sample_f1", "normal_fa_cycle_rate", "idle_fa_cycle_rate", "normal_fa_episodes"):
        for name, want in (("mean", repeats[m].mean()), ("std", repeats[m].std())):
            np.testing.assert_allclose(found[f"{m}_{name}"].astype(float), want.sort_index(), atol=3e-4)
