"""Seeded splits of any number of groups, as numpy shuffles them."""

import numpy as np

from tidewatch.operators import splits


def test_many_groups_are_shuffled_as_numpy_does(spark, monkeypatch):
    # before, a limit of ids on the driver was an error
    monkeypatch.setattr(splits, "ID_LIMIT", 10, raising=False)
    monkeypatch.setattr(splits, "DRAWN", 7)
    rows = [(f"{k}_{i}", k) for k, n in (("fault", 23), ("normal", 41), ("idle", 11)) for i in range(n)]
    got = {r["group_id"]: r["fold"] for r in splits.fold_map(spark.createDataFrame(rows * 2, "group_id string, kind string"), 4, 7).collect()}
    rng, want = np.random.default_rng(7), {}
    for kind in ("fault", "normal", "idle"):
        ids = np.array(sorted(g for g, k in rows if k == kind))
        rng.shuffle(ids)
        want |= {str(g): i % 4 for i, g in enumerate(ids)}
    assert got == want


def test_splits_of_many_groups(spark, monkeypatch):
    monkeypatch.setattr(splits, "ID_LIMIT", 10, raising=False)
    rows = [(f"{s}_{i}_0", s, i, 0, int(s == "fault"), 0, 0 if s == "fault" else None, 9.0) for s, n in (("fault", 21), ("normal", 40)) for i in range(n)]
    manifest = spark.createDataFrame(rows, "group_id string, source string, series long, segment_id long, label int, idle_majority int, onset_us long, duration_sec double")
    got = {r["group_id"]: r["split"] for r in splits.assign_splits(manifest, 1.0, seed=42).collect()}
    free = sorted(rows, key=lambda r: (r[1] == "fault", r[2], r[3]))
    rng, want = np.random.default_rng(42), {}
    for label in (0, 1):
        index = np.array([i for i, r in enumerate(free) if r[4] == label])
        rng.shuffle(index)
        a, b = splits.split_sizes(len(index), 0.6, 0.2)
        want |= {free[i][0]: n for i, n in zip(index.tolist(), ["train"] * a + ["val"] * b + ["test"] * (len(index) - a - b), strict=True)}
    assert got == want
    chosen = {r["group_id"] for r in splits.calibration_groups(manifest, 0.2, 3).collect()}
    ids = np.array(sorted(r[0] for r in rows))
    np.random.default_rng(3).shuffle(ids)
    assert chosen == set(ids[:13].tolist())
