"""Embedding near-duplicates against all pairs."""

from collections import Counter

import numpy as np
import pytest

from tidewatch.llm import embedding_dedup as D

COLUMNS = "vec_id long, embedding array<double>, label int, rep long, key string, root int, n int"


def frame(spark, rows, columns=COLUMNS):
    return spark.createDataFrame([(*r, 1, "k", 2, 3) for r in rows], columns).repartition(3)


def plain(rows):
    """Rows (vec_id, n_links, component_id, kept) by all pairs."""
    ok = [v is not None and y is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, v, y in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    unit = [np.array(v, float) / np.linalg.norm(v) if k else None for k, (_, v, _) in zip(ok, rows, strict=True)]
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= D.LIKE:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (k, *_) in enumerate(rows):
        known = [x for x in (least.get(find(i)), k) if x is not None]
        least[find(i)] = min(known) if known else None
    return Counter((k, links[i], least[find(i)], k == least[find(i)]) for i, (k, *_) in enumerate(rows))


def near(rng, v, angle, n):
    """n vectors at about this angle from v."""
    out = []
    for _ in range(n):
        x = rng.normal(size=len(v))
        x -= (x @ v) / (v @ v) * v
        out.append((np.cos(angle) * v / np.linalg.norm(v) + np.sin(angle) * x / np.linalg.norm(x)) * rng.uniform(0.5, 2))
    return out


def sample(seed=1, d=32):
    rng = np.random.default_rng(seed)
    rows = [(v, int(rng.integers(3))) for v in rng.normal(size=(400, d))]
    for angle, n in ((0.05, 90), (0.1, 120), (0.135, 80), (0.16, 60), (0.19, 30)):
        centre = rng.normal(size=d)
        rows += [(v, 1) for v in near(rng, centre, angle, n)]
    for v, y in rows[:60]:
        rows.append((near(rng, v, rng.uniform(0.0, 0.25), 1)[0], y))
    v = rng.normal(size=d)
    for _ in range(25):  # a chain: each links with the next
        rows.append((v, 2))
        v = near(rng, v, 0.18, 1)[0]
    rows = [(v.tolist(), y) for v, y in rows]
    rows += [rows[0]] * 40 + [(rows[0][0], 99), (rows[5][0], None), (None, 1), ([], 1), ([0.0] * d, 1), ([0.0] * d, 1), ([-0.0] * d, 1), ([float("nan")] * d, 1), ([float("inf")] * d, 1), ([1.0, None], 1), ([1.0, 2.0], 1), ([2.0, 4.0], 1), ([1e-300, 2e-300], 1)]
    order = rng.permutation(len(rows))
    return [(int(order[i]), *rows[i]) for i in range(len(rows))]


@pytest.mark.parametrize("cell", [16, 1024])
def test_equals_all_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(D, "CELL", cell)  # 16: classes by cells, 1024: at once
    rows = sample()
    rows += [rows[3], rows[3], (None, rows[7][1], rows[7][2]), (None, [5.0] + [0.0] * 31, 1)]
    got = Counter(tuple(r) for r in D.near_duplicate_vectors(frame(spark, rows)).collect())
    want = plain([r if r[1] is None or len(r[1]) != 2 or r[1][0] != 1e-300 else (r[0], [1.0, 2.0], r[2]) for r in rows])
    assert got == want


def test_single_precision(spark):
    rows = [(i, np.float32(v).tolist() if v and None not in v else None, y) for i, v, y in sample(2)]
    rows = [r for r in rows if r[1] is None or len(r[1]) == 32]
    got = Counter(tuple(r) for r in D.near_duplicate_vectors(frame(spark, rows, COLUMNS.replace("double", "float"))).collect())
    assert got == plain(rows)


def test_many_equal_vectors_are_one(spark):
    rows = [(i, [1.0, 2.0, 3.0], 1) for i in range(3000)] + [(9000 + i, [3.0, -2.0, float(i)], 1) for i in range(2)]
    got = D.near_duplicate_vectors(frame(spark, rows)).collect()
    assert Counter((r["n_links"], r["component_id"]) for r in got) == {(2999, 0): 3000, (0, 9000): 1, (0, 9001): 1} and sum(r["kept"] for r in got) == 3


def test_empty_tables(spark):
    assert D.near_duplicate_vectors(frame(spark, [])).collect() == []
    assert Counter(tuple(r) for r in D.near_duplicate_vectors(frame(spark, [(1, None, 1), (None, [1.0], None)])).collect()) == {(1, 0, 1, True): 1, (None, 0, None, True): 1}


def test_passes_grow_with_the_table():
    assert D.passes_for(0) <= D.passes_for(10) <= D.passes_for(10_000) < D.passes_for(10_000_000) < 100


def test_a_window_keeps_one_link_for_each_row(spark):
    rng = np.random.default_rng(3)
    unit = np.array([v / np.linalg.norm(v) for v in near(rng, rng.normal(size=16), 0.05, 700)])
    w = D.Window(0.98, 32)
    links = w.feed(np.arange(300), unit[:300]) + w.feed(np.arange(300, 700), unit[300:])
    assert len(links) == 699
