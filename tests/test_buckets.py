"""Many series share the calls of a micro-batch."""

import numpy as np
import pandas as pd

from tidewatch.plans.queries import plain_detector
from tidewatch.streaming.detector import Memory, Stepper, recalled, saved, step_series


def test_series_of_a_bucket_step_as_each_by_itself():
    rng = np.random.default_rng(1)
    n = 300
    frame = pd.DataFrame({"source": rng.choice(["normal", "fault"], n), "series": rng.choice(["1", "2", None], n), "t_us": rng.integers(0, 9, n).cumsum() * 10**10, "seq": np.arange(n), "kind": "normal", "truth": 0})
    frame = frame.assign(**{f"c{i}": rng.random(n) * 90 for i in range(3)})
    memories: dict[tuple, Memory] = {}
    parts = []
    for at in range(0, n, 100):
        parts.append(step_series(frame.iloc[at : at + 100], plain_detector(), memories))
        memories = recalled(saved(memories))
    got = pd.concat(parts).set_index("seq")
    for _, own in frame.groupby(["source", "series"], dropna=False):
        want = Stepper(plain_detector()).many(own["t_us"].to_numpy(np.int64), own[["c0", "c1", "c2"]].to_numpy(float))
        for c in ("segment_id", "final_alarm", "persistence_count"):
            assert got.loc[own["seq"], c].tolist() == want[c]
