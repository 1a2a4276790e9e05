"""Exact splits by a seeded permutation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import sessions, splits
from tidewatch.plans.queries import EV_ROWS, LI_ROWS, MANIFEST, query, rounded
from tidewatch.plans.star import event_rows, line_rows, table


@query(f"WITH {EV_ROWS} SELECT group_id, kind, (row_number() OVER (PARTITION BY kind ORDER BY md5('3:' || group_id), group_id) - 1) % 5 AS fold FROM (SELECT DISTINCT group_id, kind FROM seg_rows)")
def fold_map_exact(spark, sf_dir):
    return rounded(splits.exact_fold_map(event_rows(spark, sf_dir), 5, 3))


@query(f"""WITH {LI_ROWS}, {MANIFEST}, o AS (SELECT *, CASE WHEN idle_majority = 1 THEN 'EXCLUDED_IDLE' WHEN source = 'fault' AND onset_us IS NOT NULL AND duration_sec < 432000 THEN 'EXCLUDED_SHORT' END AS out FROM manifest),
  r AS (SELECT group_id, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || group_id), group_id) - 1 AS rank, count(*) OVER (PARTITION BY label) AS n FROM o WHERE out IS NULL),
  a AS (SELECT *, CASE WHEN n >= 3 THEN greatest(1, least(round_even(n * 0.6, 0), n - 2)) ELSE round_even(n * 0.6, 0) END AS a FROM r), b AS (SELECT *, CASE WHEN n >= 3 THEN greatest(1, least(round_even(n * 0.2, 0), n - a - 1)) ELSE round_even(n * 0.2, 0) END AS b FROM a)
  SELECT o.group_id, coalesce(out, CASE WHEN rank < a THEN 'train' WHEN rank < a + b THEN 'val' ELSE 'test' END) AS split FROM o LEFT JOIN b USING (group_id)""")
def split_exact(spark, sf_dir):
    return splits.exact_splits(sessions.segment_manifest(line_rows(spark, sf_dir)), 432_000.0).select("group_id", "split")


@query(f"WITH {EV_ROWS}, g AS (SELECT DISTINCT group_id FROM seg_rows WHERE kind = 'normal'), r AS (SELECT group_id, row_number() OVER (ORDER BY md5('7:' || group_id), group_id) AS place, count(*) OVER () AS n FROM g) SELECT group_id FROM r WHERE place <= least(greatest(1, ceil(n * 0.2)), n - 1)")
def calibration_exact(spark, sf_dir):
    return splits.exact_calibration_groups(event_rows(spark, sf_dir).where("kind = 'normal'"), 0.2, 7)


@query("WITH r AS (SELECT event_id, row_number() OVER (ORDER BY md5('7:' || event_id), event_id) AS place, count(*) OVER () AS n FROM events) SELECT event_id FROM r WHERE place <= greatest(2, round_even(n * 0.3, 0))")
def subsample_exact(spark, sf_dir):
    return splits.exact_subsample(table(spark, sf_dir, "events").select("event_id"), "event_id", 0.3, 7).select(F.col("event_id"))
