"""The evaluation protocol over the event stream: five folds, five repeats, five quantiles, five alarm variants, and the parts of it that SQL
can express."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.operators.models import fold_forests, tree_keys, tree_samples
from tidewatch.operators.moments import fold_models, hashed_folds
from tidewatch.operators import splits, windows
from tidewatch.plans.protocol import VARIANTS, comparison_table, sample_cv, streaming_cv, window_run
from tidewatch.plans.queries import EV_ROWS, LI_ROWS, query, rounded
from tidewatch.plans.star import EVENT_SETTINGS, LINE_SETTINGS, event_rows, line_rows
from tidewatch.schema import feature_names
from tidewatch.sources.scratch import written
from tidewatch.streaming.detector import detect, fit_detector

QUANTILES = (0.9, 0.95, 0.97, 0.98, 0.99)
K, REPEATS = 5, 5


def _fold(seed: str) -> str:
    return f"CAST(floor(CAST('0x' || substr(md5({seed} || ':' || group_id), 1, 8) AS BIGINT) / 4294967296.0 * {K}) AS BIGINT)"


@query()
def streaming_cv_sweep(spark, sf_dir):
    return rounded(streaming_cv(event_rows(spark, sf_dir), EVENT_SETTINGS, K, REPEATS, quantiles=QUANTILES, variants=VARIANTS), 4)


@query()
def streaming_cv_comparison(spark, sf_dir):
    """Means and deviations over the repeats, for all quantiles and variants."""
    return rounded(comparison_table(streaming_cv(event_rows(spark, sf_dir), EVENT_SETTINGS, K, REPEATS, quantiles=QUANTILES, variants=VARIANTS)), 4)


@query()
def streaming_cv_forest(spark, sf_dir):
    return rounded(streaming_cv(event_rows(spark, sf_dir), EVENT_SETTINGS, K, REPEATS, quantiles=QUANTILES, variants=("final_alarm",), kind="forest"), 4)


#: The protocol with models of one feature each, whose scores are SQL: the squared distance of its log from the mean, over the variance.
PLAIN = {"sample": ["value"], "short": ["short_value_mean"], "long": ["long_value_mean"]}
#: Decimals at which scores and thresholds are compared: windows of equal means are often exactly at a threshold, and the sums' order isn't fixed.
DIGITS = 8
_LOG = "CASE WHEN {0} < 0 THEN -ln(1 - {0}) ELSE ln(1 + {0}) END"
_RATE = "round(count(*) FILTER (WHERE {0}) / nullif(count(*) FILTER (WHERE {1}), 0), 4)"


@query(f"""WITH {EV_ROWS}, w AS (SELECT *, row_number() OVER o AS place, avg(value) OVER (o ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m3, avg(value) OVER (o ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m5 FROM seg_rows WINDOW o AS (PARTITION BY group_id ORDER BY t_us, seq)),
  x AS (SELECT source, group_id, t_us, seq, kind, label, idle, {_LOG.format('value')} AS a, CASE WHEN place >= 3 THEN {_LOG.format('m3')} END AS b, CASE WHEN place >= 5 THEN {_LOG.format('m5')} END AS c FROM w),
  g AS (SELECT group_id, repeat, {_fold('repeat')} AS fold FROM (SELECT DISTINCT group_id FROM seg_rows), range({REPEATS}) t(repeat)),
  r AS (SELECT x.*, repeat, test_fold, CASE WHEN fold = test_fold THEN 'test' WHEN kind = 'normal' AND fold = (test_fold + 1) % {K} THEN 'validation' WHEN kind = 'normal' AND idle <> 1 AND fold <> (test_fold + 1) % {K} THEN 'train' END AS role FROM x JOIN g USING (group_id), range({K}) f(test_fold)),
  m AS (SELECT repeat, test_fold, avg(a) AS ma, var_pop(a) AS va, avg(b) AS mb, var_pop(b) AS vb, avg(c) AS mc, var_pop(c) AS vc FROM r WHERE role = 'train' GROUP BY 1, 2),
  s AS (SELECT r.*, power(a - ma, 2) / va AS raw, round(power(b - mb, 2) / vb, {DIGITS}) AS short_score, round(power(c - mc, 2) / vc, {DIGITS}) AS long_score FROM r JOIN m USING (repeat, test_fold) WHERE role IN ('test', 'validation')),
  z AS (SELECT *, CASE WHEN count(*) OVER p >= 3 THEN round(avg(raw) OVER p, {DIGITS}) END AS sample_score FROM s WINDOW p AS (PARTITION BY group_id, repeat, test_fold ORDER BY t_us, seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
  q AS (SELECT repeat, test_fold, unnest({list(QUANTILES)}::DOUBLE[]) AS quantile, round(unnest(quantile_cont(sample_score, {list(QUANTILES)})), {DIGITS}) AS ts, round(unnest(quantile_cont(short_score, {list(QUANTILES)})), {DIGITS}) AS th, round(unnest(quantile_cont(long_score, {list(QUANTILES)})), {DIGITS}) AS tl FROM z WHERE role = 'validation' GROUP BY 1, 2),
  al AS (SELECT z.*, quantile, coalesce(sample_score >= ts, false) AS sample_alarm, coalesce(short_score >= th, false) AS short_alarm, coalesce(long_score >= tl, false) AS long_alarm FROM z JOIN q USING (repeat, test_fold) WHERE role = 'test'),
  o AS (SELECT *, sample_alarm OR short_alarm OR long_alarm AS or_3 FROM al),
  f AS (SELECT *, or_3 AND coalesce(lag(or_3) OVER (PARTITION BY group_id, repeat, quantile ORDER BY t_us, seq), false) AS final_alarm FROM o),
  v AS (UNPIVOT (SELECT repeat, quantile, group_id, t_us, seq, kind, label, {', '.join(VARIANTS)} FROM f) ON {', '.join(VARIANTS)} INTO NAME variant VALUE alarm),
  e AS (SELECT *, alarm AND NOT coalesce(lag(alarm) OVER (PARTITION BY repeat, quantile, variant, group_id ORDER BY t_us, seq), false) AS new FROM v),
  d AS (SELECT repeat, quantile, variant, group_id, kind, count(*) FILTER (WHERE label = 1 AND alarm) AS tp, count(*) FILTER (WHERE label <> 1 AND alarm) AS fp, count(*) FILTER (WHERE label = 1 AND NOT alarm) AS fn, count(*) FILTER (WHERE new) AS ep, min(t_us) AS onset, min(CASE WHEN alarm THEN t_us END) AS hit FROM e GROUP BY ALL),
  t AS (SELECT repeat, quantile, variant, CAST(sum(tp) FILTER (WHERE kind <> 'idle') AS DOUBLE) AS tp, CAST(sum(fp) FILTER (WHERE kind <> 'idle') AS DOUBLE) AS fp, CAST(sum(fn) FILTER (WHERE kind <> 'idle') AS DOUBLE) AS fn,
    count(*) FILTER (WHERE kind = 'fault') AS n_events, count(*) FILTER (WHERE kind = 'fault' AND hit IS NOT NULL) AS detected_events, {_RATE.format("kind = 'fault' AND hit IS NOT NULL", "kind = 'fault'")} AS event_detection_rate, round(avg((hit - onset) / 1e6) FILTER (WHERE kind = 'fault'), 4) AS delay_mean_sec,
    {', '.join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}_cycles, count(*) FILTER (WHERE kind = '{k}' AND hit IS NOT NULL) AS {k}_fa_cycles, CAST(coalesce(sum(ep) FILTER (WHERE kind = '{k}'), 0) AS BIGINT) AS {k}_fa_episodes" for k in ("normal", "idle"))},
    {', '.join(_RATE.format(f"kind = '{k}' AND hit IS NOT NULL", f"kind = '{k}'") + f" AS {k}_fa_cycle_rate" for k in ("normal", "idle"))} FROM d GROUP BY ALL)
  SELECT * EXCLUDE (tp, fp, fn), round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS sample_f1, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS sample_precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS sample_recall FROM t""")
def streaming_cv_one_feature(spark, sf_dir):
    return rounded(streaming_cv(event_rows(spark, sf_dir), EVENT_SETTINGS, K, REPEATS, quantiles=QUANTILES, variants=VARIANTS, features=PLAIN, digits=DIGITS), 4)


@query(f"""WITH {LI_ROWS}, x AS (SELECT group_id, sign(quantity) * ln(1 + abs(quantity)) AS a, sign(price) * ln(1 + abs(price)) AS b, sign(discount) * ln(1 + abs(discount)) AS c FROM seg_rows WHERE kind = 'normal'),
  g AS (SELECT group_id, repeat, {_fold('repeat')} AS fold FROM (SELECT DISTINCT group_id FROM x), range({REPEATS}) t(repeat)),
  r AS (SELECT x.*, repeat, test_fold FROM x JOIN g USING (group_id), range({K}) f(test_fold) WHERE fold <> test_fold AND fold <> (test_fold + 1) % {K}),
  u AS (SELECT repeat, test_fold, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, covar_pop(a, a) AS aa, covar_pop(a, b) AS ab, covar_pop(a, c) AS ac, covar_pop(b, b) AS bb, covar_pop(b, c) AS bc, covar_pop(c, c) AS cc FROM r GROUP BY ALL),
  q AS (SELECT repeat, test_fold, sum(power((a - ma) * (a - ma) + (b - mb) * (b - mb) + (c - mc) * (c - mc), 2)) AS q4 FROM r JOIN u USING (repeat, test_fold) GROUP BY ALL),
  v AS (SELECT *, (aa + bb + cc) / 3 AS m, aa * aa + bb * bb + cc * cc + 2 * (ab * ab + ac * ac + bc * bc) AS ss FROM u JOIN q USING (repeat, test_fold)), w AS (SELECT *, (ss - 3 * m * m) / 3 AS d2 FROM v)
  SELECT repeat, test_fold, n, round(ma, 8) AS quantity_mean, round(mb, 8) AS price_mean, round(mc, 8) AS discount_mean, round(1e3 * greatest(0, least(q4 / (3.0 * n * n) - ss / (3.0 * n), d2)) / d2, 8) AS shrinkage_pm FROM w""")
def fold_models_one_scan(spark, sf_dir):
    """Location and Ledoit-Wolf shrinkage of all folds of all repeats, from mergeable moments."""
    rows = line_rows(spark, sf_dir).withColumn("folds", hashed_folds(F.col("group_id"), K, REPEATS))
    models = fold_models(rows.where("kind = 'normal'"), list(LINE_SETTINGS.channels), K, REPEATS, among=rows)
    found = [(r, t, m.rows, *m.location, 1e3 * m.shrinkage) for (r, t), m in models.items()]
    out = spark.createDataFrame(found, "repeat long, test_fold long, n long, quantity_mean double, price_mean double, discount_mean double, shrinkage_pm double")
    return rounded(out, 8)


@query(f"""WITH {LI_ROWS}, x AS (SELECT group_id, seq, CAST('0x' || substr(md5(group_id || ':' || t_us || ':' || seq), 1, 15) AS BIGINT) % 2147483647 AS n FROM seg_rows WHERE kind = 'normal'),
  h AS (SELECT tree, group_id, seq, (a * n + b) % 2147483647 AS hash, n FROM x, (VALUES {', '.join(f'({t}, {a}::BIGINT, {b}::BIGINT)' for t, (a, b) in enumerate(tree_keys(10, 42)))}) t(tree, a, b)),
  o AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY hash, n) AS place FROM h) SELECT CAST(tree AS BIGINT) AS tree, hash, n AS row FROM o WHERE place <= 64""")
def forest_samples(spark, sf_dir):
    """The samples of ten trees: of each tree the 64 rows with the smallest keyed hashes."""
    rows = line_rows(spark, sf_dir).where("kind = 'normal'")
    drawn = tree_samples(rows, list(LINE_SETTINGS.channels), ["group_id", "t_us", "seq"], 10, 64, 42)
    place = F.row_number().over(Window.partitionBy("tree").orderBy("hash", "row"))
    return drawn.withColumn("_p", place).where("_p <= 64").select(F.col("tree").cast("long").alias("tree"), "hash", "row")


@query()
def fold_forest_sizes(spark, sf_dir):
    """Trees and their nodes of the forests of all folds of one repeat."""
    rows = line_rows(spark, sf_dir).withColumn("folds", hashed_folds(F.col("group_id"), K, 1))
    forests = fold_forests(rows.where("kind = 'normal'"), list(LINE_SETTINGS.channels), K, 1, trees=20, among=rows)
    return spark.createDataFrame([(r, t, len(f.trees), sum(len(x["feature"]) for x in f.trees)) for (r, t), f in forests.items()], "repeat int, test_fold int, trees int, nodes long")


# offline protocols


def _windows(spark, sf_dir):
    """The events' trailing windows of five rows as intervals with the features."""
    w = windows.count_windows(event_rows(spark, sf_dir), 5, EVENT_SETTINGS.channels).where("window_start_us is not null")
    onset = F.min(F.when(F.col("state") >= 1, F.col("t_us"))).over(Window.partitionBy("group_id"))
    w = w.withColumns({"start_us": F.col("window_start_us"), "end_us": F.col("t_us"), "onset_us": onset})
    return written(w.select("source", "series", "group_id", "kind", "start_us", "end_us", "onset_us", "label", *feature_names(EVENT_SETTINGS.channels)), "windows")


@query()
def sample_cv_metrics(spark, sf_dir):
    rows = event_rows(spark, sf_dir)
    return rounded(sample_cv(rows, EVENT_SETTINGS, splits.hashed_fold_map(rows, K), K, 60.0, quantile=0.95), 4)


@query()
def window_run_metrics(spark, sf_dir):
    """One run over windows split by group: metrics of windows beside those of events."""
    long = _windows(spark, sf_dir)
    u = splits.hash_share(F.col("group_id"), 5)
    split = long.withColumn("split", F.when(u < 0.6, "train").when(u < 0.8, "val").otherwise("test"))
    run = window_run(split, feature_names(EVENT_SETTINGS.channels), quantile=0.95)
    return rounded(run["event_metrics"].join(run["window_metrics"].select("tp", "fp", "tn", "fn", "f1")), 4)


@query()
def fitted_detection(spark, sf_dir):
    """A detector fitted on normal segments and applied to all rows: alarms by kind."""
    rows = event_rows(spark, sf_dir)
    normal = splits.training_rows(rows)
    held = splits.exact_calibration_groups(normal, 0.2, 0)
    train, calibration = normal.join(held, "group_id", "left_anti"), normal.join(held, "group_id", "left_semi")
    found = detect(rows, fit_detector(train, calibration, EVENT_SETTINGS))
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), *(F.sum(F.col(c).cast("long")).alias(c) for c in VARIANTS))
