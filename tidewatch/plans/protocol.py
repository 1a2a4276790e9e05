"""The evaluation protocols: single window runs, window cross-validation, streaming cross-validation with a quantile sweep.

Folds and quantiles are columns: the models of all folds are fitted in the same passes, and thresholds of all quantiles come
from the same scores. Features and scores are persisted where several passes read them; what an executor loses is computed again.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators import alarms, metrics, splits, thresholds
from tidewatch.operators.models import fit_forest, fit_gaussian, fit_gaussians, fold_forests
from tidewatch.operators.moments import fold_models, with_folds
from tidewatch.operators.windows import sample_feature_names, sample_features
from tidewatch.plans import cv_blocks
from tidewatch.schema import Settings
from tidewatch.sources.scratch import written
from tidewatch.streaming.detector import NAMES, complete, features_of, model_inputs

#: Alarm columns that are evaluated side by side.
VARIANTS = ("final_alarm", "or_3", "sample_alarm", "short_alarm", "long_alarm")


def window_run(windows: DataFrame, features: list[str], kind: str = "ledoit_wolf", mode: str = "quantile", quantile: float = 0.995, k: int = 1, seed: int = 42, fraction: float = 1.0) -> dict[str, DataFrame]:
    """One run over windows with split (train, val, test): `windows` scored and alarmed, `threshold`, `events`, `event_metrics`,
    `window_metrics`, `audit` (of the validation scores)."""
    train = splits.subsample(windows.where("split = 'train' and label = 0"), fraction, seed)
    if kind == "forest":
        model = fit_forest(train, features, 300, seed=seed, among=windows)
    else:
        model = fit_gaussian(train, features, kind, windows)
    rows = windows.withColumn("score", model.score())
    validation = rows.where("split = 'val'")
    limit = thresholds.best_f1(validation).select("threshold") if mode == "f1" else thresholds.normal_quantile(validation, quantile).select("threshold")
    value = limit.first()
    at = float(value[0]) if value and value[0] is not None else float("inf")
    test = alarms.k_consecutive(rows.where("split = 'test'").withColumn("alarm_immediate", F.coalesce(F.col("score") >= at, F.lit(False))), F.lit(at), k, "alarm_k_consecutive")
    events = metrics.window_events(test, "alarm_k_consecutive")
    return {
        "windows": test,
        "threshold": windows.sparkSession.createDataFrame([(at,)], "threshold double"),
        "events": events,
        "event_metrics": metrics.event_metrics(events),
        "window_metrics": metrics.confusion(test, "alarm_k_consecutive"),
        "audit": thresholds.score_audit(validation),
    }


def window_cv(windows: DataFrame, features: list[str], folds: DataFrame, k: int, step_sec: float, kind: str = "ledoit_wolf", quantile: float = 0.9999, consecutive: int = 1) -> DataFrame:
    """One row of pooled metrics over all test folds of windows (with kind and group_id)."""
    rows = splits.fold_roles(windows, folds, k)
    models = fit_gaussians(rows.where("role = 'train'"), features, ["test_fold"], kind, windows)
    score = None
    for (fold,), model in sorted(models.items()):
        own = F.col("test_fold") == fold
        score = F.when(own, model.score()) if score is None else score.when(own, model.score())
    rows = rows.where("role in ('validation', 'test')").withColumn("score", score)
    limits = thresholds.normal_quantile(rows.where("role = 'validation'"), quantile, ["test_fold"]).select("test_fold", "threshold")
    test = rows.where("role = 'test'").join(F.broadcast(limits), "test_fold")
    test = alarms.k_consecutive(test, F.col("threshold"), consecutive, "alarm")
    events = metrics.event_metrics(metrics.window_events(test, "alarm"))
    false = metrics.window_false_alarms(test, "alarm", step_sec).withColumn("_k", F.lit(1))
    sample = metrics.confusion(test, "alarm").withColumn("_k", F.lit(1))
    return events.withColumn("_k", F.lit(1)).join(sample, "_k").join(false, "_k").withColumns({"fa_per_hour": F.try_divide(F.col("n_episodes") * 3600.0, F.col("exposure_sec")), "fa_cycle_rate": F.try_divide(F.col("n_fa_groups").cast("double"), F.col("n_groups"))}).drop("_k")


def _by_fold(models: dict[tuple, object]) -> Column:
    """The score by the model of a row's test fold."""
    out = None
    for (fold,), model in sorted(models.items()):
        out = F.when(F.col("test_fold") == fold, model.score()) if out is None else out.when(F.col("test_fold") == fold, model.score())
    if out is None:
        raise ValueError("no fold has training rows")
    return out


def scale_alarms(windows: DataFrame, features: list[str], folds: DataFrame, k: int, kind: str = "ledoit_wolf", quantile: float = 0.9999, consecutive: int = 1) -> DataFrame:
    """The test windows of all folds with `alarm`, by models and thresholds of their fold."""
    rows = splits.fold_roles(windows, folds, k)
    models = fit_gaussians(rows.where("role = 'train'"), features, ["test_fold"], kind, windows)
    scored_rows = rows.where("role in ('validation', 'test')").withColumn("score", _by_fold(models)).persist()
    limits = thresholds.normal_quantile(scored_rows.where("role = 'validation'"), quantile, ["test_fold"]).select("test_fold", "threshold")
    return alarms.k_consecutive(scored_rows.where("role = 'test'").join(F.broadcast(limits), "test_fold"), F.col("threshold"), consecutive, "alarm")


def multi_scale_cv(scales: dict[str, tuple[DataFrame, float, float]], features: list[str], folds: DataFrame, k: int, kind: str = "ledoit_wolf", quantile: float = 0.9999, consecutive: int = 1) -> DataFrame:
    """Metrics of each scale by itself, over all its segments, and of the system in which each segment is judged by the longest
    scale that it has windows of (`system` is `multi`). scales: name -> (windows with kind, window_sec, step_sec)."""
    groups = [w.select("group_id").distinct().withColumn("window_sec", F.lit(sec)) for w, sec, _ in scales.values()]
    longest = functools.reduce(DataFrame.unionByName, groups).groupBy("group_id").agg(F.max("window_sec").alias("_longest"))
    counts, events = [], []
    for name, (windows, window_sec, step_sec) in scales.items():
        test = scale_alarms(windows, features, folds, k, kind, quantile, consecutive)
        routed = test.join(longest.where(F.col("_longest") == window_sec).select("group_id"), "group_id", "left_semi")
        for system, rows in ((name, test), ("multi", routed)):
            own = rows.withColumn("system", F.lit(system))
            counts.append(metrics.fold_counts(own, "alarm", step_sec, ["system", "test_fold"]))
            events.append(metrics.window_events(own, "alarm", ["system", "test_fold"]).withColumn("window_sec", F.lit(window_sec)))
    return metrics.fold_totals(functools.reduce(DataFrame.unionByName, counts), functools.reduce(DataFrame.unionByName, events), ["system"])


def sample_alarms(rows: DataFrame, settings: Settings, folds: DataFrame, k: int, kind: str = "ledoit_wolf", quantile: float = 0.9999, rolling: bool = False, how: str = "mean", least: int | None = None) -> DataFrame:
    """The test rows of all folds with sample_alarm: smoothed scores against the quantile of the fold's validation segments."""
    features = sample_feature_names(settings.channels, rolling)
    inputs = splits.fold_roles(sample_features(rows, settings.channels, rolling), folds, k)
    # a segment is in one role for each test fold
    keyed = inputs.withColumns({"_group": F.col("group_id"), "group_id": F.concat_ws("|", "group_id", F.col("test_fold").cast("string"))})
    models = fit_gaussians(keyed.where("role = 'train'"), features, ["test_fold"], kind, inputs)
    score = alarms.smoothed(F.col("_raw"), settings.smooth, how, least)
    judged = keyed.where("role in ('validation', 'test')").withColumn("_raw", _by_fold(models)).withColumn("score", score).persist()
    limits = thresholds.normal_quantile(judged.where("role = 'validation'"), quantile, ["test_fold"]).select("test_fold", "threshold")
    test = judged.where("role = 'test'").join(F.broadcast(limits), "test_fold")
    return test.withColumns({"sample_alarm": F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False)), "group_id": F.col("_group")}).drop("_group", "_raw")


def sample_cv(rows: DataFrame, settings: Settings, folds: DataFrame, k: int, dt: float, long_sec: float = 1.0, **how) -> DataFrame:
    """One row of metrics of the sample alarms over all test folds; how: as for sample_alarms."""
    return metrics.sample_fold_metrics(sample_alarms(rows, settings, folds, k, **how), "sample_alarm", dt, long_sec, [])


def ensemble_rows(rows: DataFrame, long: DataFrame, short: DataFrame, features: list[str], settings: Settings, folds: DataFrame, k: int, quantile: float = 0.9999, consecutive: int = 2) -> DataFrame:
    """rows with the nine combinations of the alarms of long windows, short windows and samples, all by the models of the fold
    in which the row is tested."""
    out = sample_alarms(rows, settings, folds, k, quantile=quantile).select(*rows.columns, "sample_alarm")
    for name, windows in (("long_alarm", long), ("short_alarm", short)):
        out = alarms.alarms_to_rows(out, scale_alarms(windows, features, folds, k, quantile=quantile, consecutive=consecutive), "alarm", name)
    return alarms.combine(out)


def ensemble_cv(rows: DataFrame, long: DataFrame, short: DataFrame, features: list[str], settings: Settings, folds: DataFrame, k: int, **how) -> DataFrame:
    """Metrics of each of the nine combinations over all test folds."""
    found = ensemble_rows(rows, long, short, features, settings, folds, k, **how).persist()
    return functools.reduce(DataFrame.unionByName, [metrics.raw_alarm_metrics(found, c).withColumn("combination", F.lit(c)) for c in alarms.COMBINATIONS])


def replay_errors(found: DataFrame, windows: DataFrame, alarm: str = "or_3_p2") -> tuple[DataFrame, DataFrame]:
    """What an evaluation gets wrong: the events with detected, delay_sec and duration_sec, and the windows after which normal
    rows alarm (fp_context)."""
    spans = found.where("kind = 'fault'").groupBy("group_id").agg(((F.max("t_us") - F.min("t_us")) / 1e6).alias("duration_sec"))
    return metrics.sample_events(found, alarm).join(spans, "group_id"), alarms.windows_with_alarms(windows, found, alarm, "fp_context")


def _scores(rows: DataFrame, models: dict[tuple[int, int], dict], features: dict[str, list[str]], k: int, repeats: int, settings: Settings) -> DataFrame:
    """Rows once for each fold of each repeat in which they are tested or validate, with the scores of that fold's models.

    rows have folds and all features, which go to Python once; a window model's score is null where its window isn't full.
    """
    keys = ["source", "group_id", "t_us", "seq", "kind", "label"]
    names = sorted({f for own in features.values() for f in own})
    places = {n: [names.index(f) for f in features[n]] for n in NAMES}
    full = [F.col(f"{n}_{settings.channels[0]}_mean").isNotNull().alias(f"_{n}") for n in ("short", "long")]
    out = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in keys) + ", repeat int, test_fold int, role string, sample_raw double, short_score double, long_score double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = len(keys)
            folds = batch.column(at).flatten().to_numpy().reshape(batch.num_rows, -1)
            known = {"sample": np.ones(batch.num_rows, bool), **{n: batch.column(at + 1 + i).to_numpy(zero_copy_only=False) for i, n in enumerate(("short", "long"))}}
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[at + 3 :]])
            normal = np.array(batch.column(keys.index("kind")).to_pylist(), dtype=object) == "normal"
            for r in range(repeats):
                for role, mine, of in (("test", np.ones(len(x), bool), folds[:, r]), ("validation", normal, (folds[:, r] - 1) % k)):
                    for t in range(k):
                        chosen = np.flatnonzero(mine & (of == t))
                        if not len(chosen) or len(models.get((r, t), {})) < len(NAMES):
                            continue
                        found = []
                        for n in NAMES:
                            s = np.full(len(chosen), np.nan)
                            own = known[n][chosen]
                            if own.any():
                                s[own] = models[r, t][n].numpy_score(x[chosen[own]][:, places[n]])
                            found.append(pa.array(s, mask=~own))
                        fixed = [pa.array(np.full(len(chosen), v, np.int32)) for v in (r, t)] + [pa.array([role] * len(chosen))]
                        yield pa.RecordBatch.from_arrays([*(c.take(pa.array(chosen)) for c in batch.columns[:at]), *fixed, *found], [c.split()[0] for c in out.split(", ")])

    return rows.select(*keys, "folds", *full, *(F.col(f).cast("double") for f in names)).mapInArrow(score, out)


def fold_scores(rows: DataFrame, k: int, repeats: int, settings: Settings, kind: str = "ledoit_wolf", seed: int = 0, fold_map=None, features: dict[str, list[str]] | None = None) -> DataFrame:
    """Validation and test rows of each fold of each repeat with the scores of that fold's models (fitted on its training segments).

    One scan fits the models of all folds and repeats of a scale; one more scores the rows by all of them.
    """
    inputs, models, names = fold_fits(rows, k, repeats, settings, kind, seed, fold_map, features)
    return _scores(inputs, models, names, k, repeats, settings)


def fold_fits(rows: DataFrame, k: int, repeats: int, settings: Settings, kind: str = "ledoit_wolf", seed: int = 0, fold_map=None, features: dict[str, list[str]] | None = None) -> tuple[DataFrame, dict[tuple[int, int], dict], dict[str, list[str]]]:
    """rows with folds and features, the models by (repeat, test fold) and name, and the models' features."""
    names = features or features_of(settings)
    wanted = _wanted(names, settings)
    every = with_folds(model_inputs(rows, settings), k, repeats, seed, fold_map)
    inputs = written(every.select(*(c for c in every.columns if c in wanted)), "cv-inputs")
    train = inputs.where("kind = 'normal' and coalesce(idle, 0) <> 1")
    models: dict[tuple[int, int], dict] = {}
    for name in NAMES:
        own = complete(train, name, settings)
        every = complete(inputs, name, settings)
        found = fold_forests(own, names[name], k, repeats, seed=seed, among=every) if kind == "forest" else fold_models(own, names[name], k, repeats, kind, every)
        for key, model in found.items():
            models.setdefault(key, {})[name] = model
    _check_models(models)
    return inputs, models, names


def _wanted(names: dict[str, list[str]], settings: Settings) -> set[str]:
    return {"source", "group_id", "t_us", "seq", "kind", "label", "idle", "folds", *(f for own in names.values() for f in own), *(f"{n}_{settings.channels[0]}_mean" for n in ("short", "long"))}


def _check_models(models: dict[tuple[int, int], dict]) -> None:
    if not any(len(m) == len(NAMES) for m in models.values()):
        raise ValueError("no fold has enough training rows")


def fold_thresholds(scores: DataFrame, settings: Settings, quantiles: tuple[float, ...]) -> DataFrame:
    """repeat, test_fold, quantile and the thresholds of the three detectors, from validation rows: exact, by cells."""
    own = Window.partitionBy("group_id", "repeat", "test_fold").orderBy("t_us", "seq").rowsBetween(1 - settings.smooth, 0)
    ready = F.count(F.lit(1)).over(own) >= settings.smooth
    rows = scores.where("role = 'validation'").withColumn("sample_score", F.when(ready, F.avg("sample_raw").over(own)))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"{n}_score").alias("score")) for n in NAMES)))
    long = rows.select("repeat", "test_fold", each.alias("_e")).select("repeat", "test_fold", "_e.name", "_e.score")
    return _thresholds(long, quantiles)


def _thresholds(long: DataFrame, quantiles: tuple[float, ...]) -> DataFrame:
    return _by_quantile(thresholds.exact_quantiles(long, "score", quantiles, ["repeat", "test_fold", "name"]), quantiles)


def _by_quantile(found: DataFrame, quantiles: tuple[float, ...]) -> DataFrame:
    found = found.groupBy("repeat", "test_fold").agg(*(F.first(F.when(F.col("name") == n, F.col("quantiles")), True).alias(f"_{n}") for n in NAMES))
    places = F.explode(F.array(*(F.struct(F.lit(float(v)).alias("quantile"), *(F.coalesce(F.col(f"_{n}")[i], F.lit(float("inf"))).alias(f"{n}_threshold") for n in NAMES)) for i, v in enumerate(quantiles))))
    return found.select("repeat", "test_fold", places.alias("_p")).select("repeat", "test_fold", "_p.*")


def fold_alarms(scores: DataFrame, limits: DataFrame, settings: Settings) -> DataFrame:
    """Test rows with all alarms, once for each quantile of limits."""
    test = scores.where("role = 'test'").join(F.broadcast(limits), ["repeat", "test_fold"])
    # windows go along a segment for one quantile and repeat; its group id says so for the time being
    key = F.concat_ws("|", "group_id", F.col("quantile").cast("string"), F.col("repeat").cast("string"))
    keyed = test.withColumns({"_group": F.col("group_id"), "group_id": key})
    at: dict[str, Column] = {n: F.col(f"{n}_threshold") for n in NAMES}
    return alarms.derive_alarms(keyed, at, settings).withColumn("group_id", F.col("_group")).drop("_group")


def streaming_cv(rows: DataFrame, settings: Settings, k: int = 5, repeats: int = 5, seed: int = 0, quantiles: tuple[float, ...] = (0.9999,), variants: tuple[str, ...] = ("final_alarm",), kind: str = "ledoit_wolf", fold_map=None, features: dict[str, list[str]] | None = None, digits: int | None = None) -> DataFrame:
    """Metrics by repeat, quantile and variant over all test folds together.

    Repeats, folds, quantiles and variants are columns of one plan. fold_map(rows, k, seed) deals the groups (group_id, fold); by hash
    where it is not given. The rows by themselves: fold_scores, fold_thresholds and fold_alarms.
    digits: decimals at which scores and thresholds are compared, so that rows of equal scores, which sums in another order tell apart in their last
    digits, are on the same side of a threshold.
    """
    names = features or features_of(settings)
    # folds first: the windows' pass leaves the rows in the order of their segments, which blocks keep
    every = model_inputs(with_folds(rows, k, repeats, seed, fold_map), settings)
    every = every.select(*(c for c in every.columns if c in _wanted(names, settings)))
    inputs = written(cv_blocks.blocks(every, settings, ordered=True), "cv-inputs", cv_blocks.GROUP_BLOCKS)
    models = cv_blocks.block_models(inputs, dict(every.dtypes), names, k, repeats, settings, kind, seed)
    _check_models(models)
    kept = written(cv_blocks.scored_blocks(inputs, models, names, k, repeats, settings), "cv-scores", cv_blocks.GROUP_BLOCKS)
    found = _by_quantile(cv_blocks.validation_quantiles(kept, k, repeats, settings, quantiles, digits), quantiles).collect()
    place = {float(q): i for i, q in enumerate(quantiles)}
    limits = {(r["repeat"], r["test_fold"]): np.full((len(quantiles), len(NAMES)), np.inf) for r in found}
    for r in found:
        own = np.array([r[f"{n}_threshold"] for n in NAMES])
        limits[r["repeat"], r["test_fold"]][place[r["quantile"]]] = own if digits is None else np.round(own, digits)
    if not limits:
        raise ValueError("no fold has validation rows")
    return cv_blocks.alarm_table(cv_blocks.block_sums(kept, limits, repeats, settings, variants, digits), quantiles, variants)


def comparison_table(repeats: DataFrame) -> DataFrame:
    """Means and deviations over repeats by quantile and variant, as numbers and as text."""
    measures = ["event_detection_rate", "delay_mean_sec", "sample_f1", "sample_precision", "sample_recall", "normal_fa_cycle_rate", "idle_fa_cycle_rate", "normal_fa_episodes"]
    from tidewatch.functions.scalar import mean_std_text

    out = metrics.mean_and_std(repeats, ["quantile", "variant"], measures)
    return out.withColumns({f"{m}_text": mean_std_text(F.col(f"{m}_mean"), F.col(f"{m}_std"), 4) for m in measures})
