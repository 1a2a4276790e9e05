"""The causal three-scale detector: batch by window functions, streaming by per-series state.

Both score the same models: rows and their first differences smoothed over 3 rows, and window features of the last 5
and 10 rows of the segment. A row alarms finally when the last `persistence` rows of its segment all alarmed.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewatch.functions.scalar import alarm_state, label_of, stream_kind
from tidewatch.operators.alarms import derive_alarms, smoothed
from tidewatch.operators.models import Forest, Gaussian, fit_forest, fit_gaussians, model_from_json
from tidewatch.operators.thresholds import normal_quantile
from tidewatch.operators.windows import count_windows_of, run_features, sample_feature_names
from tidewatch.schema import Settings, feature_names
from tidewatch.sources.scratch import written

NAMES = ("sample", "short", "long")


@dataclass(frozen=True)
class Detector:
    models: dict[str, Gaussian | Forest]
    thresholds: dict[str, float]
    settings: Settings

    def to_json(self) -> str:
        return json.dumps({"models": {k: json.loads(m.to_json()) for k, m in self.models.items()}, "thresholds": self.thresholds, "settings": self.settings.__dict__}, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Detector:
        d = json.loads(text)
        settings = Settings(**{k: tuple(v) if isinstance(v, list) else v for k, v in d["settings"].items()})
        missing = {*NAMES} - {*d["models"]} | {*NAMES} - {*d["thresholds"]}
        if missing:
            raise ValueError(f"not a fitted detector: it lacks {sorted(missing)}")
        return Detector({k: model_from_json(json.dumps(m)) for k, m in d["models"].items()}, d["thresholds"], settings)


def model_inputs(rows: DataFrame, settings: Settings) -> DataFrame:
    """rows with all features: the sample's, and those of both windows, prefixed short_ and long_."""
    return count_windows_of(rows, {"short_": settings.short_size, "long_": settings.long_size}, settings.channels, diffs=True)


def features_of(settings: Settings) -> dict[str, list[str]]:
    names = feature_names(settings.channels)
    return {"sample": sample_feature_names(settings.channels), "short": [f"short_{n}" for n in names], "long": [f"long_{n}" for n in names]}


def complete(inputs: DataFrame, name: str, settings: Settings) -> DataFrame:
    """Rows on which a model can be scored: all for the sample model, those with a full window for the others."""
    return inputs if name == "sample" else inputs.where(F.col(f"{name}_{settings.channels[0]}_mean").isNotNull())


def scored(inputs: DataFrame, models: dict, settings: Settings) -> DataFrame:
    """rows with sample_raw, short_score and long_score (null before a window is full)."""
    names = features_of(settings)
    full = lambda n: F.col(f"{n}_{settings.channels[0]}_mean").isNotNull()
    out = inputs.withColumns({"sample_raw": models["sample"].score(), "short_score": F.when(full("short"), models["short"].score()), "long_score": F.when(full("long"), models["long"].score())})
    return out.drop(*names["short"], *names["long"])


def fit_detector(train: DataFrame, calibration: DataFrame, settings: Settings, kind: str = "ledoit_wolf", seed: int = 0) -> Detector:
    """Models from training segments, thresholds from calibration segments; both normal only. kind may be `forest`."""
    names = features_of(settings)
    # written, as several passes read them
    inputs = written(model_inputs(train, settings), "detector-inputs")
    models = {}
    for name in NAMES:
        own = complete(inputs, name, settings)
        models[name] = fit_forest(own, names[name], seed=seed) if kind == "forest" else fit_gaussians(own.withColumn("_one", F.lit(1)), names[name], ["_one"], kind)[(1,)]
    rows = scored(model_inputs(calibration, settings), models, settings)
    rows = rows.withColumn("sample_score", smoothed(F.col("sample_raw"), settings.smooth))
    rows = written(rows.select(*(f"{n}_score" for n in NAMES), F.lit(0).alias("label")), "calibration-scores")
    thresholds = {}
    for name in NAMES:
        value = normal_quantile(rows, settings.quantile, score=f"{name}_score").first()
        thresholds[name] = float(value["threshold"]) if value and value["threshold"] is not None else float("inf")
    return Detector(models, thresholds, settings)


def detect(rows: DataFrame, detector: Detector) -> DataFrame:
    """All scores and alarms of segmented rows, in one batch."""
    lits: dict[str, Column] = {k: F.lit(v) for k, v in detector.thresholds.items()}
    return derive_alarms(scored(model_inputs(rows, detector.settings), detector.models, detector.settings), lits, detector.settings)


# streaming

STEP = (
    "source string, series string, t_us long, seq long, kind string, ground_truth int, segment_id long, segment_reset boolean, gap_sec double, sample_score double, short_score double, long_score double, "
    "sample_alarm boolean, short_alarm boolean, long_alarm boolean, or_3 boolean, final_alarm boolean, active_detectors array<string>, persistence_count int, note string"
)
#: Series share a state by bucket, so a micro-batch costs a few calls for each bucket and not for each series.
BUCKETS = 256
#: The memories of a bucket's series: source, series and Memory's fields of each.
STATE = "memories string"


def in_buckets(rows: DataFrame, *key: str):
    """rows grouped by the bucket of their series."""
    return rows.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int")).groupBy("_bucket")


@dataclass
class Memory:
    """What is kept of a series: no more rows than the longest window has."""

    last: int | None = None
    segment: int = 0
    times: list[int] = field(default_factory=list)
    rows: list[float] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    history: list[bool] = field(default_factory=list)


def saved(memories: dict[tuple, Memory]) -> str:
    return json.dumps([[*key, m.last, m.segment, m.times, m.rows, m.scores, m.history] for key, m in memories.items()])


def recalled(text: str | None) -> dict[tuple, Memory]:
    return {(source, series): Memory(*kept) for source, series, *kept in json.loads(text or "[]")}


def in_series(frame: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """Rows in the order of their series and times, and where each series begins and the last ends."""
    frame = frame.sort_values(["source", "series", "t_us", "seq"], kind="stable", ignore_index=True)
    code = frame.groupby(["source", "series"], dropna=False, sort=False).ngroup().to_numpy()
    return frame, np.append(np.flatnonzero(np.diff(code, prepend=-1)), len(code))


def step_series(frame: pd.DataFrame, detector: Detector, memories: dict[tuple, Memory], strict: bool = False) -> pd.DataFrame:
    """STEP columns of rows of many series (source, series, t_us, seq, kind, truth, c0, c1 and so on, and perhaps reset), whose memories go on."""
    frame, cuts = in_series(frame)
    n = len(frame)
    times = frame["t_us"].to_numpy(np.int64)
    values = frame[[f"c{i}" for i in range(len(detector.settings.channels))]].to_numpy(float)
    firsts = cuts[:-1]
    source, series = (frame[c].astype(object).where(frame[c].notna(), None).to_numpy()[firsts].tolist() for c in ("source", "series"))
    keys = list(zip(source, series, strict=True))
    begins = np.zeros(n, bool)
    begins[firsts] = True
    anew = frame["reset"].to_numpy(bool) if "reset" in frame else np.zeros(n, bool)
    # a piece is what a series has from its first row or a reset to the next reset
    starts = np.flatnonzero(begins | anew)
    of = np.cumsum(begins)[starts] - 1
    kept = [Memory() if fresh else memories.get(keys[i]) or Memory() for i, fresh in zip(of.tolist(), anew[starts].tolist(), strict=True)]
    out = step_pieces(detector, kept, np.append(starts, n), times, values, strict)
    for i, memory in zip(of.tolist(), kept, strict=True):
        memories[keys[i]] = memory
    truth = pd.to_numeric(frame["truth"]).astype("Int32")
    return pd.DataFrame({**{c: frame[c] for c in ("source", "series", "t_us", "seq", "kind")}, "ground_truth": truth, **out}, columns=[c.split()[0] for c in STEP.split(", ")])


#: Runs of rows that are judged together: some ten megabytes.
RUNS = 65_536


def step_pieces(d: Detector, memories: list[Memory], cuts: np.ndarray, times: np.ndarray, values: np.ndarray, strict: bool = False) -> dict[str, np.ndarray | list]:
    """The detector along many pieces of series at once: piece i is rows cuts[i] to cuts[i + 1], in the order of their times, behind memories[i],
    which is replaced by what is kept behind the piece. Rows older than the last, and rows with unknown channels, change nothing and
    carry a note; strict: they are an error."""
    s, n, pieces = d.settings, len(times), len(memories)
    piece = np.repeat(np.arange(pieces), np.diff(cuts))
    last = np.array([0 if m.last is None else m.last for m in memories], np.int64)
    met = np.array([m.last is not None for m in memories], bool)
    segment = np.array([m.segment for m in memories], np.int64)
    held = np.array([sum(m.history[-s.persistence :]) for m in memories], np.int64)
    known = np.isfinite(values).all(1)
    late = known & met[piece] & (times < last[piece])
    taken = known & ~late
    good = np.flatnonzero(taken)
    if strict and len(good) < n:
        raise ValueError(f"{n - len(good)} rows are late or have unknown channels")
    gap = np.full(n, np.nan)
    gap[late] = (times[late] - last[piece[late]]) / 1e6
    own, t = piece[good], times[good]
    opens = np.append(True, own[1:] != own[:-1])[: len(good)]
    before = np.where(opens, last[own], np.append(0, t[:-1])[: len(good)])
    gap[good] = np.where(opens & ~met[own], np.nan, (t - before) / 1e6)
    starts = gap[good] > s.gap_sec
    reset = np.zeros(n, bool)
    reset[good] = starts
    # a run is a segment's rows here; the first of a piece goes on behind what is in memory unless a gap starts it
    first = np.flatnonzero(opens | starts)
    run = np.cumsum(opens | starts) - 1
    behind = [memories[p] if o and not b else None for p, o, b in zip(own[first].tolist(), opens[first].tolist(), starts[first].tolist(), strict=True)]
    slots = np.array([max(len(m.times), len(m.scores), len(m.history)) if m else 0 for m in behind], np.int64)
    # all rows in one array, those in memory before the run's own
    at = np.arange(len(good)) + np.cumsum(slots)[run] if len(good) else np.zeros(0, np.int64)
    start = (at[first] - slots) if len(good) else np.zeros(0, np.int64)
    size = len(good) + int(slots.sum())
    whole_t, whole = np.zeros(size, np.int64), np.zeros((size, values.shape[1]))
    raw, history = np.zeros(size), np.zeros(size, bool)
    whole_t[at], whole[at] = t, values[good]
    rows_from, scores_from = start.copy(), start.copy()
    for i in np.flatnonzero(slots).tolist():
        m, end = behind[i], int(start[i] + slots[i])
        rows_from[i], scores_from[i] = end - len(m.times), end - len(m.scores)
        whole_t[end - len(m.times) : end] = m.times
        whole[end - len(m.times) : end] = np.array(m.rows, float).reshape(-1, values.shape[1])
        raw[end - len(m.scores) : end] = m.scores
        history[end - len(m.history) : end] = m.history
    scores = {name: np.full(n, np.nan) for name in NAMES}
    scores["sample"][:] = 0.0
    alarm = {name: np.zeros(n, bool) for name in NAMES}
    if len(good):
        previous = whole[np.where(at > rows_from[run], at - 1, at)]
        raw[at] = d.models["sample"].numpy_score(np.hstack([whole[at], whole[at] - previous]))

    def judge(name: str, length: int, since: np.ndarray, score) -> None:
        """Scores of the rows that have `length` rows of their segment, themselves the last, from the places `since` of their runs on."""
        full = np.flatnonzero(at - since[run] >= length - 1) if len(good) else np.zeros(0, np.int64)
        for k in range(0, len(full), RUNS):
            chosen = full[k : k + RUNS]
            found = score(at[chosen])
            scores[name][good[chosen]] = found
            alarm[name][good[chosen]] = found >= d.thresholds[name]

    judge("sample", s.smooth, scores_from, lambda ends: raw[ends[:, None] - np.arange(s.smooth - 1, -1, -1)].mean(axis=1))
    for name, length in (("short", s.short_size), ("long", s.long_size)):
        judge(name, length, rows_from, lambda ends, name=name, length=length: d.models[name].numpy_score(run_features(whole_t, whole, ends, length)))
    any_of = alarm["sample"] | alarm["short"] | alarm["long"]
    history[at] = any_of[good]
    sums = np.append(0, np.cumsum(history))
    number, count, final = segment[piece], held[piece], np.zeros(n, bool)
    if len(good):
        count[good] = sums[at + 1] - sums[np.maximum(at + 1 - s.persistence, start[run])]
        final[good] = count[good] == s.persistence
        breaks = np.cumsum(starts)
        number[good] = segment[own] + breaks - (breaks - starts)[np.maximum.accumulate(np.where(opens, np.arange(len(good)), 0))]
        # a row without effect tells the state that it met: that of the last good row before it, or the one at the start
        idle = np.flatnonzero(~taken)
        place = np.searchsorted(good, idle) - 1
        some = (place >= 0) & (own[np.maximum(place, 0)] == piece[idle])
        number[idle[some]], count[idle[some]] = number[good[place[some]]], count[good[place[some]]]
        ends = np.flatnonzero(np.append(own[1:] != own[:-1], True))
        for p, e, r, own_start, rows_start, scores_start, last_t, segment_now in zip(own[ends].tolist(), (at[ends] + 1).tolist(), run[ends].tolist(), start[run[ends]].tolist(), rows_from[run[ends]].tolist(), scores_from[run[ends]].tolist(), t[ends].tolist(), number[good[ends]].tolist(), strict=True):
            since = max(e - s.long_size, rows_start)
            had = own_start if not slots[r] else own_start + int(slots[r]) - len(behind[r].history)
            memories[p] = Memory(last_t, segment_now, whole_t[since:e].tolist(), whole[since:e].ravel().tolist(), raw[max(e - s.smooth, scores_start) : e].tolist(), history[max(e - s.persistence, had) : e].tolist())
    marks = [[name for bit, name in enumerate(("sample", "0.5s", "1.0s")) if code >> bit & 1] for code in range(8)]
    active = alarm["sample"] + 2 * alarm["short"] + 4 * alarm["long"]
    out: dict[str, np.ndarray | list] = {"segment_reset": reset, "gap_sec": gap}
    out |= {f"{c}_score": scores[c] for c in NAMES} | {f"{c}_alarm": alarm[c] for c in NAMES}
    out |= {"or_3": any_of, "final_alarm": final, "note": np.where(known, np.where(late, "late", None), "invalid")}
    return out | {"segment_id": number, "persistence_count": count, "active_detectors": [marks[code] for code in active.tolist()]}


class Stepper:
    """The detector along one series. Rows older than the last, and rows with unknown channels, change nothing and carry a note;
    strict: they are an error."""

    def __init__(self, detector: Detector, memory: Memory | None = None, strict: bool = False):
        self.d, self.memory, self.strict = detector, memory or Memory(), strict

    def reset(self) -> None:
        """Forgets the series, as before its first row."""
        self.memory = Memory()

    def step(self, t_us: int, values: list[float]) -> dict:
        """One row."""
        return {k: v[0] for k, v in self.many(np.array([t_us]), np.array([values], float)).items()}

    def many(self, times: np.ndarray, values: np.ndarray) -> dict[str, list]:
        """Rows in the order of their times."""
        kept = [self.memory]
        found = step_pieces(self.d, kept, np.array([0, len(times)]), times, values, self.strict)
        self.memory = kept[0]
        return {k: [None if x != x else x for x in (v if isinstance(v, list) else v.tolist())] for k, v in found.items()}


def detect_stream(stream: DataFrame, detector: Detector, strict: bool = False) -> DataFrame:
    """Scores and alarms of a stream of samples (source, series, t_us, seq, channels), by source and series.

    Rows of a micro-batch are put in order of time and scored at once; a row older than the series' last is returned with the
    note `late`, one with an unknown channel with `invalid`; strict: the stream stops at such a row. The state of a series is at
    most as many rows as the longest window; series share BUCKETS states. A stream may lack source (external), state and idle (0): then has no
    ground_truth, which is null. Where a column `reset` is true, the series starts anew with that row.
    """
    channels = detector.settings.channels
    text = detector.to_json()
    given = set(stream.columns)
    optional = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in given else F.lit(default)
    truth = label_of(F.col("state")) if "state" in given else F.lit(None).cast("int")
    source = optional("source", "external")

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memories = recalled(state.get[0] if state.exists else None)
        yield step_series(pd.concat([f for f in frames if len(f)]), known_detector(text), memories, strict)
        state.update((saved(memories),))

    narrow = stream.select(
        source.alias("source"),
        F.col("series").cast("string"),
        "t_us",
        F.col("seq").cast("long"),
        stream_kind(source, optional("state", 0), optional("idle", 0)).alias("kind"),
        truth.alias("truth"),
        optional("reset", False).alias("reset"),
        *(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(channels)),
    )
    return in_buckets(narrow, "source", "series").applyInPandasWithState(advance, STEP, STATE, "append", GroupStateTimeout.NoTimeout)


@functools.lru_cache(maxsize=8)
def known_detector(text: str) -> Detector:
    """A saved detector, read once in each Python worker."""
    return Detector.from_json(text)


def log_columns(steps: DataFrame, samples: DataFrame, detector: Detector, key: tuple[str, ...] = ("source", "series", "t_us", "seq")) -> DataFrame:
    """The stream's log, 30 columns for each row: what came in, scores, thresholds, alarms and the state shown."""
    c = samples.select(*(F.col(k).cast("string") if k == "series" else F.col(k) for k in key), *detector.settings.channels, "state", "idle")
    both = steps.join(c, list(key))
    limit = {n: F.lit(float(v)) for n, v in detector.thresholds.items()}
    scores = [(F.col(f"{n}_score").alias(f"{n}_score"), limit[n].alias(f"{n}_threshold"), F.col(f"{n}_alarm")) for n in NAMES]
    return both.select(
        "source",
        "series",
        "t_us",
        F.timestamp_micros("t_us").alias("timestamp"),
        "seq",
        "kind",
        "ground_truth",
        F.col("idle").alias("Idle"),
        F.col("state").alias("Equipment_state"),
        "segment_id",
        F.concat_ws("_", "source", "series", F.col("segment_id").cast("string")).alias("group_id"),
        "segment_reset",
        "gap_sec",
        *detector.settings.channels,
        *(x for part in scores for x in part),
        "or_3",
        "final_alarm",
        alarm_state(F.col("final_alarm"), F.col("or_3")).alias("shown"),
        F.concat_ws(",", "active_detectors").alias("active_detectors"),
        "note",
    )


def running_counts(steps: DataFrame) -> DataFrame:
    """Of a stream of steps, by source and kind: rows, alarmed rows, late and invalid rows so far. Write it in update or
    complete mode."""
    return steps.groupBy("source", "kind").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("final_alarm").cast("long")).alias("alarm_rows"), F.sum((F.col("note") == "late").cast("long")).alias("late_rows"), F.sum((F.col("note") == "invalid").cast("long")).alias("invalid_rows"))


def write_replay(samples: DataFrame, path: str, part_sec: float) -> None:
    """Writes samples as files that follow each other in time, one for each part_sec of the data, to be replayed."""
    part = F.floor(F.col("t_us") / round(part_sec * 1e6))
    samples.withColumn("part", part).repartitionByRange("part").sortWithinPartitions("t_us", "seq").write.partitionBy("part").parquet(path)


def replay(samples: DataFrame, path: str):
    """A stream over files of samples written part by part (write_replay): one part for each trigger. A trigger interval of
    part_sec replays at the pace of the data, a shorter one faster."""
    spark = samples.sparkSession
    return spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def feature_snapshot(rows: DataFrame, settings: Settings) -> DataFrame:
    """The window features of both sizes at each row, for display."""
    return model_inputs(rows, settings).select("group_id", "t_us", "seq", *features_of(settings)["short"], *features_of(settings)["long"])


