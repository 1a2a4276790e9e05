"""Quality by naive Bayes support vectors.

Features are indicators of hashed n-grams of a whole text: its words, and runs of one, two and three word shapes
(letters are told by case only, digits are one sign, other signs stay, a word equal to the one before is a sign of its
own). Each indicator is scaled by the log ratio of its smoothed shares in the two classes, and a linear hinge-loss model
is fitted to the scaled indicators, of unit length, by dual coordinate descent. A quarter of the sample is kept from fitting to put the
best threshold at score 0.3.

Fitted on a bounded sample (labelled.MAX_ROWS, MAX_BYTES); every row is scored on its whole text. labels, lang, source
and doc_id are never inputs of a score.

Nulls: a null text is scored as the empty text, which has one feature of its own. A null doc_id is kept. Repeated rows
are scored alike. With no labelled rows, or one class only, every score is that class (1 without rows). An empty table gives no rows.
Other columns are kept by drop_low_quality and ignored elsewhere.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidewatch.llm.common import new_name
from tidewatch.llm.labelled import AT_CUT, CUT, best_threshold, fit_in_task, fold, sample_rows, sigmoid, slope

MODULUS, HELD_OUT = 5, 0
BUCKETS = 1 << 18
PASSES = 30
#: Words whose numbers one Python worker keeps.
CACHE_WORDS = 400_000
_RUNS = re.compile(rb"(.)\1+")
_KINDS = bytes(ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else b for b in range(256))
_SAME = np.uint64(7919)


class Features(dict):
    """Word -> (word bucket, shape number) packed into one integer, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        text = word.decode(errors="replace")
        cased = bytes(word.translate(_KINDS)) if word.isascii() else "".join("A" if c.isupper() else "a" if c.isalpha() else c for c in text).encode().translate(_KINDS)
        shape = zlib.crc32(_RUNS.sub(rb"\1", cased))
        self[word] = value = (zlib.crc32(word) % BUCKETS) << 32 | shape
        return value

    def of(self, text: str | None) -> np.ndarray:
        """The sorted distinct features of a text."""
        found = (text or "").encode().split()
        if not found:
            return np.zeros(1, np.int32)
        both = np.fromiter(map(self.__getitem__, found), np.uint64, len(found))
        unit = both >> np.uint64(32)
        s = both & np.uint64(0xFFFFFFFF)
        same = both[1:] == both[:-1]
        s[1:][same] = _SAME
        a = s * np.uint64(0x9E3779B97F4A7C15)
        parts = [unit, a >> np.uint64(46)]
        if len(a) > 1:
            b = (a[:-1] ^ (s[1:] + np.uint64(1))) * np.uint64(0xBF58476D1CE4E5B9)
            parts.append(b >> np.uint64(46))
            if len(a) > 2:
                parts.append(((b[:-1] ^ (s[2:] + np.uint64(3))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(46))
        # the same n-gram order shares no bucket space on purpose: 2**18 buckets for each of the four kinds
        return np.unique(np.concatenate([p.astype(np.int32) + np.int32(k * BUCKETS) for k, p in enumerate(parts)]))


KINDS = 4


class Model:
    """Weights of plain indicators, the ratios that scale them, and the calibration."""

    def __init__(self, weights: np.ndarray, ratio: np.ndarray, bias: float):
        self.weights, self.ratio, self.bias, self.threshold, self.scale = weights, ratio, bias, 0.0, 1.0

    def margin(self, features: np.ndarray) -> float:
        """The margin of a text; its scaled indicators are of unit length, as in fitting."""
        v = self.ratio[features]
        return float(self.weights[features].sum() / (np.sqrt(v @ v) or 1.0) + self.bias)


def log_count_ratios(docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """For each feature the log ratio of its smoothed shares in class 1 and class 0."""
    counts = np.ones((2, KINDS * BUCKETS))
    for x, c in zip(docs, y, strict=True):
        counts[c, x] += 1
    return np.log(counts[1] / (1 + (y == 1).sum())) - np.log(counts[0] / (1 + (y == 0).sum()))


def dual_coordinate_descent(docs: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, c: float = 1.0, passes: int = PASSES, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights (for plain indicators) and bias of the hinge-loss model over scaled indicators; classes weigh the same."""
    rng = np.random.default_rng(seed)
    w, bias = np.zeros(len(ratio)), 0.0
    sign = np.where(y == 1, 1.0, -1.0)
    cost = c * len(y) * np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    values = [ratio[x].astype(np.float32) for x in docs]
    values = [v / (np.sqrt(v @ v) or 1.0) for v in values]
    alpha = np.zeros(len(docs))
    for _ in range(passes):
        worst = 0.0
        for i in rng.permutation(len(docs)):
            x, v = docs[i], values[i]
            gradient = sign[i] * (w[x] @ v + bias) - 1.0
            new = min(max(alpha[i] - gradient / (v @ v + 1.0), 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                worst = max(worst, abs(new - alpha[i]) / max(cost[i], 1e-12))
                alpha[i] = new
                w[x] += step * v
                bias += step
        if worst < 1e-3:
            break
    return w, bias


def fit(texts: list[str], y: np.ndarray, seed: int = 0) -> Model | float:
    """A calibrated model, or the constant score where there is one class at most."""
    if len(set(y.tolist())) < 2:
        return float(y[0]) if len(y) else 1.0
    features = Features()
    docs = [features.of(t) for t in texts]
    rng = np.random.default_rng(seed)
    kept = np.zeros(len(y), bool)
    for c in (0, 1):
        own = rng.permutation(np.flatnonzero(y == c))
        kept[own[: len(own) // 4]] = len(own) >= 8
    fitted = [x for x, k in zip(docs, kept, strict=True) if not k]
    ratio = log_count_ratios(fitted, y[~kept])
    weights, bias = dual_coordinate_descent(fitted, y[~kept], ratio, seed=seed)
    model = Model((weights * ratio).astype(np.float32), ratio.astype(np.float32), bias)
    if len(set(y[kept].tolist())) < 2:
        kept[:] = True
    margins = np.array([model.margin(x) for x, k in zip(docs, kept, strict=True) if k])
    model.threshold = best_threshold(margins, y[kept])
    model.scale = slope(margins, y[kept], model.threshold)
    return model


def train_on(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model | float:
    return fit_in_task(sample_rows(docs, labels, label, MODULUS, HELD_OUT), fit)


def with_score(docs: DataFrame, model: Model | float, column: str = "score") -> DataFrame:
    """docs with the score of each row's text in one more column, of a name that docs doesn't have."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, features = shared.value, Features()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            if isinstance(model, float):
                scores = [model] * len(texts)
            else:
                margins = np.array([model.margin(features.of(t.as_py())) for t in texts])
                scores = sigmoid(model.scale * (margins - model.threshold) + AT_CUT)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], [*batch.schema.names[:-1], column])

    rows = docs.withColumn(new_name(docs, "_text"), F.col("text").cast("string"))
    schema = StructType([*docs.schema.fields, StructField(column, DoubleType())])
    return rows.mapInArrow(score, schema)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs."""
    scored = with_score(docs.select("doc_id", "text"), train_on(docs, labels))
    return scored.select("doc_id", F.coalesce(fold(MODULUS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are predicted to be of good quality."""
    score = new_name(docs, "_quality")
    return with_score(docs, train_on(docs, labels), score).where(F.col(score) >= CUT).drop(score)
