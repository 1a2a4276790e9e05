"""Labelled rows for the classifiers: a bounded sample to fit on, and what both share in fitting and scoring."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import LOWER, UPPER, materialize

#: A classifier is fitted on at most about so many labelled rows, and on whole texts of so many bytes in all.
MAX_ROWS = 12_000
MAX_BYTES = 24_000_000
#: A score of CUT or more is predicted 1; scores are shifted so that the best threshold lies there.
CUT = 0.3
_SLICES = 1 << 20


def fold(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo modulus; null without a doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def sample_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """slice, doc_id, text, label (0 or 1) of labelled documents outside the held-out fold; the same rows for the same input.

    Rows of one doc_id and text count once. Where there are more than max_rows, those with the smallest hashes of doc_id are taken, and of
    these as many whole texts as max_bytes allows: what doesn't fit any more is passed over by itself. Null texts and labels are left out.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(modulus) != held_out)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    known = known.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(_SLICES)))
    share = min(1.0, max_rows / max(1, known.count()))
    # about max_rows small rows: the bound of the broadcast
    chosen = known.where(F.col("slice") < int(share * _SLICES) if share < 1 else F.lit(True))
    found = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    found = found.select("slice", "doc_id", F.octet_length("text").alias("n"), F.sha2("text", 256).alias("digest"), "text", "label")
    rows = materialize(found.dropDuplicates(["doc_id", "digest"]), "labelled")
    # the first max_rows rows without their texts, so any number of texts of one doc_id is bounded too
    first = rows.select("slice", "doc_id", "n", "digest").orderBy("slice", "doc_id", "digest").limit(max_rows).collect()
    total, taken = 0, []
    for r in first:
        if total + r["n"] <= max_bytes:
            total += r["n"]
            taken.append((r["doc_id"], r["digest"]))
    fit = docs.sparkSession.createDataFrame(taken, rows.select("doc_id", "digest").schema)
    return rows.join(F.broadcast(fit), ["doc_id", "digest"]).select("slice", "doc_id", "text", "label")


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> tuple[list[str], np.ndarray]:
    """The texts and labels of sample_rows, in a fixed order."""
    got = sample_rows(docs, labels, label, modulus, held_out, max_rows, max_bytes).orderBy("slice", "doc_id", "text").select("text", "label").collect()
    return [r["text"] for r in got], np.array([r["label"] for r in got], dtype=np.int64)


def fit_in_task(rows: DataFrame, fit: Callable[[list[str], np.ndarray], object]) -> object:
    """What fit(texts, labels) returns for the rows of a sample, called in one task: the sample is bounded, and the driver
    gets the model only."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str] = []
        y: list[int] = []
        for batch in batches:
            texts += batch.column(2).to_pylist()
            y += batch.column(3).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, np.array(y, dtype=np.int64)))], pa.binary())], ["model"])

    got = rows.repartition(1).sortWithinPartitions("slice", "doc_id", "text").mapInArrow(train, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else fit([], np.zeros(0, np.int64))


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def best_threshold(margins: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap at which the mean of the two classes' hit rates is largest."""
    order = np.argsort(margins, kind="stable")
    m, t = margins[order], y[order]
    below = np.concatenate([[0], np.cumsum(t == 0)]) / max(1, (y == 0).sum()) + np.concatenate([np.cumsum((t == 1)[::-1])[::-1], [0]]) / max(1, (y == 1).sum())
    edges = np.concatenate([[m[0] - 1.0], (m[1:] + m[:-1]) / 2, [m[-1] + 1.0]])
    below[1:-1][m[1:] == m[:-1]] = -1
    best = np.flatnonzero(below >= below.max() - 1e-12)
    return float(edges[best[len(best) // 2]])


def slope(margins: np.ndarray, y: np.ndarray, threshold: float) -> float:
    """The scale that makes sigmoid(scale * (margin - threshold)) fit y best, of a few from flat to steep."""
    spread = float(np.std(margins)) or 1.0
    scales = [s / spread for s in (0.25, 0.5, 1.0, 2.0, 4.0, 8.0)]
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))

    def loss(s: float) -> float:
        p = np.clip(sigmoid(s * (margins - threshold)), 1e-6, 1 - 1e-6)
        return float(-(weight * np.where(y == 1, np.log(p), np.log(1 - p))).sum())

    return min(scales, key=loss)


#: The logit of CUT: where a margin equal to its threshold goes.
AT_CUT = float(np.log(CUT / (1 - CUT)))

#: Common words of some languages, to tell a text's language by (fixed values).
COMMON_WORDS = {
    "de": "der die das und ist nicht ein eine zu den von mit sich des auf für im dem auch als",
    "en": "the of and to in is that it for was with as on by are this be at from or",
    "es": "el los las que y del se por con una su para es al lo como más o pero un",
    "fr": "le les et des du une dans qui est pour pas au sur par plus ce il sont avec aux",
}
_LANGUAGES = sorted(COMMON_WORDS)
_OF_WORD: dict[bytes, int] = {}
for _i, _k in enumerate(_LANGUAGES):
    for _w in COMMON_WORDS[_k].encode().split():
        _OF_WORD.setdefault(_w, _i)
N_LANGUAGES = len(_LANGUAGES) + 1
#: Lower-cases A-Z, keeps digits, a-z and bytes of non-ASCII characters, makes all else a space.
WORD_BYTES = bytes((UPPER + LOWER).find(chr(b)) % 26 + 97 if chr(b) in UPPER + LOWER else b if 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def language_of(words: list[bytes]) -> int:
    """The language whose common words are most frequent, the last number for none."""
    counts = [0] * len(_LANGUAGES)
    for w in words:
        if len(w) < 6 and (k := _OF_WORD.get(w)) is not None:
            counts[k] += 1
    best = max(counts)
    return counts.index(best) if best else len(_LANGUAGES)
