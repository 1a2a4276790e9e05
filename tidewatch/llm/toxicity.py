"""Toxicity by a convolutional text classifier, trained in numpy.

A word's embedding is the sum of hashed rows for the word and its first 3 to 7 bytes, so inflected forms share most of
it. Filters of widths 1, 2 and 3 run over the words, each is max-pooled over the whole text and passed through a ReLU, and a
logistic layer gives a margin. Max pooling sends each filter's gradient to one place, so a training step touches few rows.
A quarter of the sample is kept from training to calibrate: the margin at which both classes are
told apart best becomes score 0.3, for each language by itself where it has enough of both labels. The language is
told from the text by its common words; labels, lang, source and doc_id are never inputs of a score.

Scoring keeps, for each word met, the products of its embedding with all filter columns; a text is a gather, shifted
sums and maxima. Fitted on a bounded sample (labelled.MAX_ROWS, MAX_BYTES); every row is scored on its whole text.

Nulls: a null text is scored as the empty text, which has the score of zero pools. A null doc_id is kept. Repeated rows
are scored alike. With no labelled rows, or one class only, every score is that class (0 without rows). An empty table
gives no rows. Other columns are kept by drop_toxic and ignored elsewhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidewatch.llm.common import new_name
from tidewatch.llm.labelled import AT_CUT, CUT, N_LANGUAGES, WORD_BYTES, best_threshold, fit_in_task, fold, language_of, sample_rows, sigmoid, slope

MODULUS, HELD_OUT = 4, 2
BUCKETS = 1 << 16
DIMENSION = 16
WIDTHS = (1, 2, 3)
FILTERS = 10
#: Steps of training, and passes over the sample at most.
STEPS, PASSES = 30_000, 40
#: Training ends when the mean error over so many steps falls below this.
SETTLED_STEPS, SETTLED = 2_000, 0.01
#: Words whose products one Python worker keeps.
CACHE_WORDS = 150_000
PREFIXES = (3, 4, 5, 6, 7)
#: Labels of both kinds that a language needs for a threshold of its own.
ENOUGH = 40


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


def rows_of(word: bytes) -> list[int]:
    """The embedding rows of a word: itself and its first bytes; row 0 stays zero."""
    out = [zlib.crc32(word, 1) % (BUCKETS - 1) + 1]
    out += [zlib.crc32(word[:k], k) % (BUCKETS - 1) + 1 if len(word) > k - 1 else 0 for k in PREFIXES]
    return out


class Net:
    """Embedding, filters (for each width a list of matrices by place) and the output layer."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.embedding = rng.normal(0, 0.05, (BUCKETS, DIMENSION)).astype(np.float32)
        self.embedding[0] = 0
        self.filters = [[rng.normal(0, 0.3, (DIMENSION, FILTERS)).astype(np.float32) for _ in range(w)] for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.out_bias = np.float32(-1.0)
        self.thresholds = np.zeros(N_LANGUAGES)
        self.scale = 1.0

    def pool(self, parts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Maxima of all filters, before the bias, and where they are. parts: a row for each word with the products."""
        n, at = len(parts), 0
        tops, places = [], []
        for w in WIDTHS:
            rows = max(1, n - w + 1)
            total = np.zeros((rows, FILTERS), np.float32)
            for j in range(w):
                piece = parts[j : j + rows, at : at + FILTERS]
                total[: len(piece)] += piece
                at += FILTERS
            best = total.argmax(0)
            places.append(best)
            tops.append(total[best, np.arange(FILTERS)])
        return np.concatenate(tops), places

    def columns(self) -> np.ndarray:
        return np.concatenate([m for by_place in self.filters for m in by_place], axis=1)

    def margin(self, parts: np.ndarray) -> float:
        top, _ = self.pool(parts)
        return float(np.maximum(top + self.bias, 0) @ self.out + self.out_bias)

    def train(self, docs: list[np.ndarray], rows_of_word: np.ndarray, y: np.ndarray, steps: int, seed: int = 0, rate: float = 0.05) -> None:
        """AdaGrad on single documents, the rarer class weighted up. docs: word numbers; rows_of_word: their embedding rows."""
        rng = np.random.default_rng(seed)
        squares = np.full(BUCKETS, 1e-3, np.float32)
        state = {k: np.full(np.shape(v), 1e-3, np.float32) for k, v in (("bias", self.bias), ("out", self.out), ("out_bias", self.out_bias))}
        fsq = [[np.full(m.shape, 1e-3, np.float32) for m in by_place] for by_place in self.filters]
        share = min(max(y.mean(), 0.05), 0.95)
        order = np.concatenate([rng.permutation(len(docs)) for _ in range(-(-steps // len(docs)))])[:steps]
        error = 0.0
        for step, i in enumerate(order):
            if step % SETTLED_STEPS == 0:
                if step and error / SETTLED_STEPS < SETTLED:
                    break
                error = 0.0
            rows = rows_of_word[docs[i]]
            e = self.embedding[rows].sum(1)
            top, places = self.pool(e @ self.columns())
            act = np.maximum(top + self.bias, 0)
            p = sigmoid(act @ self.out + self.out_bias)
            g = np.float32((p - y[i]) * (0.5 / share if y[i] else 0.5 / (1 - share)))
            error += abs(p - y[i])
            if abs(g) < 1e-3:
                continue
            g_act = g * self.out * (act > 0)
            for name, grad in (("out", g * act), ("out_bias", g), ("bias", g_act)):
                state[name] += grad * grad
                setattr(self, name, getattr(self, name) - rate * grad / np.sqrt(state[name]))
            for k, w in enumerate(WIDTHS):
                gk = g_act[k * FILTERS : (k + 1) * FILTERS]
                live = np.flatnonzero(gk)
                for j in range(w):
                    at = places[k][live] + j
                    inside = at < len(rows)
                    f, at = live[inside], at[inside]
                    if not len(f):
                        continue
                    m = self.filters[k][j]
                    grad_m = e[at].T * gk[f]
                    grad_e = m[:, f].T * gk[f, None]
                    fsq[k][j][:, f] += grad_m * grad_m
                    m[:, f] -= rate * grad_m / np.sqrt(fsq[k][j][:, f])
                    touched, each = rows[at].ravel(), np.repeat(grad_e, rows.shape[1], 0)
                    np.add.at(squares, touched, (each * each).mean(1))
                    np.subtract.at(self.embedding, touched, rate * each / np.sqrt(squares[touched])[:, None])
            self.embedding[0] = 0


class Scorer:
    """Scores texts with a net, keeping the products of words."""

    def __init__(self, net: Net):
        self.net, self.matrix = net, net.columns()
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.table = np.zeros((4096, self.matrix.shape[1]), np.float32)

    def look_up(self, words: list[bytes]) -> np.ndarray:
        if len(self.number) > CACHE_WORDS:
            self.forget()
        number = self.number
        new = [w for w in dict.fromkeys(words) if w not in number]
        if new:
            first = len(number)
            for w in new:
                number[w] = len(number)
            while len(number) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[first : first + len(new)] = self.net.embedding[np.array([rows_of(w) for w in new])].sum(1) @ self.matrix
        return self.table[np.fromiter(map(number.__getitem__, words), np.int32, len(words))]

    def margin(self, text: str | None) -> tuple[float, int]:
        found = words(text)
        return self.net.margin(self.look_up(found)), language_of(found)

    def score(self, text: str | None) -> float:
        margin, language = self.margin(text)
        return float(sigmoid(self.net.scale * (margin - self.net.thresholds[language]) + AT_CUT))


def fit(texts: list[str], y: np.ndarray, seed: int = 0) -> Net | float:
    """A net with calibrated thresholds, or the constant score where there is one class at most."""
    if len(set(y.tolist())) < 2:
        return float(y[0]) if len(y) else 0.0
    rng = np.random.default_rng(seed)
    # the part for calibration has its share of both classes; with few rows of a class it is used for both
    kept = np.zeros(len(y), bool)
    for c in (0, 1):
        own = rng.permutation(np.flatnonzero(y == c))
        kept[own[: len(own) // 4]] = len(own) >= 8
    net = Net(seed)
    number: dict[bytes, int] = {b"": 0}  # a text without words has one of no rows
    docs = [np.array([number.setdefault(w, len(number)) for w in words(t)] or [0], np.int32) for t, k in zip(texts, kept, strict=True) if not k]
    rows_of_word = np.array([[0] * (1 + len(PREFIXES)), *(rows_of(w) for w in list(number)[1:])], np.int32)
    net.train(docs, rows_of_word, y[~kept], min(STEPS, PASSES * len(docs)), seed)
    if len(set(y[kept].tolist())) < 2:
        kept[:] = True
    scorer = Scorer(net)
    found = [scorer.margin(t) for t, k in zip(texts, kept, strict=True) if k]
    margins, languages, truth = np.array([m for m, _ in found]), np.array([k for _, k in found]), y[kept]
    net.thresholds[:] = best_threshold(margins, truth)
    for k in range(N_LANGUAGES):
        own = languages == k
        if min((truth[own] == 0).sum(), (truth[own] == 1).sum()) >= ENOUGH:
            net.thresholds[k] = best_threshold(margins[own], truth[own])
    shifted = margins - net.thresholds[languages]
    net.scale = slope(shifted, truth, 0.0)
    return net


def train_on(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Net | float:
    return fit_in_task(sample_rows(docs, labels, label, MODULUS, HELD_OUT), fit)


def with_score(docs: DataFrame, model: Net | float, column: str = "score") -> DataFrame:
    """docs with the score of each row's text in one more column, of a name that docs doesn't have."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if isinstance(shared.value, Net) else None
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            scores = [scorer.score(t.as_py()) if scorer else shared.value for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], [*batch.schema.names[:-1], column])

    rows = docs.withColumn(new_name(docs, "_text"), F.col("text").cast("string"))
    schema = StructType([*docs.schema.fields, StructField(column, DoubleType())])
    return rows.mapInArrow(score, schema)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs."""
    scored = with_score(docs.select("doc_id", "text"), train_on(docs, labels))
    return scored.select("doc_id", F.coalesce(fold(MODULUS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't predicted toxic."""
    score = new_name(docs, "_toxicity")
    return with_score(docs, train_on(docs, labels), score).where(F.col(score) < CUT).drop(score)
