"""Normal-only models: squared Mahalanobis distance with shrunk covariance, and isolation forests.

A model is a small driver-side object; its score is a Column, evaluated in the JVM for the distance and by one Arrow batch
function for forests.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from tidewatch.functions.scalar import signed_log1p


def signed_log(x: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.log1p(np.abs(x))


class ScoreModel(Protocol):
    """What a detector asks of a model."""

    def score(self, columns: dict[str, Column] | None = None) -> Column: ...


@dataclass(frozen=True)
class Gaussian:
    """Location and precision over transformed features; medians stand in for unknown ones."""

    features: list[str]
    location: list[float]
    precision: list[list[float]]
    medians: list[float]
    shrinkage: float = 0.0
    rows: int = 0
    kind: str = "ledoit_wolf"

    def inputs(self, columns: dict[str, Column] | None = None) -> list[Column]:
        get = lambda f: (columns or {}).get(f, F.col(f))
        return [signed_log1p(F.coalesce(get(f), F.lit(m))) for f, m in zip(self.features, self.medians, strict=True)]

    def score(self, columns: dict[str, Column] | None = None) -> Column:
        """The squared distance: a sum over the upper triangle, compiled with the plan around it."""
        d = [x - F.lit(m) for x, m in zip(self.inputs(columns), self.location, strict=True)]
        total = None
        for i, x in enumerate(d):
            row = x * F.lit(self.precision[i][i])
            for j in range(i + 1, len(d)):
                row = row + d[j] * F.lit(2 * self.precision[i][j])
            total = x * row if total is None else total + x * row
        return total

    def numpy_score(self, x: np.ndarray) -> np.ndarray:
        return self.logged_score(signed_log(x))

    def logged_score(self, x: np.ndarray) -> np.ndarray:
        """numpy_score of features whose signed logs are taken already, as for many models at once; NaN where unknown."""
        d = np.where(np.isnan(x), signed_log(np.array(self.medians)), x) - np.array(self.location)
        return ((d @ np.array(self.precision)) * d).sum(axis=1)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Gaussian:
        return Gaussian(**json.loads(text))


def shrink(s: np.ndarray, n: int, q4: float, kind: str) -> tuple[np.ndarray, float]:
    """The covariance s (divisor n) shrunk towards the mean variance; q4: the sum of ||x||^4 of the centred rows."""
    p = len(s)
    mean = np.trace(s) / p
    if kind == "empirical":
        share = 0.0
    elif kind == "ledoit_wolf":
        d2 = ((s - mean * np.eye(p)) ** 2).sum() / p
        b2 = min(q4 / (p * n * n) - (s**2).sum() / (p * n), d2)
        share = max(0.0, b2) / d2 if d2 > 0 else 0.0
    elif kind == "oas":
        trace2, squares = np.trace(s) ** 2, (s**2).sum()
        below = (n + 1 - 2 / p) * (squares - trace2 / p)
        share = min(1.0, ((1 - 2 / p) * squares + trace2) / below) if below > 0 else 1.0
    else:
        raise ValueError(f"unknown covariance {kind}")
    return (1 - share) * s + share * mean * np.eye(p), float(share)


def open_features(among: DataFrame, features: list[str]) -> list[int]:
    """The numbers of the features that some row of among doesn't know."""
    unknown = among.agg(*(F.sum(F.col(f).isNull().cast("long")).alias(f"_{i}") for i, f in enumerate(features))).first()
    return [i for i in range(len(features)) if unknown[f"_{i}"]]


def exact_medians(rows: DataFrame, features: list[str], numbers: list[int], by: list[str]) -> dict[tuple, float]:
    """(*by, feature's number) -> the median of what is known of it, by cells of values: no task holds all values of a feature."""
    from tidewatch.operators.thresholds import exact_quantiles

    if not numbers:
        return {}
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("feature"), F.col(features[i]).cast("double").alias("v")) for i in numbers)))
    found = exact_quantiles(rows.select(*by, each.alias("_e")).select(*by, "_e.feature", "_e.v"), "v", (0.5,), [*by, "feature"])
    return {(*(r[c] for c in by), r["feature"]): float(r["quantiles"][0]) for r in found.collect()}


def _in_groups(batch: pa.RecordBatch, k: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """The groups of a batch by its first k columns, each with the values of its rows in the others."""
    values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[k:]])
    code = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns[:k]:
        own = c.dictionary_encode(null_encoding="encode")
        code = np.unique(code * len(own.dictionary) + own.indices.to_numpy(), return_inverse=True)[1]
    for number, first in enumerate(np.unique(code, return_index=True)[1].tolist()):
        yield tuple(c[first].as_py() for c in batch.columns[:k]), values[code == number]


def _merged(a: tuple | None, b: tuple) -> tuple:
    """Rows, means and centred products of two sets of rows together."""
    if a is None:
        return b
    n, d = a[0] + b[0], b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


def _moments(x: DataFrame, by: list[str]) -> dict[tuple, tuple[int, np.ndarray, np.ndarray]]:
    """Of each group its rows, means and covariances (divisor n): each task sends one row for each group it meets."""
    k, p = len(by), len(x.columns) - len(by)
    schema = StructType([*x.select(*by).schema.fields, StructField("n", LongType()), StructField("mean", ArrayType(DoubleType())), StructField("products", ArrayType(DoubleType()))])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kept = {}, None
        for batch in batches:
            if not batch.num_rows:
                continue
            kept = batch.schema
            for key, v in _in_groups(batch, k):
                mean = v.mean(0)
                total[key] = _merged(total.get(key), (len(v), mean, (v - mean).T @ (v - mean)))
        if total:
            keys = [pa.array([key[i] for key in total], kept.field(i).type) for i in range(k)]
            lists = [pa.array([t[j].ravel().tolist() for t in total.values()], pa.list_(pa.float64())) for j in (1, 2)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array([t[0] for t in total.values()]), *lists], [f.name for f in schema])

    out: dict[tuple, tuple] = {}
    for r in x.mapInArrow(sums, schema).collect():
        key = tuple(r[:k])
        out[key] = _merged(out.get(key), (r["n"], np.array(r["mean"]), np.array(r["products"]).reshape(p, p)))
    return {key: (n, mean, products / n) for key, (n, mean, products) in out.items()}


def _fourth_moments(x: DataFrame, by: list[str], means: dict[tuple, np.ndarray]) -> dict[tuple, float]:
    """Of each group the sum of ||x - mean||^4."""
    k = len(by)
    schema = StructType([*x.select(*by).schema.fields, StructField("fourth", DoubleType())])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kept = {}, None
        for batch in batches:
            if not batch.num_rows:
                continue
            kept = batch.schema
            for key, v in _in_groups(batch, k):
                total[key] = total.get(key, 0.0) + float((((v - means[key]) ** 2).sum(1) ** 2).sum())
        if total:
            yield pa.RecordBatch.from_arrays([*(pa.array([key[i] for key in total], kept.field(i).type) for i in range(k)), pa.array(list(total.values()))], [f.name for f in schema])

    found = x.mapInArrow(sums, schema)
    return {tuple(r[:k]): float(r[k]) for r in found.groupBy(*by).agg(F.sum("fourth")).collect()}


def fit_gaussians(rows: DataFrame, features: list[str], by: list[str], kind: str = "ledoit_wolf", among: DataFrame | None = None) -> dict[tuple, Gaussian]:
    """A model for each group of `by`.

    among: all rows that the models will score. Only features that some of them doesn't know need a median, which stands in for
    them; without it all features have one. One pass gives means and covariances, Ledoit-Wolf shrinkage needs one more for the fourth moment
    about the mean. A group's moments are p * (p + 3) / 2 numbers.
    """
    n_of = len(features)
    numbers = list(range(n_of)) if among is None else open_features(among, features)
    medians = exact_medians(rows, features, numbers, by)
    keys = sorted({key[:-1] for key in medians}, key=str)
    middle = {key: [medians.get((*key, i), 0.0) for i in range(n_of)] for key in keys}
    of = lambda name: [StructField(f"{name}{i}", DoubleType()) for i in range(n_of)]
    by_fields = rows.select(*by).schema.fields
    value = [F.col(f).cast("double") for f in features]
    source = rows
    if middle:
        table = rows.sparkSession.createDataFrame([(*key, *m) for key, m in middle.items()], StructType([*by_fields, *of("_m")]))
        source = rows.join(F.broadcast(table), by)
        value = [F.coalesce(v, F.col(f"_m{i}")) for i, v in enumerate(value)]
    x = source.select(*by, *(signed_log1p(v).alias(f"_x{i}") for i, v in enumerate(value)))
    out = _moments(x, by)
    fourth = dict.fromkeys(out, 0.0)
    if kind == "ledoit_wolf":
        fourth |= _fourth_moments(x, by, {key: location for key, (_, location, _) in out.items()})
    models = {}
    for key, (n, location, s) in out.items():
        covariance, share = shrink(s, n, fourth[key], kind)
        models[key] = Gaussian(list(features), location.tolist(), np.linalg.pinv(covariance, hermitian=True).tolist(), middle.get(key, [0.0] * n_of), share, int(n), kind)
    return models


def fit_gaussian(rows: DataFrame, features: list[str], kind: str = "ledoit_wolf", among: DataFrame | None = None) -> Gaussian:
    found = fit_gaussians(rows.withColumn("_one", F.lit(1)), features, ["_one"], kind, among)
    if not found:
        raise ValueError("no rows to fit on")
    return found[(1,)]


def _average_path(n: float) -> float:
    """The mean depth of an unsuccessful search in a tree of n points."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


#: Rows that a forest scores at a time: so many that calls cost little each; the comparisons with all cuts take some tens of megabytes.
SCORED_ROWS = 1 << 16


def _above(rank: np.ndarray, cuts: int) -> list[np.ndarray | None]:
    """For each number k from 1 to cuts which ranks are at least k, 64 rows in a word.

    Ranks are halved as in a binary search, all rows at once: of the rows whose rank is in a range, those in its upper half have the next bit.
    """
    out: list[np.ndarray | None] = [None] * (cuts + 1)
    whole = np.zeros(-(-len(rank) // 64) * 64, np.uint32)
    whole[: len(rank)] = rank
    bits = [np.packbits((whole >> i & 1).astype(bool)).view(np.uint64) for i in range(cuts.bit_length())]

    def halve(low: int, bit: int, inside: np.ndarray, over: np.ndarray) -> None:
        middle = low + (1 << bit)
        if middle <= cuts:
            upper = inside & bits[bit]
            out[middle] = over | upper
            if bit:
                halve(middle, bit - 1, upper, over)
                halve(low, bit - 1, inside ^ upper, out[middle])
        elif bit:
            halve(low, bit - 1, inside, over)

    if bits:
        halve(0, len(bits) - 1, np.full(len(whole) // 64, -1, np.int64).view(np.uint64), np.zeros(len(whole) // 64, np.uint64))
    return out


def _turns(nodes: list[tuple], above: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The turns of all rows in a tree, level by level, 64 rows in a word: 1 for right, 0 for left and below a leaf. No row is looked up by itself: all
    nodes' turns are there, and which of them count for a row is a matter of a few words."""

    def below(k: int) -> list[np.ndarray]:
        feature, number, left, right = nodes[k]
        if feature < 0:
            return []
        turn, lower, higher = above[feature][number], below(left), below(right)
        out = [turn]
        for i in range(max(len(lower), len(higher))):
            if i >= len(lower):
                out.append(higher[i] & turn)
            elif i >= len(higher):
                out.append(lower[i] & ~turn)
            else:
                own = lower[i] ^ higher[i]
                own &= turn
                own ^= lower[i]
                out.append(own)
        return out

    return below(0)


@dataclass(frozen=True)
class Forest:
    """Isolation trees as flat arrays: split feature (-1: leaf), split value, left child, right child, path length at leaves."""

    features: list[str]
    medians: list[float]
    trees: list[dict] = field(repr=False)
    sample: int = 256

    def numpy_score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / average path): near 1 for anomalies."""
        return self.logged_score(signed_log(x))

    @functools.cached_property
    def cuts(self) -> list[np.ndarray]:
        """Of each feature the different split values of all trees, in order."""
        feature, value = (np.concatenate([t[c] for t in self.trees]) for c in ("feature", "value"))
        return [np.unique(value[feature == f]) for f in range(len(self.features))]

    @functools.cached_property
    def _walks(self) -> list[tuple]:
        """For each tree: feature, split value's number in cuts (from 1) and both children of each node; its depth; and the path length by the turns
        taken, a bit for each level, 1 for right, zeros below a leaf."""
        out = []
        for t in self.trees:
            number = np.zeros(len(t["feature"]), np.int64)
            for f, cuts in enumerate(self.cuts):
                own = t["feature"] == f
                number[own] = np.searchsorted(cuts, t["value"][own]) + 1
            level, depth, leaves = [(0, 0)], -1, []
            while level:
                depth += 1
                leaves += [(turns, depth, t["path"][k]) for k, turns in level if t["feature"][k] < 0]
                level = [(int(t[side][k]), 2 * turns + i) for k, turns in level if t["feature"][k] >= 0 for i, side in enumerate(("left", "right"))]
            lengths = np.zeros(1 << depth)
            for turns, at, path in leaves:
                lengths[turns << depth - at] = path
            out.append(([*zip(t["feature"].tolist(), number.tolist(), t["left"].tolist(), t["right"].tolist(), strict=True)], depth, lengths))
        return out

    def logged_score(self, x: np.ndarray) -> np.ndarray:
        """numpy_score of features whose signed logs are taken already; NaN where unknown."""
        x = self.known(x)
        return self.ranked_score([np.searchsorted(cuts, c, "right") for cuts, c in zip(self.cuts, x.T, strict=True)])

    def known(self, x: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(x), signed_log(np.array(self.medians)), x)

    def rank_tables(self, every: list[np.ndarray]) -> list[np.ndarray]:
        """For each feature the rank among this forest's cuts by the rank among those of all_cuts."""
        return [np.append(0, np.searchsorted(cuts, among, "right")).astype(np.min_scalar_type(len(cuts))) for cuts, among in zip(self.cuts, every, strict=True)]

    def ranked_score(self, ranks: list[np.ndarray]) -> np.ndarray:
        """The scores of rows, of which for each feature the number of cuts is known that are not above the row's value."""
        n = len(ranks[0])
        out, index, length = np.zeros(n), np.empty(8192, np.intp), np.empty(8192)
        for start in range(0, n, SCORED_ROWS):
            size = min(SCORED_ROWS, n - start)
            above = [_above(r[start : start + size], len(cuts)) for r, cuts in zip(ranks, self.cuts, strict=True)]
            for nodes, depth, lengths in self._walks:
                code = np.zeros(size, np.uint8 if depth <= 8 else np.int64)
                for turn in _turns(nodes, above):
                    np.add(code, code, out=code)
                    code |= np.unpackbits(turn.view(np.uint8))[:size]
                # few rows at a time, which stay in the processor's cache
                for at in range(0, size, 8192):
                    own = code[at : at + 8192]
                    index[: len(own)] = own
                    out[start + at : start + at + len(own)] += lengths.take(index[: len(own)], out=length[: len(own)], mode="clip")
        return 2.0 ** (-(out / len(self.trees)) / max(_average_path(self.sample), 1e-12))

    def to_json(self) -> str:
        """Numbers only: a saved forest can be read without running anything of it."""
        return json.dumps({"features": self.features, "medians": self.medians, "sample": self.sample, "trees": [{k: v.tolist() for k, v in t.items()} for t in self.trees]}, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Forest:
        d = json.loads(text)
        trees = [{k: np.array(v, float if k in ("value", "path") else np.int64) for k, v in t.items()} for t in d["trees"]]
        return Forest(d["features"], d["medians"], trees, d["sample"])

    def score(self, columns: dict[str, Column] | None = None) -> Column:
        model = self

        @F.pandas_udf("double")
        def forest(*x: pd.Series) -> pd.Series:
            return pd.Series(model.numpy_score(np.column_stack([c.to_numpy(dtype=float, na_value=np.nan) for c in x])))

        return forest(*((columns or {}).get(f, F.col(f)).cast("double") for f in self.features))


def all_cuts(forests: list[Forest]) -> list[np.ndarray]:
    """The cuts of all forests by feature: a row's rank among them is looked for once for all forests."""
    return [np.unique(np.concatenate(own)) for own in zip(*(f.cuts for f in forests), strict=True)]


def model_from_json(text: str) -> Gaussian | Forest:
    """A saved model of either kind; an error where it lacks what its kind needs."""
    fields = set(json.loads(text))
    for kind, needed in ((Gaussian, {"features", "location", "precision", "medians"}), (Forest, {"features", "medians", "trees", "sample"})):
        if needed <= fields:
            return kind.from_json(text)
    raise ValueError(f"not a saved model: {sorted(fields)}")


def _grow(x: np.ndarray, limit: int, rng: np.random.Generator) -> dict:
    feature, value, left, right, path = [], [], [], [], []

    def node(rows: np.ndarray, depth: int) -> int:
        k = len(feature)
        for a in (feature, value, left, right, path):
            a.append(0)
        low, high = x[rows].min(0), x[rows].max(0)
        free = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(free):
            feature[k], path[k] = -1, depth + _average_path(len(rows))
            return k
        f = int(rng.choice(free))
        cut = rng.uniform(low[f], high[f])
        below = x[rows, f] < cut
        if not below.any() or below.all():
            below = x[rows, f] <= low[f]
        feature[k], value[k] = f, cut
        left[k] = node(rows[below], depth + 1)
        right[k] = node(rows[~below], depth + 1)
        return k

    node(np.arange(len(x)), 0)
    return {"feature": np.array(feature), "value": np.array(value, float), "left": np.array(left), "right": np.array(right), "path": np.array(path, float)}


#: A prime below 2**31: products of two numbers below it fit 64 bits.
PRIME = 2_147_483_647


def tree_keys(trees: int, seed: int) -> list[tuple[int, int]]:
    """A multiplier and an offset for each tree, by two generators modulo PRIME."""
    a, b, out = 1 + seed % (PRIME - 1), 1 + (7 * seed + 3) % (PRIME - 1), []
    for _ in range(trees):
        a, b = a * 48_271 % PRIME, b * 69_621 % PRIME
        out.append((a, b))
    return out


def row_number_of(columns: list[Column]) -> Column:
    """A number below PRIME for each row: the first 15 digits of the MD5 of its values, modulo PRIME."""
    text = F.concat_ws(":", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(PRIME))


SAMPLES = "set int, tree int, hash long, row long, x array<double>"


def hash_bounds(sizes: dict[int, int], sample: int) -> dict[int, int]:
    """For each set of so many rows the bound that leaves about 4 * sample of them for each tree."""
    return {s: PRIME if n <= 8 * sample else int(PRIME * (4 * sample / n)) + 1 for s, n in sizes.items()}


def drawn(row: np.ndarray, x: np.ndarray, first: np.ndarray, many: np.ndarray, of: np.ndarray, keys: np.ndarray, limit: np.ndarray) -> Iterator[pa.RecordBatch]:
    """SAMPLES of rows: those whose hash is below the limit of a set they are in. A row's sets are many of `of`, from first on."""
    most = limit.max(initial=0)
    for tree, (a, b) in enumerate(keys):
        h = (a * row + b) % PRIME
        # only rows below some set's bound are looked at set by set
        few = np.flatnonzero(h < most)
        at = np.repeat(few, many[few])
        got = np.repeat(first[few] - np.append(0, np.cumsum(many[few]))[:-1], many[few]) + np.arange(len(at))
        below = h[at] < limit[of[got]]
        at, got = at[below], got[below]
        if len(got):
            values = pa.ListArray.from_arrays(np.arange(0, len(at) * x.shape[1] + 1, x.shape[1], dtype=np.int32), pa.array(x[at].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(of[got], pa.int32()), pa.array(np.full(len(at), tree, np.int32)), pa.array(h[at]), pa.array(row[at]), values], ["set", "tree", "hash", "row", "x"])


def tree_samples(rows: DataFrame, columns: list[str], key: list[str], trees: int, sample: int, seed: int, sets: Column | None = None, sizes: dict[int, int] | None = None) -> DataFrame:
    """set, tree, rank_hash, row, columns: for each set and tree the `sample` rows with the smallest keyed hashes, in one pass.

    A tree's hash of a row is (a * row + b) modulo PRIME, with its own a and b, of the row's number by its key columns. So the samples
    are the same however the rows are dealt and however many there are. sets: an array of the sets that a row is in (0 by default);
    sizes: rows of each set. A task passes on only hashes below a bound that leaves about 4 * sample rows of a set for each tree, many more than
    can be missing by chance; a set for which it wasn't enough would be an error.
    """
    sets = F.array(F.lit(0)) if sets is None else sets
    chosen = rows.select(sets.alias("sets"), row_number_of([F.col(k) for k in key]).alias("row"), *(F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(columns)))
    if sizes is None:
        sizes = {r["s"]: r["count"] for r in chosen.select(F.explode("sets").alias("s")).groupBy("s").count().collect()}
    keys = np.array(tree_keys(trees, seed), dtype=np.int64).reshape(trees, 2)
    bound = hash_bounds(sizes, sample)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row = batch.column(1).to_numpy()
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[2:]])
            member = batch.column(0)
            of = member.flatten().to_numpy()
            limit = np.zeros(int(of.max(initial=-1)) + 1, np.int64)
            for s in range(len(limit)):
                limit[s] = bound.get(s, 0)
            first, many = member.offsets.to_numpy()[:-1] - member.offsets[0].as_py(), np.diff(member.offsets.to_numpy())
            yield from drawn(row, x, first, many, of, keys, limit)

    return chosen.mapInArrow(draw, SAMPLES)


def _forests(rows: DataFrame, features: list[str], key: list[str], trees: int, sample: int, seed: int, sets: Column | None, medians: dict[int, list[float]], sizes: dict[int, int]) -> dict[int, Forest]:
    return grown(tree_samples(rows, features, key, trees, sample, seed, sets, sizes), features, sample, seed, medians, sizes)


def grown(samples: DataFrame, features: list[str], sample: int, seed: int, medians: dict[int, list[float]], sizes: dict[int, int]) -> dict[int, Forest]:
    """A forest for each set of rows: trees are grown in executors, each from its own sample, and only trees reach the driver."""
    parts = ("feature", "value", "left", "right", "path")

    def grow(rows: pa.Table) -> pa.Table:
        s, tree = rows.column("set")[0].as_py(), rows.column("tree")[0].as_py()
        size = min(sample, sizes[s])
        h, row = rows.column("hash").to_numpy(), rows.column("row").to_numpy()
        x = np.array(rows.column("x").to_pylist(), dtype=float)
        # equal hashes are told apart by the rows' numbers, and equal numbers by their values
        order = np.lexsort((*x.T[::-1], row, h))[:size]
        if len(order) < size:
            raise ValueError("too few hashes below the bound")
        x = np.where(np.isnan(x[order]), np.array(medians[s]), x[order])
        x = np.sign(x) * np.log1p(np.abs(x))
        t = _grow(x, int(np.ceil(np.log2(max(size, 2)))), np.random.default_rng([seed, s, tree]))
        return pa.table({"set": pa.array([s], pa.int32()), "tree": pa.array([tree], pa.int32()), **{c: pa.array([t[c].astype(float).tolist()], pa.list_(pa.float64())) for c in parts}})

    schema = "set int, tree int, " + ", ".join(f"{c} array<double>" for c in parts)
    found: dict[int, list] = {}
    for r in samples.groupBy("set", "tree").applyInArrow(grow, schema).collect():
        found.setdefault(r["set"], []).append((r["tree"], {c: np.array(r[c]).astype(float if c in ("value", "path") else np.int64) for c in parts}))
    return {s: Forest(list(features), medians[s], [t for _, t in sorted(own, key=lambda v: v[0])], min(sample, sizes[s])) for s, own in found.items()}


def fit_forest(rows: DataFrame, features: list[str], trees: int = 100, sample: int = 256, seed: int = 42, key: list[str] | None = None, among: DataFrame | None = None) -> Forest:
    """An isolation forest, the same for the same rows in any order and number of partitions.

    key: columns that tell rows apart, by default the features; each tree has its own sample by them. among: as for fit_gaussians.
    """
    n = rows.count()
    if not n:
        raise ValueError("no rows to fit on")
    found = exact_medians(rows, features, list(range(len(features))) if among is None else open_features(among, features), [])
    medians = [found.get((i,), 0.0) for i in range(len(features))]
    return _forests(rows, features, key or features, trees, sample, seed, None, {0: medians}, {0: n})[0]


def fold_forests(rows: DataFrame, features: list[str], k: int, repeats: int, trees: int = 100, sample: int = 256, seed: int = 42, key: tuple[str, ...] = ("group_id", "t_us", "seq"), among: DataFrame | None = None) -> dict[tuple[int, int], Forest]:
    """A forest for each (repeat, test fold) of rows with folds, as moments.fold_models has: all trees of all folds from one pass."""
    from tidewatch.operators.moments import fold_medians

    # set r * k + t: the rows in neither fold t nor the next of repeat r
    inside = [F.when((F.col("folds")[r] != t) & (F.col("folds")[r] != (t + 1) % k), F.lit(r * k + t)) for r in range(repeats) for t in range(k)]
    sets = F.array_compact(F.array(*inside))
    sizes: dict[int, int] = {}
    for own in rows.groupBy("folds").count().select("count", sets.alias("sets")).collect():
        for s in own["sets"]:
            sizes[s] = sizes.get(s, 0) + own["count"]
    middle = fold_medians(rows, features, k, repeats, among)
    medians = {s: [middle.get((s // k, s % k, i), 0.0) for i in range(len(features))] for s in sizes}
    found = _forests(rows, features, list(key), trees, sample, seed, sets, medians, sizes)
    return {(s // k, s % k): f for s, f in found.items()}
