"""Streaming cross-validation without rows for each fold, quantile and variant.

Rows are put in the order of their segments once, for the windows' features, and kept in that order as blocks of so many rows, each with the
few rows before it that smoothing and persistence look back at. Models are fitted from the blocks. A row is scored once, by the models of
all folds that test it or validate with it, and its scores are two arrays. So a block is judged by itself: all quantiles and variants are columns of
arrays, and only sums by (repeat, quantile, variant) leave it, with the segments that lie across its edges apart. Of the validation scores only
counts by cell, and the values of the cells that hold a wanted rank, leave the blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scalar import seconds
from tidewatch.operators import metrics, thresholds
from tidewatch.operators.models import PRIME, SAMPLES, Forest, all_cuts, drawn, fold_forests, grown, hash_bounds, signed_log, tree_keys
from tidewatch.operators.moments import FoldSums, Moments, fold_models, merged, training_moments
from tidewatch.schema import Settings
from tidewatch.sources.scratch import written
from tidewatch.streaming.detector import NAMES, complete

#: Rows of a block: some hundred kilobytes.
BLOCK_ROWS = 2000
#: Blocks that a reader takes at once at most: some megabytes.
GROUP_BLOCKS = 16
#: Rows that are scored at a time: each model has some tens of thousands of them.
SCORED_ROWS = 150_000
KEYS = ("group_id", "t_us", "seq", "kind", "label")
SUMS = ("groups", "tp", "fp", "fn", "episodes", "found", "delay_us")
PARTS = "repeat int, quantile int, variant int, group_id string, kind string, onset long, hit long, " + ", ".join(f"{c} long" for c in SUMS)
NEVER = np.iinfo(np.int64).max


def _message(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Blocks as tables, and how many of their first rows belong to the block before."""
    for batch in batches:
        for before, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield before, pa.ipc.open_stream(rows.as_buffer()).read_all()


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(float)


def _folds(table: pa.Table) -> np.ndarray:
    return table.column("folds").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)


def blocks(rows: DataFrame, settings: Settings, ordered: bool = False) -> DataFrame:
    """before and rows: the rows of segments in order, in blocks as Arrow tables, of which the first `before` rows belong to the block before.

    ordered: rows come in the order of their segments already, each segment in one partition.
    """
    back = settings.smooth - 1 + settings.persistence

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                own = pa.Table.from_batches([batch.slice(start, BLOCK_ROWS)])
                whole = pa.concat_tables([tail, own]).combine_chunks() if tail is not None else own
                before = whole.num_rows - own.num_rows
                tail = whole.slice(max(0, whole.num_rows - back))
                yield pa.RecordBatch.from_arrays([pa.array([before], pa.int32()), pa.array([_message(whole)], pa.binary())], ["before", "rows"])

    if not ordered:
        rows = rows.repartition("group_id").sortWithinPartitions("group_id", "t_us", "seq")
    return rows.mapInArrow(cut, "before int, rows binary")


def rows_of(kept: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns (with their types) of the rows of blocks, each row once."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for before, table in _tables(batches):
            yield from table.slice(before).select(list(columns)).to_batches()

    return kept.mapInArrow(unpack, ", ".join(f"`{c}` {t}" for c, t in columns.items()))


def _name_columns(features: dict[str, list[str]], settings: Settings) -> tuple[list[str], dict[str, list[int]], dict[str, str]]:
    """All features, the numbers of those of each model, and the column that is known where a window model's window is full."""
    names = sorted({f for own in features.values() for f in own})
    return names, {n: [names.index(f) for f in features[n]] for n in NAMES}, {n: f"{n}_{settings.channels[0]}_mean" for n in ("short", "long")}


def _inputs(table: pa.Table, names: list[str], full: dict[str, str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """folds, features (NaN where unknown), which rows may train, and those on which each model can be scored."""
    idle = _numbers(table, "idle") == 1 if "idle" in table.column_names else np.zeros(table.num_rows, bool)
    train = (table.column("kind").to_numpy() == "normal") & ~idle
    ready = {n: table.column(full[n]).is_valid().to_numpy() if n in full else np.ones(table.num_rows, bool) for n in NAMES}
    return _folds(table), np.column_stack([_numbers(table, f) for f in names]), train, ready


def block_models(kept: DataFrame, types: dict[str, str], features: dict[str, list[str]], k: int, repeats: int, settings: Settings, kind: str = "ledoit_wolf", seed: int = 0) -> dict[tuple[int, int], dict]:
    """The models by (repeat, test fold) and name, as moments.fold_models and models.fold_forests have them: from one scan, or for forests two scans
    more for each name. Names of which some row lacks a feature are fitted by these. types: of the blocks' columns."""
    names, places, full = _name_columns(features, settings)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [FoldSums(len(places[n]), k, repeats) for n in NAMES]
        unknown, sizes = [np.zeros(len(places[n])) for n in NAMES], np.zeros((len(NAMES), repeats, k))
        for before, table in _tables(batches):
            folds, x, train, ready = _inputs(table.slice(before), names, full)
            for i, n in enumerate(NAMES):
                unknown[i] += np.isnan(x[ready[n]][:, places[n]]).sum(axis=0)
                own = train & ready[n]
                for r in range(repeats):
                    sizes[i, r] += np.bincount(folds[own, r], minlength=k)
                if kind != "forest":
                    total[i].add(folds[own], x[own][:, places[n]])
        found = [(n, r, f, m) for n, t in zip(NAMES, total, strict=True) for r, f, m in t.parts()]
        found += [(n, -1, 0, v.tolist()) for n, v in zip(NAMES, unknown, strict=True)] + [(n, -2, 0, v.ravel().tolist()) for n, v in zip(NAMES, sizes, strict=True)]
        arrays = zip(zip(*found, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float64())), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in arrays], ["name", "repeat", "fold", "m"])

    def add(rows: pa.Table) -> pa.Table:
        lists, p = [np.array(v) for v in rows.column("m").to_pylist()], len(places[rows.column("name")[0].as_py()])
        whole = merged([Moments.unflat(v, p) for v in lists], p).flat() if rows.column("repeat")[0].as_py() >= 0 else sum(lists).tolist()
        return pa.table({**{c: rows.column(c)[:1] for c in ("name", "repeat", "fold")}, "m": pa.array([whole], pa.list_(pa.float64()))})

    schema = "name string, repeat int, fold int, m array<double>"
    found = {(r["name"], r["repeat"], r["fold"]): np.array(r["m"]) for r in kept.mapInArrow(sums, schema).groupBy("name", "repeat", "fold").applyInArrow(add, schema).collect()}
    models: dict[tuple[int, int], dict] = {}
    for n in NAMES if found else ():
        p = len(places[n])
        if found[n, -1, 0].any():
            every = complete(rows_of(kept, types), n, settings)
            own = every.where("kind = 'normal' and coalesce(idle, 0) <> 1" if "idle" in types else "kind = 'normal'")
            of = fold_forests(own, features[n], k, repeats, seed=seed, among=every) if kind == "forest" else fold_models(own, features[n], k, repeats, kind, every)
        elif kind == "forest":
            of = _block_forests(kept, n, features, found[n, -2, 0].reshape(repeats, k), settings, seed)
        else:
            parts = {(r, f): Moments.unflat(m, p) for (name, r, f), m in found.items() if name == n and r >= 0}
            whole = {(r, t): training_moments(parts, r, t, k, p) for r in range(repeats) for t in range(k)}
            of = {key: m.gaussian(features[n], [0.0] * p, kind) for key, m in whole.items() if m.n}
        for key, model in of.items():
            models.setdefault(key, {})[n] = model
    return models


def _block_forests(kept: DataFrame, name: str, features: dict[str, list[str]], counts: np.ndarray, settings: Settings, seed: int, trees: int = 100, sample: int = 256) -> dict[tuple[int, int], Forest]:
    """models.fold_forests of rows that know all features. counts: training rows by repeat and fold."""
    repeats, k = counts.shape
    names, places, full = _name_columns({n: features[name] for n in NAMES}, settings)
    # the tests that a fold trains for, and the rows of each (repeat, test)
    trained = np.array([[t for t in range(k) if f not in (t, (t + 1) % k)] for f in range(k)]).reshape(k, -1)
    sizes = {r * k + t: int(sum(counts[r, f] for f in range(k) if t in trained[f])) for r in range(repeats) for t in range(k)}
    sizes = {s: n for s, n in sizes.items() if n}
    bounds, keys = hash_bounds(sizes, sample), np.array(tree_keys(trees, seed), dtype=np.int64).reshape(trees, 2)
    limit = np.array([bounds.get(s, 0) for s in range(repeats * k)], np.int64)

    def number(*key) -> int:
        """As models.row_number_of."""
        return int(hashlib.md5(":".join("" if v is None else str(v) for v in key).encode()).hexdigest()[:15], 16) % PRIME

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for before, table in _tables(batches):
            own = table.slice(before)
            folds, x, train, ready = _inputs(own, names, full)
            chosen = np.flatnonzero(train & ready[name])
            if len(chosen):
                own = own.select(["group_id", "t_us", "seq"]).take(pa.array(chosen))
                row = np.array(list(map(number, *(c.to_pylist() for c in own.columns))), np.int64)
                of = (np.arange(repeats)[:, None] * k + trained[folds[chosen]]).reshape(len(chosen), -1)
                many = np.full(len(chosen), of.shape[1])
                yield from drawn(row, x[chosen][:, places[name]], np.arange(len(chosen)) * of.shape[1], many, of.ravel(), keys, limit)

    found = grown(kept.mapInArrow(draw, SAMPLES), features[name], sample, seed, {s: [0.0] * len(features[name]) for s in sizes}, sizes)
    return {(s // k, s % k): f for s, f in found.items()}


def scored_blocks(kept: DataFrame, models: dict[tuple[int, int], dict], features: dict[str, list[str]], k: int, repeats: int, settings: Settings) -> DataFrame:
    """Blocks of rows with two arrays of scores instead of their features, for each repeat those of NAMES: test, by the models of the fold that tests
    the row, and validation (null unless the row is normal), by those of the fold before. NaN where a window isn't full."""
    names, places, full = _name_columns(features, settings)
    models = {key: by for key, by in models.items() if len(by) == len(NAMES)}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = {n: all_cuts([by[n] for by in models.values()]) for n in NAMES if isinstance(next(iter(models.values()))[n], Forest)}
        ranked = {(key, n): by[n].rank_tables(cuts[n]) for key, by in models.items() for n in cuts}

        def judged(held: list[tuple[int, pa.Table]]) -> Iterator[pa.RecordBatch]:
            table = pa.concat_tables([t for _, t in held]).combine_chunks()
            n = table.num_rows
            folds, x, _, ready = _inputs(table, names, full)
            x, normal = signed_log(x), table.column("kind").to_numpy() == "normal"
            test, validation = (np.full((n, repeats, len(NAMES)), np.nan) for _ in range(2))
            for i, name in enumerate(NAMES):
                own = np.ascontiguousarray(x[:, places[name]])
                ranks = None
                if name in cuts and not np.isnan(own[ready[name]]).any():
                    ranks = [np.searchsorted(c, v, "right") for c, v in zip(cuts[name], own.T, strict=True)]
                for (r, t), by in models.items():
                    tested = folds[:, r] == t
                    chosen = np.flatnonzero(ready[name] & (tested | normal & (folds[:, r] == (t + 1) % k)))
                    if not len(chosen):
                        continue
                    if ranks is None:
                        found = by[name].logged_score(own[chosen])
                    else:
                        found = by[name].ranked_score([of.take(rank.take(chosen)) for of, rank in zip(ranked[(r, t), name], ranks, strict=True)])
                    # with one fold a row is tested and validates by the same models
                    test[chosen[tested[chosen]], r, i] = found[tested[chosen]]
                    other = normal & (folds[:, r] == (t + 1) % k)
                    validation[chosen[other[chosen]], r, i] = found[other[chosen]]
            lists = []
            for found, mine in ((test, np.ones(n, bool)), (validation, normal)):
                offsets = pa.array(np.append(0, np.cumsum(np.where(mine, repeats * len(NAMES), 0))).astype(np.int32))
                lists.append(pa.ListArray.from_arrays(offsets, pa.array(found[mine].ravel()), mask=pa.array(~mine)))
            out = table.select([*KEYS, "folds"]).append_column("test", lists[0]).append_column("validation", lists[1])
            at = 0
            for before, t in held:
                yield pa.RecordBatch.from_arrays([pa.array([before], pa.int32()), pa.array([_message(out.slice(at, t.num_rows))], pa.binary())], ["before", "rows"])
                at += t.num_rows

        held, size = [], 0
        for before, table in _tables(batches):
            held.append((before, table))
            size += table.num_rows
            if size >= SCORED_ROWS:
                yield from judged(held)
                held, size = [], 0
        if held:
            yield from judged(held)

    return kept.mapInArrow(score, "before int, rows binary")


class Block:
    """A block's columns, and the place of each row in its segment as far as the block knows it."""

    def __init__(self, rows: bytes, repeats: int, settings: Settings, digits: int | None = None):
        self.digits = digits
        table = pa.ipc.open_stream(rows).read_all().combine_chunks()
        self.n, self.repeats, self.smooth = table.num_rows, repeats, settings.smooth
        column = lambda c: table.column(c).combine_chunks()
        names = column("group_id").dictionary_encode()
        code = names.indices.to_numpy(zero_copy_only=False)
        self.groups, self.code = names.dictionary, code
        self.first = np.append(True, code[1:] != code[:-1])
        self.place = np.arange(self.n) - np.maximum.accumulate(np.where(self.first, np.arange(self.n), 0))
        self.t, self.kind = column("t_us").to_numpy(), column("kind").to_numpy(zero_copy_only=False)
        self.fault = column("label").to_numpy(zero_copy_only=False) == 1
        self.folds = column("folds").flatten().to_numpy().reshape(self.n, repeats)
        self.table = table

    def scores(self, which: str) -> np.ndarray:
        """rows x repeats x NAMES, the sample's smoothed; NaN where there is none."""
        lists = self.table.column(which).combine_chunks()
        out = np.full((self.n, self.repeats, len(NAMES)), np.nan)
        some = lists.is_valid().to_numpy(zero_copy_only=False)
        out[some] = lists.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, self.repeats, len(NAMES))
        raw, total = out[:, :, 0], np.zeros((self.n, self.repeats))
        for back in range(self.smooth - 1, -1, -1):
            total[back:] += raw[: self.n - back] if back else raw
        out[:, :, 0] = np.where((self.place >= self.smooth - 1)[:, None], total / self.smooth, np.nan)
        return out if self.digits is None else np.round(out, self.digits)


def _cells(score: np.ndarray) -> np.ndarray:
    """The number of a score's cell, as thresholds.cell_of has it: cells are in the order of the scores."""
    with np.errstate(divide="ignore"):
        place = np.floor(np.clip(np.log2(np.abs(score)), -1100, 1100) * thresholds.CELLS).astype(np.int64) + 2048 * thresholds.CELLS
    return np.where(score == 0, 0, np.where(score > 0, place, -place))


def _validation(batches: Iterator[pa.RecordBatch], k: int, repeats: int, settings: Settings, digits: int | None) -> Iterator[tuple[int, int, str, np.ndarray]]:
    """repeat, test fold, name and the scores of a block's validation rows whose score is known."""
    for batch in batches:
        for before, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            b = Block(rows.as_buffer(), repeats, settings, digits)
            found = b.scores("validation")[before:]
            for r in range(repeats):
                test = (b.folds[before:, r] - 1) % k
                for t in range(k):
                    own = found[test == t, r]
                    for i, name in enumerate(NAMES):
                        known = own[~np.isnan(own[:, i]), i]
                        if len(known):
                            yield r, t, name, known


OF = "repeat int, test_fold int, name string"


def validation_scores(kept: DataFrame, k: int, repeats: int, settings: Settings, digits: int | None = None, cells: dict[tuple[int, int, str], dict[int, int]] | None = None) -> DataFrame:
    """repeat, test_fold, name, score of all validation rows whose score is known; of those in some cells only, and with the cell and the number that
    cells has for it, if there are cells."""

    def together(parts: list[tuple]) -> pa.RecordBatch:
        keys, cell, before, score = [p[:3] for p in parts], *(np.concatenate([p[i] for p in parts]) for i in (3, 4, 5))
        of = [np.repeat(np.array([key[i] for key in keys], np.int32), [len(p[5]) for p in parts]) for i in (0, 1, 2)]
        name = pa.array(NAMES).take(pa.array(of[2]))
        more = {} if cells is None else {"_cell": pa.array(cell), "_before": pa.array(before)}
        return pa.RecordBatch.from_pydict({"repeat": pa.array(of[0]), "test_fold": pa.array(of[1]), "name": name, **more, "score" if cells is None else "_v": pa.array(score)})

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # few of a block's scores are wanted: those of many blocks make a batch
        parts, size = [], 0
        for r, t, name, score in _validation(batches, k, repeats, settings, digits):
            of = before = np.zeros(len(score), np.int64)
            if cells is not None:
                wanted = cells.get((r, t, name), {})
                of = _cells(score)
                own = np.isin(of, list(wanted))
                score, of = score[own], of[own]
                before = np.array([wanted[c] for c in of.tolist()], np.int64)
            if len(score):
                parts.append((r, t, NAMES.index(name), of, before, score))
                size += len(score)
            if size >= 10_000:
                yield together(parts)
                parts, size = [], 0
        if parts:
            yield together(parts)

    return kept.mapInArrow(values, f"{OF}, score double" if cells is None else f"{OF}, _cell long, _before long, _v double")


def validation_quantiles(kept: DataFrame, k: int, repeats: int, settings: Settings, quantiles: tuple[float, ...], digits: int | None = None) -> DataFrame:
    """repeat, test_fold, name, quantiles and n, as thresholds.exact_quantiles of validation_scores: scores are counted by cell where they are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, str], dict[int, int]] = {}
        for r, t, name, score in _validation(batches, k, repeats, settings, digits):
            own = total.setdefault((r, t, name), {})
            for cell, n in zip(*(v.tolist() for v in np.unique(_cells(score), return_counts=True)), strict=True):
                own[cell] = own.get(cell, 0) + n
        found = [(*key, cell, n) for key, own in total.items() for cell, n in own.items()]
        if found:
            arrays = zip(zip(*found, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in arrays], ["repeat", "test_fold", "name", "_cell", "_size"])

    def values_of(keys: DataFrame) -> DataFrame:
        cells: dict[tuple[int, int, str], dict[int, int]] = {}
        for key in keys.collect():
            cells.setdefault((key["repeat"], key["test_fold"], key["name"]), {})[key["_cell"]] = key["_before"]
        return validation_scores(kept, k, repeats, settings, digits, cells)

    by = ["repeat", "test_fold", "name"]
    sizes = kept.mapInArrow(count, f"{OF}, _cell long, _size long").groupBy(*by, "_cell").agg(F.sum("_size").alias("_size"))
    return thresholds.quantiles_by_cells(written(sizes, "cells"), values_of, quantiles, by)


def block_sums(kept: DataFrame, limits: dict[tuple[int, int], np.ndarray], repeats: int, settings: Settings, variants: tuple[str, ...], digits: int | None = None) -> DataFrame:
    """PARTS: sums of a block's whole segments by kind, and by themselves the segments at its edges. limits: (repeat, test fold) -> quantiles x NAMES."""
    quantiles = len(next(iter(limits.values())))
    lag = lambda a: np.concatenate([np.zeros_like(a[:1]), a[:-1]])

    def judge(b: Block, before: int) -> Iterator[pa.RecordBatch]:
        test = b.scores("test")
        runs = np.flatnonzero(b.first[before:] | (np.arange(b.n - before) == 0))
        edge = np.zeros(len(runs), bool)
        edge[[0, -1]] = True
        kind, group, y = b.kind[before:][runs], b.code[before:][runs], b.fault[before:, None]
        onset = np.minimum.reduceat(b.t[before:], runs)
        for r in range(repeats):
            at = np.full((b.n, quantiles, len(NAMES)), np.nan)
            present = np.zeros(b.n, bool)
            for t in np.unique(b.folds[:, r]).tolist():
                if (r, t) in limits:
                    own = b.folds[:, r] == t
                    present |= own
                    at[own] = limits[r, t]
            each = test[:, r, None, :] >= at
            alarm = {f"{n}_alarm": each[:, :, i] for i, n in enumerate(NAMES)}
            alarm["or_3"] = each.any(axis=2)
            final, earlier = alarm["or_3"], alarm["or_3"]
            for back in range(1, settings.persistence):
                earlier = lag(earlier)
                final = final & earlier & (b.place >= back)[:, None]
            alarm["final_alarm"] = final
            for v, variant in enumerate(variants):
                whole = alarm[variant]
                new = (whole & ~(lag(whole) & (b.place > 0)[:, None]))[before:]
                hit = whole[before:]
                add = lambda a: np.add.reduceat(a.astype(np.int64), runs, axis=0)
                counts = [add(y & hit), add(~y & hit), add(y & ~hit), add(new)]
                time = np.minimum.reduceat(np.where(hit, b.t[before:, None], NEVER), runs, axis=0)
                found = time != NEVER
                delay = np.where(found, time - onset[:, None], 0)
                # a segment is in one fold: it is tested as a whole or not at all
                tested = present[before:][runs]
                for q in range(quantiles):
                    for name in ("fault", "normal", "idle"):
                        own = tested & ~edge & (kind == name)
                        if own.any():
                            sums = [int(own.sum()), *(int(c[own, q].sum()) for c in counts), int(found[own, q].sum()), int(delay[own, q].sum())]
                            yield r, q, v, None, name, None, None, *sums
                    for i in np.flatnonzero(tested & edge).tolist():
                        yield r, q, v, b.groups[int(group[i])].as_py(), kind[i], int(onset[i]), int(time[i, q]) if found[i, q] else None, 1, *(int(c[i, q]) for c in counts), 0, 0

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        schema = pa.schema([(c.split()[0], {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[c.split()[1]]) for c in PARTS.split(", ")])
        table = lambda found: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)
        for batch in batches:
            for before, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                edges = []
                for part in judge(Block(rows.as_buffer(), repeats, settings, digits), before):
                    if part[3] is None:
                        total[part[:5]] = total.get(part[:5], 0) + np.array(part[7:], np.int64)
                    else:
                        edges.append(part)
                if edges:
                    yield table(edges)
        if total:
            yield table([(*key, None, None, *v.tolist()) for key, v in total.items()])

    return kept.mapInArrow(sums, PARTS)


def alarm_table(parts: DataFrame, quantiles: tuple[float, ...], variants: tuple[str, ...]) -> DataFrame:
    """The metrics of metrics.raw_alarm_metrics by repeat, quantile and variant, from PARTS (kept, as they are read twice)."""
    parts = written(parts, "cv-parts")
    by = ["repeat", "quantile", "variant"]
    edges = parts.where("group_id is not null").groupBy(*by, "group_id", "kind").agg(F.min("onset").alias("onset"), F.min("hit").alias("hit"), *(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "episodes")))
    edges = edges.withColumns({"groups": F.lit(1), "found": F.col("hit").isNotNull().cast("long"), "delay_us": F.coalesce(F.col("hit") - F.col("onset"), F.lit(0))})
    each = parts.where("group_id is null").select(*by, "kind", *SUMS).unionByName(edges.select(*by, "kind", *SUMS))
    of = lambda kind, c: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(c))), F.lit(0))
    aggs = [F.coalesce(F.sum(F.when(F.col("kind") != "idle", F.col(c))), F.lit(0)).alias(f"_{c}") for c in ("tp", "fp", "fn")]
    aggs += [of("fault", "groups").alias("n_events"), of("fault", "found").alias("detected_events")]
    aggs.append(F.try_divide(seconds(of("fault", "delay_us"), F.lit(0)), of("fault", "found")).alias("delay_mean_sec"))
    for kind in ("normal", "idle"):
        aggs += [of(kind, "groups").alias(f"{kind}_cycles"), of(kind, "found").alias(f"{kind}_fa_cycles"), of(kind, "episodes").alias(f"{kind}_fa_episodes")]
    named = each.groupBy(*by).agg(*aggs).withColumns({"quantile": F.array(*(F.lit(float(q)) for q in quantiles))[F.col("quantile")], "variant": F.array(*map(F.lit, variants))[F.col("variant")]})
    return metrics.alarm_rates(named, by)
