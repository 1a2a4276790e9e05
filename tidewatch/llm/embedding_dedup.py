"""Near-duplicate embeddings by sorted projection passes.

1. Equal vectors of one label are one representative with a count; hashes of label and vector find it again for each row.
2. Passes. Each pass draws 64 random hyperplanes and orders the representatives of a label and length lexicographically by the signs of
   their projections. Each is compared, by its cosine in double precision, with the WINDOW before it; of the links found, those are kept
   that join what the window hasn't joined yet, so a pass gives at most one link for each vector, however dense a group is. Where one range of
   the order ends, its last rows are compared with the first ones of the next. The number of passes follows from the number of vectors: a pair
   at the threshold meets in one pass with a chance of about p**log2(n / WINDOW), p the chance of one equal sign, and MISS is the
   chance to meet in none.
3. Classes are the connected components of all passes' links.
4. All links of a class. A window sees only some partners in a dense group, so each class is then compared with itself, whole. Classes of at
   most CELL vectors are compared at once. Larger ones are cut into cells of CELL vectors in a sorted order, each with its centre and the
   largest angle to it: the angles tell of most pairs of cells that all or none of their vectors link, and only the others are compared.
   So within a class no link is missed; between classes one is missed with the chance above.

Linked with nothing, and a class by themselves: rows whose label or vector is null, and vectors that are empty, zero or hold null or
non-finite entries. Vectors of different lengths don't link. Repeated rows count as other vectors. A null vec_id is no component_id
unless a class has no other; such rows are kept if their class's id is null too. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from tidewatch.llm.common import look_up, materialize, with_position
from tidewatch.llm.ngram_jaccard import components

LIKE = 0.98
WINDOW = 32
MISS = 1e-4
CELL = 1024
#: Vectors of small classes that are handled together.
BUCKET = 16_384
SEED = 11
#: Room for rounding when angles tell that all or none of two cells link.
_SLACK = 1e-6


def passes_for(n: int, like: float = LIKE, window: int = WINDOW, miss: float = MISS) -> int:
    """How many passes leave a pair at the threshold apart with a chance of about miss."""
    same_sign = 1 - math.acos(like) / math.pi
    meets = min(0.999, same_sign ** math.log2(max(1.0, n / window)))
    return math.ceil(math.log(miss) / math.log(1 - meets))


def _matrix(column: pa.Array) -> np.ndarray:
    """Equally long vectors as unit vectors in double precision."""
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def sign_hash(unit: np.ndarray, number: int) -> np.ndarray:
    """The signs of 64 projections, drawn for this pass and length, as 64-bit integers in the order of the bits."""
    planes = np.random.default_rng([SEED, unit.shape[1], number]).normal(size=(unit.shape[1], 64))
    bits = np.packbits(unit @ planes > 0, axis=1).view(">u8").ravel().astype(np.uint64)
    return (bits ^ np.uint64(1 << 63)).view(np.int64)


def _key(label: Column, v: Column) -> Column:
    return F.concat(F.hex(F.xxhash64(label, v)), F.hex(F.xxhash64(F.lit(SEED), v, label)))


def keyed(vectors: DataFrame, column: str, label: str) -> DataFrame:
    """vec_id, label as text, v, and key, which equal vectors of one label share; key is null where a vector takes no part."""
    kind = vectors.schema[column].dataType
    exact = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType | DoubleType)
    text = F.col(label) + F.lit(0.0) if isinstance(vectors.schema[label].dataType, FloatType | DoubleType) else F.col(label)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), text.cast("string").alias("label"), F.col(column).cast(kind if exact else "array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    return rows.withColumn("key", F.when(F.col("label").isNotNull() & F.col("v").isNotNull() & finite, _key(F.col("label"), F.col("v"))))


class Window:
    """Verified links between neighbours of one order, fed in parts; of each row's links those that join what isn't joined yet."""

    def __init__(self, like: float, window: int):
        self.like, self.window, self.known = like, window, 0
        self.ids, self.unit, self.of = np.zeros(0, np.int64), None, np.zeros(0, np.int64)

    def feed(self, ids: np.ndarray, unit: np.ndarray) -> list[tuple[int, int]]:
        links: list[tuple[int, int]] = []
        step = max(256, self.window)
        for start in range(0, len(ids), step):
            self._block(ids[start : start + step], unit[start : start + step], links)
        return links

    def _block(self, ids: np.ndarray, unit: np.ndarray, links: list[tuple[int, int]]) -> None:
        before = len(self.ids)
        all_ids = np.concatenate([self.ids, ids])
        all_unit = unit if self.unit is None else np.concatenate([self.unit, unit])
        of = np.concatenate([self.of, np.arange(self.known, self.known + len(ids))])
        self.known += len(ids)
        near = unit @ all_unit.T >= self.like
        place, other = np.arange(before, before + len(ids))[:, None], np.arange(len(all_ids))[None, :]
        near &= (other < place) & (other >= place - self.window)
        for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
            a, b = of[before + i], of[j]
            if a != b:
                links.append((int(all_ids[before + i]), int(all_ids[j])))
                of[of == a] = b
        self.ids, self.unit, self.of = all_ids[-self.window :], all_unit[-self.window :], of[-self.window :]


def projected(reps: DataFrame, passes: int) -> DataFrame:
    """run (pass, length and label), hash, rep, v for each pass."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(batch.column(2).offsets.to_numpy())
            for d in np.unique(lengths):
                part = batch.take(pa.array(np.flatnonzero(lengths == d)))
                unit, labels = _matrix(part.column(2)), part.column(1).to_pylist()
                for number in range(passes):
                    run = pa.array([f"{number}|{d}|{x}" for x in labels])
                    yield pa.RecordBatch.from_arrays([run, pa.array(sign_hash(unit, number)), part.column(0), part.column(2)], ["run", "hash", "rep", "v"])

    vector = reps.schema["v"].dataType.simpleString()
    return reps.select("rep", "label", "v").mapInArrow(hashes, f"run string, hash long, rep long, v {vector}")


def _feed(table: pa.RecordBatch | pa.Table, windows: dict[str, Window], like: float, window: int) -> list[tuple[int, int]]:
    """Links of sorted rows run, rep, v; of the windows only that of the last run is kept."""
    runs = table.column("run").to_pylist()
    cuts = [0, *(i for i in range(1, len(runs)) if runs[i] != runs[i - 1]), len(runs)]
    ids, links = table.column("rep").to_numpy(), []
    for start, end in zip(cuts, cuts[1:], strict=False):
        if start == end:
            continue
        if runs[start] not in windows:
            windows.clear()
            windows[runs[start]] = Window(like, window)
        v = table.column("v").slice(start, end - start)
        links += windows[runs[start]].feed(ids[start:end], _matrix(v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v))
    return links


def pass_links(reps: DataFrame, passes: int, like: float = LIKE, window: int = WINDOW) -> DataFrame:
    """Verified links (a, b) of all passes."""
    vector = reps.schema["v"].dataType.simpleString()
    order = ("run", "hash", "rep")
    ranged = projected(reps, passes).repartitionByRange(*order).sortWithinPartitions(*order)
    schema = f"a long, b long, border long, side int, place long, run string, rep long, v {vector}"
    names = [f.split()[0] for f in schema.split(", ")]

    def blank(kind: pa.DataType, n: int) -> pa.Array:
        return pa.nulls(n, kind)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        windows: dict[str, Window] = {}
        last: pa.Table | None = None

        def ends(rows: pa.Table, border: int, side: int, first: int) -> pa.RecordBatch:
            n, rows = rows.num_rows, rows.combine_chunks()
            columns = [blank(pa.int64(), n), blank(pa.int64(), n), pa.array(np.full(n, border)), pa.array(np.full(n, side, np.int32)), pa.array(np.arange(first, first + n))]
            columns += [rows.column(c).combine_chunks() for c in ("run", "rep", "v")]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            if not batch.num_rows:
                continue
            links = np.array(_feed(batch, windows, like, window), dtype=np.int64).reshape(-1, 2)
            n = len(links)
            rest = [blank(t, n) for t in (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), batch.schema.field("v").type)]
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1]), *rest], names)
            rows = pa.Table.from_batches([batch])
            if seen < window:
                yield ends(rows.slice(0, window - seen), part - 1, 1, seen)
            seen += batch.num_rows
            last = rows if last is None else pa.concat_tables([last, rows])
            last = last.slice(max(0, last.num_rows - window))
        if last is not None:
            yield ends(last, part, 0, 0)

    found = materialize(ranged.mapInArrow(compare, schema), "embedding-passes")

    def across(rows: pa.Table) -> pa.Table:
        links = _feed(rows.sort_by([("side", "ascending"), ("place", "ascending")]), {}, like, window)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    borders = found.where("border is not null").select("border", "side", "place", "run", "rep", "v").groupBy("border").applyInArrow(across, "a long, b long")
    return found.where("border is null").select("a", "b").union(borders).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _counts(unit: np.ndarray, other: np.ndarray, weights: np.ndarray, like: float) -> np.ndarray:
    """For each of unit the weights of the others that link, in parts of bounded memory."""
    return np.concatenate([(unit[i : i + CELL] @ other.T >= like) @ weights for i in range(0, len(unit), CELL)])


def small_class_links(members: DataFrame, like: float) -> DataFrame:
    """rep, links: the copies of other vectors linked, in classes of at most CELL vectors, whole buckets of classes at a time."""
    buckets = F.lit(members.count() // BUCKET + 1)

    def count(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("root").combine_chunks()
        roots, weights = rows.column("root").to_numpy(), rows.column("n").to_numpy()
        v, out = rows.column("v").combine_chunks(), np.zeros(rows.num_rows, np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(roots)) + 1).tolist(), len(roots)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            unit = _matrix(v.slice(start, end - start))
            near = unit @ unit.T >= like
            np.fill_diagonal(near, False)
            out[start:end] = near @ weights[start:end]
        return pa.table({"rep": rows.column("rep"), "links": pa.array(out)})

    return members.groupBy(F.pmod(F.xxhash64("root"), buckets)).applyInArrow(count, "rep long, links long")


def cut_into_cells(members: DataFrame) -> DataFrame:
    """root, cell, reps, weights, unit (packed), weight, centre, radius: classes in the sorted order of a pass, cut every CELL vectors."""
    vector = members.schema["v"].dataType.simpleString()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(batch.column(3).offsets.to_numpy())
            for d in np.unique(lengths):
                part = batch.take(pa.array(np.flatnonzero(lengths == d)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sign_hash(_matrix(part.column(3)), 0))], ["root", "rep", "n", "v", "hash"])

    rows = members.select("root", "rep", "n", "v").mapInArrow(hashes, f"root long, rep long, n long, v {vector}, hash long")
    placed = with_position(rows, ["root", "hash", "rep"], "place", "embedding-order")

    def pack(rows: pa.Table) -> pa.Table:
        unit = _matrix(rows.column("v").combine_chunks())
        centre = unit.mean(axis=0)
        centre = centre / (np.linalg.norm(centre) or 1.0)
        radius = float(np.arccos(np.clip(unit @ centre, -1, 1)).max()) if centre.any() else math.pi
        weights = rows.column("n").to_numpy()
        packed = [rows.column("rep").to_numpy().tobytes(), weights.tobytes(), unit.tobytes()]
        one = {"root": rows.column("root")[:1], "cell": pa.array([rows.column("place")[0].as_py() // CELL], pa.int64())}
        return pa.table({**one, **{k: pa.array([p], pa.binary()) for k, p in zip(("reps", "weights", "unit"), packed, strict=True)}, "weight": pa.array([int(weights.sum())], pa.int64()), "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": pa.array([radius], pa.float64())})

    schema = "root long, cell long, reps binary, weights binary, unit binary, weight long, centre array<double>, radius double"
    return materialize(placed.groupBy("root", F.floor(F.col("place") / CELL).alias("cell")).applyInArrow(pack, schema), "embedding-cells")


def large_class_links(members: DataFrame, like: float) -> DataFrame:
    """rep, links: as small_class_links, for classes of any size, by pairs of cells."""
    cells = cut_into_cells(members)
    sides = cells.select("root", "cell", "weight", "centre", "radius")
    last = sides.groupBy("root").agg(F.max("cell").alias("last"))
    right = sides.select("root", F.col("cell").alias("j"), F.col("weight").alias("weight_j"), F.col("centre").alias("centre_j"), F.col("radius").alias("radius_j"))
    left = sides.join(last, "root").withColumnRenamed("cell", "i").withColumn("j", F.explode(F.sequence("i", "last")))
    limit = math.acos(like)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All of two cells link (1) or some may (0); pairs of which none can are left out."""
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.array(batch.column(c).to_pylist()) for c in (4, 7))
            apart, reach = np.arccos(np.clip((a * b).sum(axis=1), -1, 1)), batch.column(5).to_numpy() + batch.column(8).to_numpy()
            same = batch.column(1).to_numpy() == batch.column(2).to_numpy()
            apart[same] = 0.0
            whole = apart + reach < limit - _SLACK
            kept = pa.array(np.flatnonzero(apart - reach <= limit + _SLACK))
            columns = [batch.column(c).take(kept) for c in (0, 1, 2, 3, 6)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(whole).take(kept)], ["root", "i", "j", "weight_i", "weight_j", "whole"])

    joined = left.join(right, ["root", "j"]).select("root", "i", "j", "weight", "centre", "radius", "weight_j", "centre_j", "radius_j")
    pairs = materialize(joined.mapInArrow(decide, "root long, i long, j long, weight_i long, weight_j long, whole boolean"), "embedding-cell-pairs")
    whole = pairs.where("whole")
    # a cell whose vectors all link with one another counts each vector but itself
    added = whole.select("root", F.col("i").alias("cell"), F.col("weight_j").alias("more"), (F.col("i") == F.col("j")).cast("int").alias("own"))
    added = added.union(whole.where("i <> j").select("root", F.col("j").alias("cell"), F.col("weight_i").alias("more"), F.lit(0).alias("own")))
    added = added.groupBy("root", "cell").agg(F.sum("more").alias("more"), F.max("own").alias("own"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for reps, weights, more, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                links = more - own * np.frombuffer(weights, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(reps, np.int64)), pa.array(links)], ["rep", "links"])

    told = cells.join(added, ["root", "cell"]).select("reps", "weights", "more", "own").mapInArrow(spread, "rep long, links long")
    open_pairs = pairs.where("not whole").select("root", "i", "j")
    both = open_pairs.withColumn("cell", F.col("i")).union(open_pairs.where("i <> j").withColumn("cell", F.col("j")))

    def count(rows: pa.Table) -> pa.Table:
        packed = [[np.frombuffer(x, t) for x in rows.column(c).to_pylist()] for c, t in (("reps", np.int64), ("weights", np.int64), ("unit", np.float64))]
        reps, weights = packed[0], packed[1]
        unit = [u.reshape(len(r), -1) for u, r in zip(packed[2], reps, strict=True)]
        if len(reps) == 1:
            links = [_counts(unit[0], unit[0], weights[0], like) - weights[0]]
        else:
            links = [_counts(unit[0], unit[1], weights[1], like), _counts(unit[1], unit[0], weights[0], like)]
        return pa.table({"rep": pa.array(np.concatenate(reps)), "links": pa.array(np.concatenate(links))})

    compared = both.join(cells.select("root", "cell", "reps", "weights", "unit"), ["root", "cell"]).groupBy("root", "i", "j").applyInArrow(count, "rep long, links long")
    return told.union(compared).groupBy("rep").agg(F.sum("links").alias("links"))


def near_duplicate_vectors(vectors: DataFrame, like: float = LIKE, window: int = WINDOW, miss: float = MISS, column: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links (other vectors linked), component_id (the smallest vec_id reachable), kept, for each row."""
    rows = keyed(vectors, column, label)
    reps = rows.where("key is not null").groupBy("key", "label", "v").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
    reps = materialize(reps.withColumn("rep", F.monotonically_increasing_id()), "embedding-representatives")
    found = pass_links(reps, passes_for(reps.count(), like, window, miss), like, window)
    roots = components(materialize(found, "embedding-links"))
    members = materialize(reps.join(roots.withColumnRenamed("row", "rep"), "rep").select("rep", "root", "n", "least", "v"), "embedding-members")
    total = members.count()
    classes = materialize(members.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.min("least").alias("first")), "embedding-classes")
    sized = look_up(members, classes.select("root", "size", F.col("size").alias("of"), "first"), "root", "size", total)
    sized = materialize(sized, "embedding-sized")
    links = small_class_links(sized.where(F.col("of") <= CELL), like).union(large_class_links(sized.where(F.col("of") > CELL), like))
    told = reps.select("rep", "key", "n", "least").join(sized.select("rep", "first").join(links, "rep"), "rep", "left")
    told = told.select("key", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("first", "least").alias("component"))
    out = look_up(rows.select("vec_id", "key"), materialize(told, "embedding-told"), "key", "n", rows.count())
    component = F.when(F.col("key").isNotNull(), F.col("component")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
