"""Near duplicates by a Jaccard join over word shingles, with prefix filters under several global orders.

A document's set is its distinct five-word shingles, as hashes. Two documents link when their sets' Jaccard similarity is
0.75 or more; classes are the connected components. No link is lost: each step below only drops what can't link.

1. Document frequency, packed. Documents fall into batches of about BATCH_BYTES. A batch sends each range of hashes one row
   with its distinct hashes and their counts; the range answers each batch with the hashes that occur in two documents or
   more, and their frequency. A shingle that all documents have is one entry for each batch, not one for each document.
2. Survivors. A document can link only if at least 75 % of its set occurs elsewhere; the others are done. Of equal sets one
   document stands for all.
3. Candidates. Two linked sets share a token among the first n - ceil(0.75 n) + 1 of each, under every global order. Three orders are used:
   by frequency (rare first), by hash upwards, and by hash downwards. Frequency prefixes are posted by token; a pair
   met there must have sizes and places that allow 75 %, and share a token in both prefixes by hash, of which only
   32 bits a token are sent to the pair. Only what passes all three orders is verified, on the whole sets.
4. Large groups. First, documents that share one of their first tokens by hash are compared with one hub of that list; linked ones get the label
   of a document that they are connected to. Then the frequency prefixes are posted, and only lists with several labels are kept:
   pairs of one label need no comparison, so a group of thousands of near copies costs a few rows for each of its documents. Lists with
   too many pairs left are again compared with a hub, another one each round. Where hubs link nothing new, lists with too many pairs are
   split by a further token: linked sets share k tokens among the first n - ceil(0.75 n) + k, so the first k tokens that
   they share are a key for both, and its lists are shorter. The pairs of the lists that are left are compared.
5. Components by alternating large and small stars.

Nulls: a null text has an empty set, linked with nothing. A null doc_id links as others do, but a component's id is its
smallest doc_id that isn't null. Repeated rows are separate documents of equal sets. An empty table gives no rows. Other
columns are ignored, or kept by keep_one_of_each and keep_one_row_of_each. Texts are handled whole. All row keys are made here, so doc_id need not be unique.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import LOWER_BYTES, look_up, materialize, shared_folder, with_row_key

WORDS = 5
#: Similarity in hundredths.
LIKE = 75
BATCH_BYTES = 4 << 20
#: Distinct hashes, over all batches, that one range holds.
RANGE_TOKENS = 1 << 21
#: Hub rounds go on while the pairs left are more than so many for each posting and a round links a new share of the
#: documents, and for so many rounds at most.
PAIRS_EACH, PROGRESS, ROUNDS = 2, 0.02, 8
#: A list of no more pairs than this is compared as it is; longer ones are split by up to so many further tokens.
SHORT_PAIRS, SPLITS = 64, 3
#: Tokens by which likely links are found before all that are left.
FIRST_TOKENS = 4
_C = np.uint64(0x9E3779B97F4A7C15)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hasher:
    """64-bit hashes of a text's words, all at once: a word's bytes, as random numbers, in a polynomial modulo 2**64.

    Running sums over the text are cut at the words and shifted to their start, so no short word is handled by itself. Powers of
    an odd base repeat in their low bits, so long words of few letters may share a polynomial: words of more than LONG bytes
    are hashed by xxHash.
    """

    LONG = 64

    BASE = 0x9E3779B97F4A7C15

    def __init__(self):
        self.number = np.random.default_rng(20_240_101).integers(1, 1 << 63, 256).astype(np.uint64)
        self.space = np.zeros(256, bool)
        self.space[[32, *range(9, 14)]] = True
        self.grow(1 << 16)

    def grow(self, n: int) -> None:
        self.up, self.down = _powers(self.BASE, n), _powers(pow(self.BASE, -1, 1 << 64), n)

    def words(self, text: str | None) -> np.ndarray:
        data = np.frombuffer((text or "").encode().translate(LOWER_BYTES), np.uint8)
        if len(data) > len(self.up):
            self.grow(2 * len(data))
        inside = np.ones(len(data) + 2, bool)
        inside[0] = inside[-1] = False
        inside[1:-1] = ~self.space[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        first, end = edges[::2], edges[1::2]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.number[data] * self.up[: len(data)], out=sums[1:])
        h = (sums[end] - sums[first]) * self.down[first] + (end - first).astype(np.uint64)
        for i in np.flatnonzero(end - first > self.LONG).tolist():
            h[i] = xxhash.xxh3_64_intdigest(data[first[i] : end[i]].tobytes())
        return h ^ (h >> np.uint64(32))


def shingles(text: str | None, hasher: Hasher, width: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles; of all its words where they are fewer."""
    h = hasher.words(text)
    if not len(h):
        return h
    k = min(width, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : len(h) - k + 1 + i]) * _C
        out ^= out >> np.uint64(29)
    return np.unique(out)


def small(tokens: np.ndarray) -> np.ndarray:
    """Sorted 48-bit tokens of sorted 64-bit hashes."""
    out = tokens >> np.uint64(16)
    return out[np.append(True, out[1:] != out[:-1])] if len(out) else out


def pack(sorted_tokens: np.ndarray) -> bytes:
    """Sorted 48-bit tokens as 40-bit steps (all low parts, then all high parts), or as they are where a step is larger."""
    steps = np.diff(sorted_tokens)
    if len(steps) and steps.max() < 1 << 40:
        return b"\1" + sorted_tokens[:1].tobytes() + steps.astype(np.uint32).tobytes() + (steps >> np.uint64(32)).astype(np.uint8).tobytes()
    return b"\0" + sorted_tokens.tobytes()


def unpack(data: bytes) -> np.ndarray:
    if not data[0]:
        return np.frombuffer(data, np.uint64, offset=1)
    n = (len(data) - 9) // 5
    out = np.empty(1 + n, np.uint64)
    out[0] = np.frombuffer(data, np.uint64, 1, offset=1)[0]
    out[1:] = np.frombuffer(data, np.uint32, n, offset=9)
    out[1:] += np.frombuffer(data, np.uint8, offset=9 + 4 * n).astype(np.uint64) << np.uint64(32)
    return np.cumsum(out, dtype=np.uint64)


def folded(tokens: np.ndarray) -> bytes:
    """The sorted 32-bit folds of tokens: equal tokens have equal ones."""
    return np.unique((tokens ^ (tokens >> np.uint64(20))).astype(np.uint32)).tobytes()


def least_overlap(n: int, like: int = LIKE) -> int:
    """The fewest tokens that a set of n shares with any set it links to."""
    return -(-like * n // 100)


def _arrow(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.Table.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


COUNTS = "range int, batch long, tokens binary, counts binary"
ANSWERS = "batch long, range int, tokens binary, frequency binary"
SETS = "row long, doc_id long, n long, fingerprint binary, tokens binary, frequency binary, low binary, high binary"


def document_sets(docs: DataFrame, like: int = LIKE, width: int = WORDS) -> DataFrame:
    """A row for each document: set size, fingerprint of the set, and for survivors the tokens that occur elsewhere, their
    frequency, and the prefixes by hash (low: upwards, high: downwards), shared tokens only, 32 bits of each.

    A batch has one row for each range of which it has tokens, so rows are fewer than batches times ranges and than tokens; larger
    batches and ranges (BATCH_BYTES, RANGE_TOKENS) suit executors with more memory.
    """
    size, count = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    batches = max(1, size // BATCH_BYTES, count // 20_000)
    ranges = min(max(1, size // 6 // RANGE_TOKENS), 65_535)
    # rows that are the same are spread, too
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id() % 1021), F.lit(batches)).alias("batch"))

    def count_batch(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        hasher = Hasher()
        every = [small(shingles(t.as_py(), hasher, width)) for t in group.column("text")]
        tokens, n = np.unique(np.concatenate(every), return_counts=True)
        of_range = (tokens * np.uint64(ranges)) >> np.uint64(48)
        cuts = np.flatnonzero(np.append(True, of_range[1:] != of_range[:-1])) if len(tokens) else np.zeros(0, int)
        batch, out = key[0].as_py(), []
        for a, b in zip(cuts, np.append(cuts[1:], len(tokens)), strict=True):
            out.append((int(of_range[a]), batch, pack(tokens[a:b]), np.minimum(n[a:b], 255).astype(np.uint8).tobytes()))
        return _arrow(out, COUNTS)

    def answer(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        lists = [unpack(x.as_py()) for x in group.column("tokens")]
        counts = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in group.column("counts")]).astype(np.int64)
        every = np.concatenate(lists)
        order = np.argsort(every, kind="stable")
        every = every[order]
        first = np.flatnonzero(np.diff(every, prepend=every[0] + np.uint64(1)))
        frequency = np.add.reduceat(counts[order], first)
        shared = frequency >= 2
        known, frequency = every[first][shared], np.minimum(frequency[shared], 65535).astype(np.uint16)
        out = []
        for batch, own in zip(group.column("batch").to_pylist(), lists, strict=True):
            at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
            hit = known[at] == own if len(known) else np.zeros(len(own), bool)
            if hit.any():
                out.append((batch, key[0].as_py(), pack(own[hit]), frequency[at[hit]].tobytes()))
        return _arrow(out, ANSWERS)

    def finish(group: pa.Table, answers: pa.Table) -> pa.Table:
        parts = sorted(zip(answers.column("range").to_pylist(), answers.column("tokens").to_pylist(), answers.column("frequency").to_pylist(), strict=True))
        known = np.concatenate([np.zeros(0, np.uint64), *(unpack(t) for _, t, _ in parts)])
        frequency = np.concatenate([np.zeros(0, np.uint16), *(np.frombuffer(f, np.uint16) for _, _, f in parts)])
        hasher, out = Hasher(), []
        for doc_id, text in zip(group.column("doc_id").to_pylist(), group.column("text"), strict=True):
            whole = shingles(text.as_py(), hasher, width)
            n, fingerprint = len(whole), hashlib.blake2b(whole.tobytes(), digest_size=16).digest()
            tokens = small(whole)
            row = (0, doc_id, n, fingerprint, None, None, None, None)
            if n and len(known):
                at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                hit = known[at] == tokens
                least = least_overlap(n, like)
                if hit.sum() >= least:
                    p = min(n - least + 1, len(tokens))
                    row = (0, doc_id, n, fingerprint, tokens[hit].tobytes(), frequency[at[hit]].tobytes(), folded(tokens[:p][hit[:p]]), folded(tokens[-p:][hit[-p:]]))
            out.append(row)
        return _arrow(out, SETS)

    by_batch = rows.groupBy("batch")
    counted = by_batch.applyInArrow(count_batch, COUNTS)
    answered = counted.groupBy("range").applyInArrow(answer, ANSWERS)
    sets = by_batch.cogroup(answered.groupBy("batch")).applyInArrow(finish, SETS)
    return materialize(sets.withColumn("row", F.monotonically_increasing_id()), "sets", compression="zstd")


POSTINGS = "token long, row long, root long, n long, place long, centre long"


def _posted(sets: DataFrame, choose) -> DataFrame:
    """token, row, root, n, place, centre for the tokens of each set that choose(n, tokens, frequency) returns with their
    places. centre: the mean frequency of the set's tokens, highest for the text that others are edits of."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                row, root, n = (batch.column(k)[i].as_py() for k in range(3))
                tokens = np.frombuffer(batch.column(3)[i].as_buffer(), np.uint64)
                frequency = np.frombuffer(batch.column(4)[i].as_buffer(), np.uint16)
                token, place = choose(n, tokens, frequency)
                k, centre = len(token), int(1000 * frequency.astype(np.int64).sum() // n)
                if k:
                    out.append((token.astype(np.int64), np.full(k, row), np.full(k, root), np.full(k, n), place, np.full(k, centre)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], ["token", "row", "root", "n", "place", "centre"])

    return sets.select("row", "root", "n", "tokens", "frequency").mapInArrow(post, POSTINGS)


def postings(sets: DataFrame, like: int = LIKE, more: int = 0) -> DataFrame:
    """The shared tokens of each prefix by frequency, and `more` after it; place counts all of the set's tokens, rare first."""

    def choose(n: int, tokens: np.ndarray, frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        alone = n - len(tokens)
        take = max(0, n - least_overlap(n, like) + 1 + more - alone)
        mixed = (tokens ^ (tokens >> np.uint64(21))) * _C
        first = np.lexsort((mixed, frequency))[:take]
        return tokens[first], np.arange(alone, alone + len(first))

    return _posted(sets, choose)


def first_tokens(sets: DataFrame, k: int = FIRST_TOKENS) -> DataFrame:
    """The k first shared tokens of each set by hash: likely the same in similar sets. All have place 0."""
    return _posted(sets, lambda n, tokens, frequency: (tokens[:k], np.zeros(min(k, len(tokens)), np.int64)))


def _sides(pairs: DataFrame, sets: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The pairs (a, b) with these columns of both sets."""
    side = lambda x: sets.select(F.col("row").alias(f"row_{x}"), *(F.col(c).alias(f"{c}_{x}") for c in columns))
    joined = pairs.join(side("a"), F.col("a") == F.col("row_a")).join(side("b"), F.col("b") == F.col("row_b"))
    return joined.select("a", "b", *(f"{c}_{x}" for c in columns for x in "ab"))


def _common(batch: pa.RecordBatch, column: int, i: int, kind: type) -> int:
    """How many tokens two sorted binary columns of a row share."""
    x, y = (np.frombuffer(batch.column(k)[i].as_buffer(), kind) for k in (column, column + 1))
    return np.intersect1d(x, y, assume_unique=True).size


def _filtered(batches: Iterator[pa.RecordBatch], keep) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = pa.array([bool(keep(batch, i)) for i in range(batch.num_rows)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], ["a", "b"])


def meet_by_hash(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that share a token in the prefixes of both orders by hash."""
    keep = lambda batch, i: _common(batch, 2, i, np.uint32) and _common(batch, 4, i, np.uint32)
    return _sides(pairs, sets, ("low", "high")).mapInArrow(lambda batches: _filtered(batches, keep), "a long, b long")


def verify(pairs: DataFrame, sets: DataFrame, like: int = LIKE) -> DataFrame:
    """The pairs (a, b) whose whole sets are alike enough; those that fail an order's filter are dropped before."""

    def keep(batch: pa.RecordBatch, i: int) -> bool:
        common = _common(batch, 4, i, np.uint64)
        return 100 * common >= like * (batch.column(2)[i].as_py() + batch.column(3)[i].as_py() - common)

    return _sides(meet_by_hash(pairs, sets), sets, ("n", "tokens")).mapInArrow(lambda batches: _filtered(batches, keep), "a long, b long")


def may_link(like: int = LIKE):
    """Sizes and places of two postings of a token that leave room for enough common tokens; columns l_ and r_."""
    room = F.least(F.col("l_n") - F.col("l_place"), F.col("r_n") - F.col("r_place"))
    return (100 + like) * room >= like * (F.col("l_n") + F.col("r_n"))


def components(edges: DataFrame) -> DataFrame:
    """row, root: the smallest row that each row of edges (a, b) is connected to, roots included.

    Large and small stars in turn, each round one job; done when a round leaves the edges as they were.
    """
    edges, before = edges.where("a <> b").select("a", "b"), None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        edges = materialize(small, "edges")
        after = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if after == before or not after[0]:
            break
        before = after
    roots = edges.select(F.col("b").alias("row")).distinct()
    return edges.select(F.col("a").alias("row"), F.col("b").alias("root")).unionByName(roots.select("row", F.col("row").alias("root")))


def _pairs(met: DataFrame, tested: DataFrame | None, like: int) -> DataFrame:
    """The different pairs of rows met in a list that aren't of one component, may link and weren't tested."""
    met = met.where((F.col("l_root") != F.col("r_root")) & may_link(like))
    pairs = met.select(F.least("l_row", "r_row").alias("a"), F.greatest("l_row", "r_row").alias("b")).distinct()
    return materialize(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")


def _with_hubs(posted: DataFrame, hub, total: int) -> DataFrame:
    """Each of the `total` postings beside one of its list, the one with the smallest hub."""
    sides = ("row", "root", "n", "place")
    hubs = posted.groupBy("token").agg(F.min(F.struct(hub.alias("_by"), *sides)).alias("h"), F.count(F.lit(1)).alias("size")).where("size > 1")
    hubs = hubs.select("token", "size", *(F.col(f"h.{c}").alias(f"l_{c}") for c in sides))
    # tokens of very many documents are broadcast with their hub
    met = look_up(posted.select("token", *(F.col(c).alias(f"r_{c}") for c in sides)), hubs, "token", "size", total)
    return met.where(F.col("l_row") != F.col("r_row"))


def _labels(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """row, root: the smallest row within two steps of each row over links (a, b), on top of labels.

    Rows of one root are connected; the rows of a component may still have several roots.
    """
    if labels is not None:
        links = links.unionByName(labels.select(F.col("root").alias("a"), F.col("row").alias("b")))
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    one = materialize(both.groupBy(F.col("a").alias("row")).agg(F.least(F.min("b"), F.col("a")).alias("root")), "labels")
    two = both.join(one, F.col("b") == F.col("row")).groupBy(F.col("a").alias("row")).agg(F.min("root").alias("root"))
    return materialize(two, "labels")


def _mixed(posted: DataFrame) -> DataFrame:
    """The postings of lists with several roots, with `pairs`: how many pairs of different roots their list has."""
    lists = posted.groupBy("token", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("token").agg(F.sum("k").alias("size"), ((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).cast("long").alias("pairs")).where("pairs > 0")
    lists = materialize(lists, "lists")
    total = lists.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return materialize(look_up(posted.drop("pairs"), lists, "token", "size", total).where("pairs is not null"), "postings")


def _pairs_of(posted: DataFrame) -> int:
    return posted.select("token", "pairs").distinct().agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]


def _all_met(posted: DataFrame) -> DataFrame:
    side = lambda x: posted.select("token", *(F.col(c).alias(f"{x}_{c}") for c in ("row", "root", "n", "place")))
    return side("l").join(side("r"), "token").where(F.col("l_row") < F.col("r_row"))


def _split(posted: DataFrame, sets: DataFrame, like: int, k: int) -> DataFrame:
    """The postings, keyed by k tokens instead of k - 1: by one more of the same set, behind the last.

    A place is that of the last token, less the tokens of the key before it, so may_link still tells what is left.
    """
    own = sets.join(posted.select("row", "root").distinct(), "row")
    further = postings(own, like, k - 1).select("row", F.col("token").alias("_more"), F.col("place").alias("_at"))
    keyed = posted.select("token", "row", "root", "n", "place").join(further, "row").where(F.col("_at") > F.col("place") + k - 2)
    return keyed.select(F.xxhash64("token", "_more").alias("token"), "row", "root", "n", (F.col("_at") - k + 1).alias("place"))


def link_classes(sets: DataFrame, like: int = LIKE, pairs_each: int = PAIRS_EACH, rounds: int = ROUNDS) -> DataFrame:
    """row, root for the rows of sets (all different) that link to another; rows that link to nothing may be missing."""
    folder = f"{shared_folder(sets.sparkSession)}/jaccard-{uuid.uuid4().hex}"

    def step(met: DataFrame, name: str, first: bool = False) -> DataFrame:
        """Tests the pairs met, adds them and the links among them to the tables of all, and returns these links."""
        tested = None if first else sets.sparkSession.read.schema("a long, b long").parquet(f"{folder}/tested")
        pairs = _pairs(met, tested, like)
        found = materialize(verify(pairs, sets, like), name)
        for table, rows in (("tested", pairs), ("links", found)):
            rows.write.mode("append").parquet(f"{folder}/{table}")
        return found

    # most links of large groups, at a few postings for each document
    likely = materialize(first_tokens(sets.withColumn("root", F.col("row"))), "first-tokens")
    labels = _labels(step(_with_hubs(likely, -F.col("centre"), likely.count()), "links", True))
    # all that may link and isn't connected yet
    relabel = lambda df: df.join(labels, "row", "left").withColumn("root", F.coalesce("root", "row"))
    own = _mixed(postings(relabel(sets), like))
    n, documents = own.count(), sets.count()
    for k in range(rounds):
        left = _pairs_of(own)
        if left <= pairs_each * n:
            break
        found = step(_with_hubs(own, F.xxhash64("row", F.lit(k)) if k else -F.col("centre"), own.count()), "links")
        labels = _labels(found, labels)
        own = _mixed(relabel(own.drop("root")))
        if found.count() < PROGRESS * documents:
            break
    # a list with few pairs is compared; the others are split as long as that leaves less work
    for k in range(2, SPLITS + 2):
        left, n = _pairs_of(own), own.count()
        if left <= pairs_each * n or k == SPLITS + 1:
            break
        short = F.col("pairs") <= SHORT_PAIRS
        deeper = _mixed(_split(own.where(~short), sets, like, k))
        if deeper.count() + _pairs_of(deeper) >= left:
            break
        step(_all_met(own.where(short)), "links")
        own = deeper
    if n and left:
        step(_all_met(own), "links")
    return components(sets.sparkSession.read.schema("a long, b long").parquet(f"{folder}/links"))


def near_duplicates(docs: DataFrame, like: int = LIKE, width: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs."""
    sets = document_sets(docs, like, width)
    shared = sets.where("low is not null")
    classes = materialize(shared.groupBy("fingerprint").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("m"), F.count(F.lit(1)).alias("size")).select("fingerprint", F.col("m.row").alias("row"), F.col("m.doc_id").alias("first"), "size"), "classes")
    stand = materialize(shared.join(classes.select("row"), "row"), "stand-ins", compression="zstd")
    linked = link_classes(stand, like)
    named = linked.join(classes.select("row", "first"), "row")
    # a root that very many rows have is broadcast with its name
    roots = materialize(named.groupBy("root").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("members")), "roots")
    named = look_up(named, roots, "root", "members", roots.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]).select("row", "least")
    of_class = materialize(classes.join(named, "row", "left").select(F.col("fingerprint").alias("_key"), F.coalesce("least", "first").alias("component_id"), "size"), "components")
    # sets without shared tokens, the empty ones among them, have no key: they are their own component
    rows = sets.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("low").isNotNull(), F.col("fingerprint")).alias("_key"))
    joined = look_up(rows, of_class, "_key", "size", sets.count())
    return joined.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, like: int = LIKE, width: int = WORDS) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component; rows without a doc_id stay."""
    gone = near_duplicates(docs, like, width).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(materialize(gone, "near-copies"), "doc_id", "left_anti").select(*docs.columns)


def keep_one_row_of_each(docs: DataFrame, like: int = LIKE, width: int = WORDS) -> DataFrame:
    """One row of each component of docs: the one with the smallest doc_id, and of repeated or no doc_ids any one."""
    keyed, key = with_row_key(docs, "rows")
    found = near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), like, width).select(F.col("doc_id").alias(key), "component_id")
    named = materialize(found.join(keyed.select(key, F.col("doc_id").cast("long").alias("_id")), key), "components")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull(), "_id", key)).alias("m")).select(F.col(f"m.{key}").alias(key))
    gone = named.select(key).join(first, key, "left_anti")
    return keyed.join(materialize(gone, "near-copies"), key, "left_anti").select(*docs.columns)
