"""Benchmark decontamination over a positional inverted index.

The index is split by documents, as search engines split theirs: the documents of a scan task form blocks of about
BLOCK_BYTES of text and at most BLOCK_DOCS documents. A block is one row with its documents, its terms, and the positions of
each term, which run on through its documents. All postings of a document are in one block; matching therefore needs no
shuffle, and a term or passage that every document has costs each block the same. The index holds all terms of the
documents, so one stored index serves any query set.

A query set (the benchmark) is cut into windows of terms, and is handed to the tasks in blocks of about QUERY_WORDS words, one
after another; the driver holds one of them at a time. In each index block, the windows with a term that the block lacks
fall away at once; for the others the posting lists are intersected from the rarest term on, each shifted by its place in
the window. An exact phrase has all its terms at one start. A proximity match is a start for which each term has an
occurrence within slop words of its place; the start itself may lie before the document or after it. All terms of a match lie in
one document, whatever the slop. Its span reaches from the first to the last of the occurrences, each the nearest to its place and
of two equally near ones the first.

Words: A-Z is lower-cased, then runs of digits, a-z and non-ASCII characters. An item of fewer than `window` words, but
not none, is one window. Nulls: a null text has no words; items with a null item_id are left out. A null doc_id
is kept. Repeated rows are separate documents; repeated items count once by item_id. Empty tables: no documents give no
rows, no items give no hits. Other columns are ignored. Texts are handled whole; a text of more than BLOCK_BYTES is a
block of its own.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import LOWER, UPPER, arrow_batches, materialize, shared_folder, with_row_key

WINDOW = 10
BLOCK_BYTES = 4 << 20
#: Documents of a block at most, which bounds its row where texts are short.
BLOCK_DOCS = 1 << 16
#: Blocks of a Parquet row group, which its writer and its readers hold whole, whatever the length of the task's input.
GROUP_BLOCKS = 1
QUERY_WORDS = 200_000
#: Lower-cases A-Z, keeps digits, a-z and bytes of non-ASCII characters, makes all else a space.
WORD_BYTES = bytes((UPPER + LOWER).encode().find(b) % 26 + 97 if chr(b) in UPPER + LOWER else b if 48 <= b <= 57 or b >= 128 else 32 for b in range(256))

INDEX = "block long, doc_ids array<long>, lengths array<int>, terms array<binary>, sizes array<int>, positions binary"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


class Numbers(dict):
    """Word -> its number in the order of first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Queries:
    """The windows of a block of items, as rows of term numbers; short windows are filled with -1."""

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW):
        number = Numbers()
        rows: dict[tuple[int, ...], set] = {}
        for item_id, text in items:
            terms = [number[w] for w in words(text)]
            for i in range(max(1, len(terms) - window + 1) if terms else 0):
                rows.setdefault(tuple(terms[i : i + window]), set()).add(item_id)
        self.terms = list(number)
        self.windows = np.full((len(rows), window), -1, dtype=np.int32)
        for k, terms in enumerate(rows):
            self.windows[k, : len(terms)] = terms
        self.items = list(rows.values())
        self.lengths = (self.windows >= 0).sum(1)


def query_blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = QUERY_WORDS) -> Iterator[Queries]:
    """The windows of the items in blocks of about block_words words; one at least."""
    held: list = []
    size, none = 0, True
    for item_id, text in benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").toLocalIterator():
        held.append((item_id, text))
        size += len(words(text))
        if size >= block_words:
            yield Queries(held, window)
            held, size, none = [], 0, False
    if held or none:
        yield Queries(held, window)


class Block:
    """The postings of an index block: positions by term, and where its documents begin and end."""

    def __init__(self, lengths: np.ndarray, terms: list[bytes], sizes: np.ndarray, positions: np.ndarray):
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.number = {t: i for i, t in enumerate(terms)}
        self.cuts = np.concatenate([[0], np.cumsum(sizes)])
        self.positions = positions

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.cuts[term] : self.cuts[term + 1]]


def _exact(lists: list[np.ndarray], places: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents and spans of an exact phrase from its terms' positions, the rarest first."""
    starts, n = lists[0] - places[0], len(places)
    for other, place in zip(lists[1:], places[1:], strict=True):
        wanted = starts + place
        starts = starts[other[np.minimum(np.searchsorted(other, wanted), len(other) - 1)] == wanted]
        if not len(starts):
            break
    doc = np.searchsorted(block.ends, np.maximum(starts, 0), "right")
    inside = (starts >= 0) & (starts + n <= block.ends[doc])
    doc, first = doc[inside], starts[inside] - block.starts[doc[inside]]
    return doc, first, first + n


def _near(lists: list[np.ndarray], places: np.ndarray, block: Block, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _exact, with each term up to slop words off its place; candidate starts lie around the rarest term's occurrences."""
    around = np.arange(-slop, slop + 1)
    doc = np.repeat(np.searchsorted(block.ends, lists[0], "right"), len(around))
    doc, starts = np.unique(np.stack([doc, (lists[0].astype(np.int64)[:, None] - places[0] + around).ravel()]), axis=1)
    low, high = block.starts[doc], block.ends[doc]
    first, last = high, low - 1
    for other, place in zip(lists, places, strict=True):
        target = starts + place
        at = np.searchsorted(other, np.clip(target, low, high))
        before, after = other[np.maximum(at - 1, 0)], other[np.minimum(at, len(other) - 1)]
        ok_before = (at > 0) & (before >= np.maximum(target - slop, low)) & (before < high)
        ok_after = (at < len(other)) & (after <= np.minimum(target + slop, high - 1)) & (after >= low)
        nearest = np.where(ok_before & (~ok_after | (target - before <= after - target)), before, after)
        ok = ok_before | ok_after
        first, last = np.minimum(first, nearest)[ok], np.maximum(last, nearest)[ok]
        doc, starts, low, high = doc[ok], starts[ok], low[ok], high[ok]
        if not len(doc):
            break
    return doc, first - low, last + 1 - low


def matches(block: Block, queries: Queries, slop: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(window, documents, firsts, ends) for each window that occurs in a block: the documents by place, and the spans."""
    if not len(queries.windows) or not len(block.ends):
        return
    # the last entries are for the fill of short windows, which comes last in each order
    of_term = np.array([*(block.number.get(t, -1) for t in queries.terms), -1])
    sizes = np.append(np.where(of_term[:-1] >= 0, np.append(np.diff(block.cuts), 0)[of_term[:-1]], 0), 1 << 60)
    counts = sizes[queries.windows]
    for k in np.nonzero(counts.min(axis=1) > 0)[0]:
        order = np.argsort(counts[k], kind="stable")[: queries.lengths[k]]
        lists = [block.postings(t) for t in of_term[queries.windows[k][order]]]
        found = _near(lists, order, block, slop) if slop else _exact(lists, order, block)
        if len(found[0]):
            yield int(k), *found


def build_index(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The stored postings of docs: a row for each block, with its documents and the int32 positions term by term."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        number = Numbers()
        ids: list = []
        lengths: list[int] = []
        terms: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            term = np.concatenate(terms)
            place = np.argsort(term, kind="stable").astype(np.int32)
            sizes = np.bincount(term, minlength=len(number)).astype(np.int32)
            row = ([block], [ids], [lengths], [list(number)], [sizes], [place.tobytes()])
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], INDEX.replace(",", "").split()[::2])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = (text.as_py() or "").encode()
                if ids and (size + len(data) > block_bytes or len(ids) >= BLOCK_DOCS):
                    yield flush()
                    block, size, number = block + 1, 0, Numbers()
                    ids, lengths, terms = [], [], []
                found = data.translate(WORD_BYTES).split()
                terms.append(np.fromiter(map(number.__getitem__, found), np.int32, len(found)))
                ids.append(doc_id)
                lengths.append(len(found))
                size += len(data)
        if ids:
            yield flush()

    with arrow_batches(docs.sparkSession, BLOCK_BYTES):  # as the texts are cut into blocks anyway
        return materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(index, INDEX), "postings", compression="zstd", **{"parquet.block.row.count.limit": str(GROUP_BLOCKS)})


HITS = "block long, place int, doc_id long, n_words long, spans array<array<int>>, items array<long>"


def merged(spans: list) -> list[list[int]]:
    """The union of [start, end) spans."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def search_block(index: DataFrame, queries: Queries, slop: int = 0, hits_only: bool = False) -> DataFrame:
    """For each indexed document the spans of words that windows of this query block cover, and the windows' items."""
    shared = index.sparkSession.sparkContext.broadcast(queries)
    names = HITS.replace(",", "").split()[::2]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.int64()))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                number, ids, lengths, terms, sizes, data = (batch.column(k)[row] for k in range(6))
                lengths, ids = np.asarray(lengths.values, dtype=np.int64), ids.as_py()
                block = Block(lengths, terms.as_py(), np.asarray(sizes.values, dtype=np.int64), np.frombuffer(data.as_buffer(), np.int32))
                spans: dict[int, list] = {}
                items: dict[int, set] = {}
                for k, documents, first, end in matches(block, queries, slop):
                    for d, a, b in zip(documents.tolist(), first.tolist(), end.tolist(), strict=True):
                        spans.setdefault(d, []).append((a, b))
                        items.setdefault(d, set()).update(queries.items[k])
                places = sorted(spans) if hits_only else range(len(ids))
                out = ([number.as_py()] * len(places), places, [ids[d] for d in places], lengths[list(places)], [merged(spans.get(d, [])) for d in places], [sorted(items.get(d, [])) for d in places])
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names)

    return index.mapInArrow(search, HITS)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0, block_bytes: int = BLOCK_BYTES, block_words: int = QUERY_WORDS) -> DataFrame:
    """doc_id, n_words, spans ([start, end) word ranges that windows cover), items of each row of docs.

    slop 0 asks for exact phrases; with more, each word of a window may be up to so many words off its place.
    """
    return search_index(build_index(docs, block_bytes), benchmark, window, slop, block_words)


def search_index(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0, block_words: int = QUERY_WORDS) -> DataFrame:
    """As find_contamination, over a stored index."""
    blocks = query_blocks(benchmark, window, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return search_block(index, first, slop).drop("block", "place")
    folder = f"{shared_folder(index.sparkSession)}/hits-{uuid.uuid4().hex}"
    for queries in itertools.chain([first, second], blocks):  # a pass over the index for each, which writes hits only
        search_block(index, queries, slop, hits_only=True).write.mode("append").parquet(folder)
    hits = index.sparkSession.read.schema(HITS).parquet(folder)
    # a group has one row for each query block at most
    each = hits.groupBy("block", "place").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("_items"))
    every = search_block(index, Queries([], window), slop).join(each, ["block", "place"], "left")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = pa.array([merged(x or []) for x in batch.column(2).to_pylist()], pa.list_(pa.list_(pa.int32())))
            items = pa.array([x or [] for x in batch.column(3).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), spans, items], ["doc_id", "n_words", "spans", "items"])

    return every.select("doc_id", "n_words", "_spans", "_items").mapInArrow(merge, HITS.split("int, ", 1)[1])


def contamination_digest(found: DataFrame) -> DataFrame:
    """Counts of hit words and items for each document, and a digest of the items' ids sorted as strings."""
    covered = F.aggregate("spans", F.lit(0), lambda n, s: n + s[1] - s[0]).cast("long")
    names = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    return found.select("doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (covered > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs in which no window of the benchmark occurs. Each row by itself, whatever its doc_id."""
    keyed, key = with_row_key(docs, "rows")
    hit = find_contamination(keyed.select(F.col(key).alias("doc_id"), "text"), benchmark, window).where("size(spans) > 0").select(F.col("doc_id").alias(key))
    return keyed.join(materialize(hit, "contaminated"), key, "left_anti").select(*docs.columns)
