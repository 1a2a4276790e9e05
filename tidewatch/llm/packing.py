"""Packing token sequences by shortest-pack-first over the length histogram.

Each document becomes its token ids and an end id, cut into full pieces of max_tokens and a rest. Only the histogram of
piece lengths (at most max_tokens rows) reaches the driver. There the lengths are placed longest first: a run of equal
pieces goes onto the packs that are shortest so far, if it fits there, else opens packs; packs of one pattern are kept
as one entry with a count. Each step is a run (length, ranks, sequences, offset), and pieces find their run by their
rank among the pieces of their length.

Nulls: a null text is an empty document, so just the end id. A null doc_id is kept. Repeated rows are separate
documents. Pieces of equal length
are ranked by doc_id, then start. An empty table gives no rows. Other columns are ignored. Long texts are cut, never shortened.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import materialize, rank_within

MAX_TOKENS = 2048
END_ID = 1
#: Entries of the chunk cache of one Python worker before it starts anew.
CACHE_ENTRIES = 300_000
#: Runs of 40 bytes each that may be broadcast.
BROADCAST_RUNS = 200_000
SPECIAL = {"<|endoftext|>": 50256}


#: Runs of so many white-space characters or more are cut out before the pattern sees them, which backtracks through each.
LONG_RUN = 1000
#: What the pattern calls white space (fixed values).
WHITE_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Irregular(Exception):
    """A text with spaces beside other white space, which can't be cut at its spaces."""


class Encoder(dict):
    """Byte-level BPE ids as little-endian 32-bit bytes; equal to the tokenizers library's ids for the same vocabulary.

    The pre-tokenizer always cuts before a space that stands between two characters which aren't white space, so texts
    are cut there and the ids of each chunk are remembered. Texts with other spaces are encoded at once. The strings of
    special tokens are those tokens; without any they are plain text.
    """

    def __init__(self, ranks_path: str, pattern: str, special: dict[str, int] | None = None):
        import base64
        import re

        import numpy as np
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.np = np
        self.special = special or {}
        self.token_bytes = {i: b for b, i in ranks.items()}
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.special)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.long_run = re.compile(f"[{WHITE_SPACE}]{{{LONG_RUN},}}")

    def ordinary(self, text: str) -> list[int]:
        """The ids of a text without special tokens.

        The pattern takes a run of white space before another character as one piece less its last character, and a run at the end whole. So
        a long run is encoded as such a piece by itself, and the pattern goes on behind it.
        """
        if len(text) < LONG_RUN:
            return self.bpe.encode_ordinary(text)
        ids, at = [], 0
        for run in self.long_run.finditer(text):
            end = run.end() - (run.end() < len(text))
            ids += self.bpe.encode_ordinary(text[at : run.start()]) if at < run.start() else []
            ids += self.bpe._encode_single_piece(text[run.start() : end])
            at = end
        return ids + self.bpe.encode_ordinary(text[at:])

    def ids(self, text: str) -> list[int]:
        if self.cut is None:
            return self.ordinary(text)
        return [i for part in self.cut.split(text) for i in ([self.special[part]] if part in self.special else self.ordinary(part))]

    def whole(self, text: str) -> bytes:
        return self.np.asarray(self.ids(text), dtype="<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise Irregular
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        ids = self.whole(" " + chunk)
        if len(chunk) < 64:
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if not rest or not first or first[-1].isspace():
            return self.whole(text)
        try:
            return self.whole(first) + b"".join(map(self.__getitem__, rest))
        except Irregular:
            return self.whole(text)


def default_encoder() -> Encoder:
    import public_tokenizers

    return Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, SPECIAL)


def token_pieces(docs: DataFrame, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, with_ids: bool = False, encoder=default_encoder) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids) for each piece of each document."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            out: list[list] = [[] for _ in range(5 + with_ids)]
            for i, doc_id in enumerate(ids):
                data = enc.encode(texts[i].as_py() or "") + end
                n = len(data) // 4
                for start in range(0, n, max_tokens):
                    piece = data[4 * start : 4 * (start + max_tokens)]
                    for col, v in zip(out, (doc_id, start, len(piece) // 4, zlib.crc32(piece), n, piece), strict=False):
                        col.append(v)
            types = [pa.int64()] * 5 + [pa.binary()] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], schema.replace(",", "").split()[::2])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


def pack_histogram(histogram: dict[int, int], max_tokens: int = MAX_TOKENS) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, end rank, sequence of the first, offset), by shortest-pack-first, longest length first."""
    packs: list[tuple[int, int, int]] = []  # a heap of (tokens so far, first sequence, count)
    runs, opened = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left and packs and packs[0][0] + length <= max_tokens:
            tokens, first, count = heapq.heappop(packs)
            m = min(count, left)
            runs.append((length, rank, rank + m, first, tokens))
            heapq.heappush(packs, (tokens + length, first, m))
            if count > m:
                heapq.heappush(packs, (tokens, first + m, count - m))
            rank, left = rank + m, left - m
        if left:  # new packs, each filled with this length before the next is opened
            deep = max_tokens // length
            for count, layers in ((left // deep, deep), (1, left % deep)):
                if count and layers:
                    for k in range(layers):
                        runs.append((length, rank, rank + count, opened, k * length))
                        rank += count
                    heapq.heappush(packs, (layers * length, opened, count))
                    opened += count
    return runs


def pack_documents(docs: DataFrame, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, with_ids: bool = False, encoder=default_encoder) -> DataFrame:
    """The pieces with their sequence_id and their offset in that sequence."""
    spark = docs.sparkSession
    pieces = token_pieces(docs, max_tokens, end_id, with_ids, encoder)
    columns = pieces.columns
    pieces = materialize(pieces.withColumn("_row", F.monotonically_increasing_id()), "pack-pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    placed = pack_histogram(histogram, max_tokens)
    runs = spark.createDataFrame(placed, "_length long, _first long, _end long, _sequence long, _offset long")
    ranked = rank_within(pieces, ["length"], ["doc_id", "start", "ids_crc32", "doc_tokens", "_row"], "_rank", sum(histogram.values()))
    # there are a few runs for each length; most pieces may be of one length, so the runs are broadcast, beyond BROADCAST_RUNS
    # (very large max_tokens) by Spark's own threshold only
    found = ranked.join(F.broadcast(runs) if len(placed) <= BROADCAST_RUNS else runs, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end")))
    return found.select(*columns, (F.col("_sequence") + F.col("_rank") - F.col("_first")).alias("sequence_id"), F.col("_offset").alias("offset"))
