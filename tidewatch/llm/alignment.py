"""Alignment of two tokenizers' tokens over the same bytes by a dangling-suffix transducer.

Both token streams spell the same bytes. The transducer reads the side that lags; its state is which side leads and
that side's unmatched bytes, always a suffix of its last token. Transitions are remembered by (side, residual, next token). An empty
residual closes a group. Each step that reads against a residual links the new token with the leader's last one, so every
overlapping pair is found once.

Both tokenizers always cut before a space between two characters that aren't white space, so texts are cut there; what a piece
does from the empty residual to the empty residual is remembered as one transition.

Counts over the corpus: texts are read in blocks of about BLOCK_BYTES. A block has one row for each different linked id pair
in it, with the number of its documents; these rows are added by pair, joined with their totals and given back to their block, where each
document looks its links up. A pair that all documents hold is so one row for each block.

Nulls: a null text, an empty text and one whose tokens' bytes differ from a space and the text have no tokens. A null doc_id is kept.
Repeated rows are separate documents. Equal counts are all highest. An empty table gives no rows. Other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import materialize
from tidewatch.llm.packing import Encoder

BLOCK_BYTES = 8_000_000
#: Pieces of texts that one Python worker remembers, and transitions, before it starts anew.
CACHE_ENTRIES = 200_000
_CUT = re.compile(r"(?<=\S) (?=\S)")


class Differ(Exception):
    """Token bytes that aren't those of the text."""


class Tokenizer:
    """The ids of each of some texts, and the bytes of each id."""

    def __init__(self, ids: Callable[[list[str]], list[list[int]]], token_bytes: Callable[[int], bytes]):
        self.ids, self.token_bytes = ids, token_bytes


def byte_bpe() -> Tokenizer:
    """The byte-level vocabulary, over a space and the text; strings of special tokens are plain text."""
    import public_tokenizers

    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return Tokenizer(lambda texts: [encoder.ordinary(" " + t) for t in texts], encoder.token_bytes.__getitem__)


def piece_bpe() -> Tokenizer:
    """The piece vocabulary, which puts a space before the text by itself."""
    import public_tokenizers
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def token_bytes(i: int) -> bytes:
        piece = pieces.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else piece.replace("▁", " ").encode()

    return Tokenizer(lambda texts: pieces.encode(texts, num_threads=1), token_bytes)


#: n_a, n_b, n_groups, groups as text, links (64-bit a << 32 | b) of a piece.
Piece = tuple[int, int, int, str, bytes]


class Transducer:
    """Aligns texts; remembers the bytes of ids, its transitions and what whole pieces of texts do."""

    def __init__(self, a: Tokenizer, b: Tokenizer):
        self.sides = (a, b)
        self.shown: tuple[dict[int, str], dict[int, str]] = ({}, {})
        self.spelt: tuple[dict[int, bytes], dict[int, bytes]] = ({}, {})
        self.steps: dict[tuple[int, bytes, int], tuple[int, bytes]] = {}
        self.pieces: dict[str, Piece] = {}

    def step(self, leads: int, residual: bytes, token: int) -> tuple[int, bytes]:
        """The side that leads, and its residual, after the other side's token."""
        new = self.spelt[1 - leads][token]
        if residual.startswith(new):
            found = (leads, residual[len(new) :])
        elif new.startswith(residual):
            found = (1 - leads, new[len(residual) :])
        else:
            raise Differ
        if len(self.steps) >= CACHE_ENTRIES:
            self.steps.clear()
        self.steps[leads, residual, token] = found
        return found

    def align(self, a: list[int], b: list[int]) -> tuple[list[str], list[int]]:
        """The groups as text and the links."""
        for side, ids in enumerate((a, b)):
            for i in ids:
                if i not in self.shown[side]:
                    self.shown[side][i], self.spelt[side][i] = str(i), self.sides[side].token_bytes(i)
        (shown_a, shown_b), spelt_a, known = self.shown, self.spelt[0], self.steps.get
        rest_b = iter(b)
        next_a, next_b, groups, links = iter(a).__next__, rest_b.__next__, [], []
        left = len(a)
        try:
            while left:
                x, left = next_a(), left - 1
                of_a, of_b, leads, residual = shown_a[x], "", 0, spelt_a[x]
                while residual:
                    if leads:
                        x, left = next_a(), left - 1
                        of_a, token = f"{of_a},{shown_a[x]}", x
                    else:
                        y = token = next_b()
                        of_b = f"{of_b},{shown_b[y]}" if of_b else shown_b[y]
                    links.append(x << 32 | y)
                    leads, residual = known((leads, residual, token)) or self.step(leads, residual, token)
                groups.append(f"{of_a}|{of_b}")
        except StopIteration:
            raise Differ from None
        if next(rest_b, None) is not None:
            raise Differ
        return groups, links

    def align_pieces(self, texts: list[str]) -> dict[str, Piece]:
        out = {}
        for text, a, b in zip(texts, self.sides[0].ids(texts), self.sides[1].ids(texts), strict=True):
            groups, links = self.align(a, b)
            # streams that align spell the same bytes, and these are a space's and the text's
            if sum(map(len, map(self.spelt[0].__getitem__, a))) != 1 + len(text.encode()):
                raise Differ
            out[text] = (len(a), len(b), len(groups), ";".join(groups), array("q", links).tobytes())
        return out

    def document(self, text: str | None) -> tuple[int, int, int, str, np.ndarray]:
        """n_a, n_b, n_groups, groups, links of a whole text; zeros and nothing where it has no tokens."""
        if text:
            known = self.pieces
            pieces = text.split(" ")
            new = [p for p in dict.fromkeys(pieces) if p not in known]
            if any(not p or p[0].isspace() or p[-1].isspace() for p in new):
                pieces = _CUT.split(text)
                new = [p for p in dict.fromkeys(pieces) if p not in known]
            try:
                fresh = self.align_pieces(new) if new else {}
                na, nb, ng, shown, links = zip(*[known.get(p) or fresh[p] for p in pieces], strict=True)
                if len(known) + len(fresh) > CACHE_ENTRIES:
                    known.clear()
                known.update((p, v) for p, v in fresh.items() if len(p) < 64 and not p[0].isspace() and not p[-1].isspace())
                return sum(na), sum(nb), sum(ng), ";".join(shown), np.frombuffer(b"".join(links), np.int64)
            except Differ:
                pass
        return 0, 0, 0, "", np.zeros(0, np.int64)


_DOCUMENT = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, times binary"


def read_blocks(docs: DataFrame, a: Callable[[], Tokenizer] = byte_bpe, b: Callable[[], Tokenizer] = piece_bpe, with_groups: bool = False) -> DataFrame:
    """A row for each document, with its different links as places in its block's list and how often it has each (32 bits);
    and a row for each block, with the list of its pairs and in how many of its documents each is."""
    schema = f"{_DOCUMENT}, pairs binary, docs binary" + ", groups string" * with_groups
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[f.split()[1]] for f in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = Transducer(a(), b())
        block = TaskContext.get().partitionId() << 32
        rows: list[list] = []
        found: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            sizes = [len(f) for f in found]
            pairs, places, docs_of = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
            ends = np.cumsum(sizes)
            for row, end, n in zip(rows, ends, sizes, strict=True):
                row[7] = places[end - n : end].astype("<u4").tobytes()
            rows.append([block, *[None] * 8, pairs.tobytes(), docs_of.astype("<u4").tobytes()] + [None] * with_groups)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                na, nb, ng, shown, links = transducer.document(text)
                own, times = np.unique(links, return_counts=True)
                found.append(own)
                digest = hashlib.sha256(shown.encode()).hexdigest() if na else ""
                rows.append([block, ids[i].as_py(), na, nb, ng, len(links), digest, None, times.astype("<u4").tobytes(), None, None] + [shown] * with_groups)
                size += len(text or "")
                if size >= BLOCK_BYTES:
                    yield flush()
                    rows, found, size, block = [], [], 0, block + 1
        if rows:
            yield flush()

    return materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(read, schema), "alignment", compression="zstd")


def block_pairs(blocks: DataFrame) -> DataFrame:
    """block, place, a, b, docs: how many documents of the block hold each of its pairs linked."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed, docs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pairs = np.frombuffer(packed, "<i8")
                columns = [np.full(len(pairs), block), np.arange(len(pairs)), pairs >> 32, pairs & 0xFFFFFFFF, np.frombuffer(docs, "<u4").astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["block", "place", "a", "b", "docs"])

    return blocks.where("pairs is not null").select("block", "pairs", "docs").mapInArrow(unpack, "block long, place long, a long, b long, docs long")


def link_counts(pairs: DataFrame) -> DataFrame:
    """a, b, count (documents that hold the two ids linked), best (no other b has a higher count beside this a)."""
    counts = materialize(pairs.groupBy("a", "b").agg(F.sum("docs").alias("count")), "alignment-counts")
    return counts.join(counts.groupBy("a").agg(F.max("count").alias("top")), "a").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))


def align_documents(docs: DataFrame, a: Callable[[], Tokenizer] = byte_bpe, b: Callable[[], Tokenizer] = piece_bpe, with_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and groups as text on demand."""
    blocks = read_blocks(docs, a, b, with_groups)
    pairs = block_pairs(blocks)
    known = pairs.join(link_counts(pairs), ["a", "b"]).select("block", "place", "count", "best")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + ", groups string" * with_groups
    names = [f.split()[0] for f in schema.split(", ")]

    def look_up(rows: pa.Table, known: pa.Table) -> pa.Table:
        size = known.num_rows
        place = known.column("place").to_numpy()
        count, best = np.zeros(size, np.int64), np.zeros(size, bool)
        count[place], best[place] = known.column("count").to_numpy(), known.column("best").to_numpy(zero_copy_only=False)
        sums: list[tuple[int, int]] = []
        for links, times in zip(rows.column("links").to_pylist(), rows.column("times").to_pylist(), strict=True):
            at, n = np.frombuffer(links, "<u4"), np.frombuffer(times, "<u4").astype(np.int64)
            sums.append((int(n[best[at]].sum()), int((count[at] * n).sum())))
        found = rows.append_column("n_best", pa.array([s[0] for s in sums], pa.int64())).append_column("count_sum", pa.array([s[1] for s in sums], pa.int64()))
        return found.select(names)

    rows = blocks.where("pairs is null").drop("pairs", "docs")
    return rows.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(look_up, schema)
