"""Token alignment against the whole texts' tokens and their byte ranges."""

import hashlib
import random
from collections import Counter, defaultdict

import corpus
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidewatch.llm import alignment as A


def byte_table():
    """The byte that each character of a byte-level token stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in shown}
    return table | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}


def plain(texts):
    """For each text n_a, n_b, groups, links by their byte ranges."""
    first = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    table, out = byte_table(), []
    for text in texts:
        if not text:
            out.append((0, 0, [], []))
            continue
        a = first.encode(" " + text, add_special_tokens=False).ids
        b = second.encode(text)
        bytes_a = [bytes(table[c] for c in first.id_to_token(i)) for i in a]
        pieces = [second.id_to_piece(i) for i in b]
        bytes_b = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces, strict=True)]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            out.append((0, 0, [], []))
            continue
        ranges = []
        for side in (bytes_a, bytes_b):
            at, own = 0, []
            for t in side:
                own.append((at, at + len(t)))
                at += len(t)
            ranges.append(own)
        ends = sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]})
        groups, start = [], 0
        for end in ends:
            groups.append(tuple([i for i, (s, e) in zip(ids, own, strict=True) if start <= s and e <= end] for ids, own in zip((a, b), ranges, strict=True)))
            start = end
        links = [(x, y) for x, (s, e) in zip(a, ranges[0], strict=True) for y, (t, u) in zip(b, ranges[1], strict=True) if max(s, t) < min(e, u)]
        out.append((len(a), len(b), groups, links))
    return out


def expected(texts):
    found = plain(texts)
    docs = Counter(p for *_, links in found for p in set(links))
    top = defaultdict(int)
    for (x, _), n in docs.items():
        top[x] = max(top[x], n)
    rows = []
    for na, nb, groups, links in found:
        shown = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        rows.append((na, nb, len(groups), len(links), sum(docs[p] == top[p[0]] for p in links), sum(docs[p] for p in links), hashlib.sha256(shown.encode()).hexdigest() if na else "", shown))
    return rows


def odd_texts():
    rng = random.Random(7)
    bits = ["word", "naïve", "漢字", "🙂", " ", "  ", "\n", "\t", " ", "12345", "don't", "<|endoftext|>", "</s>", "<0x41>", "▁", "ﬀ", "\x00", "é", "ÿ", "."]
    return ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(1, 30))) for _ in range(150)]


@pytest.mark.parametrize("block_bytes", [400, 8_000_000])
def test_equals_the_byte_ranges(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(A, "BLOCK_BYTES", block_bytes)
    texts = [t[:3000] if t else t for t in corpus.texts(40)] + odd_texts()
    rows = corpus.rows(texts)
    want = Counter(zip([r[0] for r in rows], expected([r[1] for r in rows]), strict=True))
    docs = spark.createDataFrame(rows, corpus.COLUMNS).repartition(3)
    got = A.align_documents(docs, with_groups=True).collect()
    assert Counter((r["doc_id"], tuple(r)[1:]) for r in got) == want


def test_long_white_space_and_long_words(spark):
    texts = [" " * 1_200_000 + "a", "\n" * 1_200_000 + "b", "x" * 300_000, "ab " * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in A.align_documents(docs).collect():
        assert r["n_a"] > 0 and r["n_links"] == r["n_a"] + r["n_b"] - r["n_groups"]


def test_empty_tables_and_texts_without_tokens(spark):
    assert A.align_documents(corpus.empty(spark)).count() == 0
    rows = A.align_documents(spark.createDataFrame([(1, None), (2, ""), (None, "a▁b")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, *tuple(r)[1:]) for r in rows) == [(k, 0, 0, 0, 0, 0, 0, "") for k in range(3)]


def test_the_residual_changes_sides():
    token = lambda words: A.Tokenizer(list, words.__getitem__)
    t = A.Transducer(token([b"ab", b"cde", b"f"]), token([b"a", b"bcd", b"ef"]))
    groups, links = t.align([0, 1, 2], [0, 1, 2])
    assert groups == ["0,1,2|0,1,2"] and links == [x << 32 | y for x, y in ((0, 0), (0, 1), (1, 1), (1, 2), (2, 2))]
    assert t.steps[0, b"ab", 0] == (0, b"b") and t.steps[0, b"b", 1] == (1, b"cd")
    for a, b in (([0], [0]), ([0, 0], [0, 1]), ([0], [0, 1, 2])):
        with pytest.raises(A.Differ):
            t.align(a, b)


def test_pieces_beyond_the_cache_are_aligned_anew(monkeypatch):
    monkeypatch.setattr(A, "CACHE_ENTRIES", 5)
    t = A.Transducer(A.byte_bpe(), A.piece_bpe())
    texts = [x for x in corpus.texts(30) if x]
    assert [t.document(x)[:4] for x in texts] == [(na, nb, len(g), ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g)) for na, nb, g, _ in plain(texts)]
    assert len(t.pieces) <= 5 + 10_000 and len(t.steps) <= 5
