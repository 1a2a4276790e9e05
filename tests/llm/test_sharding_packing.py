import heapq
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from corpus import empty, frame, rows, texts
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewatch.llm.common import materialize, rank_within
from tidewatch.llm.packing import default_encoder, pack_documents, pack_histogram
from tidewatch.llm.sharding import deal, shard_documents


def test_groups_stay_together_and_loads_are_near_equal(spark):
    values = texts(400)
    for heavy in (2048, 2):  # all groups one by one, nearly all by classes
        out = shard_documents(frame(spark, values), 4, heavy).collect()
        assert len(out) == len(rows(values))
        of, load, slots = defaultdict(set), Counter(), defaultdict(list)
        crc = {(i, zlib.crc32((t or "").encode())) for i, t, *_ in rows(values)}
        for r in out:
            of[r["group"] and bytes(r["group"])].add(r["shard"])
            load[r["shard"]] += r["size"]
            slots[r["shard"]].append(r["slot"])
            assert (r["doc_id"], r["text_crc32"]) in crc
        assert all(len(x) == 1 for x in of.values())
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())
        assert sum(load.values()) == sum(len((t or "").encode()) + 1 for _, t, *_ in rows(values))
        largest = max(map(len, (t.encode() for t in values if t)))
        assert max(load.values()) - min(load.values()) <= 2 * largest


def test_dealing_classes_equals_a_heap():
    heavy, classes = [("a", 900), ("b", 400), ("c", 390)], [(5, 1003, 1003 * 7), (3, 50, 50 * 3)]
    _, runs, loads = deal(heavy, classes, 3)
    heap = [0.0] * 3
    for size in [900, 400, 390] + [7] * 1003 + [3] * 50:
        heapq.heapreplace(heap, heap[0] + size)
    assert sorted(loads) == sorted(heap)
    assert sum(b - a for c, a, b, _ in runs if c == 5) == 1003


def test_sharding_an_empty_table(spark):
    assert shard_documents(empty(spark)).collect() == []
    assert pack_documents(empty(spark)).collect() == []


def test_ids_equal_the_tokenizers_library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = default_encoder()
    more = ["", " a", "a ", "a\n b", "don't  we'll it's", "a <|endoftext|> b", "x<|endoftext|>", "a b c", "1 2 33 ... !? \t x", "a b　 c"]
    for text in [*(x for x in texts() if x is not None), *more]:
        assert encoder.encode(text) == np.asarray(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)[:80]


def test_ids_of_thousands_of_random_texts_equal_the_library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder, rng = default_encoder(), np.random.default_rng(8)
    pieces = [" ", "  ", "\n", "\t", "\u00a0", "\u2003", "\u2028", "\u3000", "\u0085", "\x1c", "'s", "don't", "I'LL", "Straße", "naïve", "漢字", "🙂", "👩‍🔬", "e\u0301", "\u200d", "12", "3.14", "a" * 70, "xyz" * 30, "!!!", "...", "<|endoftext|>", "<|", "_", "ʼn", "ﬁ", "\x00", "\x7f", "\ufeff", "\ud7ff", "İ", "the", "of", "and", "Word"]
    for _ in range(4000):
        text = "".join(pieces[i] for i in rng.integers(0, len(pieces), rng.integers(1, 14)))
        assert encoder.encode(text) == np.asarray(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), ascii(text)


def test_pieces_cover_documents_and_sequences_hold_them(spark):
    values = texts()
    out = pack_documents(frame(spark, values), 256, with_ids=True).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((i, np.asarray([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, x, *_ in rows(values))
    pieces, sequences, got = defaultdict(list), defaultdict(list), Counter()
    for r in out:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    for doc_id, n in Counter(i for i, _ in want.elements()).items():
        own = sorted(pieces[doc_id], key=lambda r: r["start"])
        for k in range(n):
            got[doc_id, b"".join(r["ids"] for r in own[k::n])] += 1
    assert got == want
    tokens = sum(r["length"] for r in out)
    assert len(sequences) * 256 < tokens * 1.05


def test_shortest_pack_first_equals_one_piece_at_a_time():
    rng = np.random.default_rng(1)
    for _ in range(20):
        histogram = dict(Counter(rng.integers(1, 65, 300).tolist()))
        heap: list[int] = []
        for length in sorted(Counter(histogram).elements(), reverse=True):
            if heap and heap[0] + length <= 64:
                heapq.heapreplace(heap, heap[0] + length)
            else:
                heapq.heappush(heap, length)
        loads = Counter()
        for length, a, b, s, offset in pack_histogram(histogram, 64):
            for k in range(b - a):
                assert offset == loads[s + k] or offset + length <= 64
                loads[s + k] += length
        assert sorted(loads.values()) == sorted(heap)


def test_long_white_space_has_the_library_ids():
    encoder = default_encoder()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in (" " * 2_000_000 + "a", "\n" * 2_000_000 + "b", "c" + "\t" * 2_000_000):
        assert len(encoder.encode(text)) > 0
    rng = np.random.default_rng(9)
    for _ in range(60):
        runs = [str(rng.choice([" ", "\n", "\t", "　", " \n", "\u0085"])) * int(rng.choice([1, 999, 1000, 1001, 2500])) for _ in range(3)]
        words = rng.choice(["a", "12", "<|endoftext|>", "é!", "'s"], 4).tolist()
        text = "".join(x + y for x, y in zip(words, [*runs, ""], strict=True))[int(rng.integers(0, 2)) :]
        assert encoder.encode(text) == np.asarray(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), ascii(text[:60])


def test_repeated_rows_are_spread_over_buckets(spark):
    docs = spark.createDataFrame([(1, "same text")], "doc_id long, text string").crossJoin(spark.range(200_000)).select("doc_id", "text")
    rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "repeated")
    windows = rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "_row"), F.lit(int(200_000**0.5)))).groupBy("_bucket").count()
    assert windows.agg(F.max("count")).first()[0] < 2000
    ranks = rank_within(rows, [], ["doc_id", "_row"], "rank").agg(F.countDistinct("rank"), F.max("rank")).first()
    assert tuple(ranks) == (200_000, 199_999)
    packed = pack_documents(docs.limit(30_000), 64).agg(F.countDistinct("sequence_id", "offset"), F.count(F.lit(1))).first()
    assert packed[0] == packed[1] == 30_000
    assert shard_documents(docs.limit(30_000), 4).groupBy("shard", "slot").count().where("count > 1").count() == 0
