import base64
import hashlib
import random
import re
from urllib.parse import urlparse

import numpy as np
import pyarrow.parquet as pq
import pytest
from corpus import COLUMNS, empty, frame, rows, texts
from pyspark.sql import functions as F

from tidewatch.llm import decontamination
from tidewatch.llm.decontamination import Block, Numbers, Queries, build_index, contamination_digest, drop_contaminated, find_contamination, matches, search_index
from tidewatch.llm.warc import read_archive, write_archive

PAGES = "page_id long, url string, html string, sha1 string, first long"


def test_archives_are_read_back_whole(spark):
    big = "<p>" + "ä" * 100_000
    pages = [(5, "http://a/\r\nX: y", big, "z", 9), (3, None, big, None, 1), (9, "u", big, None, 1), (1, "u", None, None, 1), (2, "u", "", None, 1), (4, "u", "one\r\n\r\n", None, 1), (4, "u", "one\r\n\r\n", None, 1), (4, "u", "other", None, 1), (None, "u", big, None, 1), (None, "u", "alone", None, 1)]
    out = read_archive(write_archive(spark.createDataFrame(pages, PAGES), chunk_bytes=1000)).collect()
    assert len(out) == len(pages) and all(r["intact"] for r in out)
    first: dict = {}
    for page_id, _, html, *_ in pages:
        if page_id is not None:
            first[html or ""] = min(page_id, first.get(html or "", page_id))
    want = []
    for page_id, _, html, *_ in pages:
        data, lead = (html or "").encode(), first.get(html or "")
        revisit = page_id is not None and lead != page_id
        want.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", lead if revisit else None))
    key = lambda x: tuple(map(str, x))
    assert sorted(((r[0], r[1], r[2], r[3], r[4]) for r in out), key=key) == sorted(want, key=key)
    out = read_archive(write_archive(spark.createDataFrame(pages, PAGES), min_bytes=100)).collect()
    assert {r["page_id"] for r in out if r["record_type"] == "revisit"} == {5, 9}


def test_payloads_of_several_flushes_are_read_back_whole(spark):
    html = "".join(chr(97 + i * i % 26) for i in range(1037))
    pages = spark.createDataFrame([(1, "u", html, None, 1), (2, "u", "small", None, 1)], PAGES)
    archive = write_archive(pages, chunk_bytes=10, flush_bytes=100)
    numbers = [r["chunk_no"] for r in archive.where("record_id like '1/%'").collect()]
    assert sorted(numbers) == list(range(-1, 105))
    joined = b"".join(r["data"] for r in archive.where("record_id like '1/%' and chunk_no > 0").orderBy("chunk_no").collect())
    assert joined == html.encode()
    out = {r["page_id"]: r for r in read_archive(archive).collect()}
    assert len(out) == 2 and all(r["intact"] for r in out.values()) and out[1]["payload_bytes"] == len(html)
    # the set flush size, crossed by one payload
    page = spark.range(1).selectExpr("id as page_id", "'u' as url", "repeat('0123456789abcdefg', 1048576) as html")
    assert [(r["payload_bytes"], r["intact"]) for r in read_archive(write_archive(page)).collect()] == [(17 << 20, True)]


def test_damage_is_found(spark):
    archive = write_archive(spark.createDataFrame([(1, "u", "x" * 50, None, 1), (2, "u", "y" * 50, None, 1)], PAGES), chunk_bytes=20)
    bad = archive.withColumn("data", F.when(F.col("record_id").startswith("2/") & (F.col("chunk_no") == 2), F.lit(b"z" * 20)).otherwise(F.col("data")))
    assert {r["page_id"]: r["intact"] for r in read_archive(bad).collect()} == {1: True, 2: False}
    gone = archive.where("not (record_id like '1/%' and chunk_no = 3)")
    assert {r["page_id"]: r["intact"] for r in read_archive(gone).collect()} == {1: False, 2: True}
    assert read_archive(write_archive(spark.createDataFrame([], PAGES))).collect() == []


def brute(values, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for doc_id, text, *_ in values:
        w, hit, of = words(text), set(), set()
        for item_id, item in items:
            if item_id is None:
                continue
            v = words(item)
            for i in range(max(1, len(v) - window + 1) if v else 0):
                part = v[i : i + window]
                for j in range(len(w) - len(part) + 1):
                    if w[j : j + len(part)] == part:
                        hit |= set(range(j, j + len(part)))
                        of.add(item_id)
        out.append((doc_id, len(w), len(hit), len(of), hashlib.sha256(",".join(sorted(map(str, of))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_contamination_equals_brute_force(spark):
    values = texts()
    parts = values[1].split() + values[2].split()
    values += [" ".join(values[5].split()[:4] + parts[3:16] + ["END"]), " ".join(parts).upper(), "ONE! two"]
    items = [(1, " ".join(parts)), (2, values[5]), (10, "one two"), (9, ""), (8, None), (None, values[7]), (3, values[-3]), (2, values[5]), (7, "a a a a a a a a a a a"), (6, "end")]
    values.append("a " * 40)
    docs, bench = frame(spark, values), spark.createDataFrame(items, "item_id long, text string")
    want = brute(rows(values), items)
    for settings in ({}, {"block_bytes": 500, "block_words": 20}):
        got = contamination_digest(find_contamination(docs, bench, **settings)).collect()
        assert sorted(map(tuple, got), key=str) == want
    kept = drop_contaminated(docs, bench)
    assert kept.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    hit = {x[0] for x in want if x[5]}
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((x[0] for x in want if x[0] not in hit), key=str)
    none = bench.where("1 = 0")
    assert not any(r["contaminated"] for r in contamination_digest(find_contamination(docs, none)).collect())
    assert find_contamination(empty(spark), bench).collect() == []


def brute_near(w, v, slop):
    """The words that a proximity match of v covers, over all starts."""
    hit = set()
    for start in range(-len(v) - slop, len(w) + slop + 1):
        at = []
        for j, term in enumerate(v):
            near = [p for p in range(max(0, start + j - slop), min(len(w), start + j + slop + 1)) if w[p] == term]
            if not near:
                break
            at.append(min(near, key=lambda p: (abs(p - start - j), p)))  # noqa: B023
        else:
            hit |= set(range(min(at), max(at) + 1))
    return hit


@pytest.mark.parametrize("slop", [1, 2, 5])
def test_proximity_equals_brute_force(slop):
    rng = random.Random(slop)
    for trial in range(60):
        docs = [[rng.choice("abcdef") for _ in range(rng.randint(0, 14))] for _ in range(6)]
        items = [[rng.choice("abcdefg") for _ in range(rng.randint(1, 5))] for _ in range(4)]
        number = Numbers()
        ids = np.array([number[w.encode()] for d in docs for w in d], np.int32)
        place = np.argsort(ids, kind="stable").astype(np.int32)
        block = Block(np.array([len(d) for d in docs]), list(number), np.bincount(ids, minlength=len(number)), place)
        for s in (0, slop):
            got = [set() for _ in docs]
            queries = Queries([(i, " ".join(v)) for i, v in enumerate(items)], 5)
            for _, found, first, end in matches(block, queries, s):
                for d, a, b in zip(found, first, end, strict=True):
                    got[d] |= set(range(a, b))
            assert got == [set().union(*(brute_near(d, v, s) for v in items)) for d in docs], (trial, s)


def test_proximity_stays_in_its_document(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    docs = frame(spark, ["x y z w", "beta alpha gamma delta", "alpha x x x x x x beta gamma delta", "delta gamma beta alpha", "alpha beta", "gamma delta"])
    near = {r["doc_id"]: (r["items"], r["spans"]) for r in find_contamination(docs, bench, window=4, slop=2).collect()}
    assert near[1] == ([1], [[0, 4]]) and not any(near[i][0] for i in (0, 2, 3, 4, 5))
    assert {r["doc_id"]: r["items"] for r in find_contamination(docs, bench, window=4, slop=3).collect()}[3] == [1]
    index = build_index(docs)
    other = spark.createDataFrame([(7, "x y z w")], "item_id long, text string")
    assert {r["doc_id"] for r in search_index(index, other, window=4).where("size(items) > 0").collect()} == {0}


def test_positions_of_very_many_short_texts_stay_in_range(spark):
    docs = spark.range(530_000).coalesce(1).selectExpr("id as doc_id", "if(id % 100000 = 99999, 'Alpha beta', if(id % 2 = 0, '', null)) as text")
    bench = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    found = find_contamination(docs, bench)
    assert found.count() == 530_000
    assert [r["doc_id"] for r in found.where("size(spans) > 0").orderBy("doc_id").collect()] == [k * 100_000 + 99_999 for k in range(5)]


def test_no_row_group_of_the_index_holds_several_blocks(spark):
    values = ["alpha beta gamma", "delta " * 50] * 20
    index = build_index(spark.createDataFrame(list(enumerate(values)), "doc_id long, text string").coalesce(1), block_bytes=400)
    groups = [m.row_group(i).num_rows for m in (pq.read_metadata(urlparse(f).path) for f in index.inputFiles()) for i in range(m.num_row_groups)]
    assert len(groups) == index.count() >= 20 and set(groups) == {1}


def test_texts_reach_the_index_in_small_batches(spark, monkeypatch):
    conf, plain, seen = "spark.sql.execution.arrow.maxBytesPerBatch", decontamination.materialize, []
    before = spark.conf.get(conf)
    monkeypatch.setattr(decontamination, "materialize", lambda df, *name, **options: seen.append(spark.conf.get(conf)) or plain(df, *name, **options))
    docs = spark.range(300).selectExpr("id as doc_id", "concat(repeat('alpha ', 10000), id) as text")
    assert build_index(docs.coalesce(1)).selectExpr("sum(size(doc_ids))", "sum(aggregate(lengths, 0, (a, b) -> a + b))").first()[:] == (300, 300 * 10001)
    assert seen == [str(decontamination.BLOCK_BYTES)] and spark.conf.get(conf) == before
