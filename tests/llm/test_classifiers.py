import math
import random
import re
import zlib

import numpy as np
import pytest
from corpus import COLUMNS, empty
from pyspark.sql import functions as F

from tidewatch.llm import labelled, quality, toxicity

STEMS = ["vequ", "grolb", "snarfa"]


def corpus(n, seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "an", "er", "in", "on", "re"]) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 150))]
        toxic, good = rng.random() < 0.2, rng.random() < 0.8
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(STEMS) + word()
        if not good:
            words = [w + rng.choice(["###", "$$$"]) for w in words] if rng.random() < 0.5 else [w.upper() + "!!" for w in words]
        rows.append((" ".join(words), int(toxic), int(good)))
    return rows


@pytest.mark.parametrize(("module", "column"), [(toxicity, 1), (quality, 2)])
def test_held_out_accuracy(module, column):
    rows = corpus(1500)
    train, test = rows[:1100], rows[1100:]
    model = module.fit([r[0] for r in train], np.array([r[column] for r in train]))
    if module is toxicity:
        scorer = toxicity.Scorer(model)
        scores = np.array([scorer.score(r[0]) for r in test])
        assert abs(scorer.score(None) - scorer.score("")) == 0 and 0 <= scorer.score("") <= 1
    else:
        f = quality.Features()
        scores = labelled.sigmoid(model.scale * (np.array([model.margin(f.of(r[0])) for r in test]) - model.threshold) + labelled.AT_CUT)
    truth = np.array([r[column] for r in test])
    hit = (scores >= labelled.CUT) == truth
    assert hit[truth == 1].mean() > 0.95 and hit[truth == 0].mean() > 0.95


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(2)
    docs = [np.flatnonzero(rng.random(12) < 0.5) for _ in range(60)]
    y = np.array([int(3 in x) for x in docs])
    y[:4] ^= 1
    ratio = np.ones(12)
    w, b = quality.dual_coordinate_descent(docs, y, ratio, c=1.0, passes=500)
    sign = np.where(y == 1, 1.0, -1.0)
    cost = len(y) * np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    x = np.zeros((60, 13))
    for i, d in enumerate(docs):
        x[i, d] = 1 / np.sqrt(max(1, len(d)))
        x[i, 12] = 1
    primal = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - sign * (x @ v))).sum()
    best = primal(np.append(w, b))
    for _ in range(300):
        assert primal(np.append(w, b) + rng.normal(0, 0.05, 13)) >= best - 1e-2


def test_pools_equal_a_plain_convolution():
    net = toxicity.Net(4)
    for n in (0, 1, 2, 3, 9):
        words = [f"w{i}".encode() for i in range(n)]
        e = np.array([net.embedding[toxicity.rows_of(w)].sum(0) for w in words]).reshape(n, toxicity.DIMENSION)
        top, _ = net.pool(e @ net.columns())
        want = []
        for w, by_place in zip(toxicity.WIDTHS, net.filters, strict=True):
            padded = np.concatenate([e, np.zeros((max(0, w - n), toxicity.DIMENSION))])
            want.append(np.max([sum(padded[i + j] @ by_place[j] for j in range(w)) for i in range(max(1, n - w + 1))], axis=0))
        assert np.allclose(top, np.concatenate(want), atol=1e-4)


def plain_toxicity(net, text):
    """The score of a text from the net's numbers, by the definition: words, embeddings, filters, maxima, layer, threshold."""
    words = re.findall(rb"[0-9a-z\x80-\xff]+", "".join(c.lower() if c.isascii() else c for c in text or "").encode())
    vectors = []
    for w in words:
        hashed = [zlib.crc32(w, 1)] + [zlib.crc32(w[:k], k) for k in (3, 4, 5, 6, 7) if len(w) >= k]
        vectors.append(sum(net.embedding[h % (2**16 - 1) + 1].astype(float) for h in hashed))
    tops = []
    for width, filters in zip((1, 2, 3), net.filters, strict=True):
        places = []
        for i in range(max(1, len(words) - width + 1)):
            places.append(sum((vectors[i + j] @ filters[j].astype(float) for j in range(width) if i + j < len(words)), np.zeros(10)))
        tops += list(np.max(places, axis=0))
    margin = sum(max(0.0, t + b) * o for t, b, o in zip(tops, net.bias, net.out, strict=True)) + net.out_bias
    counts = {k: sum(w.decode(errors="ignore") in v.split() and len(w) < 6 and not any(w.decode(errors="ignore") in labelled.COMMON_WORDS[o].split() for o in labelled.COMMON_WORDS if o < k) for w in words) for k, v in labelled.COMMON_WORDS.items()}
    language = max(sorted(counts), key=lambda k: counts[k])
    threshold = net.thresholds[sorted(counts).index(language) if counts[language] else len(counts)]
    return 1 / (1 + math.exp(-max(-40, min(40, net.scale * (margin - threshold) + math.log(0.3 / 0.7)))))


def plain_shape(word, before):
    """A word's shape, letters by case, digits and other signs; runs are one."""
    if word == before:
        return 7919
    kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c in "0123456789" else c for c in word)
    return zlib.crc32(re.sub(r"(.)\1+", r"\1", kinds).encode())


def plain_quality(model, text):
    """The score of an ASCII text from the model's numbers: the sum over its different n-grams, over their norm."""
    words, grams = text.split(), set()
    shapes = [plain_shape(w, before) for w, before in zip(words, [None, *words], strict=False)]
    two64 = 1 << 64
    for i, w in enumerate(words):
        grams.add(zlib.crc32(w.encode()) % 2**18)
        one = shapes[i] * 0x9E3779B97F4A7C15 % two64
        grams.add((one >> 46) + 2**18)
        if i + 1 < len(words):
            two = (one ^ (shapes[i + 1] + 1)) * 0xBF58476D1CE4E5B9 % two64
            grams.add((two >> 46) + 2 * 2**18)
            if i + 2 < len(words):
                grams.add(((two ^ (shapes[i + 2] + 3)) * 0x94D049BB133111EB % two64 >> 46) + 3 * 2**18)
    weight = sum(float(model.weights[g]) for g in grams or {0})
    norm = math.sqrt(sum(float(model.ratio[g]) ** 2 for g in grams or {0}))
    margin = weight / (norm or 1.0) + model.bias
    return 1 / (1 + math.exp(-max(-40, min(40, model.scale * (margin - model.threshold) + math.log(0.3 / 0.7)))))


def test_whole_scores_equal_plain_ones(spark):
    rows = corpus(500, 21)
    values = [r[0] for r in rows[:120]] + ["", "one", "the of AND the", "der die das und 7 ü", "Same same Same same", "a  b\tc\nD1 $$ $$"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(values)], "doc_id long, text string")
    net = toxicity.fit([r[0] for r in rows], np.array([r[1] for r in rows]))
    got = {r["doc_id"]: r["score"] for r in toxicity.with_score(docs, net).collect()}
    assert all(abs(got[i] - plain_toxicity(net, t)) < 1e-4 for i, t in enumerate(values))
    model = quality.fit([r[0] for r in rows], np.array([r[2] for r in rows]))
    got = {r["doc_id"]: r["score"] for r in quality.with_score(docs, model).collect()}
    assert all(abs(got[i] - plain_quality(model, t)) < 1e-4 for i, t in enumerate(values) if t.isascii())


def test_a_model_is_fitted_in_one_task_and_columns_do_not_clash(spark):
    rows = corpus(300, 9)
    docs = spark.createDataFrame([(i, r[0], 1.0, 2.0, "t") for i, r in enumerate(rows)], "doc_id long, text string, _toxicity double, _quality double, _text string")
    labels = spark.createDataFrame([(i, r[2], r[1]) for i, r in enumerate(rows)], "doc_id long, quality int, toxic int")
    net = toxicity.train_on(docs, labels)
    again = toxicity.fit(*labelled.sample(docs, labels, "toxic", toxicity.MODULUS, toxicity.HELD_OUT))
    assert (net.embedding == again.embedding).all() and (net.thresholds == again.thresholds).all()
    for kept in (toxicity.drop_toxic(docs, labels), quality.drop_low_quality(docs, labels)):
        assert kept.columns == docs.columns
        found = kept.collect()
        assert 0 < len(found) < len(rows) and {(r["_toxicity"], r["_quality"], r["_text"]) for r in found} == {(1.0, 2.0, "t")}


@pytest.mark.parametrize(("module", "score", "drop", "label", "column", "modulus", "out"), [(toxicity, toxicity.score_toxicity, toxicity.drop_toxic, "toxic", 1, 4, 2), (quality, quality.score_quality, quality.drop_low_quality, "quality", 2, 5, 0)])
def test_scores_of_a_table(spark, module, score, drop, label, column, modulus, out):
    rows = corpus(600, 7)
    odd = [(9001, None), (9002, ""), (None, "no id"), (0, rows[0][0]), (9003, "x" * 100_000), (9004, "word " * 20_000)]
    docs = spark.createDataFrame([(i, r[0], "en", "s", 1, 1, 1, 1) for i, r in enumerate(rows)] + [(i, t, None, None, None, None, None, None) for i, t in odd], COLUMNS)
    labels = spark.createDataFrame([(i, r[2], r[1], "x") for i, r in enumerate(rows) if i % 3] + [(1, None, None, "x"), (None, 1, 1, "x"), (77777, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    got = score(docs, labels).collect()
    assert len(got) == len(rows) + len(odd)
    by_id = {r["doc_id"]: r for r in got}
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % modulus == out)
    assert by_id[9001]["score"] == by_id[9002]["score"]
    right = [by_id[i]["predicted"] == r[column] for i, r in enumerate(rows) if by_id[i]["held_out"]]
    assert sum(right) > 0.9 * len(right)
    kept = drop(docs, labels)
    assert kept.columns == docs.columns
    want = sorted((r["doc_id"] for r in got if r["predicted"] == (0 if module is toxicity else 1)), key=str)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == want
    constant = 0.0 if module is toxicity else 1.0
    assert {r["score"] for r in score(docs, labels.where("1 = 0")).collect()} == {constant}
    assert {r["score"] for r in score(docs, labels.where(f"{label} = 1")).collect()} == {1.0}
    assert score(empty(spark), labels).collect() == []


def test_the_sample_is_bounded_and_holds_whole_texts(spark):
    docs = spark.createDataFrame([(i, "ab " * 100) for i in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(500)], "doc_id long, quality int, toxic int")
    texts, y = labelled.sample(docs, labels, "toxic", 4, 2, max_rows=100)
    assert 60 < len(texts) < 150 and set(texts) == {"ab " * 100} and set(y) == {0, 1}
    texts, _ = labelled.sample(docs, labels, "toxic", 4, 2, max_bytes=3000)
    assert 0 < len(texts) <= 10


def test_a_giant_text_costs_the_sample_only_itself(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    small = [(i, f"text {i:02d} " * 10) for i in range(60)]
    docs = spark.createDataFrame([*small, *((i, "x" * 50_000) for i in range(60))], "doc_id long, text string")
    texts, y = labelled.sample(docs, labels, "toxic", 4, 2, max_bytes=6_000)
    want = spark.createDataFrame(small, "doc_id long, text string").where(labelled.fold(4) != 2)
    assert sorted(texts) == sorted(r["text"] for r in want.collect()) and len(set(y.tolist())) == 2


def test_repeated_rows_and_many_texts_of_one_document_are_bounded(spark):
    many = spark.range(300_000)
    labels = spark.createDataFrame([(1, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    same = many.select(F.lit(1).cast("long").alias("doc_id"), F.lit("").alias("text"))
    own = many.limit(40_000).select(F.lit(3).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    found = labelled.sample_rows(same.union(own), labels, "toxic", 1000, 999, max_rows=500).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in found} in ({1: 1, 3: 499}, {3: 500})
    assert labelled.sample_rows(same, labels, "toxic", 1000, 999).count() == 1
