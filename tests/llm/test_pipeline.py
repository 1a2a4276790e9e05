"""The pipeline against its stages done in plain Python on a small table."""

from collections import defaultdict

import public_tokenizers
from test_classifiers import corpus
from test_ngram_jaccard import brute as brute_classes
from test_warc_decontamination import brute as brute_hits
from tokenizers import Tokenizer

import corpus_pipeline
from tidewatch.llm import labelled, quality, toxicity

NAMES = ["toxicity", "quality classifier", "n-gram Jaccard join", "benchmark decontamination", "packing"]


def test_rows_equal_plain_stages(spark, tmp_path):
    rows = corpus(400, 11)
    texts = [r[0] for r in rows]
    texts += [texts[0], texts[1] + " more", None, "", texts[2].upper()]
    clean = next(t for t, (_, toxic, good) in zip(texts, rows, strict=False) if not toxic and good and len(t.split()) > 60)
    texts.append(clean[: len(clean) // 3] + " " + " ".join(f"passage{i}" for i in range(12)) + " end")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, r[2], r[1]) for i, r in enumerate(rows)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    bench = [(1, " ".join(f"Passage{i}" for i in range(12))), (2, "never met words in this order at all")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = list(enumerate(texts))
    for module, column, good in ((toxicity, 2, False), (quality, 1, True)):
        frame = spark.createDataFrame(kept, "doc_id long, text string")
        given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        sample = labelled.sample(frame, given, "toxic" if column == 2 else "quality", module.MODULUS, module.HELD_OUT)
        model = module.fit(*sample)
        if module is toxicity:
            scorer = toxicity.Scorer(model)
            score = scorer.score
        else:
            features = quality.Features()
            score = lambda t: labelled.sigmoid(model.scale * (model.margin(features.of(t)) - model.threshold) + labelled.AT_CUT)  # noqa: E731, B023
        kept = [(i, t) for i, t in kept if (score(t) >= labelled.CUT) == good]
    assert 200 < len(kept) < len(texts)
    kept = [(i, t) for i, t in kept if any(x[0] == i == x[2] for x in brute_classes(kept))]
    hit = {x[0] for x in brute_hits(kept, bench) if x[5]}
    assert len(texts) - 1 in hit
    kept = [(i, t) for i, t in kept if i not in hit]

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for i, x in kept}
    got = defaultdict(int)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r["doc_id"]] += r["length"]
        assert r["doc_tokens"] == want[r["doc_id"]] and r["offset"] + r["length"] <= 2048
    assert dict(got) == want


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES and corpus_pipeline.ORACLE_SQL is None


def test_rows_are_dropped_by_row_whatever_their_doc_ids(spark, tmp_path):
    words = lambda k, n=40: " ".join(f"w{k}x{i}" for i in range(n))
    passage = " ".join(f"passage{i}" for i in range(12))
    rows = [(None, words(1)), (None, words(1)), (None, words(2)), (3, words(2)), (4, words(3)), (4, words(3)), (9, words(3)), (5, words(4)), (5, words(5)), (1, words(4) + " end"), (None, None), (None, None)]
    columns = "doc_id long, text string, _row_key string"
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], columns)
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    want = [(None, words(1)), (3, words(2)), (4, words(3)), (1, words(4) + " end"), (5, words(5)), (None, None), (None, None)]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(want, key=str)

    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, words(1) + " " + passage), (None, words(2)), (7, passage + " " + words(3)), (7, words(4)), (8, words(5)), (8, words(5)), (None, None)]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], columns)
    kept = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted((x for x in rows if "passage" not in (x[1] or "")), key=str)


def test_odd_tables_pass_through_all_stages(spark, tmp_path):
    rows = corpus(200, 5)
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row_key int, _toxicity string, component_id int"
    labels = [(i, r[2], r[1]) for i, r in enumerate(rows)]

    def run(values, name):
        folder = tmp_path / name
        spark.createDataFrame([(i, t, None, None, None, 1, "x", 2) for i, t in values], schema).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        spark.createDataFrame([(1, "never met words"), (None, "x"), (2, None)], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
        return corpus_pipeline.run(spark, str(folder)).collect()

    assert run([], "none") == []
    good = next(r[0] for r in rows if not r[1] and r[2] and len(r[0].split()) > 30)
    got = run([(None, good), (None, good), (7, good), (7, good), (None, None), (8, None)], "odd")
    # one of the copies stays, the one with a doc_id; empty texts are no copies of each other
    assert [r["doc_id"] for r in got if r["doc_tokens"] > 1] in ([7], [])
    toxic = [(i, r[0]) for i, r in enumerate(rows) if r[1]]
    assert len(run(toxic, "toxic")) < len(toxic) / 4
