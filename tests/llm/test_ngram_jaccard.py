import random
import re
from collections import Counter

import numpy as np
import pytest
from corpus import COLUMNS, empty, frame, rows, texts

from tidewatch.llm import ngram_jaccard as nj


def brute(values):
    """doc_id, set size, smallest doc_id of the component, by comparing all pairs."""
    sets = []
    for _, text, *_ in values:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lower)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(i)] = root(j)
    least: dict = {}
    for i, v in enumerate(values):
        if v[0] is not None:
            least[root(i)] = min(v[0], least.get(root(i), v[0]))
    return Counter((v[0], len(s), least.get(root(i))) for i, (v, s) in enumerate(zip(values, sets, strict=True)))


def near_copies(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    passage = [word() for _ in range(60)]
    out = []
    for g in range(12):
        base = [word() for _ in range(rng.choice([3, 5, 9, 40, 200]))]
        if g % 3 == 0:
            base = base[:20] + passage + base[20:]
        for _ in range(rng.choice([1, 3, 25])):
            copy = [*base]
            for _ in range(rng.randint(0, max(1, len(copy) // 25))):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    # a chain: each next to the following, the ends far apart
    base = [word() for _ in range(100)]
    for _ in range(12):
        base = [*base[8:], *(word() for _ in range(8))]
        out.append(rng.choice([" ", "\n"]).join(base).upper())
    # short own parts around one passage: shared by many, alike enough for some
    out += [" ".join(passage + [word() for _ in range(rng.randint(5, 30))]) for _ in range(60)]
    return out


@pytest.mark.parametrize("settings", [(8, 5), (0, 3), (10**9, 0)])
def test_classes_equal_brute_force(spark, settings, monkeypatch):
    monkeypatch.setattr(nj, "BATCH_BYTES", 8_000)
    monkeypatch.setattr(nj, "RANGE_TOKENS", 2_000)
    monkeypatch.setattr(nj.link_classes, "__defaults__", (nj.LIKE, *settings))
    values = near_copies() + texts(20)
    got = Counter(map(tuple, nj.near_duplicates(frame(spark, values)).collect()))
    assert got == brute(rows(values))


def test_long_lists_are_split_by_further_tokens(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    passages = [[word() for _ in range(40)] for _ in range(3)]
    # many short documents around parts of the same passages: long lists, few links
    values = [" ".join(rng.choice(passages)[: rng.randint(12, 40)] + [word() for _ in range(rng.randint(0, 4))] + rng.choice(passages)[rng.randint(10, 30) :]) for _ in range(150)]
    split = []
    plain = nj._split
    monkeypatch.setattr(nj, "_split", lambda posted, sets, like, k: split.append(k) or plain(posted, sets, like, k))
    monkeypatch.setattr(nj, "SHORT_PAIRS", 8)
    monkeypatch.setattr(nj.link_classes, "__defaults__", (nj.LIKE, 0, 0))
    got = Counter(map(tuple, nj.near_duplicates(frame(spark, values)).collect()))
    assert got == brute(rows(values)) and split


def test_repeated_rows_and_empty_sets_of_any_number(spark):
    values = [(i % 3, "one two three four five six") for i in range(300)] + [(None, None)] * 200 + [(9, "")] * 100 + [(9, "alone here")]
    got = Counter(map(tuple, nj.near_duplicates(spark.createDataFrame(values, "doc_id long, text string")).collect()))
    assert got == brute(values)


def test_one_of_each_class_stays(spark):
    values = near_copies(4)
    docs = frame(spark, values)
    kept = nj.keep_one_of_each(docs)
    assert kept.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    got = Counter(r["doc_id"] for r in kept.collect())
    want = Counter()
    for (doc_id, _, component), n in brute(rows(values)).items():
        if doc_id is None or doc_id == component:
            want[doc_id] += n
    assert got == want
    assert nj.near_duplicates(empty(spark)).collect() == []


def test_packing_of_tokens():
    rng = np.random.default_rng(0)
    for high, n in ((1 << 48, 5), (1 << 48, 300_000), (1 << 30, 50), (9, 1), (1 << 48, 1)):
        tokens = np.unique(rng.integers(0, high, n).astype(np.uint64))
        assert (nj.unpack(nj.pack(tokens)) == tokens).all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 140)] + [(120, 40)] + [(7, 7)]
    got = {r["row"]: r["root"] for r in nj.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys([*range(100, 140), 40], 40)}
    assert nj.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_long_words_of_few_letters_have_hashes_of_their_own():
    word = "a"
    for _ in range(10):  # a Thue-Morse word and its complement agree in any polynomial with an odd base
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    h = nj.Hasher()
    assert len(word) == 1024 and len({int(x) for x in h.words(f"{word} {other} {word.upper()}")}) == 2
    assert h.words(f"x {word}")[1] == h.words(word)[0]
