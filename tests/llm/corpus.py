"""Small documents with the odd cases: nulls, empty and long texts, repeated rows, columns with clashing names."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, shard int, length int, block int"


def texts(n: int = 60, seed: int = 3) -> list[str | None]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "an", "er", "é", "in", "Q", "7"]) for _ in range(rng.randint(1, 4)))
    out: list[str | None] = [" ".join(word() for _ in range(rng.randint(1, 120))) + rng.choice([".", "\n", ""]) for _ in range(n)]
    out += [None, "", None, "", " ", "one", "a b  c\n d\te <|endoftext|> f", "x" * 5000, " ".join(word() for _ in range(9000)), "ünïcödé straße 漢字 🙂 " * 40]
    out += [out[0]] * 25 + [out[3]] * 2
    return out


def rows(values: list[str | None]) -> list[tuple]:
    out = [(i, t, "en", "src0", len(t or ""), 1, 2, 3) for i, t in enumerate(values)]
    return [*out, out[0], (None, "no id", None, None, None, None, None, None)]


def frame(spark, values: list[str | None]):
    return spark.createDataFrame(rows(values), COLUMNS)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)
