"""URL filter: host and path rules, and a character language-model ratio for the URLs that no rule fits.

Two character models, of accepted and of rejected URLs, are variable-order Markov models over the same contexts. A context
of up to ORDER characters is kept if it is one in SHARE or more of all positions in the URLs that the models are counted
over; so there are at most SHARE contexts of each length, whatever the input. A character is predicted from the longest
kept context before it, its share mixed by Witten-Bell weights with that of the next shorter context, down to a uniform share.
A URL's score is the difference of its log-likelihoods over its length; at the calibrated threshold or more it is allowed.

Kept contexts are closed under prefixes and suffixes, so they are the states of an automaton: from a state and a
character follow the next state and the log ratio. Scoring runs each URL through this one constant table, character by character.

The models are counted over all URLs that a rule decides, but for every fifth by CRC, on which the threshold is set: the one
that tells accepted from rejected URLs best on average. Counts of all runs of characters stay in Spark; only those of kept
contexts pass through the driver. All is DataFrame functions.

Nulls: a null url has an empty host and path, no rule, and score 0, as has the empty url. A null page_id is kept. Repeated
rows are judged alike. With no decided URLs on a side, that model is uniform; with none to calibrate on, the threshold is 0. Of
thresholds that are equally good, the lowest is taken. An empty table gives no rows. Other columns are ignored; of very long
URLs all characters count.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import ascii_lower, materialize

#: (host, path, verdict): a rule fits its host and the subdomains, where the path starts with its own.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: The start, letters, 0 for all digits, signs, and * for all else.
ALPHABET = "^abcdefghijklmnopqrstuvwxyz0./:-_?=&#%~+,;@!*"
_A = len(ALPHABET)
START = ALPHABET[0]
#: Characters of the longest context, and the share of all positions that a context needs: one in so many.
ORDER, SHARE = 4, 1024
MODULUS, HELD_OUT = 5, 0
#: Scores are counted at this step, between plus and minus LIMIT, to set the threshold.
STEP, LIMIT = 0.005, 10.0
#: Log ratios are kept as whole numbers of this unit.
UNIT = 1e-4
#: An entry of the automaton's table is next state * RATIOS + log ratio + RATIOS / 2; the running value of a URL is its
#: sum so far * STATES + state.
RATIOS, STATES = 1 << 20, 1 << 13


def host_of(url: Column) -> Column:
    """After the first :// up to a slash, question or hash sign, or the end; empty for null or without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(rest)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path).otherwise(name)
        verdict = F.when(fits, says).otherwise(verdict)
    return name, verdict


def plain(url: Column) -> Column:
    """A URL in the alphabet of the models."""
    return F.regexp_replace(F.regexp_replace(ascii_lower(url), "[0-9]", "0"), r"[^a-z0./:\-_?=&#%~+,;@!]", "*")


def runs(pages: DataFrame, order: int = ORDER) -> DataFrame:
    """verdict, run, n: how often each run of a character and up to `order` before it, the start included, occurs."""
    whole = F.concat(F.lit(START * order), plain(F.col("url")))
    found = pages.select("verdict", F.explode(F.regexp_extract_all(whole, F.lit(rf"(?s)(?=(.{{{order + 1}}}))"), F.lit(1))).alias("run"))
    counted = found.groupBy("verdict", "run").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("run", F.regexp_replace("run", rf"^\{START}+", START)).groupBy("verdict", "run").agg(F.sum("n").alias("n"))


def contexts(counted: DataFrame, order: int = ORDER, share: int = SHARE) -> list[tuple[str, str, str, int]]:
    """(context, character, verdict, count) for the contexts of up to `order` characters that are kept."""
    total = counted.agg(F.sum("n")).first()[0] or 0
    length = F.char_length("run")
    each = counted.select("verdict", "n", F.substring("run", length, F.lit(1)).alias("c"), F.explode(F.transform(F.sequence(F.lit(0), length - 1), lambda k: F.substring(F.col("run"), length - k, k))).alias("context"))
    each = each.groupBy("context", "c", "verdict").agg(F.sum("n").alias("n"))
    kept = each.groupBy("context").agg(F.sum("n").alias("_n")).where(F.col("_n") * share >= total).select("context")
    return [tuple(r) for r in each.join(kept, "context").select("context", "c", "verdict", "n").collect()]


def automaton(found: list[tuple[str, str, str, int]]) -> tuple[list[int], int]:
    """The table of the automaton, an entry for each state and character, and the state at the start of a URL."""
    counts: dict[tuple[str, str], dict[str, int]] = {}
    for context, c, verdict, n in found:
        counts.setdefault((verdict, context), {})[c] = n
    states = sorted({context for context, *_ in found} | {""}, key=lambda w: (len(w), w))
    number = {w: i for i, w in enumerate(states)}

    def longest(w: str) -> str:
        while w not in number:
            w = w[1:]
        return w

    logs: dict[str, list[list[float]]] = {}
    for verdict in ("allow", "block"):
        shares: list[list[float]] = []
        for w in states:  # the shorter contexts come first
            below = shares[number[longest(w[1:])]] if w else [1.0 / _A] * _A
            own = counts.get((verdict, w), {})
            total, kinds = sum(own.values()), len(own)
            shares.append([(own.get(c, 0) + kinds * p) / (total + kinds) for c, p in zip(ALPHABET, below, strict=True)] if total else below)
        logs[verdict] = [[math.log(p) for p in row] for row in shares]
    table = []
    for i, w in enumerate(states):
        for k, c in enumerate(ALPHABET):
            ratio = round((logs["allow"][i][k] - logs["block"][i][k]) / UNIT)
            table.append(number[longest(w + c)] * RATIOS + ratio + RATIOS // 2)
    return table, number[longest(START)]


def score(url: Column, table: list[int], start: int) -> Column:
    """The mean log ratio of a URL's characters."""
    entries = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")

    def step(value: Column, c: Column) -> Column:
        entry = F.element_at(entries, (value.bitwiseAND(STATES - 1) * _A + F.instr(F.lit(ALPHABET), c)).cast("int"))
        total = F.shiftright(value, 13) + entry.bitwiseAND(RATIOS - 1) - RATIOS // 2
        return total * STATES + F.shiftright(entry, 20)

    n = F.char_length(url)
    end = F.aggregate(F.split(plain(url), ""), F.lit(start).cast("bigint"), step)
    return F.when(n > 0, F.shiftright(end, 13) * UNIT / n).otherwise(0.0)


def calibrate(pages: DataFrame) -> float:
    """The threshold with the best mean of both classes' hit rates on held-out decided URLs."""
    step = F.round(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.col("score"))) / STEP).cast("int")
    found = pages.where("verdict is not null and held_out").groupBy(step.alias("step"), "verdict").agg(F.count(F.lit(1)).alias("n")).collect()
    good, bad = ({r["step"]: r["n"] for r in found if r["verdict"] == v} for v in ("allow", "block"))
    if not good or not bad:
        return 0.0
    best, at = -1.0, 0.0
    hit, passed, steps = sum(good.values()), 0, sorted({*good, *bad})
    for low, step in zip([steps[0] - 1, *steps], [*steps, steps[-1] + 1], strict=True):
        rate = hit / sum(good.values()) + passed / sum(bad.values())  # allowed from `step` on
        if rate > best + 1e-12:
            best, at = rate, (low + step) / 2 * STEP
        hit, passed = hit - good.get(step, 0), passed + bad.get(step, 0)
    return at


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, score and verdict of each row of pages."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rows = pages.select("page_id", url.alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "verdict": verdict, "held_out": F.crc32(F.col("url").cast("binary")) % MODULUS == HELD_OUT})
    counted = materialize(runs(rows.where("verdict is not null and not held_out")), "url-runs")
    scored = materialize(rows.withColumn("score", score(F.col("url"), *automaton(contexts(counted)))).drop("url"), "url-scores")
    threshold = calibrate(scored)
    return scored.select("page_id", "host", "path", "rule", "score", F.coalesce("verdict", F.when(F.col("score") >= threshold, "allow").otherwise("block")).alias("verdict"))
