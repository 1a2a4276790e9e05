import hashlib
import itertools
import math
import random
import re
from collections import defaultdict

import xxhash
from corpus import empty, frame, texts
from pyspark.sql import functions as F

from tidewatch.llm import url_filter
from tidewatch.llm.chat import COSTS, LEGAL, ROLES, Repair, moves, render, repair_conversations
from tidewatch.llm.fingerprint import PIECE, WORD_WEIGHT, WORDS, differing_leaves, differing_sections, fingerprint_edits, leaf_codes, leaves_of, likeness, with_fingerprint, with_next

CHAT = "conv_id long, turn long, role string, text string, n long, run int, position int"


def cheapest(roles):
    """By trying all sequences of moves."""
    best = math.inf

    def go(i, state, cost):
        nonlocal best
        if i == len(roles):
            best = min(best, cost)
            return
        for move in moves(state, roles[i] if roles[i] in ROLES else None):
            go(i + 1, move[2], cost + move[0])

    go(0, "start", 0)
    return best


def test_repairs_are_the_cheapest():
    dp = Repair()
    for n in range(5):
        for roles in itertools.product([*ROLES, None], repeat=n):
            assert sum(m[0] for m in dp.repair({"start": 0.0}, list(roles))[1]) == cheapest(roles)


def legal(rendered):
    roles, state = re.findall(r"<\|im_start\|>(\w+)\n", rendered), "start"
    for r in roles:
        assert r in LEGAL[state], roles
        state = r
    return roles


def test_conversations_of_any_length_are_repaired_and_rendered(spark):
    rng = random.Random(5)
    rows = []
    for conv in [*range(40), None]:
        for turn in range(rng.randint(1, 7)):
            rows.append((conv, turn, rng.choice([*ROLES, "tool", None]), rng.choice([None, "", "hi", "x" * 300]), 1, 2, 3))
    rows += [(99, t, rng.choice(ROLES), f"t{t}", 1, 2, 3) for t in range(1500)]  # many runs
    rows += [(98, t, rng.choice([*ROLES, "tool"]), "", 1, 2, 3) for t in range(700)]
    rows += [(50, 2**62, "user", "far", 1, 2, 3), (50, -(2**63), "tool", "near", 1, 2, 3), (50, 2**63 - 1, None, "last", 1, 2, 3)]
    rows += [rows[0], (7, None, "user", "first", 1, 2, 3)]
    rng.shuffle(rows)
    out = repair_conversations(spark.createDataFrame(rows, CHAT))
    turns = defaultdict(list)
    for r in out.collect():
        turns[r["conv_id"]].append(r)
    assert sum(map(len, turns.values())) == len(rows)
    whole = {r["conv_id"]: r for r in render(out).collect()}
    for conv, got in turns.items():
        got.sort(key=lambda r: r["position"])
        assert [r["position"] for r in got] == list(range(len(got)))
        assert [r["turn"] for r in got] == sorted((r["turn"] for r in got), key=lambda t: -1 if t is None else t)
        roles = [r["role"] if r["role"] in ROLES else None for r in got]
        # the very moves of the whole conversation at once, however many runs it has
        moved = Repair().repair({"start": 0.0}, roles)[1]
        assert [(m[1], m[2], m[3]) for m in moved] == [(r["action"], r["new_role"], r["inserted_role"]) for r in got]
        assert whole[conv]["cost"] == sum(m[0] for m in moved)
        legal(whole[conv]["rendered"])
        assert whole[conv]["rendered"].count("<|im_end|>\n") == whole[conv]["rendered"].count("<|im_start|>")
    assert any(r["action"] == "keep" and r["cost"] == COSTS["keep"] for r in turns[99])
    assert repair_conversations(spark.createDataFrame([], CHAT)).collect() == []


def brute_log_shares(urls, verdicts):
    """For accepted and rejected URLs the log share of each character after a context, by the definition."""
    positions = [(v, url_filter.START + u[:i], u[i]) for u, v in zip(urls, verdicts, strict=True) for i in range(len(u))]
    after = defaultdict(lambda: defaultdict(int))
    total = defaultdict(int)
    for v, before, c in positions:
        for k in range(min(url_filter.ORDER, len(before)) + 1):
            after[v, before[len(before) - k :]][c] += 1
            total[before[len(before) - k :]] += 1
    kept = {w for w, n in total.items() if n * url_filter.SHARE >= len(positions)}

    def share(v, w, c):
        below = share(v, w[1:], c) if w else 1 / len(url_filter.ALPHABET)
        seen = after[v, w]
        n, kinds = sum(seen.values()), len(seen)
        return (seen.get(c, 0) + kinds * below) / (n + kinds) if n else below

    def log_ratio(url):
        out = 0.0
        for i, c in enumerate(url):
            w = next(w for k in range(min(url_filter.ORDER, i + 1), -1, -1) if (w := (url_filter.START + url[:i])[i + 1 - k :]) in kept or not w)
            out += math.log(share("allow", w, c)) - math.log(share("block", w, c))
        return out

    return log_ratio, kept


def test_urls_are_judged_by_rules_then_by_the_models(spark):
    urls = ["http://a.com/x", "https://m.example.com/en/1?q", "http://www.example.com/en/2#f", "http://WWW.EXAMPLE.COM/en/2", "http://x.net/es/1", "http://x.net/fr/", "ftp://x.net/de/3", "http://x.net", "no scheme", "", None, "http://", "http://É.org/ü?x://y", "http://a.com", "http://example.com/EN/", "http://xexample.com/en/9", "http://a.b://c/d", "x\ny://h\nost/p\nq"]
    urls += [f"http://good{i}.com/page{i}" for i in range(60)] + [f"http://bad{i}.example.com/en/casino{i}" for i in range(60)] + ["http://good.org/page", "http://bad.org/casino"]
    rows = [(i, u, "html", "host", 0.5) for i, u in enumerate(urls)]
    pages = spark.createDataFrame([*rows, rows[0], (None, "http://a.com/x", None, None, None)], "page_id long, url string, html string, host string, score double")
    out = {r["page_id"]: r for r in url_filter.filter_urls(pages).collect()}
    assert len(out) == len(urls) + 1
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host = "".join(c.lower() if c.isascii() else c for c in m[1]) if m else ""
        path = m[2] if m else ""
        best = max((r for r in url_filter.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])), key=lambda r: len(r[0] + r[1]), default=None)
        assert (out[i]["host"], out[i]["path"]) == (host, path), u
        assert out[i]["rule"] == (best and best[0] + best[1]), u
        if best:
            assert out[i]["verdict"] == best[2]
    assert out[len(urls) - 2]["verdict"] == "allow" and out[len(urls) - 1]["verdict"] == "block"
    assert out[9]["score"] == out[10]["score"] == 0.0
    # scores against the models' definition
    import zlib

    plain = lambda u: re.sub(r"[^a-z0./:\-_?=&#%~+,;@!]", "*", re.sub("[0-9]", "0", "".join(c.lower() if c.isascii() else c for c in u)))
    decided = [(plain(u), out[i]["verdict"]) for u, i in [*((u, i) for i, u in enumerate(urls)), (urls[0], 0), ("http://a.com/x", 0)] if out[i]["rule"] and zlib.crc32((u or "").encode()) % 5]
    log_ratio, kept = brute_log_shares(*zip(*decided, strict=True))
    assert {len(w) for w in kept} == set(range(url_filter.ORDER + 1))
    for i in (6, 12, 17, len(urls) - 2, len(urls) - 1):
        p = plain(urls[i])
        assert abs(out[i]["score"] - log_ratio(p) / len(p)) < 1e-3, (urls[i], out[i]["score"], log_ratio(p) / len(p))
    none = url_filter.filter_urls(pages.where("1 = 0"))
    assert none.collect() == []
    assert {r["verdict"] for r in url_filter.filter_urls(pages.where("page_id in (8, 9, 10)")).collect()} == {"allow"}


def plain_leaves(text):
    """The leaves by their definition, character by character."""
    out, rest = [], text
    while rest:
        stop = next((i for i, c in enumerate(rest) if c in "\n.!?"), len(rest))
        if 0 < stop <= PIECE:  # a sentence that is short enough, with its stops and line ends
            end = stop
            while end < len(rest) and rest[end] in ".!?":
                end += 1
            while end < len(rest) and rest[end] == "\n":
                end += 1
        elif stop:
            end = PIECE
            for i in range(1, PIECE):
                if rest[i] in "、。，！？；：" or (rest[i] in " \t" and (rest[i - 1] in "dgnrty" or ord(rest[i - 1]) > 127)):
                    end = i + 1
                    break
        else:
            end = 0
            while end < len(rest) and rest[end] in ".!?":
                end += 1
            while end < len(rest) and rest[end] == "\n":
                end += 1
        out.append(rest[:end])
        rest = rest[end:]
    return out


def plain_fingerprint(text):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    leaves, paragraphs = [], [[]]
    for leaf in plain_leaves(text):
        leaves.append(sha(leaf))
        paragraphs[-1].append(leaves[-1])
        if leaf.endswith("\n"):
            paragraphs.append([])
    sections, held = [], ""
    # a paragraph's node hashes its leaves, a comma behind each but the last of a line that ends
    for i, p in enumerate(x for x in paragraphs if x):
        node = sha(",".join(p) + ("" if i < len(paragraphs) - 1 else ","))
        held += node
        if node[0] in "048c":
            sections.append(sha(held))
            held = ""
        else:
            held += ","
    if held:
        sections.append(sha(held))
    return sha(",".join(sections)), {x[:8] for x in leaves}


def plain_words(text):
    words = {w for w in re.findall(r"[!-~]+|[^\x00-\x7F]", text)}
    return set(sorted({xxhash.xxh64_intdigest(w.encode(), seed=42) >> 32 for w in words})[:WORDS])


def plain_likeness(a, b):
    (root_a, x), (root_b, y) = plain_fingerprint(a), plain_fingerprint(b)
    if root_a == root_b:
        return 1.0
    v, w = plain_words(a), plain_words(b)
    among = set(sorted(v | w)[:WORDS])
    share = len(among & v & w) / len(among) if among else 0.0
    return (len(x & y) + WORD_WEIGHT * share) / (len(x | y) + WORD_WEIGHT)


def test_fingerprints_of_edits(spark):
    values = [*texts(), "One. Two!\nThree?? four,\n\nfive", "漢字、かな。" * 30, "x y " * 300]
    rows = [(i * 7, t) for i, t in enumerate(values)]
    rows[-1] = (2**62, rows[-1][1])
    rows = [(None, "first of all. It has no id."), (-(2**63), "least. One."), *rows]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, fingerprint string, edited string")
    got = {r["doc_id"]: r for r in fingerprint_edits(docs).collect()}
    assert len(got) == len(rows)
    prints = defaultdict(set)
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[i]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (t == edited)
        assert r["fingerprint"].split(":")[0] == plain_fingerprint(t)[0]
        assert abs(r["near_edited"] - plain_likeness(t, edited)) < 1e-9
        assert abs(r["near_next"] - plain_likeness(t, after)) < 1e-9
        leaves = list(itertools.zip_longest(plain_leaves(t), plain_leaves(edited)))
        assert r["edit_leaf"] == next((i for i, (x, y) in enumerate(leaves) if x != y), None)
        assert (r["edit_section"] is None) == (t == edited)
        prints[r["fingerprint"]].add(t)
    assert all(len(x) == 1 for x in prints.values())
    long = [r for r in got.values() if 400 < r["n_chars"]]
    assert sum(r["near_edited"] > r["near_next"] for r in long) > 0.9 * len(long)
    # cells of very few rows, and rows that share a doc_id
    cells = {(r["doc_id"], r["text"], r["next_text"]) for r in with_next(docs, 2).collect()}
    assert cells == {(i, t or "", rows[(k + 1) % len(rows)][1] or "") for k, (i, t) in enumerate(rows)}
    same = spark.createDataFrame([(3, f"t{i}") for i in range(9)], "doc_id long, text string")
    assert sorted(r["next_text"] for r in with_next(same, 2).collect()) == [f"t{i}" for i in range(9)]
    one = fingerprint_edits(docs.limit(1)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0 and fingerprint_edits(empty(spark)).collect() == []
    odd = frame(spark, ["a b", None]).collect()
    assert len(fingerprint_edits(frame(spark, ["a b", None])).collect()) == len(odd)


def test_short_edited_texts_are_nearer_than_the_next(spark):
    rng = random.Random(5)
    values = [" ".join("".join(rng.choices("abcdefghij", k=4)) for _ in range(2 + i % 8)) for i in range(80)]
    got = fingerprint_edits(frame(spark, values)).collect()
    # the first row is there twice, so the next of one of the two is its equal
    short = [r for r in got if r["n_chars"] > 8 and r["near_next"] < 1]
    assert len(short) >= len(values)
    assert all(r["near_edited"] > r["near_next"] for r in short)


def test_pieces_make_up_the_text_and_edits_are_located(spark):
    values = [t or "" for t in texts()] + ["a.\n\nb! c?? d\n\n\n", "....", "\n"]
    df = spark.createDataFrame([(t,) for t in values], "text string").select("text", F.array_join(leaves_of(F.col("text")), "").alias("joined"))
    assert all(r["text"] == r["joined"] for r in df.collect())
    lines = [f"Line number {i} has its own words." for i in range(200)]
    changed = [*lines]
    changed[120] = "Something else stands here now."
    inserted = [*lines[:50], "A new line.", *lines[50:]]
    df = spark.createDataFrame([("\n".join(lines), "\n".join(changed), "\n".join(inserted))], "a string, b string, c string")
    for c in "abc":
        df = with_fingerprint(df, c, f"f{c}")
    r = df.select(differing_leaves(F.col("fa"), F.col("fb")).alias("ab"), differing_leaves(F.col("fa"), F.col("fc")).alias("ac"), differing_leaves(F.col("fa"), F.col("fa")).alias("aa"), F.size(leaf_codes(F.col("fa"))).alias("n"), differing_sections(F.col("fa"), F.col("fc")).alias("s"), F.size(F.split(F.split("fa", ":")[1], ",")).alias("sections")).first()
    assert r["n"] == 200 and r["ab"] == [120] and r["ac"] == [] and r["aa"] == []
    assert len(r["s"]) <= 1 < r["sections"]


def test_shared_text_has_the_same_leaves_in_texts_of_any_length(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["th", "an", "er", "in", "ed", "so"]) for _ in range(rng.randint(1, 4)))
    pairs = []
    for limit in (200, 2000):
        for end in (". ", " "):
            text = end.join(" ".join(word() for _ in range(9)) for _ in range(limit))
            # on both sides of a length, and on the same side
            pairs += [(text[: limit + 5], text[11 : limit + 5]), (text[: 3 * limit], text[11 : 3 * limit]), (text[: 2 * limit], text[: limit - 1])]
    pairs += [("д" + "слово и ещё одно длинное " * 9 + text[:1900], "слово и ещё одно длинное " * 9 + text[:1900])]
    df = spark.createDataFrame(pairs, "a string, b string")
    for c in "ab":
        df = with_fingerprint(df, c, f"f{c}")
    near = [r[0] for r in df.select(likeness(F.col("fa"), F.col("fb"))).collect()]
    halves = near[2::3]
    assert min(x for i, x in enumerate(near) if i % 3 != 2 or i == 12) > 0.6, near
    assert min(halves) > 0.35, near
