"""Document fingerprints: a Merkle tree over the pieces, paragraphs and sections of a text.

Leaves are pieces of a paragraph: sentences of up to PIECE characters, and longer ones cut where their content says so: at a
space after one of a few letters or after any non-ASCII character, or after a mark such as `，`; only where there is none of these, after PIECE
characters. The rule looks at near characters only and not at the text's length, so shared text has the same leaves in texts
of any two lengths. The pieces make up the whole text, line ends included.
A paragraph is a line; its node hashes its leaves. A section is a run of paragraphs
that ends where a paragraph's hash says so, so an insertion moves no later section; its node hashes its paragraphs,
and the root hashes the sections. All nodes are SHA-256.

A fingerprint is the text `root:sections:leaves:words`: the whole root, the first 8 digits of each section and leaf, with
`,` between leaves and `;` at the end of a paragraph, and 8 digits of each of the WORDS words with the smallest hashes. Roots test equality.
Where they differ, differing sections and leaves locate the edit, and the share of common leaves is the likeness, in which the share of
common words counts as WORD_WEIGHT leaves do: in a text of few leaves, an edit may leave none as it was.

Nulls: a null text is the empty text, which has no leaves. A null doc_id comes before all others. Rows of one doc_id are
ordered by a hash of their text. Of a single row, the next is itself. An empty table gives no rows. Other columns are ignored.
Texts of any length are handled whole. All is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import materialize, with_position

#: Characters of the longest piece, its stops and line ends apart.
PIECE = 40
#: What a piece of a longer sentence ends with.
CUT = r"[ \t](?<=[dgnrty[^\x00-\x7F]][ \t])|[、。，！？；：]"
#: Words that a fingerprint keeps, those with the smallest hashes, and the leaves that they count as.
WORDS, WORD_WEIGHT = 32, 8
#: A word: visible ASCII characters, or one other character.
WORD = r"[!-~]+|[^\x00-\x7F]"
#: Rows of a cell, about, in which rows look for the next; and the places of the order at which ids are cut.
CELL_ROWS, CUTS = 128, 256


def leaves_of(text: Column) -> Column:
    """The pieces of a text, in order; joined they are the text."""
    rest = rf"[^\n.!?]{{1,{PIECE}}}+(?=[\n.!?]|\z)[.!?]*\n*"
    part = rf"[^\n.!?]{{1,{PIECE - 1}}}?(?:{CUT})|[^\n.!?]{{1,{PIECE}}}"
    return F.regexp_extract_all(text, F.lit(rf"{rest}|{part}|[.!?]+\n*|\n+"), F.lit(0))


def words_of(text: Column) -> Column:
    """The digits of the words with the smallest hashes, joined: equal rules make them comparable between any two texts."""
    hashes = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.shiftrightunsigned(F.xxhash64(w), 32))
    smallest = F.slice(F.sort_array(F.array_distinct(hashes)), 1, WORDS)
    return F.array_join(F.transform(smallest, lambda h: F.lpad(F.hex(h), 8, "0")), ",")


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds out: the fingerprint of the text column, which must not be null."""
    sha = lambda c: F.sha2(c, 256)
    df = df.withColumn("_leaves", F.array_join(F.transform(leaves_of(F.col(text)), lambda x: F.concat(sha(x), F.when(x.endswith("\n"), ";").otherwise(","))), ""))
    paragraphs = F.filter(F.split("_leaves", ";"), lambda p: p != "")
    # a section ends after a paragraph whose hash starts with one of four of the sixteen digits
    marked = F.transform(F.transform(paragraphs, sha), lambda h: F.concat(h, F.when(F.substring(h, 1, 1).isin("0", "4", "8", "c"), "|").otherwise(",")))
    df = df.withColumn("_sections", F.transform(F.filter(F.split(F.array_join(marked, ""), r"\|"), lambda s: s != ""), sha))
    short = F.transform("_sections", lambda s: F.substring(s, 1, 8))
    fingerprint = F.concat(sha(F.array_join("_sections", ",")), F.lit(":"), F.array_join(short, ","), F.lit(":"), F.regexp_replace("_leaves", "([0-9a-f]{8})[0-9a-f]{56}", "$1"), F.lit(":"), words_of(F.col(text)))
    return df.withColumn(out, fingerprint).drop("_leaves", "_sections")


def root_of(fingerprint: Column) -> Column:
    return F.substring(fingerprint, 1, 64)


def leaf_codes(fingerprint: Column) -> Column:
    """The leaves' digits, in order."""
    return F.filter(F.split(F.split(fingerprint, ":")[2], "[,;]"), lambda x: x != "")


def section_codes(fingerprint: Column) -> Column:
    """The sections' digits, in order."""
    return F.filter(F.split(F.split(fingerprint, ":")[1], ","), lambda x: x != "")


def word_share(a: Column, b: Column) -> Column:
    """The common share of all different words of two texts, by those with the smallest hashes; 0 where there are no words."""
    x, y = (F.filter(F.split(F.split(f, ":")[3], ","), lambda w: w != "") for f in (a, b))
    among = F.slice(F.sort_array(F.array_union(x, y)), 1, WORDS)
    return F.when(F.size(among) == 0, 0.0).otherwise(F.size(F.array_intersect(F.array_intersect(among, x), y)) / F.size(among))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots, else the common leaves over all different leaves of both; common words count as some leaves do."""
    x, y = leaf_codes(a), leaf_codes(b)
    common, union = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when(root_of(a) == root_of(b), 1.0).otherwise((common + WORD_WEIGHT * word_share(a, b)) / (union + WORD_WEIGHT))


def first_difference(x: Column, y: Column) -> Column:
    """The first place (from 0) at which two lists of digits differ, one that ends earlier included; null if they don't."""
    at = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), F.lit(False))
    return F.when(at > 0, at - 1)


def differing_leaves(a: Column, b: Column) -> Column:
    """The places (from 0) of a's leaves that b lacks: where the edit is. Empty for equal roots."""
    x, y = leaf_codes(a), leaf_codes(b)
    places = F.filter(F.sequence(F.lit(0), F.size(x)), lambda i: (i < F.size(x)) & ~F.coalesce(F.array_contains(y, F.get(x, i)), F.lit(True)))
    return F.when(root_of(a) == root_of(b), F.array().cast("array<int>")).otherwise(places)


def differing_sections(a: Column, b: Column) -> Column:
    """The digits of a's sections that b lacks."""
    return F.array_except(section_codes(a), section_codes(b))


def _cells(placed: DataFrame, n: int, cell_rows: int, cuts: int = CUTS):
    """A function that gives a table with doc_id and _hash its column _cell: about cell_rows rows each, in their order.

    Ids at `cuts` places of the order part the ids into intervals, each cut evenly into as many cells as its rows ask for; rows
    of one doc_id (or of none) that fill an interval are cut by their hash. So far or repeated ids crowd no other's cells.
    """
    step = max(1, -(-n // cuts))
    ids = sorted({r[0] for r in placed.where(F.col("_at") % step == 0).select("doc_id").collect() if r[0] is not None})  # cuts at most
    interval = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(F.array(*map(F.lit, ids)).cast("array<bigint>"), lambda c: c <= F.col("doc_id"))) + 1)
    found = placed.groupBy(interval.alias("k")).agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).collect()
    parts, base = {r["k"]: r for r in found}, 0
    table: list[list[float]] = []  # for each interval: cells before it, its cells, its first id, ids of a cell (0: by hash)
    for k in range(len(ids) + 2):
        r = parts.get(k)
        cells = max(1, -(-r["rows"] // cell_rows)) if r else 1
        single = r is None or r["low"] is None or r["low"] == r["high"]
        table.append([float(base), float(cells), 0.0 if single else float(r["low"]), 0.0 if single else max(1.0, (r["high"] - r["low"] + 1) / cells)])
        base += cells
    bounds = F.array(*(F.array(*map(F.lit, row)) for row in table))

    def cell(df: DataFrame) -> DataFrame:
        # doubles keep the order of ids, if not all their digits
        df = df.withColumn("_interval", F.get(bounds, interval))
        part = lambda i: F.col("_interval")[i]
        by_hash = (F.col("_hash").cast("double") / 2.0**64 + 0.5) * part(1)
        place = F.when(part(3) == 0, by_hash).otherwise((F.col("doc_id").cast("double") - part(2)) / part(3))
        return df.withColumn("_cell", (part(0) + F.greatest(F.lit(0.0), F.least(F.floor(place).cast("double"), part(1) - 1))).cast("long")).drop("_interval")

    return cell


def with_next(docs: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """doc_id, text, fingerprint of each row, and next_text, next_fingerprint of the row with the next doc_id.

    The order of the rows is found without their texts. Texts are then dealt once, into cells of near rows that look ahead within
    themselves only; the first row of the next cell that isn't empty is added to each. No window holds the whole table.
    """
    rows = materialize(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("_row")), "fingerprint-rows", compression="zstd")
    rows = rows.withColumn("_hash", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_hash"), F.col("_row")]
    placed = materialize(with_position(rows.drop("text"), order, "_at", "fingerprint-order"), "fingerprint-places")
    n = placed.count()
    cell = _cells(placed, n, cell_rows)
    placed = cell(placed)
    firsts = placed.groupBy("_cell").agg(F.min(F.struct("_at", "_row")).alias("_f")).select("_f.*")
    # a cell's first row goes to the cell of the row before it, that of all rows to the cell of the last
    before = placed.select(F.when(F.col("_at") == n - 1, 0).otherwise(F.col("_at") + 1).alias("_at"), F.col("_cell").alias("_before"))
    firsts = materialize(firsts.join(before, "_at").select("_row", "_before"), "firsts")
    added = rows.join(firsts, "_row").select(*rows.columns, F.col("_before").alias("_cell"), F.lit(1).alias("_added"))
    both = cell(rows).withColumn("_added", F.lit(0)).unionByName(added)
    # fingerprints are made between two windows over the same cells: behind the shuffle, which then moves texts only
    along = Window.partitionBy("_cell").orderBy("_added", *order)
    both = with_fingerprint(both.withColumn("next_text", F.lead("text").over(along)), "text", "fingerprint")
    both = both.withColumn("next_fingerprint", F.lead("fingerprint").over(along))
    return both.where("_added = 0").select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text: the last half replaced by the start of the next document. edit_section and
    edit_leaf: the first section and leaf (from 0) that the edit changed; null where it changed none."""
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = with_fingerprint(rows.withColumn("edited", edited), "edited", "edited_fingerprint")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        first_difference(section_codes(F.col("fingerprint")), section_codes(F.col("edited_fingerprint"))).alias("edit_section"),
        first_difference(leaf_codes(F.col("fingerprint")), leaf_codes(F.col("edited_fingerprint"))).alias("edit_leaf"),
    )
