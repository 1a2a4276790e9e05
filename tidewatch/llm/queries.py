"""The queries of the corpus operators: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.alignment import align_documents
from tidewatch.llm.chat import repair_conversations
from tidewatch.llm.common import table
from tidewatch.llm.decontamination import contamination_digest, find_contamination
from tidewatch.llm.embedding_dedup import near_duplicate_vectors
from tidewatch.llm.fingerprint import fingerprint_edits
from tidewatch.llm.ngram_jaccard import near_duplicates
from tidewatch.llm.packing import pack_documents
from tidewatch.llm.quality import score_quality
from tidewatch.llm.sharding import shard_documents
from tidewatch.llm.toxicity import score_toxicity
from tidewatch.llm.url_filter import filter_urls
from tidewatch.llm.warc import read_archive, write_archive
from tidewatch.llm.whitening import whiten


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digest(find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archive(write_archive(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(table(spark, sf_dir, "conversations"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_packing": op2_packing,
        "op3_decontamination": op3_decontamination,
        "op4_chat": op4_chat,
        "op5_warc": op5_warc,
        "op6_url_filter": op6_url_filter,
        "op7_ngram_jaccard": op7_ngram_jaccard,
        "op8_toxicity": op8_toxicity,
        "op9_fingerprint": op9_fingerprint,
        "op10_quality": op10_quality,
        "op11_embedding_dedup": op11_embedding_dedup,
        "op12_alignment": op12_alignment,
        "op13_whitening": op13_whitening,
    }


#: A text's letters A-Z lower-cased.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
  b AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
  c AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
  i AS (SELECT DISTINCT item_id, n, array_to_string(w[pos : pos + n - 1], ' ') AS part FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM c)),
  p AS (SELECT r, n, pos, array_to_string(w[pos : pos + n - 1], ' ') AS part FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM d, (SELECT DISTINCT n FROM i))),
  h AS (SELECT r, p.n, pos, item_id FROM p JOIN i ON p.n = i.n AND p.part = i.part),
  k AS (SELECT r, count(DISTINCT pos + o) AS n_hit FROM (SELECT DISTINCT r, pos, unnest(range(0, n)) AS o FROM h) GROUP BY r),
  m AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY r)
  SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN k USING (r) LEFT JOIN m USING (r)"""

_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(hex, {5 * g + 1}, 5) AS BIGINT) >> {shift}) & 31) + 1 AS INT), 1)" for g in range(8) for shift in (15, 10, 5, 0))

OP5 = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages), f AS (SELECT hex, min(page_id) AS first, count(*) AS n FROM p GROUP BY 1)
  SELECT page_id, strlen(payload) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, true AS intact FROM p JOIN f USING (hex)"""

OP7 = rf"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT DISTINCT r, array_to_string(w[pos : pos + n - 1], ' ') AS part FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM (SELECT r, w, least(5, len(w)) AS n FROM d WHERE len(w) > 0))),
  z AS (SELECT r, count(*) AS n FROM s GROUP BY r),
  o AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM s a JOIN s b ON a.part = b.part AND a.r < b.r GROUP BY 1, 2),
  e AS (SELECT a, b FROM o JOIN z x ON x.r = a JOIN z y ON y.r = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
  u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  t AS (SELECT r AS a, r AS b FROM d UNION SELECT t.a, u.b FROM t JOIN u ON u.a = t.b)
  SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d LEFT JOIN z USING (r) JOIN (SELECT t.a AS r, min(x.doc_id) AS component_id FROM t JOIN d x ON x.r = t.b GROUP BY 1) USING (r)"""

OP11 = """WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  k AS (SELECT r, label, e FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(e, lambda c: c <> 0)) > 0),
  l AS (SELECT a.r AS a, b.r AS b FROM k a JOIN k b ON a.label = b.label AND a.r <> b.r WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.98 ELSE false END),
  t AS (SELECT r AS a, r AS b FROM v UNION SELECT t.a, l.b FROM t JOIN l ON l.a = t.b)
  SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = v.r) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN (SELECT t.a AS r, min(x.vec_id) AS component_id FROM t JOIN v x ON x.r = t.b GROUP BY 1) USING (r)"""


def oracle_sql() -> dict[str, str]:
    """The others aren't SQL: heaps, tokenizers, dynamic programming, trained models and hash trees; tests hold them against
    plain versions."""
    return {"op3_decontamination": OP3, "op5_warc": OP5, "op7_ngram_jaccard": OP7, "op11_embedding_dedup": OP11}
