"""The corpus pipeline: toxic and low-quality documents go, one near copy of each group stays, documents with benchmark
passages go, and the rest is packed into training sequences.

Nulls: a null text is scored, kept or dropped as the empty text and is a copy of nothing; rows without a doc_id are judged like all
others. Repeated rows are copies of each other: one stays. Of copies the one with the smallest doc_id stays, and of equal or no
doc_ids any one. An empty table, or one of which a stage drops all rows, gives no rows. Other columns are kept up to the last
stage, whatever their names. Texts are handled whole.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the columns
of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm.common import materialize, table
from tidewatch.llm.decontamination import drop_contaminated
from tidewatch.llm.ngram_jaccard import keep_one_row_of_each
from tidewatch.llm.packing import pack_documents
from tidewatch.llm.quality import drop_low_quality
from tidewatch.llm.toxicity import drop_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_low_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_row_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: Trained classifiers and tokenizers aren't SQL; tests/llm/test_pipeline.py holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
