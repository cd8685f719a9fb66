"""A training corpus in five stages: quality, near-duplicates, benchmark passages, source mix, shards.

Each stage takes all documents that its predecessor kept and returns their columns; the last adds shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from srcloom.llm import decontamination, minhash, mixing, quality, sharding
from srcloom.llm.common import settle, table

#: A document is rejected when low quality is likelier than high quality.
QUALITY = 0.5
#: Documents are near-duplicates from 0.80 of common shingles on; the query of operator 5 has its own 0.85.
SIMILARITY = 80
SHARDS = 16


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (operator 4), learned from the labels, does not reject.

    Rows are judged by their texts; null and empty ones get the score of the intercept. All columns stay as they are."""
    return quality.keep_good(docs, quality.quality_model(docs, table(spark, sf_dir, "labels")), QUALITY)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (operator 5): that with the smallest id.

    Of repeated rows one stays; null ids link with nothing; texts without words stay."""
    return minhash.keep_one(docs, similarity=SIMILARITY)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark (operator 6). Null and empty texts stay; ids are not looked at."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (operator 8). A null source is a source; null texts have no words."""
    return mixing.emit(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot (operator 2); nulls and repeated rows get places like others. Columns of
    these two names give way."""
    return sharding.shard_rows(docs, SHARDS)


STAGES = [
    ("quality classifier", good_quality),
    ("minhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminated),
    ("mixing sources", mixed),
    ("sharding", sharded),
]

#: A trained classifier is no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is a written table that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs, f"stage{i}")
    return docs
