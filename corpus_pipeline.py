"""From raw documents to packed sequences, one operator of ``goldpan.llm`` a stage."""

from __future__ import annotations

from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldpan.llm import line_quality, packing, secret_scans, simhash
from goldpan.llm.common import stored, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
RADIUS = 3  # bits


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that fail them."""
    return line_quality.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the lowest doc_id.

    Near copies are what links of at most three bits between SimHash fingerprints reach.
    """
    return simhash.unique(docs, radius=RADIUS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, confirmed secrets in their texts replaced by a mark."""
    forest = secret_scans.trained(spark, docs, VOCABULARY)
    return secret_scans.redacted(docs, forest, VOCABULARY)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in token ids, with the sequences they are packed into."""
    items = stored(packing.counted_ids(docs, VOCABULARY, public_tokenizers.PATTERN))
    return packing.pack(items, "doc_id", "n_tokens").select(
        F.col("key").alias("doc_id"),
        "piece",
        "start",
        F.col("length").alias("n_tokens"),
        "bin",
        "bin_size",
        "offset",
    )


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]
# Fingerprints, trained trees and packing by best fit: no stage of these is SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    documents = table(spark, sf_dir, "documents")
    return reduce(lambda docs, stage: stored(stage[1](spark, docs, sf_dir)), STAGES, documents)
