"""From raw documents to packed training sequences.

Every stage works on all that its predecessor kept.  The first four are filters and
return the columns of ``documents``; the last returns the pieces of the sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wayside.llm import (
    compression_quality,
    decontaminate,
    grace_dedup,
    minhash_join,
    packing,
)
from wayside.llm.common import prepared, stored, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.7 or more; labels that are held out teach nothing.

    Null and empty texts have a score like any other.  Repeated rows have one score and
    stay or go together; a null id is in the fold of empty text.  Without labels every
    score is one half and all documents go.
    """
    prepared(spark)
    return compression_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id.

    Null and empty texts are equal.  A null id is smaller than any other; of repeated
    rows one stays.
    """
    prepared(spark)
    return grace_dedup.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates by shingles of two words, the document with the smallest id.

    Texts without words are near to nothing and stay.  Rows that share an id are one
    document: they stay or go together.  A null id is smaller than any other.
    """
    prepared(spark)
    return minhash_join.drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than 5 % of the words quote test items.

    Texts without words quote nothing and stay, as do all where there are no items.
    Every row is judged by itself, whatever its id.
    """
    prepared(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents and their places in the sequences.

    A null or empty text is its end mark alone.  Repeated rows are packed each by
    itself.  No documents give no pieces.
    """
    prepared(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", best_fit_packing),
]

# SQL expresses neither the classifier nor the packing: tests/llm compares the stages
# with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
