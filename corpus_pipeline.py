"""From raw documents to packed training sequences: the stages of ``STAGES``, each an operator of ``chronokv.llm``.

Quality rules and the quality classifier drop what they reject; of each group of near-duplicates one document stays; repeated passages are cut
out of later documents; what is left is packed.  Each stage works on all that the one before it kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chronokv.llm import cotrain, nearsets, packing, quality, substrings
from chronokv.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line model keep; the model is fitted on labelled ones among them."""
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps; it is fitted on the raw table, as the rules before it leave no poor labelled rows."""
    return cotrain.keep(docs, cotrain.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that of the smallest doc_id."""
    return nearsets.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document of a smaller doc_id has too."""
    return substrings.without_repeats(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 1024 tokens."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("simhash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply ``STAGES`` to the documents; what a stage returns is a written table before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The line model and the classifier are fitted; SQL can't express them.
ORACLE_SQL = None
