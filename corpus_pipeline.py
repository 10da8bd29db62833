"""The corpus pipeline: five stages, each an operator, from documents to packed sequences.

Each stage gets what its predecessor kept, as written. All but the last return
the columns of documents; ``n_chars`` follows the text where a stage changes it.

Nulls may stand in any column. A null or empty text fails the quality rules; in the
later stages it is no one's duplicate, loses nothing, and packs as its end id. Ids may
be null or repeat: rows are judged, cut, masked and packed each by its own text.
Very long texts are read whole. An empty table gives an empty table of the same
columns. Further columns, whatever their names, pass through all stages but packing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korpisto.llm import op01_packing, op06_near_dedup, op07_substring_dedup, op08_pii, op10_quality
from korpisto.llm.common import documents, drop, labels, materialise, ship


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or that the forest holds for odd go."""
    ship(spark)
    return op10_quality.keep(docs, labels(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return op06_near_dedup.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 50 words that a document of lower id holds are cut out."""
    return _counted(op07_substring_dedup.without_repeats(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to the names of their kinds."""
    return _counted(op08_pii.masked(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences: the rows of operator 1."""
    return op01_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("personal data", personal_data),
    ("packing", packing),
]

#: No SQL expresses trained thresholds and subword tokens; tests compare stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
