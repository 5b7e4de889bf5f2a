"""A corpus pipeline over documents: each stage is one operator of heron.llm, and its decisions take effect.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns
of documents. A stage works on every row that the one before it kept. Null and empty texts pass the
toxicity stage and fall to the quality rules; empty tables give empty results. Very long texts are
worked on whole and packed in pieces. Of equal texts the near-duplicate stage keeps that of the
smallest id; rows that repeat both id and text are one document, and all of them stay. Extra columns,
whatever their names, reach the last stage, which gives its own columns only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heron.llm.neardup import drop_near_duplicates
from heron.llm.packing import pack
from heron.llm.quality import filter_quality
from heron.llm.suffix import drop_repeated_strings
from heron.llm.toxicity import filter_toxic
from heron.plans.session import cut, ship, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned lexicon scores as toxic go."""
    ship(spark)
    return filter_toxic(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-supervision rules reject go."""
    ship(spark)
    return filter_quality(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, the one of the smallest id."""
    ship(spark)
    return drop_near_duplicates(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that an earlier document or place holds are cut out of the texts."""
    ship(spark)
    return drop_repeated_strings(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokenised documents, packed into sequences."""
    ship(spark)
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", minhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]
#: The stages learn models and pack sequences, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
