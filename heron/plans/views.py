"""Views that many queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heron.functions.pii import redact
from heron.operators import ontology, rules
from heron.plans.session import table
from heron.sources.messages import dns_answers, dns_facts, messages

BRANDS = ["acme.com"]


def unnest(df: DataFrame, array: str, name: str, *keep: str) -> DataFrame:
    """A row (keep, name) for each element of the array.

    explode() alone would let the optimiser demand a non-empty array below all projections, and so
    work out the array's whole expression a second time; the null of an empty one is dropped above.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def scored(spark, sf_dir, dns: bool = False, weights=None) -> DataFrame:
    """Redacted messages with hits, score, verdict and reasons."""
    hits = rules.rule_hits(redact(messages(spark, sf_dir)), BRANDS, dns_facts(dns_answers(spark)) if dns else None)
    return rules.phase1(hits, weights)


def with_attacks(spark, sf_dir, dns: bool = True) -> DataFrame:
    return ontology.infer(scored(spark, sf_dir, dns).withColumn("properties", ontology.properties()))


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
