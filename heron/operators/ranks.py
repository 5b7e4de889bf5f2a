"""Positions and exact quantiles of large columns, without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heron.plans.session import cut

_BITS = 33


def ranked(df: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """df with place, a row's position (from 0) in the order of the columns, and the number of rows.

    Rows are sorted by ranges; a row's place is its place in its range and how many rows lie in the
    ranges before, of which there are at most as many as partitions.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    rows = cut(rows, "ranked")
    part = F.shiftright("place", _BITS)
    found = {r["part"]: r["n"] for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    first, total = {}, 0
    for p in sorted(found):
        first[p], total = total, total + found[p]
    if not total:
        return rows, 0
    before = F.create_map(*(F.lit(x) for pair in first.items() for x in pair))
    return rows.withColumn("place", F.element_at(before, part) + F.col("place").bitwiseAND((1 << _BITS) - 1)), total


def quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """The column's quantiles by linear interpolation, nulls left out; at most two rows for each come to the driver."""
    placed, n = ranked(df.select(F.col(column).cast("double").alias("x")).filter("x is not null"), "x")
    if not n:
        return [None] * len(shares)
    at = [s * (n - 1) for s in shares]
    wanted = sorted({int(a) for a in at} | {min(n - 1, int(a) + 1) for a in at})
    value = {r["place"]: r["x"] for r in placed.filter(F.col("place").isin(wanted)).collect()}
    return [value[int(a)] + (a - int(a)) * (value[min(n - 1, int(a) + 1)] - value[int(a)]) for a in at]
