"""Running sums and maxima within groups of any size, by ranges of the sorted rows and what each range hands on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heron.plans.session import cut

#: The column of the range that a row lies in.
RANGE = "_range"


def ranges(df: DataFrame, group: str, *order: str) -> DataFrame:
    """df with the range of each row: rows are dealt out by group and order, so a large group lies in several ranges, one after another."""
    # tie parts rows that agree in all else, so that no range has to hold all of them.
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    return cut(tied.repartitionByRange(group, *order, "_tie").withColumn(RANGE, F.spark_partition_id()), "ranges")


def running(rows: DataFrame, group: str, order: list[str], current: bool = True, **columns: tuple[str, str]) -> DataFrame:
    """rows of ranges() with each named column, ("sum" or "max", of a column), over the rows of the group before, and the row itself if current.

    A window holds the rows of a group in one range. What the ranges before have is one row for each
    group and range; those that are not a group's first range are fewer than there are ranges, so what
    is handed on is broadcast.
    """
    fold = {"sum": F.sum, "max": F.max}
    per = rows.groupBy(group, RANGE).agg(*(fold[kind](c).alias(name) for name, (kind, c) in columns.items()))
    earlier = W.partitionBy(group).orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    first = F.row_number().over(W.partitionBy(group).orderBy(RANGE)) == 1
    handed = per.select(F.col(group).alias("_group"), F.col(RANGE).alias("_at"), first.alias("_first"), *(fold[kind](name).over(earlier).alias(f"_before_{name}") for name, (kind, _) in columns.items()))
    handed = handed.filter("NOT _first").drop("_first")
    w = W.partitionBy(RANGE, group).orderBy(*order, "_tie").rowsBetween(W.unboundedPreceding, 0 if current else -1)
    inside = rows.withColumns({f"_in_{name}": fold[kind](c).over(w) for name, (kind, c) in columns.items()})
    both = inside.join(F.broadcast(handed), F.col(group).eqNullSafe(F.col("_group")) & (F.col(RANGE) == F.col("_at")), "left")

    def joined(name: str, kind: str) -> Column:
        a, b = F.col(f"_before_{name}"), F.col(f"_in_{name}")
        return F.greatest(a, b) if kind == "max" else F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))

    out = both.withColumns({name: joined(name, kind) for name, (kind, _) in columns.items()})
    return out.drop("_group", "_at", *(f"{p}_{name}" for name in columns for p in ("_before", "_in")))


def running_totals(df: DataFrame, group: str, order: str, columns: list[str]) -> DataFrame:
    """df with the totals so far of the columns within each group."""
    out = running(ranges(df, group, order), group, [order], **{f"total_{c}": ("sum", c) for c in columns})
    return out.drop(RANGE, "_tie")


def merge_ranges(spans: DataFrame) -> DataFrame:
    """(id, start, end, strong): ranges (id, start, end, strong) merged where one starts within or at the end of those before; strong if any is."""
    valid = ranges(spans.filter((F.col("start") >= 0) & (F.col("end") > F.col("start"))), "id", "start", "end")
    reached = running(valid, "id", ["start", "end"], current=False, reach=("max", "end"))
    marked = cut(reached.withColumn("fresh", (F.col("reach").isNull() | (F.col("start") > F.col("reach"))).cast("long")), "ranges")
    island = running(marked, "id", ["start", "end"], island=("sum", "fresh"))
    return island.groupBy("id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.bool_or("strong").alias("strong")).drop("island")
