"""Backfills that can be stopped and go on, and updates of a stored table by partitions.

A backfill works through the rows of a table in the order of their ids, a batch at a time, as a loop with
"WHERE id > :mark ORDER BY id LIMIT :n" does. Each batch is a folder of its own, named by the last id
it may hold, that is written whole or not at all; the marks file names the batches that are done.
A batch that was stopped half way is written over when the backfill goes on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heron.operators.ranks import ranked
from heron.plans.session import cut

_MARK = "mark long"


def mark(spark: SparkSession, path: str) -> int | None:
    """The id up to which the backfill under path is done; None before its first batch."""
    try:
        return spark.read.schema(_MARK).json(f"{path}/marks").agg(F.max("mark")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def batch_ends(ids: DataFrame, size: int) -> list[int]:
    """The last id of each batch of size rows; one number for each batch comes to the driver."""
    placed, n = ranked(ids.select("id"), "id")
    ends = placed.filter((F.col("place") % size == size - 1) | (F.col("place") == n - 1)).select("id").distinct().collect() if n else []
    return sorted(r["id"] for r in ends)


def backfill(todo: DataFrame, make: Callable[[DataFrame], DataFrame], path: str, size: int, batches: int | None = None) -> int:
    """Write make(rows) for the rows of todo (id, ...) above the stored mark, size rows at a time; how many batches were written.

    Rows whose id lies at or below the mark are left alone, whether they had a result or not. With
    batches, the run ends after so many. Rows of one id are never parted.
    """
    spark = todo.sparkSession
    done = mark(spark, path)
    rows = todo if done is None else todo.filter(F.col("id") > done)
    written = 0
    for end in batch_ends(rows, size):
        if batches is not None and written == batches:
            break
        part = rows.filter(F.col("id") <= end) if done is None else rows.filter((F.col("id") > done) & (F.col("id") <= end))
        # A batch that was begun before is written over; the mark comes last.
        make(part).write.mode("overwrite").parquet(f"{path}/rows/batch={end}")
        spark.createDataFrame([(end,)], _MARK).coalesce(1).write.mode("append").json(f"{path}/marks")
        done, written = end, written + 1
    return written


def backfilled(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all batches that are done, with their batch."""
    done = mark(spark, path)
    rows = spark.read.schema(f"{schema}, batch long").parquet(f"{path}/rows") if done is not None else spark.createDataFrame([], f"{schema}, batch long")
    return rows.filter(F.col("batch") <= F.lit(done).cast("long"))


def write_by_ids(table: DataFrame, path: str, width: int) -> None:
    """Store table (id, ...) in partitions of width ids each."""
    table.withColumn("span", F.floor(F.col("id") / width)).repartition("span").write.partitionBy("span").parquet(path)


def update_by_ids(spark: SparkSession, path: str, fresh: DataFrame, column: str, width: int) -> None:
    """Replace the column where fresh (id, new) has a row; only the partitions that hold such rows are read and written."""
    fresh = cut(fresh.select("id", F.col("new").alias("_new"), F.floor(F.col("id") / width).alias("span")), "fresh")
    # The partitions to read come from the right side: those without a fresh row are pruned.
    old = spark.read.parquet(path)
    held = old.join(fresh.select("span").distinct(), "span", "left_semi")
    new = held.join(fresh.drop("span"), "id", "left").withColumn(column, F.coalesce("_new", column)).select(old.columns)
    # Written aside first, as the partitions are read and replaced in one go.
    cut(new, "updated").repartition("span").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("span").parquet(path)
