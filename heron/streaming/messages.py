"""Streaming twins: stateless scoring, running redaction totals and a daily series with late data."""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heron.functions.pii import PATTERNS, redact
from heron.operators.rules import phase1, rule_hits


def score_stream(messages: DataFrame, brands: list[str]) -> DataFrame:
    """Verdicts of a stream of messages; the batch transformation, as it keeps no state."""
    return phase1(rule_hits(redact(messages), brands))


def redaction_totals(messages: DataFrame, by: str) -> DataFrame:
    """Totals so far; for complete or update mode."""
    return redact(messages).groupBy(by).agg(*(F.sum(f"n_{k}").alias(k) for k in PATTERNS))


def follow_totals(messages: DataFrame, by: str, path: str, time: str = "msg_date", late: str = "1 day") -> None:
    """Take what is new in a stream of messages into the totals under path, and end.

    The totals of each key are the state of the query, kept in path/state; every batch writes those of
    the keys that it changed as a folder of its own, so a batch that is done again after a failure
    writes over itself. A run goes on where the last one ended. late_rows counts the rows that were older than the
    newest row of all earlier runs by more than late when they came; they count in the totals too.
    """
    spark = messages.sparkSession
    # The first run compares with a time before all others, so that each run has the same state.
    newest = newest_of(spark, path) or datetime(1, 1, 2)
    too_old = F.col(time) < F.lit(newest) - F.expr(f"INTERVAL {late}")
    sums = [F.sum(f"n_{k}").alias(k) for k in PATTERNS]
    totals = redact(messages).groupBy(by).agg(F.count("*").alias("n"), *sums, F.count_if(too_old).alias("late_rows"), F.max(time).alias("newest"))

    def put(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/totals/batch={number}")

    totals.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()


def _written(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/totals")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def newest_of(spark: SparkSession, path: str):
    """The newest row's time in the totals under path; None where there is none."""
    rows = _written(spark, path)
    return None if rows is None else rows.agg(F.max("newest")).first()[0]


def latest_totals(spark: SparkSession, path: str, by: str) -> DataFrame:
    """The totals of each key as the last batch that changed it left them, and how many batches did."""
    rows = _written(spark, path)
    last = rows.groupBy(by).agg(F.max_by(F.struct("n", *PATTERNS, "late_rows"), "batch").alias("x"), F.count("*").alias("batches"))
    return last.select(by, "x.*", "batches")


def daily_series(events: DataFrame, time: str, kind: str, late: str = "1 day") -> DataFrame:
    """Counts by day and kind; a day is final once the watermark has passed it, and later rows are dropped."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    days = timed.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("w"), kind)
    return days.agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("d"), kind, "n")
