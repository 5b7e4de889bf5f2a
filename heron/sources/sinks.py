"""Writers: result folders, positional splits, vector updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heron.operators.ranks import ranked


def write_outputs(df: DataFrame, summary: DataFrame, path: str) -> None:
    """Rows as CSV and JSON lines and the one-row summary as JSON, under one folder."""
    flat = df.select(*(F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes))
    flat.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(f"{path}/rows_csv")
    df.write.mode("overwrite").json(f"{path}/rows_json")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary_json")


def append_table(df: DataFrame, path: str, checks: dict[str, Column] | None = None) -> None:
    """Rows that pass all checks are appended to path, the others to path_rejected with the names of the checks that they fail; neither keeps the other back."""
    failed = failed_checks(checks or {})
    df.filter(F.size(failed) == 0).write.mode("append").parquet(path)
    bad = df.withColumn("failed_checks", failed).filter(F.size("failed_checks") > 0)
    if checks and not bad.isEmpty():
        bad.write.mode("append").parquet(f"{path}_rejected")


def failed_checks(checks: dict[str, Column]) -> Column:
    """The names of the checks that a row fails; a check that is null counts as passed, as in a store's constraints."""
    return F.array_compact(F.array(*(F.when(~ok, F.lit(name)) for name, ok in checks.items()))) if checks else F.array().cast("array<string>")


def split_by_position(df: DataFrame, order: str, ratio: float | list[float]) -> DataFrame:
    """df with a part for each row by its position in the order column: 0 for the first int(n * ratio), and so on for several ratios, the rest in the last."""
    ratios = ratio if isinstance(ratio, list) else [ratio]
    placed, n = ranked(df, order)
    part, end = F.lit(len(ratios)), 0
    ends = []
    for r in ratios:
        end += int(n * r)
        ends.append(end)
    for k, e in reversed(list(enumerate(ends))):
        part = F.when(F.col("place") < e, k).otherwise(part)
    return placed.withColumn("part", part).drop("place")


def split_lines(lines: DataFrame, header: str, ratio: float | list[float]) -> DataFrame:
    """split_by_position() of lines (at, line) with their header before them as a row like any other, so that it counts and only the first part has it."""
    first = lines.sparkSession.createDataFrame([(None, header)], "at long, line string")
    return split_by_position(first.unionByName(lines.select(F.col("at").cast("long"), "line")), "at", ratio)


def update_vectors(table: DataFrame, fresh: DataFrame, column: str = "v") -> DataFrame:
    """table (id, ...) with the column replaced where fresh (id, new) has a row; written back by the caller."""
    return table.join(fresh.select("id", F.col("new").alias("_new")), "id", "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def cascade_delete(evidence: DataFrame, messages: DataFrame) -> DataFrame:
    """The evidence whose message is still there."""
    return evidence.join(messages.select(F.col("id").alias("message_id")), "message_id", "left_semi")
