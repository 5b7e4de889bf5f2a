"""Work of the queries on messages and neighbours, and what they give where few rows are labelled."""

import math
import os
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from heron.plans import q_vectors

DIR = "/root/testdata/sf0.001"


def labelled(spark, tmp_path, rows):
    """The tables with so many labelled vectors, of ids from 0."""
    for p in Path(DIR).glob("*.parquet"):
        if p.stem != "embeddings":
            os.symlink(p, tmp_path / p.name)
    found = spark.read.parquet(f"{DIR}/embeddings.parquet")
    changed = found.withColumn("label", F.when(F.col("vec_id") < rows, 1).when(F.col("label") == 1, 2).otherwise(F.col("label")).cast("int"))
    changed.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("rows", [0, 1, 2])
def test_rows_without_a_labelled_neighbour_have_others(spark, tmp_path, rows):
    path = labelled(spark, tmp_path, rows)
    db = duckdb.connect()
    for p in tmp_path.glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    want = db.execute(entry.oracle_sql()["ai_score"]).fetchall()
    found = [tuple(r) for r in entry.queries()["ai_score"](spark, path).select("id", "ai_score", "top_sim", "avg_top3").collect()]
    assert len(found) == len(want)
    for a, b in zip(sorted(found), sorted(want), strict=True):
        assert a[:2] == b[:2] and all(math.isclose(x, y, abs_tol=1e-9) for x, y in zip(a[2:], b[2:], strict=True))


def test_rows_with_a_labelled_neighbour_meet_only_labelled_ones(spark, monkeypatch):
    met, nearest = [], q_vectors.nearest

    def seen(queries, corpus, *args):
        met.append(queries.count() * corpus.count())
        return nearest(queries, corpus, *args)

    monkeypatch.setattr(q_vectors, "nearest", seen)
    q_vectors.fused(spark, DIR)
    v = spark.read.parquet(f"{DIR}/embeddings.parquet")
    assert sum(met) <= v.count() * v.filter("label = 1").count()


def test_points_by_category_score_the_messages_once(spark):
    """What is left to run after the points are counted reads the texts for their categories alone."""
    plan = entry.queries()["operating_points_by_category"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "verdict" not in plan and "top_sim" not in plan
