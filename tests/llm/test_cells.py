"""Queries and anchors that meet all rows in cells: results by brute force, and what the plan may not do."""

import math
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from heron.llm import cells, negatives, topk


def whole(x, scale):
    return [math.floor(Fraction(a) * scale) for a in x]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_broadcasts_no_queries(spark):
    """The queries go to every task; as a side of a join they were small enough for Spark to broadcast all those copies."""
    r = np.random.default_rng(3)
    df = spark.createDataFrame([(i, r.normal(size=4).tolist()) for i in range(400)], "vec_id long, embedding array<double>")
    found = topk.top_k(df)
    assert "Broadcast" not in plan(found) and found.count() == 40


def test_top_k_in_lanes(spark, monkeypatch):
    """Queries beyond what a task holds meet all rows in passes of their own; near copies are met by coordinate pruning."""
    monkeypatch.setattr(topk, "BLOCK", 32)
    monkeypatch.setattr(topk, "QUERIES", 4)
    monkeypatch.setattr(cells, "HELD", 60)
    r = np.random.default_rng(4)
    stems = r.normal(size=(6, 5))
    rows = [(i, (stems[i % 6] + r.normal(size=5) * 0.05).tolist()) for i in range(500)]
    v = {i: whole(x, 1024) for i, x in rows}
    want = sorted((q, k, c, -x) for q in range(0, 500, 10) for k, (x, c) in enumerate(sorted((-sum(a * b for a, b in zip(v[q], v[c], strict=True)), c) for c in v if c != q)[:7], 1))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = topk.top_k(df, every=10, k=7)
    assert sorted(tuple(x) for x in found.collect()) == want
    assert plan(found).count("Scan parquet") > 2 and found.filter(F.col("rank") > 7).count() == 0


def test_hard_negatives_send_no_tiles(spark, monkeypatch):
    """What tasks send each other is panels, a few times as many as there are, and a few rows an anchor; not a score for each anchor and row."""
    monkeypatch.setattr(negatives, "BLOCK", 64)
    monkeypatch.setattr(negatives, "ANCHORS", 8)
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=6).tolist(), i % 3) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    found = negatives.hard_negatives(df, every=2)
    assert "tile" not in plan(found) and found.count() > 0


def test_hard_negatives_in_lanes(spark, monkeypatch):
    """Anchors beyond what a task holds meet all rows in passes of their own, and all panels of a tile are added up."""
    monkeypatch.setattr(negatives, "BLOCK", 64)
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    monkeypatch.setattr(negatives, "CHUNK", 2)
    r = np.random.default_rng(6)
    base = r.normal(size=5) + 1
    rows = [(i, (base + r.normal(size=5) * 0.7).tolist(), int(r.integers(4))) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    want = sorted(tuple(x) for x in negatives.hard_negatives(df, every=20).collect())
    v, label = {i: whole(x, 256) for i, x, _ in rows}, {i: y for i, _, y in rows}
    brute = []
    for a in range(0, 500, 20):
        scores = sorted((-sum(x * y for x, y in zip(v[a], v[c], strict=True)), c) for c in v if c != a)
        for p, pos in [s for s in scores if label[s[1]] == label[a]][:5]:
            near = [s for s in scores if label[s[1]] != label[a] and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            brute += [(a, pos, n, c, -p, -s) for n, (s, c) in enumerate(near, 1)]
    assert want == sorted(brute) and len(brute) > 100
    monkeypatch.setattr(cells, "HELD", 40)
    assert sorted(tuple(x) for x in negatives.hard_negatives(df, every=20).collect()) == want
