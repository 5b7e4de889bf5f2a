"""Exact and approximate neighbours by plain numpy."""

import numpy as np
import pytest

from heron.operators import ann, vectors

VECTOR = "id long, v array<double>"


def brute(queries, corpus, k, metric="l2"):
    out = []
    for i, x in queries:
        near = [(round(float(vectors.similarities(np.array([x]), np.array([y]), metric)[0, 0]), 9), j) for j, y in corpus if j != i and len(y) == len(x)]
        out += [(i, j, r) for r, (_, j) in enumerate(sorted(near, key=lambda p: (-p[0], p[1]))[:k], 1)]
    return sorted(out)


def clustered(n, seed, dim=6):
    r = np.random.default_rng(seed)
    middles = r.normal(size=(12, dim)) * 3
    rows = [(i, (middles[r.integers(12)] + r.normal(size=dim) * 0.4).tolist()) for i in range(n)]
    return rows + [(n + i, rows[7][1]) for i in range(30)]


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_nearest_by_brute_force(spark, monkeypatch, metric):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rows = clustered(200, 1) + [(500, [1.0, 2.0]), (501, [1.0, 2.5]), (502, [2.0, 1.0])]
    df = spark.createDataFrame([*rows, (600, None), (601, []), (None, [1.0] * 6)], VECTOR).repartition(3)
    found = vectors.nearest(df.filter("id % 10 = 0 OR id IS NULL"), df, 5, metric)
    assert sorted((r["query_id"], r["id"], r["rank"]) for r in found.collect()) == brute([x for x in rows if x[0] % 10 == 0], rows, 5, metric)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_index_holds_every_row_and_finds_most_neighbours(spark, tmp_path, metric):
    rows = clustered(900, 2)
    odd = [(2000, [1.0, 2.0]), (2001, [2.0, 1.0]), (2002, None), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows + odd, VECTOR).repartition(3)
    path = f"file://{tmp_path}/index"
    ann.build(df, path, lists=24, metric=metric, sample=300)
    stored = spark.read.parquet(f"{path}/lists")
    assert sorted(r["id"] for r in stored.select("id").collect()) == sorted([i for i, _ in rows] + [2000, 2001])
    queries = df.filter("id % 20 = 0")
    exact = vectors.nearest(queries, df, 8, metric)
    got = ann.recall(ann.search(spark, path, queries, 8, probes=6), exact).first()
    assert got["expected"] == 8 * len([1 for i, _ in rows if i % 20 == 0]) + 1 and got["recall"] >= 0.9
    every = ann.search(spark, path, queries, 8, probes=24)
    assert sorted((r["query_id"], r["id"], r["rank"]) for r in every.collect()) == sorted((r["query_id"], r["id"], r["rank"]) for r in exact.collect())


def test_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], VECTOR)
    ann.build(none, f"file://{tmp_path}/index")
    assert ann.search(spark, f"file://{tmp_path}/index", spark.createDataFrame([(1, [1.0])], VECTOR)).count() == 0


def test_rows_of_a_query_s_own_id_take_no_place(spark):
    rows = [(1, [0.0, 0.0])] * 4 + [(2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, [3.0, 0.0])]
    df = spark.createDataFrame(rows, VECTOR)
    found = vectors.nearest(df.filter("id = 1").limit(1), df, 2).collect()
    assert [(r["id"], r["rank"]) for r in sorted(found, key=lambda r: r["rank"])] == [(2, 1), (3, 2)]


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_best_of_a_tile_with_ties_and_odd_values(metric):
    r = np.random.default_rng(4)
    c = np.vstack([r.normal(size=(1500, 8)), np.repeat(r.normal(size=(3, 8)), 40, axis=0), np.zeros((2, 8))])
    ids = np.arange(len(c)) * 2
    for k in (1, 8):
        got = list(zip(*(x.tolist() for x in vectors.best(ids[1400:1700:7], c[1400:1700:7], ids, c, k, metric)), strict=True))
        near = vectors.similarities(c[1400:1700:7], c, metric).round(9)
        want = [(q, j) for q, row in zip(ids[1400:1700:7].tolist(), near, strict=True) for j in sorted((j for j in ids.tolist() if j != q), key=lambda j: (-row[j // 2], j))[:k]]
        assert [x[:2] for x in got] == want


def test_a_cell_holds_a_bounded_share(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "HELD", 1)
    held = []
    ranked = vectors.ranked_neighbors

    def seen(queries, corpus, *args):
        held.extend(r["count"] for r in corpus.groupBy("cell").count().collect())
        return ranked(queries, corpus, *args)

    monkeypatch.setattr(vectors, "ranked_neighbors", seen)
    rows = clustered(300, 5)
    df = spark.createDataFrame(rows, VECTOR)
    found = vectors.nearest(df.filter("id % 7 = 0"), df, 4).collect()
    assert sorted((r["query_id"], r["id"], r["rank"]) for r in found) == brute([x for x in rows if x[0] % 7 == 0], rows, 4)
    assert len(held) > 10 and max(held) < 50


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("case", ["close", "long", "short", "outlier", "huge"])
def test_single_precision_loses_no_neighbour(metric, case):
    """Rows that single precision cannot tell apart, and of any length, are still ranked by their similarities."""
    r = np.random.default_rng(6)
    c = r.normal(size=(1300, 7))
    if case == "close":
        c = c[:1] + r.normal(size=(1300, 7)) * 1e-7
    c *= {"long": 1e6, "short": 1e-7, "huge": 1e200}.get(case, 1)
    if case == "outlier":
        c[5] *= 1e5
    ids = np.arange(len(c)) * 3
    for k in (1, 6):
        got = list(zip(*(x.tolist() for x in vectors.best(ids[:90], c[:90], ids, c, k, metric)), strict=True))
        with np.errstate(all="ignore"):
            near = vectors.similarities(c[:90], c, metric).round(9)
        want = [(q, j) for q, row in zip(ids[:90].tolist(), np.where(np.isnan(near), np.inf, near), strict=True) for j in sorted((j for j in ids.tolist() if j != q), key=lambda j: (-row[j // 3], j))[:k]]
        assert [x[:2] for x in got] == want


def test_products_of_a_corpus_are_in_single_precision():
    c = np.random.default_rng(7).normal(size=(500, 6))
    side = vectors.Side(np.arange(500), c, "l2")
    of, at = vectors._close(np.arange(40), c[:40], side, 4, vectors._slack(c[:40], side))
    assert len(of) == len(at) < 40 * 60
    assert vectors.Side(np.arange(2), np.array([[1.0, np.nan], [0.0, 1.0]]), "l2").single is None
