"""Resampling and paired tests over contingency cells.

A resample of rows depends only on how many rows each cell gets, so a replicate is one multinomial
draw over the cells; replicates are dealt out over tasks and each has its own seed.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = ["accuracy", "precision", "recall", "f1"]


def metrics(tp: np.ndarray, tn: np.ndarray, fp: np.ndarray, fn: np.ndarray) -> np.ndarray:
    """Rows of NAMES for arrays of counts, 0 where a denominator is."""
    def ratio(a, b):
        return np.where(b > 0, a / np.maximum(b, 1e-300), 0.0)

    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return np.stack([ratio(tp + tn, tp + tn + fp + fn), p, r, ratio(2 * p * r, p + r)], -1)


def cells(df: DataFrame, *columns: str) -> dict[tuple[int, ...], int]:
    """How often each combination of the 0/1 columns occurs: at most 2 ** len(columns) values."""
    ok = df.filter(" AND ".join(f"{c} IN (0, 1)" for c in columns))
    return {tuple(int(r[c]) for c in columns): r["count"] for r in ok.groupBy(*columns).count().collect()}


def replicate(spark: SparkSession, n: int, seed: int, draw: Callable[[np.random.Generator], np.ndarray], names: list[str]) -> DataFrame:
    """(replicate, metric, value): n seeded draws, each a row of values in the order of names."""

    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            values = [draw(np.random.default_rng([seed, i])) for i in ids]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i in ids for _ in names], pa.int64()), pa.array([m for _ in ids for m in names]), pa.array([float(x) for v in values for x in v], pa.float64())],
                ["replicate", "metric", "value"],
            )

    return spark.range(n).mapInArrow(run, "replicate long, metric string, value double")


def bootstrap(spark: SparkSession, counts: dict[tuple[int, ...], int], n: int = 1000, seed: int = 42) -> DataFrame:
    """Mean and 95 % interval of each metric over resamples of (label, pred) cells."""
    keys = [(1, 1), (0, 0), (0, 1), (1, 0)]
    c = np.array([counts.get(k, 0) for k in keys], float)
    total = int(c.sum())
    if not total:
        return spark.createDataFrame([], "metric string, mean double, low double, high double")
    share = c / total
    rows = replicate(spark, n, seed, lambda rng: metrics(*rng.multinomial(total, share)[:, None].astype(float))[0], NAMES)
    return rows.groupBy("metric").agg(F.avg("value").alias("mean"), F.percentile("value", F.lit(0.025)).alias("low"), F.percentile("value", F.lit(0.975)).alias("high"))


def _paired(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Metrics of a and of b from counts in the order of (label, a, b) as binary digits."""
    y, a, b = ((np.arange(8) >> s) & 1 for s in (2, 1, 0))

    def of(p):
        return metrics(*(np.array([c[(y == u) & (p == v)].sum()], float) for u, v in ((1, 1), (0, 0), (0, 1), (1, 0))))[0]

    return of(a), of(b)


def paired_bootstrap(spark: SparkSession, counts: dict[tuple[int, ...], int], n: int = 10_000, seed: int = 42) -> DataFrame:
    """b minus a for each metric: observed, interval and p = 2 min(P(<= 0), P(>= 0)), which can exceed 1."""
    c = np.array([counts.get(((i >> 2) & 1, (i >> 1) & 1, i & 1), 0) for i in range(8)], float)
    total = int(c.sum())
    share = c / max(1, total)

    def draw(rng):
        x, y = _paired(rng.multinomial(total, share).astype(float))
        return y - x

    x, y = _paired(c)
    seen = spark.createDataFrame(list(zip(NAMES, (y - x).tolist(), strict=True)), "metric string, observed double")
    rows = replicate(spark, n, seed, draw, NAMES).groupBy("metric").agg(
        F.avg("value").alias("mean"), F.percentile("value", F.lit(0.025)).alias("low"), F.percentile("value", F.lit(0.975)).alias("high"),
        (2 * F.least(F.avg((F.col("value") <= 0).cast("double")), F.avg((F.col("value") >= 0).cast("double")))).alias("p"),
    )
    return seen.join(F.broadcast(rows), "metric")


def _halves(n: int, widths: float = 40.0) -> tuple[np.ndarray, np.ndarray]:
    """Outcomes of n fair coins and their probabilities, but for those that lie over 40 standard deviations off, which no float tells from 0."""
    wide = int(widths * math.sqrt(n) / 2) + 2
    k = np.arange(max(0, n // 2 - wide), min(n, n // 2 + wide) + 1)
    steps = np.log((n - k[1:] + 1) / k[1:]) if len(k) > 1 else np.zeros(0)
    log = np.concatenate([[0.0], np.cumsum(steps)])
    p = np.exp(log - log.max())
    return k, p / p.sum()


def permutation_exact(spark: SparkSession, counts: dict[tuple[int, ...], int]) -> DataFrame:
    """P(|difference| >= |observed|) over all ways to swap rows' predictions, exactly.

    Only rows whose two predictions differ count. Of those with one label, the number that end with a
    right prediction for a is binomial, and both labels' numbers are independent. A metric's difference
    never falls as more rows of label 0 go wrong for a, so for each number of label 1 the two tails of
    label 0 are found by bisection: the work grows with the root of the rows, not with their square.
    """
    c = {k: int(counts.get(k, 0)) for k in ((y, a, b) for y in (0, 1) for a in (0, 1) for b in (0, 1))}
    x, y = _paired(np.array([c[i >> 2 & 1, i >> 1 & 1, i & 1] for i in range(8)], float))
    observed = y - x
    n1, n0 = c[1, 0, 1] + c[1, 1, 0], c[0, 0, 1] + c[0, 1, 0]
    (right, p1), (wrong, p0) = _halves(n1), _halves(n0)
    below = np.concatenate([[0.0], np.cumsum(p0)])

    def difference(k1: np.ndarray, k0: np.ndarray) -> np.ndarray:
        def one(tp, fp):
            return metrics(*(v.astype(float) for v in (tp, c[0, 0, 0] + n0 + c[0, 1, 1] - fp, fp, c[1, 0, 0] + n1 + c[1, 1, 1] - tp)))

        return one(c[1, 1, 1] + n1 - k1, c[0, 1, 1] + n0 - k0) - one(c[1, 1, 1] + k1, c[0, 1, 1] + k0)

    def first(m: int, least: float) -> np.ndarray:
        """For each number of label 1, the place of the first number of label 0 whose difference is at least that."""
        low, high = np.zeros(len(right), np.int64), np.full(len(right), len(wrong), np.int64)
        while (low < high).any():
            mid = (low + high) // 2
            up = difference(right, wrong[np.minimum(mid, len(wrong) - 1)])[:, m] >= least
            low, high = np.where(~up & (low < high), mid + 1, low), np.where(up & (low < high), mid, high)
        return low

    found = []
    for m, name in enumerate(NAMES):
        seen = abs(float(observed[m]))
        if seen <= 1e-12:
            p = 1.0
        else:
            # From here up, and what lies below the first difference that is over the lower end.
            p = float((p1 * (1 - below[first(m, seen - 1e-12)] + below[first(m, -seen + 1e-12 + 1e-15)])).sum())
        found.append((name, float(observed[m]), min(1.0, p)))
    return spark.createDataFrame(found, "metric string, observed double, p double")


def permutation(spark: SparkSession, counts: dict[tuple[int, ...], int], n: int = 10_000, seed: int = 42) -> DataFrame:
    """P(|difference| >= |observed|) when each row's two predictions are swapped at random."""
    c = np.array([counts.get(((i >> 2) & 1, (i >> 1) & 1, i & 1), 0) for i in range(8)], np.int64)
    x, y = _paired(c.astype(float))
    observed = y - x

    def draw(rng):
        swapped = c.copy()
        for base in (0, 4):
            k, m = rng.binomial(c[base + 1], 0.5), rng.binomial(c[base + 2], 0.5)
            swapped[base + 1] += m - k
            swapped[base + 2] += k - m
        p, q = _paired(swapped.astype(float))
        return (np.abs(q - p) >= np.abs(observed) - 1e-12).astype(float)

    rows = replicate(spark, n, seed, draw, NAMES).groupBy("metric").agg(F.avg("value").alias("p"))
    return spark.createDataFrame(list(zip(NAMES, observed.tolist(), strict=True)), "metric string, observed double").join(F.broadcast(rows), "metric")


def mcnemar(n01: int, n10: int) -> tuple[float, float]:
    """The corrected statistic and its p by chi-squared with one degree of freedom; (0, 1) without discordant rows."""
    if n01 + n10 == 0:
        return 0.0, 1.0
    x = (abs(n01 - n10) - 1) ** 2 / (n01 + n10)
    return x, math.erfc(math.sqrt(x / 2))


def wilcoxon(better: int, worse: int) -> tuple[float, float]:
    """Signed ranks of differences that are all of size one: closed form; (0, 1) without any."""
    n = better + worse
    if n == 0:
        return 0.0, 1.0
    low = min(better, worse)
    z = (2 * low - n) / math.sqrt(n)
    return low * (n + 1) / 2, min(1.0, math.erfc(abs(z) / math.sqrt(2)))
