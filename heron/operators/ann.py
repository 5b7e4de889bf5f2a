"""Approximate nearest neighbours, opt-in: an inverted-file index stored as Parquet, searched list by list.

The index has a coarse centroid for each list, fitted by k-means on a sample of at most SAMPLE rows; every
row of the corpus is stored in the list of its nearest centroid. A search reads the lists of the few
centroids nearest to each query. Exact search (heron.operators.vectors.nearest) stays the default.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heron.operators.vectors import cell_rows, ranked_neighbors, usable

#: Rows that centroids are fitted on at most, rounds of the fit, and files that a list is dealt out to.
SAMPLE, ROUNDS, FILES = 20_000, 12, 8


def fit(rows: DataFrame, lists: int, metric: str = "l2", sample: int = SAMPLE) -> np.ndarray:
    """At most as many centroids as lists, from the sample rows of the smallest hashes by id; vectors of another than the sample's commonest dimension are left to list 0."""
    got = usable(rows).select("v").orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    sizes = np.bincount([len(r["v"]) for r in got]) if got else np.zeros(1)
    x = np.array([r["v"] for r in got if len(r["v"]) == sizes.argmax()], np.float64).reshape(-1, max(1, int(sizes.argmax())))
    if metric == "cosine":
        x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
    c = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)].copy()
    for _ in range(ROUNDS if len(c) else 0):
        of = _closest(x, c, 1)[:, 0]
        for k in range(len(c)):
            if (of == k).any():
                c[k] = x[of == k].mean(0)
    return c


def _closest(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """For each row of x the places of its n nearest centroids."""
    far = (c * c).sum(1) - 2 * (x @ c.T)
    return np.argsort(far, axis=1, kind="stable")[:, :n]


def _lists(c: np.ndarray, n: int, metric: str, batches):
    """Rows (id, v) to (group, id, v), a row for each of the n nearest lists."""
    for b in batches:
        v = b.column(1)
        ends, flat = v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False)
        fits = np.flatnonzero(np.diff(ends) == c.shape[1])
        x = np.array([flat[ends[k] : ends[k + 1]] for k in fits], np.float64).reshape(-1, c.shape[1])
        if metric == "cosine":
            x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
        near = _closest(x, c, n) if len(c) else np.zeros((len(x), 1), int)
        odd = np.setdiff1d(np.arange(len(v)), fits)
        at = np.concatenate([np.repeat(fits, near.shape[1]), odd])
        group = np.concatenate([near.ravel(), np.zeros(len(odd), int)])
        yield pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), b.column(0).take(pa.array(at)), v.take(pa.array(at))], ["group", "id", "v"])


_DEALT = "group int, id long, v array<double>"


def build(corpus: DataFrame, path: str, lists: int = 64, metric: str = "l2", sample: int = SAMPLE) -> None:
    """Store the index of corpus (id, v) under path: its centroids, and every row in its list."""
    spark = corpus.sparkSession
    c = fit(corpus, lists, metric, sample)
    spark.createDataFrame([(k, metric, x.tolist()) for k, x in enumerate(c)], "list int, metric string, v array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    rows = usable(corpus).select(F.col("id").cast("long"), F.col("v").cast("array<double>")).mapInArrow(partial(_lists, c, 1, metric), _DEALT)
    # A list is written by several tasks, so that none has to hold a large one.
    dealt = rows.withColumnRenamed("group", "list").repartition("list", F.pmod(F.xxhash64("id"), F.lit(FILES)))
    dealt.sortWithinPartitions("list").write.partitionBy("list").parquet(f"{path}/lists")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 8, probes: int = 40) -> DataFrame:
    """(query_id, id, similarity, rank): the k most similar rows among the lists of the probes centroids nearest to each row of queries (id, v), itself left out."""
    centroids = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
    if not centroids:
        return spark.createDataFrame([], "query_id long, id long, similarity double, rank int")
    metric, c = centroids[0]["metric"], np.array([r["v"] for r in centroids], np.float64)
    asked = usable(queries).select(F.col("id").cast("long"), F.col("v").cast("array<double>")).mapInArrow(partial(_lists, c, min(probes, len(c)), metric), _DEALT)
    stored = spark.read.schema("id long, v array<double>, list int").parquet(f"{path}/lists").select(F.col("list").alias("group"), "id", "v")

    most, dims = stored.groupBy("group").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims")).agg(F.max("n"), F.max("dims")).first()
    # A long list is dealt into parts, so that no task has to hold it whole; its queries go to all of them.
    parts = max(1, -(-(most or 0) // cell_rows(dims or 1)))
    to = asked.select("group", "id", "v", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    of = stored.select("group", "id", "v", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"))
    to, of = (x.select((F.col("group") * parts + F.col("part")).alias("cell"), "id", "v") for x in (to, of))
    return ranked_neighbors(to, of, len(c) * parts, k, metric)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: how many of the exact neighbours (query_id, id) were found."""
    right = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return right.agg(F.count("*").alias("expected"), F.count("hit").alias("found"), (F.count("hit") / F.count("*")).alias("recall"))
