"""Importance resampling towards a target distribution over hashed word runs.

Every document is read once. While its words go by, a ring keeps the running zlib CRC states of the
last n starts: each is extended by a space and the word, the oldest falls out and the word starts a
new one. After every word the states are the CRCs of all runs of up to n words that end there, so no
run is ever put together as a string; their buckets go out with the document. Counts per bucket over
all documents and over the target give each bucket's gain, a document's weight is the mean gain of its
features, and the highest weights plus Gumbel noise by document id are drawn: a sample without
replacement in proportion to exp(weight / 1000).

Cases: null and empty texts have no words, no features and weight 0, and are never drawn; very long
texts are read a slice at a time, the ring goes on over the cuts; equal scores go to the smaller
doc_id, rows that agree in both are ranked next to each other; a null doc_id has the noise of an empty
id and comes after all others of its score; repeated rows count and are ranked each; an empty target
or an empty table is counted as zeros; extra columns of any name are ignored by resampling() and
kept by resample().
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heron.llm.columns import whole
from heron.operators.ranks import ranked
from heron.plans.session import cut, discard, table

#: The bytes of words (digits, lower-case letters and all of UTF-8 beyond ASCII), the noise's seed.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
SEED = "2024"
#: Bytes of a text whose words are held at a time.
SLICE = 1 << 20
BUCKETS, LEAST, PERCENT = 10_000, 20, 10


def slices(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, those of about SLICE bytes at a time."""
    at = 0
    while at < len(data):
        gap = GAP.search(data, at + SLICE)
        to = gap.end() if gap else len(data)
        yield WORD.findall(data, at, to)
        at = to


def runs(data: bytes, n: int) -> Iterator[tuple[int, list[int]]]:
    """For each slice, how many words it has and the CRCs of all runs of up to n words that end in it."""
    ring: list[int] = []
    for words in slices(data):
        out: list[int] = []
        for w in words:
            step = b" " + w
            ring = [crc32(w), *[crc32(step, state) for state in ring[: n - 1]]]
            out += ring
        yield len(words), out


def features(data: bytes, n: int, buckets: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Words, features, the buckets that the features meet and how many meet each."""
    n_words = n_features = 0
    total = None
    for words, states in runs(data.lower(), n):
        n_words, n_features = n_words + words, n_features + len(states)
        ids, counts = np.unique(np.array(states, np.uint32) % np.uint32(buckets), return_counts=True)
        if total is None:
            total = ids, counts
        else:
            ids, at = np.unique(np.concatenate([total[0], ids]), return_inverse=True)
            total = ids, np.bincount(at, np.concatenate([total[1], counts])).astype(np.int64)
    return (n_words, n_features, *(total or (np.zeros(0, np.uint32), np.zeros(0, np.int64))))


_LISTS = ("bucket", pa.list_(pa.int32())), ("count", pa.list_(pa.int64()))


def _scan(n: int, buckets: int, batches):
    for b in batches:
        found = [features(t or b"", n, buckets) for t in b.column("text").to_pylist()]
        ends = pa.array(np.cumsum([0, *(len(f[2]) for f in found)]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0), *(f[k] for f in found)]), kind.value_type, safe=False)) for k, (_, kind) in zip((2, 3), _LISTS, strict=True)]
        sums = [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([b.column("row"), *sums, *lists], ["row", "n_words", "n_features", "bucket", "count"])


def bucketed(docs: DataFrame, *without: str, n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """row (the columns of docs but some), n_words, n_features, and the buckets of the features with their counts; a narrow step."""
    if n < 1 or not 1 <= buckets < 1 << 31:
        raise ValueError("n and buckets must be at least 1")
    rows = docs.select(whole(docs, *without), F.col("text").cast("string").cast("binary").alias("text"))
    kinds = [(x, T.LongType()) for x in ("n_words", "n_features")] + [("bucket", T.ArrayType(T.IntegerType())), ("count", T.ArrayType(T.LongType()))]
    return rows.mapInArrow(partial(_scan, n, buckets), T.StructType([rows.schema["row"], *(T.StructField(*k) for k in kinds)]))


def _count(buckets: int, batches):
    total = np.zeros(buckets, np.int64)
    for b in batches:
        ids, counts = (b.column(k).flatten().to_numpy(zero_copy_only=False) for k in (0, 1))
        total += np.bincount(ids, counts, buckets).astype(np.int64)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "count"])


def histogram(rows: DataFrame, buckets: int) -> np.ndarray:
    """Features per bucket; each task sends at most one count a bucket, the driver gets as many."""
    counts = rows.select("bucket", "count").mapInArrow(partial(_count, buckets), "bucket long, count long")
    out = np.zeros(buckets, np.int64)
    for r in counts.groupBy("bucket").agg(F.sum("count").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of target share over source share) of each bucket, every bucket counted once more than it is met."""
    k, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + k) / ((a + 1.0) * (t + k)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weigh(gain: np.ndarray, batches):
    for b in batches:
        lists = b.column("bucket")
        total = np.concatenate([[0], np.cumsum(gain[lists.flatten().to_numpy()] * b.column("count").flatten().to_numpy())]).astype(np.int64)
        ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        n = b.column("n_features").to_numpy()
        weight = np.where(n > 0, (total[ends[1:]] - total[ends[:-1]]) // np.maximum(n, 1), 0)
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "n_words", "n_features")), pa.array(weight, pa.int64())], ["row", "n_words", "n_features", "weight"])


def _noise(id_):
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def judge(docs: DataFrame, target: DataFrame, *without: str, n: int = 1, buckets: int = BUCKETS, least: int = LEAST, percent: int = PERCENT) -> DataFrame:
    """row (the columns of docs but some), n_words, n_features, weight, score, and rank of the drawn: percent of the documents of at least `least` words."""
    rows = cut(bucketed(docs, *without, n=n, buckets=buckets), "resample-buckets")
    gain = gains(histogram(rows, buckets), histogram(bucketed(target.select("text"), "text", n=n, buckets=buckets), buckets))
    weighed = rows.mapInArrow(partial(_weigh, gain), T.StructType([*(rows.schema[c] for c in ("row", "n_words", "n_features")), T.StructField("weight", T.LongType())]))
    id_ = F.col("row.doc_id")
    # tie parts rows that agree in everything else, so that no range of the sort has to hold all of them.
    scored = cut(weighed.select("*", (F.col("weight") + _noise(id_)).alias("score"), F.monotonically_increasing_id().alias("tie")), "resample-scores")
    discard(rows)
    may = scored.filter(F.col("n_words") >= least).select("*", (-F.col("score")).alias("low"), id_.isNull().alias("unnamed"), id_.alias("id"))
    placed, total = ranked(may, "low", "unnamed", "id", "n_features", "tie")
    names = ["row", "n_words", "n_features", "weight", "score"]
    drawn = placed.select(*names, F.when(F.col("place") < percent * total // 100, F.col("place") + 1).alias("rank"))
    return drawn.unionByName(scored.filter(F.col("n_words") < least).select(*names, F.lit(None).cast("long").alias("rank")))


def resampling(docs: DataFrame, target: DataFrame, **how: int) -> DataFrame:
    """doc_id, n_features, weight, score, rank and n_words of every document."""
    return judge(docs.select("doc_id", "text"), target, "text", **how).select("row.doc_id", "n_features", "weight", "score", "rank", "n_words")


def resample(docs: DataFrame, target: DataFrame, **how: int) -> DataFrame:
    """The drawn rows of docs, with their own columns."""
    return judge(docs, target, **how).filter("rank IS NOT NULL").select("row.*")


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resampling(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) AS r(i))
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, text FROM documents
), words AS (
  SELECT r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM (SELECT r, text FROM docs UNION ALL SELECT -1, text FROM benchmark)
), bytes AS (
  SELECT w, list_transform(range(1, 2 * strlen(w), 2), lambda i: CAST('0x' || substr(hex(w), i, 2) AS BIGINT)) AS b FROM (SELECT DISTINCT w FROM words)
), hashed AS (
  SELECT w, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM bytes, crc_table
), features AS (
  SELECT r, bucket FROM words JOIN hashed USING (w)
), totals AS (
  SELECT count(*) FILTER (r > 0) AS s, count(*) FILTER (r < 0) AS t FROM features
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((count(*) FILTER (r < 0) + 1.0::DOUBLE) * (s + 10000.0::DOUBLE) / ((count(*) FILTER (r > 0) + 1.0::DOUBLE) * (t + 10000.0::DOUBLE)))) AS BIGINT) AS gain
  FROM features, totals GROUP BY bucket, s, t
), sums AS (
  SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS g FROM features JOIN gains USING (bucket) WHERE r > 0 GROUP BY r
), weights AS (
  SELECT r, doc_id, coalesce(n, 0) AS n, CASE WHEN n > 0 THEN (g - ((g % n) + n) % n) // n ELSE 0 END AS weight FROM docs LEFT JOIN sums USING (r)
), scores AS (
  SELECT r, doc_id, n, weight, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM weights
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id NULLS LAST, n) AS k, count(*) FILTER (n >= 20) OVER () AS total FROM scores
)
SELECT doc_id, n AS n_features, weight, score, CASE WHEN n >= 20 AND k <= 10 * total // 100 THEN k END AS rank, n AS n_words FROM ranked
"""
