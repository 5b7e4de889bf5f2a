"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard stands at NODES places of a ring of hashes, and a row belongs to the next node clockwise
from the hash of its doc_id. No shard takes more rows than its bound: with the slack 0 that of `rows`,
so that counts differ by one at most. A row that finds its shard full goes on clockwise to the next node
whose shard has room. Rows never meet one by one: how many rows each arc of the ring holds (NODES * shards
counters, whatever the input) decides how many of them stay and where the others go, and a row finds its
shard and its slot there by its place in the order of the ring, which a range sort gives.

Equal texts are not kept together: a group of copies may be larger than a shard, and its rows are dealt
out by their ids as all others are.

Cases: a null text has no bytes, so size 16 and the CRC of nothing; a null doc_id has the hash of an
empty id; rows of one doc_id stand at one place of the ring and overflow from there, however many they
are; repeated rows are rows of their own; a table with fewer rows than shards leaves some empty; an empty
table gives no rows; very long texts weigh one row like any other; extra columns of any name are ignored
by sharding() and kept by sharded().
"""

from __future__ import annotations

import hashlib
from collections import deque
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heron.llm.columns import whole
from heron.operators.ranks import ranked
from heron.plans.session import cut, discard, table

SHARDS, NODES = 40, 512
#: Fixed value: what a row weighs besides its text.
ROW_BYTES = 16
#: Hexadecimal digits of a hash that make a place on the ring.
DIGITS = 15


def nodes(shards: int, per_shard: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of all virtual nodes in ring order, and whose they are; a shard's places do not depend on the others."""
    at = sorted((int(hashlib.sha256(f"shard {s} node {v}".encode()).hexdigest()[:DIGITS], 16), s) for s in range(shards) for v in range(per_shard))
    return np.array([p for p, _ in at], np.int64), np.array([s for _, s in at], np.int64)


def place(id_):
    """Where a doc_id stands on the ring."""
    return F.conv(F.substring(F.sha2(F.coalesce(id_.cast("string"), F.lit("")), 256), 1, DIGITS), 16, 10).cast("long")


def arc(places: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The node next clockwise from each place; beyond the last one the ring begins again, which is arc len(places)."""
    return np.searchsorted(places, at)


def bounds(total: int, shards: int, slack: float) -> list[int]:
    """Rows that each shard may take: with no slack just as many as there are, one more in the first shards."""
    if slack <= 0:
        return [total // shards + (s < total % shards) for s in range(shards)]
    return [-(-int(total * (1 + slack)) // shards)] * shards


def pieces(counts: list[int], owner: list[int], shards: int, slack: float = 0.0) -> list[tuple[int, int, int]]:
    """Where the rows go, in ring order: (rows, shard, first slot).

    counts has the rows of each arc and of the stretch beyond the last node, which belongs to the first.
    First every arc fills its own shard, those nearest the ring's start before others; what is left goes on
    clockwise, in the order in which it set out, into the room that is left at each node.
    """
    n = len(owner)
    room = bounds(sum(counts), shards, slack)
    used = [0] * shards
    home = [*owner, owner[0]]
    out: list[list[tuple[int, int]]] = [[] for _ in home]

    def put(a, s, k):
        out[a].append((s, k))
        room[s] -= k

    left = []
    for a, c in enumerate(counts):
        k = min(c, room[home[a]])
        if k:
            put(a, home[a], k)
        left.append(c - k)
    waiting: deque[list[int]] = deque()
    # The first turn gathers what set out on the way, the second takes it past the ring's start.
    for turn in range(2):
        for a in range(n):
            s = owner[a]
            while waiting and room[s]:
                k = min(waiting[0][1], room[s])
                put(waiting[0][0], s, k)
                waiting[0][1] -= k
                if not waiting[0][1]:
                    waiting.popleft()
            if turn == 0 and left[a]:
                waiting.append([a, left[a]])
        if turn == 0 and left[n]:
            waiting.append([n, left[n]])
    found = []
    for parts in out:
        for s, k in parts:
            found.append((k, s, used[s]))
            used[s] += k
    return found


def _arcs(places: np.ndarray, batches):
    total = np.zeros(len(places) + 1, np.int64)
    for b in batches:
        total += np.bincount(arc(places, b.column(0).to_numpy()), minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["arc", "n"])


def _deal(begins: np.ndarray, shard: np.ndarray, slot: np.ndarray, batches):
    for b in batches:
        at = b.column("place").to_numpy()
        k = np.searchsorted(begins, at, "right") - 1
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("key"), pa.array(shard[k], pa.int32()), pa.array(slot[k] + at - begins[k], pa.int64())], ["row", "key", "shard", "slot"])


def assign(docs: DataFrame, *without: str, shards: int = SHARDS, per_shard: int = NODES, slack: float = 0.0) -> DataFrame:
    """row (the columns of docs but some), key (doc_id, size and text_crc32), shard and slot of each row."""
    if shards < 1 or per_shard < 1:
        raise ValueError("shards and per_shard must be at least 1")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.struct(F.col("doc_id"), (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32")).alias("key")
    # tie parts rows that agree in all else, so that no range of the sort has to hold all of them.
    rows = cut(docs.select(whole(docs, *without), key, place(F.col("doc_id")).alias("at"), F.monotonically_increasing_id().alias("tie")), "shards-keys")
    places, owner = nodes(shards, per_shard)
    counts = [0] * (len(places) + 1)
    for r in rows.select("at").mapInArrow(partial(_arcs, places), "arc long, n long").groupBy("arc").agg(F.sum("n").alias("n")).collect():
        counts[r["arc"]] = r["n"]
    found = pieces(counts, owner.tolist(), shards, slack)
    size, shard, slot = (np.array([f[k] for f in found], np.int64) for k in range(3))
    begins = np.cumsum(size) - size
    order = rows.select("*", F.col("key.doc_id").alias("id"), F.col("key.size").alias("size"), F.col("key.text_crc32").alias("crc"))
    placed, total = ranked(order, "at", "id", "size", "crc", "tie")
    discard(rows)
    kinds = [placed.schema["row"], placed.schema["key"], T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())]
    return placed.select("row", "key", "place").mapInArrow(partial(_deal, begins, shard, slot), T.StructType(kinds))


def sharding(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row."""
    dealt = assign(docs.select("doc_id", "text"), "text", **how)
    return dealt.select("key.*", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharded(docs: DataFrame, path: str, rows_per_file: int = 1_000_000, **how) -> None:
    """Write the rows of docs, with their own columns, as Parquet under path/shard=N, each shard by slot in files of so many rows."""
    if "shard" in {c.lower() for c in docs.columns}:
        raise ValueError("docs has a column named shard, which names the folders")
    dealt = assign(docs, **how).select("row.*", "shard", F.struct("slot").alias("__at"))
    file = F.floor(F.col("__at.slot") / rows_per_file)
    dealt.repartition("shard", file).sortWithinPartitions("shard", "__at.slot").drop("__at").write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)


def op13_sharding(spark, sf_dir: str) -> DataFrame:
    return sharding(table(spark, sf_dir, "documents"))
