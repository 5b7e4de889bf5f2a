"""Substring deduplication by content-defined chunks.

A gear hash rolls over each text's bytes; a chunk ends where its top bits are zero, so chunk borders
follow the content and an insertion only shifts the chunks that it touches. Chunks are named by a
digest; every chunk but the first of its digest, by (doc_id, start), is repeated. Runs of repeated
chunks of at least RUN bytes are removed; shorter ones are common phrases and stay.

Cases: null and empty texts have no chunks; text without borders is cut every LARGEST bytes; rows
that repeat a doc_id are one document and get the same ranges removed, clipped to their length; rows
without doc_id are left whole; an empty table gives no rows; extra columns of any name are ignored by
chunk_dedup() and kept by drop_repeated_chunks().
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heron.llm.rolling import mix
from heron.llm.suffix import _digests, _typed, with_kept
from heron.plans.session import cut, free, table

SMALLEST, LARGEST, BITS = 32, 1024, 4
RUN = 100
#: One pseudo-random 32-bit number for each byte value.
GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash h = 2 h + GEAR[byte] at every byte, 32 bits wide, by doubling the window."""
    h, width = GEAR[data], 1
    while width < 32:
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint32(width)
        h, width = wider, width * 2
    return h


def borders(data: np.ndarray) -> list[int]:
    """The ends of data's chunks."""
    n = len(data)
    ends, last = [], 0
    for at in (np.flatnonzero(gear(data) < np.uint32(1 << (32 - BITS))) + 1).tolist() + [n]:
        while at - last > LARGEST:
            last += LARGEST
            ends.append(last)
        if at - last >= SMALLEST or at == n:
            if at > last:
                ends.append(at)
            last = at
    return ends


def _chunks(batches):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    for b in batches:
        out = []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if doc is None or not text:
                continue
            data, at = text.encode(), 0
            for end in borders(np.frombuffer(data, np.uint8)):
                out.append((doc, at, end, hashlib.blake2b(data[at:end], digest_size=16).digest()))
                at = end
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["doc", "start", "end", "digest"])


def _runs(least: int):
    """Repeated chunks in the order of (doc, start) to runs of at least that many bytes."""

    def run(batches):
        doc, start, end = None, 0, 0
        for b in batches:
            out = []
            for d, s, e in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                # A repeated document sends its chunks once for each of its rows.
                if d == doc and s <= end:
                    end = max(end, e)
                    continue
                if doc is not None and end - start >= least:
                    out.append((doc, start, end))
                doc, start, end = d, s, e
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], ["doc", "start", "end"])
        last = [(doc, start, end)] if doc is not None and end - start >= least else []
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in last], pa.int64()) for i in range(3)], ["doc", "start", "end"])

    return run


def repeated_chunks(docs: DataFrame, least: int = RUN) -> DataFrame:
    """(doc, start, end): runs of chunks that an earlier place holds."""
    spark = docs.sparkSession
    chunks = docs.select("doc_id", "text").mapInArrow(_chunks, "doc long, start long, end long, digest binary")
    # Partial minima keep the chunks of a large group of copies from one task.
    firsts = cut(chunks.groupBy("digest").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "chunks")
    free(spark)
    again = chunks.join(firsts.hint("merge"), "digest").filter((F.col("doc") != F.col("first.doc")) | (F.col("start") != F.col("first.start"))).select("doc", "start", "end")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return again.repartition(parts, "doc").sortWithinPartitions("doc", "start", "end").mapInArrow(_runs(least), "doc long, start long, end long")


def chunk_dedup(docs: DataFrame, least: int = RUN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of docs."""
    docs = _typed(docs)
    return _digests(docs, cut(repeated_chunks(docs, least), "ranges"))


def drop_repeated_chunks(docs: DataFrame, least: int = RUN) -> DataFrame:
    """docs with runs of repeated chunks taken out of text, and n_chars (if there) as of the text left."""
    return with_kept(docs, cut(repeated_chunks(_typed(docs), least), "ranges"))


def op4_chunk_dedup(spark, sf_dir: str) -> DataFrame:
    return chunk_dedup(table(spark, sf_dir, "documents"))
