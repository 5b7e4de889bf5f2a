"""Removal of repeated 100-byte strings, exactly, by suffix arrays built by grouping.

suffix_array() is the linear grouping construction: suffixes are grouped by first byte; groups are
taken in descending order, and the previous-smaller pointers of a group's suffixes say which lower
suffixes continue with it, and how often, and so split off of their groups; then one pass from the
smallest suffix on emits each group's order, following the same pointers, without recursion.

A corpus does not fit one suffix array, so Spark deals out only what can repeat. Each window of 100
bytes is named by its smallest hashed K-gram (its minimiser); windows in a row with one minimiser
are a unit. Equal windows have equal minimisers, so only units whose minimiser occurs twice matter:
- units with equal content, told by 128 bits of two unlike hashes (one of the bytes, one of their
  mixed K-grams) beside the minimiser's, are decided as a whole: all but the first are repeated;
- units with the same minimiser and other content (the edges of repeated passages) come together,
  one unit for each content, and the suffix array of their texts puts equal windows side by side.
  A minimiser with more than GROUP contents is dealt out by the windows' digests instead.

Cases: a null or empty text has no bytes and the digest of no bytes; texts under 100 bytes are left
whole; ties do not arise, as (doc_id, start) orders all strings; rows that repeat a doc_id are one
document (its first text counts as the source) and get the same ranges removed, clipped to their
length; rows without doc_id are left whole; an empty table gives no rows; extra columns of any name
are ignored by suffix_dedup() and kept by drop_repeated_strings().
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heron.llm.columns import whole
from heron.llm.rolling import mix, prefix, ranges
from heron.plans.session import cut, discard, free, table

LENGTH = 100
K = 24
#: Texts of one minimiser that one suffix array takes.
GROUP = 4096
#: Bytes hashed at a time.
BLOCK = 1 << 20
_POSITION = np.uint64((1 << 30) - 1)


def suffix_array(text: bytes) -> list[int]:
    """The starts of text's suffixes in lexicographic order."""
    n = len(text) + 1
    s = [c + 1 for c in text] + [0]
    # order holds the suffixes by group; a group is a range of order, named by its start.
    order = sorted(range(n), key=s.__getitem__)
    place = [0] * n
    group = [0] * n
    last: dict[int, int] = {}
    start = 0
    for i, x in enumerate(order):
        if s[x] != s[order[start]]:
            start = i
        place[x], group[x], last[start] = i, start, i
    before = [-1] * n
    end = n - 1
    while end >= 0:
        start = group[order[end]]
        members = order[start : end + 1]
        times: dict[int, int] = {}
        members.sort()
        for x in members:
            p = x - 1
            while p >= 0 and group[p] > start:
                p = before[p]
            if p >= 0 and group[p] == start:
                p = before[p]
            before[x] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if times:
            by_times: dict[int, list[int]] = {}
            for p, k in times.items():
                by_times.setdefault(k, []).append(p)
            for k in sorted(by_times, reverse=True):
                moved: dict[int, int] = {}
                for p in by_times[k]:
                    g = group[p]
                    to = last[g] - moved.get(g, 0)
                    other = order[to]
                    i = place[p]
                    order[i], order[to] = other, p
                    place[other], place[p] = i, to
                    moved[g] = moved.get(g, 0) + 1
                for g, count in moved.items():
                    top = last[g]
                    new = top - count + 1
                    if new != g:
                        for i in range(new, top + 1):
                            group[order[i]] = new
                        last[g], last[new] = new - 1, top
        end = start - 1
    out = [0] * n
    free_at = {g: g for g in last}
    done = [False] * n
    out[0] = n - 1
    done[n - 1] = True
    for i in range(n):
        p = out[i] - 1
        while p >= 0 and not done[p]:
            g = group[p]
            out[free_at[g]] = p
            free_at[g] += 1
            done[p] = True
            p = before[p]
    return out[1:]


def reach(parts: list[bytes]) -> list[int]:
    """For each string, the longest prefix that it shares with another one; neighbours in order share most."""
    order, out = sorted(range(len(parts)), key=parts.__getitem__), [0] * len(parts)
    for i, j in zip(order, order[1:], strict=False):
        a, b = parts[i], parts[j]
        low, high = 0, min(len(a), len(b))
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
        out[i], out[j] = max(out[i], low), max(out[j], low)
    return out


def related(contexts: list[tuple[int, int, bytes, int]], length: int, k: int) -> list[tuple[int, int, bytes]]:
    """The parts of the contexts that can hold a common window, as (doc, start, bytes).

    A common window reaches to either side of the minimiser no further than the context agrees with
    some other one there; contexts that are left with less than a window have none in common.
    """
    before = reach([c[:at][::-1] for _, _, c, at in contexts])
    after = reach([c[at + k :] for _, _, c, at in contexts])
    return [
        (doc, start + at - left, c[at - left : at + k + right])
        for (doc, start, c, at), left, right in zip(contexts, before, after, strict=True) if left + k + right >= length
    ]


def repeated_windows(contexts: list[tuple[int, int, bytes]], length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(doc, start, end) covered by windows of the contexts (doc, start, bytes) that an earlier window equals."""
    contexts = sorted(contexts)
    text = b"\0".join(c for _, _, c in contexts)
    owner: list[int] = []
    firsts: list[int] = []
    at = 0
    for k, (_, _, c) in enumerate(contexts):
        owner += [k if i + length <= len(c) else -1 for i in range(len(c))] + [-1]
        firsts.append(at)
        at += len(c) + 1
    flagged: dict[int, list[int]] = {}
    same: list[int] = []
    shown = b""

    def settle() -> None:
        if len(same) > 1:
            # Contexts are in the order of (doc, start), and positions within one ascend.
            at = sorted((contexts[owner[i]][0], contexts[owner[i]][1] + i - firsts[owner[i]]) for i in same)
            for doc, start in at[1:]:
                if (doc, start) != at[0]:
                    flagged.setdefault(doc, []).append(start)

    for i in suffix_array(text):
        if owner[i] < 0:
            continue
        window = text[i : i + length]
        if window == shown:
            same.append(i)
        else:
            settle()
            same, shown = [i], window
    settle()
    out = []
    for doc, starts in flagged.items():
        starts = sorted(set(starts))
        begin = end = starts[0]
        for x in starts[1:]:
            if x > end + length:
                out.append((doc, begin, end + length))
                begin = x
            end = x
        out.append((doc, begin, end + length))
    return out


#: No units: what _minimisers() gives of texts that are all too short.
_NONE = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.uint64, np.int64))


def _minimisers(data: np.ndarray, ends: np.ndarray, length: int, k: int, named: bool = True):
    """Units of the texts that lie end to end in data: (start of the first window, windows, minimiser, two hashes of the unit if named, place of the minimiser)."""
    n = len(data) - k + 1
    if n < 1 or len(data) < length:
        return _NONE
    sums = prefix(data)
    at = np.arange(n, dtype=np.int64)
    grams = ranges(sums, at, at + k)
    low = (grams & ~_POSITION) | at.astype(np.uint64)
    # The smallest of each run of length - k + 1 grams, by doubling.
    run, want = 1, length - k + 1
    while run * 2 <= want:
        low = np.minimum(low[: len(low) - run], low[run:])
        run *= 2
    if run < want:
        low = np.minimum(low[: len(low) - (want - run)], low[want - run :])
    begins = np.concatenate([[0], ends[:-1]])
    windows = np.maximum(ends - begins - length + 1, 0)
    if not windows.sum():
        return _NONE
    p = np.repeat(begins - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows) + np.arange(windows.sum())
    q = (low[p] & _POSITION).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (p[1:] != p[:-1] + 1)])
    first, count = p[new], np.diff(np.r_[new, len(p)])
    q = q[new]
    if not named:
        return first, count, grams[q], _NONE[3], _NONE[4], q - first
    content = ranges(sums, first, first + count + length - 1)
    # Sums over bytes are linear; sums over mixed grams are not, so the two hashes fail on unlike texts.
    other = ranges(prefix(mix(grams ^ np.uint64(0xD6E8FEB86659FD93))), first, first + count + length - k)
    return first, count, grams[q], mix(content + (q - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), other, q - first


def _blocks(batch):
    """Texts of a batch laid end to end, about BLOCK bytes at a time: (ids, data, ends)."""
    ids, size, texts = [], 0, []
    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        if doc is None or not text:
            continue
        ids.append(doc)
        texts.append(text.encode())
        size += len(texts[-1])
        if size >= BLOCK:
            yield ids, np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
            ids, size, texts = [], 0, []
    if ids:
        yield ids, np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])


def _hashes(length: int, k: int):
    def run(batches):
        for b in batches:
            found = [_minimisers(data, ends, length, k, named=False)[2] for _, data, ends in _blocks(b)]
            h, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int64))], ["h", "n"])

    return run


def _units(length: int, k: int):
    def run(batches):
        for b in batches:
            for ids, data, ends in _blocks(b):
                first, count, h, d, e, anchor = _minimisers(data, ends, length, k)
                at = np.searchsorted(ends, first, "right")
                begins = np.concatenate([[0], ends[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x.view(np.int64)) for x in (h, d, e)), pa.array(np.array(ids, np.int64)[at]), pa.array(((first - begins[at]) << 16) | (anchor << 8) | count)],
                    ["h", "d", "e", "doc", "at"],
                )

    return run


def _contexts(length: int):
    def run(batches):
        for b in batches:
            out = []
            for doc, text, units in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                data = (text or "").encode()
                for u in units:
                    start = u["at"] >> 16
                    out.append((u["h"], u["nd"], doc, start, data[start : start + (u["at"] & 255) + length - 1], u["at"] >> 8 & 255))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["h", "nd", "doc", "start", "bytes", "anchor"])

    return run


def _resolve(length: int, k: int):
    def settle(contexts):
        some = related(contexts, length, k) if len(contexts) > 1 else []
        return repeated_windows(some, length) if len(some) > 1 else []

    def rows(found):
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], ["doc", "start", "end"])

    def run(batches):
        now, contexts = None, []
        for b in batches:
            out = []
            for h, *context in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if h != now:
                    out += settle(contexts)
                    now, contexts = h, []
                contexts.append(tuple(context))
            yield rows(out)
        yield rows(settle(contexts))

    return run


def _windows(length: int):
    def run(batches):
        for b in batches:
            out = []
            for doc, start, data in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                out += [(hashlib.blake2b(data[i : i + length], digest_size=16).digest(), doc, start + i) for i in range(len(data) - length + 1)]
            kinds = (pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["w", "doc", "start"])

    return run


def repeated_ranges(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """(doc, start, end): byte ranges of docs (doc_id, text) whose union is what an earlier string of length bytes covers."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text")
    twice = cut(
        texts.mapInArrow(_hashes(length, k), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h"), "minimisers"
    )
    free(spark)
    units = texts.mapInArrow(_units(length, k), "h long, d long, e long, doc long, at long")
    units = cut(units.join(twice.hint("shuffle_hash"), "h"), "units")
    discard(twice)
    firsts = units.groupBy("h", "d", "e").agg(F.min(F.struct("doc", "at")).alias("first"), F.count("*").alias("n"))
    firsts = cut(firsts, "firsts")
    again = firsts.filter("n > 1").select("h", "d", "e", "first")
    start = F.shiftright("at", 16)
    whole = units.join(again, ["h", "d", "e"]).filter((F.col("doc") != F.col("first.doc")) | (F.col("at") != F.col("first.at")))
    whole = whole.select("doc", start.alias("start"), (start + F.col("at").bitwiseAND(255) + (length - 1)).alias("end"))
    whole = cut(whole, "whole")
    discard(units)
    # Written, so that both sides of the join are plain exchanges, whose hot minimisers Spark can split.
    several = cut(firsts.groupBy("h").agg(F.count("*").alias("nd")).filter("nd > 1"), "several")
    edges = firsts.join(several, "h").select(F.col("first.doc").alias("doc"), F.struct("h", "nd", "first.at").alias("u"))
    listed = edges.groupBy("doc").agg(F.collect_list("u").alias("units"))
    held = texts.join(listed, F.col("doc_id") == F.col("doc")).select("doc", "text", "units")
    contexts = cut(held.mapInArrow(_contexts(length), "h long, nd long, doc long, start long, bytes binary, anchor int"), "contexts")
    discard(firsts, several)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    few = contexts.filter(F.col("nd") <= GROUP).select("h", "doc", "start", "bytes", "anchor").repartition(parts, "h").sortWithinPartitions("h")
    by_array = few.mapInArrow(_resolve(length, k), "doc long, start long, end long")
    rows = contexts.filter(F.col("nd") > GROUP).select("doc", "start", "bytes").mapInArrow(_windows(length), "w binary, doc long, start long")
    origin = rows.groupBy("w").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    by_digest = rows.join(origin, "w").filter((F.col("doc") != F.col("first.doc")) | (F.col("start") != F.col("first.start")))
    by_digest = by_digest.select("doc", "start", (F.col("start") + length).alias("end"))
    return whole.unionByName(by_array).unionByName(by_digest)


def _removed(data: bytes, found: list[dict]) -> tuple[bytes, int, int]:
    """What is left of data, how many bytes went and in how many runs."""
    out, at, gone, runs, end = [], 0, 0, 0, -1
    for r in sorted((min(x["start"], len(data)), min(x["end"], len(data))) for x in found):
        if r[1] <= max(end, r[0]):
            continue
        if r[0] > end:
            runs += 1
        begin = max(r[0], end)
        out.append(data[at:begin])
        gone += r[1] - begin
        at = end = r[1]
    out.append(data[at:])
    return b"".join(out), gone, runs


_APPLIED = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def _apply(with_text: bool):
    def run(batches):
        for b in batches:
            rows = []
            for text, found in zip(b.column("text").to_pylist(), b.column("ranges").to_pylist(), strict=True):
                data = (text or "").encode()
                left, gone, runs = _removed(data, found or [])
                # A cut may fall inside a character; what is left of it is no text.
                kept = (text if not gone else left.decode("utf-8", "ignore")) if with_text else None
                rows.append((len(data), gone, runs, hashlib.sha256(left).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("row"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], ["row", *_APPLIED])

    return run


def remove_ranges(docs: DataFrame, found: DataFrame, with_text: bool = True) -> DataFrame:
    """row (the columns of docs but text), n_bytes, n_removed, n_spans, kept_sha256 and kept (the text left, if asked for)."""
    by_doc = found.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    rows = docs.select(whole(docs, "text"), F.col("text").cast("string").alias("text")).join(by_doc, F.col("row.doc_id") == F.col("doc"), "left").drop("doc")
    extra = [T.StructField(n, T.LongType() if n.startswith("n_") else T.StringType()) for n in _APPLIED]
    return rows.mapInArrow(_apply(with_text), T.StructType([rows.schema["row"], *extra]))


def _digests(docs: DataFrame, found: DataFrame) -> DataFrame:
    return remove_ranges(docs, found, with_text=False).select("row.doc_id", *_APPLIED[:-1])


def with_kept(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with the ranges taken out of text, and n_chars (if there) as of the text left."""
    now = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        now["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return remove_ranges(docs, found).select(*(now.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def _typed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of docs."""
    docs = _typed(docs)
    return _digests(docs, cut(repeated_ranges(docs, length), "ranges"))


def drop_repeated_strings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with repeated strings taken out of text, and n_chars (if there) as of the text left."""
    return with_kept(docs, cut(repeated_ranges(_typed(docs), length), "ranges"))


def op5_suffix_array(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))
