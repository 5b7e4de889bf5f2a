"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are sorted by length into buckets (blocks of at most BLOCK vectors). A query first meets the
bucket of the longest vectors, whose k-th best product is a lower bound of its final k-th best. For
every other bucket that bound gives a local cosine threshold, bound / (|q| * longest vector of the
bucket): over 1, the bucket is skipped for that query (length pruning); near 1, only vectors whose
coordinate along the query's largest one lies in the feasible interval are verified (coordinate
pruning); else all its products are computed. Buckets that no query can use are left out before
anything is sent to them. The others pass by the queries of a task, longest first, and what a query has
found there raises its bound (heron.llm.cells); only its k best leave the task.

Components are held as floor(1024 * x) / 1024 in 64-bit floats, which is exact for every finite x.
Products are floats where all of them stay under 2 ** 53; beyond, scaled floats with an error bound
choose the candidates, and Python integers of any size decide.

Cases: vectors that are null or hold null or non-finite components take no part, nor do rows without
vec_id, as a result could not name them; empty vectors have the product 0 with all others, and
unequal lengths count as padded with zeros; ties go to the smaller vec_id; repeated vec_ids are rows
of their own, each with a list of its own in which the others may stand; fewer than k candidates give
fewer rows; an empty table gives none; extra columns are ignored. Every finite size takes part: scores outside the
range of long are ranked by their exact values and shown as the end of that range.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heron.llm.cells import ROWS, TILE, Best, kth, lanes_of, meet, reached
from heron.plans.session import cut, table

BLOCK = 2048
QUERIES = 256
#: From this local cosine threshold on, coordinate pruning pays.
COORDINATE_FROM = 0.8
#: From this size on a 64-bit float times 1024 is a whole number; norms are kept 2 ** 64 times smaller, so that none overflows.
WHOLE, LESS = float(1 << 43), 64
#: What rounding below the normal range can add to a scaled product.
TINY = 2.0**-900
LOW, HIGH = -(1 << 63), (1 << 63) - 1
#: nodes has a number for each row of ids, as ids may be repeated.
_BLOCK = "block long, longest double, dim int, n int, kind int, ids binary, nodes binary, vectors binary"
_FOUND = "query long, query_id long, vec_id long, score long, beyond binary"


def whole_vectors(df: DataFrame) -> DataFrame:
    """vec_id, v (floor(1024 * x) / 1024 of each component) and norm (over 2 ** LESS) of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    takes_part = F.col("vec_id").isNotNull() & F.forall(x, lambda a: F.coalesce(~F.isnan(a) & (F.abs(a) < float("inf")), F.lit(False)))
    v = F.transform(x, lambda a: F.when(F.abs(a) < WHOLE, F.floor(a * 1024) / 1024.0).otherwise(a))
    rows = df.filter(takes_part).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.withColumn("most", F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0.0)))
    squares = F.aggregate("v", F.lit(0.0), lambda s, a: s + (a / F.col("most")) * (a / F.col("most")))
    return rows.select("vec_id", "v", F.when(F.col("most") > 0, F.col("most") * 2.0**-LESS * F.sqrt(squares)).otherwise(0.0).alias("norm"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    """The lists as rows, padded with zeros."""
    ends = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    dim = int(ends.max(initial=0))
    out = np.zeros((len(ends), dim))
    out[np.arange(dim) < ends[:, None]] = flat
    return out


def _block(key, held):
    """One block of the held rows (ids, nodes, vectors, norms)."""
    whole = np.zeros((sum(len(h[0]) for h in held), max(h[2].shape[1] for h in held)))
    at = 0
    for _, _, m, _ in held:
        whole[at : at + len(m), : m.shape[1]] = m
        at += len(m)
    ids, nodes, norms = (np.concatenate([h[i] for h in held]) for i in (0, 1, 3))
    kind, vectors = _packed(whole)
    row = (key, norms.max(), whole.shape[1], len(ids), kind, ids.tobytes(), nodes.tobytes(), vectors)
    kinds = (pa.int64(), pa.float64(), *[pa.int32()] * 3, *[pa.binary()] * 3)
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [x.split()[0] for x in _BLOCK.split(", ")])


def _packed(m: np.ndarray) -> tuple[int, bytes]:
    """The bytes of a number and the numbers: 1024 times the components in 2 or 4 bytes where they fit, else the components."""
    most = float(np.abs(m).max(initial=0.0)) * 1024
    for size, kind in ((2, np.int16), (4, np.int32)):
        if most < 1 << (8 * size - 1):
            return size, (m * 1024).astype(kind).tobytes()
    return 8, m.tobytes()


def _cut_up(limit: int, found):
    """Blocks of at most limit of the rows found, in the order they come."""
    part, k, n, held = TaskContext.get().partitionId(), 0, 0, []
    for ids, nodes, m, norms in found:
        at = 0
        while at < len(ids):
            to = min(len(ids), at + limit - n)
            held.append((ids[at:to], nodes[at:to], m[at:to], norms[at:to]))
            n, at = n + to - at, to
            if n == limit:
                yield _block((part << 32) + k, held)
                k, n, held = k + 1, 0, []
    if held:
        yield _block((part << 32) + k, held)


def _pack(batches):
    """Rows (vec_id, v, norm) to blocks; a row's node is its partition and its place there."""

    def found():
        place = TaskContext.get().partitionId() << 32
        for b in batches:
            yield b.column(0).to_numpy(), np.arange(place, place + b.num_rows), _matrix(b.column(1)), b.column(2).to_numpy()
            place += b.num_rows

    yield from _cut_up(BLOCK, found())


def _asked(every: int, batches):
    """The rows of blocks whose id is divisible by every, as blocks of queries."""

    def found():
        for b in batches:
            for r in b.to_pylist():
                ids, nodes, m = _open(r)
                on = np.flatnonzero(ids % every == 0)
                if len(on):
                    yield ids[on], nodes[on], m[on], np.zeros(len(on))

    yield from _cut_up(QUERIES, found())


def _open(r: dict, s: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, nodes = (np.frombuffer(r[f"{s}{x}"], np.int64) for x in ("ids", "nodes"))
    kind = {2: np.int16, 4: np.int32, 8: np.float64}[r[f"{s}kind"]]
    m = np.frombuffer(r[f"{s}vectors"], kind).reshape(len(ids), r[f"{s}dim"])
    return ids, nodes, m if kind is np.float64 else m / 1024.0


def exponents(m: np.ndarray) -> np.ndarray:
    """For each row, the least e with all its components under 2 ** e."""
    return np.frexp(np.abs(m).max(1, initial=0.0))[1].astype(np.int64)


def products(q: np.ndarray, c: np.ndarray, of_q: np.ndarray, of_c: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Products of the rows of q and c over 2 ** (of_q + of_c), their error bounds, and the exact integers where floats hold them all."""
    dim = min(q.shape[1], c.shape[1])
    q, c = q[:, :dim], c[:, :dim]
    most = float(np.abs(q).max(initial=0.0)) * float(np.abs(c).max(initial=0.0))
    if most * max(dim, 1) * 2**20 < 2**53:
        exact = (q * 1024) @ (c * 1024).T
        return np.ldexp(exact, -(of_q[:, None] + of_c + 20)), np.full(exact.shape, TINY), exact.astype(np.int64)
    q, c = np.ldexp(q, -of_q[:, None]), np.ldexp(c, -of_c)
    error = (dim + 4) * 2.0**-52 * np.outer(np.sqrt((q * q).sum(1)), np.sqrt((c * c).sum(1))) + TINY
    return q @ c.T, error, None


def integers(v: np.ndarray) -> list[int]:
    """1024 times the components, exactly."""
    return [int(x * 1024) if abs(x) < WHOLE else int(x) * 1024 for x in v.tolist()]


def shown(score: int) -> tuple[int, bytes]:
    """The score as a long, and bytes that order scores which that long does not tell apart."""
    if LOW <= score <= HIGH:
        return score, b"\x80"
    size = (score.bit_length() + 7) // 8
    data = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return (HIGH, b"\xff" + data) if score > 0 else (LOW, b"\x00" + bytes(255 - x for x in data))


def best(q: np.ndarray, c: np.ndarray, ids: np.ndarray, on: np.ndarray, row: tuple, k: int) -> list[tuple[int, int]]:
    """(-score, vec_id) of the query's k best among the candidates on, ties to smaller ids; row has its products, their error bounds and integers."""
    near, error, exact = row
    if len(on) > k:
        least = np.partition((near - error)[on], -k)[-k]
        on = on[(near + error)[on] >= least]
    if exact is not None:
        on = on[np.lexsort((ids[on], -exact[on]))[:k]]
        return list(zip((-exact[on]).tolist(), ids[on].tolist(), strict=True))
    mine = integers(q)
    return sorted((-sum(a * b for a, b in zip(mine, integers(c[x]), strict=False)), int(ids[x])) for x in on)[:k]


def _seed(k: int):
    """The bound of each query by the block of the longest vectors, and the least norm that any of them can still use."""

    def run(batches):
        for b in batches:
            rows = b.to_pylist()
            for r in rows:
                _, qn, q = _open(r)
                of_q, bound = exponents(q), np.full(len(qn), -np.inf)
                _, sn, s = _open(r, "s_")
                r["scale"] = int(np.frexp(r["s_longest"])[1]) + LESS
                near, error, _ = products(q, s, of_q, r["scale"])
                for j in range(len(qn)):
                    others = (near[j] - error[j])[sn != qn[j]]
                    if len(others) >= k:
                        bound[j] = np.partition(others, -k)[-k]
                long = np.sqrt((np.ldexp(q, -of_q[:, None]) ** 2).sum(1))
                # A query needs |candidate| >= bound / |q|; bounds of zero or less need nothing.
                needs = np.where(bound > TINY * 4, bound / np.maximum(long, 1e-300), 0.0)
                r["reach"] = float(needs.min(initial=np.inf)) * (1 - 1e-9)
                r["bounds"] = bound.tobytes()
            names = [x.split() for x in _SEEDED.split(", ")]
            kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[kind]) for n, kind in names], [n for n, _ in names])

    return run


_SEEDED = "block long, dim int, n int, kind int, scale int, reach double, ids binary, nodes binary, vectors binary, bounds binary"


class Queries:
    """Queries of one dimension: whole numbers in single or double precision as the products need, and the best so far."""

    def __init__(self, parts: list[tuple], k: int):
        self.ids, self.nodes, self.q, self.bounds, self.scale = *(np.concatenate([p[x] for p in parts]) for x in range(4)), parts[0][4]
        self.k, self.of, self.best = k, exponents(self.q), Best(len(self.q), k)
        with np.errstate(all="ignore"):
            # A score that the bound by the longest vectors asks for; the k best so far ask for more.
            self.asked = np.floor(np.ldexp(self.bounds, self.of + self.scale + 20))
            self.whole = self.q * 1024
            self.long = np.sqrt((self.whole * self.whole).sum(1))
        self.longest = self.long.max(initial=0.0)
        self.single = self.whole.astype(np.float32) if self.longest < 1 << 24 else None
        self.main = np.abs(self.whole).argmax(1) if self.q.shape[1] else np.zeros(len(self.q), int)
        self.beyond: dict[int, list[tuple[int, int]]] = {}

    def meet(self, c: "Passing") -> None:
        with np.errstate(all="ignore"):
            size = self.longest * c.longest
        if not size < 2**53:
            return self.large(c)
        least = np.maximum(self.asked, self.best.least())
        # Length pruning: the local cosine that a vector of this block needs at least.
        with np.errstate(all="ignore"):
            local = np.where(least > 0, least / np.maximum(self.long * c.longest, 1e-300), -1.0)
        fit = size < 1 << 24 and self.single is not None and c.single is not None
        full = np.flatnonzero(local < COORDINATE_FROM)
        step = max(1, TILE // max(1, len(c.ids)))
        for low in range(0, len(full), step):
            self.take(full[low : low + step], slice(None), c, fit, least)
        near = np.flatnonzero((local >= COORDINATE_FROM) & (local <= 1 + 1e-9))
        # Coordinate pruning: queries of one largest coordinate verify the vectors in any of their feasible intervals.
        near = near[np.argsort(self.main[near], kind="stable")]
        for some in np.split(near, np.flatnonzero(np.diff(self.main[near])) + 1) if len(near) else []:
            f = int(self.main[some[0]])
            on: slice | np.ndarray = slice(None)
            if f < c.whole.shape[1]:
                x, t = self.whole[some, f] / self.long[some], np.minimum(1.0, local[some])
                wide = np.sqrt(np.maximum(0.0, (1 - t * t) * (1 - x * x))) + 1e-7
                # Of angles: y is at least x t - wide, and past x t + wide only where that side holds all up to the axis.
                lows = np.where(-x >= t, -1.0, x * t - wide)
                highs = np.where(x >= t, 1.0, x * t + wide)
                on = c.between(f, float(lows.min()) - 1e-7, float(highs.max()) + 1e-7)
                if not len(on):
                    continue
            for low in range(0, len(some), step):
                self.take(some[low : low + step], on, c, fit, least)

    def take(self, at: np.ndarray, on, c: "Passing", fit: bool, least: np.ndarray) -> None:
        q, v = (self.single, c.single) if fit else (self.whole, c.whole)
        dim = min(q.shape[1], v.shape[1])
        tile = q[at, :dim] @ v[on, :dim].T
        ids, nodes = c.ids[on], c.nodes[on]
        # One more than k, as a query may stand in the block itself.
        rows, columns = reached(tile, kth(tile, least[at], self.k + 1))
        other = nodes[columns] != self.nodes[at[rows]]
        rows, columns = rows[other], columns[other]
        self.best.add(at[rows], tile[rows, columns].astype(np.int64), ids[columns])

    def large(self, c: "Passing") -> None:
        """The same where floats do not hold the products: scaled ones with error bounds choose candidates, Python integers decide."""
        with np.errstate(all="ignore"):
            reach = np.sqrt((np.ldexp(self.q, -self.of[:, None]) ** 2).sum(1)) * np.ldexp(c.norm, LESS - self.scale)
            local = np.where(reach > 0, self.bounds / np.maximum(reach, 1e-300), np.where(self.bounds > TINY * 4, 2.0, -1.0))
        on = np.flatnonzero(local <= 1 + 1e-9)
        step = max(1, TILE // max(1, len(c.ids)))
        for low in range(0, len(on), step):
            some = on[low : low + step]
            found = products(self.q[some], c.v, self.of[some], self.scale)
            for at, j in enumerate(some.tolist()):
                row = tuple(None if x is None else x[at] for x in found)
                fits = np.flatnonzero((c.nodes != self.nodes[j]) & (row[0] + row[1] >= self.bounds[j]))
                held = self.beyond.setdefault(j, [])
                held += best(self.q[j], c.v, c.ids, fits, row, self.k)
                if len(held) > 8 * self.k:
                    held[:] = sorted(held)[: self.k]

    def found(self) -> pa.RecordBatch:
        rows, scores, ids = self.best.found()
        plain = [self.nodes[rows], self.ids[rows], ids, scores]
        large = [(int(self.nodes[j]), int(self.ids[j]), i, *shown(-s)) for j, held in self.beyond.items() for s, i in sorted(held)[: self.k]]
        columns = [pa.concat_arrays([pa.array(x, pa.int64()), pa.array([r[n] for r in large], pa.int64())]) for n, x in enumerate(plain)]
        columns.append(pa.array([b"\x80"] * len(rows) + [r[4] for r in large], pa.binary()))
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _FOUND.split(", ")])


class Passing:
    """One block of vectors."""

    def __init__(self, r: dict):
        self.ids, self.nodes, self.v = _open(r)
        self.norm = r["longest"]
        with np.errstate(all="ignore"):
            self.whole = self.v * 1024
            self.lengths = np.sqrt((self.whole * self.whole).sum(1))
        self.longest = self.lengths.max(initial=0.0)
        self.single = self.whole.astype(np.float32) if self.longest < 1 << 24 else None
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def between(self, f: int, low: float, high: float) -> np.ndarray:
        """The vectors whose coordinate f lies in an interval, as a share of their length."""
        if f not in self.sorted:
            y = self.whole[:, f] / np.maximum(self.lengths, 1e-300)
            order = np.argsort(y, kind="stable")
            self.sorted[f] = y[order], order
        y, order = self.sorted[f]
        return order[np.searchsorted(y, low, "left") : np.searchsorted(y, high, "right")]


def _verify(k: int):
    def gathered(rows: list[dict]) -> list[Queries]:
        of: dict[tuple[int, int], list] = {}
        for r in rows:
            ids, nodes, q = _open(r)
            of.setdefault((r["dim"], r["scale"]), []).append((ids, nodes, q, np.frombuffer(r["bounds"], np.float64), r["scale"]))
        out = []
        for parts in of.values():
            low, n = 0, 0
            for high, p in enumerate(parts, 1):
                n += len(p[0])
                if n >= ROWS or high == len(parts):
                    out.append(Queries(parts[low:high], k))
                    low, n = high, 0
        return out

    def run(batches):
        waiting, queries = [], None
        for b in batches:
            for at in range(b.num_rows):
                r = b.slice(at, 1).to_pylist()[0]
                if r["side"] == 0:
                    waiting.append(r)
                    continue
                if queries is None:
                    queries, waiting = gathered(waiting), []
                c = Passing(r)
                for q in queries:
                    q.meet(c)
        for q in queries or []:
            yield q.found()

    return run


def top_k(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score: for each vector whose id is divisible by every, the k best others."""
    spark = vectors.sparkSession
    rows = whole_vectors(vectors)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Length alone may be one value for all rows; the id splits such a bucket over partitions.
    sorted_rows = rows.repartitionByRange(parts, F.desc("norm"), F.col("vec_id")).sortWithinPartitions(F.desc("norm"), "vec_id")
    blocks = cut(sorted_rows.mapInArrow(_pack, _BLOCK), "topk-blocks")
    asked = blocks.mapInArrow(partial(_asked, every), _BLOCK)
    first = blocks.select("longest", "block").orderBy(F.desc("longest"), "block").first()
    if first is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    longest = blocks.filter(F.col("block") == first["block"]).select(*(F.col(n).alias(f"s_{n}") for n in ("longest", "ids", "nodes", "vectors", "dim", "kind")))
    # One block of at most BLOCK vectors is broadcast.
    bounded = cut(asked.join(F.broadcast(longest), F.lit(True)).mapInArrow(_seed(k), _SEEDED), "topk-queries")
    scale, least, n_q, size = bounded.agg(F.max("scale"), F.min("reach"), F.sum("n"), F.sum(F.col("n").cast("long") * F.col("dim"))).first()
    if scale is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # Blocks too short for every query stay where they are.
    used = blocks.filter(F.col("longest") >= F.lit(float(np.ldexp(least, scale - LESS))))
    n, n_c = used.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = meet(bounded.drop("reach"), used, "block", [F.desc("longest"), "block"], (n_q, n_c, n), lanes_of(size), _verify(k), _FOUND, "topk-found")
    order = W.partitionBy("query").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.r <> c.r
), r AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM p
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
