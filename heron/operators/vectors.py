"""Exact nearest neighbours over embedding columns, in blocks, and contamination checks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a corpus that a task holds at least, where there are as many, and components that it holds at most.
BLOCK, HELD = 1024, 1 << 22
#: Scores that are worked out at a time, and meetings of two rows from which on more tasks are worth their rows' way.
TILE, WORTH = 1 << 22, 1 << 20
#: Scores of which only the largest is looked at first.
STEP = 64


def similarities(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """Row by row similarity: 1 - distance for l2, else the cosine with 1e-8 added to each norm."""
    if metric == "l2":
        out = np.empty((len(q), len(c)))
        for i, x in enumerate(q):
            out[i] = 1.0 - np.sqrt(((c - x) ** 2).sum(1))
        return out
    qn = q / (np.linalg.norm(q, axis=1, keepdims=True) + 1e-8)
    cn = c / (np.linalg.norm(c, axis=1, keepdims=True) + 1e-8)
    return qn @ cn.T


class Side:
    """The rows of a corpus, sorted by ids, as their products need them: as they are or normed (b), and in single precision, scaled to at most 1, half their squares below."""

    def __init__(self, ids: np.ndarray, c: np.ndarray, metric: str):
        self.ids, self.metric = ids, metric
        self.b = c if metric == "l2" else c / (np.linalg.norm(c, axis=1, keepdims=True) + 1e-8)
        with np.errstate(all="ignore"):
            self.minus = (c * c).sum(1) / 2 if metric == "l2" else np.zeros(len(c))
            self.longest = np.sqrt((self.b * self.b).sum(1).max()) if len(c) else 0.0
        # Products of what is not finite, or of squares near the ends of double precision, are left to double precision.
        self.single = None
        if self.longest == 0 or 1e-100 < self.longest < 1e100:
            self.scale = self.longest or 1.0
            self.single = np.vstack([(self.b / self.scale).T, -self.minus / self.scale**2]).astype(np.float32)


def _slack(a: np.ndarray, side: Side) -> np.ndarray:
    """By how much a product may be below another whose similarity is the same to nine digits, for each query."""
    if side.metric != "l2":
        return np.full(len(a), 1e-8)
    both = np.sqrt((a * a).sum(1)) + side.longest
    return 4e-9 * both + 1e-12 * both * both


def _own(q_ids: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place of a query, of a row) of equal ids."""
    low = np.searchsorted(ids, q_ids, "left")
    n = np.searchsorted(ids, q_ids, "right") - low
    return np.repeat(np.arange(len(q_ids)), n), np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())


def _close(q_ids: np.ndarray, a: np.ndarray, side: Side, k: int, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Pairs (place of a query, of a row) among which the k best of each query are, by products in single precision; None where these tell too little."""
    longest = np.sqrt((a * a).sum(1))
    if side.single is None or not np.all(longest < 1e6 * side.scale):
        return None
    near = np.hstack([a / side.scale, np.ones((len(a), 1))]).astype(np.float32) @ side.single
    near[_own(q_ids, side.ids)] = -np.inf
    n = near.shape[1]
    # Each of so many groups of rows is looked at by its largest product alone; the k-th largest of these is at most the k-th largest of all.
    groups = min(n, max(n // STEP, 8 * k))
    each = n // groups
    first = near[:, : each * groups].reshape(len(a), each, groups)
    tops = np.hstack([first.max(1), near[:, each * groups :]])
    # Twice the error of a sum of so many products, and that of its terms.
    error = (a.shape[1] + 16) * 2.0**-23 * (longest / side.scale + 0.5) + 1e-37
    least = np.partition(tops, -k, axis=1)[:, -k] - (slack / side.scale**2 + error)
    least = np.nextafter(least.astype(np.float32), np.float32(-np.inf))
    of, at = np.nonzero((tops >= least[:, None]) & (tops > -np.inf))
    alone = at >= groups
    whole_of, whole_at = np.repeat(of[~alone], each), (at[~alone][:, None] + groups * np.arange(each)).ravel()
    x = near[whole_of, whole_at]
    fits = (x >= least[whole_of]) & (x > -np.inf)
    of, at = np.concatenate([whole_of[fits], of[alone]]), np.concatenate([whole_at[fits], at[alone] + (each - 1) * groups])
    return (of, at) if len(of) <= near.size // 4 or near.size < STEP * STEP else None


def _closer(q_ids: np.ndarray, a: np.ndarray, side: Side, k: int, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same by products in double precision, for any rows."""
    own = _own(q_ids, side.ids)
    near = a @ side.b.T - side.minus
    near[own] = -np.inf
    least = np.partition(near, -k, axis=1)[:, -k] - slack if len(side.ids) > k else np.full(len(a), -np.inf)
    # What is not finite cannot be left out by its product.
    keep = ~(near < least[:, None])
    keep[own] = False
    return np.divmod(np.flatnonzero(keep), len(side.ids))


def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int, metric: str, side: Side | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, id, similarity) of the k most similar rows of c, sorted by ids, for each row of q, its own id left out; ties of nine digits go to the smaller ids.

    Matrix products tell which rows can be among the k, by more than rounding; only of those the similarity itself is worked out.
    """
    side = side or Side(ids, c, metric)
    with np.errstate(all="ignore"):
        a, b = q if metric == "l2" else q / (np.linalg.norm(q, axis=1, keepdims=True) + 1e-8), side.b
        slack = _slack(a, side)
        of, at = (_close(q_ids, a, side, k, slack) if len(ids) > k else None) or _closer(q_ids, a, side, k, slack)
        s, size = np.empty(len(of)), max(1, TILE // max(1, q.shape[1]))
        for low in range(0, len(of), size):
            x, y = a[of[low : low + size]], b[at[low : low + size]]
            s[low : low + size] = 1.0 - np.sqrt(((y - x) ** 2).sum(1)) if metric == "l2" else (x * y).sum(1)
    rounded = np.round(s, 9)
    order = np.lexsort((ids[at], -np.where(np.isnan(rounded), np.inf, rounded), of))
    of, at, s = of[order], at[order], s[order]
    chosen = np.arange(len(of)) - np.searchsorted(of, of) < k
    return q_ids[of[chosen]], ids[at[chosen]], s[chosen]


def _matrices(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(ids, rows) of each dimension from batches of ids, sizes and components, sorted by ids."""
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    if not parts:
        return out
    ids, sizes, flat = (np.concatenate(x) for x in zip(*parts, strict=True))
    ends = np.cumsum(sizes)
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        at = at[np.argsort(ids[at], kind="stable")]
        out[dim] = ids[at], flat[(ends[at] - dim)[:, None] + np.arange(dim)]
    return out


def _nearest(k: int, metric: str):
    """Rows (cell, side, id, v), a cell's corpus (side 0) before its queries, to (query_id, id, similarity)."""

    def meet(queries, corpus):
        for dim, (q_ids, q) in _matrices(queries).items():
            if dim not in corpus:
                continue
            side, c = corpus[dim]
            step = max(1, TILE // len(c))
            for low in range(0, len(q_ids), step):
                found = best(q_ids[low : low + step], q[low : low + step], side.ids, c, k, metric, side)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "id", "similarity"])

    def run(batches):
        now, parts, corpus = None, [], None
        for b in batches:
            cells, sides, lists = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3)
            ids, ends, flat = b.column(2).to_numpy(), lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(sides) != 0)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(cells)], strict=True):
                if low == high:
                    continue
                cell, part = int(cells[low]), (ids[low:high].copy(), np.diff(ends[low : high + 1]), np.array(flat[ends[low] : ends[high]], np.float64))
                if cell != now:
                    now, parts, corpus = cell, [], None
                if sides[low] == 0:
                    parts.append(part)
                    continue
                if corpus is None:
                    corpus, parts = {dim: (Side(ids, c, metric), c) for dim, (ids, c) in _matrices(parts).items()}, []
                yield from meet([part], corpus)

    return run


def cell_rows(dims: int) -> int:
    """How many corpus rows of at most so many components a cell holds."""
    return max(BLOCK, HELD // max(1, dims))


def ranked_neighbors(queries: DataFrame, corpus: DataFrame, cells: int, k: int, metric: str) -> DataFrame:
    """(query_id, id, similarity, rank): the k best of all pairs of a row of queries and one of corpus, both (cell, id, v), in the same of cells 0, 1, ...; at most k rows a query leave each cell."""
    spark = queries.sparkSession
    parts = min(cells, 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def side(rows: DataFrame, n: int) -> DataFrame:
        return rows.select(F.col("cell").cast("int"), F.lit(n).alias("side"), F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))

    rows = side(corpus, 0).unionByName(side(queries, 1))
    dealt = rows.repartitionById(parts, F.col("cell") % parts).sortWithinPartitions("cell", "side")
    found = dealt.mapInArrow(_nearest(k, metric), "query_id long, id long, similarity double")
    order = W.partitionBy("query_id").orderBy(F.round("similarity", 9).desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def usable(rows: DataFrame) -> DataFrame:
    """The rows (id, v) that have an id and a vector."""
    return rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & F.col("id").isNotNull())


def nearest(queries: DataFrame, corpus: DataFrame, k: int = 8, metric: str = "l2") -> DataFrame:
    """(query_id, id, similarity, rank): the k most similar rows of corpus (id, v) for each row of queries (id, v), itself left out.

    Queries and corpus are dealt into shares, and each pair of shares is a cell. A cell holds a
    bounded share of the corpus and meets its queries as they come; only k rows a query leave it.
    There are as many cells as there are shuffle partitions, fewer where the rows are few. Vectors
    meet only those of their own dimension.
    """
    spark = queries.sparkSession
    q, c = usable(queries), usable(corpus)
    n_q, (n_c, dims) = q.count(), c.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    if not n_q or not n_c:
        return spark.createDataFrame([], "query_id long, id long, similarity double, rank int")
    tasks = min(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-n_q * n_c // WORTH))
    down = max(1, -(-n_c // cell_rows(dims)), min(tasks, round((tasks * n_c / max(1, n_q)) ** 0.5)))
    across = max(1, -(-tasks // down))

    def share(n: int):
        return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")

    def each(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    to = q.select("id", "v", (share(across) * down).alias("at"), each(down).alias("row")).select((F.col("at") + F.col("row")).alias("cell"), "id", "v")
    of = c.select("id", "v", share(down).alias("row"), each(across).alias("at")).select((F.col("at") * down + F.col("row")).alias("cell"), "id", "v")
    return ranked_neighbors(to, of, across * down, k, metric)


def similarity_stats(neighbors: DataFrame) -> DataFrame:
    """query_id, top_sim, avg_top3, avg_all and the number of neighbours."""
    return neighbors.groupBy("query_id").agg(
        F.max("similarity").alias("top_sim"), F.avg(F.when(F.col("rank") <= 3, F.col("similarity"))).alias("avg_top3"),
        F.avg("similarity").alias("avg_all"), F.count("*").cast("int").alias("n_neighbors"),
    )


def contamination(queries: DataFrame, corpus: DataFrame, threshold: float = 0.90) -> DataFrame:
    """(id, nearest_id, max_similarity, flagged): each query's most similar corpus row by cosine, the first of ties."""
    best = nearest(queries, corpus, 1, "cosine")
    return best.select(F.col("query_id").alias("id"), F.col("id").alias("nearest_id"), F.col("similarity").alias("max_similarity"), (F.col("similarity") >= threshold).alias("flagged"))
