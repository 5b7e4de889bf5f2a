"""Blocks of rows that meet others in tasks: products stay where they are made, and the best of each row leave.

Held blocks (queries, anchors) are dealt into lanes of at most HELD components. A lane is held whole by
every task, and each of the passing blocks comes by in one task. So a pass sends the passing blocks once
and a lane once a task, whatever the number of meetings; lanes beyond the first are passes of their own,
after which their shuffle files go. Nothing is broadcast.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heron.plans.session import cut

#: Components that a task holds, scores that it works out at a time, and tasks that a lane goes to in any case.
HELD, TILE, LEAST = 1 << 23, 1 << 21, 32
#: Rows of one matrix of held rows.
ROWS = 4096
#: A score that no row has.
NONE = -(1 << 62)


def lanes_of(components: int) -> int:
    """In how many lanes so many components are held."""
    return max(1, -(-components // HELD))


def meet(held: DataFrame, passing: DataFrame, key: str, order: list, sizes: tuple[int, int, int], lanes: int, run, schema: str, tag: str) -> DataFrame:
    """What run() makes of each lane of held rows and the passing rows, of equal columns, in each task; held rows come first.

    sizes has the rows that are held and passing, and the passing blocks.
    """
    n_held, n_passing, blocks = sizes
    parts = max(1, int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # So many that the copies of a lane are as large as what passes, or few.
    shares = max(1, min(parts, blocks, max(n_passing * lanes // max(1, n_held), LEAST)))
    right = passing.withColumn("side", F.lit(1)).withColumn("share", F.pmod(F.shiftright(key, 32) + F.col(key).bitwiseAND((1 << 32) - 1), F.lit(shares)).cast("int"))
    found = None
    for lane in range(lanes):
        mine = held if lanes == 1 else held.filter(F.pmod(F.xxhash64(key), F.lit(lanes)) == lane)
        left = mine.withColumn("side", F.lit(0)).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
        dealt = left.unionByName(right, allowMissingColumns=True).repartitionById(shares, F.col("share")).sortWithinPartitions("side", *order).drop("share")
        made = dealt.mapInArrow(run, schema)
        if lanes > 1:
            made = cut(made, tag)
        found = made if found is None else found.unionByName(made)
    return found


class Best:
    """The k best (score, id) of each of n rows so far, higher scores first, ties to smaller ids."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, np.full((n, k), NONE, np.int64), np.full((n, k), (1 << 63) - 1, np.int64)

    def least(self) -> np.ndarray:
        """The score that another must reach."""
        return np.where(self.scores[:, -1] == NONE, -np.inf, self.scores[:, -1].astype(np.float64))

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(rows):
            return
        changed, at = np.unique(rows, return_inverse=True)
        of = np.concatenate([np.repeat(np.arange(len(changed)), self.k), at])
        scores, ids = np.concatenate([self.scores[changed].ravel(), scores]), np.concatenate([self.ids[changed].ravel(), ids])
        order = np.lexsort((ids, -scores, of))
        of = of[order]
        order = order[np.arange(len(of)) - np.searchsorted(of, of) < self.k]
        self.scores[changed], self.ids[changed] = scores[order].reshape(-1, self.k), ids[order].reshape(-1, self.k)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, score, id) of all that is held."""
        rows, at = np.nonzero(self.scores != NONE)
        return rows, self.scores[rows, at], self.ids[rows, at]


def kth(tile: np.ndarray, least: np.ndarray, k: int) -> np.ndarray:
    """least, but where it is none the k-th highest score of the row, which is no more than what the k best need."""
    open_rows = np.flatnonzero(least == -np.inf)
    if len(open_rows) and tile.shape[1] > k:
        least = least.copy()
        least[open_rows] = np.partition(tile[open_rows], -k, axis=1)[:, -k]
    return least


def reached(tile: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the scores that are at least the row's, and are any."""
    rows, columns = np.divmod(np.flatnonzero(tile >= least.astype(tile.dtype)[:, None]), tile.shape[1])
    some = tile[rows, columns] > -np.inf
    return rows[some], columns[some]
