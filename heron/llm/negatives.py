"""Hard negatives by a two-dimensional block matrix product (SUMMA).

Rows are sorted by label and packed into blocks, anchors into smaller ones, and every block is cut into
panels of CHUNK dimensions. The tasks form a grid of lanes of anchors and shares of candidates
(heron.llm.cells): an anchor panel goes to all tasks of its lane, a candidate panel to one task of each
lane. Where two blocks meet, the products of their panels are added up, dimension chunk by dimension
chunk, in the task that keeps the tile; of a tile only the best few per anchor, or per anchor and
positive within its window, are kept, and of all tiles of a task only those leave it.

The product is walked in two phases that share no work: tiles of equal labels give the positives; those
of unlike labels then give, inside the windows that the positives' scores open, the negatives. As blocks
are sorted by label, few pairs of blocks belong to both.

Components are held as floor(256 * x), in 2, 4 or 8 bytes or, beyond, as Python integers. Tiles are
products in single precision where every sum stays under 2 ** 24, in double precision under 2 ** 53;
beyond, they are sums of Python integers.

Cases: rows whose label or vector is null or whose vector holds null or non-finite components take no
part, nor do rows without vec_id, as a result could not name them; empty vectors have the product 0
with all others and unequal lengths count as padded with zeros; ties go to the smaller vec_id; repeated
vec_ids are rows of their own, so an anchor may meet another row of its id; fewer positives or negatives
give fewer rows, and a window that holds none gives none; an empty table gives none; extra columns are
ignored. Scores outside the range of long are ranked and compared by their exact values and shown as
the end of that range.
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
from heron.llm.topk import HIGH, LOW, shown
from heron.plans.session import cut, table

#: Rows of a block of anchors and of candidates, and dimensions of a panel.
ANCHORS, BLOCK, CHUNK = 256, 2048, 32
SCALE = 256
#: From this size on a 64-bit float times SCALE is a whole number.
WHOLE = float(1 << 44)
_PANEL = "anchor boolean, block long, chunk int, dim int, n int, longest double, kind int, ids binary, labels binary, nodes binary, values binary"
_WINDOWS = "array<struct<at:int,slot:int,positive_id:long,score:long,beyond:binary>>"
_FOUND = "a_block long, at int, slot int, anchor_id long, positive_id long, positive_score long, vec_id long, score long, beyond binary"
_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def labelled(vectors: DataFrame) -> DataFrame:
    """vec_id, label and v (floor(SCALE * x) / SCALE of each component) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    takes_part = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall(x, lambda a: F.coalesce(~F.isnan(a) & (F.abs(a) < float("inf")), F.lit(False)))
    v = F.transform(x, lambda a: F.when(F.abs(a) < WHOLE, F.floor(a * SCALE) / float(SCALE)).otherwise(a))
    return vectors.filter(takes_part).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))


def _panels(every: int, batches):
    """Rows (vec_id, label, v), sorted by label, to panels of candidates and of anchors; a row's node is its partition and place."""
    part, place = TaskContext.get().partitionId(), 0
    held: dict[bool, list] = {False: [], True: []}
    made = {False: 0, True: 0}

    def block(anchor):
        rows = held[anchor]
        dim = max(len(r[3]) for r in rows)
        m = np.zeros((len(rows), dim))
        for k, r in enumerate(rows):
            m[k, : len(r[3])] = r[3]
        ids, labels, nodes = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        key, made[anchor], held[anchor] = (part << 32) + made[anchor], made[anchor] + 1, []
        with np.errstate(all="ignore"):
            longest = float(np.sqrt(((m * SCALE) ** 2).sum(1)).max())
        # Beyond, numbers of 8 bytes do not hold every component.
        m = (m * SCALE).astype(np.int64) if longest < 2.0**62 else integers(m)
        for chunk in range(max(1, -(-dim // CHUNK))):
            first = chunk == 0
            kind, values = packed(m[:, chunk * CHUNK : (chunk + 1) * CHUNK])
            out = [anchor, key, chunk, dim, len(rows), longest, kind, *(x.tobytes() if first else b"" for x in (ids, labels, nodes)), values]
            kinds = [pa.bool_(), pa.int64(), *[pa.int32()] * 3, pa.float64(), pa.int32(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(out, kinds, strict=True)], _names(_PANEL))

    for b in batches:
        ends, flat = b.column(2).offsets.to_numpy(), b.column(2).values.to_numpy(zero_copy_only=False)
        for k, (i, label) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            row = (i, label, (part << 32) + place, flat[ends[k] : ends[k + 1]])
            place += 1
            for anchor, most in ((False, BLOCK), (True, ANCHORS)):
                if anchor and i % every:
                    continue
                held[anchor].append(row)
                if len(held[anchor]) == most:
                    yield from block(anchor)
    for anchor in (False, True):
        if held[anchor]:
            yield from block(anchor)


def integers(m: np.ndarray) -> np.ndarray:
    """SCALE times the components, as Python integers."""
    return np.array([[int(x * SCALE) if abs(x) < WHOLE else int(x) * SCALE for x in row] for row in m.tolist()], object).reshape(m.shape)


def packed(tile: np.ndarray) -> tuple[int, bytes]:
    """Bytes of whole numbers and how they are held: numbers of 2, 4 or 8 bytes, or decimals."""
    if tile.dtype == object:
        return 0, ",".join(map(str, tile.ravel().tolist())).encode()
    most = max(int(tile.max()), -int(tile.min())) if tile.size else 0
    for size, kind in ((2, np.int16), (4, np.int32)):
        if most < 1 << (8 * size - 1):
            return size, tile.astype(kind).tobytes()
    return 8, np.ascontiguousarray(tile).tobytes()


def unpacked(kind: int, data: bytes) -> np.ndarray:
    if kind:
        return np.frombuffer(data, {2: np.int16, 4: np.int32, 8: np.int64}[kind]).astype(np.int64)
    return np.array([int(x) for x in data.split(b",") if x], object)


def first(scores: np.ndarray, ids: np.ndarray, on: np.ndarray, k: int) -> list[int]:
    """Of the places on, those of the k highest scores, ties to the smaller ids."""
    if scores.dtype == object:
        return sorted(on.tolist(), key=lambda x: (-scores[x], ids[x]))[:k]
    if len(on) > k:
        on = on[scores[on] >= np.partition(scores[on], -k)[-k]]
    return on[np.lexsort((ids[on], -scores[on]))[:k]].tolist()


def exact(score: int, beyond: bytes) -> int:
    """The score that shown() gave as a long and the bytes beyond it."""
    if beyond == b"\x80":
        return score
    data = beyond[5:]
    return int.from_bytes(data, "big") if score > 0 else -int.from_bytes(bytes(255 - x for x in data), "big")


def exactly(panel: np.ndarray) -> np.ndarray:
    """The panel in Python integers."""
    return panel if panel.dtype == object else np.array([int(x) for x in panel.ravel().tolist()], object).reshape(panel.shape)


class Block:
    """A block of rows as panels of whole numbers: floats of single or double precision, or Python integers, as its longest row needs."""

    def __init__(self, rows: list[dict]):
        r = rows[0]
        self.block, self.dim, self.longest, self.windows = r["block"], r["dim"], r["longest"], r.get("windows")
        self.ids, self.labels, self.nodes = (np.frombuffer(r[n], np.int64) for n in ("ids", "labels", "nodes"))
        self.panels = []
        for x in rows:
            width = max(0, min(CHUNK, self.dim - x["chunk"] * CHUNK))
            values = unpacked(x["kind"], x["values"]).reshape(len(self.ids), width)
            self.panels.append(values if values.dtype == object else values.astype(np.float32 if self.longest < 1 << 24 else np.float64))


def tile(a: list[np.ndarray], c: list[np.ndarray], size: float) -> np.ndarray:
    """Scores of rows held as panels, added up panel by panel; size is what no sum exceeds."""
    kind = np.float32 if size < 1 << 24 else np.float64 if size < 2.0**53 else object
    total = None
    for x, y in zip(a, c, strict=False):
        width = min(x.shape[1], y.shape[1])
        x, y = x[:, :width], y[:, :width]
        if kind is object:
            part = exactly(x) @ exactly(y).T if width else np.zeros((len(x), len(y)), object)
        else:
            part = x.astype(kind, copy=False) @ y.astype(kind, copy=False).T
        total = part if total is None else np.add(total, part, out=total)
    return total


class Anchors:
    """Anchors of one dimension, and the best of each, or of each in its windows, so far."""

    def __init__(self, blocks: list[Block], k: int, low: int, high: int):
        self.ids, self.labels, self.nodes = (np.concatenate([getattr(b, n) for b in blocks]) for n in ("ids", "labels", "nodes"))
        self.blocks, self.at = np.repeat([b.block for b in blocks], [len(b.ids) for b in blocks]), np.concatenate([np.arange(len(b.ids)) for b in blocks])
        self.panels, self.longest = [np.concatenate(p) for p in zip(*(b.panels for b in blocks), strict=True)], max(b.longest for b in blocks)
        self.k, self.windows = k, None
        self.beyond: dict[tuple, list[tuple[int, int]]] = {}
        if blocks[0].windows is not None:
            # Of each anchor and slot: the positive, and the least and the most that a negative may score.
            self.windows, first = {}, 0
            for b in blocks:
                for w in b.windows:
                    score = exact(w["score"], w["beyond"])
                    # low * positive <= 100 * negative <= high * positive, in whole numbers.
                    self.windows[first + w["at"], w["slot"] - 1] = w["positive_id"], w["score"], -((-low * score) // 100), high * score // 100
                first += len(b.ids)
            self.slots = 1 + max((s for _, s in self.windows), default=0)
            self.low, self.high = np.full((len(self.ids), self.slots), np.inf), np.full((len(self.ids), self.slots), LOW)
            for (row, slot), (_, _, least, most) in self.windows.items():
                self.low[row, slot], self.high[row, slot] = min(max(least, LOW), HIGH), min(max(most, LOW), HIGH)
        self.best = Best(len(self.ids) * (1 if self.windows is None else self.slots), k)

    def meet(self, c: Block) -> None:
        one = c.labels[0] == c.labels[-1]
        if self.windows is None:
            rows = np.flatnonzero((self.labels >= c.labels[0]) & (self.labels <= c.labels[-1]))
        else:
            rows = np.flatnonzero(self.labels != c.labels[0]) if one else np.arange(len(self.labels))
        with np.errstate(all="ignore"):
            size = self.longest * c.longest
        step = max(1, TILE // len(c.ids))
        for low in range(0, len(rows), step):
            some = rows[low : low + step]
            scores = tile([p[some] for p in self.panels], c.panels, size)
            alike = None if one else self.labels[some][:, None] == c.labels
            if scores.dtype == object:
                self.large(some, scores, alike, c)
                continue
            if alike is not None:
                scores[~alike if self.windows is None else alike] = -np.inf
            if self.windows is None:
                self.positives(some, scores, c)
            else:
                self.negatives(some, scores, c)

    def positives(self, some: np.ndarray, scores: np.ndarray, c: Block) -> None:
        # One more than k, as the anchor may stand in the block itself.
        rows, columns = reached(scores, kth(scores, self.best.least()[some], self.k + 1))
        other = c.nodes[columns] != self.nodes[some[rows]]
        rows, columns = rows[other], columns[other]
        self.best.add(some[rows], scores[rows, columns].astype(np.int64), c.ids[columns])

    def negatives(self, some: np.ndarray, scores: np.ndarray, c: Block) -> None:
        least = np.maximum(self.low[some], self.best.least().reshape(-1, self.slots)[some])
        rows, columns = reached(scores, least.min(1))
        found = scores[rows, columns].astype(np.int64)
        for slot in range(self.slots):
            on = np.flatnonzero((found >= least[rows, slot]) & (found <= self.high[some[rows], slot]))
            self.best.add(some[rows[on]] * self.slots + slot, found[on], c.ids[columns[on]])

    def large(self, some: np.ndarray, scores: np.ndarray, alike: np.ndarray | None, c: Block) -> None:
        """The same in Python integers."""
        for at, row in enumerate(some.tolist()):
            same = np.full(len(c.ids), self.labels[row] == c.labels[0]) if alike is None else alike[at]
            if self.windows is None:
                self.hold((row, None), scores[at], np.flatnonzero(same & (c.nodes != self.nodes[row])), c)
                continue
            for slot in range(self.slots):
                if (row, slot) in self.windows:
                    _, _, least, most = self.windows[row, slot]
                    self.hold((row, slot), scores[at], np.array([x for x in np.flatnonzero(~same).tolist() if least <= scores[at][x] <= most], np.int64), c)

    def hold(self, key: tuple, scores: np.ndarray, on: np.ndarray, c: Block) -> None:
        held = self.beyond.setdefault(key, [])
        held += [(-int(scores[x]), int(c.ids[x])) for x in first(scores, c.ids, on, self.k)]
        if len(held) > 8 * self.k:
            held[:] = sorted(held)[: self.k]

    def found(self) -> pa.RecordBatch:
        """Rows of _FOUND."""
        out = []
        rows, scores, ids = (x.tolist() for x in self.best.found())
        if self.windows is None:
            plain = [((row, None), score, b"\x80", i) for row, score, i in zip(rows, scores, ids, strict=True)]
        else:
            plain = [(divmod(row, self.slots), score, b"\x80", i) for row, score, i in zip(rows, scores, ids, strict=True)]
        for (row, slot), score, beyond, i in plain + [(key, *shown(-s), i) for key, held in self.beyond.items() for s, i in sorted(held)[: self.k]]:
            positive = (None, None) if slot is None else self.windows[row, slot][:2]
            out.append((int(self.blocks[row]), int(self.at[row]), None if slot is None else slot + 1, int(self.ids[row]), *positive, i, score, beyond))
        kinds = (pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([f[x] for f in out], t) for x, t in enumerate(kinds)], _names(_FOUND))


def _mine(k: int, low: int, high: int):
    """The panels of a lane's anchors, then of the candidates that pass, to the best of each anchor in this task."""

    def gathered(blocks: list[Block]) -> list[Anchors]:
        of: dict[tuple, list[Block]] = {}
        for b in sorted(blocks, key=lambda b: (b.labels[0], b.block)):
            # Anchors beyond single precision stay apart, as their tiles may need Python integers.
            of.setdefault((b.dim, b.longest < 1 << 24, b.panels[0].dtype), []).append(b)
        out = []
        for (_, single, _), some in of.items():
            start, n = 0, 0
            for end, b in enumerate(some, 1):
                n += len(b.ids)
                if n >= (ROWS if single else ANCHORS) or end == len(some):
                    out.append(Anchors(some[start:end], k, low, high))
                    start, n = end, 0
        return out

    def whole(batches):
        """(side, block) of panels that come one after another."""
        held: list[dict] = []
        for b in batches:
            for at in range(b.num_rows):
                r = b.slice(at, 1).to_pylist()[0]
                if held and (r["side"], r["block"]) != (held[0]["side"], held[0]["block"]):
                    yield held[0]["side"], Block(held)
                    held = []
                held.append(r)
        if held:
            yield held[0]["side"], Block(held)

    def run(batches):
        waiting, anchors = [], None
        for side, block in whole(batches):
            if side == 0:
                waiting.append(block)
                continue
            if anchors is None:
                anchors, waiting = gathered(waiting), []
            for a in anchors:
                a.meet(block)
        for a in anchors or []:
            yield a.found()

    return run


def hard_negatives(vectors: DataFrame, every: int = 50, positives: int = 5, k: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores.

    Anchors are the rows whose vec_id is divisible by every, positives their best rows of the same label, and
    negatives of a positive the best k rows of other labels that score from low to high percent of it.
    """
    spark = vectors.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # tie parts rows that agree in label and id, so that no range of the sort has to hold all of them.
    rows = labelled(vectors).withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, "label", "vec_id", "tie").sortWithinPartitions("label", "vec_id")
    panels = cut(rows.select("vec_id", "label", "v").mapInArrow(partial(_panels, every), _PANEL), "negatives-panels")
    one = F.col("chunk") == 0
    sizes = {r["anchor"]: r for r in panels.filter(one).groupBy("anchor").agg(F.count("*").alias("blocks"), F.sum("n").alias("n"), F.sum(F.col("n").cast("long") * F.col("dim")).alias("size")).collect()}
    if True not in sizes:
        return spark.createDataFrame([], _RESULT)
    lanes, size = lanes_of(sizes[True]["size"]), (sizes[True]["n"], sizes[False]["n"], sizes[False]["blocks"])
    anchors, others = (panels.filter(F.col("anchor") == x).drop("anchor") for x in (True, False))

    def mined(asked: DataFrame, best: int) -> DataFrame:
        return meet(asked, others, "block", ["block", "chunk"], size, lanes, _mine(best, low, high), _FOUND, "negatives-found")

    near = mined(anchors.withColumn("windows", F.lit(None).cast(_WINDOWS)), positives)
    order = F.desc("score"), F.desc("beyond"), F.asc("vec_id")
    ranked = near.withColumn("slot", F.row_number().over(W.partitionBy("a_block", "at").orderBy(*order))).filter(F.col("slot") <= positives)
    found = cut(ranked.select("a_block", "at", "slot", "vec_id", "score", "beyond"), "negatives-positives")
    # At most ANCHORS * positives windows to a block; a positive below zero opens none.
    windows = found.filter("score >= 0").groupBy(F.col("a_block").alias("block")).agg(F.collect_list(F.struct("at", "slot", F.col("vec_id").alias("positive_id"), "score", "beyond")).alias("windows"))
    far = mined(anchors.join(windows, "block").withColumn("windows", F.when(one, F.col("windows"))), k)
    ranked = far.withColumn("rank", F.row_number().over(W.partitionBy("a_block", "at", "slot").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    mixed = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", mixed.alias("label")))


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.r AS a, c.r AS c, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.r <> c.r
), p AS (
  SELECT a, c, anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, c) <= 5
), n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.a, p.c ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.a = s.a AND NOT s.alike AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
