"""Near-duplicate classes by Order MinHash and banded alignment.

The k-mers are five-word shingles, labelled with their occurrence number so that each is unique in
its text. For each of TABLES hash functions the ORDER smallest labelled k-mers are sampled and kept
in text order; texts that agree on a sample are candidates. Similarity is that of the best alignment
of the two shingle sequences: matched / (all - matched), so order counts as in edit similarity; links
need a sample in common and 0.8 or more. As labelled shingles are unique, the alignment is a longest
increasing subsequence, within the band that the threshold leaves. Classes are the connected components
of all such links, so they depend on the texts alone, not on sizes, partitions or how texts were dealt.

Exact copies are one text before anything else. A bucket gives a star, each text with the bucket's
smallest node, never all pairs. A text of a star that is not linked to its centre is aligned with those
of the star that hold enough of its shingles and are not connected with it yet. Stars of more than
GROUP texts are split into parts; a text that its part does not connect with the centre then meets the
texts of all parts with which it can have a link: texts of similarity t share a shingle among the first
n - ceil(t * n) + 1 of each one's n, in whatever order of shingles that both follow. In a star's order
those of its centre come last, as what unlike texts of a star have in common the centre mostly has too.
These smaller groups give stars again; where LEVELS of them still leave split stars, a text meets all
parts. None of this loses a link, so a split star gives what a whole one does.

Cases: null and empty texts are copies of the empty text; a text of one to four words is one
shingle; the class id is the smallest doc_id of the class; rows that repeat a doc_id are one
document if their texts are equal, else each row has its own text's class, and rows go by id and text;
null ids belong to the class of their text, and such rows go where a row with an id holds the text; a
text that has only null ids is not compared and has no class; an empty table gives no rows; extra
columns of any name are ignored by near_duplicates() and kept by drop_near_duplicates().
"""

from __future__ import annotations

import re
from bisect import bisect_left
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heron.llm.columns import quoted, unlike
from heron.llm.rolling import mix, prefix, ranges
from heron.plans.session import cut, discard, table

WORDS = 5
SIMILARITY = 0.8
TABLES = 12
ORDER = 2
#: Texts and shingles of a star that one task takes; larger stars are split.
GROUP = 4000
VOLUME = 4_000_000
#: Levels of stars, each of the groups into which the split stars of the one before are dealt, before texts meet all of a split star.
LEVELS = 3
_TEXT = re.compile(rb"[^\x00-\x20]+")
#: One odd multiplier for each table; labelled shingles are mixed before.
_SEEDS = mix(np.arange(1, TABLES + 1, dtype=np.uint64)) | np.uint64(1)
_SKETCH = "doc_id long, digest string, n int, keys array<long>"


def shingles(text: str | None) -> np.ndarray:
    """The text's five-word shingles in order, as hashes that are unique through their occurrence number."""
    data = (text or "").lower().encode()
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = raw > 32
    steps = np.diff(inside)
    start, end = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    if not len(start):
        return np.zeros(0, np.uint64)
    words = ranges(prefix(raw), start, end)
    n = max(1, len(words) - WORDS + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(WORDS, len(words))):
        out = mix(out + words[i : i + n])
    order = np.argsort(out, kind="stable")
    same = out[order]
    first = np.r_[True, same[1:] != same[:-1]]
    if not first.all():
        at = np.arange(n)
        label = np.zeros(n, np.uint64)
        label[order] = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
        out = np.where(label > 0, mix(out + label * np.uint64(0x9E3779B97F4A7C15)), out)
    return out


def sketch(s: np.ndarray) -> list[int]:
    """For each table, the key of its smallest labelled shingles in text order."""
    x = _SEEDS[:, None] * s[None, :]
    at = np.sort(np.argpartition(x, ORDER - 1, axis=1)[:, :ORDER], axis=1) if len(s) > ORDER else np.tile(np.arange(len(s)), (TABLES, 1))
    key = np.arange(TABLES, dtype=np.uint64)
    for v in np.take_along_axis(x, at, axis=1).T:
        key = mix(key * np.uint64(3) + v)
    return key.astype(np.int64).tolist()


def _sketch(batches):
    for b in batches:
        found = [shingles(t) for t in b.column(2).to_pylist()]
        keys = [sketch(s) if len(s) else [] for s in found]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array([len(s) for s in found], pa.int32()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "digest", "n", "keys"]
        )


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> float:
    """Similarity of the best alignment within the band of the given similarity."""
    if len(a) == 0 or len(b) == 0:
        return 1.0 if len(a) == len(b) else 0.0
    both = len(a) + len(b)
    band = int(both * (1 - similarity) / (1 + similarity)) + 1
    if abs(len(a) - len(b)) > band:
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    j = j[np.argsort(i)]
    if len(j) < 2 or (np.diff(j) > 0).all():
        matched = len(j)
    else:
        tails: list[int] = []
        for x in j.tolist():
            at = bisect_left(tails, x)
            tails[at : at + 1] = [x]
        matched = len(tails)
    return matched / (both - matched)


def overlaps(texts: list[np.ndarray], some: np.ndarray, width: int = 1 << 14) -> np.ndarray:
    """How many shingles each of some texts shares with every text, by counting bits, width shingles at a time."""
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    _, name, often = np.unique(np.concatenate(texts), return_inverse=True, return_counts=True)
    number = np.cumsum(often > 1) - 1
    several = often[name] > 1
    owner, name = owner[several], number[name[several]]
    order = np.argsort(name, kind="stable")
    owner, name = owner[order], name[order]
    out = np.zeros((len(some), len(texts)), np.int32)
    for low in range(0, int(name[-1]) + 1 if len(name) else 0, width):
        at = slice(*np.searchsorted(name, [low, low + width]))
        held = np.zeros((len(texts), width), bool)
        held[owner[at], name[at] - low] = True
        bits = np.packbits(held, axis=1).view(np.uint64)
        for row, i in zip(out, some.tolist(), strict=True):
            row += np.bitwise_count(bits & bits[i]).sum(1, dtype=np.int32)
    return out


def agreeing(texts: list[tuple[int, np.ndarray]]):
    """A test of whether the texts of two places have a sample in common; each text's samples are drawn when first asked for."""
    drawn: dict[int, set[int]] = {}

    def samples(i: int) -> set[int]:
        if i not in drawn:
            drawn[i] = set(sketch(texts[i][1]))
        return drawn[i]

    return lambda i, j: not samples(i).isdisjoint(samples(j))


def first_shingles(s: np.ndarray, late: np.ndarray, similarity: float) -> np.ndarray:
    """So many of a text's shingles, in an order where the late ones come last, that texts of the similarity share one of them."""
    return s[np.lexsort((s, np.isin(s, late)))[: len(s) - ceil(similarity * len(s) - 1e-9) + 1]]


def links_of(texts: list[tuple[int, np.ndarray]], similarity: float, sampled: bool = True) -> tuple[list[tuple[int, int]], list[int]]:
    """Links that connect whatever a star's texts connect, the centre first, and the ids that they do not connect with the centre; in a sampled star each text has a sample of the centre."""
    (centre, c), found, agree = texts[0], [], agreeing(texts)
    root = list(range(len(texts)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    apart = []
    for i, (doc, s) in enumerate(texts[1:], 1):
        if aligned(c, s, similarity) >= similarity and (sampled or agree(0, i)):
            found.append((centre, doc))
            root[i] = 0
        else:
            apart.append(i)
    if not apart:
        return found, []
    # What two texts share, in any order, bounds their alignment.
    sizes = np.array([len(s) for _, s in texts])
    for i, row in zip(apart, overlaps([s for _, s in texts], np.array(apart)), strict=True):
        near = row / np.maximum(1, sizes + sizes[i] - row)
        hits = np.flatnonzero(near >= similarity)
        for j in hits[np.argsort(-near[hits], kind="stable")].tolist():
            x, y = find(i), find(j)
            if x != y and aligned(texts[i][1], texts[j][1], similarity) >= similarity and agree(i, j):
                root[max(x, y)] = min(x, y)
                found.append((min(texts[i][0], texts[j][0]), max(texts[i][0], texts[j][0])))
    return found, [texts[i][0] for i in apart if find(i)]


def links_between(heads: list[tuple[int, np.ndarray]], members: list[tuple[int, np.ndarray]], connected: int, similarity: float) -> list[tuple[int, int]]:
    """Links of heads with members, of which the first connected ones are of one class; a pair of two heads is left to the smaller."""
    if not heads or not members:
        return []
    texts, n = members + heads, len(members)
    agree = agreeing(texts)
    root = [0] * connected + list(range(connected, len(texts)))
    found: list[tuple[int, int]] = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    sizes = np.array([len(s) for _, s in texts])
    for i, row in enumerate(overlaps([s for _, s in texts], np.arange(n, len(texts))), n):
        near = row[:n] / np.maximum(1, sizes[:n] + sizes[i] - row[:n])
        hits = np.flatnonzero(near >= similarity)
        for j in hits[np.argsort(-near[hits], kind="stable")].tolist():
            x, y = find(i), find(j)
            if x != y and (j < connected or texts[i][0] < texts[j][0]) and aligned(texts[i][1], texts[j][1], similarity) >= similarity and agree(i, j):
                root[max(x, y)] = min(x, y)
                found.append((min(texts[i][0], texts[j][0]), max(texts[i][0], texts[j][0])))
    return found


def _verify(similarity: float, sampled: bool):
    def close(star, texts):
        if len(texts) < 2 or texts[0][0] != star[0]:
            return
        found, alone = links_of(texts, similarity, sampled)
        yield from ((star[0], a, b, True) for a, b in found)
        if star[2] > 1:
            yield from ((star[0], star[0], x, False) for x in alone)

    def run(batches):
        star, texts = None, []
        for b in batches:
            out = []
            for centre, part, parts, doc, text in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if (centre, part, parts) != star:
                    out += close(star, texts)
                    star, texts = (centre, part, parts), []
                if not texts or texts[-1][0] != doc:
                    texts.append((doc, shingles(text)))
            yield _rows(out)
        yield _rows(list(close(star, texts)) if star else [])

    return run


def _firsts(similarity: float):
    """(star, node, n, key): the first shingles of each text of a star but its centre, whose own come last."""

    def run(batches):
        star, late = None, None
        for b in batches:
            centres, parts, docs, texts = (b.column(i).to_pylist() for i in (0, 1, 3, 4))
            out, rows = [], []
            for centre, part, doc, text in zip(centres, parts, docs, texts, strict=True):
                s = shingles(text)
                if (centre, part) != star:
                    star, late = (centre, part), s if doc == centre else s[:0]
                if doc != centre:
                    out.append(first_shingles(s, late, similarity).astype(np.int64))
                    rows.append((centre, doc, len(s)))
            sizes = [len(x) for x in out]
            columns = [pa.array(np.repeat(np.array([r[i] for r in rows], kind), sizes)) for i, kind in enumerate((np.int64, np.int64, np.int32))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate([np.zeros(0, np.int64), *out]))], ["star", "node", "n", "key"])

    return run


def _meet(similarity: float):
    def close(star, sides):
        connected = len(sides[1])
        return [(star[0], a, b, True) for a, b in links_between(sides[0], sides[1] + sides[2], connected, similarity)]

    def run(batches):
        star, sides = None, ([], [], [])
        for b in batches:
            out = []
            for centre, head, part, side, doc, text in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if (centre, head, part) != star:
                    out += close(star, sides) if star else []
                    star, sides = (centre, head, part), ([], [], [])
                if not sides[side] or sides[side][-1][0] != doc:
                    sides[side].append((doc, shingles(text)))
            yield _rows(out)
        yield _rows(close(star, sides) if star else [])

    return run


def _rows(out):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["star", "a", "b", "linked"])


def _parts(share: float):
    """How many parts a group of rows (b, n) takes, each with that share of GROUP and VOLUME."""
    return F.ceil(F.greatest(F.count("*") / (share * GROUP), F.sum("n") / (share * VOLUME))).cast("int")


def _digest(text="text"):
    return F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))


def _with_text(rows: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """rows (doc, ...) with the text of the node doc, from a row of docs that has the node's id and digest."""
    # The candidates grow with the corpus, so the plan is the one for large sides at any size.
    named = rows.join(nodes.select(F.col("node").alias("doc"), "doc_id", "digest"), "doc")
    return named.join(docs.select("doc_id", _digest().alias("digest"), "text").hint("merge"), ["doc_id", "digest"])


def _dealt(docs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(centre, part, parts, doc, text) of the stars of edges (a, b, n), each part in one task, the centre first in each."""
    # Written, as both sides of the join are then plain exchanges, whose hot stars Spark can split.
    sizes = cut(edges.groupBy("a").agg(_parts(1).alias("parts")), "sizes")
    members = edges.join(sizes, "a").select(F.col("a").alias("centre"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "parts", F.col("b").alias("doc"))
    centres = sizes.select(F.col("a").alias("centre"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "parts", F.col("a").alias("doc"))
    rows = _with_text(members.unionByName(centres), docs, nodes).select("centre", "part", "parts", "doc", "text")
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n, "centre", "part").sortWithinPartitions("centre", "part", F.col("doc") != F.col("centre"), "doc")


def verify(docs: DataFrame, nodes: DataFrame, edges: DataFrame, similarity: float, sampled: bool = True) -> DataFrame:
    """(star, a, b, linked) of the candidate pairs edges (a, b) of nodes, a being the centre of b's star; in sampled stars b has a sample of a."""
    return _dealt(docs, nodes, edges).mapInArrow(_verify(similarity, sampled), "star long, a long, b long, linked boolean")


def meet(docs: DataFrame, nodes: DataFrame, edges: DataFrame, alone: DataFrame, similarity: float) -> DataFrame:
    """(star, a, b, linked) of the texts alone (a, b) of split stars, each with every text of its star."""
    heads = edges.join(alone, ["a", "b"], "left_semi")
    # Two sides meet in one task, so the second gets smaller parts.
    sizes = edges.groupBy("a").agg(_parts(1).alias("parts")).join(heads.groupBy("a").agg(_parts(0.5).alias("heads")), "a")
    head, part = F.pmod(F.xxhash64("b", F.lit(1)), F.col("heads")).cast("int"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")

    def each(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    first = heads.join(sizes, "a").select("a", head.alias("head"), each("parts").alias("part"), F.lit(0).alias("side"), F.col("b").alias("doc"))
    marked = edges.join(sizes, "a").join(alone.withColumn("side", F.lit(2)), ["a", "b"], "left")
    second = marked.select("a", each("heads").alias("head"), part.alias("part"), F.coalesce("side", F.lit(1)).alias("side"), F.col("b").alias("doc"))
    rows = _with_text(first.unionByName(second), docs, nodes).select("a", "head", "part", "side", "doc", "text")
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartition(n, "a", "head", "part").sortWithinPartitions("a", "head", "part", "side", "doc")
    return dealt.mapInArrow(_meet(similarity), "star long, a long, b long, linked boolean")


def refined(docs: DataFrame, nodes: DataFrame, edges: DataFrame, alone: DataFrame, similarity: float) -> DataFrame:
    """The candidate pairs (a, b, n) of smaller stars: a star for each first shingle that a text alone (a, b) of a split star shares with others of it."""
    split = edges.join(alone.select("a").distinct(), "a", "left_semi")
    keys = cut(_dealt(docs, nodes, split).mapInArrow(_firsts(similarity), "star long, node long, n int, key long").distinct(), "firsts")
    wanted = keys.join(alone.toDF("star", "node"), ["star", "node"], "left_semi").select("star", "key").distinct()
    met = keys.join(wanted, ["star", "key"], "left_semi").groupBy("star", "key").agg(F.min("node").alias("a"), F.count("*").alias("many"))
    centres = cut(met.filter("many > 1").select("star", "key", "a"), "centres")
    finer = cut(keys.join(centres, ["star", "key"]).filter("node <> a").select("a", F.col("node").alias("b"), "n").distinct(), "stars")
    discard(keys, centres)
    return finer


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): the smallest node that it is connected with."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    done = labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")), "roots")
    while True:
        # The smallest root among the neighbours, then the root's root.
        offered = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        nearer = labels.join(offered, F.col("node") == F.col("a")).select("node", F.least("root", "near").alias("next"), F.col("root").alias("was"))
        up = labels.select(F.col("node").alias("n2"), F.col("root").alias("above"))
        moved = cut(nearer.join(up, F.col("next") == F.col("n2"), "left").select("node", F.least("next", F.coalesce("above", "next")).alias("root"), "was"), "roots")
        discard(done)
        done, labels = moved, moved.select("node", "root")
        if not moved.filter("root <> was").limit(1).count():
            discard(both)
            return labels


def _classes(docs: DataFrame, similarity: float) -> DataFrame:
    """doc_id, digest of the text and class_id of every row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sketches = cut(rows.select("doc_id", _digest().alias("digest"), "text").mapInArrow(_sketch, _SKETCH), "sketches")
    # One text for all its copies: the smallest id stands for it, null only where there is none. A node is a text, as an id may have several.
    texts = sketches.groupBy("digest").agg(F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "n", "keys")).alias("x")).select("digest", "x.doc_id", "x.n", "x.keys")
    texts = cut(texts.withColumn("node", F.monotonically_increasing_id()), "texts")
    nodes = texts.filter("doc_id is not null")
    keys = nodes.select("node", "n", F.explode("keys").alias("key"))
    centres = cut(keys.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("many")).filter("many > 1").select("key", "a"), "centres")
    edges = stars = cut(keys.join(centres, "key").filter("node <> a").select("a", F.col("node").alias("b"), "n").distinct(), "stars")
    checked = cut(verify(rows, nodes, edges, similarity), "links")
    links, alone = checked.filter("linked").select("a", "b"), checked.filter("not linked").select(F.col("star").alias("a"), "b")
    level = 1
    while not alone.isEmpty():
        if level == LEVELS:
            links = links.unionByName(cut(meet(rows, nodes, edges, alone, similarity), "links").select("a", "b"))
            break
        edges, level = refined(rows, nodes, edges, alone, similarity), level + 1
        again = cut(verify(rows, nodes, edges, similarity, False), "links")
        links, alone = links.unionByName(again.filter("linked").select("a", "b")), again.filter("not linked").select(F.col("star").alias("a"), "b")
    roots = components(links)
    discard(centres, stars, checked)
    least = cut(roots.join(nodes.select("node", "doc_id"), "node").groupBy("root").agg(F.min("doc_id").alias("class_id")), "classes")
    linked = roots.join(least, "root").select("node", "class_id")
    classes = texts.join(linked, "node", "left").select("digest", F.coalesce("class_id", "doc_id").alias("class_id"))
    return sketches.select("doc_id", "digest").join(cut(classes, "classes"), "digest").select("doc_id", "digest", "class_id")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and class_id of every row of docs."""
    return _classes(docs, similarity).select("doc_id", "class_id")


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs whose doc_id is its class's smallest, and those without a class, with their own columns."""
    gone = _classes(docs, similarity).filter("class_id is not null and not doc_id <=> class_id").select("doc_id", "digest")
    a, b, digest = unlike(docs, "gone_id", "gone_digest", "digest")
    rows = docs.withColumn(digest, _digest())
    left = rows.join(gone.toDF(a, b).hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col(a)) & (F.col(digest) == F.col(b)), "left_anti")
    return left.select(*map(quoted, docs.columns))


def op6_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
