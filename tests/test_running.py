"""Running sums and maxima of large groups, and alignment in bounded memory, by plain Python."""

import random
import resource
import time

import pytest

from heron.operators import align
from heron.operators.running import RANGE, merge_ranges, ranges, running, running_totals


@pytest.fixture
def many_ranges(spark):
    """Small tables keep their eight ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def grouped(seed, n=2000):
    """One group with most rows, some small ones, a null group, ties in the order and nulls in the values."""
    r = random.Random(seed)
    return [(r.choice(["hot"] * 8 + ["a", "b", "z", None]), r.randrange(n), r.choice([None, 0, 1, 5, -3])) for _ in range(n)]


def test_a_group_lies_in_several_ranges(many_ranges):
    df = many_ranges.createDataFrame(grouped(1), "g string, o long, n long")
    found = ranges(df, "g", "o")
    parts = {r[RANGE]: (r["low"], r["high"]) for r in found.filter("g = 'hot'").groupBy(RANGE).agg({"o": "min"}).withColumnRenamed("min(o)", "low").join(found.filter("g = 'hot'").groupBy(RANGE).agg({"o": "max"}).withColumnRenamed("max(o)", "high"), RANGE).collect()}
    assert len(parts) >= 4 and all(parts[a][1] <= parts[b][0] for a, b in zip(sorted(parts), sorted(parts)[1:]))


def test_running_totals_by_hand(many_ranges):
    rows = [(g, 2 * k, n) for k, (g, _, n) in enumerate(grouped(2))]
    df = many_ranges.createDataFrame(rows, "g string, o long, n long").repartition(5)
    so_far, want = {}, []
    for g, o, n in rows:
        so_far[g] = n if so_far.get(g) is None else so_far[g] + (n or 0)
        want.append((g, o, n, so_far[g]))
    assert sorted(map(tuple, running_totals(df, "g", "o", ["n"]).collect()), key=str) == sorted(want, key=str)
    assert running_totals(df.limit(0), "g", "o", ["n"]).count() == 0


def test_maximum_of_the_rows_before(many_ranges):
    rows = [(g, k, n) for k, (g, _, n) in enumerate(grouped(3, 700))]
    df = ranges(many_ranges.createDataFrame(rows, "g string, o long, n long"), "g", "o")
    best, want = {}, []
    for g, o, n in rows:
        want.append((g, o, best.get(g)))
        best[g] = max((x for x in (best.get(g), n) if x is not None), default=None)
    found = running(df, "g", ["o"], current=False, top=("max", "n"))
    assert sorted(map(tuple, found.select("g", "o", "top").collect()), key=str) == sorted(want, key=str)


def test_equal_rows_are_dealt_out(many_ranges):
    df = many_ranges.createDataFrame([("g", 1, 1)] * 1000, "g string, o long, n long")
    assert ranges(df, "g", "o").select(RANGE).distinct().count() >= 4
    assert sorted(r["total_n"] for r in running_totals(df, "g", "o", ["n"]).collect()) == list(range(1, 1001))


def test_merged_ranges_of_one_large_group(many_ranges):
    r = random.Random(5)
    spans = [(r.choice(["hot"] * 9 + ["a", None]), s := r.randrange(9000), s + r.choice([0, 1, 2, 5, 20]), r.random() < 0.1) for _ in range(1500)] + [("hot", -1, 4, True), ("hot", 5, 3, True), ("hot", 0, 1, False), ("hot", 0, 1, True), ("wide", 0, 9000, False), ("wide", 5, 6, True)]
    want = []
    for g in {x[0] for x in spans}:
        now = None
        for s, e, strong in sorted(x[1:] for x in spans if x[0] == g and x[1] >= 0 and x[2] > x[1]):
            if now and s <= now[1]:
                now = [now[0], max(now[1], e), now[2] or strong]
            else:
                want += [(g, *now)] if now else []
                now = [s, e, strong]
        want += [(g, *now)] if now else []
    df = many_ranges.createDataFrame(spans, "id string, start long, end long, strong boolean").repartition(4)
    assert sorted(map(tuple, merge_ranges(df).select("id", "start", "end", "strong").collect()), key=str) == sorted(want, key=str)
    assert merge_ranges(df.limit(0)).count() == 0


def whole_table(u, v):
    """The walk back through the whole table."""
    n, m = len(u), len(v)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            best[i][j] = best[i - 1][j - 1] + 1 if u[i - 1] == v[j - 1] else max(best[i - 1][j], best[i][j - 1])
    pairs, i, j = [], n, m
    while i and j:
        if u[i - 1] == v[j - 1]:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif best[i - 1][j] >= best[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return pairs[::-1], best[n][m]


def test_alignment_keeps_the_ties_of_the_whole_table():
    r = random.Random(7)
    for n, letters in [(k, "ab") for k in range(12)] + [(60, "abcd"), (90, "ab"), (300, "abcdefgh")] * 4:
        u, v = ([r.choice(letters) for _ in range(r.randint(0, n))] for _ in range(2))
        assert align.common(u, v) == whole_table(u, v)


def test_alignment_of_long_texts_in_bounded_memory():
    r = random.Random(8)
    u = [f"w{r.randrange(4000)}" for _ in range(20_000)]
    v = [x if r.random() < 0.9 else "other" for x in u]
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    pairs, n = align.common(u, v)
    assert n == len(pairs) >= sum(a == b for a, b in zip(u, v)) and all(u[i] == v[j] for i, j in pairs)
    # The whole table would take 1600 MB.
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000 and time.time() - began < 60
