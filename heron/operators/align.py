"""Sentence matching and token spans of two texts."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heron.functions.text import TOKEN, sentences, tokens

_TOKEN = re.compile(TOKEN)
SPAN = "array<struct<a_start:int,a_end:int,b_start:int,b_end:int,strong:boolean>>"


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct tokens; 0 for two empty sets."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def match_sentences(pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """(id, i, j, score): for each sentence of a, the first of the best sentences of b, where the score is at least least. pairs has id, a and b."""
    a = pairs.select("id", F.posexplode(sentences(F.col("a"))).alias("i", "s")).select("id", "i", F.array_distinct(tokens(F.col("s"))).alias("ta"))
    b = pairs.select("id", F.posexplode(sentences(F.col("b"))).alias("j", "s")).select("id", "j", F.array_distinct(tokens(F.col("s"))).alias("tb"))
    # The sentences of one pair meet, never those of different pairs.
    scored = a.join(b, "id").select("id", "i", "j", jaccard(F.col("ta"), F.col("tb")).alias("score"))
    best = scored.groupBy("id", "i").agg(F.min(F.struct((-F.col("score")).alias("k"), "j")).alias("x"))
    return best.select("id", "i", F.col("x.j").alias("j"), (-F.col("x.k")).alias("score")).filter(F.col("score") >= least)


def common(u: list[str], v: list[str]) -> tuple[list[tuple[int, int]], int]:
    """Pairs of places of a longest common subsequence of two token lists, and its length; on ties the walk back goes up in u.

    The table of lengths is filled row by row; one row in STEP is kept, and the walk back fills the
    rows between two kept ones again, so memory grows with the root of its size and time stays that of
    two fillings.
    """
    names: dict[str, int] = {}
    a, b = (np.array([names.setdefault(t, len(names)) for t in x], np.int32) for x in (u, v))
    n, m = len(a), len(b)
    step = max(16, int(n**0.5))

    def rows(row: np.ndarray, low: int, high: int):
        for i in range(low, high):
            row, above = np.zeros(m + 1, np.int32), row
            np.maximum.accumulate(np.maximum(above[1:], above[:-1] + (b == a[i])), out=row[1:])
            yield row

    kept = [np.zeros(m + 1, np.int32)]
    for low in range(0, n, step):
        for row in rows(kept[-1], low, min(n, low + step)):
            last = row
        kept.append(last)
    pairs, i, j, low, block = [], n, m, n, []
    while i and j:
        if i <= low:
            low = (i - 1) // step * step
            block = [kept[low // step], *rows(kept[low // step], low, min(n, low + step))]
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif block[i - 1 - low][j] >= block[i - low][j - 1]:
            i -= 1
        else:
            j -= 1
    return pairs[::-1], int(kept[-1][m])


def _spans(a: str, b: str, strong_share: float, strong_tokens: int) -> list[tuple]:
    """Runs of the longest common token sequence."""
    x, y = list(_TOKEN.finditer(a)), list(_TOKEN.finditer(b))
    pairs, best = common([t[0].lower() for t in x], [t[0].lower() for t in y])
    share, runs = (best / max(len(x), len(y)) if x or y else 0.0), []
    for i, j in pairs:
        if runs and runs[-1][1] == i - 1 and runs[-1][3] == j - 1:
            runs[-1][1], runs[-1][3] = i, j
        else:
            runs.append([i, i, j, j])
    return [(x[p].start(), x[q].end(), y[r].start(), y[s].end(), share >= strong_share or q - p + 1 >= strong_tokens) for p, q, r, s in runs]


def lcs_spans(df: DataFrame, a: str, b: str, strong_share: float = 0.9, strong_tokens: int = 4) -> DataFrame:
    """df with spans, the aligned runs of the two text columns; nulls count as empty. Dynamic programming is no relation, so a Pandas UDF does it."""

    @F.pandas_udf(SPAN)
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        names = ("a_start", "a_end", "b_start", "b_end", "strong")
        return pd.Series([[dict(zip(names, s, strict=True)) for s in _spans(p or "", q or "", strong_share, strong_tokens)] for p, q in zip(x, y, strict=True)])

    return df.withColumn("spans", run(F.col(a), F.col(b)))
