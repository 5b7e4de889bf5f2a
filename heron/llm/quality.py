"""Quality rules by weak supervision.

Each rule votes good (+1), bad (-1) or abstains (0) on a document's text statistics. A two-class
naive Bayes mixture over the votes is fitted by expectation-maximisation, without labels: the fit
needs only how many documents have each vote pattern, at most 3 ** len(RULES) counters however
large the corpus is. The posterior probability of "good" then decides, instead of all rules having
to pass.

Cases: a null or empty text has no words, so it fails the base rules; an empty table gives an empty
result; documents with equal votes get equal posteriors, repeated rows among them; null ids are kept
as they are; extra columns of any name are ignored by quality() and kept by filter_quality().
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heron.llm.columns import whole
from heron.plans.session import cut, table

#: White space that parts words, and the characters counted as symbols.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Common function words of the four languages, for the function-word rule.
FUNCTION_WORDS = frozenset(
    "the of and to in is that for it as with was on be at by this are from or an not "
    "de la le et les des en un du une que est pour qui dans par sur au avec pas "
    "der die und den von das mit sich dem ein nicht für auf eine zu im ist "
    "el los del se las por con no su para al lo como más".split()
)
WINDOW = 5
#: The counts of features(), in its order; the first BASE are those of the base rules.
NAMES = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_upper n_pipe n_shout n_function n_sentences".split()
BASE = 5
_WORD = re.compile(f"[^{re.escape(SPACE)}]+")


def repeat_words(words: list[str]) -> int:
    """How many words lie in five-word windows that the text holds twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    if len(set(windows)) == n:
        return 0
    seen, total, end = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + WINDOW - max(i, end)
            end = i + WINDOW
    return total


def features(text: str | None) -> tuple[int, ...]:
    """The counts of one whole text, in the order of NAMES."""
    text = text or ""
    words = _WORD.findall(text)
    lines, seen, dup = 0, set(), 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            lines += 1
            dup += line in seen
            seen.add(line)
    return (
        len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), dup, repeat_words(words), lines,
        sum(map(str.isupper, words)), words.count("|"), text.count("!!"),
        sum(map(FUNCTION_WORDS.__contains__, map(str.lower, words))),
        text.count(". ") + text.count(".\n") + text.count("? ") + text.count("! ") + text.rstrip(SPACE).endswith((".", "?", "!")),
    )


def _batches(batches):
    kind = None
    for b in batches:
        rows = [features(t) for t in b.column("text").to_pylist()]
        kind = kind or pa.struct([pa.field(n, pa.int64()) for n in NAMES])
        stats = pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(NAMES))], fields=list(kind))
        yield pa.RecordBatch.from_arrays([b.column("row"), stats], ["row", "stats"])


def text_features(docs: DataFrame, *without: str) -> DataFrame:
    """row, all columns of docs but some, and stats, the counts of each whole text; a narrow step, without a shuffle."""
    rows = docs.select(whole(docs, *without), F.col("text").cast("string").alias("text"))
    out = T.StructType([rows.schema["row"], T.StructField("stats", T.StructType([T.StructField(n, T.LongType()) for n in NAMES]))])
    return rows.mapInArrow(_batches, out)


def _n(name: str):
    return F.col("stats")[name]


def _share(a: str, b: str = "n_words"):
    return _n(a) / F.greatest(_n(b), F.lit(1))


def _vote(bad, good):
    return F.when(bad, -1).when(good, 1).otherwise(0)


#: Rule name -> vote as a column over text_features().
RULES = {
    "symbols": lambda: _vote(_share("n_symbols") > 0.3, _share("n_symbols") < 0.05),
    "shouting": lambda: _vote(_share("n_upper") > 0.3, _share("n_upper") < 0.1),
    "exclaims": lambda: _vote(_share("n_shout") > 0.1, _share("n_shout") < 0.01),
    "tables": lambda: _vote(_share("n_pipe") > 0.15, _share("n_pipe") < 0.02),
    "function_words": lambda: _vote(_share("n_function") < 0.03, _share("n_function") > 0.1),
    "sentences": lambda: _vote(_share("n_sentences") < 0.01, _share("n_sentences").between(0.02, 0.34)),
    "dup_lines": lambda: _vote(_share("n_dup_lines", "n_lines") > 0.3, _n("n_dup_lines") == 0),
    "repeats": lambda: _vote(_share("n_repeat_words") > 0.1, _n("n_repeat_words") == 0),
    "word_length": lambda: _vote(~_share("word_chars").between(2.5, 12), _share("word_chars").between(3, 9)),
}


def fit(patterns: dict[tuple[int, ...], int], rounds: int = 100, prior: float = 0.8) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """EM over vote patterns: the share of good documents, and for each rule vote -> (P(vote|good), P(vote|bad))."""
    total = sum(patterns.values())
    m = len(next(iter(patterns), ()))
    rows = [{1: (0.8, 0.4), 0: (0.15, 0.2), -1: (0.05, 0.4)} for _ in range(m)]
    if not total:
        return prior, rows
    for _ in range(rounds):
        good_of = {p: posterior(p, prior, rows) for p in patterns}
        good = sum(n * good_of[p] for p, n in patterns.items())
        new = []
        for j in range(m):
            counts = {v: [1.0, 1.0] for v in (1, 0, -1)}
            for p, n in patterns.items():
                counts[p[j]][0] += n * good_of[p]
                counts[p[j]][1] += n * (1 - good_of[p])
            g, b = (sum(c[k] for c in counts.values()) for k in (0, 1))
            row = {v: (c[0] / g, c[1] / b) for v, c in counts.items()}
            # A vote never counts against its own meaning, so the classes keep their names.
            row[1] = (row[1][0], min(row[1][1], row[1][0]))
            row[-1] = (row[-1][0], max(row[-1][1], row[-1][0]))
            new.append(row)
        share = min(0.99, max(0.01, good / total))
        done = abs(share - prior) < 1e-6 and max((abs(new[j][v][k] - rows[j][v][k]) for j in range(m) for v in (1, 0, -1) for k in (0, 1)), default=0) < 1e-6
        prior, rows = share, new
        if done:
            break
    return prior, rows


def posterior(pattern: tuple[int, ...], prior: float, rows: list[dict[int, tuple[float, float]]]) -> float:
    odds = math.log(prior) - math.log(1 - prior)
    for v, row in zip(pattern, rows, strict=True):
        odds += math.log(row[v][0]) - math.log(row[v][1])
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def judge(docs: DataFrame, *without: str, threshold: float = 0.5) -> DataFrame:
    """row (the columns of docs but some), stats, votes, p_good, base_failed and kept; every row is judged by its own text."""
    votes = F.array(*(r().cast("int") for r in RULES.values()))
    scored = cut(text_features(docs, *without).withColumn("votes", votes), "quality")
    base = (_n("n_words") < 10) | (100 * _n("n_repeat_words") > 20 * _n("n_words"))
    # At most 3 ** len(RULES) rows, whatever the input.
    patterns = {tuple(r["votes"]): r["count"] for r in scored.filter(~base).groupBy("votes").count().collect()}
    prior, rows = fit(patterns)
    odds = F.lit(math.log(prior) - math.log(1 - prior))
    for j, row in enumerate(rows if patterns else []):
        v = F.col("votes")[j]
        side = {k: math.log(a) - math.log(b) for k, (a, b) in row.items()}
        odds = odds + F.when(v == 1, side[1]).when(v == -1, side[-1]).otherwise(side[0])
    return (
        scored.withColumn("p_good", 1 / (1 + F.exp(-odds)))
        .withColumn("base_failed", base)
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
    )


def quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of each document, then the other counts, p_good and votes."""
    judged = judge(docs.select("doc_id", "text"), "text", threshold=threshold)
    counts = [_n(n).alias(n) for n in NAMES]
    return judged.select("row.doc_id", *counts[:BASE], "base_failed", "kept", *counts[BASE:], "p_good", "votes")


def filter_quality(docs: DataFrame) -> DataFrame:
    """The rows of docs that judge() keeps, with their own columns; no join, as the verdict travels with the row."""
    return judge(docs).filter("kept").select("row.*")


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
