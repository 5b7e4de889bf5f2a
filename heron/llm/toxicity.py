"""Toxicity scores from a lexicon matched by Levenshtein automata.

The lexicon is learned from a bounded sample of labelled rows: words and word stems that mark the
toxic ones, chosen by greedy cover so that the rare words of one copied text are not taken for
insults. A trie of the terms is intersected with the Levenshtein automata of all terms at once: a
state is the set of (trie node, errors) that a word's prefix can reach, and states and transitions
are built when first met. Every hit is read in a window of words around it: quotation marks or
words of reporting make it a quoted hit. Each (term, exact or misspelled, plain or quoted) has the
share of toxic rows among the labelled rows that hold it, and a text's score joins these.

Cases: a null or empty text has no hit and gets the score of texts without hits; an empty label
table gives an empty lexicon and score 0 everywhere; several labels of one doc_id count as the
highest; every row is scored by its own text, so repeated rows and ties get equal scores; labels,
lang, source and doc_id are never inputs of a score; extra columns of any name are carried by
filter_toxic() and ignored elsewhere.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heron.llm.columns import whole
from heron.plans.session import table

#: Bound of the labelled rows that the lexicon is learned from.
SAMPLE = 8000
#: Bounds of the terms that the cover chooses from, and of the lexicon.
CANDIDATES = 20_000
MAX_TERMS = 200
STEMS = (4, 5, 6, 7)
#: Shorter terms must match exactly; one error is let pass from here on.
FUZZY_FROM = 5
CONTEXT = 6
#: Words of reporting; fixed values.
REPORTING = frozenset("said says called calls calling quote quoted quotes wrote writes word words term dit écrit mot appelé sagte schrieb wort nannte dijo escribió palabra llamó".split())
MARKS = "\"'“”„«»‘’`"
CACHE = 400_000
_WORD = re.compile(r"[^\W\d_]+")


class Automaton:
    """All terms' Levenshtein automata of one error, intersected with the terms' trie and determinised on demand."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        for k, (text, _) in enumerate(terms):
            node = 0
            for c in text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                node = self.children[node][c]
            self.ends[node].append(k)
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.start = self._state({(0, 0)})

    def _state(self, found: set[tuple[int, int]]) -> int:
        """The state's number, or -1 for the empty one; skipping a term's letter is an error that needs no input."""
        found = set(found) | {(c, 1) for n, e in found if e == 0 for c in self.children[n].values()}
        key = frozenset(found)
        if not key:
            return -1
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        out = set()
        for n, e in self.sets[state]:
            if c in self.children[n]:
                out.add((self.children[n][c], e))
            if e == 0:
                out.add((n, 1))
                out |= {(x, 1) for x in self.children[n].values()}
        self.moves[state][c] = nxt = self._state(out)
        return nxt

    def match(self, word: str) -> tuple[int, int] | None:
        """The best (term, errors) for a word: whole terms within one error, stems exactly at the word's start."""
        state, best = self.start, None
        for c in word:
            nxt = self.moves[state].get(c)
            state = self._move(state, c) if nxt is None else nxt
            if state < 0:
                return best
            for n, e in self.sets[state] if best is None else ():
                if e == 0:
                    best = next(((k, 0) for k in self.ends[n] if self.terms[k][1]), best)
        for n, e in sorted(self.sets[state], key=lambda x: x[1]):
            for k in self.ends[n]:
                if not self.terms[k][1] and (e == 0 or len(self.terms[k][0]) >= FUZZY_FROM) and (best is None or e < best[1]):
                    best = (k, e)
        return best


class Scorer:
    """Hits and scores of texts; a bounded cache holds what each token matched."""

    def __init__(self, terms: list[tuple[str, bool]], weights: dict[tuple[int, int, int], float], base: float):
        self.automaton, self.weights, self.base, self.cache = Automaton(terms), weights, base, {}

    def _token(self, token: str) -> tuple:
        if len(self.cache) > CACHE:
            self.cache.clear()
        found = tuple(m for w in _WORD.findall(token) if (m := self.automaton.match(w)))
        self.cache[token] = found
        return found

    def hits(self, text: str | None) -> dict[tuple[int, int, int], int]:
        """(term, errors, quoted) -> count."""
        words = (text or "").lower().split()
        cache = self.cache
        if not any([cache[w] if w in cache else self._token(w) for w in set(words)]):
            return {}
        out: Counter = Counter()
        for i, w in enumerate(words):
            for k, e in cache[w] if w in cache else self._token(w):
                out[k, e, int(self._quoted(words, i))] += 1
        return out

    def _quoted(self, words: list[str], i: int) -> bool:
        if words[i][0] in MARKS and words[i].rstrip(".,;:!?")[-1] in MARKS:
            return True
        before, after = words[max(0, i - CONTEXT) : i + 1], words[i : i + CONTEXT + 1]
        if any(w.strip(".,;:!?" + MARKS) in REPORTING for w in before[:-1]):
            return True
        opened = next((w for w in reversed(before) if w[0] in MARKS or w.rstrip(".,;:!?")[-1:] in MARKS), "")
        return bool(opened) and opened[0] in MARKS and any(w.rstrip(".,;:!?")[-1:] in MARKS for w in after)

    def score(self, hits: dict[tuple[int, int, int], int]) -> float:
        left = 1 - self.base
        for key in hits:
            left *= 1 - self.weights.get(key, 0.0)
        return min(1.0, max(0.0, 1 - left))


def held_out(column) -> F.Column:
    return F.coalesce(F.crc32(column.cast("string")) % 5 == 0, F.lit(False))


def sample_labels(labels: DataFrame, size: int) -> DataFrame:
    """At most size rows (doc_id, toxic) for learning, none of the held-out ones."""
    one = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    one = one.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)


def _terms_of(text: str) -> set[tuple[str, bool]]:
    words = set(_WORD.findall(text.lower()))
    out = {(w, False) for w in words if len(w) > 3}
    for n in STEMS:
        out |= {(w[:n], True) for w in words if len(w) >= n}
    return out


def _count_terms(batches):
    """Term counts by label, summed within the task before they are sent on."""
    pos, neg = Counter(), Counter()
    for b in batches:
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            (pos if toxic else neg).update(_terms_of(text))
    keys = list(pos.keys() | neg.keys())
    yield pa.RecordBatch.from_pydict({
        "term": pa.array([k[0] for k in keys], pa.string()), "stem": pa.array([k[1] for k in keys], pa.bool_()),
        "pos": pa.array([pos[k] for k in keys], pa.int64()), "neg": pa.array([neg[k] for k in keys], pa.int64()),
    })


def _incidence(terms: set[tuple[str, bool]]):
    def run(batches):
        for b in batches:
            rows = [(h, t, s) for h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for t, s in _terms_of(text) & terms]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.bool_()))], ["h", "term", "stem"]
            )

    return run


def cover(pairs: list[tuple[int, tuple[str, bool]]], neg: dict[tuple[str, bool], int], least: float, most: int = MAX_TERMS) -> list[tuple[str, bool]]:
    """Greedy cover of the toxic texts by terms; a text counts half as much with each term that it already has."""
    texts = defaultdict(set)
    for h, term in pairs:
        texts[term].add(h)
    weight: dict[int, float] = defaultdict(lambda: 1.0)
    chosen: list[tuple[str, bool]] = []
    while texts and len(chosen) < most:
        gain = {t: sum(weight[h] for h in hs) - 3 * neg.get(t, 0) for t, hs in texts.items()}
        best = max(gain, key=lambda t: (gain[t], not t[1], len(t[0]), t[0]))
        if gain[best] < least:
            break
        chosen.append(best)
        for h in texts.pop(best):
            weight[h] /= 2
        related = [t for t in texts if (best[1] and t[0].startswith(best[0])) or (t[1] and best[0].startswith(t[0]))]
        for t in related:
            del texts[t]
    return chosen


def learn(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> dict:
    """The lexicon and its weights, as plain values; everything on the driver is bounded by size."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(sample_labels(labels, size)), "doc_id")
    # Copies of a text would count its rare words many times.
    seen = rows.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).cache()
    try:
        n_pos, n = seen.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
        if not n_pos:
            return {"terms": [], "weights": {}, "base": 0.0}
        least = max(2.0, 0.004 * n_pos)
        # What a term gains falls with each choice, so those that start under the least are never chosen.
        counted = (
            seen.select("text", "toxic").mapInArrow(_count_terms, "term string, stem boolean, pos long, neg long")
            .groupBy("term", "stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
            .filter((F.col("pos") >= 3) & (F.col("neg") * 10 <= F.col("pos")) & (F.col("pos") - 3 * F.col("neg") >= least))
            .orderBy(F.desc(F.col("pos") - 3 * F.col("neg")), "term", "stem").limit(CANDIDATES)
        )
        neg = {(r["term"], r["stem"]): r["neg"] for r in counted.collect()}
        pairs = [
            (r["h"], (r["term"], r["stem"]))
            for r in seen.filter("toxic = 1").select("h", "text").mapInArrow(_incidence(set(neg)), "h long, term string, stem boolean").collect()
        ]
        terms = cover(pairs, neg, least)
        held = Counter()
        toxic = Counter()
        for r in seen.select("text", "toxic").mapInArrow(_hit_rows(terms), "toxic int, kinds array<int>").collect():
            kinds = {tuple(r["kinds"][i : i + 3]) for i in range(0, len(r["kinds"]), 3)}
            # A weak kind is judged where no stronger one explains the label.
            strong = {k for k in kinds if k[1:] == (0, 0)}
            for k in strong or kinds or {()}:
                held[k] += 1
                toxic[k] += r["toxic"]
        rate = n_pos / n
        base = toxic[()] / held[()] if held[()] else rate
        weights = {}
        for k in range(len(terms)):
            for e in (0, 1):
                for q in (0, 1):
                    prior = (0.9 if e == 0 else 0.6) * (1 if q == 0 else 0.5)
                    weights[k, e, q] = (toxic[k, e, q] + 2 * prior) / (held[k, e, q] + 2)
        return {"terms": terms, "weights": weights, "base": min(0.4, base)}
    finally:
        seen.unpersist()


def _hit_rows(terms):
    def run(batches):
        scorer = Scorer(terms, {}, 0.0)
        for b in batches:
            kinds = [[x for key in scorer.hits(t) for x in key] for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1).cast(pa.int32()), pa.array(kinds, pa.list_(pa.int32()))], ["toxic", "kinds"])

    return run


def _score_batches(model: dict):
    def run(batches):
        scorer = Scorer(model["terms"], model["weights"], model["base"])
        for b in batches:
            found = [scorer.hits(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), pa.array([scorer.score(h) for h in found], pa.float64()), pa.array([sum(h.values()) for h in found], pa.int64()),
                 pa.array([sum(c for k, c in h.items() if k[2]) for h in found], pa.int64())],
                ["row", "score", "n_hits", "n_quoted"],
            )

    return run


def score(docs: DataFrame, model: dict, *without: str) -> DataFrame:
    """row (the columns of docs but some), score, n_hits and n_quoted; a narrow step."""
    rows = docs.select(whole(docs, *without), F.col("text").cast("string").alias("text"))
    out = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("n_hits", T.LongType()), T.StructField("n_quoted", T.LongType())])
    return rows.mapInArrow(_score_batches(model), out)


def toxicity(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, n_hits and n_quoted of each document."""
    scored = score(docs.select("doc_id", "text"), learn(docs, labels, size), "text")
    return scored.select(
        "row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits", "n_quoted"
    )


def filter_toxic(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """The rows of docs with a score under 0.5, with their own columns; no join."""
    return score(docs, learn(docs, labels, size)).filter("score < 0.5").select("row.*")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
