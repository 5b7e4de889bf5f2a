"""Packing of tokenised documents into sequences by bin completion.

Only lengths matter for packing, and there are at most CAPACITY of them, so the instance is a
histogram of at most CAPACITY counters however many documents there are. Its solution is a list of
patterns (a filling of one sequence, and how often it is used), found by branch and bound: take the
largest length left, enumerate all undominated fillings of the room beside it in the order of their
waste, use a filling as often as the counts allow, or less often, and go on; a branch ends where the
sequences so far and the bound of the rest reach the best solution known, or where its waste does.
Best fit decreasing gives the first incumbent and completes each state. Before the search turns back
anywhere, it dives to the end several times: lengths above a threshold take the filling that best fit
would, lengths below it the undominated one of least waste, each as often as the counts allow; a dive
ends where its waste allows no better solution. Dives take STEPS patterns at most, for up to 17
thresholds, and the search then looks at WORK fillings over the number of lengths; then the best
solution stands. Documents then take their places by their rank within their
length, which is counted per partition and summed over partitions, so no length is gathered in one
task.

Cases: a null or empty text is one piece with the end id alone; rows with equal ids or texts are
packed each; ties between pieces of one length are broken by partition and row order; an empty
table gives no pieces; texts of any length are cut at CAPACITY; extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heron.plans.session import cut, table

CAPACITY = 4096
END_ID = 1
#: Bound of a task's word cache and of the characters of the texts that are split into words at a time.
CACHE, SPLIT = 500_000, 500_000
#: Bounds of the driver's work: patterns of all dives, and fillings that branch and bound looks at, times the number of lengths, of which it looks at NODES at most.
STEPS, WORK, NODES = 20_000, 400_000, 5000
#: Shares of the pieces below the thresholds of dives, in the order in which they are tried.
BELOW = (1, 0, *(k / n for n in (2, 4, 8, 16) for k in range(1, n, 2)))
#: Bound of the branches that are open at a time, each with the sums that its lengths can make: at most 2 MB.
DEPTH = 48
#: ASCII marks that the vocabulary keeps together as one run.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, k long"


class WordTokens:
    """Token ids of texts as little-endian 32-bit bytes, word by word.

    The vocabulary's pre-tokenizer drops white space and never joins over it, so a text's ids are
    those of its words in turn; a bounded cache holds each word's ids.
    """

    def __init__(self, path: str | None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        #: Texts that hold an added token, which can stand inside a word, are encoded whole; the vocabulary matches them in the text as it is.
        self.added = {x.content for x in self.tokenizer.get_added_tokens_decoder().values()}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        """Empty the cache: a worker lives on after its tasks, also in stages that do not need it."""
        self.cache: dict[str, bytes] = {"": b""}

    def _encode(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """The ids of words of letters, encoded as one text that is split where a token ends a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            # Some letter is split by the vocabulary's normal form.
            return self._encode(words)
        data, at = ids.tobytes(), [0, *(ends * 4).tolist()]
        return [data[i:j] for i, j in zip(at, at[1:], strict=False)]

    def _learn(self, words: set[str]) -> None:
        """Words of letters are encoded together; letters before a run of marks are the letters' ids and the marks'."""
        cache = self.cache
        plain = [w for w in words if w.isalpha()]
        forms, letters, other = [], set(), set()
        for w in words.difference(plain):
            stem = w.rstrip(_MARKS)
            if stem.isalpha():
                letters.add(stem)
                other.add(w[len(stem) :])
                forms.append((w, stem, w[len(stem) :]))
            else:
                other.add(w)
        plain += letters.difference(cache, plain)
        other = list(other.difference(cache))
        if plain:
            cache.update(zip(plain, self._letters(plain), strict=True))
        if other:
            cache.update(zip(other, self._encode(other), strict=True))
        for w, stem, mark in forms:
            cache[w] = cache[stem] + cache[mark]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each whole text."""
        # Added tokens, and separators that str.split() takes for white space and the vocabulary does not.
        whole = (*"\x1c\x1d\x1e\x1f", *self.added)
        odd = [any(c in t for c in whole) for t in texts]
        split = [[] if o else t.split() for t, o in zip(texts, odd, strict=True)]
        if len(self.cache) > CACHE:
            self.forget()
        self._learn(set().union(*split).difference(self.cache))
        got = self.cache.__getitem__
        return [self._encode([t])[0] if o else b"".join(map(got, s)) for t, s, o in zip(texts, split, odd, strict=True)]


@lru_cache(maxsize=1)
def _tokens(path: str | None) -> WordTokens:
    """One for all tasks of a worker."""
    return WordTokens(path)


def groups(ids, texts, most: int) -> Iterator[tuple[list, list[str]]]:
    """Runs of ids and texts from Arrow columns, of at most so many characters together, or of one text."""
    some, held, size = [], [], 0
    for doc_id, text in zip(ids, texts, strict=True):
        text = text.as_py() or ""
        if held and size + len(text) > most:
            yield some, held
            some, held, size = [], [], 0
        some.append(doc_id.as_py())
        held.append(text)
        size += len(text)
    if held:
        yield some, held


def _pieces(path: str | None, capacity: int):
    def run(batches):
        tokens, part, ranks = _tokens(path), TaskContext.get().partitionId(), Counter()
        end = np.array([END_ID], "<u4").tobytes()
        for b in batches:
            for ids, some in groups(b.column(0), b.column(1), SPLIT):
                rows = []
                for doc_id, data in zip(ids, tokens.encode(some), strict=True):
                    data += end
                    for n, start in enumerate(range(0, len(data), 4 * capacity)):
                        piece = data[start : start + 4 * capacity]
                        size = len(piece) // 4
                        rows.append((doc_id, n, start // 4, size, zlib.crc32(piece), part, ranks[size]))
                        ranks[size] += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in _PIECES.split(", ")])
        tokens.forget()

    return run


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of each document's ids, with their rank (part, k) among the pieces of their length."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_pieces(path, capacity), _PIECES)


Filling = tuple[tuple[int, int], ...]
Pattern = tuple[int, Filling]


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit decreasing over a histogram: equal sequences are one group, so the groups stay few."""
    groups: dict[int, list[tuple[int, dict[int, int]]]] = {}  # room left -> (times, filling)
    rooms: list[int] = []

    def add(room: int, times: int, filling: dict[int, int]) -> None:
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((times, filling))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left and (at := bisect_left(rooms, size)) < len(rooms):
            room = rooms[at]
            times, filling = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[at]
            used = min(left, times)
            left -= used
            if used < times:
                add(room, times - used, filling)
            add(room - size, used, {**filling, size: filling.get(size, 0) + 1})
        each = capacity // size
        if left >= each:
            add(capacity - each * size, left // each, {size: each})
        if left % each:
            add(capacity - left % each * size, 1, {size: left % each})
    return [(times, tuple(sorted(filling.items(), reverse=True))) for same in groups.values() for times, filling in same]


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing of the counted lengths needs: pieces over half stand alone, and what the rest does not find beside them needs more."""
    n, size = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * np.arange(capacity + 1))])
    half = capacity // 2
    small = np.arange(half + 1)
    # For each bound of what counts as small: pieces too large for any of it, those over half, and the rest from the bound on.
    alone, halves = n[-1] - n[capacity - small + 1], n[capacity - small + 1] - n[half + 1]
    beside = halves * capacity - (size[capacity - small + 1] - size[half + 1])
    rest = size[half + 1] - size[small]
    return int((alone + halves + np.maximum(0, -(-(rest - beside) // capacity))).max())


def _sums(sizes: list[int], most: list[int], room: int) -> list[int]:
    """For each place in sizes, the sums up to room that the sizes from there on can make, as bits."""
    full, out = (1 << room + 1) - 1, [1]
    for s, n in zip(reversed(sizes), reversed(most), strict=True):
        bits, step, n = out[-1], 1, min(n, room // s)
        while n:
            take = min(step, n)
            bits |= bits << take * s & full
            n, step = n - take, step * 2
        out.append(bits)
    return out[::-1]


def dominated(filling: Filling, sizes: list[int], most: list[int], waste: int) -> bool:
    """Whether one piece outside the filling can join it, or take the place of a smaller one or of several inside."""
    # Sums of one piece, of several, and of any number, as bits.
    single, multiple, sums = 0, 0, 1
    for s, n in filling:
        single |= 1 << s
        for _ in range(n):
            multiple |= multiple << s | (sums & ~1) << s
            sums |= sums << s
    used, outside = dict(filling), 0
    for s, n in zip(sizes, most, strict=True):
        outside |= (n > used.get(s, 0)) << s
    return any((multiple << by | ((single | 1) << by if by else 0)) & outside for by in range(waste + 1))


def fillings(sizes: list[int], most: list[int], room: int, waste: int) -> Iterator[tuple[Filling | None, int]]:
    """The undominated fillings of the room with their waste, least waste first, larger pieces first; None for each dominated one."""
    reach = _sums(sizes, most, room)
    for lost in range(min(waste, room) + 1):
        goal = room - lost
        if not reach[0] >> goal & 1:
            continue
        if not lost and goal in sizes:
            # One piece that fills the room is better than all other fillings.
            yield ((goal, 1),), lost
            return
        # Depth first through the sizes, only where what is left of the goal can still be made.
        stack: list[tuple[int, int, Filling]] = [(0, goal, ())]
        while stack:
            at, left, chosen = stack.pop()
            if not left:
                yield (None if dominated(chosen, sizes, most, lost) else chosen), lost
                continue
            if at == len(sizes):
                continue
            s, to = sizes[at], []
            for n in range(min(most[at], left // s) + 1):
                if reach[at + 1] >> left - n * s & 1:
                    to.append((at + 1, left - n * s, (*chosen, (s, n)) if n else chosen))
            stack += to


def dive(counts: dict[int, int], capacity: int, above: int, waste: int, steps: int) -> tuple[list[Pattern] | None, int]:
    """One walk to the end that never turns back, and its steps; None where it loses more than the waste or takes more than the steps.

    The largest length left takes the filling of the largest pieces that fit if it is above the
    threshold, else the undominated filling of least waste, and that as often as the counts allow.
    """
    left, out = dict(sorted(counts.items(), reverse=True)), []
    while left:
        if len(out) == steps:
            return None, steps
        largest = next(iter(left))
        left[largest] -= 1
        room, pattern = capacity - largest, Counter({largest: 1})
        sizes = [s for s, n in left.items() if n and s <= room]
        if largest > above:
            for s in sizes:
                if n := min(left[s], room // s):
                    pattern[s] += n
                    room -= n * s
        else:
            filling, room = next(x for x in fillings(sizes, [left[s] for s in sizes], room, room) if x[0] is not None)
            pattern.update(dict(filling))
        left[largest] += 1
        times = min(left[s] // c for s, c in pattern.items())
        waste -= room * times
        if waste < 0:
            return None, len(out)
        for s, c in pattern.items():
            left[s] -= c * times
            if not left[s]:
                del left[s]
        out.append((times, tuple(sorted(pattern.items(), reverse=True))))
    return out, len(out)


def dives(counts: dict[int, int], capacity: int, best: list[Pattern], floor: int, steps: int) -> list[Pattern]:
    """The best of a solution and those of dives from several thresholds."""
    total, fewest = sum(s * n for s, n in counts.items()), sum(t for t, _ in best)
    sizes = sorted(counts)
    ends = np.cumsum([counts[s] for s in sizes])
    tried = set()
    for share in BELOW:
        above = sizes[min(len(sizes) - 1, int(np.searchsorted(ends, share * ends[-1])))] if share else 0
        if fewest == floor or steps <= 0 or above in tried:
            continue
        tried.add(above)
        found, used = dive(counts, capacity, above, (fewest - 1) * capacity - total, steps)
        steps -= used
        if found is not None and sum(t for t, _ in found) < fewest:
            best, fewest = found, sum(t for t, _ in found)
    return best


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES, depth: int = DEPTH) -> list[Pattern]:
    """Patterns that hold every counted piece once, in as few sequences as branch and bound finds.

    Dives come first. A branch then takes the largest length left with an undominated filling of its sequence, as often as
    the counts allow or less often; best fit decreasing completes each state to a solution. A state
    that was reached with as few sequences before, or that the bound shows to be no better than the
    best solution, is left. Below depth open branches only best fit goes on; after nodes fillings the
    best solution stands.
    """
    full = counts.get(capacity, 0)
    counts = {s: n for s, n in counts.items() if s < capacity and n}
    whole = [(full, ((capacity, 1),))] if full else []
    if not counts:
        return whole
    start = np.zeros(capacity + 1, np.int64)
    for s, n in counts.items():
        start[s] = n
    total, floor = sum(s * n for s, n in counts.items()), lower_bound(start, capacity)
    best = dives(counts, capacity, best_fit(counts, capacity), floor, STEPS)
    nodes = min(nodes, WORK // len(counts))
    fewest, opened, path = sum(t for t, _ in best), 0, []
    seen: dict[bytes, int] = {}

    def branches(left: np.ndarray, used: int, rest: int):
        nonlocal opened
        present = np.flatnonzero(left)[::-1].tolist()
        largest = present[0]
        now = left.copy()
        now[largest] -= 1
        sizes = [s for s in present if now[s] and s <= capacity - largest]
        # What all sequences may lose together, if the solution is to be better than the best one.
        allowed = (fewest - 1 - used) * capacity - rest
        for filling, lost in fillings(sizes, [int(now[s]) for s in sizes], capacity - largest, max(0, allowed)):
            opened += 1
            if opened > nodes:
                return
            if filling is None or lost > (fewest - 1 - used) * capacity - rest:
                continue
            pattern = Counter({largest: 1})
            pattern.update(dict(filling))
            for times in range(min(int(left[s]) // c for s, c in pattern.items()), 0, -1):
                yield times, pattern
                if opened > nodes:
                    return

    iterators, states = [branches(start, 0, total)], [(start, 0, total)]
    while iterators and fewest > floor and opened <= nodes:
        step = next(iterators[-1], None)
        if step is None:
            iterators.pop(), states.pop()
            if path:
                path.pop()
            continue
        opened += 1
        times, pattern = step
        left, used, rest = states[-1]
        left, used = left.copy(), used + times
        for s, c in pattern.items():
            left[s] -= c * times
        rest -= times * sum(s * c for s, c in pattern.items())
        if used + lower_bound(left, capacity) >= fewest or seen.get(key := blake2b(left.tobytes(), digest_size=16).digest(), fewest) <= used:
            continue
        if len(seen) < nodes:
            seen[key] = used
        chosen = (times, tuple(sorted(pattern.items(), reverse=True)))
        completed = best_fit({int(s): int(left[s]) for s in np.flatnonzero(left)}, capacity)
        if used + sum(t for t, _ in completed) < fewest:
            best, fewest = [*path, chosen, *completed], used + sum(t for t, _ in completed)
        if len(states) == depth:
            continue
        path.append(chosen)
        states.append((left, used, rest))
        iterators.append(branches(left, used, rest))
    return whole + best


def places(patterns: list[Pattern]) -> dict[int, list[tuple[int, int, int, int]]]:
    """Length -> (first rank, first sequence, copies in a sequence, offset of the first copy), by rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: Counter = Counter()
    sequence = 0
    for times, filling in patterns:
        offset = 0
        for size, copies in filling:
            out.setdefault(size, []).append((ranks[size], sequence, copies, offset))
            ranks[size] += times * copies
            offset += size * copies
        sequence += times
    return out


def _place(lookup: dict[int, list[tuple[int, int, int, int]]]):
    tables = {size: np.array(rows, np.int64) for size, rows in lookup.items()}

    def run(batches):
        for b in batches:
            size, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                on, rows = np.flatnonzero(size == s), tables[int(s)]
                row = rows[np.searchsorted(rows[:, 0], rank[on], "right") - 1]
                slot = rank[on] - row[:, 0]
                sequence[on] = row[:, 1] + slot // row[:, 2]
                offset[on] = row[:, 3] + slot % row[:, 2] * s
            keep = [b.column(n) for n in b.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], [*(n for n in b.schema.names if n != "rank"), "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece."""
    cuts = cut(pieces(docs, path, capacity), "pieces")
    by_part = cuts.groupBy("part", "length").agg(F.count("*").alias("n"))
    # At most capacity rows come to the driver.
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    lookup = places(bin_completion(counts, capacity))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    first = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = cuts.join(first, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("k")).alias("rank"))
    return ranked.mapInArrow(_place(lookup), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
