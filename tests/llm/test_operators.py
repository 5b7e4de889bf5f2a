"""The operators of heron.llm against brute force, round trips and hand-made cases."""

import fractions
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from heron.llm import chunks, html, neardup, packing, pieces, quality, suffix, topk, toxicity, warc

#: Names that operators use, or have used, for columns of their own.
CLASHING = (
    "score kept h n key class_id start end doc length rank _gone __stats __text __score __doc __ranges __kept row stats votes p_good gone_id gone_digest digest node "
    "ranges n_hits n_bytes d e at a b part ids sha held_out"
).split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, extra=False):
    """Documents from texts; with extra also columns whose names an operator might use itself."""
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        for c in CLASHING:
            df = df.withColumn(c, F.lit("x"))
    return df


def words(seed, n, vocabulary=5000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


ODD = [None, "", " ", "\n\t", "a", "é \x00 \x1f", "x" * 5000, "same text here", "same text here", "word " * 3000]


# 1 quality rules


def test_repeat_words_by_brute_force():
    for seed in range(60):
        r = random.Random(seed)
        w = [r.choice("abc") for _ in range(r.randint(0, 40))]
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        hit = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(5)}
        assert quality.repeat_words(w) == len(hit)


def test_quality_counts():
    n = dict(zip(quality.NAMES, quality.features("a b#\n\na b#\nÉ é"), strict=True))
    assert (n["n_words"], n["word_chars"], n["n_symbols"], n["n_dup_lines"], n["n_lines"]) == (6, 8, 2, 1, 3)
    assert quality.features(None)[0] == quality.features(" \n")[0] == 0


def test_base_counts_and_verdicts_by_brute_force(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice(["a", "b", "Ü#", "x|y", "5%", "\n", "\n a b", "\x0b"]) for _ in range(r.randint(0, 40))) for _ in range(150)] + ODD
    space, want = set(" \t\n\x0b\x0c\r"), {}
    for i, t in enumerate(texts):
        t = t or ""
        ws = "".join("\0" if c in space else c for c in t.replace("\0", "z")).split("\0")
        ws = [w for w in ws if w]
        gone, lines = set(), t.split("\n")
        for x in range(len(ws) - 4):
            if any(ws[x : x + 5] == ws[y : y + 5] for y in range(len(ws) - 4) if y != x):
                gone |= set(range(x, x + 5))
        dup = sum(1 for k, line in enumerate(lines) if set(line) - space and line in lines[:k])
        failed = len(ws) < 10 or 100 * len(gone) > 20 * len(ws)
        want[i] = (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), dup, len(gone), failed)
    df = quality.quality(docs(spark, texts))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert df.columns[:8] == names
    rows = df.collect()
    assert {x["doc_id"]: tuple(x)[1:7] for x in rows} == want
    assert not any(x["kept"] for x in rows if x["base_failed"])
    # The posterior of every document, from expectation-maximisation over the documents one by one.
    votes = [tuple(x["votes"]) for x in rows if not x["base_failed"]]
    prior, table = 0.8, [{1: (0.8, 0.4), 0: (0.15, 0.2), -1: (0.05, 0.4)} for _ in votes[0]]
    for _ in range(100):
        good = []
        for v in votes:
            g, b = prior, 1 - prior
            for x, row in zip(v, table, strict=True):
                g, b = g * row[x][0], b * row[x][1]
            good.append(g / (g + b))
        share, old = min(0.99, max(0.01, sum(good) / len(good))), (prior, table)
        prior, table = share, []
        for j in range(len(votes[0])):
            n = {x: [1 + sum(g for g, v in zip(good, votes, strict=True) if v[j] == x), 1 + sum(1 - g for g, v in zip(good, votes, strict=True) if v[j] == x)] for x in (1, 0, -1)}
            row = {x: (n[x][0] / sum(c[0] for c in n.values()), n[x][1] / sum(c[1] for c in n.values())) for x in n}
            row[1], row[-1] = (row[1][0], min(row[1])), (row[-1][0], max(row[-1]))
            table.append(row)
        if abs(prior - old[0]) < 1e-6 and all(abs(table[j][x][k] - old[1][j][x][k]) < 1e-6 for j in range(len(table)) for x in (1, 0, -1) for k in (0, 1)):
            break
    for x in rows:
        g, b = prior, 1 - prior
        for y, row in zip(x["votes"], table, strict=True):
            g, b = g * row[y][0], b * row[y][1]
        assert abs(x["p_good"] - g / (g + b)) < 1e-6 and x["kept"] == (not x["base_failed"] and x["p_good"] >= 0.5)


def test_quality_separates_junk(spark):
    good = ["The cat of the house and the dog. " + " ".join(words(i, 60)) + " is in the garden. It was on the wall." for i in range(60)]
    junk = [" ".join(w + "%%%" for w in words(i, 60)) for i in range(60, 70)]
    got = {r["doc_id"]: r["kept"] for r in quality.quality(docs(spark, good + junk + ODD, extra=True)).collect()}
    assert all(got[i] for i in range(60)) and not any(got[i] for i in range(60, 73)) and len(got) == 80
    kept = quality.filter_quality(docs(spark, good + junk, extra=True))
    assert kept.columns == docs(spark, [], extra=True).columns and {r["doc_id"] for r in kept.collect()} == set(range(60))
    assert {r["__stats"] for r in kept.collect()} == {"x"}
    assert quality.quality(docs(spark, [])).count() == 0


# 2 packing


def test_packing_places_every_piece(spark):
    texts = [" ".join(words(i, n)) for i, n in enumerate([5, 900, 2500, 40, 40, 700, 1, 333])] + ODD
    rows = packing.pack(docs(spark, texts, extra=True)).collect()
    tokens = packing.WordTokens(None)
    plain = [np.array(tokens.tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for t in texts]
    seen = {}
    for r in rows:
        part = plain[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == 4096 * r["piece"] and len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + r["length"]
    assert seen == {i: len(p) for i, p in enumerate(plain)}
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in bins.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 4096
    assert packing.pack(docs(spark, [])).count() == 0


def fewest(items, capacity):
    """Sequences of an exact search."""
    items, out = sorted(items, reverse=True), len(items)

    def go(i, bins):
        nonlocal out
        if len(bins) >= out:
            return
        if i == len(items):
            out = len(bins)
            return
        for b in set(bins):
            if b + items[i] <= capacity:
                k = bins.index(b)
                go(i + 1, [*bins[:k], b + items[i], *bins[k + 1 :]])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return out


def packed(items, capacity):
    found = packing.bin_completion({s: items.count(s) for s in items}, capacity)
    used = sorted(s for t, f in found for _ in range(t) for s, c in f for _ in range(c))
    assert used == sorted(items) and all(sum(s * c for s, c in f) <= capacity for _, f in found)
    return sum(t for t, _ in found)


def test_bin_completion_equals_exact_search():
    assert packed([10, 8, 8, 8, 7, 4, 4, 4, 3, 3], 20) == 3
    r = random.Random(3)
    for _ in range(600):
        capacity = r.choice([10, 20, 50, 1000])
        items = [r.randint(1, int(capacity * r.choice([0.5, 0.6, 0.7, 1]))) for _ in range(r.randint(8, 12))]
        found = packed(items, capacity)
        counts = np.bincount(items, minlength=capacity + 1)
        assert found == fewest(items, capacity) >= packing.lower_bound(counts, capacity) >= -(-sum(items) // capacity)


def test_fillings_are_all_that_nothing_dominates():
    r = random.Random(6)
    for _ in range(150):
        room = r.randint(1, 24)
        items = [r.randint(1, room) for _ in range(r.randint(1, 7))]
        sizes = sorted(set(items), reverse=True)
        every = {tuple(sorted((x for i, x in enumerate(items) if m >> i & 1), reverse=True)) for m in range(1 << len(items))}
        every = {x for x in every if sum(x) <= room}

        def beaten(x, every=every, items=items):
            rest = list(items)
            for s in x:
                rest.remove(s)
            parts = [tuple(s for i, s in enumerate(x) if m >> i & 1) for m in range(1 << len(x))]
            return any(sum(y) <= s and y != (s,) and sum(x) - sum(y) + s <= room for y in parts for s in rest)

        def flat(f):
            return tuple(s for s, n in f for _ in range(n))

        found = [(flat(f), lost) for f, lost in packing.fillings(sizes, [items.count(s) for s in sizes], room, room) if f is not None]
        assert [lost for _, lost in found] == sorted(room - sum(x) for x, _ in found) and len(set(found)) == len(found)
        assert {x for x, _ in found} == ({(room,)} if room in items else {x for x in every if not beaten(x)})


def test_repeated_ids_with_other_texts_are_packed_each(spark):
    rows = packing.pack(spark.createDataFrame([(1, "a b"), (1, "c d e"), (1, "a b"), (None, "x")], "doc_id long, text string")).collect()
    assert sorted(r["length"] for r in rows) == [2, 3, 3, 4] and len({(r["sequence_id"], r["offset"]) for r in rows}) == 4


def test_word_tokens_equal_the_tokenizer():
    t = packing.WordTokens(None)
    texts = [x or "" for x in ODD] + ["Don't STOP, é.É, x!! 12 a b İstanbul ΑΣ. <|endoftext|>", *(" ".join(words(i, 50)) for i in range(5))]
    assert t.encode(texts) == t._encode(texts) == t.encode(texts)


def test_added_tokens_have_the_ids_of_the_untouched_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["one <|endoftext|> two", "a<|startoftext|>b", "<|ENDOFTEXT|> <|endoftext", "x<|endoftext|><|endoftext|>y!", "<| endoftext |>"]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [637, 49407, 1237]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.WordTokens(None).encode(texts)] == want
    crc = [zlib.crc32(np.array([*w, 1], "<u4").tobytes()) for w in want]
    assert {r["doc_id"]: r["ids_crc32"] for r in packing.pack(docs(spark, texts)).collect()} == dict(enumerate(crc))


# 3 SentencePiece


def test_pieces_equal_sentencepiece():
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    p = pieces.Pieces()
    r = random.Random(5)
    texts = [x or "" for x in ODD] + ["▁a ▁▁b", "你好 🙂", "<s> </s>", "  lead", "tail  "] + ["".join(r.choice("ab the\n é\x00ing,") for _ in range(80)) for _ in range(60)]
    ids = p.encode(texts)
    assert ids == model.encode(texts) == p.encode(texts)
    assert [p.decode(i) for i in ids if i is not None] == [t.replace("▁", " ") for t in texts]


def test_encode_and_decode_frames(spark):
    back = pieces.decode(pieces.encode(docs(spark, ODD, extra=True))).collect()
    assert {r["doc_id"]: r["text"] for r in back} == {i: t or "" for i, t in enumerate(ODD)}
    assert pieces.encode(docs(spark, [])).count() == 0


# 4 chunks


def test_gear_is_a_rolling_hash():
    data = np.frombuffer(random.Random(1).randbytes(500), np.uint8)
    h, slow = 0, []
    for b in data.tolist():
        h = (2 * h + int(chunks.GEAR[b])) % 2**32
        slow.append(h)
    assert chunks.gear(data).tolist() == slow


def test_chunks_resist_insertions(spark):
    a = " ".join(words(1, 400))
    b = "new words at the front " + a[:900] + " inserted " + a[900:]
    rows = {r["doc_id"]: r for r in chunks.chunk_dedup(docs(spark, [a, b, " ".join(words(2, 300)), *ODD], extra=True)).collect()}
    assert rows[0]["n_removed"] == 0 and rows[2]["n_removed"] == 0 and rows[1]["n_removed"] > 0.7 * len(a)
    assert rows[12]["n_removed"] > 0 and rows[3]["n_bytes"] == 0
    assert chunks.chunk_dedup(docs(spark, [])).count() == 0


def cut_by_hand(data):
    """Chunk ends byte by byte: the hash of the last 32 bytes has its top bits zero, no chunk is under SMALLEST but the last, none over LARGEST."""
    ends, last, h = [], 0, 0
    for i, b in enumerate(data, 1):
        h = (2 * h + int(chunks.GEAR[b])) % 2**32
        zero = h >> (32 - chunks.BITS) == 0
        # Whatever is longer than LARGEST at a border, or at the end, is cut from the front.
        if zero or i == len(data):
            while i - last > chunks.LARGEST:
                last += chunks.LARGEST
                ends.append(last)
            if i - last >= chunks.SMALLEST or i == len(data):
                if i > last:
                    ends.append(i)
                last = i
    return ends


def test_chunk_dedup_by_brute_force(spark):
    r = random.Random(12)
    base = [" ".join(words(i, 80, 300)) for i in range(5)]
    texts = base + [base[r.randrange(5)][r.randrange(200) :][: r.randrange(60, 400)] + f" mid {i} " + base[r.randrange(5)][: r.randrange(300)] for i in range(40)] + ODD + ["a" * 3000, "a" * 3000]
    seen, want = set(), []
    for t in texts:
        data, at, runs = (t or "").encode(), 0, []
        for end in cut_by_hand(data):
            piece = data[at:end]
            if piece in seen:
                if runs and runs[-1][1] == at:
                    runs[-1][1] = end
                else:
                    runs.append([at, end])
            seen.add(piece)
            at = end
        runs = [x for x in runs if x[1] - x[0] >= chunks.RUN]
        left = b"".join(data[a:b] for a, b in zip([0, *(x[1] for x in runs)], [*(x[0] for x in runs), len(data)], strict=True))
        want.append((len(data), sum(b - a for a, b in runs), len(runs), hashlib.sha256(left).hexdigest()))
    rows = sorted(chunks.chunk_dedup(docs(spark, texts, extra=True)).collect(), key=lambda x: x["doc_id"])
    assert [(x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in rows] == want


def test_repeated_rows_lose_the_same_chunks(spark):
    a = " ".join(words(1, 400))
    rows = [(0, a), (1, "front " + a), (2, "front " + a), (2, "front " + a)]
    got = [(r["doc_id"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in chunks.chunk_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    once = chunks.chunk_dedup(spark.createDataFrame(rows[:3], "doc_id long, text string")).filter("doc_id = 2").first()
    assert once["n_removed"] > 0.9 * len(a)
    assert [x[1:] for x in got if x[0] == 2] == [(once["n_removed"], once["n_spans"], once["kept_sha256"])] * 2


def test_chunk_borders_cover_the_text():
    for n in (0, 1, 31, 32, 5000):
        data = np.zeros(n, np.uint8)
        ends = chunks.borders(data)
        assert (ends[-1] if ends else 0) == n and all(b - a <= chunks.LARGEST for a, b in zip([0, *ends], ends, strict=False))


# 5 suffix arrays


@pytest.mark.parametrize("letters", [b"ab", b"abc\x00", b"a"])
def test_suffix_array_by_sorting(letters):
    for seed in range(120):
        r = random.Random(seed)
        t = bytes(r.choice(letters) for _ in range(r.randint(0, 50)))
        assert suffix.suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def brute(texts, length):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        runs = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("group", [suffix.GROUP, 2])
def test_suffix_dedup_by_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(suffix, "GROUP", group)
    r = random.Random(9)
    base = [" ".join(words(i, 60, 400)) for i in range(6)]
    texts = base + [base[0], base[1][:150] + " other " + base[2][40:260], base[3][30:131], "é" * 90, "ab" * 120, base[4] + base[4]]
    texts += [base[r.randrange(6)][r.randrange(80) :][: r.randrange(90, 260)] + f" end {i}" for i in range(40)] + ODD
    rows = sorted(suffix.suffix_dedup(docs(spark, texts, extra=True)).collect(), key=lambda x: x["doc_id"])
    assert [(x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in rows] == brute(texts, 100)


def test_suffix_dedup_empty_and_filter(spark):
    assert suffix.suffix_dedup(docs(spark, [])).count() == 0
    t = " ".join(words(3, 80))
    out = {r["doc_id"]: r for r in suffix.drop_repeated_strings(docs(spark, [t, "é " + t, None])).collect()}
    assert out[0]["text"] == t and out[1]["text"] == "é " and out[1]["n_chars"] == 2 and out[2]["text"] is None


# 6 near duplicates


def edited(ws, seed, n):
    r, out = random.Random(seed), list(ws)
    for _ in range(n):
        out[r.randrange(len(out))] = f"edit{r.randrange(10**6)}"
    return out


def test_near_duplicates_by_brute_force(spark):
    base = words(1, 300)
    texts = [" ".join(words(i, 200)) for i in range(2, 8)] + [" ".join(edited(base, i, i % 9)) for i in range(30)] + ["one two", "one two", "one three"]
    s = [neardup.shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if neardup.aligned(s[i], s[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs(spark, texts, extra=True)).collect()}
    assert got == dict(enumerate(root))


def test_large_stars_are_split(spark, monkeypatch):
    monkeypatch.setattr(neardup, "GROUP", 4)
    base = words(1, 300)
    texts = [" ".join(edited(base, i, 2)) for i in range(25)]
    assert {r["class_id"] for r in neardup.near_duplicates(docs(spark, texts)).collect()} == {0}


def test_split_stars_lose_no_chain(spark, monkeypatch):
    """x is only like its y, and y like the centre; both have the samples of the centre, so there is one star of them."""
    monkeypatch.setattr(neardup, "GROUP", 4)
    base = words(1, 300)
    want = neardup.sketch(neardup.shingles(" ".join(base)))

    def same_samples(ws, seed, n):
        return next(e for e in (edited(ws, seed + k, n) for k in range(0, 10**6, 1000)) if neardup.sketch(neardup.shingles(" ".join(e))) == want)

    ys = [same_samples(base, i, 5) for i in range(12)]
    xs = [same_samples(y, 100 + i, 5) for i, y in enumerate(ys)]
    lone = [edited(base, 200 + i, 60) for i in range(3)]
    texts = [" ".join(w) for w in [base, *ys, *xs, *lone]]
    s = [neardup.shingles(t) for t in texts]
    assert all(neardup.aligned(s[0], s[13 + i]) < 0.8 <= neardup.aligned(s[1 + i], s[13 + i]) for i in range(12))
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs(spark, texts)).collect()}
    assert got == dict.fromkeys(range(25), 0) | {25: 25, 26: 26, 27: 27}


def test_near_duplicates_odd_rows(spark):
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs(spark, ODD, extra=True)).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 7, 9: 9}
    assert neardup.near_duplicates(docs(spark, [])).count() == 0
    kept = neardup.drop_near_duplicates(docs(spark, ["a b", "a b", "c"], extra=True))
    assert {r["doc_id"] for r in kept.collect()} == {0, 2} and kept.columns[-len(CLASHING) :] == CLASHING


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    base, other = words(1, 300), words(2, 300)
    a, b, near_b = " ".join(base), " ".join(other), " ".join(edited(other, 1, 2))
    df = spark.createDataFrame([(2, a), (5, a), (5, b), (5, b), (3, near_b), (2, "x y z")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["class_id"]) for r in neardup.near_duplicates(df).collect())
    assert got == [(2, 2), (2, 2), (3, 3), (5, 2), (5, 3), (5, 3)]
    assert sorted((r["doc_id"], r["text"]) for r in neardup.drop_near_duplicates(df).collect()) == sorted([(2, a), (2, "x y z"), (3, near_b)])
    # One id with two texts does not join the classes of the texts.
    df = spark.createDataFrame([(1, a), (1, b), (0, near_b), (7, a)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["class_id"]) for r in neardup.near_duplicates(df).collect()) == [(0, 0), (1, 0), (1, 1), (7, 1)]
    assert sorted((r["doc_id"], r["text"]) for r in neardup.drop_near_duplicates(df).collect()) == sorted([(1, a), (0, near_b)])


def test_null_ids_do_not_stand_for_their_text(spark):
    base = words(1, 300)
    a, near = " ".join(base), " ".join(edited(base, 1, 3))
    df = spark.createDataFrame([(None, a), (3, a), (5, a), (None, a), (1, near), (8, "some other text")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["class_id"]) for r in neardup.near_duplicates(df).collect())
    assert got == [(0, 1), (0, 1), (1, 1), (3, 1), (5, 1), (8, 8)]
    assert sorted(r["doc_id"] or 0 for r in neardup.drop_near_duplicates(df).collect()) == [1, 8]


def test_alignment_minds_order():
    a = neardup.shingles(" ".join(words(1, 200)))
    assert neardup.aligned(a, a) == 1 and neardup.aligned(a, np.concatenate([a[100:], a[:100]])) < 0.5


# 7 toxicity


def test_automaton_equals_edit_distance():
    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            d, up = [i, *d[1:]], d
            for j, y in enumerate(b, 1):
                d[j] = min(up[j] + 1, d[j - 1] + 1, up[j - 1] + (x != y))
        return d[-1]

    terms = [("abcab", False), ("bcaab", False), ("caabc", False)]
    m = toxicity.Automaton(terms)
    r = random.Random(3)
    for _ in range(2000):
        w = "".join(r.choice("abc") for _ in range(r.randint(0, 7)))
        best = min(distance(w, t) for t, _ in terms)
        found = m.match(w)
        assert (found is None) == (best > 1) and (found is None or found[1] == best)
    assert toxicity.Automaton([("lowei", True)]).match("loweischaft") == (0, 0)


def test_toxicity_learns_and_quotes(spark):
    r = random.Random(2)
    bad = ["idiot", "moron", "scumbag"]
    rows = [(i, " ".join([*words(i, 40), *([r.choice(bad)] if i % 4 == 0 else []), *words(i + 999, 5)])) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(rows + [(1000, "you are an idoit and a moronn"), (1001, None), (1002, ""), (1003, 'he was called "idiot" there')], "doc_id long, text string")
    got = {x["doc_id"]: x for x in toxicity.toxicity(df, labels).collect()}
    assert all(got[i]["predicted"] == int(i % 4 == 0) for i in range(400))
    assert got[1000]["predicted"] == 1 and got[1001]["score"] == got[1002]["score"] < 0.5 and got[1003]["n_quoted"] == 1
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(400))
    none = toxicity.toxicity(df, labels.limit(0)).collect()
    assert {x["score"] for x in none} == {0.0}
    kept = toxicity.filter_toxic(docs(spark, ["fine", None, "fine"], extra=True), labels)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2] and kept.columns[-len(CLASHING) :] == CLASHING
    assert toxicity.toxicity(df.limit(0), labels).count() == 0 and toxicity.filter_toxic(df.limit(0), labels).count() == 0
    twice = [r["score"] for r in toxicity.toxicity(df.unionByName(df.filter("doc_id = 4")), labels).filter("doc_id = 4").collect()]
    assert len(twice) == 2 and len(set(twice)) == 1


def test_scores_by_brute_force():
    """Every hit by comparing every word with every term, its context by the definition, and the score as one minus the product."""

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))

    terms = [("idiot", False), ("moron", False), ("scum", True), ("dolt", False)]
    r = random.Random(8)
    weights = {(k, e, q): r.random() for k in range(4) for e in (0, 1) for q in (0, 1)}
    scorer = toxicity.Scorer(terms, weights, 0.1)
    pool = ["idiot", "idiots", "idoit", "moron", "mron", "scummy", "scum", "dolt", "dolts", "fine", "word", "day", "xidiotx"]
    for _ in range(300):
        ws = [r.choice(pool) for _ in range(r.randint(0, 12))]
        want = {}
        for i, w in enumerate(ws):
            exact = [k for k, (t, stem) in enumerate(terms) if w == t or (stem and w.startswith(t))]
            fuzzy = [k for k, (t, stem) in enumerate(terms) if not stem and len(t) >= 5 and near(w, t)]
            for k, e in [(k, 0) for k in exact] or [(k, 1) for k in fuzzy]:
                key = (k, e, int("word" in ws[max(0, i - toxicity.CONTEXT) : i]))
                want[key] = want.get(key, 0) + 1
        got = scorer.hits(" ".join(ws))
        assert got == want
        left = 0.9
        for k in got:
            left *= 1 - weights[k]
        assert abs(scorer.score(got) - (1 - left)) < 1e-12


# 8 HTML


def text_of(page, gone=()):
    return html.main_text(html.lines(page), list(gone))[0]


@pytest.mark.parametrize(("page", "want"), [
    ('<html><body><nav>Menu</nav><article><h1>T &amp; x</h1><p>a<b>b</b>\n c<br>d<div class="comments"><p>no</p></div><aside>no</aside><p>e</article><footer>f</footer><script>x="</p>"</script>', "T & x\nab c d\ne"),
    (None, ""),
    ('<article><p>a</article><section class="comments"><article class="comment"><p>Nice post!</article></section>', "a"),
    ('<div id="comments"><article><p>reader says</article></div>', ""),
    ('<article><p>a</p><div class="post-comments"><article class="comment-123">no</article></div><p>b</article>', "a\nb"),
    ('<article><p>a<div class="share-price">12.50</div><div class="share-buttons">no</div><p class="navigationist">b</article>', "a\n12.50\nb"),
    ('<nav>Menu<article><p>a</p></article>', "a"),
    ('<form><main class="search">a<p>b<form>no</form></main></form>', "a\nb"),
    ('<article><p title="the hidden truth">a<p hidden>no<p style="x: y; display : none">no<p>b</article>', "a\nb"),
    ('<article>a <span class="ad">no <span>no</span> no</span> b</article>', "a\nb"),
    ('<p>a<!-- no --><ul><li>b<li>c</ul><textarea>no</textarea><hr>d &#x27;&nbsp;&lt;e', "a\nb\nc\nd ' <e"),
])
def test_html_main_text(page, want):
    assert text_of(page) == want


def pages_of(spark, rows, parts=None):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in CLASHING + ["host", "path", "gone", "keys", "outline", "n_lines"]:
        df = df.withColumn(c, F.lit("x"))
    return df.repartitionByRange(parts, "page_id") if parts else df


def page(middle, top="Top line"):
    return f"<body><div>{top}</div><div>{middle}</div><div>Bottom</div></body>"


def test_html_differencing(spark):
    rows = [(1, "http://h/a/1", page("one")), (2, "http://h/a/2", page("two")), (3, "http://other/", page("three")), (4, None, None), (5, "http://h/a/3", page("two")), (5, "http://h/a/3", page("two")), (None, "x", "<p>p")]
    got = sorted((r["page_id"] or 0, r["text"], r["n_chars"], r["n_lines"], r["n_shared"], r["n_marked"]) for r in html.extract(pages_of(spark, rows)).collect())
    assert got == [(0, "p", 1, 1, 0, 0), (1, "one", 3, 3, 2, 0), (2, "two", 3, 3, 2, 0), (3, "Top line\nthree\nBottom", 21, 3, 0, 0), (4, "", 0, 0, 0, 0), (5, "two", 3, 3, 2, 0), (5, "two", 3, 3, 2, 0)]
    assert html.extract(pages_of(spark, rows).limit(0)).count() == 0


def test_html_copies_do_not_delete_an_article(spark):
    """Near copies share the article, other pages the template only; equal pages get equal texts wherever they stand."""
    article = "".join(f"<p>{' '.join(words(i, 30))}</p>" for i in range(8))
    other = "".join(f"<p>{' '.join(words(i, 30))}</p>" for i in range(8, 16))
    rows = [(i, f"http://h/a/{i:03d}", page(article + (f"<p>print {i}</p>" if i % 3 else ""))) for i in range(80)] + [(i, f"http://h/b/{i}", page(other + f"<p>{i}")) for i in range(100, 102)]
    got = {r["page_id"]: r["text"] for r in html.extract(pages_of(spark, rows)).collect()}
    for i in range(80):
        assert got[i].count("\n") + 1 >= 8 and " ".join(words(3, 30)) in got[i]
    assert len({got[i] for i in range(0, 80, 3)}) == 1
    assert got[100].endswith("100") and " ".join(words(8, 30)) in got[100]
    # A page and one near copy of it say nothing of what is template.
    two = {r["text"] for r in html.extract(pages_of(spark, [(1, "http://h/1", page(article)), (2, "http://h/2", page(article + "<p>x"))])).collect()}
    assert all("Top line" in t for t in two)


@pytest.mark.parametrize("marked", [False, True])
def test_html_texts_do_not_depend_on_partitions(spark, marked):
    r = random.Random(1)
    rows = []
    for i in range(90):
        body = f"<div>Top {i % 2}</div><div>text {i}</div><div>text {r.randrange(40)} is {r.randrange(9)}</div><div>Bottom</div>"
        rows.append((i, f"https://h{i % 3}.example/{r.randrange(30)}", f"<nav>m</nav><article>{body}</article>" if marked else body))
    one, many = (sorted(map(tuple, html.extract(pages_of(spark, rows, n)).collect())) for n in (1, 40))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        few = sorted(map(tuple, html.extract(pages_of(spark, rows, 2)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert one == many == few and (marked or any(x[5] for x in one))


def test_html_long_pages():
    deep = "<div>" * 30000 + "x" + "</p></div>" * 30000
    assert text_of(deep) == "x"
    many = "".join(f"<p>{i % 50}" for i in range(30000))
    assert text_of(many).count("\n") == 29999
    a, b = ([f"{i % k}" for i in range(6000)] for k in (7, 11))
    assert len(html.shared(a, b)) > 2000 and html.shared(a, a) == set(range(6000))


def test_longest_common_subsequence():
    for seed in range(200):
        r = random.Random(seed)
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        at = html.shared(a, b)
        picked, k = [a[i] for i in sorted(at)], 0
        for y in b:
            k += k < len(picked) and picked[k] == y
        assert len(at) == best[-1][-1] and k == len(picked)


# 9 WARC


def test_warc_round_trip(spark):
    rows = [(1, "http://a/\r\nX: y", "<p>é</p>"), (2, "http://b/", "<p>é</p>"), (3, None, None), (4, "u", ""), (5, "v", "x" * 100000), (None, "w", "other")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.read_archives(warc.write_archives(pages)).collect()}
    assert len(got) == 6 and (got[1]["record_type"], got[1]["refers_to"]) == ("revisit", 2) and (got[3]["record_type"], got[3]["refers_to"]) == ("revisit", 4)
    assert got[2]["payload"].decode() == "<p>é</p>" and got[5]["payload"] == b"x" * 100000 and got[None]["record_type"] == "response"
    assert got[1]["payload_digest"] == warc.digest("<p>é</p>".encode()) and got[1]["payload_bytes"] == 9
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_warc_repeated_ids_clashing_names_and_hot_payloads(spark):
    rows = [(7, "a", "p"), (7, "b", "p"), (3, "c", "p"), (9, "d", None), (9, "e", "q"), (None, "f", "q"), *((i, None, "hot") for i in range(100, 400))]
    pages = pages_of(spark, rows)
    for c in ("sha", "refers_to", "payload", "archive", "content", "record_type"):
        pages = pages.withColumn(c, F.lit("x"))
    got = [(r["page_id"], r["url"], r["record_type"], r["refers_to"]) for r in warc.read_archives(warc.write_archives(pages)).collect()]
    want = [(7, "a", "response", None), (7, "b", "response", None), (3, "c", "revisit", 7), (9, "d", "response", None), (9, "e", "response", None), (None, "f", "revisit", 9)]
    want += [(i, None, "response" if i == 399 else "revisit", None if i == 399 else 399) for i in range(100, 400)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_warc_detects_damage():
    member = warc.record(7, "u", "text", None)
    raw = next(warc.members(member))
    assert warc.read_record(raw)[:4] == (7, "u", "response", None)
    with pytest.raises(ValueError):
        warc.read_record(raw.replace(b"text", b"tex_"))
    with pytest.raises(ValueError):
        list(warc.members(member[:-9]))


# 10 top-k


def floor1024(x):
    """floor(1024 * x) of a finite float, exactly."""
    return math.floor(fractions.Fraction(x) * 1024)


@pytest.mark.parametrize("scale", [1.0, 3000.0, 1e12, 1e20, 1e300])
def test_top_k_by_brute_force(spark, scale):
    r = np.random.default_rng(1)
    rows = [(i, (r.normal(size=8) * r.choice([0.1, 1, scale])).tolist()) for i in range(700)] + [(700, None), (701, [1.0, None]), (702, [float("nan")] * 8), (703, []), (704, [1.0, 2.0])]
    rows += [(i, rows[5][1]) for i in range(705, 760)] + [(800, [scale * 3] * 8), (900, []), (901, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("norm", F.lit(1)).withColumn("v", F.lit(None)).withColumn("rank", F.lit(0))
    v = {i: [floor1024(x) for x in e] for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)}
    want = []
    for q in v:
        if q % 100 == 0:
            s = sorted((-sum(a * b for a, b in zip(v[q], v[c], strict=False)), c) for c in v if c != q)[:10]
            want += [(q, k, c, min(max(-x, topk.LOW), topk.HIGH)) for k, (x, c) in enumerate(s, 1)]
    assert sorted(tuple(x) for x in topk.top_k(df).collect()) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_keeps_large_and_small_components(spark):
    """Products beyond 2 ** 53 that differ by one, sizes far apart, and less than k candidates."""
    rows = [(0, [1e12, 1.0]), (1, [1e12, 1 / 1024]), (2, [1e12, 2 / 1024]), (3, [1e20, 1.0]), (4, [1.7e308, -1.7e308]), (5, [1e-3, 5e-324]), (6, [-1e20, 0.0])]
    got = [(r["vec_id"], r["score"]) for r in sorted(topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), key=lambda r: r["rank"])]
    assert got == [(4, topk.HIGH), (3, topk.HIGH), (2, topk.HIGH), (1, topk.HIGH), (5, 1024 * 10**12), (6, topk.LOW)]


def test_scores_beyond_long_stay_in_order():
    some = [0, 1, -1, topk.HIGH, topk.LOW, topk.HIGH + 1, topk.LOW - 1, 2**80, 2**80 + 1, -(2**80), -(2**80) - 1, 2**200, -(2**200), 255 * 2**64, 256 * 2**64]
    assert sorted(some, key=topk.shown) == sorted(some)


def test_top_k_skips_short_buckets(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    r = np.random.default_rng(4)
    rows = [(i, (r.normal(size=6) * 2.0 ** -(i % 40)).tolist()) for i in range(600)]
    v = {i: [floor1024(x) for x in e] for i, e in rows}
    want = sorted((q, k, c, -x) for q in range(0, 600, 100) for k, (x, c) in enumerate(sorted((-sum(a * b for a, b in zip(v[q], v[c], strict=True)), c) for c in v if c != q)[:10], 1))
    assert sorted(tuple(x) for x in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()) == want
