"""Importance resampling, hard negatives and sharding against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from heron.llm import html, neardup, negatives, packing, resample, sharding, topk
from tests.llm.test_operators import CLASHING, ODD, docs, words

MORE = "bucket count n_words n_features weight tie low unnamed id place at key shard_ slot size crc text_crc32 law".split()


def clashing(df):
    for c in [*CLASHING, *MORE]:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("x"))
    return df


# 11 importance resampling


def noise(doc_id):
    h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def resampled(rows, target, n, buckets, least, percent):
    def found(text):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(ws), [zlib.crc32(" ".join(ws[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(ws) - k + 1)]

    source, goal = Counter(b for _, t in rows for b in found(t)[1]), Counter(b for t in target for b in found(t)[1])
    s, t = sum(source.values()), sum(goal.values())
    out = []
    for doc_id, text in rows:
        n_words, fs = found(text)
        gains = [math.floor(1000 * math.log((goal[b] + 1) * (s + buckets) / ((source[b] + 1) * (t + buckets)))) for b in fs]
        weight = sum(gains) // len(gains) if gains else 0
        out.append((doc_id, len(fs), weight, weight + noise(doc_id), n_words))
    may = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    drawn = {id(x): k for k, x in enumerate(may[: percent * len(may) // 100], 1)}
    return sorted(((*x[:4], drawn.get(id(x)), x[4]) for x in out), key=str)


@pytest.mark.parametrize(("n", "buckets", "piece"), [(1, 10_000, 1 << 20), (3, 97, 64), (2, 1, 1)])
def test_resampling_by_brute_force(spark, monkeypatch, n, buckets, piece):
    monkeypatch.setattr(resample, "SLICE", piece)
    r = random.Random(n)
    texts = [" ".join(r.choice(["The", "cat", "É", "9a", "x-y", "Ünder_score", "\n", "!", "ǅ", "K"]) for _ in range(r.randint(0, 60))) for _ in range(120)] + ODD
    rows = list(enumerate(texts)) + [(3, texts[3]), (3, texts[4]), (None, texts[5] + " and so on" * 9), (None, None), (-7, "a b c d e f g h " * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    target = ["the cat é the cat", None, "", "k x y 9A"]
    found = resample.resampling(clashing(df), spark.createDataFrame([(t,) for t in target], "text string"), n=n, buckets=buckets, least=15, percent=30)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    assert sorted((tuple(x) for x in found.collect()), key=str) == resampled(rows, target, n, buckets, 15, 30)


def test_ring_holds_the_last_runs():
    text = " ".join(words(1, 300, 40)).encode()
    ws = text.split()
    want = [[zlib.crc32(b" ".join(ws[i - k : i + 1])) for k in range(min(4, i + 1))] for i in range(len(ws))]
    assert [n for n, _ in resample.runs(text, 4)] == [300] and next(iter(resample.runs(text, 4)))[1] == [x for w in want for x in w]


def test_resample_keeps_the_columns_of_docs(spark):
    texts = [" ".join(words(i, 30)) for i in range(50)]
    df = clashing(docs(spark, texts))
    kept = resample.resample(df, spark.createDataFrame([(" ".join(words(7, 30)),)], "text string"))
    want = [x[0] for x in resampled(list(enumerate(texts)), [" ".join(words(7, 30))], 1, 10_000, 20, 10) if x[4]]
    assert kept.columns == df.columns and sorted(x["doc_id"] for x in kept.collect()) == sorted(want) and len(want) == 5
    none = spark.createDataFrame([], "text string")
    assert resample.resampling(docs(spark, []), none).count() == 0
    assert resample.resampling(docs(spark, [None, "a"]), none).count() == 2
    assert {x["text"] for x in resample.resample(docs(spark, ["a b " * 10] * 20), none).collect()} == {"a b " * 10}


# 12 hard negatives


def mined(rows, every, positives, k, low, high):
    part = [(i, label, [math.floor(Fraction(x) * 256) for x in e]) for i, e, label in rows if i is not None and label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    shown = lambda x: min(max(x, negatives.LOW), negatives.HIGH)
    out = []
    for a, (i, label, v) in enumerate(part):
        if i % every:
            continue
        scores = [(-sum(x * y for x, y in zip(v, w, strict=False)), j, other) for c, (j, other, w) in enumerate(part) if c != a]
        for p, pos, _ in sorted(s for s in scores if s[2] == label)[:positives]:
            near = sorted(s for s in scores if s[2] != label and low * -p <= 100 * -s[0] <= high * -p)[:k]
            out += [(i, pos, r, j, shown(-p), shown(-s)) for r, (s, j, _) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize(("scale", "labels"), [(1.0, 3), (50.0, 40), (1e9, 3), (1e20, 2), (1e300, 1)])
def test_hard_negatives_by_brute_force(spark, monkeypatch, scale, labels):
    monkeypatch.setattr(negatives, "BLOCK", 64)
    monkeypatch.setattr(negatives, "ANCHORS", 5)
    monkeypatch.setattr(negatives, "CHUNK", 3)
    r = np.random.default_rng(2)
    base = r.normal(size=8) + 1
    rows = [(i, ((base + r.normal(size=8) * 0.6) * r.choice([0.1, 1, scale])).tolist(), int(r.integers(labels))) for i in range(400)]
    rows += [(i, rows[5][1], rows[5][2] + i % 2) for i in range(400, 460)] + [(0, rows[9][1], rows[0][2]), (50, rows[8][1], 1), (50, rows[50][1], rows[50][2]), (100, [1.0, 2.0], 0), (150, [], 0), (-50, rows[3][1], -1)]
    rows += [(500, None, 1), (550, [1.0, None], 1), (600, [float("nan")] * 8, 1), (650, [float("inf")] * 8, 1), (700, rows[1][1], None), (None, rows[2][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    for c in ("score", "rank", "anchor", "block", "chunk", "slot", "beyond", "windows", "v", "tie"):
        df = df.withColumn(c, F.lit("x"))
    found = negatives.hard_negatives(df, every=50, positives=4, k=3)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(x) for x in found.collect()) == mined(rows, 50, 4, 3, 50, 95)
    assert labels == 1 or found.count() > 50


def test_hard_negatives_of_nothing(spark):
    empty = "vec_id long, embedding array<float>, label int"
    assert negatives.hard_negatives(spark.createDataFrame([], empty)).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(1, [1.0], 1)], empty)).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(50, [1.0], 1), (1, [1.0], 2)], empty)).count() == 0
    assert [tuple(x) for x in negatives.hard_negatives(spark.createDataFrame([(50, [], 1), (1, [], 1), (2, [], 2)], empty)).collect()] == [(50, 1, 1, 2, 0, 0)]


def test_tiles_keep_their_numbers():
    for values in ([[0, -1], [2**31 - 1, -(2**31) + 1]], [[2**31, 1]], [[-(2**40), 5]], [[2**70, -(2**90)]]):
        tile = np.array(values, object if max(map(abs, sum(values, []))) > 2**62 else np.int64)
        assert (negatives.unpacked(*negatives.packed(tile)) == tile.ravel()).all()
    for x in (0, 5, -5, 2**63 - 1, -(2**63), 2**63, -(2**63) - 1, 2**90, -(2**90)):
        assert negatives.exact(*negatives.shown(x)) == x


# 13 sharding


def ring(rows, shards, per_shard):
    """Shard and slot of each row, one row after another, by the ring: first all into their own shard, then what is left, clockwise."""
    at = lambda text: int(hashlib.sha256(text.encode()).hexdigest()[: sharding.DIGITS], 16)
    nodes = sorted((at(f"shard {s} node {v}"), s) for s in range(shards) for v in range(per_shard))
    size = lambda t: len((t or "").encode()) + 16
    order = sorted((at("" if i is None else str(i)), i is not None, i or 0, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    node = lambda x: next((k for k, (p, _) in enumerate(nodes) if p >= x), len(nodes))
    got, left = [None] * len(order), []
    for k, row in enumerate(order):
        s = nodes[node(row[0]) % len(nodes)][1]
        if room[s]:
            room[s], got[k] = room[s] - 1, (node(row[0]), 0, s)
        else:
            left.append((node(row[0]), k))
    for start, k in [*left]:
        assert room[nodes[start % len(nodes)][1]] == 0
    waiting, at_node = [], 0
    while left or waiting:
        here = at_node % len(nodes)
        s = nodes[here][1]
        while waiting and room[s]:
            start, k = waiting.pop(0)
            room[s], got[k] = room[s] - 1, (start, at_node + 1, s)
        move = [x for x in left if x[0] == at_node]
        left = [x for x in left if x[0] != at_node]
        waiting += move
        at_node += 1
    return order, got


def check(rows, found, shards):
    counts = Counter(x["shard"] for x in found)
    assert len(found) == len(rows) and set(counts) <= set(range(shards))
    assert not rows or max(counts.values()) - min(counts[s] for s in range(shards)) <= 1
    for s in counts:
        assert sorted(x["slot"] for x in found if x["shard"] == s) == list(range(counts[s]))
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((x["doc_id"], x["size"], x["text_crc32"]) for x in found) == want


@pytest.mark.parametrize("per_shard", [1, 4, 32])
def test_sharding_by_brute_force(spark, per_shard):
    texts = [" ".join(words(i, 5)) for i in range(300)] + ODD
    rows = list(enumerate(texts)) + [(7, "hot")] * 150 + [(None, "x"), (None, None), (-1, "é")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    found = sharding.sharding(df, shards=7, per_shard=per_shard)
    assert found.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    found = found.collect()
    check(rows, found, 7)
    order, got = ring(rows, 7, per_shard)
    want = Counter((i if named else None, size, crc, s) for (_, named, i, size, crc), (_, _, s) in zip(order, got, strict=True))
    assert Counter((x["doc_id"], x["size"], x["text_crc32"], x["shard"]) for x in found) == want


def test_sharding_of_few_rows(spark):
    for rows in ([], [(1, None)], [(1, "a"), (2, "a"), (3, "a")]):
        check(rows, sharding.sharding(spark.createDataFrame(rows, "doc_id long, text string")).collect(), 40)


def test_one_more_shard_moves_few_rows(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    a, b = ({x["doc_id"]: x["shard"] for x in sharding.sharding(df, shards=n).collect()} for n in (40, 41))
    assert sum(a[i] != b[i] for i in a) < 0.12 * len(a)
    a, b = ({x["doc_id"]: x["shard"] for x in sharding.sharding(df, shards=n, slack=0.1).collect()} for n in (40, 41))
    assert sum(a[i] != b[i] for i in a) < 0.035 * len(a) and max(Counter(b.values()).values()) <= 537


def test_sharded_files(spark, tmp_path):
    df = docs(spark, [" ".join(words(i, 5)) for i in range(100)])
    sharding.sharded(df, f"file://{tmp_path}/shards", rows_per_file=8, shards=5)
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert sorted(map(str, back.select(df.columns).collect())) == sorted(map(str, df.collect()))
    assert {r["n"] for r in back.groupBy("shard").agg(F.count("*").alias("n")).collect()} == {20}
    assert all(len(list(p.glob("*.parquet"))) == 3 for p in (tmp_path / "shards").glob("shard=*"))
    with pytest.raises(ValueError, match="shard"):
        sharding.sharded(df.withColumn("Shard", F.lit(1)), f"file://{tmp_path}/other")


# 10 top-k of repeated ids, and the SQL of the operators that have one


def test_top_k_of_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    r = np.random.default_rng(8)
    rows = [(i, (r.normal(size=4) * r.choice([0.2, 1, 3])).tolist()) for i in range(120)]
    rows += [(100, [1.0, 0.0, 0.0, 0.0]), (100, [0.0, 1.0, 0.0, 0.0]), (100, [0.0, 1.0, 0.0, 0.0]), (0, rows[5][1]), (7, rows[7][1]), (7, rows[9][1])]
    v = [(i, [math.floor(Fraction(x) * 1024) for x in e]) for i, e in rows]
    want = []
    for a, (i, q) in enumerate(v):
        if i % 100 == 0:
            s = sorted((-sum(x * y for x, y in zip(q, c, strict=True)), j) for b, (j, c) in enumerate(v) if b != a)[:10]
            want += [(i, k, j, -x) for k, (x, j) in enumerate(s, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    assert sorted(tuple(x) for x in topk.top_k(df).collect()) == sorted(want) and len(want) == 60


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n.startswith("op")))
def test_operators_equal_their_sql(spark, name):
    db = duckdb.connect()
    for p in Path("/root/testdata/sf0.001").glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    df = entry.queries()[name](spark, "/root/testdata/sf0.001")
    result = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(x[n] for n in names) for x in df.collect()), key=str) == sorted(result.fetchall(), key=str)


# 8 boilerplate inside articles


@pytest.mark.parametrize("inner", [
    '<div id="respond">Leave a reply</div>', '<ul class="commentlist"><li>first!</ul>', '<section id="discussion"><p>I disagree</section>', '<div class="ad-slot">Buy</div>', '<div class="advertising">Buy</div>',
    '<div class="adUnit">Buy</div>', '<div class="comment-respond"><form>name</form>write</div>', '<p class="social">follow us</p>', "<footer>filed under x</footer>",
])
def test_boilerplate_inside_an_article_goes(inner):
    found = html.lines(f"<body><article><h1>Title</h1><p>One &amp; two</p>{inner}<p>Three</p></article></body>")
    assert html.main_text(found, [])[0] == "Title\nOne & two\nThree"


@pytest.mark.parametrize("inner", ['<p class="share-price">up</p>', '<div class="unit">up</div>', '<div class="slot">up</div>', '<section id="discussion-of-results">up</section>', '<p class="respondents">up</p>'])
def test_words_beside_stay(inner):
    assert "up" in html.main_text(html.lines(f"<article><p>One</p>{inner}</article>"), [])[0]


# 2 packing of large histograms


@pytest.mark.parametrize(("n", "low", "high", "most"), [(3000, 1000, 2000, 1200), (3000, 1200, 1800, 1260), (20_000, 700, 2100, 6970), (3000, 1400, 2700, 1537)])
def test_bin_completion_beats_best_fit_on_large_histograms(n, low, high, most):
    r = random.Random(1)
    counts = Counter(r.randint(low, high) for _ in range(n))
    found = packing.bin_completion(dict(counts))
    used = Counter()
    for times, filling in found:
        assert times > 0 and sum(s * c for s, c in filling) <= packing.CAPACITY
        for s, c in filling:
            used[s] += times * c
    assert used == counts
    by_best_fit = sum(t for t, _ in packing.best_fit(counts, packing.CAPACITY))
    assert sum(t for t, _ in found) <= min(most, by_best_fit) and (most == 1537 or sum(t for t, _ in found) < 0.98 * by_best_fit)


def test_dives_keep_to_their_bounds():
    counts = {7: 3, 5: 4, 3: 5, 2: 2}
    found, steps = packing.dive(counts, 10, 0, 10, 99)
    assert steps == len(found) and sum(t * sum(s * c for s, c in f) for t, f in found) == 60 and sum(t for t, _ in found) == 6
    assert packing.dive(counts, 10, 5, 0, 99)[0] is None or sum(t for t, _ in packing.dive(counts, 10, 5, 0, 99)[0]) == 6
    assert packing.dive(counts, 10, 0, 10, 1) == (None, 1) and packing.dive({7: 2}, 10, 0, 5, 99)[0] is None


def test_a_worker_splits_a_bounded_share_of_the_texts():
    """Long texts come in smaller groups, so that their words are not all held at once; only a text that is longer by itself is over the bound."""
    sizes = [5, 40, 0, 90, 300, 10, 10, None, 80, 30]
    ids, texts = pa.array([*range(9), None]), pa.array([None if n is None else "x" * n for n in sizes])
    found = list(packing.groups(ids, texts, 100))
    assert [x for some, _ in found for x in some] == [*range(9), None] and [len(t) for _, held in found for t in held] == [n or 0 for n in sizes]
    assert all(sum(map(len, held)) <= 100 or len(held) == 1 for _, held in found) and len(found) == 5


def test_a_worker_keeps_no_words_after_its_task(monkeypatch):
    """Workers are used again, also in stages that do not need the words."""
    monkeypatch.setattr(packing, "TaskContext", type("Task", (), {"get": classmethod(lambda c: c), "partitionId": staticmethod(lambda: 0)}))
    rows = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([f"alpha{i} beta" for i in range(300)])], ["doc_id", "text"])
    assert sum(b.num_rows for b in packing._pieces(None, packing.CAPACITY)(iter([rows]))) == 300
    assert len(packing._tokens(None).cache) == 1


def test_articles_take_part_in_differencing(spark):
    """Pages of one template and unlike articles tell the template; a line that the articles share is template to differencing and comes back as main."""
    def page(i):
        story = f"<h1>Story {i}</h1><p>{' '.join(words(900 + i, 30))}</p><p>As always.</p>"
        return f"<body><div>Top</div><nav>Menu</nav><article>{story}</article><div>New {i}</div><footer>Foot</footer></body>"

    found = html.lines(page(1))
    keys, sizes = html.outline(found)
    assert len(keys) == len(found) == 7 and [n > 0 for n in sizes] == [True, False, True, True, True, True, False]
    assert html.deleted([html.outline(html.lines(page(i))) for i in range(6)]) == [[0, 1, 4, 6]] * 6
    df = spark.createDataFrame([(i, f"http://h/{i}", page(i)) for i in range(12)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_lines"], r["n_shared"], r["n_marked"]) for r in html.extract(df).collect()}
    assert got == {i: (f"Story {i}\n{' '.join(words(900 + i, 30))}\nAs always.", 7, 3, 1) for i in range(12)}


# 6 stars of unlike texts


def test_unlike_texts_that_share_a_sample_do_not_all_meet(spark, monkeypatch):
    """Pages of their own with one licence in common: the samples inside the licence make large stars of unlike texts. Among them are groups that are like each other."""
    monkeypatch.setattr(neardup, "GROUP", 40)
    licence = words(77, 60)
    texts = []
    for i in range(1500):
        own = words(10_000 + i // 3 if i % 50 < 3 else 50_000 + i, 60)
        if i % 50 < 3:
            own[(7 * i) % 60] = f"edit{i}"
        texts.append(" ".join(own + licence))
    s = [neardup.shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(max(0, i - 3), i):
            if neardup.aligned(s[i], s[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    met, checked = [], []
    first_meet, first_verify = neardup.meet, neardup.verify
    monkeypatch.setattr(neardup, "meet", lambda *a: met.append(a[2].count()) or first_meet(*a))
    monkeypatch.setattr(neardup, "verify", lambda *a: checked.append(a[2].count()) or first_verify(*a))
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs(spark, texts)).collect()}
    assert got == dict(enumerate(root)) and len(set(root)) < 1500
    # Each text is in at most TABLES stars of a level's samples; no level has all pairs of a star.
    assert len(checked) > 1 and max(checked) <= 1500 * neardup.TABLES * neardup.TABLES / 2 and sum(met) <= 1500 * neardup.TABLES


@pytest.mark.parametrize("group", [3, 10, 4000])
def test_classes_do_not_depend_on_the_size_of_stars(spark, monkeypatch, group):
    """Texts round one passage, in chains of a middling similarity: many pairs have one sample in common, which is that of a large star, or none."""
    monkeypatch.setattr(neardup, "GROUP", group)
    passage, texts = words(77, 12), []
    for i in range(30):
        own = words(3000 + i, 30)
        for k in range(5):
            texts.append(" ".join(own + passage))
            own[6 * k : 6 * k + 6] = words(9000 + 10 * i + k, 6)
    s = [neardup.shingles(t) for t in texts]
    samples = [set(neardup.sketch(x)) for x in s]
    root, apart = list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i):
            if neardup.aligned(s[i], s[j], 0.5) >= 0.5:
                apart += len(samples[i] & samples[j]) < 2
                if samples[i] & samples[j]:
                    a, b = root[i], root[j]
                    root = [min(a, b) if x in (a, b) else x for x in root]
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs(spark, texts), 0.5).collect()}
    assert apart > 5 and got == dict(enumerate(root))


def test_similar_texts_share_a_first_shingle():
    for seed in range(300):
        r = random.Random(seed)
        a, b = (np.unique(np.array([r.randrange(60) for _ in range(r.randint(1, 40))], np.uint64)) for _ in range(2))
        late, both = np.array(r.sample(range(60), 20), np.uint64), len(np.intersect1d(a, b))
        t = both / (len(a) + len(b) - both)
        assert not both or len(np.intersect1d(neardup.first_shingles(a, late, t), neardup.first_shingles(b, late, t)))


# 1 and 2 by SQL, as far as it goes


def tables():
    db = duckdb.connect()
    for p in Path("/root/testdata/sf0.001").glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return db


BASE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^ \t\n\x0B\x0C\r]+') AS ws FROM d),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^ \t\n\x0B\x0C\r]') GROUP BY r),
wins AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) > 4)),
hit AS (SELECT r, i FROM wins QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM hit, range(5) AS x(k) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(list_sum([length(x) for x in ws]), 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
 len(ws) < 10 OR 100 * coalesce(rep.n, 0) > 20 * len(ws) AS base_failed FROM w LEFT JOIN dup USING (r) LEFT JOIN rep USING (r)"""


def test_base_counts_equal_sql(spark):
    result = tables().execute(BASE)
    names = [d[0] for d in result.description]
    want = sorted((tuple(int(x) for x in r) for r in result.fetchall()))
    found = entry.queries()["op1_quality_rules"](spark, "/root/testdata/sf0.001").select(names).collect()
    assert sorted(tuple(int(x) for x in r) for r in found) == want and len(want) == 200


def test_packed_places_by_sql(spark, tmp_path):
    entry.queries()["op2_packing"](spark, "/root/testdata/sf0.001").write.parquet(f"file://{tmp_path}/p")
    db = tables()
    db.execute(f"CREATE VIEW p AS SELECT * FROM '{tmp_path}/p/*.parquet'")
    gaps = 'SELECT count(*) FROM (SELECT "offset", coalesce(sum(length) OVER (PARTITION BY sequence_id ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS due FROM p) WHERE "offset" <> due'
    assert db.execute(gaps).fetchall() == [(0,)]
    assert db.execute("SELECT max(n) <= 4096 FROM (SELECT sum(length) AS n FROM p GROUP BY sequence_id)").fetchall() == [(True,)]
    assert db.execute("SELECT count(*) FROM (SELECT doc_id, piece, start, sum(length) OVER (PARTITION BY doc_id ORDER BY piece) - length AS due, length, max(piece) OVER (PARTITION BY doc_id) AS last FROM p) WHERE start <> due OR (length < 4096 AND piece < last)").fetchall() == [(0,)]
    assert db.execute("SELECT count(DISTINCT doc_id) FROM p").fetchall() == db.execute("SELECT count(DISTINCT doc_id) FROM documents").fetchall()
