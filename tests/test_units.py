"""Worked cases by hand."""

import math

import pytest
from pyspark.sql import functions as F

from heron.functions import pii
from heron.functions import text as X
from heron.operators import align, cost, curate, evaluate, fusion, ontology, rules, stats
from heron.operators.vectors import nearest
from heron.operators.running import merge_ranges, running_totals


def one(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in columns.items()))


def mail(spark, sender, subject, body, urls, brands=(), dns=None, weights=None):
    df = one(spark, sender_email=sender, subject=subject, body=body, urls=urls)
    return rules.phase1(rules.rule_hits(df, list(brands), dns, body="body"), weights).first()


def test_redaction_of_each_kind(spark):
    text = "Contact me at john.doe@example.com or 555-123-4567. SSN 123-45-6789. CC 4111 1111 1111 1111. DOB 01/02/1980."
    r = pii.redact(one(spark, body=text)).first()
    assert [r[f"n_{k}"] for k in pii.PATTERNS] == [1] * 5 and r["n_pii"] == 5
    assert "j******e@example.com" in r["redacted_body"] and "**/**/****" in r["redacted_body"] and "***-***-4567" in r["redacted_body"]
    assert "123-45-6789" not in r["redacted_body"]


def test_redaction_order_and_empty(spark):
    r = pii.redact(one(spark, body="ab@x.org 4111111111111111")).first()
    assert r["redacted_body"].startswith("**@x.org") and (r["n_phone"], r["n_cc"]) == (1, 0)
    assert pii.redact(spark.createDataFrame([(None,)], "body string")).first()["n_pii"] == 0


@pytest.mark.parametrize(("case", "score", "verdict"), [
    (("alice@example.com", "hi", "hello", 0), 0, "benign"),
    (("a@example.com", "urgent", "see https://bit.ly/abc", 1), 2, "needs_review"),
    (("support@gmail.com", "x", "We need your password to update your bank account.", 0, ["acme.com"]), 2, "needs_review"),
    (("a@b.com", "x", "https://192.168.1.1/login https://tinyurl.com/x", 1), 4, "needs_review"),
])
def test_rules(spark, case, score, verdict):
    r = mail(spark, *case)
    assert (r["score"], r["verdict"]) == (score, verdict)


def test_mismatch_has_no_weight(spark):
    r = mail(spark, "a@corp.com", "x", "http://evil.com/x http://sub.corp.com", 1)
    assert r["domain_mismatch"] and r["score"] == 0 and r["reasons"] == []


def test_empty_weights_weigh_nothing(spark):
    assert mail(spark, "a@b.com", "x", "urgent", 0, weights={})["score"] == 0


def infer(spark, props, **kw):
    df = spark.createDataFrame([(props,)], "properties array<string>")
    return {a["attack_type"]: a["confidence"] for a in ontology.infer(df, **kw).first()["attacks"]}


def test_ontology_fractions(spark):
    got = infer(spark, ["hasCredentialRequest", "hasMissingMX", "hasUrgencyLanguage"])
    assert got["CredentialTheft"] == 1 and got["SocialEngineeringAttack"] == 1 and math.isclose(got["HighConfidencePhishing"], 2 / 3)
    assert "URLBasedAttack" not in got and got["TechnicalAttack"] == 0.5
    assert infer(spark, ["hasIPLiteralURL", "hasDomainMismatch"], minimum=0.5) == {"URLBasedAttack": 1.0, "PrescriptionFraud": 0.5}
    assert infer(spark, []) == {} and set(infer(spark, ["hasCredentialRequest"], strict=True)) == set()


def test_hosts_and_urls(spark):
    df = one(spark, t="Http://no www.A.com:80/x https://[::1]/ http://u:p@h/")
    assert df.select(X.hosts(F.col("t"))).first()[0] == ["a.com", "", "u"]
    df = one(spark, t="see https://a.com/b, a.com/b 4.5 and www.x.org")
    assert df.select(X.extract_urls(F.col("t"))).first()[0] == "https://a.com/b,"
    assert "www.x.org" in df.select(X.extract_urls(F.col("t"), False)).first()[0]


def test_costs(spark):
    r = cost.with_costs(spark.createDataFrame([(0.178, 0.0016)], "recall double, fpr double")).first()
    assert round(r["total_cost_daily"], 2) == 1502.91 and round(r["net_benefit"], 2) == 390097.09 and round(r["roi"], 2) == 259.56


def test_scores_round_half_to_even(spark):
    df = spark.createDataFrame([("benign", 0.65, 0.0)], "v string, t double, a double")
    s = fusion.ai_score(F.col("v"), F.lit(0.5), F.lit(0.5), F.lit(0.0), F.lit(True))
    assert df.select(s.alias("s")).first()["s"] == 5
    assert df.select(fusion.ai_score(F.col("v"), F.lit(0.45), F.lit(0.45), F.lit(0.0), F.lit(True)).alias("s")).first()["s"] == 4
    t = fusion.Thresholds.read('{"top_similarity_threshold": 0.1, "avg_top3_threshold": 0.1}')
    assert (t.review_top, t.review_avg) == (0.0, 0.0)


def test_confusion_without_positives(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (None, 1)], "label int, pred int")
    r = evaluate.confusion(df).first()
    assert (r["tp"], r["tn"], r["fp"], r["fn"], r["precision"], r["f1"], r["fpr"]) == (0, 1, 1, 0, 0.0, 0.0, 0.5)


def test_nearest_and_ties(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 1.0]), (4, None), (5, [])], "id long, v array<double>")
    got = [(r["query_id"], r["id"], r["rank"]) for r in nearest(df, df, 1).orderBy("query_id").collect()]
    assert got == [(1, 2, 1), (2, 3, 1), (3, 2, 1)]


def test_statistics(spark):
    assert stats.mcnemar(0, 0) == (0.0, 1.0) and stats.wilcoxon(0, 0) == (0.0, 1.0)
    assert stats.wilcoxon(3, 1)[0] == 2.5
    counts = {(1, 1): 30, (0, 0): 50, (0, 1): 10, (1, 0): 10}
    rows = {r["metric"]: r for r in stats.bootstrap(spark, counts, 200).collect()}
    assert rows["accuracy"]["low"] <= 0.8 <= rows["accuracy"]["high"]
    again = {r["metric"]: r for r in stats.bootstrap(spark, counts, 200).collect()}
    assert rows == again
    paired = {(1, 1, 1): 20, (0, 0, 0): 20, (1, 0, 1): 10}
    p = {r["metric"]: r["p"] for r in stats.permutation(spark, paired, 200).collect()}
    assert p["recall"] < 0.05


def test_keep_first_is_greedy(spark):
    ids = spark.createDataFrame([(i,) for i in range(5)], "id long")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "i long, j long")
    assert {r["id"]: r["kept"] for r in curate.keep_first(ids, pairs).collect()} == {0: True, 1: False, 2: True, 3: False, 4: True}


def test_spans_and_ranges(spark):
    assert align._spans("the cat sat", "a cat sat", 0.9, 4) == [(4, 11, 2, 9, False)]
    assert align._spans("", "x", 0.9, 4) == []
    df = spark.createDataFrame([(1, 0, 3, False), (1, 3, 5, True), (1, 7, 9, False), (1, 4, 4, True)], "id long, start long, end long, strong boolean")
    assert sorted(tuple(r) for r in merge_ranges(df).collect()) == [(1, 0, 5, True), (1, 7, 9, False)]


def test_running_totals(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 2, 3), ("b", 1, 5)], "g string, o long, n long")
    assert sorted((r["g"], r["o"], r["total_n"]) for r in running_totals(df, "g", "o", ["n"]).collect()) == [("a", 1, 2), ("a", 2, 5), ("b", 1, 5)]


def column(spark, values, make, kind="string"):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", make(F.col("v")).alias("x"))
    return [r["x"] for r in sorted(rows.collect(), key=lambda r: r["i"])]


def test_urls_equal_the_pattern(spark):
    """The pattern by Python's own engine, and the rules around it, on texts that end in marks."""
    import random
    import re
    from urllib.parse import urlparse

    from heron.functions import text as X

    r = random.Random(5)
    parts = ["http://", "https://", "HTTP://", "www.", "a.example", "x", "10.0.0.1", "4.5", "localhost", ":80", "/", "/p", ".", ")", ",", " ", "-", "@", "?q=1", "#t"]
    texts = ["see http://a.example/", "go to https://x.example/p.", "(http://a.example/p.)", "", "http://a.example/p/.)"] + ["".join(r.choice(parts) for _ in range(r.randint(1, 14))) for _ in range(400)]
    want = []
    for t in texts:
        found = []
        for m in re.finditer(X.URL, t):
            u = m[0]
            proper = u.startswith(("http://", "https://", "www.")) or ("." in u and not u.endswith(".") and len(u) > 3 and re.search(r"[a-zA-Z\-]", u))
            if proper and u not in found:
                found.append(u)
        want.append((",".join(u for u in found if urlparse(u).netloc), ",".join(found)))
    assert column(spark, texts, X.extract_urls) == [w for w, _ in want]
    assert column(spark, texts, lambda c: X.extract_urls(c, require_netloc=False)) == [w for _, w in want]
    assert column(spark, texts[:3], X.extract_urls) == ["http://a.example", "https://x.example/p", "http://a.example/p."]


def test_csv_fields_quote_by_quote(spark):
    import random

    from heron.functions import text as X

    def fields(line):
        out, now, inside, i = [], "", False, 0
        while i < len(line):
            c = line[i]
            if c == '"' and inside and line[i + 1 : i + 2] == '"':
                now, i = now + '"', i + 1
            elif c == '"':
                inside = not inside
            elif c == "," and not inside:
                out.append(now)
                now = ""
            else:
                now += c
            i += 1
        return [*out, now]

    r = random.Random(2)
    lines = ["", ",", '"a,b",c', '"a""b"', '""', '""""', 'x"y,z"w,', 'a,"unclosed, b'] + ["".join(r.choice('ab,""') for _ in range(r.randint(0, 12))) for _ in range(400)]
    assert column(spark, lines, X.csv_fields) == [fields(x) for x in lines]


def test_browser_file(spark, tmp_path):
    from heron.sources.messages import read_browser_csv

    p = tmp_path / "table.csv"
    p.write_bytes(b"\n Sender ,sender_email,Subject,Body,url\r\nx,a@b.c,s,see www.x.y\r\n\nno,,s,b,1\nx, d@e.f ,\"s, t\",b,1\n")
    got = sorted((r["sender"], r["receiver"], r["subject"], r["body"], r["url"]) for r in read_browser_csv(spark, f"file://{p}").collect())
    assert got == [("a@b.c", None, "s", "see www.x.y", 1), ("d@e.f", None, "s, t", "b", 1)]
    (tmp_path / "empty.csv").write_text("")
    assert read_browser_csv(spark, f"file://{tmp_path}/empty.csv").count() == 0


def test_bad_bytes_and_missing_objects(spark, tmp_path):
    from heron.sources.messages import read_json_object, read_tolerant

    (tmp_path / "t.csv").write_bytes(b"a,b\nx\xffy,1\nz,2\nw,3\n")
    rows = read_tolerant(spark, f"file://{tmp_path}/t.csv", "a string, b int")
    assert sorted(map(tuple, rows.collect())) == [("w", 3), ("xy", 1), ("z", 2)]
    assert read_tolerant(spark, f"file://{tmp_path}/t.csv", "a string, b int", limit=2).count() == 2
    (tmp_path / "m.json").write_text('{"a":\n [1, 2]}')
    assert read_json_object(spark, f"file://{tmp_path}/m.json") == {"a": [1, 2]} and read_json_object(spark, f"file://{tmp_path}/none.json") == {}


def test_keyed_digest(spark):
    import hashlib
    import hmac

    from heron.functions import text as X

    for key in ("k", "a key of more than sixty-four bytes " * 3):
        assert column(spark, ["", "é:1:x"], lambda c, key=key: X.hmac_sha256(key, c)) == [hmac.new(key.encode(), m.encode(), hashlib.sha256).hexdigest() for m in ("", "é:1:x")]


def test_places_and_quantiles(spark):
    import numpy as np

    from heron.operators.ranks import quantiles, ranked
    from heron.sources.sinks import split_by_position

    x = np.random.default_rng(1).permutation(500).astype(float)
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(7)
    placed, n = ranked(df, "x")
    assert n == 500 and all(r["place"] == r["x"] for r in placed.collect())
    assert np.allclose(quantiles(df.unionByName(df.filter("x < 3")), "x", [0, 0.33, 0.5, 1]), np.quantile(np.r_[x, 0, 1, 2], [0, 0.33, 0.5, 1]))
    assert quantiles(df.limit(0), "x", [0.5]) == [None]
    for ratio, want in ((0.7, [350, 150]), ([0.7, 0.15], [350, 75, 75]), (0.0, [0, 500])):
        part = {r["part"]: r["count"] for r in split_by_position(df, "x", ratio).groupBy("part").count().collect()}
        assert [part.get(k, 0) for k in range(len(want))] == want
    assert split_by_position(df.limit(0), "x", 0.5).count() == 0


def test_spans_by_plain_recursion():
    import random
    from functools import lru_cache

    from heron.operators.align import _spans

    r = random.Random(3)
    for _ in range(200):
        a, b = (" ".join(r.choice("abcd") for _ in range(r.randint(0, 7))) for _ in range(2))
        u, v = a.split(), b.split()

        @lru_cache(None)
        def most(i, j, u=tuple(u), v=tuple(v)):
            if not i or not j:
                return 0
            return most(i - 1, j - 1) + 1 if u[i - 1] == v[j - 1] else max(most(i - 1, j), most(i, j - 1))

        found = _spans(a, b, 0.9, 4)
        assert sum(len(a[s:e].split()) for s, e, *_ in found) == most(len(u), len(v))
        assert all(a[s:e] == b[x:y] for s, e, x, y, _ in found) and [s[0] for s in found] == sorted(s[0] for s in found)
        share = most(len(u), len(v)) / max(len(u), len(v), 1)
        assert all(strong == (share >= 0.9 or len(a[s:e].split()) >= 4) for s, e, _, _, strong in found)


def test_offsets_of_sentences_and_tokens(spark):
    import re

    texts = ["One. Two? It's 3!\n\nfour", "", "...", "no end", " a  b .c", "é😀. Ünder's x'y'z", "!x"]
    got = [r["x"] for r in _column_rows(spark, texts, lambda c: X.sentence_offsets(c))]
    want = [[(m.start(), m.end(), m[0]) for m in re.finditer(X.SENTENCE, t)] or [(0, len(t), t)] for t in texts]
    assert [[tuple(s) for s in x] for x in got] == want
    got = [r["x"] for r in _column_rows(spark, texts, lambda c: F.flatten(F.transform(X.sentence_offsets(c), X.token_offsets)))]
    want = [[(s + m.start(), s + m.end(), m[0].lower()) for s, _, x in w for m in re.finditer(X.TOKEN, x)] for w in want]
    assert [[tuple(s) for s in x] for x in got] == want


def _column_rows(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", make(F.col("v")).alias("x"))
    return sorted(rows.collect(), key=lambda r: r["i"])


def test_short_digest_and_sets(spark):
    def digest(text):
        data = text.encode("utf-16-be")
        a, b, m = 0x811C9DC5, 0x9E3779B9, 2**32
        for i in range(0, len(data), 2):
            c = data[i] * 256 + data[i + 1]
            a, b = (a ^ c) * 0x01000193 % m, b ^ (c + b + b * 64 % m + b // 4) % m
        x, y = a ^ (b << 13 & m - 1 | b >> 19), b ^ (a << 11 & m - 1 | a >> 21)
        return bytes([x & 255, x >> 8 & 255, x >> 16 & 255, y & 255, y >> 8 & 255, (x ^ y) >> 16 & 255]).hex()

    texts = ["", "a", "anonymous:1:url", "é😀\x00", "x" * 300]
    assert [r["x"] for r in _column_rows(spark, texts, X.short_digest)] == [digest(t) for t in texts]
    df = spark.createDataFrame([(["a", "b"], ["b", "a", "a"]), (["a"], ["a", "b"]), ([], None), (None, ["a"])], "p array<string>, q array<string>")
    assert [r[0] for r in df.select(X.same_set(F.col("p"), F.col("q"))).collect()] == [True, False, True, False]


def test_permutation_is_exact(spark):
    import itertools
    import random

    import numpy as np

    r = random.Random(6)
    for _ in range(12):
        rows = [tuple(r.randint(0, 1) for _ in range(3)) for _ in range(r.randint(1, 11))]
        counts = {k: rows.count(k) for k in set(rows)}
        differ = [i for i, (_, a, b) in enumerate(rows) if a != b]

        def difference(rows):
            def one(at):
                return stats.metrics(*(np.array([float(sum((x[0], x[at]) == k for x in rows))]) for k in ((1, 1), (0, 0), (0, 1), (1, 0))))[0]

            return one(2) - one(1)

        seen, hits, n = difference(rows), np.zeros(4), 0
        for flips in itertools.product([False, True], repeat=len(differ)):
            swapped = list(rows)
            for i, f in zip(differ, flips, strict=True):
                y, a, b = rows[i]
                swapped[i] = (y, b, a) if f else rows[i]
            hits, n = hits + (np.abs(difference(swapped)) >= np.abs(seen) - 1e-12), n + 1
        got = {x["metric"]: (x["observed"], x["p"]) for x in stats.permutation_exact(spark, counts).collect()}
        assert all(math.isclose(got[m][0], seen[k], abs_tol=1e-12) and math.isclose(got[m][1], hits[k] / n, abs_tol=1e-9) for k, m in enumerate(stats.NAMES))


def test_permutation_by_sampling_and_at_any_size(spark):
    counts = {(1, 1, 1): 40, (1, 0, 1): 25, (1, 1, 0): 12, (0, 0, 0): 60, (0, 1, 0): 9, (0, 0, 1): 14, (0, 1, 1): 5, (1, 0, 0): 8}
    exact = {r["metric"]: r["p"] for r in stats.permutation_exact(spark, counts).collect()}
    drawn = {r["metric"]: r["p"] for r in stats.permutation(spark, counts, 4000).collect()}
    assert all(abs(exact[m] - drawn[m]) < 0.03 for m in stats.NAMES)
    large = {k: 10**7 * n for k, n in counts.items()}
    assert all(r["p"] < 1e-9 for r in stats.permutation_exact(spark, large).filter("metric IN ('accuracy', 'recall')").collect())
    assert all(r["p"] == 1.0 for r in stats.permutation_exact(spark, {(1, 1, 1): 3, (0, 1, 0): 2, (0, 0, 1): 2}).collect())


def test_lines_are_split_with_their_header(spark):
    from heron.sources.sinks import split_lines

    lines = spark.createDataFrame([(k, f"row {k}") for k in range(9)], "at long, line string")
    parts = {}
    for r in split_lines(lines, "header", 0.5).collect():
        parts.setdefault(r["part"], set()).add(r["line"])
    assert parts == {0: {"header", *(f"row {k}" for k in range(4))}, 1: {f"row {k}" for k in range(4, 9)}}
    assert [r["part"] for r in split_lines(lines.limit(0), "header", 0.5).collect()] == [1]
