"""Queries on evaluation, sweeps, statistics and costs."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heron.functions.text import reason_tag
from heron.operators import cost, evaluate as E, stats
from heron.operators.evaluate import confusion, rounded
from heron.operators.fusion import Thresholds
from heron.operators.rules import RULES
from heron.plans import oracle_base as B
from heron.plans.book import query
from heron.plans.session import cut, shared_dir
from heron.plans.q_vectors import V, fused, fused_sql, knn_sql, phish_neighbors
from heron.plans.views import scored, unnest, vectors, with_attacks
from heron.operators.vectors import nearest, similarity_stats
from heron.sources.messages import read_json_object

P1, P1D = B.phase1(False), B.phase1(True)


def metric_sql(source: str, by: str = "", label: str = "label", pred: str = "pred") -> str:
    """A query of the metrics of source (label, pred) by the given columns."""
    head = f"{by}, " if by else ""
    return f"""SELECT {head}tp, tn, fp, fn, round(coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0), 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall,
 round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, round(coalesce(CAST(fp AS DOUBLE) / nullif(fp + tn, 0), 0), 6) AS fpr FROM (
 SELECT *, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS p, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS r FROM (
 SELECT {head}CAST(sum(CAST({label} = 1 AND {pred} = 1 AS INT)) AS BIGINT) AS tp, CAST(sum(CAST({label} = 0 AND {pred} = 0 AS INT)) AS BIGINT) AS tn, CAST(sum(CAST({label} = 0 AND {pred} = 1 AS INT)) AS BIGINT) AS fp, CAST(sum(CAST({label} = 1 AND {pred} = 0 AS INT)) AS BIGINT) AS fn
 FROM {source} WHERE {label} IN (0, 1) {"GROUP BY " + by if by else ""}))"""


@query("confusion_metrics", f"WITH {P1D}, s AS (SELECT label, CAST(score >= 2 AS INT) AS pred FROM p1) {metric_sql('s')}")
def confusion_metrics(spark, sf_dir):
    return rounded(confusion(scored(spark, sf_dir, dns=True).withColumn("pred", (F.col("score") >= 2).cast("int"))))


@query("evaluate_pipeline", f"WITH {P1}, s AS (SELECT label, CAST(verdict <> 'benign' AS INT) AS pred, n_pii, len(reasons) AS k FROM p1) SELECT m.*, x.redactions, x.reasons FROM ({metric_sql('s')}) m, (SELECT CAST(sum(n_pii) AS BIGINT) AS redactions, CAST(sum(k) AS BIGINT) AS reasons FROM s WHERE label IN (0, 1)) x")
def evaluate_pipeline(spark, sf_dir):
    """Redaction, scoring without lookups, prediction, and the totals of both."""
    s = scored(spark, sf_dir).filter("label in (0, 1)").withColumn("pred", (F.col("verdict") != "benign").cast("int"))
    totals = s.agg(F.sum("n_pii").cast("long").alias("redactions"), F.sum(F.size("reasons")).cast("long").alias("reasons"))
    return rounded(confusion(s)).crossJoin(totals)


@query("metrics_by_creator", f"WITH {P1D}, s AS (SELECT created_by, label, CAST(score >= 2 AS INT) AS pred FROM p1) {metric_sql('s', 'created_by')}")
def metrics_by_creator(spark, sf_dir):
    return rounded(confusion(scored(spark, sf_dir, dns=True).withColumn("pred", (F.col("score") >= 2).cast("int")), "created_by"))


@query("metrics_by_emotion", f"WITH {P1D}, s AS (SELECT unnest(list_distinct([lang, cue])) AS emotion, label, CAST(score >= 2 AS INT) AS pred FROM p1) {metric_sql('s', 'emotion')}")
def metrics_by_emotion(spark, sf_dir):
    s = scored(spark, sf_dir, dns=True).withColumn("pred", (F.col("score") >= 2).cast("int"))
    return rounded(confusion(s.select("label", "pred", F.explode(F.array_distinct("emotions")).alias("emotion")), "emotion"))


def _union(weights):
    return "s AS (" + " UNION ALL ".join(f"SELECT '{n}' AS variant, label, CAST({B.score(w)} >= 2 AS INT) AS pred FROM p1" for n, w in weights.items()) + ")"


def _variants(spark, sf_dir, weights):
    rows = E.variants(scored(spark, sf_dir, dns=True), weights, ["label"])
    return confusion(rows.withColumn("pred", (F.col("score") >= 2).cast("int")), "variant")


@query("weight_ablations", f"WITH {P1D}, {_union(E.group_ablations())} {metric_sql('s', 'variant')}")
def weight_ablations(spark, sf_dir):
    return rounded(_variants(spark, sf_dir, E.group_ablations()))


@query("loo_importance", f"""WITH {P1D}, {_union(E.leave_one_out())}, c AS (SELECT variant, sum(CAST(label = 1 AND pred = 1 AS INT)) AS tp, sum(CAST(label = 0 AND pred = 0 AS INT)) AS tn, sum(CAST(label = 0 AND pred = 1 AS INT)) AS fp, sum(CAST(label = 1 AND pred = 0 AS INT)) AS fn FROM s WHERE label IN (0, 1) GROUP BY variant),
q AS (SELECT variant, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS p, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS r, coalesce(CAST(fp AS DOUBLE) / nullif(fp + tn, 0), 0) AS f FROM c),
d AS (SELECT q.variant AS rule, q.r - b.r AS d_recall, q.f - b.f AS d_fpr, q.p - b.p AS d_precision FROM q, (SELECT * FROM q WHERE variant = 'baseline') b WHERE q.variant <> 'baseline'),
i AS (SELECT *, 2 * abs(d_recall) + 1.5 * abs(d_fpr) + abs(d_precision) AS importance FROM d)
SELECT rule, round(d_recall, 6) AS d_recall, round(d_fpr, 6) AS d_fpr, round(d_precision, 6) AS d_precision, round(importance, 6) AS importance, CASE WHEN round(importance, 9) >= 0.10 THEN 'HIGH' WHEN round(importance, 9) >= 0.03 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM i""")
def loo_importance(spark, sf_dir):
    out = rounded(E.importance(_variants(spark, sf_dir, E.leave_one_out())))
    return out.orderBy(F.desc("importance"), F.desc(F.abs("d_recall")), "rule")


@query("rule_coverage", f"""WITH {P1D}, s AS (SELECT label, score, unnest([{', '.join(f"CASE WHEN {r} > 0 THEN '{r}' END" for r in RULES)}]) AS rule FROM p1)
SELECT rule, CAST(sum(CAST(label = 1 AS INT)) AS BIGINT) AS phish, CAST(sum(CAST(label = 0 AS INT)) AS BIGINT) AS benign, CAST(sum(CAST(label = 1 AND score >= 2 AS INT)) AS BIGINT) AS tp, CAST(sum(CAST(label = 0 AND score >= 2 AS INT)) AS BIGINT) AS fp, round(sum(CAST(label = 1 AS INT)) / count(*), 6) AS precision
FROM s WHERE rule IS NOT NULL AND label IN (0, 1) GROUP BY rule""")
def rule_coverage(spark, sf_dir):
    hit = F.array_compact(F.array(*(F.when(F.col(r) > 0, F.lit(r)) for r in RULES)))
    s = unnest(scored(spark, sf_dir, dns=True).filter("label in (0, 1)").withColumn("hit", hit), "hit", "rule", "label", "score")
    on = F.col("score") >= 2
    return s.groupBy("rule").agg(
        F.count_if(F.col("label") == 1).alias("phish"), F.count_if(F.col("label") == 0).alias("benign"), F.count_if((F.col("label") == 1) & on).alias("tp"), F.count_if((F.col("label") == 0) & on).alias("fp"),
        F.round(F.avg((F.col("label") == 1).cast("double")), 6).alias("precision"),
    )


@query("threshold_sweep", f"WITH {P1D}, s AS (SELECT t, label, CAST(score >= t AS INT) AS pred FROM p1, (SELECT CAST(unnest(range(1, 11)) AS INT) AS t)) {metric_sql('s', 't')}")
def threshold_sweep(spark, sf_dir):
    return rounded(E.sweep(scored(spark, sf_dir, dns=True), 1, 10))


@query("threshold_best", f"WITH {P1D}, s AS (SELECT t, label, CAST(score >= t AS INT) AS pred FROM p1, (SELECT CAST(unnest(range(1, 11)) AS INT) AS t)), q AS ({metric_sql('s', 't')}) SELECT t, f1, precision FROM q ORDER BY precision >= 0.3 DESC, f1 DESC, t LIMIT 1")
def threshold_best(spark, sf_dir):
    """The best F1 among thresholds of enough precision, else the best of all; the first wins."""
    m = rounded(E.sweep(scored(spark, sf_dir, dns=True), 1, 10))
    return m.orderBy(F.desc(F.col("precision") >= 0.3), F.desc("f1"), "t").limit(1).select("t", "f1", "precision")


@query("threshold_tune_val_test", f"""WITH {P1D}, s AS (SELECT id % 2 AS part, t, label, CAST(score >= t AS INT) AS pred FROM p1, (SELECT CAST(unnest(range(0, 13)) AS INT) AS t)), q AS ({metric_sql('s', 'part, t')}), b AS (SELECT t FROM q WHERE part = 0 ORDER BY f1 DESC, t LIMIT 1)
SELECT q.part, q.t, q.f1, q.precision, q.recall FROM q JOIN b ON q.t = b.t""")
def threshold_tune_val_test(spark, sf_dir):
    """The threshold that is best on the validation half, on both halves."""
    m = rounded(E.sweep(scored(spark, sf_dir, dns=True).withColumn("part", F.col("id") % 2), 0, 12, ["part"]))
    best = m.filter("part = 0").orderBy(F.desc("f1"), "t").limit(1).select("t")
    return m.join(F.broadcast(best), "t").select("part", "t", "f1", "precision", "recall")


_TOPS, _AVGS = list(range(40, 80, 5)), list(range(35, 75, 5))
_GRID = f"g AS (SELECT * FROM (SELECT unnest({_TOPS}) AS top_t), (SELECT unnest({_AVGS}) AS avg_t)), s AS (SELECT top_t, avg_t, label, CAST(verdict = 'phishing' OR round(top_sim, 9) * 100 >= top_t OR (verdict = 'needs_review' AND round(avg_top3, 9) * 100 >= avg_t) AS INT) AS pred FROM f, g)"


@query("similarity_grid", f"WITH {fused_sql()}, {_GRID} {metric_sql('s', 'top_t, avg_t')}")
def similarity_grid(spark, sf_dir):
    return rounded(E.similarity_grid(fused(spark, sf_dir), _TOPS, _AVGS))


@query("similarity_grid_best", f"WITH {fused_sql()}, {_GRID}, q AS ({metric_sql('s', 'top_t, avg_t')}) SELECT top_t, avg_t, f1 FROM q ORDER BY precision >= 0.3 DESC, f1 DESC, top_t, avg_t LIMIT 1")
def similarity_grid_best(spark, sf_dir):
    m = rounded(E.similarity_grid(fused(spark, sf_dir), _TOPS, _AVGS))
    return m.orderBy(F.desc(F.col("precision") >= 0.3), F.desc("f1"), "top_t", "avg_t").limit(1).select("top_t", "avg_t", "f1")


_POINTS = "pt AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {lo}, {hi}, {s}, {a})" for n, lo, hi, s, a in E.POINTS) + ") AS v(mode, lo, hi, sim, av)), s AS (SELECT mode, f.created_by, label, CAST(score >= hi OR round(top_sim, 9) >= sim OR (score >= lo AND round(avg_top3, 9) >= av) AS INT) AS pred FROM f, pt)"


@query("operating_points", f"WITH {fused_sql()}, {_POINTS} {metric_sql('s', 'mode')}")
def operating_points(spark, sf_dir):
    return rounded(E.operating_points(fused(spark, sf_dir)))


@query("operating_points_by_category", f"""WITH {fused_sql()}, {_POINTS}, cats AS (SELECT DISTINCT created_by AS category FROM m), s2 AS (SELECT s.mode, s.created_by AS category, label, pred FROM s WHERE label = 1 UNION ALL SELECT s.mode, category, label, pred FROM s, cats WHERE label = 0) {metric_sql('s2', 'mode, category')}""")
def operating_points_by_category(spark, sf_dir):
    """Each category's positives against the same negatives: negatives are counted once and joined to the categories' counts."""
    rows = fused(spark, sf_dir)
    m = cut(E.operating_points(rows.withColumn("category", F.col("created_by")), ["category"]), "points")
    neg = m.groupBy("mode").agg(F.sum("tn").alias("tn"), F.sum("fp").alias("fp"))
    categories = rows.select(F.col("created_by").alias("category")).distinct()
    grid = neg.join(F.broadcast(categories), F.lit(True))
    both = grid.join(m.select("mode", "category", "tp", "fn"), ["mode", "category"], "left").fillna(0, ["tp", "fn"])
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    out = both.withColumns({"accuracy": E.ratio(tp + tn, tp + tn + fp + fn), "precision": E.ratio(tp, tp + fp), "recall": E.ratio(tp, tp + fn), "fpr": E.ratio(fp, fp + tn)})
    out = out.withColumn("f1", E.ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return rounded(out.select("mode", "category", *E.METRICS))


_KS = [4, 8, 16, 32]


@query("k_ablation", f"""WITH {B.phase1(True)}, {V}, {knn_sql('true', 'true', 32)}, ks AS (SELECT unnest({_KS}) AS k),
st AS (SELECT query_id, k, max(CASE WHEN label = 1 THEN similarity END) AS top_sim FROM nn JOIN ks ON rank <= k GROUP BY query_id, k),
s AS (SELECT ks.k, label, CAST(verdict = 'phishing' OR round(coalesce(top_sim, 0), 9) >= 0.30 AS INT) AS pred FROM p1 CROSS JOIN ks LEFT JOIN st ON st.query_id = p1.id % (SELECT count(*) FROM v) AND st.k = ks.k)
{metric_sql('s', 'k')}""")
def k_ablation(spark, sf_dir):
    """Prefixes of one list of the 32 nearest serve every k."""
    v = vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "v", "label")
    n = v.count()
    near = nearest(v, v, max(_KS)).join(v.filter("label = 1").select("id"), "id")
    tops = near.groupBy("query_id").agg(*(F.max(F.when(F.col("rank") <= k, F.col("similarity"))).alias(f"top_{k}") for k in _KS))
    p1 = scored(spark, sf_dir, dns=True).select("label", "verdict", (F.col("id") % n).alias("vid"))
    rows = p1.join(tops, F.col("vid") == F.col("query_id"), "left")
    each = F.array(*(F.struct(F.lit(k).alias("k"), F.coalesce(f"top_{k}", F.lit(0.0)).alias("top")) for k in _KS))
    pred = ((F.col("verdict") == "phishing") | (F.round("x.top", 9) >= 0.30)).cast("int")
    return rounded(confusion(rows.select("label", "verdict", F.explode(each).alias("x")).select("label", F.col("x.k").alias("k"), pred.alias("pred")), "k"))


@query("failure_taxonomy", f"""WITH {P1D}, k AS (SELECT CASE WHEN label = 1 AND score < 5 THEN 'fn' WHEN label = 0 AND score >= 5 THEN 'fp' END AS side,
 CASE WHEN label = 1 THEN CASE WHEN score = 0 THEN 'zero_score' WHEN urls <> 1 THEN 'no_urls' WHEN length(body) < 200 THEN 'low_signal_content' WHEN score < 2 THEN 'below_threshold' ELSE 'multiple_factors' END
 ELSE CASE WHEN len(reasons) >= 2 THEN 'multiple_weak_signals' ELSE 'unknown' END END AS kind FROM p1 WHERE label IN (0, 1)), c AS (SELECT side, kind, count(*) AS n FROM k WHERE side IS NOT NULL GROUP BY side, kind)
SELECT side, kind, n, round(100.0 * n / sum(n) OVER (PARTITION BY side), 6) AS pct FROM c""")
def failure_taxonomy(spark, sf_dir):
    from pyspark.sql import Window as W

    s = scored(spark, sf_dir, dns=True).filter("label in (0, 1)")
    side = F.when((F.col("label") == 1) & (F.col("score") < 5), "fn").when((F.col("label") == 0) & (F.col("score") >= 5), "fp")
    kind = F.when(F.col("label") == 1, E.false_negative_kind(F.col("score"), F.col("reasons"), F.col("body"), F.col("urls") == 1)).otherwise(E.false_positive_kind(F.col("reasons")))
    c = s.select(side.alias("side"), kind.alias("kind")).filter("side is not null").groupBy("side", "kind").agg(F.count("*").alias("n"))
    return c.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy("side")), 6))


#: What counts as a specific citation for each tag, and what the reasons must speak of.
CITATIONS = {
    "AUTH": ["no mx", "missing mx", "mx missing", "mx record", "no spf", "spf not present", "spf missing", "spf record", "no dmarc", "dmarc not present", "dmarc missing", "lack of dmarc", "without dmarc", "dmarc policy", "dmarc record", ".com", ".xyz", ".net"],
    "URL": ["ip literal", "ip address", "http://", "https://", "domain mismatch", "shortener", "shortened url", "short link", "bit.ly", "tinyurl"],
    "URGENCY": ["urgent", "immediately", "verify", "suspended", "24 hours", "expires", "account", "action required", "confirm", "freeze", "frozen", "security check", "15min", "available", "expire in", "complete this", "detected", "keyword", "violation"],
    "CONTENT": ["credential", "password", "verify identity", "phi"],
}
TOPICS = {
    "AUTH": ["mx", "spf", "dmarc", "dns", "domain"], "URL": ["url", "link", "ip literal", "shortener", "domain mismatch"],
    "URGENCY": ["urgency", "keyword"], "CONTENT": ["credential", "phi", "password", "verify", "identity"],
}


def _ground(tag, reason, low, reasons):
    """Tag-specific checks of whether an explanation cites what was found."""
    def some(words):
        hit = F.lit(False)
        for w in words:
            # The reasons in one string: a phrase cannot reach over the line break between two of them.
            hit = hit | F.contains(F.lower(F.array_join(reasons, "\n")), F.lit(w))
        return hit

    def cites(words):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        return hit

    def judge(known, supported):
        return F.when(~known, "UNKNOWN").when(supported, "SUPPORTED").otherwise("UNSUPPORTED")

    auth, url, urgency, content = (CITATIONS[t] for t in ("AUTH", "URL", "URGENCY", "CONTENT"))
    return (
        F.when(tag == "AUTH", judge(some(TOPICS["AUTH"]), cites(auth)))
        .when(tag == "URL", judge(some(TOPICS["URL"]), cites(url) | reason.rlike(r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}")))
        .when(tag == "URGENCY", judge(some(TOPICS["URGENCY"]), cites(urgency)))
        .when(tag == "CONTENT", judge(some(TOPICS["CONTENT"]), cites(content)))
        .when(tag == "SIMILARITY", F.when(reason.rlike(r"\d\.\d+") | cites(["similarity", "similar"]), "SUPPORTED").otherwise("UNSUPPORTED"))
        .otherwise("UNKNOWN")
    )


#: Explanations made from a tag, a fixed phrase and some words of the message.
_EXPLAIN = """concat(CASE id % 7 WHEN 0 THEN '[AUTH] ' WHEN 1 THEN '[URL] ' WHEN 2 THEN '[URGENCY] ' WHEN 3 THEN '[CONTENT] ' WHEN 4 THEN '[SIMILARITY] ' WHEN 5 THEN '[NEW] ' ELSE '' END,
 CASE id % 11 WHEN 0 THEN 'No SPF record' WHEN 1 THEN 'weak auth of user@x.com' WHEN 2 THEN 'bit.ly link' WHEN 3 THEN 'pushy tone' WHEN 4 THEN 'score 0.71' WHEN 5 THEN 'asks for a Password' WHEN 6 THEN 'host 192.0.2.7'
 WHEN 7 THEN 'Account expires' WHEN 8 THEN 'similar text' WHEN 9 THEN 'lack of DMARC' ELSE 'tone' END, ' ', right(body, 30))"""


def _cited(tag, extra="false"):
    return f"CASE WHEN NOT {B.any_of('rs', TOPICS[tag])} THEN 'UNKNOWN' WHEN {B.any_of('low', CITATIONS[tag])} OR {extra} THEN 'SUPPORTED' ELSE 'UNSUPPORTED' END"


@query("groundedness_summary", f"""WITH {P1D}, e0 AS (SELECT {_EXPLAIN} AS r, lower(array_to_string(reasons, chr(10))) AS rs FROM p1), e AS (SELECT CASE WHEN regexp_matches(r, '^\\[[A-Z]+\\]') THEN regexp_extract(r, '^\\[([A-Z]+)\\]', 1) ELSE 'OTHER' END AS tag, r, lower(r) AS low, rs FROM e0),
g AS (SELECT tag, CASE tag WHEN 'AUTH' THEN {_cited("AUTH")} WHEN 'URL' THEN {_cited("URL", "regexp_matches(r, '[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}')")} WHEN 'URGENCY' THEN {_cited("URGENCY")} WHEN 'CONTENT' THEN {_cited("CONTENT")}
 WHEN 'SIMILARITY' THEN CASE WHEN regexp_matches(r, '[0-9][.][0-9]+') OR contains(low, 'similar') THEN 'SUPPORTED' ELSE 'UNSUPPORTED' END ELSE 'UNKNOWN' END AS s FROM e)
SELECT tag, count(*) AS total, CAST(sum(CAST(s = 'SUPPORTED' AS INT)) AS BIGINT) AS supported, CAST(sum(CAST(s = 'UNSUPPORTED' AS INT)) AS BIGINT) AS unsupported, CAST(sum(CAST(s = 'UNKNOWN' AS INT)) AS BIGINT) AS unknown, round(sum(CAST(s = 'SUPPORTED' AS INT)) / greatest(1, count(*)), 6) AS rate FROM g GROUP BY tag""")
def groundedness_summary(spark, sf_dir):
    from heron.functions.text import bracket_tag

    reason = F.expr(_EXPLAIN)
    s = scored(spark, sf_dir, dns=True).withColumn("r", reason).withColumn("tag", bracket_tag(F.col("r")))
    g = s.select("tag", _ground(F.col("tag"), F.col("r"), F.lower("r"), F.col("reasons")).alias("s"))
    ok = F.count_if(F.col("s") == "SUPPORTED")
    return g.groupBy("tag").agg(F.count("*").alias("total"), ok.alias("supported"), F.count_if(F.col("s") == "UNSUPPORTED").alias("unsupported"), F.count_if(F.col("s") == "UNKNOWN").alias("unknown"), F.round(ok / F.greatest(F.lit(1), F.count("*")), 6).alias("rate"))


@query("explanation_quality", f"WITH {P1D} SELECT verdict, count(*) AS n, round(avg(len(reasons)), 6) AS avg_tags, round(avg(CAST(len(reasons) > 0 AS INT)), 6) AS coverage, round(avg(length(array_to_string(reasons, ' | '))), 6) AS avg_length, CAST(max(len(reasons)) AS INT) AS most FROM p1 GROUP BY verdict")
def explanation_quality(spark, sf_dir):
    k = F.size("reasons")
    return scored(spark, sf_dir, dns=True).groupBy("verdict").agg(
        F.count("*").alias("n"), F.round(F.avg(k), 6).alias("avg_tags"), F.round(F.avg((k > 0).cast("int")), 6).alias("coverage"), F.round(F.avg(F.length(F.array_join("reasons", " | "))), 6).alias("avg_length"), F.max(k).alias("most"),
    )


_TAGS = f"WITH {P1D}, t AS (SELECT {B.reason_tag()} AS tag FROM (SELECT unnest(reasons) AS reason FROM p1))"


@query("explanation_tags", f"{_TAGS} SELECT tag, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM t), 6) AS pct, (SELECT count(DISTINCT tag) FROM t) AS unique_tags FROM t GROUP BY tag")
def explanation_tags(spark, sf_dir):
    """How often each tag explains a verdict, its share of all tags, and how many tags there are."""
    n = unnest(scored(spark, sf_dir, dns=True), "reasons", "reason").groupBy(reason_tag(F.col("reason")).alias("tag")).agg(F.count("*").alias("n"))
    # One row for each of ten tags at most.
    every = W.partitionBy()
    return n.select("tag", "n", F.round(100.0 * F.col("n") / F.sum("n").over(every), 6).alias("pct"), F.count("*").over(every).alias("unique_tags"))


@query("majority_baseline", f"WITH {B.MESSAGES}, t AS (SELECT label FROM m WHERE label IS NOT NULL GROUP BY label ORDER BY count(*) DESC, label LIMIT 1), s AS (SELECT m.label, t.label AS pred FROM m, t) {metric_sql('s')}")
def majority_baseline(spark, sf_dir):
    from heron.sources.messages import messages

    m = messages(spark, sf_dir).filter("label is not null").select("label")
    top = m.groupBy("label").count().orderBy(F.desc("count"), "label").limit(1).select(F.col("label").alias("pred"))
    return rounded(confusion(m.join(F.broadcast(top), F.lit(True))))


def _cells(spark, sf_dir):
    s = scored(spark, sf_dir, dns=True).withColumns({"a": (F.col("score") >= 2).cast("int"), "b": (F.col("score") >= 5).cast("int"), "pred": (F.col("score") >= 2).cast("int")})
    return s.select("label", "a", "b", "pred")


@query("bootstrap_ci")
def bootstrap_ci(spark, sf_dir):
    return rounded(stats.bootstrap(spark, stats.cells(_cells(spark, sf_dir), "label", "pred")))


@query("paired_bootstrap")
def paired_bootstrap(spark, sf_dir):
    return rounded(stats.paired_bootstrap(spark, stats.cells(_cells(spark, sf_dir), "label", "a", "b")))


def _metrics_sql(tp, fp):
    p, r = f"coalesce(({tp}) / nullif(({tp}) + ({fp}), 0), 0.0)", f"coalesce(({tp}) / nullif(n1, 0), 0.0)"
    return {"accuracy": f"coalesce((({tp}) + n0 - ({fp})) / nullif(n0 + n1, 0), 0.0)", "precision": p, "recall": r, "f1": f"coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0.0)"}


_AFTER, _BEFORE = (_metrics_sql("t + d1 - k1", "f + d0 - k0"), _metrics_sql("t + k1", "f + k0"))
_HALF = "exp(lgamma(d{0} + 1) - lgamma(k{0} + 1) - lgamma(d{0} - k{0} + 1) - d{0} * ln(2.0))"


@query("permutation_test", f"""WITH {P1D}, s AS (SELECT label AS y, score >= 2 AS a, score >= 5 AS b FROM p1 WHERE label IN (0, 1)),
c AS (SELECT CAST(count(*) FILTER (y = 1) AS DOUBLE) AS n1, CAST(count(*) FILTER (y = 0) AS DOUBLE) AS n0, CAST(count(*) FILTER (y = 1 AND a AND b) AS DOUBLE) AS t, CAST(count(*) FILTER (y = 0 AND a AND b) AS DOUBLE) AS f,
 count(*) FILTER (y = 1 AND a <> b) AS d1, count(*) FILTER (y = 0 AND a <> b) AS d0, count(*) FILTER (y = 1 AND a AND NOT b) AS o1, count(*) FILTER (y = 0 AND a AND NOT b) AS o0 FROM s),
g AS (SELECT c.*, CAST(x.k1 AS DOUBLE) AS k1, CAST(z.k0 AS DOUBLE) AS k0, x.k1 = o1 AND z.k0 = o0 AS seen, {_HALF.format('1')} * {_HALF.format('0')} AS w FROM c, LATERAL (SELECT unnest(range(0, d1 + 1)) AS k1) x, LATERAL (SELECT unnest(range(0, d0 + 1)) AS k0) z),
e AS ({' UNION ALL '.join(f"SELECT '{m}' AS metric, {_AFTER[m]} - {_BEFORE[m]} AS d, w, seen FROM g" for m in stats.NAMES)}),
o AS (SELECT metric, d AS observed FROM e WHERE seen) SELECT metric, round(any_value(observed), 6) AS observed, round(sum(CASE WHEN abs(d) >= abs(observed) - 1e-12 THEN w ELSE 0 END), 6) AS p FROM e JOIN o USING (metric) GROUP BY metric""")
def permutation_test(spark, sf_dir):
    """The exact distribution over all swaps."""
    return rounded(stats.permutation_exact(spark, stats.cells(_cells(spark, sf_dir), "label", "a", "b")))


_DISC = f"WITH {P1D}, s AS (SELECT label = CAST(score >= 2 AS INT) AS ra, label = CAST(score >= 5 AS INT) AS rb FROM p1 WHERE label IN (0, 1)), d AS (SELECT sum(CAST(ra AND NOT rb AS INT)) AS n01, sum(CAST(rb AND NOT ra AS INT)) AS n10 FROM s)"


def _discordant(spark, sf_dir):
    c = stats.cells(_cells(spark, sf_dir), "label", "a", "b")
    return sum(n for (y, a, b), n in c.items() if a == y != b), sum(n for (y, a, b), n in c.items() if b == y != a)


@query("mcnemar", f"{_DISC} SELECT CAST(n01 AS BIGINT) AS n01, CAST(n10 AS BIGINT) AS n10, round(coalesce((abs(n01 - n10) - 1) ** 2 / nullif(n01 + n10, 0), 0), 6) AS statistic FROM d")
def mcnemar(spark, sf_dir):
    n01, n10 = _discordant(spark, sf_dir)
    x, _ = stats.mcnemar(n01, n10)
    return spark.createDataFrame([(n01, n10, round(x, 6))], "n01 long, n10 long, statistic double")


@query("wilcoxon", f"{_DISC} SELECT CAST(n01 AS BIGINT) AS worse, CAST(n10 AS BIGINT) AS better, round(least(n01, n10) * (n01 + n10 + 1) / 2.0, 6) AS statistic FROM d")
def wilcoxon(spark, sf_dir):
    worse, better = _discordant(spark, sf_dir)
    w, _ = stats.wilcoxon(better, worse)
    return spark.createDataFrame([(worse, better, round(w, 6))], "worse long, better long, statistic double")


_COST = "attacks * 0.1 AS breaches_prevented, fp AS false_positives, 10000 * 0.00002 * 2 + 10000 * 0.131 * 0.001 + 10000 * 0.131 * 2 / 60 * 30 + fp * 15 / 60 * 50 AS total_cost_daily, attacks * 0.1 * 50000 AS risk_mitigated"


def _cost_sql(source, cols):
    return f"""SELECT {cols}, round(attacks, 6) AS attacks_detected, round(breaches_prevented, 6) AS breaches_prevented, round(false_positives, 6) AS false_positives, round(total_cost_daily, 4) AS total_cost_daily, round(risk_mitigated, 4) AS risk_mitigated,
 round(risk_mitigated - total_cost_daily, 4) AS net_benefit, round((risk_mitigated - total_cost_daily) / total_cost_daily, 4) AS roi FROM (SELECT *, {_COST} FROM (SELECT *, 440.0 * recall AS attacks, 9560.0 * fpr AS fp FROM {source}))"""


def _cost_rounded(df, *keep):
    names = ["attacks_detected", "breaches_prevented", "false_positives"]
    money = ["total_cost_daily", "risk_mitigated", "net_benefit", "roi"]
    return df.select(*keep, *(F.round(c, 6).alias(c) for c in names), *(F.round(c, 4).alias(c) for c in money))


_RATES = """coalesce(count(*) FILTER (label = 1 AND score >= 2) / CAST(nullif(count(*) FILTER (label = 1), 0) AS DOUBLE), 0.0) AS recall,
 coalesce(count(*) FILTER (label = 0 AND score >= 2) / CAST(nullif(count(*) FILTER (label = 0), 0) AS DOUBLE), 0.0) AS fpr FROM p1 WHERE label IN (0, 1)"""


def _rates(spark, sf_dir, *by):
    return confusion(scored(spark, sf_dir, dns=True).withColumn("pred", (F.col("score") >= 2).cast("int")), *by).select(*by, "recall", "fpr")


@query("cost_benefit", f"WITH {P1D}, q AS (SELECT created_by, {_RATES} GROUP BY created_by) " + _cost_sql("q", "created_by"))
def cost_benefit(spark, sf_dir):
    """Costs and benefits by what the rules reach on each creator's messages."""
    return _cost_rounded(cost.with_costs(_rates(spark, sf_dir, "created_by")), "created_by")


@query("cost_benefit_modes", f"WITH {fused_sql()}, {_POINTS}, q AS (SELECT mode, sum(CAST(label = 1 AND pred = 1 AS INT)) / CAST(sum(CAST(label = 1 AS INT)) AS DOUBLE) AS recall, sum(CAST(label = 0 AND pred = 1 AS INT)) / CAST(sum(CAST(label = 0 AS INT)) AS DOUBLE) AS fpr FROM s WHERE label IN (0, 1) GROUP BY mode) " + _cost_sql("q", "mode"))
def cost_benefit_modes(spark, sf_dir):
    return _cost_rounded(cost.with_costs(E.operating_points(fused(spark, sf_dir)).select("mode", "recall", "fpr")), "mode")


@query("scenario_comparison", f"""WITH {P1D}, q AS (SELECT {_RATES}), c AS ({_cost_sql('q', "'deployed' AS scenario")})
SELECT 'no_system' AS scenario, 0.0::DOUBLE AS cost, 2200000.0::DOUBLE AS residual_risk UNION ALL SELECT scenario, total_cost_daily, round(2200000.0 - risk_mitigated, 4) FROM c""")
def scenario_comparison(spark, sf_dir):
    """Cost and risk without and with the rules as they do on all labelled messages."""
    rates = _rates(spark, sf_dir)
    out = cost.scenarios(F.col("recall"), F.col("fpr"), rates)
    return out.select("scenario", F.round("cost", 4).alias("cost"), F.round("residual_risk", 4).alias("residual_risk"))


@query("tfidf_logreg")
def tfidf_logreg(spark, sf_dir):
    """A text classifier as baseline: one- and two-word TF-IDF and logistic regression, by even and odd ids."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, CountVectorizer, NGram, RegexTokenizer, SQLTransformer

    from heron.sources.messages import messages

    m = messages(spark, sf_dir).filter("label is not null").select("id", "label", F.concat("subject", F.lit("\n\n"), "body").alias("text"))
    steps = Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="w1", pattern=r"\W+"), NGram(n=2, inputCol="w1", outputCol="w2"),
        SQLTransformer(statement="SELECT *, concat(w1, w2) AS terms FROM __THIS__"), CountVectorizer(inputCol="terms", outputCol="tf", vocabSize=20000), IDF(inputCol="tf", outputCol="features"),
        LogisticRegression(maxIter=20, regParam=0.01),
    ])
    model = steps.fit(m.filter("id % 2 = 0"))
    scored_rows = model.transform(m.filter("id % 2 = 1")).select("label", F.col("prediction").cast("int").alias("pred"))
    return rounded(confusion(scored_rows))


@query("threshold_config", f"""WITH {V}, {knn_sql('q.label <> 1', 'c.label = 1', 8)}, st AS (SELECT max(similarity) AS t, avg(CASE WHEN rank <= 3 THEN similarity END) AS a FROM nn GROUP BY query_id),
r AS (SELECT 'report' AS source, round(0.5 + abs(avg(t)), 6) AS p, round(0.3 + abs(avg(a)) / 2, 6) AS a FROM st UNION ALL SELECT 'missing', NULL, NULL)
SELECT source, coalesce(p, 0.40) AS phish_top, coalesce(a, 0.35) AS phish_avg, CASE WHEN p IS NULL THEN 0.25 ELSE round(greatest(0.0, p - 0.15), 6) END AS review_top, CASE WHEN p IS NULL THEN 0.17 ELSE round(greatest(0.0, a - 0.18), 6) END AS review_avg FROM r""")
def threshold_config(spark, sf_dir):
    """Thresholds from a report that was written from measured similarities, and the defaults where there is none."""
    path = f"{shared_dir(spark)}/thresholds-{uuid.uuid4().hex}"
    found = similarity_stats(phish_neighbors(spark, sf_dir)).agg(F.round(0.5 + F.abs(F.avg("top_sim")), 6).alias("top_similarity_threshold"), F.round(0.3 + F.abs(F.avg("avg_top3")) / 2, 6).alias("avg_top3_threshold"))
    found.coalesce(1).write.json(path)
    both = [("report", Thresholds.of_report(read_json_object(spark, path))), ("missing", Thresholds.of_report(read_json_object(spark, path + "-none")))]
    rows = [(name, *(round(x, 6) for x in (t.phish_top, t.phish_avg, t.review_top, t.review_avg))) for name, t in both]
    return spark.createDataFrame(rows, "source string, phish_top double, phish_avg double, review_top double, review_avg double")


@query("k_ablation_ontology", f"WITH {P1D}, {B.ontology_ctes()}, a AS (SELECT DISTINCT id FROM attacks), s AS (SELECT label, CAST(score >= 5 OR (score >= 2 AND a.id IS NOT NULL) AS INT) AS pred FROM p1 LEFT JOIN a ON a.id = p1.id) {metric_sql('s')}")
def k_ablation_ontology(spark, sf_dir):
    """Review cases count as phishing where the ontology infers an attack."""
    s = with_attacks(spark, sf_dir)
    pred = ((F.col("score") >= 5) | ((F.col("score") >= 2) & (F.size("attacks") > 0))).cast("int")
    return rounded(confusion(s.withColumn("pred", pred)))


