"""Confusion metrics, sweeps over thresholds and weights, and failure taxonomies.

Variants never rescore messages: each row is exploded into one small row per variant, and one
aggregation by variant gives all metrics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heron.operators.rules import RULES, WEIGHTS, score_of

METRICS = ["tp", "tn", "fp", "fn", "accuracy", "precision", "recall", "f1", "fpr"]
#: Rule groups that ablations drop; fixed values.
GROUPS = {
    "no_url": ["ip_literal_link", "shortened_url", "url_present"], "no_urgency": ["urgency"], "no_creds": ["creds_request"],
    "no_auth": ["missing_mx", "no_spf", "no_dmarc"], "no_brand": ["freemail_brand_claim", "lookalike_domain"],
}
#: Operating points: name, low, high, sim high, avg3 high; fixed values.
POINTS = [
    ("Baseline (Pipeline)", 2, 5, 0.70, 0.68), ("Conservative", 1, 4, 0.65, 0.60), ("Balanced", 1, 3, 0.60, 0.55),
    ("Moderate", 0, 3, 0.55, 0.50), ("Aggressive", 0, 2, 0.50, 0.45),
]


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, *by: str, label: str = "label", pred: str = "pred") -> DataFrame:
    """The metrics of 0/1 predictions for each group; rows without a label are left out, empty denominators give 0."""
    y, p = F.col(label), F.col(pred)
    agg = df.filter(y.isin(0, 1)).groupBy(*by).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"), F.count_if((y == 1) & (p == 0)).alias("fn"),
    )
    tp, tn, fp, fn = (F.col(c) for c in METRICS[:4])
    out = agg.withColumns({"accuracy": ratio(tp + tn, tp + tn + fp + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "fpr": ratio(fp, fp + tn)})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select(*by, *METRICS)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c, t in df.dtypes if t == "double"})


def variants(df: DataFrame, weights: dict[str, dict[str, int]], keep: list[str]) -> DataFrame:
    """One row (variant, score, *keep) for each message and weighting."""
    scores = F.array(*(F.struct(F.lit(n).alias("variant"), score_of(w).alias("score")) for n, w in weights.items()))
    return df.select(*keep, F.explode(scores).alias("x")).select("x.variant", "x.score", *keep)


def group_ablations() -> dict[str, dict[str, int]]:
    """The default weights, and copies with one group at zero."""
    return {"baseline": dict(WEIGHTS)} | {n: {k: 0 if k in drop else v for k, v in WEIGHTS.items()} for n, drop in GROUPS.items()}


def leave_one_out() -> dict[str, dict[str, int]]:
    return {"baseline": dict(WEIGHTS)} | {r: WEIGHTS | {r: 0} for r in RULES}


def importance(metrics: DataFrame) -> DataFrame:
    """metrics by variant with a baseline row -> each rule's change, importance and level."""
    base = metrics.filter("variant = 'baseline'").select(F.col("precision").alias("bp"), F.col("recall").alias("br"), F.col("fpr").alias("bf"))
    # One row on the right.
    d = metrics.filter("variant <> 'baseline'").join(F.broadcast(base), F.lit(True)).select(
        F.col("variant").alias("rule"), (F.col("recall") - F.col("br")).alias("d_recall"), (F.col("fpr") - F.col("bf")).alias("d_fpr"), (F.col("precision") - F.col("bp")).alias("d_precision")
    )
    score = 2 * F.abs("d_recall") + 1.5 * F.abs("d_fpr") + F.abs("d_precision")
    return d.withColumn("importance", score).withColumn("level", F.when(F.round("importance", 9) >= 0.10, "HIGH").when(F.round("importance", 9) >= 0.03, "MEDIUM").otherwise("LOW"))


def sweep(df: DataFrame, low: int, high: int, by: list[str] = ()) -> DataFrame:
    """Metrics of score >= t for each t from low to high."""
    rows = df.select("label", "score", *by, F.explode(F.sequence(F.lit(low), F.lit(high))).alias("t"))
    return confusion(rows.withColumn("pred", (F.col("score") >= F.col("t")).cast("int")), *by, "t")


def similarity_grid(df: DataFrame, tops: list[int], avgs: list[int]) -> DataFrame:
    """Metrics of the fused prediction for each pair of thresholds in hundredths."""
    pairs = F.array(*(F.struct(F.lit(a).alias("top_t"), F.lit(b).alias("avg_t")) for a in tops for b in avgs))
    rows = df.select("label", "verdict", "top_sim", "avg_top3", F.explode(pairs).alias("g")).select("*", "g.*")
    t, a = F.round("top_sim", 9) * 100 >= F.col("top_t"), F.round("avg_top3", 9) * 100 >= F.col("avg_t")
    pred = (F.col("verdict") == "phishing") | t | ((F.col("verdict") == "needs_review") & a)
    return confusion(rows.withColumn("pred", pred.cast("int")), "top_t", "avg_t")


def operating_points(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Metrics of the named configurations over rows with score, top_sim and avg_top3."""
    points = F.array(*(F.struct(F.lit(n).alias("mode"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(s).alias("sim"), F.lit(a).alias("avg")) for n, lo, hi, s, a in POINTS))
    rows = df.select("label", "score", "top_sim", "avg_top3", *by, F.explode(points).alias("p")).select("*", "p.*")
    review = (F.col("score") >= F.col("lo")) & (F.col("score") < F.col("hi"))
    pred = (F.col("score") >= F.col("hi")) | (F.round("top_sim", 9) >= F.col("sim")) | (review & (F.round("avg_top3", 9) >= F.col("avg")))
    return confusion(rows.withColumn("pred", pred.cast("int")), "mode", *by)


def false_negative_kind(score: Column, reasons: Column, body: Column, has_url: Column) -> Column:
    dns = F.exists(reasons, lambda r: F.contains(r, F.lit("valid MX")) | F.contains(r, F.lit("SPF present")) | F.contains(r, F.lit("DMARC present")))
    return F.when(score == 0, "zero_score").when(dns, "legitimate_dns").when(~has_url, "no_urls").when(F.length(body) < 200, "low_signal_content").when(score < 2, "below_threshold").otherwise("multiple_factors")


def false_positive_kind(reasons: Column) -> Column:
    return F.when(F.size(reasons) >= 2, "multiple_weak_signals").otherwise("unknown")


