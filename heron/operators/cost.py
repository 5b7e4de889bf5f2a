"""Costs and benefits of detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed default assumptions.
DEFAULTS = {
    "daily_emails": 10000.0, "phishing_rate": 0.044, "embedding_cost_per_email": 0.00002, "llm_cost_per_review": 0.001, "analyst_hourly_rate": 30.0,
    "minutes_per_review": 2.0, "false_positive_delay_minutes": 15.0, "clinical_hourly_cost": 50.0, "breach_cost_per_incident": 50000.0,
    "needs_review_rate": 0.131, "breach_share": 0.10,
}


def cost_columns(recall: Column, fpr: Column, **assumptions: float) -> dict[str, Column]:
    """Daily volumes, costs, mitigated risk, net benefit and return for a recall and a false positive rate."""
    a = DEFAULTS | assumptions
    phish, clean = a["daily_emails"] * a["phishing_rate"], a["daily_emails"] * (1 - a["phishing_rate"])
    detected, false_alarms = phish * recall, clean * fpr
    api = a["daily_emails"] * a["embedding_cost_per_email"] * 2 + a["daily_emails"] * a["needs_review_rate"] * a["llm_cost_per_review"]
    review = a["daily_emails"] * a["needs_review_rate"] * a["minutes_per_review"] / 60 * a["analyst_hourly_rate"]
    delay = false_alarms * a["false_positive_delay_minutes"] / 60 * a["clinical_hourly_cost"]
    total = F.lit(api + review) + delay
    mitigated = detected * a["breach_share"] * a["breach_cost_per_incident"]
    return {
        "attacks_detected": detected, "breaches_prevented": detected * a["breach_share"], "false_positives": false_alarms, "total_cost_daily": total,
        "risk_mitigated": mitigated, "net_benefit": mitigated - total, "roi": F.when(total > 0, (mitigated - total) / total).otherwise(0.0),
    }


def with_costs(modes: DataFrame, **assumptions: float) -> DataFrame:
    """modes (recall, fpr, ...) with their costs."""
    return modes.withColumns(cost_columns(F.col("recall"), F.col("fpr"), **assumptions))


def scenarios(recall: Column, fpr: Column, df: DataFrame, **assumptions: float) -> DataFrame:
    """What the risk is without and with the system."""
    a = DEFAULTS | assumptions
    risk = a["daily_emails"] * a["phishing_rate"] * a["breach_share"] * a["breach_cost_per_incident"]
    c = cost_columns(recall, fpr, **assumptions)
    without = df.select(F.lit("no_system").alias("scenario"), F.lit(0.0).alias("cost"), F.lit(risk).alias("residual_risk"))
    return without.unionByName(df.select(F.lit("deployed").alias("scenario"), c["total_cost_daily"].alias("cost"), (F.lit(risk) - c["risk_mitigated"]).alias("residual_risk")))
