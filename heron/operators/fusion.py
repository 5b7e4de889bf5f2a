"""Rules and retrieval joined into final verdicts."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Thresholds:
    """Similarity thresholds; fixed default values."""

    phish_top: float = 0.40
    phish_avg: float = 0.35
    review_top: float = 0.25
    review_avg: float = 0.17

    @classmethod
    def of(cls, phish_top: float, phish_avg: float) -> Thresholds:
        """Review thresholds derived from the phishing ones, not below zero."""
        return cls(phish_top, phish_avg, max(0.0, phish_top - 0.15), max(0.0, phish_avg - 0.18))

    @classmethod
    def read(cls, text: str | None) -> Thresholds:
        """From a JSON report; the defaults where there is none."""
        return cls.of_report(json.loads(text) if text else {})

    @classmethod
    def of_report(cls, found: dict) -> Thresholds:
        if "top_similarity_threshold" not in found:
            return cls()
        return cls.of(found["top_similarity_threshold"], found.get("avg_top3_threshold", cls.phish_avg))


def ai_verdict(verdict: Column, top: Column, avg3: Column, t: Thresholds = Thresholds()) -> Column:
    phish = (verdict == "phishing") | (top >= t.phish_top) | ((verdict == "needs_review") & (avg3 >= t.phish_avg))
    return F.when(phish, "phishing").when((top >= t.review_top) | (avg3 >= t.review_avg), "needs_review").otherwise(verdict)


def ai_score(verdict: Column, top_phish: Column, avg3_phish: Column, top_all: Column, has_phish: Column) -> Column:
    """0 to 10; halves round to even."""
    s = F.when(has_phish, 0.65 * top_phish + 0.35 * avg3_phish).otherwise(0.5 * top_all)
    p = F.when(verdict == "phishing", 1.0).when(verdict == "needs_review", 0.6).otherwise(0.0)
    both = F.least(F.lit(1.0), F.greatest(F.lit(0.0), s, 0.7 * s + 0.3 * p))
    return F.bround(F.round(both * 10, 9)).cast("int")


def conclusion(label: Column, dmarc: Column) -> Column:
    policy = F.coalesce(dmarc, F.lit("none"))
    return F.when(
        label == 1, F.concat(F.lit("Conclusion: **PHISH** — matches known phish and weak auth (DMARC: "), policy, F.lit(")"))
    ).otherwise(F.concat(F.lit("Conclusion: **LEGIT** — no strong phish match and auth not clearly risky (DMARC: "), policy, F.lit(")")))


def with_conclusion(reasons: Column, line: Column) -> Column:
    return F.when(F.array_contains(reasons, line), reasons).otherwise(F.array_append(reasons, line))
