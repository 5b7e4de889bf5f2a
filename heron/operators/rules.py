"""Weighted mail rules: hit counts once per message, then any weighting is a dot product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heron.functions import text as X

#: Fixed values of the rules.
FREEMAIL = ["gmail.com", "yahoo.com", "outlook.com", "hotmail.com", "aol.com", "proton.me"]
SHORTENERS = ["bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly", "buff.ly"]
URGENCY = ["urgent", "immediate action", "verify your account", "password expires", "suspend", "pay now", "update your information"]
CREDENTIALS = r"(?i)\bpasswords?\b|\blog\s*in\b|\blogin\b|\bssn\b|\bsocial\s+security\b|\bcredit\s+cards?\b|\bbank\s+accounts?\b"
#: What a text must hold, lower-cased, for CREDENTIALS to match; most texts are only searched for that.
CREDENTIAL_PARTS = ["password", "log", "ssn", "social", "credit", "bank"]
REQUEST_VERBS = r"(?i)\b(enter|provide|send|share|confirm|verify|update|reset|submit)\b"
#: The default weights, the tuned ones, and below them the reasons.
WEIGHTS = {
    "missing_mx": 2, "no_spf": 2, "no_dmarc": 1, "freemail_brand_claim": 2, "lookalike_domain": 2,
    "ip_literal_link": 2, "shortened_url": 2, "urgency": 2, "creds_request": 2, "strict_dmarc_missing_align": 3,
}
TUNED = {
    "missing_mx": 3, "no_spf": 3, "no_dmarc": 3, "url_present": 1, "freemail_brand_claim": 2, "lookalike_domain": 2,
    "ip_literal_link": 3, "shortened_url": 2, "urgency": 2, "creds_request": 1, "strict_dmarc_missing_align": 3,
}
#: Rule -> the reason it gives, in the order of reasons; links come host by host.
REASONS = {
    "missing_mx": "Sender domain missing MX record", "no_spf": "SPF not present for sender domain", "no_dmarc": "DMARC not present for sender domain",
    "freemail_brand_claim": "Freemail sender claims corporate brand", "lookalike_domain": "Sender domain looks like brand domain (confusable)",
    "url_present": "URL present in email", "ip_literal_link": "Link points to IP literal host", "shortened_url": "Shortened URL detected",
    "urgency": "Urgency language detected", "creds_request": "Credentials/PII request language detected",
}
RULES = [r for r in REASONS if r != "url_present"]
VERDICTS = ["benign", "needs_review", "phishing"]


def any_of(text: Column, phrases: list[str]) -> Column:
    hit = F.lit(False)
    for p in phrases:
        hit = hit | F.contains(text, F.lit(p))
    return hit


def rule_hits(df: DataFrame, brands: list[str] = (), dns: DataFrame | None = None, body: str = "redacted_body") -> DataFrame:
    """df with sender_domain, link_hosts, one hit count for each rule, and the indicators that carry no weight.

    df needs sender_email, subject, urls and the body column. dns (domain, has_mx, spf_present,
    dmarc_present, dmarc_policy) turns on the lookups; a domain that it lacks has nothing. Nulls of
    text count as empty.
    """
    out = df.withColumns({
        "sender_domain": X.domain_last(F.coalesce("sender_email", F.lit(""))),
        "link_hosts": F.when(F.col("urls") == 1, X.hosts(F.coalesce(F.col(body), F.lit("")))),
    })
    if dns is not None:
        facts = dns.select(F.col("domain").alias("_domain"), "has_mx", "spf_present", "dmarc_present", "dmarc_policy")
        out = out.join(facts, F.col("sender_domain") == F.col("_domain"), "left").drop("_domain")
        known = F.col("sender_domain") != ""
        for c in ("has_mx", "spf_present", "dmarc_present"):
            out = out.withColumn(c, F.when(known, F.coalesce(F.col(c), F.lit(False))))
        out = out.withColumn("dmarc_policy", F.when(known, F.coalesce("dmarc_policy", F.lit("none"))))
        lookups = {r: F.when(~F.col(c), 1).otherwise(0) for r, c in (("missing_mx", "has_mx"), ("no_spf", "spf_present"), ("no_dmarc", "dmarc_present"))}
        lookups = {r: F.coalesce(c, F.lit(0)) for r, c in lookups.items()}
    else:
        lookups = {r: F.lit(0) for r in ("missing_mx", "no_spf", "no_dmarc")}
    domain, hosts = F.col("sender_domain"), F.coalesce("link_hosts", F.array().cast("array<string>"))
    # A column of its own, so that it is worked out once.
    out = out.withColumn("_low_body", F.lower(F.coalesce(F.col(body), F.lit(""))))
    low_body, low_subject = F.col("_low_body"), F.lower(F.coalesce("subject", F.lit("")))
    lookalike = F.lit(False)
    for b in brands:
        lookalike = lookalike | X.confusable(domain, F.lit(b))
    claim = any_of(low_subject, list(brands)) | any_of(low_body, list(brands))
    freemail = domain.isin(*FREEMAIL)
    text = F.coalesce(F.col(body), F.lit(""))
    return out.withColumns(lookups | {
        "freemail_sender": freemail,
        "freemail_brand_claim": (freemail & claim).cast("int"),
        "lookalike_domain": lookalike.cast("int"),
        "ip_literal_link": F.size(F.filter(hosts, lambda h: h.rlike(X.IP_LITERAL))),
        "shortened_url": F.size(F.filter(hosts, lambda h: F.exists(F.array(*map(F.lit, SHORTENERS)), lambda s: F.endswith(h, s)))),
        "domain_mismatch": (domain != "") & F.exists(hosts, lambda h: ~h.rlike(X.IP_LITERAL) & ~X.host_of_sender(h, domain)),
        "urgency": any_of(low_body, URGENCY).cast("int"),
        "creds_request": (any_of(low_body, CREDENTIAL_PARTS) & text.rlike(CREDENTIALS) & text.rlike(REQUEST_VERBS)).cast("int"),
    }).drop("_low_body")


def score_of(weights: dict[str, int] | None = None) -> Column:
    """The weighted sum of the hits. None means the default weights; an empty map weighs nothing."""
    weights = WEIGHTS if weights is None else weights
    total = sum((F.col(r) * F.lit(weights.get(r, 0)) for r in RULES), F.lit(0))
    if "url_present" in weights:
        total = total + F.when(F.col("urls") == 1, weights["url_present"]).otherwise(0)
    return total.cast("int")


def verdict_of(score: Column, low: float = 2, high: float = 5) -> Column:
    return F.when(score < low, "benign").when(score < high, "needs_review").otherwise("phishing")


def reasons_of(weights: dict[str, int] | None = None) -> Column:
    """The reasons in order; the two link rules speak once for each host that they hit."""
    weights = WEIGHTS if weights is None else weights

    def one(rule: str, on: Column) -> Column:
        return F.when(on, F.array(F.lit(REASONS[rule]))).otherwise(F.array().cast("array<string>"))

    def of_host(h: Column) -> Column:
        short = F.exists(F.array(*map(F.lit, SHORTENERS)), lambda s: F.endswith(h, s))
        return F.concat(one("ip_literal_link", h.rlike(X.IP_LITERAL)), one("shortened_url", short))

    before = [one(r, F.col(r) > 0) for r in ("missing_mx", "no_spf", "no_dmarc", "freemail_brand_claim", "lookalike_domain")]
    if "url_present" in weights:
        before.append(one("url_present", F.col("urls") == 1))
    links = F.flatten(F.transform(F.coalesce("link_hosts", F.array().cast("array<string>")), of_host))
    return F.concat(*before, links, one("urgency", F.col("urgency") > 0), one("creds_request", F.col("creds_request") > 0))


def phase1(df: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """rule_hits() with score, verdict and reasons."""
    scored = df.withColumn("score", score_of(weights))
    return scored.withColumns({"verdict": verdict_of(F.col("score")), "reasons": reasons_of(weights)})


def indicators() -> Column:
    """The indicators as one struct; a null field is an absent key."""
    def on(c):
        return F.when(c, F.lit(True))

    return F.struct(
        F.col("sender_domain"), on(F.col("freemail_sender")).alias("freemail_sender"), on(F.col("freemail_brand_claim") > 0).alias("freemail_brand_claim"),
        on(F.col("lookalike_domain") > 0).alias("lookalike"), F.col("link_hosts"), on(F.col("ip_literal_link") > 0).alias("ip_literal_link"),
        on(F.col("shortened_url") > 0).alias("shortened_url"), on(F.col("domain_mismatch")).alias("domain_mismatch"),
        on(F.col("urgency") > 0).alias("urgency"), on(F.col("creds_request") > 0).alias("creds_request"),
    )
