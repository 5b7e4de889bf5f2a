"""Cleaning of raw mail columns, quality rejection reasons and small row-wise fixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heron.functions.text import strip

CLEAN_COLUMNS = ["sender", "receiver", "msg_date", "subject", "body", "urls", "label", "sender_email", "url_extracted"]
#: Date forms that are tried in turn.
FORMATS = ["d MMM yyyy HH:mm:ss XXX", "d MMM yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def sender_email(sender: Column, given: Column) -> Column:
    """The given address, or what stands in <> in the sender, or the sender itself."""
    inner = F.trim(F.regexp_extract(sender, "<([^>]+)>", 1))
    return F.when(~blank(given), given).when(blank(sender), sender).when(sender.rlike("<[^>]+>"), inner).otherwise(F.trim(sender))


def timestamp_text(value: Column) -> Column:
    """An ISO timestamp in UTC, or empty: without a trailing zone name and a leading weekday, +hhmm as +hh:mm."""
    c = F.trim(value)
    c = F.regexp_replace(c, r"\s*\([^)]*\)\s*$", "")
    c = F.regexp_replace(c, r"^[A-Za-z]{3,9},\s+", "")
    c = F.regexp_replace(c, r"([+-])(\d{2})(\d{2})$", "$1$2:$3")
    parsed = F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in FORMATS))
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))


def binary_flag(value: Column) -> Column:
    """1 for numbers of one or more, else 0; no number counts as 0."""
    x = value.cast("string").try_cast("double")
    return F.when(~F.isnan(x) & (x >= 1), 1).otherwise(0)


def binary_label(value: Column) -> Column:
    """0 or 1 after cutting the fraction off, else null."""
    x = value.cast("string").try_cast("double")
    cut = F.when(~F.isnan(x) & (F.abs(x) < 1e9), F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)))
    return F.when(cut.isin(0, 1), cut.cast("int"))


def integer(value: Column, default: int = 0) -> Column:
    return F.coalesce(F.trim(value.cast("string")).try_cast("int"), F.lit(default))


def clean(df: DataFrame) -> DataFrame:
    """The nine columns of a cleaned corpus, missing ones as null."""
    for c in CLEAN_COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df.withColumns({
        "sender_email": sender_email(F.col("sender"), F.col("sender_email")), "msg_date": timestamp_text(F.col("msg_date")),
        "urls": binary_flag(F.col("urls")), "label": binary_label(F.col("label")),
    }).select(*CLEAN_COLUMNS)


def truncated(value: Column, default: int = 0) -> Column:
    """A number's whole part; blanks and what is no finite number give the default."""
    x = F.trim(value.cast("string")).try_cast("double")
    whole = F.when(~F.isnan(x) & (F.abs(x) < 2**53), F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)))
    return F.coalesce(whole, F.lit(default).cast("long"))


#: The address pattern of the fallback, and what stands for no address.
FALLBACK_ADDRESS = r"[\w\.-]+@[\w\.-]+\.[a-zA-Z]{2,}"
UNKNOWN = "unknown@example.com"


def sender_fallback(sender: Column, search: bool = True) -> Column:
    """An address wherever one can be found in a sender, else a fixed one: in <>, then by search (if wanted), then the sender itself if it holds an @."""
    s = strip(F.coalesce(sender, F.lit("")))

    def close(c: Column) -> Column:
        return F.translate(c, " ", "")

    # The variant that does not search takes what follows the first <, the other one the first <> that holds something.
    inner = F.regexp_extract(s, "<([^>]+)>", 1) if search else F.when(F.contains(s, F.lit(">")), F.regexp_extract(s, "^[^<]*<([^>]*)", 1))
    inner = strip(inner)
    out = F.when(F.contains(inner, F.lit("@")), close(inner))
    if search:
        found = F.regexp_extract(s, "(?U)" + FALLBACK_ADDRESS, 0)
        out = out.when(found != "", found)
    return out.when(F.contains(s, F.lit("@")), close(s)).otherwise(F.lit(UNKNOWN))


def combine(subject: Column, body: Column, joiner: str = "\n\n", limit: int | None = 8000) -> Column:
    """Subject and body as one text, stripped and, as the embedding service asks, no longer than limit."""
    both = strip(F.concat(F.coalesce(subject, F.lit("")), F.lit(joiner), F.coalesce(body, F.lit(""))))
    return both if limit is None else F.left(both, F.lit(limit))


def embedding_inputs(df: DataFrame, target: str) -> DataFrame:
    """(id, target, input) for the rows that have text for the target: doc, subject, body or url."""
    text = {"doc": combine(F.col("subject"), F.col("body")), "subject": F.left(strip(F.col("subject")), F.lit(8000)), "body": F.left(strip(F.col("body")), F.lit(8000)), "url": F.left(strip(F.col("url_extracted")), F.lit(8000))}[target]
    return df.select("id", F.lit(target).alias("target"), text.alias("input")).filter(F.col("input") != "")


def rejection_reasons(subject: Column, body: Column, min_body=0, max_body=10000, min_subject=0, max_subject=1000, url_required=True, keywords: list[str] | None = None) -> Column:
    """Why a sample is rejected; an empty array accepts it."""
    def too(n, what):
        return F.concat(F.lit(what), n.cast("string"))

    nb, ns = F.length(body), F.length(subject)
    checks = [F.when(~body.rlike(r"(?i)https?://"), "missing_url")] if url_required else []
    checks += [F.when(nb < min_body, too(nb, "body_too_short_")), F.when(nb > max_body, too(nb, "body_too_long_")), F.when(ns < min_subject, too(ns, "subject_too_short_")), F.when(ns > max_subject, too(ns, "subject_too_long_"))]
    if keywords:
        hit = F.lit(False)
        for k in keywords:
            hit = hit | F.contains(F.lower(body), F.lit(k))
        checks.append(F.when(~hit, "missing_category_keywords"))
    return F.array_compact(F.array(*checks))


def ensure_url(body: Column, url: str) -> Column:
    return F.when(body.rlike(r"(?i)https?://"), body).otherwise(F.concat(body, F.lit("\n\n" + url)))


def round_robin(index: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))
