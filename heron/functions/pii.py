"""Order-dependent masking of personal data, as native column expressions.

Each masker works on the output of the one before it: a contiguous card number is taken by the phone
pattern first, and the later patterns see what it left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The five patterns, in the order in which they apply.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?|\d{3})[-.\s]?\d{3}[-.\s]?\d{4}",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "cc": r"\b(?:\d[ -]*?){13,19}\b",
    "dob": r"\b(?:\d{1,2}[/-]){2}\d{2,4}\b",
}


def mask_email(v: Column) -> Column:
    """The local part's inner letters become asterisks; all of them where there are at most two."""
    local, domain = F.split_part(v, F.lit("@"), F.lit(1)), F.substring_index(v, "@", -1)
    n = F.length(local)
    masked = F.when(n <= 2, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(local, F.lit(1)), F.repeat(F.lit("*"), n - 2), F.right(local, F.lit(1))))
    return F.concat(masked, F.lit("@"), domain)


def mask_digits(v: Column) -> Column:
    """All digits but the last four become asterisks; the other characters stay."""
    tail = r"(?s)^(.*?)((?:\d\D*){4})$"
    return F.concat(F.regexp_replace(F.regexp_extract(v, tail, 1), r"\d", "*"), F.regexp_extract(v, tail, 2))


MASKS: dict[str, Callable[[Column], Column]] = {
    "email": mask_email,
    "phone": mask_digits,
    "ssn": lambda v: F.concat(F.lit("***-**-"), F.right(v, F.lit(4))),
    "cc": mask_digits,
    "dob": lambda v: F.lit("**/**/****"),
}


#: What a text with a match must hold; most texts are only searched for that.
NEEDS = {"email": "@", "phone": "[0-9]{4}", "ssn": "-[0-9]{4}", "cc": "[0-9]", "dob": "[0-9][/-][0-9]"}


def masked(text: Column, found: Column, pattern: str, mask: Callable[[Column], Column]) -> Column:
    """The text with the found matches of the pattern replaced by their masks: the gaps and the masks, zipped together again."""
    gaps = F.split(text, pattern, -1)
    joined = F.array_join(F.zip_with(F.slice(gaps, 1, F.size(gaps) - 1), F.transform(found, mask), lambda g, m: F.concat(g, m)), "")
    return F.when(F.size(found) > 0, F.concat(joined, F.element_at(gaps, -1))).otherwise(text)


def redact_one(df: DataFrame, kind: str, column: str, into: str) -> DataFrame:
    """df with the column's matches of one kind masked, and their number in n_<kind>."""
    text, none = F.col(column), F.array().cast("array<string>")
    found = F.when(text.rlike(NEEDS[kind]), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))).when(text.isNotNull(), none)
    with_found = df.withColumn("_found", found)
    return with_found.withColumns({f"n_{kind}": F.size("_found"), into: masked(text, F.col("_found"), PATTERNS[kind], MASKS[kind])}).drop("_found")


def redact(df: DataFrame, column: str = "body", into: str = "redacted_body") -> DataFrame:
    """df with all five maskers applied in order, n_<kind> for each and their sum n_pii; a null text counts as empty."""
    out = df.withColumn(into, F.coalesce(F.col(column), F.lit("")))
    for kind in PATTERNS:
        out = redact_one(out, kind, into, into)
    return out.withColumn("n_pii", sum((F.col(f"n_{k}") for k in PATTERNS), F.lit(0)))


def redaction_map() -> Column:
    """The counts as a map, as the API returns them."""
    return F.create_map(*(x for k in PATTERNS for x in (F.lit(k), F.col(f"n_{k}"))))


#: Independent patterns of exposure, case-insensitive; fixed values.
EXPOSURE = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "cc": r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b",
    "dob": r"\b(0[1-9]|1[0-2])/(0[1-9]|[12]\d|3[01])/\d{4}\b",
}


def exposure_count(text: Column) -> Column:
    return sum((F.regexp_count(text, F.lit("(?i)" + p)) for p in EXPOSURE.values()), F.lit(0))
