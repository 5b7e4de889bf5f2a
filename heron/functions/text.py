"""String, URL and address scalars as native column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns whose results must agree with the mail formats they read.
HOST = r"(?:https?://|www\.)([^/\s]+)"
IP_LITERAL = r"^\d{1,3}(?:\.\d{1,3}){3}$"
URL_TEXT = r"(?i)(https?://|www\.)\S+"
URL_UI = r"(?i)https?://|www\."
ADDRESS = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
URL = r"(?i)\b(?:https?://|www\.)?(?:(?:[a-zA-Z0-9\-]+\.)+[a-zA-Z0-9\-]+|(?:\d{1,3}\.){3}\d{1,3}|localhost)(?::\d+)?(?:/[^\s]*)?(?=\b|[^a-zA-Z0-9/@\-.])"
SENTENCE = r"[^.!?\n]+[.!?\n]?"
TOKEN = r"[A-Za-z0-9]+(?:'[A-Za-z0-9]+)?"


def strip(c: Column) -> Column:
    """Without white space at both ends, line breaks included."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def domain_first(email: Column) -> Column:
    """What follows the first @, lower-cased; as the store's generated column."""
    return F.lower(F.split_part(email, F.lit("@"), F.lit(2)))


def domain_last(address: Column) -> Column:
    """What follows the last @, lower-cased and trimmed; empty if there is none."""
    return F.when(F.contains(address, F.lit("@")), F.trim(F.lower(F.substring_index(address, "@", -1)))).otherwise(F.lit(""))


def hosts(text: Column) -> Column:
    """Hosts after http(s):// or www., lower-cased, cut at a port, without brackets; in order, repeats kept."""
    found = F.regexp_extract_all(text, F.lit(HOST), F.lit(1))
    return F.transform(found, lambda h: F.btrim(F.split_part(F.lower(h), F.lit(":"), F.lit(1)), F.lit("[]")))


def without_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def host_of_sender(host: Column, domain: Column) -> Column:
    """The host is the sender's domain or lies under it."""
    h, d = without_www(host), without_www(domain)
    return (domain != "") & ((h == d) | F.endswith(h, F.concat(F.lit("."), d)))


def confusable(a: Column, b: Column) -> Column:
    """Unequal, but equal once digits that look like letters are read as those."""
    return (F.translate(a, "01357", "olest") == F.translate(b, "01357", "olest")) & (a != b)


def dmarc_policy(record: Column) -> Column:
    """The first p= directive of a DMARC record, or null."""
    parts = F.transform(F.split(record, ";"), lambda p: F.trim(p))
    first = F.filter(parts, lambda p: F.startswith(p, F.lit("p=")))
    return F.when(F.size(first) > 0, F.substring(F.element_at(first, 1), 3, 1_000_000))


def extract_urls(text: Column, require_netloc: bool = True) -> Column:
    """Distinct URLs in order, comma-joined; bare numbers are none. With require_netloc only those with a scheme stay."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(URL), F.lit(0))
    proper = F.filter(found, lambda u: u.rlike(r"^(?:https?://|www\.)") | (u.rlike(r"[a-zA-Z\-]") & (F.length(u) > 3) & F.contains(u, F.lit(".")) & ~F.endswith(u, F.lit("."))))
    distinct = F.array_distinct(proper)
    return F.array_join(F.filter(distinct, lambda u: u.rlike("(?i)^https?://")) if require_netloc else distinct, ",")


def hmac_sha256(key: str, message: Column) -> Column:
    """The keyed digest of a text as hex digits, by its definition over two digests."""
    data = key.encode()
    block = (data if len(data) <= 64 else hashlib.sha256(data).digest()).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in block).hex())) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def csv_fields(line: Column) -> Column:
    """The fields of a single CSV line: quotes switch between quoted and plain text wherever they stand, doubled ones inside are one."""
    parts = F.split(line, '"', -1)
    inside = "\u0001"

    def part(x: Column, i: Column) -> Column:
        between = (x == "") & (i > 0) & (i < F.size(parts) - 1)
        return F.when(i % 2 == 1, F.translate(x, ",", inside)).when(between, F.lit('"')).otherwise(x)

    return F.transform(F.split(F.array_join(F.transform(parts, part), ""), ",", -1), lambda f: F.translate(f, inside, ","))


def content_hash(subject: Column, body: Column) -> Column:
    return F.sha2(F.concat(subject, F.lit("||"), body), 256)


def bracket_tag(reason: Column) -> Column:
    """The tag in leading square brackets, or OTHER."""
    tag = F.regexp_extract(reason, r"^\[([A-Z]+)\]", 1)
    return F.when(tag != "", tag).otherwise(F.lit("OTHER"))


#: Tag -> phrases, in the order in which they are tried; fixed values.
REASON_TAGS = [
    ("missing_mx", ["missing mx"]), ("no_spf", ["spf not present", "no spf"]), ("no_dmarc", ["dmarc not present", "no dmarc"]),
    ("urgency", ["urgency"]), ("creds_request", ["credential", "pii request"]), ("ip_literal_link", ["ip literal"]), ("shortened_url", ["shortened url"]),
    ("freemail_brand_claim", ["freemail", "brand claim"]), ("lookalike_domain", ["lookalike"]),
]


def reason_tag(reason: Column) -> Column:
    low, out = F.lower(reason), None
    for tag, phrases in REASON_TAGS:
        hit = F.lit(False)
        for p in phrases:
            hit = hit | F.contains(low, F.lit(p))
        out = F.when(hit, F.lit(tag)) if out is None else out.when(hit, F.lit(tag))
    return out.otherwise(F.lit("other"))


def property_title(name: Column) -> Column:
    """hasMissingMX as "Missing M X": every capital is set off."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, "^has", ""), "([A-Z])", " $1"))


def sentences(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))
    return F.when(F.size(found) > 0, found).otherwise(F.array(text))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def offsets(text: Column, pattern: str) -> Column:
    """(start, end, text) of each match in order; places count code points from 0, and end is the place after the match."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("text")))
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")

    def step(s, p):
        start = s["at"] + p["gap"]
        end = start + F.length(p["text"])
        return F.struct(end.alias("at"), F.array_append(s["found"], F.struct(start.alias("start"), end.alias("end"), p["text"].alias("text"))).alias("found"))

    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda s: s["found"])


def sentence_offsets(text: Column) -> Column:
    """offsets() of the sentences; a text without any is one itself."""
    found = offsets(text, SENTENCE)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end"), text.alias("text"))))


def token_offsets(sentence: Column) -> Column:
    """offsets() of the lower-cased tokens of one of sentence_offsets(), in the whole text."""
    return F.transform(offsets(sentence["text"], TOKEN), lambda t: F.struct((t["start"] + sentence["start"]).alias("start"), (t["end"] + sentence["start"]).alias("end"), F.lower(t["text"]).alias("text")))


def code_units(text: Column) -> Column:
    """The 16-bit code units of the text, as browsers count them."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0))
    return F.transform(units, lambda u: F.conv(u, 16, 10).cast("long"))


#: 32-bit start values and multiplier of the short digest.
_START, _TIMES, _WORD = (0x811C9DC5, 0x9E3779B9), 0x01000193, 1 << 32


def short_digest(text: Column) -> Column:
    """Twelve hex digits of two 32-bit accumulators that are folded over the text's code units; not for secrets."""

    def rotated(x: Column, n: int) -> Column:
        return (x * (1 << n)) % _WORD + F.shiftright(x, 32 - n)

    def step(s, c):
        a, b = s["a"].bitwiseXOR(c), s["b"]
        return F.struct((a * _TIMES % _WORD).alias("a"), b.bitwiseXOR((c + b + b * 64 % _WORD + F.shiftright(b, 2)) % _WORD).alias("b"))

    def digits(s):
        x, y = s["a"].bitwiseXOR(rotated(s["b"], 13)), s["b"].bitwiseXOR(rotated(s["a"], 11))
        bytes_ = [x, F.shiftright(x, 8), F.shiftright(x, 16), y, F.shiftright(y, 8), F.shiftright(x.bitwiseXOR(y), 16)]
        return F.concat(*(F.lower(F.lpad(F.hex(b % 256), 2, "0")) for b in bytes_))

    return F.aggregate(code_units(text), F.struct(*(F.lit(v).cast("long").alias(n) for n, v in zip("ab", _START, strict=True))), step, digits)


def same_set(chosen: Column, right: Column) -> Column:
    """Whether two arrays hold the same values, in any order; a null array holds none."""
    a, b = (F.array_sort(F.array_distinct(F.coalesce(x, F.array().cast("array<string>")))) for x in (chosen, right))
    return a == b
