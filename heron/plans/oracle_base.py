"""Shared pieces of the DuckDB counterparts: common table expressions that mirror the canonical views."""

from __future__ import annotations

from heron.functions import pii
from heron.functions.text import REASON_TAGS
from heron.operators import ontology, rules

ROUND = 6


def quoted(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


MESSAGES = """
m AS (
  SELECT d.doc_id AS id,
    'user' || (d.doc_id % 37) || '@' || CASE d.doc_id % 9 WHEN 0 THEN 'gmail.com' WHEN 1 THEN 'yahoo.com' WHEN 2 THEN 'acme.com'
      WHEN 3 THEN 'acm3.com' ELSE 'corp' || (d.doc_id % 5) || '.example.com' END AS sender_email,
    left(split_part(d.text, chr(10), 1), 120) AS subject,
    d.text || CASE d.doc_id % 10 WHEN 0 THEN ' This is urgent.' WHEN 1 THEN ' Please verify your account.' WHEN 2 THEN ' Enter your password to continue.'
      WHEN 3 THEN ' Call 555-010-1234 today.' WHEN 4 THEN ' SSN 123-45-6789 on file.' WHEN 5 THEN ' DOB 01/02/1980.' WHEN 6 THEN ' Card 4111 1111 1111 1111.' ELSE '' END
      || CASE d.doc_id % 7 WHEN 0 THEN ' http://192.0.2.7/login' WHEN 1 THEN ' https://bit.ly/abc' WHEN 2 THEN ' ' || p.url
      WHEN 3 THEN ' https://www.corp1.example.com/x' WHEN 4 THEN ' http://microsoft.co/x' ELSE '' END AS body,
    CAST(d.doc_id % 7 < 5 AS INTEGER) AS urls,
    CAST(CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.quality = 0 OR l.toxic = 1 THEN 1 ELSE 0 END AS INTEGER) AS label,
    CASE WHEN d.doc_id % 11 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(d.doc_id AS INTEGER)) END AS msg_date,
    TIMESTAMP '2024-03-01 00:00:00' AS created_at, d.doc_id % 4 AS urgency_hits, d.doc_id % 3 AS link_count,
    d.source AS created_by, d.lang, d.n_chars,
    CASE d.doc_id % 10 WHEN 0 THEN 'urgency' WHEN 1 THEN 'verify' WHEN 2 THEN 'password' WHEN 3 THEN 'phone' WHEN 4 THEN 'ssn' WHEN 5 THEN 'dob' WHEN 6 THEN 'card' ELSE 'none' END AS cue
  FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id % 50 LEFT JOIN labels l ON l.doc_id = d.doc_id
)"""

_MASK = {
    "email": "CASE WHEN length(split_part(x, '@', 1)) <= 2 THEN repeat('*', length(split_part(x, '@', 1))) ELSE left(x, 1) || repeat('*', length(split_part(x, '@', 1)) - 2) || right(split_part(x, '@', 1), 1) END || '@' || split_part(x, '@', 2)",
    "phone": "regexp_replace(regexp_extract(x, '(?s)^(.*?)((?:\\d\\D*){4})$', 1), '\\d', '*', 'g') || regexp_extract(x, '(?s)^(.*?)((?:\\d\\D*){4})$', 2)",
    "ssn": "'***-**-' || right(x, 4)",
    "dob": "'**/**/****'",
}
_MASK["cc"] = _MASK["phone"]


def reason_tag(column: str = "reason") -> str:
    """The tag of a reason, the first that one of its phrases names."""
    cases = " ".join("WHEN " + " OR ".join(f"contains(lower({column}), '{p}')" for p in phrases) + f" THEN '{tag}'" for tag, phrases in REASON_TAGS)
    return f"CASE {cases} ELSE 'other' END"


def redact_step(kind: str, source: str, name: str, column: str = "t") -> str:
    p = pii.PATTERNS[kind]
    return f"""
{name}_a AS (SELECT *, regexp_split_to_array({column}, '{p}') AS g, [{_MASK[kind]} for x in regexp_extract_all({column}, '{p}')] AS k FROM {source}),
{name} AS (SELECT * EXCLUDE ({column}, g, k), array_to_string([g[i] || coalesce(k[i], '') for i in range(1, len(g) + 1)], '') AS {column}, len(k) AS n_{kind} FROM {name}_a)"""


def redaction(source: str = "m", column: str = "body") -> str:
    steps, at = [f"r0 AS (SELECT *, coalesce({column}, '') AS t FROM {source})"], "r0"
    for i, kind in enumerate(pii.PATTERNS):
        steps.append(redact_step(kind, at, f"r{i + 1}"))
        at = f"r{i + 1}"
    steps.append("red AS (SELECT * EXCLUDE (t), t AS redacted_body, n_email + n_phone + n_ssn + n_cc + n_dob AS n_pii FROM r5)")
    return ",\n".join(steps)


DNS = """
dns AS (
  SELECT * FROM (VALUES ('gmail.com', true, true, true, 'none'), ('yahoo.com', true, true, true, 'reject'), ('acme.com', true, true, false, NULL),
    ('corp0.example.com', false, true, false, NULL), ('corp1.example.com', true, false, false, NULL), ('corp2.example.com', true, true, false, NULL),
    ('corp3.example.com', true, false, true, 'quarantine'), ('corp4.example.com', true, true, true, 'quarantine')) AS v(domain, has_mx, spf_present, dmarc_present, dmarc_policy)
)"""


def any_of(text: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in phrases) + ")"


_HOST = r"(?:https?://|www\.)([^/\s]+)"
_IP = r"^\d{1,3}(?:\.\d{1,3}){3}$"
_SHORT = "len([s for s in " + quoted(rules.SHORTENERS) + " if ends_with(h, s)]) > 0"


def hits(dns: bool, brands=("acme.com",)) -> str:
    look = " OR ".join(f"(translate(sender_domain, '01357', 'olest') = translate('{b}', '01357', 'olest') AND sender_domain <> '{b}')" for b in brands) or "false"
    claim = f"({any_of('lower(subject)', brands)} OR {any_of('lower(redacted_body)', brands)})" if brands else "false"
    free = "sender_domain IN (" + ", ".join(f"'{d}'" for d in rules.FREEMAIL) + ")"
    look_ups = (
        "CAST(NOT coalesce(dns.has_mx, false) AS INT) AS missing_mx, CAST(NOT coalesce(dns.spf_present, false) AS INT) AS no_spf, CAST(NOT coalesce(dns.dmarc_present, false) AS INT) AS no_dmarc, coalesce(dns.dmarc_policy, 'none') AS dmarc_policy"
        if dns else "0 AS missing_mx, 0 AS no_spf, 0 AS no_dmarc, NULL AS dmarc_policy"
    )
    host_match = "(regexp_replace(h, '^www\\.', '') = regexp_replace(sender_domain, '^www\\.', '') OR ends_with(regexp_replace(h, '^www\\.', ''), '.' || regexp_replace(sender_domain, '^www\\.', '')))"
    return f"""
h0 AS (
  SELECT *, CASE WHEN contains(sender_email, '@') THEN trim(lower(string_split(sender_email, '@')[-1])) ELSE '' END AS sender_domain,
    CASE WHEN urls = 1 THEN [trim(split_part(lower(x), ':', 1), '[]') for x in regexp_extract_all(redacted_body, '{_HOST}', 1)] END AS link_hosts FROM red
),
hits AS (
  SELECT h0.*, {look_ups}, {free} AS freemail_sender, CAST({free} AND {claim} AS INT) AS freemail_brand_claim, CAST({look} AS INT) AS lookalike_domain,
    CAST(len([h for h in coalesce(link_hosts, []) if regexp_matches(h, '{_IP}')]) AS INT) AS ip_literal_link,
    CAST(len([h for h in coalesce(link_hosts, []) if {_SHORT}]) AS INT) AS shortened_url,
    sender_domain <> '' AND len([h for h in coalesce(link_hosts, []) if NOT regexp_matches(h, '{_IP}') AND NOT {host_match}]) > 0 AS domain_mismatch,
    CAST({any_of("lower(redacted_body)", rules.URGENCY)} AS INT) AS urgency,
    CAST(regexp_matches(redacted_body, '{rules.CREDENTIALS}') AND regexp_matches(redacted_body, '{rules.REQUEST_VERBS}') AS INT) AS creds_request
  FROM h0 {"LEFT JOIN dns ON dns.domain = h0.sender_domain" if dns else ""}
)"""


def score(weights=None) -> str:
    weights = rules.WEIGHTS if weights is None else weights
    total = " + ".join(f"{r} * {weights.get(r, 0)}" for r in rules.RULES)
    if "url_present" in weights:
        total += f" + CASE WHEN urls = 1 THEN {weights['url_present']} ELSE 0 END"
    return f"CAST({total} AS INT)"


VERDICT = "CASE WHEN score < 2 THEN 'benign' WHEN score < 5 THEN 'needs_review' ELSE 'phishing' END"


def reasons() -> str:
    def one(r, on):
        return f"CASE WHEN {on} THEN ['{rules.REASONS[r]}'] ELSE [] END"

    head = [one(r, f"{r} > 0") for r in ("missing_mx", "no_spf", "no_dmarc", "freemail_brand_claim", "lookalike_domain")]
    link = f"flatten([list_concat({one('ip_literal_link', f'regexp_matches(h, {chr(39)}{_IP}{chr(39)})')}, {one('shortened_url', _SHORT)}) for h in coalesce(link_hosts, [])])"
    tail = [one("urgency", "urgency > 0"), one("creds_request", "creds_request > 0")]
    out = f"coalesce({link}, [])"
    for x in reversed(head):
        out = f"list_concat({x}, {out})"
    for x in tail:
        out = f"list_concat({out}, {x})"
    return out


def phase1(dns: bool = False, weights=None) -> str:
    """WITH-less list of expressions down to p1: hits, score, verdict and reasons of every message."""
    parts = [MESSAGES, redaction(), hits(dns), f"p0 AS (SELECT *, {score(weights)} AS score FROM hits)", f"p1 AS (SELECT *, {VERDICT} AS verdict, {reasons()} AS reasons FROM p0)"]
    if dns:
        parts.insert(0, DNS)
    return ",\n".join(parts)


def ontology_ctes() -> str:
    """props and attacks (as list of structs ordered by confidence, name) of p1."""
    props = "list_filter([CASE WHEN urgency > 0 THEN 'hasUrgencyLanguage' END, CASE WHEN creds_request > 0 THEN 'hasCredentialRequest' END, CASE WHEN freemail_sender OR freemail_brand_claim > 0 THEN 'hasFreemailSender' END, CASE WHEN missing_mx > 0 THEN 'hasMissingMX' END, CASE WHEN no_spf > 0 THEN 'hasMissingSPF' END, CASE WHEN no_dmarc > 0 THEN 'hasMissingDMARC' END, CASE WHEN ip_literal_link > 0 THEN 'hasIPLiteralURL' END, CASE WHEN shortened_url > 0 THEN 'hasShortenedURL' END, CASE WHEN domain_mismatch OR lookalike_domain > 0 THEN 'hasDomainMismatch' END], lambda x: x IS NOT NULL)"
    rows = ", ".join(f"('{a}', {quoted(x)}, {quoted(y) if y else 'CAST([] AS VARCHAR[])'})" for a, (x, y) in ontology.ATTACKS.items())
    return f"""
o0 AS (SELECT *, {props} AS properties FROM p1),
rules AS (SELECT * FROM (VALUES {rows}) AS v(attack_type, all_of, alts)),
o1 AS (
  SELECT o0.id, attack_type, len(list_intersect(all_of, properties)) AS n, CAST(len(alts) > 0 AND list_has_any(alts, properties) AS INT) AS met, len(all_of) + CAST(len(alts) > 0 AS INT) AS total, len(alts) AS alt
  FROM o0 CROSS JOIN rules
),
attacks AS (SELECT id, attack_type, CAST(n + met AS DOUBLE) / total AS confidence FROM o1 WHERE n + met > 0 AND CAST(n + met AS DOUBLE) / total >= 0.3 AND (alt = 0 OR met > 0))"""
