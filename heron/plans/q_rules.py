"""Queries on redaction, rule scoring and ontology inference."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from heron.functions import pii
from heron.functions.pii import redact
from heron.operators import ontology, rules
from heron.operators.running import running_totals
from heron.plans import oracle_base as B
from heron.plans.book import query
from heron.plans.session import cut, shared_dir, table
from heron.plans.views import BRANDS, scored, unnest, with_attacks
from heron.sources import sinks
from heron.sources.messages import dns_answers, dns_facts, messages
from heron.sources.turtle import RDF, read_turtle, triples, write_turtle

P1, P1D = B.phase1(False), B.phase1(True)


def _one(kind):
    sql = f"WITH {B.MESSAGES}, r0 AS (SELECT id, body AS t FROM m), {B.redact_step(kind, 'r0', 'r1')} SELECT id, t AS redacted, CAST(n_{kind} AS INT) AS n FROM r1"

    @query(f"redact_{kind}", sql)
    def run(spark, sf_dir):
        out = pii.redact_one(messages(spark, sf_dir), kind, "body", "redacted")
        return out.select("id", "redacted", F.col(f"n_{kind}").alias("n"))

    return run


for _kind in pii.PATTERNS:
    _one(_kind)


@query("redact_all", f"WITH {B.MESSAGES}, {B.redaction()} SELECT id, redacted_body, CAST(n_email AS INT) AS n_email, CAST(n_phone AS INT) AS n_phone, CAST(n_ssn AS INT) AS n_ssn, CAST(n_cc AS INT) AS n_cc, CAST(n_dob AS INT) AS n_dob, CAST(n_pii AS INT) AS n_pii FROM red")
def redact_all(spark, sf_dir):
    return redact(messages(spark, sf_dir)).select("id", "redacted_body", *(f"n_{k}" for k in pii.PATTERNS), F.col("n_pii"))


@query("redact_neighbors", f"""WITH {B.MESSAGES}, {B.redaction()}, s AS (SELECT id, n_email, n_phone, n_ssn, n_cc, n_dob FROM red), m2 AS (SELECT id, subject AS body FROM m),
 {B.redaction("m2").replace("r0", "q0").replace("r1", "q1").replace("r2", "q2").replace("r3", "q3").replace("r4", "q4").replace("r5", "q5").replace("red AS", "qed AS")}
SELECT s.id, CAST(s.n_email + q.n_email AS INT) AS email, CAST(s.n_phone + q.n_phone AS INT) AS phone, CAST(s.n_ssn + q.n_ssn AS INT) AS ssn, CAST(s.n_cc + q.n_cc AS INT) AS cc, CAST(s.n_dob + q.n_dob AS INT) AS dob
FROM s JOIN qed q ON s.id = q.id""")
def redact_neighbors(spark, sf_dir):
    """Subject and body are redacted apart; the counts of both are merged by kind."""
    body = redact(messages(spark, sf_dir)).withColumn("b", pii.redaction_map())
    both = redact(body, "subject", "redacted_subject").withColumn("s", pii.redaction_map())
    merged = F.map_zip_with("b", "s", lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))
    return both.withColumn("m", merged).select("id", *(F.col("m")[k].alias(k) for k in pii.PATTERNS))


@query("phi_exposure", f"""WITH {B.MESSAGES}, t AS (SELECT id, subject || chr(10) || chr(10) || body AS t FROM m),
c AS (SELECT t, {" + ".join(f"len(regexp_extract_all(t, '(?i){p}'))" for p in pii.EXPOSURE.values())} AS n FROM t)
SELECT count(*) AS emails, CAST(sum(n) AS BIGINT) AS phi_patterns, CAST(sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) AS BIGINT) AS emails_with_phi,
 round(avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END), 6) AS exposure_rate, CAST(sum(length(t)) AS BIGINT) AS total_chars, round(avg(length(t)), 6) AS avg_chars,
 round(sum(length(t)) / 4.0 * 0.15 / 1000000, 6) AS input_cost, round(count(*) * 200 * 0.60 / 1000000, 6) AS output_cost FROM c""")
def phi_exposure(spark, sf_dir):
    text = F.concat("subject", F.lit("\n\n"), "body")
    rows = messages(spark, sf_dir).select(text.alias("t")).withColumn("n", pii.exposure_count(F.col("t")))
    return rows.agg(
        F.count("*").alias("emails"), F.sum("n").cast("long").alias("phi_patterns"), F.count_if(F.col("n") > 0).alias("emails_with_phi"),
        F.round(F.avg((F.col("n") > 0).cast("double")), 6).alias("exposure_rate"), F.sum(F.length("t")).cast("long").alias("total_chars"),
        F.round(F.avg(F.length("t")), 6).alias("avg_chars"), F.round(F.sum(F.length("t")) / 4.0 * 0.15 / 1000000, 6).alias("input_cost"),
        F.round(F.count("*") * 200 * 0.60 / 1000000, 6).alias("output_cost"),
    )


_TOTALS = [f"n_{k}" for k in pii.PATTERNS] + ["n_pii"]


@query("pii_running_window", f"WITH {B.MESSAGES}, {B.redaction()} SELECT id, {', '.join(f'CAST(sum({c}) OVER (PARTITION BY created_by ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS total_{c}' for c in _TOTALS)} FROM red")
def pii_running_window(spark, sf_dir):
    """The totals so far as a batch of rows is worked off, one batch for each creator."""
    # Written, as the sort by ranges reads its rows twice.
    rows = cut(redact(messages(spark, sf_dir)).select("id", "created_by", *_TOTALS), "redacted")
    return running_totals(rows, "created_by", "id", _TOTALS).select("id", *(f"total_{c}" for c in _TOTALS))


@query("pii_running_totals", f"WITH {B.MESSAGES}, {B.redaction()} SELECT created_by, CAST(sum(n_email) AS BIGINT) AS email, CAST(sum(n_phone) AS BIGINT) AS phone, CAST(sum(n_ssn) AS BIGINT) AS ssn, CAST(sum(n_cc) AS BIGINT) AS cc, CAST(sum(n_dob) AS BIGINT) AS dob FROM red GROUP BY created_by")
def pii_running_totals(spark, sf_dir):
    """Redaction totals of each batch of rows."""
    return redact(messages(spark, sf_dir)).groupBy("created_by").agg(*(F.sum(f"n_{k}").alias(k) for k in pii.PATTERNS))


_HIT_COLUMNS = [*rules.RULES]


@query("rule_hits", f"WITH {P1D} SELECT id, sender_domain, {', '.join(f'CAST({c} AS INT) AS {c}' for c in _HIT_COLUMNS)}, domain_mismatch, freemail_sender FROM p1")
def rule_hits(spark, sf_dir):
    return scored(spark, sf_dir, dns=True).select("id", "sender_domain", *_HIT_COLUMNS, "domain_mismatch", "freemail_sender")


@query("phase1_verdicts", f"WITH {P1} SELECT id, score, verdict, reasons FROM p1")
def phase1_verdicts(spark, sf_dir):
    return scored(spark, sf_dir).select("id", "score", "verdict", "reasons")


@query("phase1_verdicts_dns", f"WITH {P1D} SELECT id, score, verdict, reasons, dmarc_policy FROM p1")
def phase1_verdicts_dns(spark, sf_dir):
    return scored(spark, sf_dir, dns=True).select("id", "score", "verdict", "reasons", "dmarc_policy")


@query("verdict_distribution", f"WITH {P1} SELECT verdict, count(*) AS n, round(avg(score), 6) AS avg_score, CAST(sum(n_pii) AS BIGINT) AS redactions FROM p1 GROUP BY verdict")
def verdict_distribution(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("avg_score"), F.sum("n_pii").cast("long").alias("redactions"))


@query("score_histogram", f"WITH {P1D} SELECT score, count(*) AS n FROM p1 GROUP BY score")
def score_histogram(spark, sf_dir):
    return scored(spark, sf_dir, dns=True).groupBy("score").agg(F.count("*").alias("n")).orderBy("score")


@query("custom_verdict", f"WITH {P1D} SELECT verdict2 AS verdict, count(*) AS n FROM (SELECT CASE WHEN score < 1 THEN 'benign' WHEN score < 3.5 THEN 'needs_review' ELSE 'phishing' END AS verdict2 FROM p1) GROUP BY verdict2")
def custom_verdict(spark, sf_dir):
    return scored(spark, sf_dir, dns=True).select(rules.verdict_of(F.col("score"), 1, 3.5).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


_ONES = {r: 1 for r in rules.RULES}


@query("weight_variants", f"WITH {P1D} SELECT id, {B.score(rules.TUNED)} AS tuned_score, {B.score()} AS default_score, {B.score(_ONES)} AS unit_score FROM p1")
def weight_variants(spark, sf_dir):
    """One scan of the hits scores every weighting."""
    hits = rules.rule_hits(redact(messages(spark, sf_dir)), BRANDS, dns_facts(dns_answers(spark)))
    return hits.select("id", rules.score_of(rules.TUNED).alias("tuned_score"), rules.score_of().alias("default_score"), rules.score_of(_ONES).alias("unit_score"))


@query("reason_counts", f"WITH {P1D} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM p1) GROUP BY reason")
def reason_counts(spark, sf_dir):
    return unnest(scored(spark, sf_dir, dns=True), "reasons", "reason").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


@query("evidence_rows", f"WITH {P1D} SELECT id AS message_id, 'rule_hit' AS kind, reason AS ref_id, CAST(score AS DECIMAL(6,4)) AS score FROM (SELECT id, score, unnest(reasons) AS reason FROM p1)")
def evidence_rows(spark, sf_dir):
    """Child rows of the evidence table, one for each reason."""
    rows = unnest(scored(spark, sf_dir, dns=True), "reasons", "reason", "id", "score")
    return rows.select(F.col("id").alias("message_id"), F.lit("rule_hit").alias("kind"), F.col("reason").alias("ref_id"), F.col("score").cast("decimal(6,4)").alias("score"))


@query("pii_counts", f"WITH {B.MESSAGES}, {B.redaction()}, s AS (SELECT sum(n_email) AS email, sum(n_phone) AS phone, sum(n_ssn) AS ssn, sum(n_cc) AS cc, sum(n_dob) AS dob FROM red) SELECT kind, CAST(n AS BIGINT) AS n FROM (UNPIVOT s ON email, phone, ssn, cc, dob INTO NAME kind VALUE n)")
def pii_counts(spark, sf_dir):
    one = redact(messages(spark, sf_dir)).agg(*(F.sum(f"n_{k}").alias(k) for k in pii.PATTERNS))
    return one.unpivot([], list(pii.PATTERNS), "kind", "n").orderBy(F.desc("n"), "kind")


_TRIPLES = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in t[:3]) + ")" for t in triples(ontology.TEXT))
_GRAPH = f"""{P1D}, {B.ontology_ctes()}, seen AS (SELECT DISTINCT attack_type, created_by FROM attacks JOIN p1 USING (id) WHERE created_by IS NOT NULL),
t AS (SELECT * FROM (VALUES {_TRIPLES}) AS v(s, p, o) UNION SELECT '{ontology.NS}' || attack_type || '.' || created_by, '{RDF}type', '{ontology.OWL}Class' FROM seen
 UNION SELECT '{ontology.NS}' || attack_type || '.' || created_by, '{ontology.RDFS}subClassOf', '{ontology.NS}' || attack_type FROM seen),
c AS (SELECT s FROM t WHERE p = '{ontology.RDFS}subClassOf' AND o = '{ontology.ROOT}' UNION SELECT t.s FROM t JOIN c ON t.o = c.s WHERE p = '{ontology.RDFS}subClassOf')"""


def _graph(spark, sf_dir):
    """The triples of a written rule file: the package's rules, and a class for each pair of an attack type and a creator whose messages show it."""
    path = f"{shared_dir(spark)}/rules-{uuid.uuid4().hex}"
    seen = unnest(with_attacks(spark, sf_dir), "attacks", "a", "created_by").select("a.attack_type", F.col("created_by").alias("variant"))
    write_turtle(ontology.observed(seen), f"{path}/observed")
    spark.createDataFrame([(ontology.TEXT,)], "value string").coalesce(1).write.text(f"{path}/rules")
    return cut(read_turtle(spark, f"{path}/*"), "triples")


@query("attack_types_closure", f"WITH RECURSIVE {_GRAPH} SELECT split_part(s, '#', 2) AS attack_type FROM c")
def attack_types_closure(spark, sf_dir):
    return ontology.attack_types(_graph(spark, sf_dir))


@query("ontology_indicators", f"WITH {P1D}, {B.ontology_ctes()} SELECT id, properties FROM o0")
def ontology_indicators(spark, sf_dir):
    return scored(spark, sf_dir, dns=True).select("id", ontology.properties().alias("properties"))


@query("infer_attacks", f"WITH {P1D}, {B.ontology_ctes()} SELECT id, attack_type, round(confidence, 6) AS confidence FROM attacks")
def infer_attacks(spark, sf_dir):
    return unnest(with_attacks(spark, sf_dir), "attacks", "a", "id").select("id", "a.attack_type", F.round("a.confidence", 6).alias("confidence"))


_RULE_TEXT = "CASE b.attack_type " + " ".join(f"WHEN '{a}' THEN '{ontology._rule_text(x, y)}'" for a, (x, y) in ontology.ATTACKS.items()) + " END"


@query("explanation_chain", f"""WITH {P1D}, {B.ontology_ctes()}, best AS (SELECT id, attack_type, confidence FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY confidence DESC, attack_type) AS rn FROM attacks) WHERE rn = 1),
d AS (SELECT id, ['✓ Detected: ' || trim(regexp_replace(regexp_replace(p, '^has', ''), '([A-Z])', ' \\1', 'g')) for p in properties] AS lines FROM o0)
SELECT d.id, array_to_string(CASE WHEN b.id IS NULL THEN d.lines ELSE list_concat(d.lines, ['⚙ Rule: ' || b.attack_type || ' requires ' || {_RULE_TEXT},
 '✓ Conclusion: Classified as ' || b.attack_type || ' (confidence: ' || CAST(round_even(b.confidence * 100, 0) AS INT) || '%)']) END, chr(10)) AS explanation FROM d LEFT JOIN best b ON b.id = d.id""")
def explanation_chain(spark, sf_dir):
    return with_attacks(spark, sf_dir).select("id", F.array_join(ontology.explanation(F.col("properties"), F.col("attacks")), "\n").alias("explanation"))


@query("ontology_coverage", f"""WITH {P1D}, {B.ontology_ctes()}, n AS (SELECT id, count(*) AS k, sum(confidence) AS c FROM attacks GROUP BY id)
SELECT coalesce(CAST(label AS VARCHAR), 'none') AS label, count(*) AS emails, CAST(sum(CASE WHEN n.id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS covered,
 round(100.0 * sum(CASE WHEN n.id IS NOT NULL THEN 1 ELSE 0 END) / count(*), 6) AS pct, round(CAST(sum(k) AS DOUBLE) / sum(CASE WHEN n.id IS NOT NULL THEN 1 ELSE 0 END), 6) AS avg_attacks,
 round(sum(c) / sum(k), 6) AS avg_confidence FROM p1 LEFT JOIN n ON n.id = p1.id GROUP BY 1""")
def ontology_coverage(spark, sf_dir):
    k = F.size("attacks")
    total = F.aggregate("attacks", F.lit(0.0), lambda s, a: s + a["confidence"])
    rows = with_attacks(spark, sf_dir).select(F.coalesce(F.col("label").cast("string"), F.lit("none")).alias("label"), k.alias("k"), total.alias("c"))
    covered = F.count_if(F.col("k") > 0)
    return rows.groupBy("label").agg(
        F.count("*").alias("emails"), covered.alias("covered"), F.round(100.0 * covered / F.count("*"), 6).alias("pct"),
        F.round(F.try_divide(F.sum("k"), covered), 6).alias("avg_attacks"), F.round(F.try_divide(F.sum("c"), F.sum("k")), 6).alias("avg_confidence"),
    )


@query("ontology_type_counts", f"WITH {P1D}, {B.ontology_ctes()} SELECT attack_type, count(*) AS n, round(avg(confidence), 6) AS avg_confidence FROM attacks GROUP BY attack_type")
def ontology_type_counts(spark, sf_dir):
    return unnest(with_attacks(spark, sf_dir), "attacks", "a").groupBy("a.attack_type").agg(F.count("*").alias("n"), F.round(F.avg("a.confidence"), 6).alias("avg_confidence"))


@query("ontology_stats", f"""WITH RECURSIVE {_GRAPH} SELECT count(*) AS total_triples, (SELECT count(*) FROM c) AS attack_types,
 count(DISTINCT s) FILTER (p = '{RDF}type' AND o = '{ontology.OWL}Class') AS classes, count(DISTINCT s) FILTER (p = '{RDF}type' AND o = '{ontology.OWL}DatatypeProperty') AS properties FROM t""")
def ontology_stats(spark, sf_dir):
    return ontology.ontology_stats(_graph(spark, sf_dir))


#: The answers of one observed lookup for each document: which domain, which name and what came back are told by its id.
_LOOKUPS = {
    "domain": "'d' || (doc_id % 37) || '.example'",
    "type": "CASE WHEN doc_id % 4 = 0 THEN 'MX' ELSE 'TXT' END",
    "prefix": "CASE WHEN doc_id % 4 = 3 THEN '_dmarc.' ELSE '' END",
    "text": """CASE WHEN doc_id % 4 = 0 THEN 'mx.example' WHEN doc_id % 4 = 3 THEN CASE doc_id % 5 WHEN 0 THEN 'v=DMARC1; p=reject' WHEN 1 THEN ' v=DMARC1; p=none' WHEN 2 THEN 'V=dmarc1;sp=none; p=quarantine' WHEN 3 THEN 'v=DMARC1; rua=x' ELSE 'v=DMARC2; p=none' END
 ELSE CASE doc_id % 3 WHEN 0 THEN 'V=SPF1 -all' WHEN 1 THEN 'site=v=spf1' ELSE lang END END""",
    "error": "CASE WHEN doc_id % 7 < 3 THEN 'NXDOMAIN' END",
}


@query("dns_facts", f"""WITH a AS (SELECT doc_id AS n, {', '.join(f'{e} AS {c}' for c, e in _LOOKUPS.items())} FROM documents), k AS (SELECT *, error IS NULL AS ok, prefix = '' AS own FROM a)
SELECT domain, bool_or(ok AND own AND type = 'MX') AS has_mx, bool_or(ok AND own AND type = 'TXT' AND starts_with(lower(text), 'v=spf1')) AS spf_present, bool_or(ok AND NOT own AND starts_with(lower(text), 'v=dmarc1')) AS dmarc_present,
 coalesce(nullif(regexp_extract(arg_min(text, n) FILTER (ok AND NOT own AND starts_with(lower(text), 'v=dmarc1')), '(?:^|;)\\s*p=([^;]*)', 1), ''), 'none') AS dmarc_policy FROM k GROUP BY domain""")
def dns_facts_query(spark, sf_dir):
    """What raw answers say of each domain."""
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("at"), *(F.expr(e).alias(c) for c, e in _LOOKUPS.items()))
    return dns_facts(a.select("at", F.concat("prefix", "domain").alias("name"), "type", "text", "error"))


#: The kinds of evidence that the store knows.
KINDS = ["rule_hit", "retrieval_neighbor", "pii_match", "model_reason"]
#: Messages of which some break each constraint, by their ids.
_DAMAGED = {
    "urls": "CASE WHEN id % 11 = 3 THEN 2 ELSE urls END", "label": "CASE WHEN id % 13 = 5 THEN -1 ELSE label END", "sender_email": "CASE WHEN id % 19 <> 2 THEN sender_email END",
    "verdict": "CASE WHEN id % 17 = 4 THEN 'unsure' WHEN id % 5 <> 0 THEN 'benign' END", "kind": "CASE WHEN id % 23 = 6 THEN 'guess' ELSE 'pii_match' END",
}


def _damaged(spark, sf_dir):
    return messages(spark, sf_dir).select("id", *(F.expr(e).alias(c) for c, e in _DAMAGED.items()))


def store_checks():
    """The store's constraints by name."""
    return {
        "urls": F.col("urls").isin(0, 1), "label": F.col("label").isin(0, 1), "verdict": F.col("verdict").isin(*rules.VERDICTS),
        "kind": F.col("kind").isin(*KINDS), "sender_email": F.col("sender_email").isNotNull(),
    }


_DAMAGED_SQL = f"WITH {B.MESSAGES}, x AS (SELECT id, {', '.join(f'{e} AS {c}' for c, e in _DAMAGED.items())} FROM m)"
_FAILED = {"urls": "urls NOT IN (0, 1)", "label": "label NOT IN (0, 1)", "verdict": "verdict NOT IN ('benign', 'needs_review', 'phishing')", "kind": "kind NOT IN ('rule_hit', 'retrieval_neighbor', 'pii_match', 'model_reason')", "sender_email": "sender_email IS NULL"}


@query("failed_checks", f"{_DAMAGED_SQL} " + " UNION ALL ".join(f"SELECT id, '{c}' AS check_name FROM x WHERE {e}" for c, e in _FAILED.items()))
def failed_checks(spark, sf_dir):
    """Rows that break the store's constraints, with the constraint's name."""
    rows = _damaged(spark, sf_dir).withColumn("failed", sinks.failed_checks(store_checks()))
    return unnest(rows, "failed", "check_name", "id")


@query("append_checked", f"{_DAMAGED_SQL}, f AS (SELECT id, " + " OR ".join(f"coalesce({e}, false)" for e in _FAILED.values()) + " AS bad FROM x) SELECT bad AS rejected, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM f GROUP BY bad")
def append_checked(spark, sf_dir):
    """Rows appended to a table in two batches; those that fail a check land beside it and keep none back."""
    path = f"{shared_dir(spark)}/append-{uuid.uuid4().hex}"
    rows = _damaged(spark, sf_dir)
    for half in (0, 1):
        sinks.append_table(rows.filter(F.col("id") % 2 == half), path, store_checks())
    both = spark.read.parquet(path).select("id", F.lit(False).alias("rejected")).unionByName(spark.read.parquet(f"{path}_rejected").select("id", F.lit(True).alias("rejected")))
    return both.groupBy("rejected").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("reasons_capped", f"WITH {P1D}, {B.ontology_ctes()}, r AS (SELECT id, list_concat(reasons, properties) AS r FROM o0) SELECT id, CASE WHEN len(r) > 5 THEN list_append(r[1:4], r[-1]) ELSE r END AS shown FROM r")
def reasons_capped(spark, sf_dir, most: int = 5):
    """What a card with room for so many lines shows of reasons and properties: the first ones and always the last."""
    r = F.col("r")
    shown = F.when(F.size(r) > most, F.concat(F.slice(r, 1, most - 1), F.slice(r, -1, 1))).otherwise(r)
    return scored(spark, sf_dir, dns=True).select("id", F.concat("reasons", ontology.properties()).alias("r")).select("id", shown.alias("shown"))


@query("indicator_struct", f"WITH {P1D} SELECT id, sender_domain, CASE WHEN urgency > 0 THEN true END AS urgency, CASE WHEN creds_request > 0 THEN true END AS creds_request, CASE WHEN domain_mismatch THEN true END AS domain_mismatch, len(link_hosts) AS n_hosts FROM p1")
def indicator_struct(spark, sf_dir):
    """The indicators; a null is an absent key."""
    i = scored(spark, sf_dir, dns=True).select("id", rules.indicators().alias("i"))
    n = F.when(F.col("i.link_hosts").isNotNull(), F.size("i.link_hosts").cast("long"))
    return i.select("id", "i.sender_domain", "i.urgency", "i.creds_request", "i.domain_mismatch", n.alias("n_hosts"))
