"""Queries on sources, sinks, cleaning, string scalars and text alignment."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from heron.functions import text as X
from heron.functions.pii import PATTERNS
from heron.operators import align, cleaning as C
from heron.operators.running import merge_ranges as merge_spans
from heron.plans import oracle_base as B
from heron.plans.book import query
from heron.plans.session import shared_dir, table
from heron.plans.views import BRANDS, scored, unnest, vectors
from heron.sources import backfill, sinks
from heron.sources.messages import MESSAGE_TYPES, browser_rows, messages, read_csv, read_jsonl, without_bad_bytes

M = f"WITH {B.MESSAGES}"


def _temp(spark, tag):
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


@query("scan_csv", f"{M} SELECT sender_email, subject, body, CAST(urls AS VARCHAR) AS urls, CAST(label AS VARCHAR) AS label FROM m")
def scan_csv(spark, sf_dir):
    """Messages written as quoted CSV and scanned again with a declared schema."""
    path = _temp(spark, "csv")
    cols = ["sender_email", "subject", "body", "urls", "label"]
    messages(spark, sf_dir).select(*cols).write.option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return read_csv(spark, path, ", ".join(f"{c} string" for c in cols)).select(*cols)


@query("scan_jsonl", "SELECT left(text, 50) AS subject, text AS body, CAST(doc_id % 4 < 3 AS INT) AS label, CASE WHEN doc_id % 3 = 0 THEN 'Unknown' ELSE source END AS created_by, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 2 END AS n_emotions FROM documents")
def scan_jsonl(spark, sf_dir):
    """Documents as JSON lines with malformed lines among them, which are skipped."""
    path = _temp(spark, "jsonl")
    kind = F.element_at(F.array(*map(F.lit, ["Phishing", "Spam", "Phishing Simulation", "Valid"])), F.expr("cast(doc_id % 4 + 1 as int)"))
    row = F.to_json(F.struct(
        F.left("text", F.lit(50)).alias("Subject"), F.col("text").alias("Body"), F.lit("a@b.c").alias("Sender"), kind.alias("Type"),
        F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("Created by"), F.when(F.col("doc_id") % 5 != 0, F.array(F.lit("fear"), F.lit("hope"))).alias("LLM detected emotion"),
    ))
    table(spark, sf_dir, "documents").select(F.explode(F.array(row, F.lit("{broken"))).alias("value")).write.text(path)
    return read_jsonl(spark, path).select("subject", "body", "label", "created_by", F.size("emotions").alias("n_emotions"))


#: Lines of a browser's table: quoted fields with commas and doubled quotes, short rows, blanks, a carriage return at the end.
_LINE = """concat(CASE WHEN id % 6 = 0 THEN '' ELSE concat('u', id) END, ',,"', replace(subject, '"', '""'), '","say ""hi"", ', replace(replace(body, chr(10), ' '), '"', '""'), '"',
 CASE WHEN id % 4 = 0 THEN '' WHEN id % 4 = 1 THEN ', 1 ' ELSE ',0' END, CASE WHEN id % 3 = 0 THEN chr(13) ELSE '' END)"""


@query("scan_browser_csv", f"""{M} SELECT 'u' || id AS sender, regexp_replace(subject, '^\\s+|\\s+$', '', 'g') AS subject, regexp_replace('say "hi", ' || replace(body, chr(10), ' '), '^\\s+|\\s+$', '', 'g') AS body,
 CASE WHEN id % 4 = 1 OR regexp_matches(body, '(?i)https?://|www[.]') THEN 1 ELSE 0 END AS url FROM m WHERE id % 6 <> 0 AND regexp_replace(subject, '^\\s+|\\s+$', '', 'g') <> ''""")
def scan_browser_csv(spark, sf_dir):
    """Messages written as lines of a browser's table and read again, quote by quote."""
    path = _temp(spark, "browser")
    messages(spark, sf_dir).select(F.expr(_LINE).alias("value")).write.option("lineSep", "\n").text(path)
    lines = spark.read.option("lineSep", "\n").text(path)
    return browser_rows(lines, "Sender, receiver,subject ,BODY,url").select("sender", "subject", "body", "url")


@query("scan_tolerant", "SELECT 'row ' || doc_id AS subject, CAST(doc_id % 5 AS VARCHAR) AS label FROM documents")
def scan_tolerant(spark, sf_dir):
    """CSV with bytes that are no UTF-8, which are left out."""
    path = _temp(spark, "bytes")
    row = F.concat(F.lit("row ").cast("binary"), F.when(F.col("doc_id") % 2 == 0, F.unhex(F.lit("FF"))).otherwise(F.lit("").cast("binary")), F.concat(F.col("doc_id").cast("string"), F.lit(","), (F.col("doc_id") % 5).cast("string")).cast("binary"))
    # Latin-1 writes each byte as it is.
    table(spark, sf_dir, "documents").select(F.decode(row, "ISO-8859-1").alias("value")).write.option("encoding", "ISO-8859-1").csv(path, quote="", escape="", sep="\t")
    rows = spark.read.schema("subject string, label string").csv(path)
    return without_bad_bytes(rows)


@query("backfill_targets", f"{M}, e AS (SELECT m.id, m.subject, m.body FROM m LEFT JOIN embeddings v ON v.vec_id = m.id WHERE v.vec_id IS NULL) SELECT id, 'doc' AS target, CAST(length(left(regexp_replace(subject || chr(10) || chr(10) || body, '^\\s+|\\s+$', '', 'g'), 8000)) AS INT) AS n FROM e UNION ALL SELECT id, 'subject', CAST(length(left(regexp_replace(subject, '^\\s+|\\s+$', '', 'g'), 8000)) AS INT) AS n FROM e WHERE n > 0")
def backfill_targets(spark, sf_dir):
    """Inputs of the rows that have no vector yet, by anti-join."""
    v = vectors(spark, sf_dir).select(F.col("vec_id").alias("id"))
    rows = messages(spark, sf_dir).select("id", "subject", "body").join(v, "id", "left_anti").withColumn("url_extracted", F.lit(None).cast("string"))
    both = C.embedding_inputs(rows, "doc").unionByName(C.embedding_inputs(rows, "subject"))
    return both.select("id", "target", F.length("input").alias("n"))


_TARGETS = "SELECT id, 'doc' AS target, CAST(length(left(regexp_replace(subject || chr(10) || chr(10) || body, '^\\s+|\\s+$', '', 'g'), 8000)) AS INT) AS n FROM e"


@query("backfill_resumed", f"{M}, e AS (SELECT m.id, m.subject, m.body FROM m LEFT JOIN embeddings v ON v.vec_id = m.id WHERE v.vec_id IS NULL), t AS ({_TARGETS}), k AS (SELECT *, (row_number() OVER (ORDER BY id) - 1) // CAST(ceil(count(*) OVER () / 6.0) AS BIGINT) AS ntile FROM t) SELECT id, target, n, max(id) OVER (PARTITION BY ntile) AS batch FROM k")
def backfill_resumed(spark, sf_dir):
    """The inputs of rows without a vector, a sixth of them at a time; the first run stops after two batches, the second does the rest."""
    v = vectors(spark, sf_dir).select(F.col("vec_id").alias("id"))
    todo = messages(spark, sf_dir).select("id", "subject", "body").join(v, "id", "left_anti").withColumn("url_extracted", F.lit(None).cast("string"))
    path, size = _temp(spark, "backfill"), max(1, -(-todo.count() // 6))

    def make(rows):
        return C.embedding_inputs(rows, "doc").select("id", "target", F.length("input").alias("n"))

    backfill.backfill(todo, make, path, size, batches=2)
    backfill.backfill(todo, make, path, size)
    return backfill.backfilled(spark, path, "id long, target string, n int")


@query("update_vectors", "SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 1.0 ELSE round(CAST(embedding[1] AS DOUBLE), 6) END AS first FROM embeddings")
def update_vectors(spark, sf_dir):
    v = vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "v")
    fresh = v.filter("id % 3 = 0").select("id", F.transform("v", lambda x: F.lit(1.0)).alias("new"))
    return sinks.update_vectors(v, fresh).select("id", F.round(F.col("v")[0], 6).alias("first"))


@query("update_partitions", "SELECT vec_id AS id, CASE WHEN vec_id % 300 < 50 AND vec_id % 7 = 0 THEN 1.0 ELSE round(CAST(embedding[1] AS DOUBLE), 6) END AS first FROM embeddings")
def update_partitions(spark, sf_dir):
    """A stored table of vectors, of which only the partitions with new vectors are written again."""
    v, path = vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "v"), _temp(spark, "vectors")
    backfill.write_by_ids(v, path, 50)
    fresh = v.filter("id % 300 < 50 AND id % 7 = 0").select("id", F.transform("v", lambda x: F.lit(1.0)).alias("new"))
    backfill.update_by_ids(spark, path, fresh, "v", 50)
    return spark.read.parquet(path).select("id", F.round(F.col("v")[0], 6).alias("first"))


@query("split_by_position", "SELECT part, count(*) AS n, min(doc_id) AS lo, max(doc_id) AS hi FROM (SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= CAST(floor(0.7 * (SELECT count(*) FROM documents)) AS BIGINT) THEN 0 ELSE 1 END AS part FROM documents) GROUP BY part")
def split_by_position(spark, sf_dir):
    return sinks.split_by_position(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.7).groupBy("part").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))


@query("split_with_header", "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k, count(*) OVER () + 1 AS n FROM documents), p AS (SELECT CASE WHEN k < CAST(floor(0.3 * n) AS BIGINT) THEN 0 ELSE 1 END AS part, doc_id FROM r) SELECT part, count(*) + CAST(part = 0 AS INT) AS n, part = 0 AS has_header, min(doc_id) AS lo, max(doc_id) AS hi FROM p GROUP BY part")
def split_with_header(spark, sf_dir):
    """Lines of a table split by position with the header counted as row 0, so that only the first part has it."""
    lines = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("at"), F.concat_ws(",", "doc_id", "lang").alias("line"))
    rows = sinks.split_lines(lines, "doc_id,lang", 0.3)
    id_ = F.when(F.col("line") != "doc_id,lang", F.split_part("line", F.lit(","), F.lit(1)).cast("long"))
    return rows.groupBy("part").agg(F.count("*").alias("n"), F.bool_or(F.col("line") == "doc_id,lang").alias("has_header"), F.min(id_).alias("lo"), F.max(id_).alias("hi"))


@query("write_outputs", f"{M} SELECT count(*) AS n, count(label) AS labelled, CAST(sum(id) AS BIGINT) AS ids FROM m")
def write_outputs(spark, sf_dir):
    """Results written as CSV and JSON, and the JSON read back."""
    path = _temp(spark, "outputs")
    rows = messages(spark, sf_dir).select("id", "label", "emotions")
    sinks.write_outputs(rows, rows.agg(F.count("*").alias("n")), path)
    back = spark.read.schema("id long, label int, emotions array<string>").json(f"{path}/rows_json")
    return back.agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.sum("id").alias("ids"))


_SENDER = "CASE WHEN id % 4 = 0 THEN 'User <' || sender_email || '>' WHEN id % 4 = 1 THEN sender_email WHEN id % 4 = 2 THEN '  ' ELSE 'no address' END"


@query("clean_sender_email", f"{M}, s AS (SELECT id, {_SENDER} AS sender FROM m) SELECT id, CASE WHEN trim(sender) = '' THEN sender WHEN regexp_matches(sender, '<[^>]+>') THEN trim(regexp_extract(sender, '<([^>]+)>', 1)) ELSE trim(sender) END AS email FROM s")
def clean_sender_email(spark, sf_dir):
    s = messages(spark, sf_dir).select("id", F.expr(_SENDER).alias("sender"))
    return s.select("id", C.sender_email(F.col("sender"), F.lit(None).cast("string")).alias("email"))


@query("normalize_timestamp", f"{M} SELECT id, CASE WHEN id % 3 = 2 THEN '' ELSE strftime(coalesce(msg_date, created_at) + CASE WHEN id % 3 = 0 THEN INTERVAL 3 HOUR ELSE INTERVAL 0 HOUR END, '%Y-%m-%dT%H:%M:%S') END AS iso FROM m")
def normalize_timestamp(spark, sf_dir):
    """Mail dates with weekday, -0300 and a zone name, ISO dates, and junk."""
    ts = F.coalesce("msg_date", "created_at")
    raw = F.when(F.col("id") % 3 == 0, F.concat(F.lit("Fri, "), F.date_format(ts, "d MMM yyyy HH:mm:ss"), F.lit(" -0300 (BRT)"))).when(F.col("id") % 3 == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).otherwise("not a date")
    return messages(spark, sf_dir).select("id", C.timestamp_text(raw).alias("iso"))


_RAW = "CASE id % 8 WHEN 0 THEN '1' WHEN 1 THEN '0.9' WHEN 2 THEN '' WHEN 3 THEN 'x' WHEN 4 THEN '2.0' WHEN 5 THEN NULL WHEN 6 THEN ' 0 ' ELSE '-0.5' END"


@query("clean_urls_flag", f"{M} SELECT id, CASE WHEN TRY_CAST(trim({_RAW}) AS DOUBLE) >= 1 THEN 1 ELSE 0 END AS flag FROM m")
def clean_urls_flag(spark, sf_dir):
    return messages(spark, sf_dir).select("id", C.binary_flag(F.expr(_RAW)).alias("flag"))


@query("clean_label", f"{M} SELECT id, CASE WHEN trunc(TRY_CAST(trim({_RAW}) AS DOUBLE)) IN (0, 1) THEN CAST(trunc(TRY_CAST(trim({_RAW}) AS DOUBLE)) AS INT) END AS label FROM m")
def clean_label(spark, sf_dir):
    return messages(spark, sf_dir).select("id", C.binary_label(F.expr(_RAW)).alias("label"))


@query("coerce_int", f"{M} SELECT id, coalesce(CASE WHEN regexp_matches(trim({_RAW}), '^[+-]?[0-9]+$') THEN CAST(trim({_RAW}) AS INT) END, 0) AS n FROM m")
def coerce_int(spark, sf_dir):
    return messages(spark, sf_dir).select("id", C.integer(F.expr(_RAW)).alias("n"))


@query("coerce_float", f"{M} SELECT id, coalesce(CAST(trunc(TRY_CAST(trim({_RAW}) AS DOUBLE)) AS BIGINT), 0) AS n FROM m")
def coerce_float(spark, sf_dir):
    return messages(spark, sf_dir).select("id", C.truncated(F.expr(_RAW)).alias("n"))


@query("clean_corpus", f"{M}, s AS (SELECT id, {_SENDER} AS sender, {_RAW} AS raw FROM m) SELECT count(*) AS n, count(CASE WHEN trim(sender) <> '' THEN 1 END) AS senders, CAST(sum(CASE WHEN TRY_CAST(trim(raw) AS DOUBLE) >= 1 THEN 1 ELSE 0 END) AS BIGINT) AS urls, count(CASE WHEN trunc(TRY_CAST(trim(raw) AS DOUBLE)) IN (0, 1) THEN 1 END) AS labels, 9 AS n_columns FROM s")
def clean_corpus(spark, sf_dir):
    raw = messages(spark, sf_dir).select(F.expr(_SENDER).alias("sender"), "subject", "body", F.expr(_RAW).alias("urls"), F.expr(_RAW).alias("label"))
    out = C.clean(raw)
    return out.agg(F.count("*").alias("n"), F.count_if(F.trim("sender_email") != "").alias("senders"), F.sum("urls").alias("urls"), F.count("label").alias("labels")).withColumn("n_columns", F.lit(len(out.columns)))


@query("sender_domain_sql", f"{M} SELECT id, lower(split_part(sender_email, '@', 2)) AS domain FROM m")
def sender_domain_sql(spark, sf_dir):
    return messages(spark, sf_dir).select("id", X.domain_first(F.col("sender_email")).alias("domain"))


@query("sender_domain_rsplit", f"{M}, s AS (SELECT id, {_SENDER} AS s FROM m) SELECT id, CASE WHEN contains(s, '@') THEN trim(lower(string_split(s, '@')[-1])) ELSE '' END AS domain FROM s")
def sender_domain_rsplit(spark, sf_dir):
    return messages(spark, sf_dir).select("id", X.domain_last(F.expr(_SENDER)).alias("domain"))


_ODD_SENDER = "CASE id % 6 WHEN 0 THEN 'User < ' || replace(sender_email, '@', ' @') || ' >' WHEN 1 THEN 'mail ' || sender_email || ' now' WHEN 2 THEN '  ' WHEN 3 THEN 'no address' WHEN 4 THEN 'a <none> b@c' ELSE sender_email || ' <x@y' END"
_FALLBACK = "[\\w\\.-]+@[\\w\\.-]+\\.[a-zA-Z]{2,}"


@query("clean_sender_fallback", f"""{M}, s AS (SELECT id, trim({_ODD_SENDER}) AS s FROM m), i AS (SELECT *, regexp_extract(s, '<([^>]+)>', 1) AS inside, CASE WHEN contains(s, '>') THEN regexp_extract(s, '^[^<]*<([^>]*)', 1) ELSE '' END AS after, regexp_extract(s, '{_FALLBACK}') AS found FROM s)
SELECT id, CASE WHEN contains(inside, '@') THEN replace(inside, ' ', '') WHEN found <> '' THEN found WHEN contains(s, '@') THEN replace(s, ' ', '') ELSE 'unknown@example.com' END AS searched,
 CASE WHEN contains(after, '@') THEN replace(after, ' ', '') WHEN contains(s, '@') THEN replace(s, ' ', '') ELSE 'unknown@example.com' END AS split FROM i""")
def clean_sender_fallback(spark, sf_dir):
    """Both variants: with a search for an address, and without."""
    s = F.expr(_ODD_SENDER)
    return messages(spark, sf_dir).select("id", C.sender_fallback(s).alias("searched"), C.sender_fallback(s, search=False).alias("split"))


@query("url_flag_variants", f"{M} SELECT id, urls AS csv_flag, CAST(regexp_matches(subject || chr(10) || body, '(?i)(https?://|www\\.)\\S+') AS INT) AS text_flag, CAST(contains(lower(subject || ' ' || body), 'http') AS INT) AS http_flag, CAST(regexp_matches(body, '(?i)https?://|www\\.') AS INT) AS ui_flag FROM m")
def url_flag_variants(spark, sf_dir):
    return messages(spark, sf_dir).select(
        "id", F.col("urls").alias("csv_flag"), F.concat("subject", F.lit("\n"), "body").rlike(X.URL_TEXT).cast("int").alias("text_flag"),
        F.contains(F.lower(F.concat("subject", F.lit(" "), "body")), F.lit("http")).cast("int").alias("http_flag"), F.col("body").rlike(X.URL_UI).cast("int").alias("ui_flag"),
    )


@query("combine_subject_body", f"{M} SELECT id, left(regexp_replace(subject || chr(10) || chr(10) || body, '^\\s+|\\s+$', '', 'g'), 8000) AS text FROM m")
def combine_subject_body(spark, sf_dir):
    return messages(spark, sf_dir).select("id", C.combine(F.col("subject"), F.col("body")).alias("text"))


@query("embedding_inputs", f"{M} SELECT id, 'body' AS target, left(regexp_replace(body, '^\\s+|\\s+$', '', 'g'), 8000) AS input FROM m WHERE regexp_replace(body, '^\\s+|\\s+$', '', 'g') <> ''")
def embedding_inputs(spark, sf_dir):
    return C.embedding_inputs(messages(spark, sf_dir).withColumn("url_extracted", F.lit(None).cast("string")), "body")


@query("nonblank_domains", f"{M}, s AS (SELECT id, {_SENDER} AS s FROM m) SELECT id FROM s WHERE lower(split_part(s, '@', 2)) <> ''")
def nonblank_domains(spark, sf_dir):
    return messages(spark, sf_dir).filter((X.domain_first(F.expr(_SENDER)).isNotNull()) & (X.domain_first(F.expr(_SENDER)) != "")).select("id")


@query("labelled_rows", f"{M} SELECT CAST(sum(CAST(label IN (0, 1) AS INT)) AS BIGINT) AS used, CAST(sum(CAST(label IS NULL OR label NOT IN (0, 1) AS INT)) AS BIGINT) AS skipped FROM m")
def labelled_rows(spark, sf_dir):
    ok = F.coalesce(F.col("label").isin(0, 1), F.lit(False))
    return messages(spark, sf_dir).agg(F.count_if(ok).alias("used"), F.count_if(~ok).alias("skipped"))


@query("valid_addresses", f"{M}, s AS (SELECT id, {_SENDER} AS s FROM m) SELECT id, regexp_matches(s, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') AS valid FROM s")
def valid_addresses(spark, sf_dir):
    return messages(spark, sf_dir).select("id", F.expr(_SENDER).rlike(X.ADDRESS).alias("valid"))


@query("ensure_url", f"{M} SELECT id, CASE WHEN regexp_matches(body, '(?i)https?://') THEN body ELSE body || chr(10) || chr(10) || 'https://example.com/portal' END AS body FROM m")
def ensure_url(spark, sf_dir):
    return messages(spark, sf_dir).select("id", C.ensure_url(F.col("body"), "https://example.com/portal").alias("body"))


@query("round_robin", "SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS template FROM documents")
def round_robin(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), C.round_robin(F.col("doc_id"), ["a", "b", "c"]).alias("template"))


@query("delete_history_row", "SELECT doc_id AS id FROM documents WHERE doc_id <> 7")
def delete_history_row(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("doc_id <> 7").select(F.col("doc_id").alias("id"))


_HOSTS = "[trim(split_part(lower(x), ':', 1), '[]') for x in regexp_extract_all(body, '(?:https?://|www\\.)([^/\\s]+)', 1)]"


@query("hosts_in_text", f"{M} SELECT id, {_HOSTS} AS hosts FROM m")
def hosts_in_text(spark, sf_dir):
    return messages(spark, sf_dir).select("id", X.hosts(F.col("body")).alias("hosts"))


@query("is_confusable", f"{M}, d AS (SELECT DISTINCT lower(split_part(sender_email, '@', 2)) AS domain FROM m) SELECT domain, translate(domain, '01357', 'olest') = 'acme.com' AND domain <> 'acme.com' AS confusable FROM d")
def is_confusable(spark, sf_dir):
    d = messages(spark, sf_dir).select(X.domain_first(F.col("sender_email")).alias("domain")).distinct()
    return d.select("domain", X.confusable(F.col("domain"), F.lit("acme.com")).alias("confusable"))


_RECORD = "CASE doc_id % 4 WHEN 0 THEN 'v=DMARC1; p=reject; sp=none' WHEN 1 THEN 'v=DMARC1;p=none' WHEN 2 THEN 'v=DMARC1; rua=x' END"


@query("parse_dmarc_policy", f"WITH r AS (SELECT doc_id AS id, {_RECORD} AS r FROM documents), p AS (SELECT id, [trim(x) for x in string_split(r, ';') if starts_with(trim(x), 'p=')] AS p FROM r) SELECT id, CASE WHEN len(p) > 0 THEN substr(p[1], 3) END AS policy FROM p")
def parse_dmarc_policy(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), X.dmarc_policy(F.expr(_RECORD)).alias("policy"))


#: A URL at the end of a text loses marks and slashes that end it; before other text it keeps all up to the white space.
_AT_END = "regexp_replace(url, '[^A-Za-z0-9_]+$', '')"


def _around(spark, sf_dir):
    """Pages' URLs in text: each twice, the second time with a full stop at the end of the text; a bare domain, a number and an address between."""
    p = table(spark, sf_dir, "pages")
    return p.select(F.col("page_id").alias("id"), F.concat(F.lit("See "), "url", F.lit(" or 4.5 at example.org, 10.0.0.1:80 or http://192.0.2.7/a and "), "url", F.lit(".")).alias("text"))


def _urls_sql(plain):
    return f"SELECT page_id AS id, url || '{plain},http://192.0.2.7/a' || CASE WHEN {_AT_END} <> url THEN ',' || {_AT_END} ELSE '' END AS urls FROM pages"


@query("extract_urls", _urls_sql(""))
def extract_urls(spark, sf_dir):
    return _around(spark, sf_dir).select("id", X.extract_urls(F.col("text")).alias("urls"))


@query("extract_urls_any", _urls_sql(",example.org"))
def extract_urls_any(spark, sf_dir):
    return _around(spark, sf_dir).select("id", X.extract_urls(F.col("text"), require_netloc=False).alias("urls"))


@query("content_hash", f"{M} SELECT id, sha256(subject || '||' || body) AS hash, left(md5(body), 8) AS short_hash FROM m")
def content_hash(spark, sf_dir):
    return messages(spark, sf_dir).select("id", X.content_hash(F.col("subject"), F.col("body")).alias("hash"), F.left(F.md5("body"), F.lit(8)).alias("short_hash"))


@query("extract_tag", "SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'AUTH' WHEN 1 THEN 'URL' ELSE 'OTHER' END AS tag FROM documents")
def extract_tag(spark, sf_dir):
    reason = F.expr("CASE doc_id % 3 WHEN 0 THEN '[AUTH] no SPF' WHEN 1 THEN '[URL] short link' ELSE 'plain [X]' END")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), X.bracket_tag(reason).alias("tag"))


@query("reason_tag", f"WITH {B.phase1(True)} SELECT tag, count(*) AS n FROM (SELECT {B.reason_tag()} AS tag FROM (SELECT unnest(reasons) AS reason FROM p1)) GROUP BY tag")
def reason_tag(spark, sf_dir):
    r = unnest(scored(spark, sf_dir, dns=True), "reasons", "reason")
    return r.groupBy(X.reason_tag(F.col("reason")).alias("tag")).agg(F.count("*").alias("n"))


_SENT = "[^.!?\\n]+[.!?\\n]?"


@query("split_sentences", f"SELECT conv_id, turn, regexp_extract_all(text, '{_SENT}') AS sentences FROM conversations WHERE len(regexp_extract_all(text, '{_SENT}')) > 0")
def split_sentences(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("sentences", X.sentences(F.col("text")))
    return c.filter(F.col("text").rlike(X.SENTENCE)).select("conv_id", "turn", "sentences")


@query("tokenize", "SELECT conv_id, turn, regexp_extract_all(lower(text), '[A-Za-z0-9]+(?:''[A-Za-z0-9]+)?') AS tokens FROM conversations")
def tokenize(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.tokens(F.col("text")).alias("tokens"))


_SPANS = """(SELECT r, conv_id, turn, i, CAST(sum(length(gap) + length(t)) OVER (PARTITION BY r ORDER BY i) - length(t) AS INT) AS start, CAST(sum(length(gap) + length(t)) OVER (PARTITION BY r ORDER BY i) AS INT) AS "end", t AS text
 FROM (SELECT r, conv_id, turn, generate_subscripts(f, 1) AS i, unnest(f) AS t, unnest(g[1:len(f)]) AS gap FROM (SELECT r, conv_id, turn, regexp_extract_all({0}, '{1}') AS f, regexp_split_to_array({0}, '{1}') AS g FROM {2})))"""
_C = "c AS (SELECT row_number() OVER () AS r, conv_id, turn, text FROM conversations)"
_S_SPANS = f"""{_C}, s0 AS {_SPANS.format('text', _SENT, 'c')}, s AS (SELECT * FROM s0 UNION ALL SELECT r, conv_id, turn, 1, 0, CAST(length(text) AS INT), text FROM c WHERE text IS NOT NULL AND r NOT IN (SELECT r FROM s0))"""


@query("sentence_offsets", f"""WITH {_S_SPANS} SELECT conv_id, turn, CAST(i - 1 AS INT) AS i, start, "end", text FROM s""")
def sentence_offsets(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    return c.select("conv_id", "turn", F.posexplode(X.sentence_offsets(F.col("text"))).alias("i", "s")).select("conv_id", "turn", "i", "s.*")


_T_SPANS = _SPANS.format("text", "[A-Za-z0-9]+(?:''[A-Za-z0-9]+)?", "(SELECT row_number() OVER () AS r, r * 100000 + start AS conv_id, conv_id * 1000 + turn AS turn, text FROM s)")


@query("token_offsets", f"""WITH {_S_SPANS}, t AS {_T_SPANS} SELECT turn // 1000 AS conv_id, turn % 1000 AS turn, CAST(start + conv_id % 100000 AS INT) AS start, CAST("end" + conv_id % 100000 AS INT) AS "end", lower(text) AS text FROM t""")
def token_offsets(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    s = c.select("conv_id", "turn", F.explode(X.sentence_offsets(F.col("text"))).alias("s"))
    return s.select("conv_id", "turn", F.explode(X.token_offsets(F.col("s"))).alias("t")).select("conv_id", "turn", "t.*")


#: The answers that count as right for a document, and those that were chosen; both from its id.
_RIGHT = "array_remove(array(if(doc_id % 2 = 0, 'url', ''), if(doc_id % 3 = 0, 'sender', ''), if(doc_id % 5 = 0, 'tone', '')), '')"
_CHOSEN = "array_remove(array(if(doc_id % 15 = 0, 'tone', ''), if(doc_id % 4 = 0, 'url', ''), if(doc_id % 3 = 0, 'sender', ''), if(doc_id % 9 = 0, 'sender', '')), '')"


@query("challenge_points", """WITH d AS (SELECT source, doc_id, doc_id % 2 = 0 AS r1, doc_id % 3 = 0 AS r2, doc_id % 5 = 0 AS r3, doc_id % 4 = 0 AS c1, doc_id % 3 = 0 AS c2, doc_id % 15 = 0 AS c3 FROM documents)
SELECT source, count(*) AS played, count(*) FILTER (r1 = c1 AND r2 = c2 AND r3 = c3) AS solved, CAST(sum(CASE WHEN r1 = c1 AND r2 = c2 AND r3 = c3 THEN 10 * (1 + doc_id % 3) ELSE 0 END) AS BIGINT) AS points FROM d GROUP BY source""")
def challenge_points(spark, sf_dir):
    """Challenges solved by the exact set of answers, and their points."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", X.same_set(F.expr(_CHOSEN), F.expr(_RIGHT)).alias("solved"))
    return d.groupBy("source").agg(F.count("*").alias("played"), F.count_if("solved").alias("solved"), F.sum(F.when(F.col("solved"), 10 * (1 + F.col("doc_id") % 3)).otherwise(0)).alias("points"))


@query("short_digests", """WITH d AS (SELECT doc_id, string_split(lang || ':' || doc_id || ':' || regexp_replace(left(text, 20), '[^ -~]', '?', 'g'), '') AS cs FROM documents),
h AS (SELECT doc_id, list_reduce(list_transform(cs, lambda c: CAST(unicode(c) AS HUGEINT)), lambda s, c: xor(s, c) * 16777619 % 4294967296, CAST(2166136261 AS HUGEINT)) AS a,
 list_reduce(list_transform(cs, lambda c: CAST(unicode(c) AS HUGEINT)), lambda s, c: xor(s, (c + s + s * 64 % 4294967296 + s // 4) % 4294967296), CAST(2654435769 AS HUGEINT)) AS b FROM d),
m AS (SELECT doc_id, xor(a, (b * 8192) % 4294967296 + b // 524288) AS x, xor(b, (a * 2048) % 4294967296 + a // 2097152) AS y FROM h)
SELECT doc_id AS id, lower(concat(printf('%02x', CAST(x % 256 AS BIGINT)), printf('%02x', CAST(x // 256 % 256 AS BIGINT)), printf('%02x', CAST(x // 65536 % 256 AS BIGINT)), printf('%02x', CAST(y % 256 AS BIGINT)), printf('%02x', CAST(y // 256 % 256 AS BIGINT)), printf('%02x', CAST(xor(x, y) // 65536 % 256 AS BIGINT)))) AS digest FROM m""")
def short_digests(spark, sf_dir):
    """The short digest of user, item and answer."""
    message = F.concat("lang", F.lit(":"), F.col("doc_id").cast("string"), F.lit(":"), F.regexp_replace(F.left("text", F.lit(20)), "[^ -~]", "?"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), X.short_digest(message).alias("digest"))


@query("previews", f"{M} SELECT id, left(subject, 100) AS s, replace(left(body, 240), chr(10), ' ') AS b FROM m")
def previews(spark, sf_dir):
    return messages(spark, sf_dir).select("id", F.left("subject", F.lit(100)).alias("s"), F.translate(F.left("body", F.lit(240)), "\n", " ").alias("b"))


_PAIRS = "pairs AS (SELECT a.conv_id * 1000 + a.turn AS id, a.text AS a, b.text AS b FROM (SELECT DISTINCT conv_id, turn, text FROM conversations) a JOIN (SELECT DISTINCT conv_id, turn, text FROM conversations) b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"


def _pairs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").distinct()
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    return c.join(nxt, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("a"), "b")


_TOK = "list_distinct(regexp_extract_all(lower(s), '[A-Za-z0-9]+(?:''[A-Za-z0-9]+)?'))"


def _sents(c):
    return f"CASE WHEN len(regexp_extract_all({c}, '{_SENT}')) > 0 THEN regexp_extract_all({c}, '{_SENT}') ELSE [{c}] END"


@query("sentence_jaccard", f"""WITH {_PAIRS}, x AS (SELECT id, unnest({_sents('a')}) AS s, generate_subscripts({_sents('a')}, 1) - 1 AS i FROM pairs), y AS (SELECT id, unnest({_sents('b')}) AS s, generate_subscripts({_sents('b')}, 1) - 1 AS j FROM pairs),
xt AS (SELECT id, i, {_TOK} AS ta FROM x), yt AS (SELECT id, j, {_TOK} AS tb FROM y),
sc AS (SELECT xt.id, i, j, CASE WHEN len(list_distinct(list_concat(ta, tb))) = 0 THEN 0.0 ELSE CAST(len(list_intersect(ta, tb)) AS DOUBLE) / len(list_distinct(list_concat(ta, tb))) END AS score FROM xt JOIN yt ON xt.id = yt.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id, i ORDER BY score DESC, j) AS rn FROM sc)
SELECT id, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(score, 6) AS score FROM r WHERE rn = 1 AND score >= 0.2""")
def sentence_jaccard(spark, sf_dir):
    return align.match_sentences(_pairs(spark, sf_dir), 0.2).withColumn("score", F.round("score", 6))


@query("lcs_spans")
def lcs_spans(spark, sf_dir):
    return align.lcs_spans(_pairs(spark, sf_dir), "a", "b").select("id", F.explode("spans").alias("s")).select("id", "s.*")


_RANGES = "ranges AS (SELECT user_id AS id, CAST(event_id % 997 AS BIGINT) AS s, CAST(event_id % 997 + event_id % 7 AS BIGINT) AS e, event_id % 5 = 0 AS strong FROM events)"


@query("merge_ranges", f"""WITH {_RANGES}, v AS (SELECT * FROM ranges WHERE e > s), f AS (SELECT *, max(e) OVER w AS reach FROM v WINDOW w AS (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM f)
SELECT id, min(s) AS start, max(e) AS "end", bool_or(strong) AS strong FROM g GROUP BY id, island""")
def merge_ranges(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = (F.col("event_id") % 997).cast("long")
    return merge_spans(e.select(F.col("user_id").alias("id"), s.alias("start"), (s + F.col("event_id") % 7).alias("end"), (F.col("event_id") % 5 == 0).alias("strong")))


#: Any key will do here; a service reads its own from its surroundings.
_KEY = "devsecret"
_PADS = ["".join(f"{b ^ pad:02x}" for b in _KEY.encode().ljust(64, b"\0")) for pad in (0x36, 0x5C)]


@query("ctf_flags", f"SELECT doc_id AS id, left(sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(lang || ':' || doc_id || ':' || left(text, 20))))), 12) AS token FROM documents")
def ctf_flags(spark, sf_dir):
    """The first twelve hex digits of a keyed digest of user, item and answer."""
    message = F.concat("lang", F.lit(":"), F.col("doc_id").cast("string"), F.lit(":"), F.left("text", F.lit(20)))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.left(X.hmac_sha256(_KEY, message), F.lit(12)).alias("token"))


_S = f"WITH {B.phase1(False)}"


@query("stream_verdicts", f"{_S} SELECT id, score, verdict FROM p1")
def stream_verdicts(spark, sf_dir):
    """Verdicts of a stream that takes all there is and ends."""
    from heron.streaming.messages import score_stream

    return _stream(spark, messages(spark, sf_dir).select(*MESSAGE_TYPES.names), lambda s: score_stream(s, BRANDS).select("id", "score", "verdict"))


@query("stream_daily", "WITH e AS (SELECT CAST(ts AS DATE) AS d, event_type, ts FROM events), top AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM e) SELECT d, event_type, count(*) AS n FROM e, top WHERE CAST(d AS TIMESTAMP) + INTERVAL 1 DAY <= mark GROUP BY d, event_type")
def stream_daily(spark, sf_dir):
    """The days that the watermark has passed when a stream of all events ends."""
    from heron.streaming.messages import daily_series

    return _stream(spark, table(spark, sf_dir, "events").select("ts", "event_type"), lambda s: daily_series(s, "ts", "event_type"))


_KINDS = ", ".join(f"CAST(sum(n_{k}) AS BIGINT) AS {k}" for k in PATTERNS)


@query("stream_redaction_totals", f"""WITH {B.MESSAGES}, {B.redaction()}, mark AS (SELECT max(msg_date) - INTERVAL 3 DAY AS t FROM red WHERE id % 3 > 0)
SELECT created_by, count(*) AS n, {_KINDS}, CAST(sum(CASE WHEN id % 3 = 0 AND msg_date < t THEN 1 ELSE 0 END) AS BIGINT) AS late_rows, count(DISTINCT id % 3 = 0) AS batches FROM red, mark GROUP BY created_by""")
def stream_redaction_totals(spark, sf_dir):
    """Running totals of a stream in two runs; the second starts from the first one's state and takes only the files that came since."""
    from heron.streaming.messages import follow_totals, latest_totals

    rows = messages(spark, sf_dir).select("id", "body", "created_by", "msg_date")
    source, path = _temp(spark, "stream-in"), _temp(spark, "stream-totals")
    for some in ("id % 3 > 0", "id % 3 = 0"):
        rows.filter(some).write.mode("append").parquet(source)
        follow_totals(spark.readStream.schema(rows.schema).parquet(source), "created_by", path, late="3 days")
    return latest_totals(spark, path, "created_by")


def _stream(spark, rows, change):
    """What a stream over the rows' files writes until it has taken them all, read back from its sink."""
    source, sink = _temp(spark, "stream-in"), _temp(spark, "stream-out")
    rows.write.parquet(source)
    out = change(spark.readStream.schema(rows.schema).parquet(source))
    out.writeStream.format("parquet").option("checkpointLocation", f"{sink}-state").trigger(availableNow=True).start(sink).awaitTermination()
    return spark.read.schema(out.schema).parquet(sink)
