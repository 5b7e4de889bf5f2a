"""The canonical messages view, and readers of the mail corpora's file formats."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heron.functions import text as X
from heron.plans.session import table

#: The phrases that the mapping of the driver's tables puts into bodies.
CUES = [
    " This is urgent.", " Please verify your account.", " Enter your password to continue.", " Call 555-010-1234 today.",
    " SSN 123-45-6789 on file.", " DOB 01/02/1980.", " Card 4111 1111 1111 1111.",
]
CUE_NAMES = ["urgency", "verify", "password", "phone", "ssn", "dob", "card"]
CSV_SCHEMA = "sender string, receiver string, msg_date string, subject string, body string, urls string, label string, sender_email string, url_extracted string"
JSONL_SCHEMA = "`Subject` string, `Body` string, `Sender` string, `Type` string, `Created by` string, `LLM detected emotion` array<string>, `Source` string"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as mail: sender, subject, body with cues and links, label, dates; all from the ids."""
    d = table(spark, sf_dir, "documents")
    # Fifty pages at most, so their broadcast is bounded.
    p = table(spark, sf_dir, "pages").filter("page_id < 50").select("page_id", "url")
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_id"), "quality", "toxic")
    cue, cue_name = F.lit(""), F.lit("none")
    for k, (phrase, name) in enumerate(zip(CUES, CUE_NAMES, strict=True)):
        cue = F.when(F.col("doc_id") % 10 == k, phrase).otherwise(cue)
        cue_name = F.when(F.col("doc_id") % 10 == k, name).otherwise(cue_name)
    link = F.expr("""
        CASE doc_id % 7 WHEN 0 THEN ' http://192.0.2.7/login' WHEN 1 THEN ' https://bit.ly/abc' WHEN 2 THEN concat(' ', url)
        WHEN 3 THEN ' https://www.corp1.example.com/x' WHEN 4 THEN ' http://microsoft.co/x' ELSE '' END""")
    domain = F.expr("""
        CASE doc_id % 9 WHEN 0 THEN 'gmail.com' WHEN 1 THEN 'yahoo.com' WHEN 2 THEN 'acme.com' WHEN 3 THEN 'acm3.com'
        ELSE concat('corp', doc_id % 5, '.example.com') END""")
    joined = d.join(F.broadcast(p), F.expr("page_id = doc_id % 50"), "left").join(lab, F.col("doc_id") == F.col("l_id"), "left")
    return joined.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("user"), F.expr("doc_id % 37"), F.lit("@"), domain).alias("sender_email"),
        F.expr("left(split_part(text, '\n', 1), 120)").alias("subject"),
        F.concat("text", cue, link).alias("body"),
        F.expr("cast(doc_id % 7 < 5 as int)").alias("urls"),
        F.expr("CASE WHEN l_id IS NULL THEN NULL WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END").alias("label"),
        F.expr("CASE WHEN doc_id % 11 <> 0 THEN timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(doc_id as int), 0, 0) END").alias("msg_date"),
        F.lit("2024-03-01").cast("timestamp").alias("created_at"),
        F.expr("to_json(named_struct('urgency_hits', doc_id % 4, 'link_count', doc_id % 3))").alias("indicators_json"),
        F.col("source").alias("created_by"),
        F.array("lang", cue_name).alias("emotions"),
    )


#: (at, name, type, text, error) of answers to lookups.
ANSWER = "at long, name string, type string, text string, error string"


def dns_answers(spark: SparkSession) -> DataFrame:
    """What a resolver answered on the names of the sender domains; a table that stands for live lookups."""
    spf, mx = "v=spf1 include:_spf.example.com -all", "10 mx.example.com"
    rows = [("gmail.com", "MX", mx), ("gmail.com", "TXT", spf), ("_dmarc.gmail.com", "TXT", "v=DMARC1; p=none"), ("yahoo.com", "MX", mx), ("yahoo.com", "TXT", spf), ("_dmarc.yahoo.com", "TXT", "v=DMARC1; p=reject"), ("acme.com", "MX", mx), ("acme.com", "TXT", spf)]
    for k in range(5):
        name = f"corp{k}.example.com"
        rows += [(name, "MX", mx)] * (k != 0) + [(name, "TXT", spf if k % 2 == 0 else "site-verification=1")] + [(f"_dmarc.{name}", "TXT", "v=DMARC1; p=quarantine")] * (k > 2)
    none = [(name, kind, None, "NXDOMAIN") for name, kind in (("acm3.com", "MX"), ("acm3.com", "TXT"), ("_dmarc.acm3.com", "TXT"), ("corp0.example.com", "MX"))]
    return spark.createDataFrame([(at, *(*r, None)[:4]) for at, r in enumerate([*rows, *none])], ANSWER)


def dns_facts(answers: DataFrame) -> DataFrame:
    """(domain, has_mx, spf_present, dmarc_present, dmarc_policy) of answers (at, name, type, text, error).

    A lookup that failed found nothing; a domain with failures only has none of the three. SPF is an
    own TXT record that begins with v=spf1, DMARC one of the name _dmarc. before the domain that begins with
    v=dmarc1, in either case; the first such record by at names the policy, none where it has no p=.
    """
    name, text = F.lower("name"), F.coalesce("text", F.lit(""))
    below = name.startswith("_dmarc.")
    ok, txt = F.col("error").isNull(), F.col("type") == "TXT"
    dmarc = ok & txt & below & F.lower(text).startswith("v=dmarc1")
    parts = F.filter(F.transform(F.split(F.col("first"), ";"), X.strip), lambda p: p.startswith("p="))
    policy = F.nullif(F.substring(F.get(parts, F.lit(0)), 3, 1 << 30), F.lit(""))
    rows = answers.select(
        F.when(below, F.substring(name, 8, 1 << 30)).otherwise(name).alias("domain"), (ok & (F.col("type") == "MX") & ~below).alias("mx"),
        (ok & txt & ~below & F.lower(text).startswith("v=spf1")).alias("spf"), dmarc.alias("dmarc"), F.when(dmarc, F.col("at")).alias("at"), F.when(dmarc, text).alias("text"),
    )
    facts = rows.groupBy("domain").agg(F.bool_or("mx").alias("has_mx"), F.bool_or("spf").alias("spf_present"), F.bool_or("dmarc").alias("dmarc_present"), F.min_by("text", "at").alias("first"))
    return facts.select("domain", "has_mx", "spf_present", "dmarc_present", F.coalesce(policy, F.lit("none")).alias("dmarc_policy"))


def read_csv(spark: SparkSession, path: str, schema: str = CSV_SCHEMA, multi_line: bool = True) -> DataFrame:
    """A headed CSV corpus with quoted line breaks."""
    return spark.read.schema(schema).option("header", True).option("multiLine", multi_line).option("quote", '"').option("escape", '"').csv(path)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines corpus; malformed lines go. Type becomes the label, creators and emotions get defaults."""
    raw = spark.read.schema(JSONL_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    return raw.select(
        F.coalesce("Subject", F.lit("")).alias("subject"), F.coalesce("Body", F.lit("")).alias("body"), F.coalesce("Sender", F.lit("")).alias("sender"),
        F.col("Type").isin("Phishing", "Spam", "Phishing Simulation").cast("int").alias("label"),
        F.coalesce(F.col("Created by"), F.lit("Unknown")).alias("created_by"),
        F.coalesce(F.col("LLM detected emotion"), F.array().cast("array<string>")).alias("emotions"), F.coalesce("Source", F.lit("")).alias("source"),
    )


def read_tolerant(spark: SparkSession, path: str, schema: str = CSV_SCHEMA, limit: int | None = None) -> DataFrame:
    """A headed CSV corpus whose bytes may be no UTF-8: such characters go. The limit, where given, is the number of rows that are asked for."""
    rows = without_bad_bytes(read_csv(spark, path, schema))
    return rows if limit is None else rows.limit(limit)


def without_bad_bytes(rows: DataFrame) -> DataFrame:
    """The text columns without the characters that stand for bytes which are no UTF-8."""
    return rows.select(*(F.translate(c, "\ufffd", "").alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes))


def browser_rows(lines: DataFrame, header: str) -> DataFrame:
    """(sender, receiver, subject, body, url) of CSV lines (value), each a row of its own, that have sender, subject and body.

    Short rows count as filled up with empty fields; sender_email goes before sender where the
    header has it; the url flag is "1" or a link in the body.
    """
    names = [h.strip().lower() for h in header.rstrip("\r").split(",")]
    fields = lines.filter(F.trim("value") != "").select(X.csv_fields(F.rtrim("value", F.lit("\r"))).alias("f"))

    def field(name: str) -> Column:
        return X.strip(F.coalesce(F.get("f", F.lit(names.index(name))), F.lit(""))) if name in names else F.lit("")

    rows = fields.select(field("sender_email" if "sender_email" in names else "sender").alias("sender"), *(field(n).alias(n) for n in ("receiver", "subject", "body", "url")))
    flag = (F.col("url") == "1") | F.col("body").rlike(X.URL_UI)
    return rows.filter("sender <> '' and subject <> '' and body <> ''").withColumn("url", flag.cast("int")).withColumn("receiver", F.nullif("receiver", F.lit("")))


def read_browser_csv(spark: SparkSession, path: str) -> DataFrame:
    """browser_rows() of one file; its first line that is not blank is the header."""
    lines = spark.read.option("lineSep", "\n").text(path).withColumn("at", F.monotonically_increasing_id()).filter(F.trim("value") != "")
    first = lines.orderBy("at").limit(1).first()
    return browser_rows(lines.filter(F.col("at") != (first["at"] if first else -1)), first["value"] if first else "")


def read_json_object(spark: SparkSession, path: str) -> dict:
    """A JSON object, such as a manifest, from any store; {} where there is none."""
    try:
        rows = spark.read.text(path, wholetext=True).limit(1).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    return json.loads(rows[0]["value"]) if rows else {}


MESSAGE_TYPES = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("sender_email", T.StringType()), T.StructField("subject", T.StringType()),
    T.StructField("body", T.StringType()), T.StructField("urls", T.IntegerType()), T.StructField("label", T.IntegerType()),
])
