"""Dashboard queries: totals, distributions, histograms, series, samples."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heron.functions import text as X
from heron.operators.cleaning import integer
from heron.operators.ranks import quantiles
from heron.plans import oracle_base as B
from heron.plans.book import query
from heron.plans.session import table
from heron.plans.views import scored, vectors
from heron.sources.messages import messages

M = f"WITH {B.MESSAGES}"


@query("overview_totals", f"""{M}, e AS (SELECT m.*, v.vec_id FROM m LEFT JOIN embeddings v ON v.vec_id = m.id)
SELECT count(*) AS total, CAST(sum(CAST(label = 1 AS INT)) AS BIGINT) AS label_1, CAST(sum(CAST(label = 0 AS INT)) AS BIGINT) AS label_0, CAST(sum(CAST(label IS NULL AS INT)) AS BIGINT) AS unlabeled,
 CAST(sum(CAST(urls = 1 AS INT)) AS BIGINT) AS urls_1, count(vec_id) AS doc_emb, round(100.0 * sum(CAST(urls = 1 AS INT)) / count(*), 6) AS pct_with_url FROM e""")
def overview_totals(spark, sf_dir):
    v = vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.lit(1).alias("has"))
    rows = messages(spark, sf_dir).select("id", "label", "urls").join(v, "id", "left")
    with_url = F.count_if(F.col("urls") == 1)
    return rows.agg(
        F.count("*").alias("total"), F.count_if(F.col("label") == 1).alias("label_1"), F.count_if(F.col("label") == 0).alias("label_0"), F.count_if(F.col("label").isNull()).alias("unlabeled"),
        with_url.alias("urls_1"), F.count("has").alias("doc_emb"), F.round(100.0 * with_url / F.count("*"), 6).alias("pct_with_url"),
    )


def top_domains(df, n):
    d = df.select(X.domain_first(F.col("sender_email")).alias("sender_domain")).filter("sender_domain is not null and sender_domain <> ''")
    return d.groupBy("sender_domain").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "sender_domain").limit(n)


_DOMAINS = "SELECT lower(split_part(sender_email, '@', 2)) AS sender_domain, count(*) AS n FROM m GROUP BY 1 HAVING sender_domain <> '' ORDER BY n DESC, sender_domain LIMIT"


@query("top_sender_domains", f"{M} {_DOMAINS} 5")
def top_sender_domains(spark, sf_dir):
    return top_domains(messages(spark, sf_dir), 5)


_PCT = ", ".join(f"round(quantile_cont(length({c}), {p}) FILTER ({c} IS NOT NULL AND trim({c}) <> ''), 6) AS {c}_p{int(p * 100)}" for c in ("subject", "body") for p in (0.25, 0.5, 0.75))


@query("length_percentiles", f"{M} SELECT {_PCT} FROM m")
def length_percentiles(spark, sf_dir):
    """Six percentiles in one pass."""
    def one(c, p):
        return F.round(F.percentile(F.when(F.trim(c) != "", F.length(c)), F.lit(p)), 6).alias(f"{c}_p{int(p * 100)}")

    return messages(spark, sf_dir).agg(*(one(c, p) for c in ("subject", "body") for p in (0.25, 0.5, 0.75)))


@query("length_stats_nearest", f"""{M}, l AS (SELECT length(body) AS n, row_number() OVER (ORDER BY length(body)) - 1 AS i, count(*) OVER () AS c FROM m)
SELECT CAST(min(n) AS INT) AS min, CAST(max(CASE WHEN i = CAST(floor(0.25 * (c - 1)) AS BIGINT) THEN n END) AS INT) AS p25, round(avg(n), 6) AS mean, CAST(max(CASE WHEN i = CAST(floor(0.75 * (c - 1)) AS BIGINT) THEN n END) AS INT) AS p75, CAST(max(n) AS INT) AS max FROM l""")
def length_stats_nearest(spark, sf_dir):
    """Values at the positions int(q * (n - 1)) of the sorted lengths: from the lengths' counts, not from a sort of all rows."""
    counts = messages(spark, sf_dir).groupBy(F.length("body").alias("n")).agg(F.count("*").alias("c"))
    # One row for each distinct length.
    upto = counts.withColumn("below", F.coalesce(F.sum("c").over(W.orderBy("n").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("c").over(W.partitionBy()))

    def at(q):
        k = F.floor(F.lit(q) * (F.col("total") - 1))
        return F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("c")), F.col("n")))

    return upto.agg(F.min("n").alias("min"), at(0.25).alias("p25"), F.round(F.sum(F.col("n") * F.col("c")) / F.sum("c"), 6).alias("mean"), at(0.75).alias("p75"), F.max("n").alias("max"))


@query("length_stats_linear", f"{M} SELECT round(avg(n), 6) AS mean, round(quantile_cont(n, 0.25), 6) AS p25, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.75), 6) AS p75, CAST(max(n) AS INT) AS max FROM (SELECT length(coalesce(subject, '')) AS n FROM m)")
def length_stats_linear(spark, sf_dir):
    n = F.length(F.coalesce("subject", F.lit("")))
    return messages(spark, sf_dir).agg(F.round(F.avg(n), 6).alias("mean"), *(F.round(F.percentile(n, F.lit(p)), 6).alias(a) for p, a in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))), F.max(n).alias("max"))


_COLS = ["sender_email", "subject", "body", "urls", "label", "msg_date"]


@query("missing_per_column", f"{M} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST(sum(CAST({c} IS NULL OR CAST({c} AS VARCHAR) = '' AS INT)) AS BIGINT) AS missing FROM m" for c in _COLS))
def missing_per_column(spark, sf_dir):
    one = messages(spark, sf_dir).agg(*(F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(c) for c in _COLS))
    return one.unpivot([], _COLS, "column_name", "missing")


@query("label_distribution", f"{M} SELECT coalesce(CAST(label AS VARCHAR), 'missing') AS label, count(*) AS n FROM m GROUP BY 1")
def label_distribution(spark, sf_dir):
    return messages(spark, sf_dir).groupBy(F.coalesce(F.col("label").cast("string"), F.lit("missing")).alias("label")).agg(F.count("*").alias("n"))


@query("url_flag_distribution", f"{M} SELECT CASE WHEN urls IN (0, 1) THEN CAST(urls AS VARCHAR) WHEN urls IS NULL THEN 'missing' ELSE 'invalid' END AS url_flag, count(*) AS n FROM m GROUP BY 1")
def url_flag_distribution(spark, sf_dir):
    flag = F.when(F.col("urls").isin(0, 1), F.col("urls").cast("string")).when(F.col("urls").isNull(), "missing").otherwise("invalid")
    return messages(spark, sf_dir).groupBy(flag.alias("url_flag")).agg(F.count("*").alias("n"))


#: Cue words of the corpus report; fixed values, other than those of the rules.
URGENCY_CUES = ["urgent", "verify your account", "password", "suspend", "update"]
CREDENTIAL_CUES = ["password", "login", "ssn", "credit card", "bank account"]


@query("content_cue_counts", f"{M}, t AS (SELECT lower(subject || chr(10) || body) AS t FROM m) SELECT CAST(sum(CAST({B.any_of('t', URGENCY_CUES)} AS INT)) AS BIGINT) AS urgency_hits, CAST(sum(CAST({B.any_of('t', CREDENTIAL_CUES)} AS INT)) AS BIGINT) AS creds_hits FROM t")
def content_cue_counts(spark, sf_dir):
    from heron.operators.rules import any_of

    t = F.lower(F.concat("subject", F.lit("\n"), "body"))
    return messages(spark, sf_dir).select(t.alias("t")).agg(F.count_if(any_of(F.col("t"), URGENCY_CUES)).alias("urgency_hits"), F.count_if(any_of(F.col("t"), CREDENTIAL_CUES)).alias("creds_hits"))


@query("timeseries_daily", f"{M} SELECT CAST(coalesce(msg_date, created_at) AS DATE) AS d, count(*) AS total, CAST(sum(CAST(label IS NOT NULL AND label = 1 AS INT)) AS BIGINT) AS phish, CAST(sum(CAST(label IS NOT NULL AND label = 0 AS INT)) AS BIGINT) AS benign FROM m GROUP BY 1")
def timeseries_daily(spark, sf_dir):
    day = F.to_date(F.coalesce("msg_date", "created_at"))
    return messages(spark, sf_dir).groupBy(day.alias("d")).agg(F.count("*").alias("total"), F.count_if(F.col("label") == 1).alias("phish"), F.count_if(F.col("label") == 0).alias("benign")).orderBy("d")


def _bucket(c, top):
    return f"CASE WHEN length({c}) >= {top} THEN 13 ELSE CAST(floor(length({c}) * 12.0 / {top}) AS INT) + 1 END"


@query("length_hist", f"{M} SELECT 'subject' AS part, CAST({_bucket('subject', 240)} AS BIGINT) AS bucket, count(*) AS n FROM m WHERE subject <> '' GROUP BY 2 UNION ALL SELECT 'body', CAST({_bucket('body', 3000)} AS BIGINT), count(*) FROM m WHERE body <> '' GROUP BY 2")
def length_hist(spark, sf_dir):
    """Both histograms in one pass."""
    m = messages(spark, sf_dir)
    parts = F.array(F.struct(F.lit("subject").alias("part"), F.length("subject").alias("n"), F.lit(240).alias("top")), F.struct(F.lit("body").alias("part"), F.length("body").alias("n"), F.lit(3000).alias("top")))
    rows = m.select(F.explode(parts).alias("x")).filter("x.n > 0")
    return rows.groupBy("x.part", F.width_bucket("x.n", F.lit(0), F.col("x.top"), F.lit(12)).alias("bucket")).agg(F.count("*").alias("n"))


@query("ugly_ranked", f"""{M} SELECT id, subject, left(body, 800) AS body, round(urgency_hits * 2 + link_count + 1.5 * (1 - least(1.0, greatest(0.0, length(subject) / 120.0))), 6) AS ugliness FROM m WHERE label = 1
ORDER BY urgency_hits * 2 + link_count + 1.5 * (1 - least(1.0, greatest(0.0, length(subject) / 120.0))) DESC, id DESC LIMIT 10""")
def ugly_ranked(spark, sf_dir, limit: int = 10):
    """The report's top rows; the limit is held between 1 and 50."""
    def field(name):
        return integer(F.get_json_object("indicators_json", f"$.{name}"))

    short = 1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.length("subject") / 120.0))
    rank = field("urgency_hits") * 2 + field("link_count") + 1.5 * short
    rows = messages(spark, sf_dir).filter("label = 1").select("id", "subject", F.left("body", F.lit(800)).alias("body"), rank.alias("r"))
    return rows.orderBy(F.desc("r"), F.desc("id")).limit(min(50, max(1, limit))).select("id", "subject", "body", F.round("r", 6).alias("ugliness"))


def by_hash(seed: int, c="id"):
    """A reproducible random order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(c).cast("string")))


@query("random_examples", f"{M}, top AS ({_DOMAINS} 10) SELECT id, sender_email, left(body, 1200) AS body, coalesce(msg_date, created_at) AS ts FROM m WHERE lower(split_part(sender_email, '@', 2)) IN (SELECT sender_domain FROM top) ORDER BY md5('7:' || id), id LIMIT 20")
def random_examples(spark, sf_dir, limit: int = 20, seed: int = 7):
    """A sample from the ten most frequent domains, by semi-join, or from all rows where there is no domain; the limit is held between 1 and 100."""
    m = messages(spark, sf_dir).withColumn("sender_domain", X.domain_first(F.col("sender_email")))
    top = top_domains(m, 10).select("sender_domain")
    some = m if top.isEmpty() else m.join(top, "sender_domain", "left_semi")
    return some.orderBy(by_hash(seed), "id").limit(min(100, max(1, limit))).select("id", "sender_email", F.left("body", F.lit(1200)).alias("body"), F.coalesce("msg_date", "created_at").alias("ts"))


def stratified(df, limit: int, seed: int = 13):
    """max(1, limit // 2) positives and the rest negatives, each the first by hash; a sampling operator, so the limit is its feature."""
    half = max(1, limit // 2)
    pos = df.filter("label = 1").orderBy(by_hash(seed), "id").limit(half)
    return pos.unionByName(df.filter("label = 0").orderBy(by_hash(seed), "id").limit(max(0, limit - half)))


@query("stratified_sample", f"{M} SELECT id, label FROM (SELECT id, label FROM m WHERE label = 1 ORDER BY md5('13:' || id), id LIMIT 30) UNION ALL SELECT id, label FROM (SELECT id, label FROM m WHERE label = 0 ORDER BY md5('13:' || id), id LIMIT 31)")
def stratified_sample(spark, sf_dir):
    return stratified(messages(spark, sf_dir).select("id", "label"), 61)


@query("fixed_sample", f"{M} SELECT id FROM m ORDER BY md5('42:' || id), id LIMIT 50")
def fixed_sample(spark, sf_dir):
    return messages(spark, sf_dir).select("id").orderBy(by_hash(42), "id").limit(50)


@query("history_stats", f"WITH {B.phase1(True)} SELECT count(*) AS total, CAST(sum(CAST(coalesce(label = 1, verdict = 'phishing') AS INT)) AS BIGINT) AS phish, CAST(sum(CAST(NOT coalesce(label = 1, verdict = 'phishing') AS INT)) AS BIGINT) AS benign FROM p1")
def history_stats(spark, sf_dir):
    bad = F.coalesce(F.col("label") == 1, F.col("verdict") == "phishing")
    return scored(spark, sf_dir, dns=True).agg(F.count("*").alias("total"), F.count_if(bad).alias("phish"), F.count_if(~bad).alias("benign"))


@query("history_pages", f"{M}, h AS (SELECT id, row_number() OVER (ORDER BY coalesce(msg_date, created_at) DESC, id DESC) - 1 AS k FROM m QUALIFY k < 500) SELECT CAST(k // 4 AS INT) AS page, list(id ORDER BY k) AS ids FROM h GROUP BY 1")
def history_pages(spark, sf_dir, size: int = 4):
    """The history's newest rows in pages of four."""
    newest = history_newest(spark, sf_dir)
    # At most 500 rows.
    k = newest.withColumn("k", F.row_number().over(W.orderBy(F.desc("saved_at"), F.desc("id"))) - 1)
    pages = k.groupBy(F.floor(F.col("k") / size).cast("int").alias("page")).agg(F.array_sort(F.collect_list(F.struct("k", "id"))).alias("x"))
    return pages.select("page", F.transform("x", lambda x: x["id"]).alias("ids"))


@query("head_rows", "SELECT doc_id AS id, lang FROM documents ORDER BY doc_id LIMIT 100")
def head_rows(spark, sf_dir, limit: int = 100):
    """The first rows in the order of the ids; the limit is the feature."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang").orderBy("id").limit(limit)


@query("history_newest", f"{M} SELECT id, coalesce(msg_date, created_at) AS saved_at FROM m ORDER BY 2 DESC, id DESC LIMIT 500")
def history_newest(spark, sf_dir):
    """The history's newest rows; its length is the feature."""
    return messages(spark, sf_dir).select("id", F.coalesce("msg_date", "created_at").alias("saved_at")).orderBy(F.desc("saved_at"), F.desc("id")).limit(500)


@query("event_series_daily", "SELECT CAST(ts AS DATE) AS d, event_type, count(*) AS n, round(sum(value), 4) AS total, CAST(sum(CAST(json_extract_string(props, '$.k') AS INT)) AS BIGINT) AS k_sum FROM events GROUP BY 1, 2")
def event_series_daily(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.to_date("ts").alias("d"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.sum(F.get_json_object("props", "$.k").cast("int")).alias("k_sum"))


_NUMERIC = ["id", "urls", "label"]
_DESCRIBE = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(quantile_cont({c}, 0.25) AS DOUBLE) AS p25, CAST(quantile_cont({c}, 0.5) AS DOUBLE) AS p50, CAST(quantile_cont({c}, 0.75) AS DOUBLE) AS p75, CAST(max({c}) AS DOUBLE) AS max FROM m" for c in _NUMERIC)


@query("numeric_describe", f"{M} {_DESCRIBE}")
def numeric_describe(spark, sf_dir):
    """Every numeric column described: moments in one pass, quantiles by rank."""
    rows = messages(spark, sf_dir).select(*_NUMERIC)
    one = rows.agg(*(F.struct(F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_samp(c), 6).alias("std"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")).alias(c) for c in _NUMERIC))
    at = {c: quantiles(rows, c, [0.25, 0.5, 0.75]) for c in _NUMERIC}
    each = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("x"), *(F.lit(q).cast("double").alias(n) for n, q in zip(("p25", "p50", "p75"), at[c], strict=True))) for c in _NUMERIC]
    return one.select(F.explode(F.array(*each)).alias("d")).select("d.column_name", "d.x.*", "d.p25", "d.p50", "d.p75")
