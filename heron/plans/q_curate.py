"""Queries on deduplication, manifests and quality of a corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from heron.operators import cleaning as C, curate
from heron.plans import oracle_base as B
from heron.operators.vectors import contamination
from heron.plans.book import query
from heron.plans.q_vectors import V, knn_sql
from heron.plans.session import table
from heron.plans.views import vectors

D = "d AS (SELECT doc_id AS id, text, lang, source, n_chars, sha256(text) AS h FROM documents)"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source", "n_chars", F.sha2("text", 256).alias("h"))


@query("union_all", "SELECT doc_id AS id, text, lang FROM documents UNION ALL SELECT item_id, text, NULL FROM benchmark")
def union_all(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    return d.unionByName(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"), allowMissingColumns=True)


@query("except_rows", "SELECT vec_id AS id FROM embeddings WHERE label <> 3")
def except_rows(spark, sf_dir):
    v = vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "label")
    return v.join(v.filter("label = 3").select("id"), "id", "left_anti").select("id")


@query("distinct_values", "SELECT DISTINCT lang, source FROM documents")
def distinct_values(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("lang", "source").distinct()


@query("exact_dedup", f"WITH {D} SELECT min(id) AS id, h FROM d GROUP BY h")
def exact_dedup(spark, sf_dir):
    return curate.exact_dedup(_docs(spark, sf_dir).select("id", "h"), "h", "id")


def _unique(spark, sf_dir):
    """Documents without exact copies, as the near-duplicate stage takes them."""
    return curate.first_copies(_docs(spark, sf_dir), "h", "id")


_STOP = ", ".join(f"'{w}'" for w in curate.STOP_WORDS)
_NEAR = f"""{D}, u AS MATERIALIZED (SELECT id, text FROM d QUALIFY row_number() OVER (PARTITION BY h ORDER BY id) = 1),
t AS (SELECT id, [w for w in regexp_extract_all(lower(text), '\\w\\w+') if w NOT IN ({_STOP})] AS ws FROM u),
g AS (SELECT id, unnest(ws) AS term FROM t UNION ALL SELECT id, unnest([array_to_string(ws[i:i + 1], ' ') for i in range(1, len(ws))]) FROM t UNION ALL SELECT id, unnest([array_to_string(ws[i:i + 2], ' ') for i in range(1, len(ws) - 1)]) FROM t),
tf AS MATERIALIZED (SELECT id, term, count(*) AS tf FROM g GROUP BY id, term), top AS (SELECT term, count(*) AS df, sum(tf) AS al FROM tf GROUP BY term ORDER BY al DESC, term LIMIT 5000),
w0 AS (SELECT id, tf.term, tf * (ln((1.0 + (SELECT count(*) FROM u)) / (1.0 + df)) + 1.0) AS w FROM tf JOIN top ON tf.term = top.term), nn AS (SELECT id, sqrt(sum(w * w)) AS norm FROM w0 GROUP BY id),
w AS MATERIALIZED (SELECT w0.id, term, w / norm AS w FROM w0 JOIN nn ON w0.id = nn.id), every AS MATERIALIZED (SELECT a.id AS i, b.id AS j, sum(a.w * b.w) AS s FROM w a JOIN w b ON a.term = b.term AND a.id < b.id GROUP BY a.id, b.id),
sg AS (SELECT tf.id, string_agg(tf.term || '=' || tf, ';' ORDER BY tf.term) AS sg FROM tf JOIN top ON tf.term = top.term GROUP BY tf.id), fi AS (SELECT id, min(id) OVER (PARTITION BY sg) AS first FROM sg),
pr AS (SELECT i, j, s FROM every WHERE i IN (SELECT first FROM fi) AND j IN (SELECT first FROM fi) UNION ALL SELECT first, id, 1.0 FROM fi WHERE id <> first)"""


@query("near_dedup_pairs", f"WITH {_NEAR} SELECT i, j, round(s, 6) AS similarity FROM pr WHERE s >= 0.85")
def near_dedup_pairs(spark, sf_dir):
    """Pairs of documents with a TF-IDF cosine of 0.85 or more; of documents with equal vectors the first stands for the rest, which are paired with it alone."""
    pairs = curate.near_pairs(_unique(spark, sf_dir))
    return pairs.select("i", "j", F.round("similarity", 6).alias("similarity"))


#: The greedy rule in the order of the ids over all pairs, one row with partners at a time.
_KEEP = f"""{_NEAR.replace("d AS (", "RECURSIVE d AS (", 1)}, n AS MATERIALIZED (SELECT i, list(j) AS js, row_number() OVER (ORDER BY i) AS k FROM every WHERE s >= 0.85 GROUP BY i),
st AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS gone UNION ALL SELECT n.k, CASE WHEN list_contains(st.gone, n.i) THEN st.gone ELSE list_distinct(list_concat(st.gone, n.js)) END FROM st JOIN n ON n.k = st.k + 1),
kept AS (SELECT u.id, NOT list_contains((SELECT gone FROM st ORDER BY k DESC LIMIT 1), u.id) AS kept FROM u)"""


@query("near_dedup", f"WITH {_KEEP} SELECT id, kept FROM kept")
def near_dedup(spark, sf_dir):
    return curate.near_dedup(_unique(spark, sf_dir))


def _stages(spark, sf_dir):
    d = _docs(spark, sf_dir)
    kept = exact_dedup(spark, sf_dir).select("id", F.lit(True).alias("e"))
    near = near_dedup(spark, sf_dir).select("id", "kept")
    return d.join(kept, "id", "left").join(near, "id", "left").withColumns({"exact_kept": F.coalesce("e", F.lit(False)), "near_kept": F.coalesce("kept", F.lit(True))})


def _report_sql(by):
    return f"""WITH {_KEEP}, f AS (SELECT d.{by}, d.id = min(d.id) OVER (PARTITION BY h) AS e, coalesce(kept.kept, true) AS k FROM d LEFT JOIN kept ON kept.id = d.id)
SELECT {by}, count(*) AS initial, CAST(sum(CAST(NOT e AS INT)) AS BIGINT) AS exact_duplicates, CAST(sum(CAST(e AND NOT k AS INT)) AS BIGINT) AS near_duplicates, CAST(sum(CAST(e AND k AS INT)) AS BIGINT) AS final, round(avg(CAST(e AND k AS INT)), 6) AS retention FROM f GROUP BY {by}"""


@query("dedup_report", _report_sql("lang"))
def dedup_report(spark, sf_dir):
    return curate.dedup_report(_stages(spark, sf_dir), "lang")


@query("dedup_report_by_model", _report_sql("source"))
def dedup_report_by_model(spark, sf_dir):
    """The same by what made the rows."""
    return curate.dedup_report(_stages(spark, sf_dir), "source")


@query("exact_dedup_report", f"WITH {D}, f AS (SELECT lang, id = min(id) OVER (PARTITION BY h) AS kept FROM d) SELECT lang, count(*) AS initial, CAST(sum(CAST(NOT kept AS INT)) AS BIGINT) AS exact_duplicates, CAST(sum(CAST(kept AS INT)) AS BIGINT) AS final, round(avg(CAST(kept AS INT)), 6) AS retention FROM f GROUP BY lang")
def exact_dedup_report(spark, sf_dir):
    d = _docs(spark, sf_dir).select("id", "lang", "h")
    first = d.groupBy("h").agg(F.min("id").alias("id")).select("id", F.lit(True).alias("e"))
    rows = d.join(first, "id", "left").withColumns({"exact_kept": F.coalesce("e", F.lit(False)), "near_kept": F.lit(True)})
    return curate.dedup_report(rows, "lang").drop("near_duplicates")


_REASONS = """list_filter([CASE WHEN NOT regexp_matches(body, '(?i)https?://') THEN 'missing_url' END, CASE WHEN length(body) < 300 THEN 'body_too_short_' || length(body) END, CASE WHEN length(body) > 3000 THEN 'body_too_long_' || length(body) END,
 CASE WHEN length(subject) < 10 THEN 'subject_too_short_' || length(subject) END, CASE WHEN length(subject) > 110 THEN 'subject_too_long_' || length(subject) END, CASE WHEN NOT (contains(lower(body), 'account') OR contains(lower(body), 'password') OR contains(lower(body), 'login')) THEN 'missing_category_keywords' END], lambda x: x IS NOT NULL)"""


@query("quality_filter", f"WITH {B.MESSAGES}, q AS (SELECT id, {_REASONS} AS r FROM m) SELECT id, len(r) = 0 AS accepted, array_to_string(r, '|') AS reasons FROM q")
def quality_filter(spark, sf_dir):
    from heron.sources.messages import messages

    r = C.rejection_reasons(F.col("subject"), F.col("body"), 300, 3000, 10, 110, keywords=["account", "password", "login"])
    return messages(spark, sf_dir).select("id", r.alias("r")).select("id", (F.size("r") == 0).alias("accepted"), F.array_join("r", "|").alias("reasons"))


@query("manifest_stats", """SELECT count(*) AS n, CAST(min(n_chars) AS BIGINT) AS min, CAST(max(n_chars) AS BIGINT) AS max, round(avg(n_chars), 6) AS mean, round(median(n_chars), 6) AS median, round(stddev_samp(n_chars), 6) AS std,
 round(100.0 * count(lang) / count(*), 6) AS lang_pct, round(100.0 * count(source) / count(*), 6) AS source_pct, round(100.0 * avg(CAST(regexp_matches(text, '(?i)https?://') AS INT)), 6) AS url_pct FROM documents""")
def manifest_stats(spark, sf_dir):
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").agg(
        F.count("*").alias("n"), F.min(n).alias("min"), F.max(n).alias("max"), F.round(F.avg(n), 6).alias("mean"), F.round(F.median(n), 6).alias("median"), F.round(F.stddev_samp(n), 6).alias("std"),
        F.round(100.0 * F.count("lang") / F.count("*"), 6).alias("lang_pct"), F.round(100.0 * F.count("source") / F.count("*"), 6).alias("source_pct"),
        F.round(100.0 * F.avg(F.col("text").rlike("(?i)https?://").cast("int")), 6).alias("url_pct"),
    )


_LANGS = ["de", "en", "es", "fr"]


@query("category_model_crosstab", "SELECT source, " + ", ".join(f"CAST(sum(CAST(lang = '{x}' AS INT)) AS BIGINT) AS {x}" for x in _LANGS) + " FROM documents GROUP BY source")
def category_model_crosstab(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").pivot("lang", _LANGS).count().fillna(0)


@query("diversity_metrics", f"WITH {D}, s AS (SELECT left(split_part(text, chr(10), 1), 120) AS subject, h, n_chars AS n FROM d) SELECT count(DISTINCT subject) AS subjects, round(100.0 * count(DISTINCT subject) / count(*), 6) AS subject_pct, count(DISTINCT h) AS hashes, round(100.0 * count(DISTINCT h) / count(*), 6) AS hash_pct, " + ", ".join(f"CAST(sum(CAST(n > {a} AND n <= {b} AS INT)) AS BIGINT) AS bin_{b}" for a, b in ((-1, 250), (250, 450), (450, 700), (700, 10000))) + " FROM s")
def diversity_metrics(spark, sf_dir):
    """Distinct subjects and texts, and right-closed length bins; lengths beyond the last bin are in none."""
    subject, n = F.left(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit(120)), F.col("n_chars")
    bins = ((-1, 250), (250, 450), (450, 700), (700, 10000))
    return _docs(spark, sf_dir).withColumn("subject", subject).agg(
        F.countDistinct("subject").alias("subjects"), F.round(100.0 * F.countDistinct("subject") / F.count("*"), 6).alias("subject_pct"),
        F.countDistinct("h").alias("hashes"), F.round(100.0 * F.countDistinct("h") / F.count("*"), 6).alias("hash_pct"), *(F.count_if((n > a) & (n <= b)).alias(f"bin_{b}") for a, b in bins),
    )


_CLEAN = knn_sql("q.label = 1", "c.label = 0", 1, "cosine")


@query("manifest_validation", f"WITH {D}, {V}, {_CLEAN}, s AS (SELECT 100.0 * avg(CAST(regexp_matches(text, '(?i)https?://') AS INT)) AS url, 100.0 * count(lang) / count(*) AS prov, 100.0 * count(DISTINCT left(split_part(text, chr(10), 1), 120)) / count(*) AS subj FROM d), c AS (SELECT coalesce(avg(CAST(similarity >= 0.9 AS INT)), 0) AS rate FROM nn) SELECT url >= 90 AS url_ok, prov >= 95 AS provenance_ok, subj >= 80 AS subjects_ok, rate < 0.05 AS contamination_ok FROM s, c")
def manifest_validation(spark, sf_dir):
    m = manifest_stats(spark, sf_dir).select("url_pct", "lang_pct", "source_pct")
    v = diversity_metrics(spark, sf_dir).select("subject_pct")
    e = vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "v", "label")
    rate = contamination(e.filter("label = 1"), e.filter("label = 0")).agg(F.coalesce(F.avg(F.col("flagged").cast("int")), F.lit(0.0)).alias("rate"))
    # One row of each.
    return m.crossJoin(v).crossJoin(rate).select(
        (F.col("url_pct") >= 90).alias("url_ok"), (F.least("lang_pct", "source_pct") >= 95).alias("provenance_ok"), (F.col("subject_pct") >= 80).alias("subjects_ok"), (F.col("rate") < 0.05).alias("contamination_ok")
    )


_SHARES = "(SELECT string_agg('- ' || source || ': ' || n || ' samples (' || printf('%.1f', 100.0 * n / t) || '%)', chr(10) ORDER BY n DESC, source) FROM (SELECT source, count(*) AS n, sum(count(*)) OVER () AS t FROM documents GROUP BY source))"


@query("manifest_card", f"""WITH {D}, s AS (SELECT count(*) AS n, count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs, string_agg(DISTINCT lang, ', ' ORDER BY lang) AS names, 100.0 * avg(CAST(regexp_matches(text, '(?i)https?://') AS INT)) AS url, 100.0 * count(DISTINCT left(split_part(text, chr(10), 1), 120)) / count(*) AS subj, count(*) - count(DISTINCT h) AS copies FROM d)
SELECT '# Corpus card' || chr(10) || 'Version: v1.0' || chr(10) || 'License: MIT' || chr(10) || chr(10) || '## Statistics' || chr(10) || 'Rows: ' || n || chr(10) || 'Sources: ' || sources || chr(10) || 'Categories: ' || langs || ' (' || names || ')' || chr(10) || 'With URL: ' || printf('%.1f', url) || '%' || chr(10)
 || 'Unique subjects: ' || printf('%.1f', subj) || '%' || chr(10) || chr(10) || '## By source' || chr(10) || {_SHARES} || chr(10) || chr(10) || '## Deduplication' || chr(10) || 'Exact copies removed: ' || copies || chr(10) || 'Near-duplicate threshold: 0.85' AS card FROM s""")
def manifest_card(spark, sf_dir):
    """The filled template of a dataset card, from a manifest of a few values."""
    d = _docs(spark, sf_dir)
    subject = F.left(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit(120))
    one = d.agg(
        F.count("*").alias("rows"), F.countDistinct("source").alias("sources"), F.array_sort(F.collect_set("lang")).alias("categories"), (100.0 * F.avg(F.col("text").rlike("(?i)https?://").cast("int"))).alias("url"),
        (100.0 * F.countDistinct(subject) / F.count("*")).alias("subjects"), (F.count("*") - F.countDistinct("h")).alias("copies"),
    ).first()
    by_source = d.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").collect()
    return spark.createDataFrame([(curate.card(one.asDict(), [(r["source"], r["n"]) for r in by_source]),)], "card string")
