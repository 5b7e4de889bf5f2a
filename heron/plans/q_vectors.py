"""Queries on retrieval and fusion."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heron.functions import text as X
from heron.operators import ann, fusion
from heron.operators.ranks import quantiles
from heron.operators.vectors import contamination, nearest, similarity_stats
from heron.plans import oracle_base as B
from heron.plans.book import query
from heron.plans.session import cut, shared_dir
from heron.plans.views import vectors, with_attacks

V = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"


def knn_sql(queries: str, corpus: str, k: int, metric: str = "l2", name: str = "nn") -> str:
    s = "1 - sqrt(list_sum([(q.v[i] - c.v[i]) ** 2 for i in range(1, len(q.v) + 1)]))" if metric == "l2" else (
        "list_dot_product(q.v, c.v) / ((sqrt(list_dot_product(q.v, q.v)) + 1e-8) * (sqrt(list_dot_product(c.v, c.v)) + 1e-8))")
    return f"""{name}_s AS (SELECT q.id AS query_id, c.id, c.label, {s} AS similarity FROM v q JOIN v c ON q.id <> c.id AND {queries} AND {corpus}),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, id) AS rank FROM {name}_s) WHERE rank <= {k})"""


def _ids(df):
    return df.select(F.col("vec_id").alias("id"), "v", "label")


def phish_neighbors(spark, sf_dir, k=8):
    v = _ids(vectors(spark, sf_dir))
    return nearest(v.filter("label <> 1"), v.filter("label = 1"), k)


@query("knn_phish", f"WITH {V}, {knn_sql('q.label <> 1', 'c.label = 1', 8)} SELECT query_id, id, CAST(rank AS INT) AS rank, round(similarity, 6) AS similarity FROM nn")
def knn_phish(spark, sf_dir):
    return phish_neighbors(spark, sf_dir).select("query_id", "id", "rank", F.round("similarity", 6).alias("similarity"))


@query("knn_cosine", f"WITH {V}, {knn_sql('q.label <> 1', 'c.label = 1', 8, 'cosine')} SELECT query_id, id, CAST(rank AS INT) AS rank, round(similarity, 6) AS similarity FROM nn")
def knn_cosine(spark, sf_dir):
    v = _ids(vectors(spark, sf_dir))
    return nearest(v.filter("label <> 1"), v.filter("label = 1"), 8, "cosine").select("query_id", "id", "rank", F.round("similarity", 6).alias("similarity"))


def _approximate(spark, sf_dir):
    """Queries (every row whose id is divisible by 20) and what an index over all rows, written first, finds for them."""
    v = _ids(vectors(spark, sf_dir))
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    ann.build(v, path)
    queries = v.filter("id % 20 = 0")
    return queries, v, ann.search(spark, path, queries)


@query("knn_approximate")
def knn_approximate(spark, sf_dir):
    """Neighbours from the lists of an inverted-file index; which ones depends on the fitted centroids, so no SQL has them."""
    return _approximate(spark, sf_dir)[2].select("query_id", "id", "rank", F.round("similarity", 6).alias("similarity"))


@query("knn_approximate_recall", f"WITH {V}, {knn_sql('q.id % 20 = 0', 'true', 8)} SELECT count(*) AS expected, true AS reached FROM nn")
def knn_approximate_recall(spark, sf_dir):
    """Whether the index finds nine tenths of the exact neighbours, and how many those are."""
    queries, v, found = _approximate(spark, sf_dir)
    return ann.recall(found, nearest(queries, v, 8)).select("expected", (F.col("recall") >= 0.9).alias("reached"))


@query("knn_similar_endpoint", f"""WITH {V}, {B.MESSAGES}, {knn_sql('q.id = 1', 'true', 25)}
SELECT nn.id, CAST(rank AS INT) AS rank, round(similarity, 6) AS similarity, m.subject, left(m.body, 240) AS body_preview, m.label FROM nn JOIN m ON m.id = nn.id""")
def knn_similar_endpoint(spark, sf_dir, k: int = 25):
    """The neighbours of one row with a preview; k is held between 1 and 25, as the endpoint's feature."""
    from heron.sources.messages import messages

    v = _ids(vectors(spark, sf_dir))
    found = nearest(v.filter("id = 1"), v, min(25, max(1, k)))
    m = messages(spark, sf_dir).select("id", "subject", F.left("body", F.lit(240)).alias("body_preview"), "label")
    return found.join(m, "id").select("id", "rank", F.round("similarity", 6).alias("similarity"), "subject", "body_preview", "label")


@query("similarity_stats", f"""WITH {V}, {knn_sql('q.label <> 1', 'c.label = 1', 8)}
SELECT query_id, round(max(similarity), 6) AS top_sim, round(avg(CASE WHEN rank <= 3 THEN similarity END), 6) AS avg_top3, round(avg(similarity), 6) AS avg_all, CAST(count(*) AS INT) AS n_neighbors FROM nn GROUP BY query_id""")
def similarity_stats_query(spark, sf_dir):
    s = similarity_stats(phish_neighbors(spark, sf_dir))
    return s.select("query_id", *(F.round(c, 6).alias(c) for c in ("top_sim", "avg_top3", "avg_all")), "n_neighbors")


_CONT = f"{V}, {knn_sql('q.label = 1', 'c.label = 0', 1, 'cosine')}"


@query("contamination", f"WITH {_CONT} SELECT query_id AS id, id AS nearest_id, round(similarity, 6) AS max_similarity, similarity >= 0.25 AS flagged FROM nn")
def contamination_query(spark, sf_dir):
    v = _ids(vectors(spark, sf_dir))
    return contamination(v.filter("label = 1"), v.filter("label = 0"), 0.25).withColumn("max_similarity", F.round("max_similarity", 6))


@query("contamination_stats", f"""WITH {_CONT} SELECT round(min(similarity), 6) AS min, round(max(similarity), 6) AS max, round(avg(similarity), 6) AS mean, round(quantile_cont(similarity, 0.5), 6) AS median,
 round(quantile_cont(similarity, 0.95), 6) AS p95, round(quantile_cont(similarity, 0.99), 6) AS p99, CAST(sum(CASE WHEN similarity >= 0.25 THEN 1 ELSE 0 END) AS BIGINT) AS flagged, count(*) AS n FROM nn""")
def contamination_stats(spark, sf_dir):
    v = _ids(vectors(spark, sf_dir))
    s = F.col("max_similarity")
    found = cut(contamination(v.filter("label = 1"), v.filter("label = 0"), 0.25), "contamination")
    at = zip(("median", "p95", "p99"), quantiles(found, "max_similarity", [0.5, 0.95, 0.99]), strict=True)
    return found.agg(
        F.round(F.min(s), 6).alias("min"), F.round(F.max(s), 6).alias("max"), F.round(F.avg(s), 6).alias("mean"),
        *(F.round(F.lit(x).cast("double"), 6).alias(n) for n, x in at), F.count_if("flagged").alias("flagged"), F.count("*").alias("n"),
    )


@query("contamination_clean", f"WITH {_CONT} SELECT v.id FROM v WHERE v.label = 1 AND v.id NOT IN (SELECT query_id FROM nn WHERE similarity >= 0.25)")
def contamination_clean(spark, sf_dir):
    """What is left when flagged rows are taken out by anti-join."""
    v = _ids(vectors(spark, sf_dir))
    bad = contamination(v.filter("label = 1"), v.filter("label = 0"), 0.25).filter("flagged").select("id")
    return v.filter("label = 1").join(bad, "id", "left_anti").select("id")


@query("retrieval_pairs", f"""WITH {V}, {B.MESSAGES}, {knn_sql('q.label <> 1', 'c.label = 1', 1)}
SELECT query_id, nn.id AS neighbor_id, format('{{:.4f}}', similarity) AS similarity, replace(left(a.body, 200), chr(10), ' ') AS query_preview, replace(left(b.body, 200), chr(10), ' ') AS neighbor_preview
FROM nn JOIN m a ON a.id = query_id JOIN m b ON b.id = nn.id""")
def retrieval_pairs(spark, sf_dir):
    from heron.sources.messages import messages

    v = _ids(vectors(spark, sf_dir))
    pairs = nearest(v.filter("label <> 1"), v.filter("label = 1"), 1)
    m = messages(spark, sf_dir).select("id", F.translate(F.left("body", F.lit(200)), "\n", " ").alias("preview"))
    a, b = m.toDF("query_id", "query_preview"), m.toDF("neighbor_id", "neighbor_preview")
    return pairs.select("query_id", F.col("id").alias("neighbor_id"), F.format_string("%.4f", F.col("similarity")).alias("similarity")).join(a, "query_id").join(b, "neighbor_id")


def fused(spark, sf_dir, k=8, thresholds=fusion.Thresholds()):
    """Every message, scored once, with its attacks, its vector's neighbours, verdict and score; messages without a vector keep phase 1."""
    n = F.col("n_vectors")
    v = _ids(vectors(spark, sf_dir))
    count = v.count()
    p1 = with_attacks(spark, sf_dir).withColumn("n_vectors", F.lit(count)).withColumn("vec_id", F.when(n > 0, F.col("id") % n))
    near = cut(similarity_stats(nearest(v, v.filter("label = 1"), k)), "near")
    # Only a row without a labelled neighbour is judged by its neighbours of any label.
    alone = v.join(near.select(F.col("query_id").alias("id")), "id", "left_anti")
    overall = nearest(alone, v, 1).select("query_id", F.col("similarity").alias("top_all"))
    joined = p1.join(near, p1.vec_id == near.query_id, "left").drop("query_id").join(overall, p1.vec_id == overall.query_id, "left")
    top, avg3, any_n = F.coalesce("top_sim", F.lit(0.0)), F.coalesce("avg_top3", F.lit(0.0)), F.coalesce("top_all", F.lit(0.0))
    out = joined.withColumns({
        "ai_verdict": fusion.ai_verdict(F.col("verdict"), F.round(top, 9), F.round(avg3, 9), thresholds),
        "ai_score": F.when(F.col("top_all").isNull() & F.col("top_sim").isNull(), F.col("score")).otherwise(
            fusion.ai_score(F.col("verdict"), top, avg3, any_n, F.col("top_sim").isNotNull())),
        "top_sim": top, "avg_top3": avg3, "n_neighbors": F.coalesce("n_neighbors", F.lit(0)),
    })
    out = out.withColumn("ai_label", (F.col("ai_verdict") == "phishing").cast("int"))
    return out.withColumn("ai_reasons", fusion.with_conclusion(F.col("reasons"), fusion.conclusion(F.col("ai_label"), F.col("dmarc_policy"))))


def fused_sql(k: int = 8) -> str:
    return f"""{B.phase1(True)}, {V}, {knn_sql('true', 'c.label = 1', k)}, {knn_sql('true', 'true', 1, name='na')},
st AS (SELECT query_id, max(similarity) AS top_sim, avg(CASE WHEN rank <= 3 THEN similarity END) AS avg_top3, avg(similarity) AS avg_all, count(*) AS n_neighbors FROM nn GROUP BY query_id),
f0 AS (SELECT p1.*, coalesce(st.top_sim, 0.0) AS top_sim, coalesce(st.avg_top3, 0.0) AS avg_top3, CAST(coalesce(n_neighbors, 0) AS INT) AS n_neighbors, st.query_id IS NOT NULL AS has_phish, coalesce(na.similarity, 0.0) AS top_all
  FROM p1 LEFT JOIN st ON st.query_id = p1.id % (SELECT count(*) FROM v) LEFT JOIN na ON na.query_id = p1.id % (SELECT count(*) FROM v)),
f1 AS (SELECT *, CASE WHEN verdict = 'phishing' OR round(top_sim, 9) >= 0.40 OR (verdict = 'needs_review' AND round(avg_top3, 9) >= 0.35) THEN 'phishing' WHEN round(top_sim, 9) >= 0.25 OR round(avg_top3, 9) >= 0.17 THEN 'needs_review' ELSE verdict END AS ai_verdict,
  CASE WHEN has_phish THEN 0.65 * top_sim + 0.35 * avg_top3 ELSE 0.5 * top_all END AS sig, CASE verdict WHEN 'phishing' THEN 1.0 WHEN 'needs_review' THEN 0.6 ELSE 0.0 END AS ps FROM f0),
f AS (SELECT *, CAST(ai_verdict = 'phishing' AS INT) AS ai_label, CAST(round_even(round(least(1.0, greatest(0.0, sig, 0.7 * sig + 0.3 * ps)) * 10, 9), 0) AS INT) AS ai_score FROM f1)"""


@query("ai_verdict", f"WITH {fused_sql()} SELECT id, verdict, ai_verdict FROM f")
def ai_verdict(spark, sf_dir):
    return fused(spark, sf_dir).select("id", "verdict", "ai_verdict")


@query("ai_score", f"WITH {fused_sql()} SELECT id, ai_score, round(top_sim, 6) AS top_sim, round(avg_top3, 6) AS avg_top3 FROM f")
def ai_score(spark, sf_dir):
    return fused(spark, sf_dir).select("id", "ai_score", F.round("top_sim", 6).alias("top_sim"), F.round("avg_top3", 6).alias("avg_top3"))


_CONCLUSION = "CASE WHEN ai_label = 1 THEN 'Conclusion: **PHISH** — matches known phish and weak auth (DMARC: ' ELSE 'Conclusion: **LEGIT** — no strong phish match and auth not clearly risky (DMARC: ' END || coalesce(dmarc_policy, 'none') || ')'"


@query("analyze_email", f"WITH {fused_sql()}, {B.ontology_ctes()}, a AS (SELECT id, count(*) AS k FROM attacks GROUP BY id) SELECT f.id, score, verdict, ai_verdict, ai_label, ai_score, n_neighbors, list_append(reasons, {_CONCLUSION}) AS ai_reasons, CAST(coalesce(a.k, 0) AS INT) AS n_attacks FROM f LEFT JOIN a ON a.id = f.id")
def analyze_email(spark, sf_dir):
    """The whole two-phase analysis of every message."""
    cols = ("id", "score", "verdict", "ai_verdict", "ai_label", "ai_score", "n_neighbors", "ai_reasons")
    return fused(spark, sf_dir).select(*cols, F.size("attacks").alias("n_attacks"))


@query("two_phase_record", f"""WITH {fused_sql()}, {B.ontology_ctes()}, a AS (SELECT id, count(*) AS k FROM attacks GROUP BY id)
SELECT f.id, CAST(regexp_matches(subject || chr(10) || body, '(?i)(https?://|www\\.)\\S+') AS INT) AS url_flag, score AS phase1_score, verdict AS phase1_verdict, CAST(score >= 2 AS INT) AS phase1_pred, ai_verdict AS rag_verdict, ai_score AS rag_score,
 CAST(ai_verdict <> 'benign' AS INT) AS rag_pred, round(top_sim, 6) AS top_sim, round(avg_top3, 6) AS avg_top3, n_neighbors, coalesce(a.k, 0) > 0 AS ontology_fired FROM f LEFT JOIN a ON a.id = f.id""")
def two_phase_record(spark, sf_dir):
    return fused(spark, sf_dir).select(
        "id", F.concat("subject", F.lit("\n"), "body").rlike(X.URL_TEXT).cast("int").alias("url_flag"), F.col("score").alias("phase1_score"), F.col("verdict").alias("phase1_verdict"),
        (F.col("score") >= 2).cast("int").alias("phase1_pred"), F.col("ai_verdict").alias("rag_verdict"), F.col("ai_score").alias("rag_score"), (F.col("ai_verdict") != "benign").cast("int").alias("rag_pred"),
        F.round("top_sim", 6).alias("top_sim"), F.round("avg_top3", 6).alias("avg_top3"), "n_neighbors", (F.size("attacks") > 0).alias("ontology_fired"),
    )


@query("similarity_stats_by_label", f"""WITH {fused_sql()}, {B.ontology_ctes()}, a AS (SELECT id, count(*) AS k FROM attacks GROUP BY id)
SELECT label, count(*) AS n, round(avg(top_sim), 6) AS mean_top, round(max(top_sim), 6) AS max_top, round(median(top_sim), 6) AS median_top, round(avg(avg_top3), 6) AS mean_avg3, round(max(avg_top3), 6) AS max_avg3,
 CAST(sum(CAST(coalesce(k, 0) > 0 AS INT)) AS BIGINT) AS ontology_fired, {', '.join(f"CAST(sum(CAST(top_sim >= 0.{c} AS INT)) AS BIGINT) AS top_{c}" for c in (70, 60, 50, 40))},
 {', '.join(f"CAST(sum(CAST(avg_top3 >= 0.{c} AS INT)) AS BIGINT) AS avg3_{c}" for c in (68, 50))}, round(avg(CAST(top_sim < 0.40 AS INT)), 6) AS low_share
FROM f LEFT JOIN a ON a.id = f.id WHERE label IS NOT NULL GROUP BY label""")
def similarity_stats_by_label(spark, sf_dir):
    rows = fused(spark, sf_dir).filter("label is not null").select("label", "top_sim", "avg_top3", F.size("attacks").alias("k"))
    t, a = F.col("top_sim"), F.col("avg_top3")
    return rows.groupBy("label").agg(
        F.count("*").alias("n"), F.round(F.avg(t), 6).alias("mean_top"), F.round(F.max(t), 6).alias("max_top"), F.round(F.median(t), 6).alias("median_top"),
        F.round(F.avg(a), 6).alias("mean_avg3"), F.round(F.max(a), 6).alias("max_avg3"), F.count_if(F.col("k") > 0).alias("ontology_fired"),
        *(F.count_if(t >= c / 100).alias(f"top_{c}") for c in (70, 60, 50, 40)), *(F.count_if(a >= c / 100).alias(f"avg3_{c}") for c in (68, 50)),
        F.round(F.avg((t < 0.40).cast("int")), 6).alias("low_share"),
    )


@query("evidence_block", f"""WITH {V}, {knn_sql('q.label <> 1', 'c.label = 1', 3)}
SELECT query_id, string_agg('#' || CAST(rank AS INT) || ' id=' || id || ' sim=' || format('{{:.2f}}', round(similarity, 6)), '; ' ORDER BY rank) AS evidence FROM nn GROUP BY query_id""")
def evidence_block(spark, sf_dir):
    """The deterministic evidence lines of a prompt, without the model."""
    line = F.concat(F.lit("#"), F.col("rank").cast("string"), F.lit(" id="), F.col("id").cast("string"), F.lit(" sim="), F.format_string("%.2f", F.round("similarity", 6)))
    pairs = phish_neighbors(spark, sf_dir, 3).select("query_id", F.struct("rank", line.alias("line")).alias("x"))
    return pairs.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "; ").alias("evidence"))


@query("neighbors_shown", f"""WITH {V}, {knn_sql('q.label <> 1', 'c.label = 1', 12)}
SELECT query_id, list(id ORDER BY rank) FILTER (rank <= 8) AS shown, CAST(count(*) AS INT) AS found FROM nn GROUP BY query_id""")
def neighbors_shown(spark, sf_dir, found: int = 12, shown: int = 8):
    """What a list with room for so many neighbours shows of those found."""
    n = phish_neighbors(spark, sf_dir, found).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("x"))
    return n.select("query_id", F.transform(F.slice("x", 1, shown), lambda x: x["id"]).alias("shown"), F.size("x").alias("found"))


@query("first_neighbor_gap", f"""WITH {V}, {knn_sql('q.label <> 1', 'c.label = 1', 2)}
SELECT query_id, round(max(CASE WHEN rank = 1 THEN similarity END) - max(CASE WHEN rank = 2 THEN similarity END), 6) AS gap FROM nn GROUP BY query_id""")
def first_neighbor_gap(spark, sf_dir):
    w = W.partitionBy("query_id").orderBy("rank")
    return phish_neighbors(spark, sf_dir, 2).withColumn("gap", F.round(F.col("similarity") - F.lead("similarity").over(w), 6)).filter("rank = 1").select("query_id", "gap")
