"""The pipeline's stages: columns, nulls and empty tables."""

import corpus_pipeline as P
from heron.plans.session import table

DIR = "/root/testdata/sf0.001"


def test_stages_in_order_and_columns(spark):
    assert [n for n, _ in P.STAGES] == ["toxicity", "quality_rules", "minhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]
    docs = table(spark, DIR, "documents")
    columns, before = docs.columns, docs.count()
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, DIR).cache()
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    packed = P.STAGES[-1][1](spark, docs, DIR)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_stages_with_nulls_and_empty(spark):
    schema = table(spark, DIR, "documents").schema
    rows = [(None, None, None, None, None), (1, None, "en", None, 0), (2, "", "en", "s", 0)]
    for data in (rows, []):
        for _, stage in P.STAGES:
            stage(spark, spark.createDataFrame(data, schema), DIR).count()


def test_stages_take_odd_rows(spark):
    """Clashing names, repeated rows, null ids, empty and very long texts go through every stage, whose columns stay those of its input."""
    import random

    from pyspark.sql import functions as F

    r = random.Random(3)

    def prose(seed, n=120):
        x = random.Random(seed)
        return ". ".join(" ".join(x.choice(["the", "of", "and", "house", "river", "walks", "tree", f"w{x.randrange(900)}"]) for _ in range(12)) for _ in range(n // 12)) + "."

    texts = [prose(i) for i in range(20)] + [prose(3), prose(3) + " End of it.", None, "", " ", "x" * 200_000, prose(99, 30_000)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(4, texts[4], "en", "s", 1), (4, prose(500), "en", "s", 1), (None, prose(501), None, None, None)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = ["row", "stats", "kept", "__stats", "_gone", "gone_id", "score", "digest", "ranges", "node"]
    for c in names:
        df = df.withColumn(c, F.lit("mine"))
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, df, DIR)
        assert out.columns == df.columns, name
        df = spark.createDataFrame(out.collect(), df.schema)
    left = df.collect()
    ids = sorted(str(x["doc_id"]) for x in left)
    assert {x["kept"] for x in left} == {"mine"} and ids.count("4") == 3 and "None" in ids and not {"20", "21", "22", "23", "24", "25"} & set(ids)
    packed = P.STAGES[-1][1](spark, df, DIR).collect()
    assert sorted({str(x["doc_id"]) for x in packed}) == sorted(set(ids)) and sum(x["piece"] == 0 for x in packed) == len(left)
