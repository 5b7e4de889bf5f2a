"""Streams give what the batch gives."""

from pyspark.sql import functions as F

from heron.plans.session import table
from heron.sources.messages import MESSAGE_TYPES, messages
from heron.streaming.messages import daily_series, redaction_totals, score_stream

DIR = "/root/testdata/sf0.001"


def drain(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_scores_and_totals(spark, tmp_path):
    rows = messages(spark, DIR).select(*MESSAGE_TYPES.names)
    rows.write.parquet(f"{tmp_path}/m")
    stream = spark.readStream.schema(MESSAGE_TYPES).parquet(f"{tmp_path}/m")
    got = drain(score_stream(stream, ["acme.com"]).select("id", "score"), "scores", "append")
    want = score_stream(rows, ["acme.com"]).select("id", "score")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    totals = drain(redaction_totals(stream, "urls"), "totals", "complete")
    assert sorted(map(tuple, totals.collect())) == sorted(map(tuple, redaction_totals(rows, "urls").collect()))


def test_daily_series(spark, tmp_path):
    events = table(spark, DIR, "events").select("ts", "event_type")
    events.write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e")
    got = {(r["d"], r["event_type"]): r["n"] for r in drain(daily_series(stream, "ts", "event_type"), "daily", "append").collect()}
    want = {(r["d"], r["event_type"]): r["n"] for r in events.groupBy(F.to_date("ts").alias("d"), "event_type").agg(F.count("*").alias("n")).collect()}
    # The last days stay open until the watermark passes them.
    assert got and all(want[k] == n for k, n in got.items()) and len({d for d, _ in want} - {d for d, _ in got}) <= 3
