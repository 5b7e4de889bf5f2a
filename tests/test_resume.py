"""Backfills and streams that stop and go on, and updates by partitions."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from heron.sources import backfill
from heron.streaming.messages import follow_totals, latest_totals, newest_of

OUT = "id long, x long"


def double(rows):
    return rows.select("id", (2 * F.col("id")).alias("x"))


def test_a_stopped_backfill_goes_on_without_a_row_twice(spark, tmp_path):
    path = f"file://{tmp_path}/b"
    todo = spark.createDataFrame([(3 * k,) for k in range(100)] + [(60,)] * 4, "id long").repartition(3)
    assert backfill.mark(spark, path) is None and backfill.backfilled(spark, path, OUT).count() == 0
    assert backfill.backfill(todo, double, path, 15, batches=2) == 2
    first = {r["id"]: r["batch"] for r in backfill.backfilled(spark, path, OUT).collect()}
    assert len(first) < 100 and max(first) == backfill.mark(spark, path)

    class Stop(Exception):
        pass

    def broken(rows):
        double(rows.limit(3)).write.parquet(f"{path}/rows/batch={backfill.batch_ends(todo.filter(F.col('id') > max(first)), 15)[0]}")
        raise Stop

    with pytest.raises(Stop):
        backfill.backfill(todo, broken, path, 15)
    assert {r["id"]: r["batch"] for r in backfill.backfilled(spark, path, OUT).collect()} == first
    assert backfill.backfill(todo, double, path, 15) >= 5
    rows = backfill.backfilled(spark, path, OUT).collect()
    assert sorted(r["id"] for r in rows) == sorted(r["id"] for r in todo.collect()) and all(r["x"] == 2 * r["id"] for r in rows)
    assert {r["id"]: r["batch"] for r in rows if r["id"] <= max(first)} == first
    assert backfill.backfill(todo, double, path, 15) == 0
    more = todo.unionByName(spark.createDataFrame([(1000,), (2,)], "id long"))
    assert backfill.backfill(more, double, path, 15) == 1 and backfill.mark(spark, path) == 1000


def test_backfill_of_nothing(spark, tmp_path):
    assert backfill.backfill(spark.createDataFrame([], "id long"), double, f"file://{tmp_path}/b", 5) == 0


def test_only_touched_partitions_are_written(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = spark.createDataFrame([(k, float(k), f"n{k}") for k in range(100)], "id long, v double, name string")
    backfill.write_by_ids(rows, f"file://{path}", 10)
    files = lambda: {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    before = files()
    backfill.update_by_ids(spark, f"file://{path}", spark.createDataFrame([(12, -1.0), (19, -2.0), (55, -3.0), (4000, 9.0)], "id long, new double"), "v", 10)
    after = files()
    kept = {f for f in before if after.get(f) == before[f]}
    assert len(before) == 10 and len(kept) == 8 and all("span=1/" not in f and "span=5/" not in f for f in kept)
    found = {r["id"]: (r["v"], r["name"]) for r in spark.read.parquet(f"file://{path}").collect()}
    assert found == {k: ({12: -1.0, 19: -2.0, 55: -3.0}.get(k, float(k)), f"n{k}") for k in range(100)}


def mails(spark, rows):
    day = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(g, body, None if d is None else day + datetime.timedelta(days=d)) for g, body, d in rows], "g string, body string, msg_date timestamp")


def test_stream_totals_go_on_from_their_state(spark, tmp_path):
    source, path = f"file://{tmp_path}/in", f"file://{tmp_path}/totals"
    schema = mails(spark, []).schema

    def run(rows=None):
        if rows is not None:
            mails(spark, rows).write.mode("append").parquet(source)
        follow_totals(spark.readStream.schema(schema).parquet(source), "g", path, late="2 days")
        return {r["g"]: (r["n"], r["email"], r["ssn"], r["late_rows"], r["batches"]) for r in latest_totals(spark, path, "g").collect()}

    ssn, mail = "SSN 123-45-6789", "a.b@example.com"
    assert run([("a", f"{ssn} {mail}", 5), ("a", mail, 1), ("b", "nothing", None)]) == {"a": (2, 2, 1, 0, 1), "b": (1, 0, 0, 0, 1)}
    assert newest_of(spark, path) == datetime.datetime(2024, 1, 6)
    # Nothing new changes nothing; what comes later adds to the state, and days 1 and 2 are late by now.
    assert run() == {"a": (2, 2, 1, 0, 1), "b": (1, 0, 0, 0, 1)}
    assert run([("a", ssn, 2), ("a", ssn, 3), ("c", mail, 1), ("c", mail, 9), ("c", None, None)]) == {"a": (4, 2, 3, 1, 2), "b": (1, 0, 0, 0, 1), "c": (3, 2, 0, 1, 1)}
    assert run([("b", mail, 6)]) == {"a": (4, 2, 3, 1, 2), "b": (2, 1, 0, 1, 2), "c": (3, 2, 0, 1, 1)}
