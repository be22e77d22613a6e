from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from dqspark.operators.contract import bad_values
from dqspark.runtime import scratch_path
from dqspark.streaming.streams import newest_rows, run_available_now, stream_value_rules, value_rule_totals

START = datetime(2024, 3, 1)
SCHEMA = "id bigint, kind string, amount double, ts timestamp_ntz"
RULES = {
    "rules": [
        {"type": "uniqueness", "columns": ["id"]},
        {"type": "uniqueness", "columns": ["kind", "amount"]},
        {"type": "referential_integrity", "column": "kind", "reference": "kinds"},
        {"type": "allowed_values", "column": "amount", "values": [1, 2.0]},
        {"type": "not_null", "column": "id"},
    ]
}


def events(n, hours):
    """A hot id in a third of the rows, nulls, NaN and repeats; times rise by batch."""
    return [
        (None if i % 11 == 5 else 7 if i % 3 == 0 else i, "abc?"[i % 4] if i % 13 else None, float("nan") if i % 17 == 3 else float(i % 4), START + timedelta(hours=hours, seconds=37 * i))
        for i in range(n)
    ]


def drained(spark, batches):
    path, out, state = (scratch_path(spark, n) for n in ("values-in", "values-out", "values-state"))
    kinds = {"kinds": spark.createDataFrame([("a",), ("b",), (None,)], "k string")}
    finished = None
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).repartition(3).write.parquet(f"{path}/batch={i}")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{path}/batch=*")
        found = stream_value_rules(stream, RULES, "ts", "1 hour", "10 minutes", kinds)
        finished = run_available_now(found, out, state, "update")
    return newest_rows(spark, out, ["window_start", "rule", "value_digest"]), finished, kinds


def test_windows_agree_with_the_batch_check(spark):
    batches = [events(300, 0), events(200, 4), events(250, 9)]
    rows, finished, kinds = drained(spark, batches)
    got = {(r["window_start"], r["rule"]): (r["values"], r["violations"]) for r in value_rule_totals(rows).collect()}
    whole = spark.createDataFrame(sum(batches, []), SCHEMA).withColumn("hour", F.date_trunc("hour", "ts"))
    rules = {i: r for i, r in enumerate(RULES["rules"]) if r["type"] != "not_null"}
    names = ["uniqueness:id", "uniqueness:kind,amount", "referential_integrity:kind", "allowed_values:amount"]
    bad = bad_values(whole, rules, ["hour"], kinds).groupBy("hour", "rule").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("v")).collect()
    assert got == {(r["hour"].replace(tzinfo=None), names[r["rule"]]): (r["n"], r["v"]) for r in bad} and len(got) > 20
    # Closed windows have left the state: only those behind no watermark are held.
    held = finished.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert 0 < held < 1500 and sum(len(b) for b in batches) * len(rules) > held


def test_newest_rows_read_one_drain(spark):
    path, out, state = (scratch_path(spark, n) for n in ("values-in", "values-out", "values-state"))
    spark.createDataFrame([(1, "a", 1.0, START)] * 3 + [(2, "z", 9.0, START)], SCHEMA).write.parquet(path)
    kinds = {"kinds": spark.createDataFrame([("a",)], "k string")}
    stream = stream_value_rules(spark.readStream.schema(SCHEMA).parquet(path), RULES, "ts", "1 hour", "10 minutes", kinds)
    run_available_now(stream, out, state, "update")
    found = value_rule_totals(newest_rows(spark, out, ["window_start", "rule", "value_digest"]))
    assert {(r["rule"], r["values"], r["violations"]) for r in found.collect()} == {
        ("uniqueness:id", 1, 2), ("uniqueness:kind,amount", 1, 2), ("referential_integrity:kind", 1, 1), ("allowed_values:amount", 1, 1)
    }


def test_contracts_without_value_rules_are_refused(spark):
    stream = spark.readStream.format("rate").load()
    with pytest.raises(ValueError, match="no value rule"):
        stream_value_rules(stream, {"rules": [{"type": "not_null", "column": "value"}]}, "timestamp", "1 hour", "1 minute")
