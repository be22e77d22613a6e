import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from dqspark.operators import ops as O
from dqspark.operators.profile import profile_table
from dqspark.runtime import broadcast_if_small, scratch_path
from dqspark.sources import tables as S
from dqspark.sources.lineage_events import EVENT, read_dbt_manifest, read_openlineage
from dqspark.streaming import streams as W

T = datetime(2024, 1, 1)


# ------------------------------------------------------------------ tables


def test_scan_is_half_open_and_pushed_down(spark, sf):
    start, end = (F.to_timestamp_ntz(F.lit(d)) for d in ("1996-01-01", "1996-02-01"))
    df = S.read_table(spark, f"{sf}/orders.parquet", partition=("o_orderdate", start, end), columns=["o_orderkey"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in plan
    with pytest.raises(ValueError):
        S.scan_table(df, max_rows=5)
    row = S.scan_coverage(df, max_rows=5).first()
    assert row["scanned_rows"] == 5 and not row["complete"]


def test_csv_types(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "id,created_at,paid_at,note,score,flag,code,none\n1,2024-01-01 10:00:00,2024-01-01,2024-01-01,1.5,true,7,\n2,,soon,2024-01-02,2,FALSE,x7,\n"
    )
    df = S.read_csv_typed(spark, str(tmp_path / "a.csv"))
    assert dict(df.dtypes) == {
        "id": "bigint", "created_at": "timestamp_ntz", "paid_at": "string", "note": "string", "score": "double", "flag": "boolean", "code": "string", "none": "string"
    }
    bad = S.cast_to_contract(df, {"expected_schema": {"paid_at": "datetime"}})
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        bad.collect()


def test_snapshot_and_metadata_tables(spark):
    path = scratch_path(spark, "t")
    df = spark.createDataFrame([(1, T, None)], "id smallint, at timestamp_ntz, x float")
    S.save_snapshot(df, path, "r1")
    S.save_snapshot(df, path, "r1")
    assert S.load_snapshot(spark, path, "r1").schema.simpleString() == df.schema.simpleString()
    assert S.load_snapshot(spark, path, "r1").count() == 1
    path = scratch_path(spark, "p")
    rows = profile_table(df, parts=("distinct",)).withColumn("dataset", F.lit("d")).withColumn("run_id", F.lit("r"))
    S.save_profiles(rows, path)
    S.save_profiles(rows.withColumn("row_count", F.lit(9).cast("bigint")), path)
    assert {r["row_count"] for r in S.load_profiles(spark, path).collect()} == {9}


def test_broadcast_is_bounded(spark):
    df = spark.range(100)
    assert "broadcast" in broadcast_if_small(df, 100)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in broadcast_if_small(df, 99)._jdf.queryExecution().logical().toString().lower()


# ------------------------------------------------------------------ lineage artifacts


def test_manifest(spark, tmp_path):
    manifest = {
        "metadata": {"dbt_schema_version": "https://schemas.getdbt.com/dbt/manifest/v12.json"},
        "sources": {"source.a": {"name": "a"}},
        "nodes": {
            "model.b": {"name": "b", "resource_type": "model", "raw_code": "select 1", "depends_on": {"nodes": ["source.a", "gone"]}, "columns": {"y": {}, "x": {}}},
            "model.c": {"resource_type": "model", "depends_on": {"nodes": ["model.b"]}},
        },
        "exposures": {"exposure.d": {"name": "d", "resource_type": "exposure", "depends_on": {"nodes": ["model.c"]}}},
    }
    (tmp_path / "m.json").write_text(json.dumps(manifest, indent=1))
    (tmp_path / "r.json").write_text(json.dumps({"results": [{"unique_id": "model.b", "status": "error", "execution_time": 1.5}, {"unique_id": "other", "status": "success"}]}))
    nodes, edges, runs = read_dbt_manifest(spark, str(tmp_path / "m.json"), str(tmp_path / "r.json"))
    by_uid = {r["uid"]: r for r in nodes.collect()}
    assert set(by_uid) == {"source.a", "model.b", "model.c", "exposure.d"}
    assert by_uid["model.b"]["columns"] == ["x", "y"] and by_uid["model.c"]["name"] == "model.c" and by_uid["source.a"]["type"] == "source"
    assert {(r["src"], r["dst"]) for r in edges.collect()} == {("source.a", "model.b"), ("model.b", "model.c"), ("model.c", "exposure.d")}
    assert {(r["asset"], r["known"]) for r in runs.collect()} == {("model.b", True), ("other", False)}
    changed = json.loads(json.dumps(manifest))
    changed["nodes"]["model.b"]["raw_code"] = "select 2"
    (tmp_path / "n.json").write_text(json.dumps(changed))
    later = {r["uid"]: r["checksum"] for r in read_dbt_manifest(spark, str(tmp_path / "n.json"))[0].collect()}
    assert [u for u in later if later[u] != by_uid[u]["checksum"]] == ["model.b"]
    (tmp_path / "bad.json").write_text('{"metadata": {}, "nodes": {}}')
    with pytest.raises(Exception, match="schema version"):
        read_dbt_manifest(spark, str(tmp_path / "bad.json"))[0].collect()


def event(**changes):
    base = {
        "eventType": "COMPLETE",
        "eventTime": "2024-01-01T00:00:00Z",
        "run": {"runId": "1"},
        "job": {"namespace": "n", "name": "load"},
        "inputs": [{"namespace": "n", "name": "raw"}],
        "outputs": [
            {"namespace": "n", "name": "out", "facets": {"columnLineage": {"fields": {"Total": {"inputFields": [{"namespace": "n", "name": "raw", "field": "Amount"}]}}}}}
        ],
    }
    return json.dumps({**base, **changes})


def test_run_events(spark, tmp_path):
    bad_field = json.loads(event())
    bad_field["outputs"][0]["facets"]["columnLineage"]["fields"]["Total"]["inputFields"][0]["field"] = ""
    lines = [event(), event(eventType="DONE"), event(run={"runId": ""}), event(inputs=[{"namespace": "", "name": "x"}]), json.dumps(bad_field), event(eventType="FAIL", outputs=[])]
    (tmp_path / "e.json").write_text("\n".join(lines))
    nodes, edges, columns, runs, rejects = read_openlineage(spark.read.schema(EVENT).json(str(tmp_path / "e.json")))
    assert rejects.count() == 4 and runs.count() == 2
    assert {(r["src"], r["dst"], r["edge_type"]) for r in edges.collect()} == {("n::raw", "job::n::load", "READS_FROM"), ("job::n::load", "n::out", "WRITES_TO")}
    assert [tuple(r) for r in columns.collect()] == [("n::raw", "amount", "n::out", "total")]
    assert {(r["uid"], r["type"], r["name"]) for r in nodes.collect()} == {("n::raw", "dataset", "raw"), ("n::out", "dataset", "out"), ("job::n::load", "job", "load")}


# ------------------------------------------------------------------ streams


def drip(spark, path, batches, schema):
    """One file per batch, read one file at a time in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/b{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/b*")


EVENT_ROWS = "ts timestamp_ntz, key string, value double"


def at(minutes):
    return T + timedelta(minutes=minutes)


def test_stream_profile_equals_batch_and_counts_late_rows(spark):
    batches = [
        [(at(1), "a", 1.0), (at(5), "b", None)],
        [(at(70), "a", 3.0), (at(130), "a", 5.0)],
        [(at(200), "b", 7.0)],
        [(at(2), "late", 100.0), (at(201), "b", 7.0)],
    ]
    stream = drip(spark, scratch_path(spark, "in"), batches, EVENT_ROWS)
    out = scratch_path(spark, "out")
    late = W.LateRows()
    spark.streams.addListener(late)
    query = W.run_available_now(W.stream_profile(stream, "ts", "1 hour", "10 minutes", ["value"]), out, scratch_path(spark, "cp"), "update")
    rows = {r["window_start"]: r for r in W.newest_rows(spark, out, ["window_start", "column"]).collect()}
    assert set(rows) == {T, at(60), at(120), at(180)} and rows[at(180)]["row_count"] == 2
    assert rows[T]["row_count"] == 2 and rows[T]["null_ratio"] == 0.5 and rows[T]["max"] == 1.0
    assert late.of(query) == 1
    spark.streams.removeListener(late)


def test_stream_restart_keeps_exactly_once(spark):
    path, out, state = (scratch_path(spark, n) for n in ("in", "out", "cp"))
    stream = drip(spark, path, [[(at(1), "a", 1.0)]], EVENT_ROWS)
    contract = {"rules": [{"type": "range", "column": "value", "max": 2}]}
    bad = scratch_path(spark, "bad")
    W.run_quarantine(stream, contract, out, bad, state).awaitTermination()
    spark.createDataFrame([(at(2), "a", 9.0)], EVENT_ROWS).write.parquet(f"{path}/b1")
    again = spark.readStream.schema(EVENT_ROWS).parquet(f"{path}/b*")
    W.run_quarantine(again, contract, out, bad, state).awaitTermination()
    assert spark.read.parquet(out).count() == 1
    assert [r["failed_rules"] for r in spark.read.parquet(bad).collect()] == [["range:value"]]


def test_stream_contract_counts(spark):
    stream = drip(spark, scratch_path(spark, "in"), [[(at(1), "a", 1.0), (at(2), "x", 9.0)], [(at(200), "a", 1.0)]], EVENT_ROWS)
    contract = {"rules": [{"type": "range", "column": "value", "max": 2}, {"type": "allowed_values", "column": "key", "values": ["a"]}]}
    out = scratch_path(spark, "out")
    W.run_available_now(W.stream_contract(stream, contract, "ts", "1 hour", "5 minutes"), out, scratch_path(spark, "cp"), "update")
    found = W.newest_rows(spark, out, ["window_start", "rule"]).collect()
    assert {(r["window_start"], r["rule"], r["violations"]) for r in found} == {
        (T, "range:value", 1), (T, "allowed_values:key", 1), (at(180), "range:value", 0), (at(180), "allowed_values:key", 0)
    }
    for rule in ({"type": "uniqueness", "column": "key"}, {"type": "row_count", "min_rows": 1}):
        with pytest.raises(ValueError):
            W.stream_contract(stream, {"rules": [rule]}, "ts", "1 hour", "5 minutes")


def test_stream_freshness(spark):
    stream = drip(spark, scratch_path(spark, "in"), [[(at(1), "a", 1.0), (at(50), "b", 1.0)], [(at(30), "a", 1.0)]], EVENT_ROWS)
    out = scratch_path(spark, "out")
    W.run_available_now(W.stream_freshness(stream, "key", "ts"), out, scratch_path(spark, "cp"), "update")
    latest = spark.read.parquet(out).groupBy("source_id").agg(F.max("latest").alias("latest"))
    limits = spark.createDataFrame([("a", 20), ("b", 20)], "source_id string, max_lag_minutes int")
    got = {r["source_id"]: (r["lag_minutes"], r["late"]) for r in W.freshness_status(latest, limits, at(60)).collect()}
    assert got == {"a": (30.0, True), "b": (10.0, False)}


def test_stream_lineage_drops_redelivery(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"{i}.json").write_text(event() + "\n" + event(eventType="NOPE"))
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(str(tmp_path))
    out = scratch_path(spark, "out")
    W.run_available_now(W.stream_lineage(stream), out, scratch_path(spark, "cp"))
    assert spark.read.parquet(out).count() == 2


# ------------------------------------------------------------------ operations


def test_metric_history_follows_the_newest_configuration(spark):
    rows = [("s", f"r{i}", at(i), "old" if i < 2 else "new", "accepted", 10 + i) for i in range(5)]
    runs = spark.createDataFrame(rows, "source_id string, run_id string, run_ts timestamp_ntz, config_hash string, quality string, total_rows int")
    profiles = spark.createDataFrame([(f"r{i}", "x", 0.0, float(i)) for i in range(5)], "run_id string, column string, null_ratio double, mean double")
    assert [r["run_id"] for r in O.metric_history(runs, profiles).orderBy("run_ts").collect()] == ["r2", "r3", "r4"]
    assert [r["run_id"] for r in O.metric_history(runs, profiles, limit=2).orderBy("run_ts").collect()] == ["r3", "r4"]
    with pytest.raises(ValueError):
        O.metric_history(runs, profiles, limit=0)


def test_compliance_and_status(spark):
    now = at(600)
    sources = spark.createDataFrame([("manual", None, T), ("ok", 60, T), ("late", 60, T), ("new", 600, T)], "source_id string, schedule_minutes int, created_at timestamp_ntz")
    runs = spark.createDataFrame([("ok", at(590), "success"), ("late", at(400), "success"), ("late", at(595), "failed"), ("ok", at(599), "pending")], "source_id string, run_ts timestamp_ntz, status string")
    compliance = O.schedule_compliance(sources, runs, now)
    assert {r["source_id"]: r["state"] for r in compliance.collect()} == {"manual": "manual", "ok": "ok", "late": "stalled", "new": "waiting"}

    def status(seen, frame=compliance, jobs=runs):
        beats = spark.createDataFrame([("w", seen)], "worker string, last_seen timestamp_ntz")
        return O.monitoring_status(frame, jobs, beats, now).first()["status"]

    assert status(now) == "degraded" and status(at(1)) == "down"
    fine = compliance.filter("state <> 'stalled'")
    assert status(now, fine) == "ok"
    old = runs.unionByName(spark.createDataFrame([("ok", at(580), "pending")], runs.schema))
    assert status(now, fine, old) == "degraded"
    idle = compliance.filter("state = 'manual'")
    assert status(at(1), idle, runs.filter("status <> 'pending'")) == "ok"


def test_mutes(spark):
    signals = spark.createDataFrame([("s", "r1", T, "volume", None, "high"), ("s", "r1", T, "range", "a", "low"), ("s", "r2", T, "volume", None, "low"), ("t", "r3", T, "volume", None, "low")], "source_id string, run_id string, run_ts timestamp_ntz, type string, column string, severity string")
    mutes = spark.createDataFrame([("s", "volume", None, at(1)), ("s", "range", "b", at(1)), ("t", "volume", None, T - timedelta(1))], "source_id string, type string, column string, until timestamp_ntz")
    assert {r["run_id"]: r["muted"] for r in O.muted_runs(signals, mutes).collect()} == {"r1": False, "r2": True, "r3": False}
    assert {(r["run_id"], r["severity"], r["signal_count"]) for r in O.notification_queue(signals, mutes).collect()} == {("r1", "high", 2), ("r3", "low", 1)}
    assert O.active_mutes(mutes, T).count() == 2


def test_latest_state_and_digest(spark):
    log = spark.createDataFrame([("e", at(1), "approve"), ("e", at(2), "reject"), ("f", at(1), "approve")], "entity string, ts timestamp_ntz, decision string")
    assert {r["entity"]: r["decision"] for r in O.latest_state(log, ["entity"]).collect()} == {"e": "reject", "f": "approve"}
    df = spark.createDataFrame([(1, "x", 5), (1, "x", 60)], "a int, b string, schedule_minutes int")
    assert O.content_digest(df).select("digest").distinct().count() == 1


def test_timeline_limits_per_run(spark):
    events = spark.createDataFrame([(i, "s" if i % 3 == 0 else "t", at(i), "k", ["a", "a"] if i % 2 else ["b"]) for i in range(60)], "event_id int, source_id string, created_at timestamp_ntz, kind string, assets array<string>")
    scope = spark.createDataFrame([("r", "s", "a"), ("q", "x", "b")], "run_id string, source_id string, asset string")
    got = {}
    for r in O.timeline(events, scope, limit=10).collect():
        got.setdefault(r["run_id"], set()).add(r["event_id"])
    assert got["q"] == set(range(40, 60, 2))
    assert got["r"] == set(sorted((i for i in range(60) if i % 3 == 0 or i % 2), reverse=True)[:10])
