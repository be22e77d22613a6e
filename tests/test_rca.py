import pytest
from pyspark.sql import functions as F

from dqspark.operators import rca as A
from dqspark.operators.ops import detection_cases, detection_metrics, sync_actions

SCHEMA = "run_id string, seq int, type string, column string, score double"


def signals_of(spark, *rows):
    df = spark.createDataFrame([("r", i, *row) for i, row in enumerate(rows)], SCHEMA)
    return df.withColumn("signal_id", F.concat_ws(":", "run_id", "seq")).withColumn(
        "severity", F.when(F.col("score") >= 0.85, "critical").otherwise("medium")
    )


def hyps(df, **kw):
    found = sorted(A.hypotheses(df, **kw).collect(), key=lambda r: (-r["confidence"], r["position"]))
    return [(r["rule_id"], r["column"], r["confidence"], r["evidence_ids"]) for r in found]


CASES = [
    ([("schema_missing_column", "a", 0.95)], [("schema_drop", "a", 0.95, ["r:0"])]),
    ([("schema_type_mismatch", "a", 0.9), ("semantic_drift", "a", 0.5)], [("schema_type_change", "a", 0.9, ["r:0", "r:1"])]),
    ([("range", "a", 0.9), ("distribution", "a", 1.0)], [("scale_error", "a", 0.99, ["r:0", "r:1"])]),
    ([("range", "a", 0.7)], [("scale_error", "a", 0.7, ["r:0"])]),
    ([("distribution", "a", 0.7)], [("unexplained_distribution_shift", "a", 0.56, ["r:0"])]),
    ([("completeness", "a", 0.7), ("completeness", "a", 0.9)], [("completeness_gap", "a", 0.7, ["r:0"])]),
    ([("freshness", "a", 0.7)], [("freshness_sla_breach", "a", 0.7, ["r:0"])]),
    ([("staleness", "a", 0.7)], [("stale_data", "a", 0.7, ["r:0"])]),
    ([("semantic_drift", "a", 0.6)], [("semantic_drift", "a", 0.45, ["r:0"])]),
    ([("column_compare", "a", 0.7)], [("column_relation_broken", "a", 0.7, ["r:0"])]),
    ([("cardinality_drift", "a", 0.7)], [("cardinality_drift", "a", 0.35, ["r:0"])]),
    ([("row_count", None, 0.75)], [("row_count_bound", None, 0.75, ["r:0"])]),
    ([("multivariate_drift", None, 0.7)], [("joint_distribution_shift", None, 0.56, ["r:0"])]),
    ([("volume", None, 0.8)], [("volume_shift", None, 0.56, ["r:0"])]),
    ([("uniqueness", "a", 0.9), ("volume", None, 1.0)], [("duplicate_load", None, 0.99, ["r:1", "r:0"])]),
    ([("uniqueness", "a", 0.9)], []),
    ([("segment_missing", None, 0.8), ("referential_integrity", "a", 0.85)], []),
]


@pytest.mark.parametrize("given, expected", CASES)
def test_rules(spark, given, expected):
    assert hyps(signals_of(spark, *given)) == expected


def test_duplicate_load_takes_the_first_signalled_column(spark):
    df = signals_of(spark, ("range", "b", 0.5), ("uniqueness", "a", 0.9), ("uniqueness", "b", 0.6), ("volume", None, 0.6))
    assert ("duplicate_load", None, 0.7, ["r:3", "r:2"]) in hyps(df)


def test_schema_change_supports_the_drop(spark):
    changes = spark.createDataFrame([("r", "a", "dropped")], "run_id string, column string, change string")
    assert hyps(signals_of(spark, ("schema_missing_column", "a", 0.95)), schema_changes=changes)[0][2] == 0.98


def test_ranking_and_report(spark):
    df = signals_of(
        spark, ("completeness", "a", 0.9), ("completeness", "b", 0.9), ("range", "c", 0.5), ("freshness", "d", 0.45), ("cardinality_drift", "e", 0.6)
    )
    strong, rest = A.rank_hypotheses(A.hypotheses(df))
    assert [(r["column"], r["rank"]) for r in strong.orderBy("rank").collect()] == [("a", 1), ("b", 2), ("c", 3)]
    assert {r["column"] for r in rest.collect()} == {"d", "e"}
    report = A.reports(df, A.hypotheses(df)).first()
    assert (report["severity"], report["top_rule"], report["causes"], report["uncertainties"]) == ("critical", "completeness_gap", 3, 2)
    actions = A.recommended_actions(strong).collect()
    assert [(a["type"], a["requires_approval"]) for a in actions] == [("dbt_test", False)]
    weak = signals_of(spark, ("cardinality_drift", "e", 0.6))
    report = A.reports(weak, A.hypotheses(weak)).first()
    assert report["top_rule"] is None and report["causes"] == 0 and report["uncertainties"] == 1


def test_evidence_of_outside_hypotheses(spark):
    signals = signals_of(spark, ("range", "a", 0.9))
    rows = [("r", "h1", "why", 1.7, ["r:0", "fake"]), ("r", "h2", "why", 0.5, ["fake"]), ("r", "h3", " ", 0.5, ["r:0"]), ("q", "h4", "why", 0.5, ["r:0"]), ("r", "h5", "why", -1.0, ["r:0"])]
    proposed = spark.createDataFrame(rows, "run_id string, hypothesis_id string, text string, confidence double, evidence_ids array<string>")
    accepted, unverified = A.validate_evidence(proposed, signals)
    assert [(r["hypothesis_id"], r["confidence"], r["verified_ids"]) for r in accepted.orderBy("rank").collect()] == [("h1", 1.0, ["r:0"]), ("h5", 0.0, ["r:0"])]
    assert {r["hypothesis_id"] for r in unverified.collect()} == {"h2", "h4"}


def test_replay(spark):
    df = signals_of(spark, ("range", "a", 0.9))
    stored = A.reports(df, A.hypotheses(df))
    assert A.replay_rca(df, stored).first()["matches"]
    assert not A.replay_rca(df, stored.withColumn("top_rule", F.lit("other"))).first()["matches"]


def test_metrics_and_actions(spark):
    df = signals_of(spark, ("range", "a", 0.9))
    strong, _ = A.rank_hypotheses(A.hypotheses(df))
    cases = spark.createDataFrame([("r", ["range"], "scale_error"), ("q", ["volume"], "volume_shift")], "run_id string, expected_types array<string>, expected_rule string")
    row = detection_metrics(cases, df, strong).first()
    assert (row["cases"], row["detection_recall"], row["top1_accuracy"], row["mean_confidence"], row["evidence_precision"]) == (2, 0.5, 0.5, 0.9, 1.0)
    bad = strong.withColumn("evidence_ids", F.array(F.lit("r:99")))
    strict = cases.withColumn("min_confidence", F.lit(0.95))
    why = {r["run_id"]: (r["top_confidence"], r["failures"], r["passed"]) for r in detection_cases(strict, df, bad).collect()}
    assert why == {"r": (0.9, ["confidence", "evidence"], False), "q": (0.0, ["missing_types", "rule", "confidence"], False)}
    assert detection_cases(cases.filter("false"), df, strong).count() == 0
    keys = "incident_id string, type string, description string"
    drafts = spark.createDataFrame([("i", "alert", "x", True), ("i", "test", "y", False)], keys + ", requires_approval boolean")
    existing = spark.createDataFrame([("i", "alert", "x", False), ("i", "old", "z", False)], keys + ", requires_approval boolean")
    decisions = spark.createDataFrame([("i", "alert", "x", "2024-01-01", "reject"), ("i", "alert", "x", "2024-01-02", "approve")], keys + ", ts string, decision string")
    got = {r["type"]: (r["requires_approval"], r["status"]) for r in sync_actions(drafts, existing, decisions).collect()}
    assert got == {"alert": (False, "approved"), "test": (False, "pending"), "old": (False, "pending")}
