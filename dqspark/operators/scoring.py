"""From violations to scored signals, and from signals to run risk and severity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dqspark.functions.columns import rounded_score, severity, severity_label, severity_rank, violation_score
from dqspark.types import SIGNAL_FIELDS

# Weights of the contract and magnitude terms, renormalised over their sum.
CONTRACT_WEIGHT = 0.35 / 0.60
MAGNITUDE_WEIGHT = 0.25 / 0.60


def score_violations(violations: DataFrame) -> DataFrame:
    """Contract signals: score by violation type and evidence, severity by score."""
    runs = [c for c in violations.columns if c not in ("seq", "rule_type", "column", "severity", "evidence")]
    score = violation_score(F.col("rule_type"), F.col("evidence"))
    return violations.select(
        *runs,
        "seq",
        F.col("rule_type").alias("type"),
        "column",
        severity(score).alias("severity"),
        rounded_score(score).alias("score"),
        F.lit("contract").alias("source"),
        "evidence",
    )


def number_signals(signals: DataFrame, runs: Sequence[str], run_id: str | None = None) -> DataFrame:
    """Dense seq per run in report order, and the signal id. A run has at most a few signals per column,
    so the window partition is bounded by the schema and the contract, not by the data."""
    runs = list(runs)
    window = Window.partitionBy(*runs) if runs else Window.partitionBy(F.lit(0))
    ordered = window.orderBy("seq", F.col("segment").asc_nulls_first(), "type", "column") if (
        "segment" in signals.columns
    ) else window.orderBy("seq", "type", "column")
    key = F.concat_ws("/", *[F.col(r).cast("string") for r in runs]) if runs else F.lit(run_id or "run")
    rest = [c for c in signals.columns if c not in (*runs, *SIGNAL_FIELDS)]
    return (
        signals.withColumn("seq", (F.row_number().over(ordered) - 1).cast("bigint"))
        .withColumn("signal_id", F.concat(key, F.lit(":"), F.col("seq").cast("string")))
        .select(*runs, "signal_id", *SIGNAL_FIELDS, *rest)
    )


def incident_risk(signals: DataFrame, runs: Sequence[str] = ("run_id",), all_runs: DataFrame | None = None) -> DataFrame:
    """Risk in [0,1] and severity per run; runs of `all_runs` without signals get risk 0 and `low`."""
    runs = list(runs)
    grouped = signals.groupBy(*runs) if runs else signals.groupBy()
    risk = grouped.agg(
        F.count(F.lit(1)).alias("signal_count"),
        F.max("score").alias("top_score"),
        F.coalesce(F.bool_or(F.col("source") == "contract"), F.lit(False)).alias("contract_broken"),
    )
    if all_runs is not None:
        risk = all_runs.select(*runs).distinct().join(risk, runs, "left")
    value = F.least(
        F.lit(1.0),
        F.when(F.col("contract_broken"), F.lit(CONTRACT_WEIGHT)).otherwise(F.lit(0.0))
        + MAGNITUDE_WEIGHT * F.col("top_score"),
    )
    has = F.coalesce(F.col("signal_count"), F.lit(0)) > 0
    result = risk.select(
        *runs,
        F.coalesce(F.col("signal_count"), F.lit(0)).alias("signal_count"),
        F.when(has, rounded_score(value)).otherwise(F.lit(0.0)).alias("risk"),
    )
    return result.withColumn("severity", F.when(F.col("signal_count") > 0, severity(F.col("risk"))).otherwise("low"))


def run_severity(runs: DataFrame, signals: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Worst signal severity of every run, `low` when it has none."""
    keys = list(keys)
    worst = signals.groupBy(*keys).agg(F.max(severity_rank(F.col("severity"))).alias("rank"))
    return (
        runs.select(*keys)
        .distinct()
        .join(worst, keys, "left")
        .select(*keys, severity_label(F.coalesce(F.col("rank"), F.lit(0))).alias("severity"))
    )
