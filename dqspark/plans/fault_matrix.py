"""Fault catalogue x detectors: prove that each corruption is found and explained."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqspark.operators.drift import detect
from dqspark.operators.faults import apply_change, apply_fault, changed_copies, fault_change
from dqspark.operators.ops import detection_cases
from dqspark.operators.profile import profile_table
from dqspark.operators.rca import hypotheses, rank_hypotheses
from dqspark.runtime import materialize

# What each fault must raise, its root-cause rule and the least confidence.
EXPECTED = {
    "F01": (["schema_missing_column"], "schema_drop", 0.85),
    "F02": (["schema_type_mismatch"], "schema_type_change", 0.85),
    "F03": (["completeness"], "completeness_gap", 0.85),
    "F04": (["volume", "uniqueness"], "duplicate_load", 0.85),
    "F05": (["range", "distribution"], "scale_error", 0.90),
    "F06": (["freshness"], "freshness_sla_breach", 0.60),
}


def expected_cases(spark) -> DataFrame:
    """(run_id, expected_types, expected_rule, min_confidence)."""
    rows = [(fault, *case) for fault, case in EXPECTED.items()]
    schema = "run_id string, expected_types array<string>, expected_rule string, min_confidence double"
    return spark.createDataFrame(rows, schema)


def fault_signals(
    df: DataFrame, contract: Mapping, columns: Mapping[str, str], as_of, base_profiles: DataFrame | None = None, faults=tuple(EXPECTED)
) -> DataFrame:
    """Signals of every faulted copy of the table, run_id = fault id; the clean table is the baseline.

    Copies that keep the schema are runs of one table: they are made from one scan, checked and profiled together. A
    fault that changes the schema is a branch of its own.
    """
    if base_profiles is None:
        base_profiles = materialize(profile_table(df, parts=("distinct",)))
    merged, changes = None, {}

    def judged(rows: DataFrame, names) -> DataFrame:
        runs = F.explode(F.array(*[F.lit(fault) for fault in names]))
        return detect(rows, contract, base_profiles.withColumn("run_id", runs), as_of, runs=["run_id"], copies=names)

    for fault in faults:
        change = fault_change(df, fault, columns)
        broken = apply_fault(df, fault, columns) if change is None else apply_change(df, change)
        if change is not None and broken.dtypes == df.dtypes:
            changes[fault] = change
        else:
            signals = judged(broken.withColumn("run_id", F.lit(fault)), [fault])
            merged = signals if merged is None else merged.unionByName(signals)
    if changes:
        signals = judged(changed_copies(df, changes), list(changes))
        merged = signals if merged is None else merged.unionByName(signals)
    return merged


def fault_cases(df: DataFrame, contract: Mapping, columns: Mapping[str, str], as_of) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(expected cases, signals, strong hypotheses) of the whole catalogue, the signals stored once."""
    signals = materialize(fault_signals(df, contract, columns, as_of))
    strong, _ = rank_hypotheses(hypotheses(signals))
    return expected_cases(df.sparkSession), signals, strong


def fault_matrix(df: DataFrame, contract: Mapping, columns: Mapping[str, str], as_of) -> DataFrame:
    """(fault_id, observed types, missing types, top rule and confidence, verdict) per fault."""
    judged = detection_cases(*fault_cases(df, contract, columns, as_of))
    shown = ("observed_types", "missing_types", "top_rule", "top_confidence", "passed")
    return judged.select(F.col("run_id").alias("fault_id"), *shown)
