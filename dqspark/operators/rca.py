"""Root-cause rules over a signals table: all runs in one pass.

Signals are folded to one row per (run, column) that keeps the first signal of each type, then to one row per
run for the dataset-level rules. A run holds at most a few signals per column, so every group is bounded by
the schema.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dqspark.functions.columns import severity_label, severity_rank

MIN_CONFIDENCE = 0.4
MAX_HYPOTHESES = 3

# Signal types the rules read.
COLUMN_TYPES = (
    "schema_missing_column",
    "schema_type_mismatch",
    "range",
    "distribution",
    "completeness",
    "freshness",
    "staleness",
    "semantic_drift",
    "column_compare",
    "cardinality_drift",
    "uniqueness",
)
DATASET_TYPES = ("row_count", "multivariate_drift", "volume")

# Action drafts per rule, (action type, needs approval, what to do).
ACTIONS = {
    "schema_drop": [("dbt_test", False, "add a column existence test")],
    "schema_type_change": [
        ("dbt_test", False, "add a data type test"),
        ("sql_patch", True, "review the upstream schema and the type conversion"),
    ],
    "scale_error": [
        ("sql_patch", True, "correct the scale of the column"),
        ("dbt_test", False, "add a range test"),
    ],
    "completeness_gap": [("dbt_test", False, "add a not_null test")],
    "duplicate_load": [
        ("sql_patch", True, "remove the duplicate rows"),
        ("dbt_test", False, "add a uniqueness test"),
    ],
    "freshness_sla_breach": [("alert", False, "review the freshness limit")],
    "unexplained_distribution_shift": [("dbt_test", True, "confirm the shift or accept a new baseline")],
    "volume_shift": [("dbt_test", False, "review the volume baseline")],
    "semantic_drift": [("dbt_test", True, "extend the allowed values or confirm the change")],
    "cardinality_drift": [("dbt_test", False, "watch the number of distinct values")],
    "joint_distribution_shift": [("dbt_test", False, "add a relation test and review the last join or transformation")],
    "stale_data": [("alert", False, "check the last load and the source system")],
    "row_count_bound": [("alert", False, "check the source and filters of the load and the row limits")],
    "column_relation_broken": [("dbt_test", False, "add a test of the relation between the columns")],
}

HYPOTHESIS = "struct<position:bigint,rule_id:string,column:string,confidence:double,evidence_ids:array<string>>"


def _first(kind: str) -> Column:
    """First signal of a type in report order, as (score, id), null when there is none."""
    hit = F.col("type") == kind
    return F.min_by(F.when(hit, F.struct("score", "signal_id")), F.when(hit, F.col("seq")))


def _hypothesis(position, rule_id: str, column: Column, when: Column, confidence: Column, *ids: Column) -> Column:
    known = F.filter(F.array(*ids), lambda i: i.isNotNull())
    return F.when(
        when,
        F.struct(
            position.cast("bigint").alias("position"),
            F.lit(rule_id).alias("rule_id"),
            column.cast("string").alias("column"),
            confidence.cast("double").alias("confidence"),
            known.alias("evidence_ids"),
        ).cast(HYPOTHESIS),
    )


def _score(kind: str) -> Column:
    return F.col(kind)["score"]


def _id(kind: str) -> Column:
    return F.col(kind)["signal_id"]


def _has(kind: str) -> Column:
    return F.col(kind).isNotNull()


def _column_rules(dropped: Column) -> list[Column]:
    """Candidates of one column, in rule order; the position ranks columns by their first signal."""
    column = F.col("column")

    def at(k: int) -> Column:
        return F.col("first_seq") * 100 + 100 + k

    both = _has("range") & _has("distribution")
    capped = F.least(F.lit(0.99), F.greatest(_score("range"), _score("distribution")) + 0.05)
    drop_score = F.when(dropped, F.least(F.lit(0.99), _score("schema_missing_column") + 0.03)).otherwise(
        _score("schema_missing_column")
    )
    absorbed = _has("schema_type_mismatch")
    return [
        _hypothesis(at(0), "schema_drop", column, _has("schema_missing_column"), drop_score, _id("schema_missing_column")),
        _hypothesis(
            at(1),
            "schema_type_change",
            column,
            absorbed,
            _score("schema_type_mismatch"),
            _id("schema_type_mismatch"),
            _id("semantic_drift"),
        ),
        _hypothesis(at(2), "scale_error", column, both, capped, _id("range"), _id("distribution")),
        _hypothesis(
            at(3),
            "unexplained_distribution_shift",
            column,
            _has("distribution") & ~_has("range"),
            _score("distribution") * 0.8,
            _id("distribution"),
        ),
        _hypothesis(at(4), "scale_error", column, _has("range") & ~_has("distribution"), _score("range"), _id("range")),
        _hypothesis(at(5), "completeness_gap", column, _has("completeness"), _score("completeness"), _id("completeness")),
        _hypothesis(at(6), "freshness_sla_breach", column, _has("freshness"), _score("freshness"), _id("freshness")),
        _hypothesis(at(7), "stale_data", column, _has("staleness"), _score("staleness"), _id("staleness")),
        _hypothesis(
            at(8),
            "semantic_drift",
            column,
            _has("semantic_drift") & ~absorbed,
            _score("semantic_drift") * 0.75,
            _id("semantic_drift"),
        ),
        _hypothesis(
            at(9), "column_relation_broken", column, _has("column_compare"), _score("column_compare"), _id("column_compare")
        ),
        _hypothesis(
            at(10),
            "cardinality_drift",
            column,
            _has("cardinality_drift"),
            _score("cardinality_drift") * 0.5,
            _id("cardinality_drift"),
        ),
    ]


def _dataset_rules() -> list[Column]:
    nothing = F.lit(None)
    volume, unique = F.col("volume"), F.col("unique")
    doubled = F.least(F.lit(0.99), (volume["score"] + unique["score"]) / 2 + 0.1)
    return [
        _hypothesis(F.lit(0), "row_count_bound", nothing, _has("row_count"), _score("row_count"), _id("row_count")),
        _hypothesis(
            F.lit(1),
            "joint_distribution_shift",
            nothing,
            _has("multivariate_drift"),
            _score("multivariate_drift") * 0.8,
            _id("multivariate_drift"),
        ),
        _hypothesis(
            F.lit(2),
            "duplicate_load",
            nothing,
            volume.isNotNull() & unique.isNotNull(),
            doubled,
            volume["signal_id"],
            unique["signal_id"],
        ),
        _hypothesis(
            F.lit(3), "volume_shift", nothing, volume.isNotNull() & unique.isNull(), volume["score"] * 0.7, volume["signal_id"]
        ),
    ]


def hypotheses(signals: DataFrame, schema_changes: DataFrame | None = None, runs: Sequence[str] = ("run_id",)) -> DataFrame:
    """(runs…, position, rule_id, column, confidence, evidence_ids), unranked.

    `schema_changes(run_id, column, change)` supports the dropped-column rule.
    """
    runs = list(runs)
    by_column = (
        signals.groupBy(*runs, "column")
        .agg(F.min("seq").alias("first_seq"), *[_first(t).alias(t) for t in (*COLUMN_TYPES, *DATASET_TYPES)])
    )
    dropped = F.lit(False)
    columns = by_column.filter("column is not null")
    if schema_changes is not None:
        gone = schema_changes.filter("change = 'dropped'").select(*runs, "column", F.lit(True).alias("dropped")).distinct()
        columns = columns.join(gone, [*runs, "column"], "left")
        dropped = F.coalesce(F.col("dropped"), F.lit(False))
    level_column = columns.select(*runs, F.explode(F.filter(F.array(*_column_rules(dropped)), lambda h: h.isNotNull())).alias("h"))
    # Dataset rules: signals without a column, plus the uniqueness signal of the earliest signalled column.
    level_dataset = (
        by_column.groupBy(*runs)
        .agg(
            *[F.first(F.when(F.col("column").isNull(), F.col(t)), ignorenulls=True).alias(t) for t in DATASET_TYPES],
            F.min_by(
                "uniqueness",
                F.when(F.col("column").isNotNull() & F.col("uniqueness").isNotNull(), F.col("first_seq")),
            ).alias("unique"),
        )
        .select(*runs, F.explode(F.filter(F.array(*_dataset_rules()), lambda h: h.isNotNull())).alias("h"))
    )
    found = level_dataset.unionByName(level_column).select(*runs, "h.*")
    return found.withColumn("confidence", F.round("confidence", 6))


def rank_hypotheses(
    found: DataFrame,
    min_confidence: float = MIN_CONFIDENCE,
    k: int = MAX_HYPOTHESES,
    runs: Sequence[str] = ("run_id",),
) -> tuple[DataFrame, DataFrame]:
    """(strong, uncertain): at most k per run at or above the limit, ties in rule order; the rest stays
    visible as uncertainty."""
    window = Window.partitionBy(*runs).orderBy(F.col("confidence").desc(), "position")
    ranked = found.withColumn("rank", F.row_number().over(window))
    strong = (F.col("confidence") >= min_confidence) & (F.col("rank") <= k)
    return ranked.filter(strong), ranked.filter(~strong)


def reports(signals: DataFrame, found: DataFrame, runs: Sequence[str] = ("run_id",)) -> DataFrame:
    """(runs…, severity, top_rule, top_column, top_confidence, causes, uncertainties): one row per run with signals."""
    runs = list(runs)
    strong, uncertain = rank_hypotheses(found, runs=runs)
    worst = signals.groupBy(*runs).agg(
        severity_label(F.max(severity_rank(F.col("severity")))).alias("severity"), F.count(F.lit(1)).alias("signal_count")
    )
    top = strong.groupBy(*runs).agg(
        F.min_by(F.struct("rule_id", "column", "confidence"), "rank").alias("t"), F.count(F.lit(1)).alias("causes")
    )
    rest = uncertain.groupBy(*runs).agg(F.count(F.lit(1)).alias("uncertainties"))
    return (
        worst.join(top, runs, "left")
        .join(rest, runs, "left")
        .select(
            *runs,
            "severity",
            "signal_count",
            F.col("t.rule_id").alias("top_rule"),
            F.col("t.column").alias("top_column"),
            F.coalesce(F.col("t.confidence"), F.lit(0.0)).alias("top_confidence"),
            F.coalesce("causes", F.lit(0)).alias("causes"),
            F.coalesce("uncertainties", F.lit(0)).alias("uncertainties"),
        )
    )


def recommended_actions(strong: DataFrame, runs: Sequence[str] = ("run_id",)) -> DataFrame:
    """Action drafts of each run's top hypothesis. The template list has a fixed size."""
    rows = [
        (rule_id, i, kind, needs, text)
        for rule_id, drafts in ACTIONS.items()
        for i, (kind, needs, text) in enumerate(drafts)
    ]
    schema = "rule_id string, action_no int, type string, requires_approval boolean, description string"
    templates = strong.sparkSession.createDataFrame(rows, schema)
    top = strong.filter("rank = 1").select(*runs, "rule_id", "column")
    return top.join(F.broadcast(templates), "rule_id").select(
        *runs, "rule_id", "column", "action_no", "type", "description", "requires_approval"
    )


def validate_evidence(
    proposed: DataFrame, signals: DataFrame, k: int = MAX_HYPOTHESES, runs: Sequence[str] = ("run_id",)
) -> tuple[DataFrame, DataFrame]:
    """(accepted, unverified) of hypotheses from any author.

    `proposed(runs…, hypothesis_id, text, confidence, evidence_ids)`. Evidence ids must be signals of the same
    run; a hypothesis without any valid id is unverified. Confidence is clamped, at most k per run remain.
    """
    runs = list(runs)
    usable = proposed.filter(F.col("confidence").isNotNull() & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    exploded = usable.select(*runs, "hypothesis_id", F.posexplode("evidence_ids").alias("_pos", "signal_id"))
    known = (
        exploded.join(signals.select(*runs, "signal_id").distinct(), [*runs, "signal_id"], "left_semi")
        .groupBy(*runs, "hypothesis_id")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("_pos", "signal_id"))), lambda x: x["signal_id"]).alias("verified_ids"))
    )
    joined = usable.join(known, [*runs, "hypothesis_id"], "left")
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))
    window = Window.partitionBy(*runs).orderBy(F.col("confidence").desc(), "hypothesis_id")
    accepted = (
        joined.filter("verified_ids is not null")
        .withColumn("confidence", clamped)
        .withColumn("rank", F.row_number().over(window))
        .filter(F.col("rank") <= k)
        .select(*runs, "rank", "hypothesis_id", "text", "confidence", "verified_ids")
    )
    return accepted, joined.filter("verified_ids is null").select(*runs, "hypothesis_id", "text")


def replay_rca(signals: DataFrame, stored: DataFrame, runs: Sequence[str] = ("run_id",)) -> DataFrame:
    """(runs…, matches): reports recomputed from stored signals against the stored reports."""
    runs = list(runs)
    fresh = reports(signals, hypotheses(signals, runs=runs), runs)
    facts = [c for c in fresh.columns if c not in runs and c in stored.columns]
    now = fresh.select(*runs, F.struct(*facts).alias("now"))
    old = stored.select(*runs, F.struct(*facts).alias("old"))
    return now.join(old, runs, "full_outer").select(*runs, F.col("now").eqNullSafe(F.col("old")).alias("matches"))
