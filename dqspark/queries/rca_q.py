"""Root-cause hypotheses over the signals of all monthly runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqspark.operators import baseline as B
from dqspark.operators import ops as O
from dqspark.operators import rca as A
from dqspark.operators.joint import multivariate_mahalanobis
from dqspark.operators.scoring import number_signals
from dqspark.queries.base import RUNS_SQL, month_profiles, month_signals, month_source_runs, query, run_catalogue, with_sql
from dqspark.queries.drift_q import HISTORY_SQL, JOINT_SQL, STALE_SQL, fees
from dqspark.runtime import materialize

_TYPES = (*A.COLUMN_TYPES, *A.DATASET_TYPES)
_PICKS = ", ".join(
    f"arg_min(score, seq) FILTER (WHERE type = '{t}') AS s_{t}, arg_min(signal_id, seq) FILTER (WHERE type = '{t}') AS i_{t}" for t in _TYPES
)


def _rule(rule, column, when, confidence, ids, source):
    return (
        f"SELECT run_id, '{rule}' AS rule_id, {column} AS \"column\", ({confidence})::DOUBLE AS conf, concat_ws(',', {ids}) AS evidence, {{pos}} AS pos "
        f"FROM {source} WHERE {when}"
    )


_COLUMN_RULES = [
    ("schema_drop", "s_schema_missing_column IS NOT NULL", "CASE WHEN gone THEN least(0.99, s_schema_missing_column + 0.03) ELSE s_schema_missing_column END", "i_schema_missing_column"),
    ("schema_type_change", "s_schema_type_mismatch IS NOT NULL", "s_schema_type_mismatch", "i_schema_type_mismatch, i_semantic_drift"),
    ("scale_error", "s_range IS NOT NULL AND s_distribution IS NOT NULL", "least(0.99, greatest(s_range, s_distribution) + 0.05)", "i_range, i_distribution"),
    ("unexplained_distribution_shift", "s_distribution IS NOT NULL AND s_range IS NULL", "s_distribution * 0.8", "i_distribution"),
    ("scale_error", "s_range IS NOT NULL AND s_distribution IS NULL", "s_range", "i_range"),
    ("completeness_gap", "s_completeness IS NOT NULL", "s_completeness", "i_completeness"),
    ("freshness_sla_breach", "s_freshness IS NOT NULL", "s_freshness", "i_freshness"),
    ("stale_data", "s_staleness IS NOT NULL", "s_staleness", "i_staleness"),
    ("semantic_drift", "s_semantic_drift IS NOT NULL AND s_schema_type_mismatch IS NULL", "s_semantic_drift * 0.75", "i_semantic_drift"),
    ("column_relation_broken", "s_column_compare IS NOT NULL", "s_column_compare", "i_column_compare"),
    ("cardinality_drift", "s_cardinality_drift IS NOT NULL", "s_cardinality_drift * 0.5", "i_cardinality_drift"),
]
_DATASET_RULES = [
    ("row_count_bound", "s_row_count IS NOT NULL", "s_row_count", "i_row_count"),
    ("joint_distribution_shift", "s_multivariate_drift IS NOT NULL", "s_multivariate_drift * 0.8", "i_multivariate_drift"),
    ("duplicate_load", "s_volume IS NOT NULL AND u_score IS NOT NULL", "least(0.99, (s_volume + u_score) / 2 + 0.1)", "i_volume, u_id"),
    ("volume_shift", "s_volume IS NOT NULL AND u_score IS NULL", "s_volume * 0.7", "i_volume"),
]


def hypothesis_sql(signals: str = "sig", dropped: bool = True) -> str:
    gone = "\"column\" IN (SELECT \"column\" FROM dropped d WHERE d.run_id = fold.run_id)" if dropped else "FALSE"
    parts = [
        _rule(r, '"column"', f'"column" IS NOT NULL AND {w}', c, i, "colf").replace("{pos}", f"first_seq * 100 + 100 + {k}")
        for k, (r, w, c, i) in enumerate(_COLUMN_RULES)
    ]
    parts += [_rule(r, "NULL", w, c, i, "datf").replace("{pos}", str(k)) for k, (r, w, c, i) in enumerate(_DATASET_RULES)]
    drop_cte = (
        """dropped AS (SELECT t.run_id, k."column" FROM (SELECT DISTINCT run_id FROM catalogue) t
             JOIN (SELECT "column", min(run_id) AS first_run FROM catalogue GROUP BY 1) k ON k.first_run < t.run_id
             WHERE NOT EXISTS (SELECT 1 FROM catalogue c WHERE c.run_id = t.run_id AND c."column" = k."column")),"""
        if dropped
        else ""
    )
    return f"""{drop_cte}
fold AS (SELECT run_id, "column", min(seq) AS first_seq, {_PICKS} FROM {signals} GROUP BY run_id, "column"),
colf AS (SELECT *, {gone} AS gone FROM fold),
uniq AS (SELECT run_id, arg_min(s_uniqueness, first_seq) AS u_score, arg_min(i_uniqueness, first_seq) AS u_id FROM fold
         WHERE "column" IS NOT NULL AND s_uniqueness IS NOT NULL GROUP BY run_id),
datf AS (SELECT f.*, u_score, u_id FROM fold f LEFT JOIN uniq USING (run_id) WHERE f."column" IS NULL),
hyp AS ({' UNION ALL '.join(parts)}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY round(conf, 6) DESC, pos) AS "rank" FROM hyp)
"""


def schema_changes(spark, sf):
    columns = run_catalogue(spark, sf).withColumn("dataset", F.lit("orders"))
    return B.schema_diff(columns, month_source_runs(spark, sf)).drop("dataset")


def month_hypotheses(spark, sf):
    signals = materialize(month_signals(spark, sf))
    return signals, A.hypotheses(signals, schema_changes(spark, sf))


def _shown(found, *extra):
    return found.select(
        "run_id", "rule_id", "column", F.round("confidence", 6).alias("confidence"), F.array_join("evidence_ids", ",").alias("evidence"), *extra
    )


_COLUMNS = 'run_id, rule_id, "column", round(conf, 6) AS confidence, evidence'

_FROM_MONTHS = [
    "schema_drop",
    "schema_type_change",
    "scale_error",
    "unexplained_distribution_shift",
    "completeness_gap",
    "freshness_sla_breach",
    "semantic_drift",
    "column_relation_broken",
    "cardinality_drift",
    "row_count_bound",
    "duplicate_load",
    "volume_shift",
]
for _name in _FROM_MONTHS:
    query(f"hypothesis_{_name}", with_sql(f"SELECT {_COLUMNS} FROM hyp WHERE rule_id = '{_name}'", hypothesis_sql()))(
        lambda spark, sf, rule=_name: _shown(month_hypotheses(spark, sf)[1].filter(F.col("rule_id") == rule))
    )


@query("hypotheses", with_sql(f"SELECT {_COLUMNS} FROM hyp", hypothesis_sql()))
def every_hypothesis(spark, sf):
    return _shown(month_hypotheses(spark, sf)[1])


@query(
    "hypothesis_stale_data",
    with_sql(
        f"SELECT {_COLUMNS} FROM hyp WHERE rule_id = 'stale_data'",
        ",".join([RUNS_SQL, HISTORY_SQL, STALE_SQL])
        + ", late AS (SELECT run_id, 0 AS seq, run_id || ':0' AS signal_id, 'staleness' AS type, \"column\", round(raw::DECIMAL(28,10), 4)::DOUBLE AS score FROM stale),"
        + hypothesis_sql("late", dropped=False),
    ),
)
def stale(spark, sf):
    signals = B.learned_staleness(materialize(month_source_runs(spark, sf)), materialize(month_profiles(spark, sf)), ["o_orderdate"])
    return _shown(A.hypotheses(number_signals(signals, ["run_id"])))


@query(
    "hypothesis_joint_distribution_shift",
    f"""WITH {JOINT_SQL}, one AS (SELECT 'lines' AS run_id, 0 AS seq, 'lines:0' AS signal_id, 'multivariate_drift' AS type, NULL::VARCHAR AS "column",
          round(least(1.0, 0.5 + round((hits / n)::DECIMAL(28,10), 4)), 4)::DOUBLE AS score FROM flag),
        {hypothesis_sql("one", dropped=False)} SELECT {_COLUMNS} FROM hyp""",
)
def joint(spark, sf):
    signal = multivariate_mahalanobis(fees(spark, sf, False), fees(spark, sf, True), columns=["price", "fee"])
    return _shown(A.hypotheses(number_signals(signal.withColumn("run_id", F.lit("lines")), ["run_id"])))


@query(
    "rank_hypotheses",
    with_sql(
        f"""SELECT {_COLUMNS}, "rank"::INTEGER AS "rank", CASE WHEN round(conf, 6) >= 0.4 AND "rank" <= 3 THEN 'strong' ELSE 'uncertain' END AS verdict FROM ranked""",
        hypothesis_sql(),
    ),
)
def ranked(spark, sf):
    strong, uncertain = A.rank_hypotheses(month_hypotheses(spark, sf)[1])
    parts = [_shown(f, "rank", F.lit(v).alias("verdict")) for f, v in ((strong, "strong"), (uncertain, "uncertain"))]
    return parts[0].unionByName(parts[1])


REPORT_SQL = """
rep AS (SELECT s.run_id, CASE max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) WHEN 4 THEN 'critical' WHEN 3 THEN 'high'
          WHEN 2 THEN 'medium' ELSE 'low' END AS severity, count(*) AS signal_count,
          (SELECT any_value(rule_id) FROM ranked r WHERE r.run_id = s.run_id AND "rank" = 1 AND round(conf, 6) >= 0.4) AS top_rule,
          coalesce((SELECT any_value(round(conf, 6)) FROM ranked r WHERE r.run_id = s.run_id AND "rank" = 1 AND round(conf, 6) >= 0.4), 0.0)::DOUBLE AS top_confidence,
          (SELECT count(*) FROM ranked r WHERE r.run_id = s.run_id AND "rank" <= 3 AND round(conf, 6) >= 0.4) AS causes,
          (SELECT count(*) FROM ranked r WHERE r.run_id = s.run_id AND NOT ("rank" <= 3 AND round(conf, 6) >= 0.4)) AS uncertainties
        FROM sig s GROUP BY s.run_id)
"""


@query("incident_reports", with_sql("SELECT * FROM rep", hypothesis_sql() + "," + REPORT_SQL))
def incident_reports(spark, sf):
    signals, found = month_hypotheses(spark, sf)
    return A.reports(signals, found).drop("top_column").withColumn("top_confidence", F.round("top_confidence", 6))


_DRAFTS = ", ".join(
    f"('{rule}', {i}, '{kind}', {str(needs).upper()}, '{text}')" for rule, drafts in A.ACTIONS.items() for i, (kind, needs, text) in enumerate(drafts)
)
ACTION_SQL = f"""
drafts AS (SELECT r.run_id, r.rule_id, r."column", t.no AS action_no, t.type, t.description, t.needs AS requires_approval
  FROM ranked r JOIN (VALUES {_DRAFTS}) t(rule, no, type, needs, description) ON t.rule = r.rule_id WHERE r."rank" = 1 AND round(r.conf, 6) >= 0.4)
"""


@query("recommended_actions", with_sql("SELECT * FROM drafts", hypothesis_sql() + "," + ACTION_SQL))
def actions(spark, sf):
    strong, _ = A.rank_hypotheses(month_hypotheses(spark, sf)[1])
    return A.recommended_actions(strong)


@query(
    "sync_actions",
    with_sql(
        """SELECT run_id AS incident_id, type, description, bool_or(requires_approval) AS requires_approval,
             CASE WHEN run_id < '1998' THEN CASE WHEN any_value(type) = 'sql_patch' THEN 'rejected' ELSE 'approved' END ELSE 'pending' END AS status
           FROM drafts GROUP BY run_id, type, description
           UNION ALL SELECT DISTINCT run_id, 'alert', 'call the owner', FALSE, 'pending' FROM drafts""",
        hypothesis_sql() + "," + ACTION_SQL,
    ),
)
def synced(spark, sf):
    """Early incidents were decided: first approved, then patches rejected; every incident has one older action."""
    strong, _ = A.rank_hypotheses(month_hypotheses(spark, sf)[1])
    drafts = materialize(A.recommended_actions(strong)).withColumnRenamed("run_id", "incident_id")
    keys = ["incident_id", "type", "description"]
    existing = drafts.select("incident_id", F.lit("alert").alias("type"), F.lit("call the owner").alias("description"), F.lit(False).alias("requires_approval")).distinct()
    early = drafts.filter("incident_id < '1998'")
    first = early.select(*keys, F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"), F.lit("approve").alias("decision"))
    later = early.filter("type = 'sql_patch'").select(*keys, F.lit("2024-01-02").cast("timestamp_ntz").alias("ts"), F.lit("reject").alias("decision"))
    return O.sync_actions(drafts, existing, first.unionByName(later))


@query(
    "validate_evidence",
    with_sql(
        """SELECT run_id, 'accepted' AS verdict, signal_id AS hypothesis_id, round(least(1.0, score * 1.2), 6)::DOUBLE AS confidence FROM (
             SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY least(1.0, score * 1.2) DESC, signal_id) AS k FROM sig WHERE severity <> 'medium') WHERE k <= 3
           UNION ALL SELECT run_id, 'unverified', signal_id, NULL FROM sig WHERE severity = 'medium'"""
    ),
)
def verified(spark, sf):
    """An outside author proposes one hypothesis per signal, too confident and with made-up ids; those about
    medium signals have nothing but made-up ids."""
    signals = materialize(month_signals(spark, sf))
    invented = F.concat(F.col("run_id"), F.lit(":x"))
    proposed = signals.select(
        "run_id",
        F.col("signal_id").alias("hypothesis_id"),
        F.concat(F.lit("because of "), F.col("type")).alias("text"),
        (F.col("score") * 1.2).alias("confidence"),
        F.when(F.col("severity") == "medium", F.array(invented)).otherwise(F.array(invented, F.col("signal_id"))).alias("evidence_ids"),
    )
    accepted, unverified = A.validate_evidence(proposed, signals)
    left = accepted.select("run_id", F.lit("accepted").alias("verdict"), "hypothesis_id", F.round("confidence", 6).alias("confidence"))
    right = unverified.select("run_id", F.lit("unverified").alias("verdict"), "hypothesis_id", F.lit(None).cast("double").alias("confidence"))
    return left.unionByName(right)


@query("replay_rca", with_sql("SELECT DISTINCT run_id, run_id < '2000' AS matches FROM sig"))
def replay(spark, sf):
    """Stored reports of 2000 and later were tampered with."""
    signals = materialize(month_signals(spark, sf))
    stored = A.reports(signals, A.hypotheses(signals))
    tampered = stored.withColumn("top_confidence", F.when(F.col("run_id") >= "2000", F.lit(0.123)).otherwise(F.col("top_confidence")))
    return A.replay_rca(signals, materialize(tampered))


