"""Operations reports; customers act as sources, events and orders as runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqspark.operators import ops as O
from dqspark.operators import rca as A
from dqspark.operators.scoring import incident_risk
from dqspark.queries.base import RUNS_SQL, SEVERITY_SQL, month_profiles, month_signals, month_source_runs, query, table, with_sql
from dqspark.queries.rca_q import REPORT_SQL, hypothesis_sql, schema_changes
from dqspark.runtime import materialize


@query(
    "metric_history",
    with_sql(
        """SELECT r.run_id, r.run_ts, r.total_rows AS "rows", (SELECT count(*) FROM sig s WHERE s.run_id = r.run_id) AS signals, r.quality, p."column", p.null_ratio,
             round(p.mean::DECIMAL(28,6), 3)::DOUBLE AS mean FROM runs r JOIN p USING (run_id)
           WHERE r.config_hash = (SELECT config_hash FROM runs ORDER BY run_ts DESC LIMIT 1)""",
        RUNS_SQL,
    ),
)
def history(spark, sf):
    runs, profiles = month_source_runs(spark, sf), month_profiles(spark, sf)
    return O.metric_history(runs, profiles, month_signals(spark, sf)).drop("source_id").withColumn("mean", F.round("mean", 3))


@query(
    "metric_history_columns",
    with_sql("""SELECT DISTINCT 'orders' AS source_id, "column" FROM p WHERE mean IS NOT NULL"""),
)
def history_columns(spark, sf):
    return O.history_columns(O.metric_history(month_source_runs(spark, sf), month_profiles(spark, sf)))


def event_runs(spark, sf):
    """Each event is an analysis of its user: errors failed, sign-ups are pending."""
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "pending").otherwise("success")
    return table(spark, sf, "events").select(F.col("user_id").alias("source_id"), F.col("ts").alias("run_ts"), status.alias("status"))


def user_sources(spark, sf):
    """Each customer is a source; the nation sets the schedule, nation 0 runs by hand."""
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("source_id"),
        (F.col("c_nationkey") * 240).alias("schedule_minutes"),
        F.lit("2024-01-29 12:00:00").cast("timestamp_ntz").alias("created_at"),
    )


AS_OF = "2024-01-31 00:00:00"

COMPLIANCE_SQL = f"""
src AS (SELECT c_custkey AS source_id, c_nationkey * 240 AS schedule_minutes, TIMESTAMP '2024-01-29 12:00:00' AS created_at FROM customer),
ok AS (SELECT user_id AS source_id, max(ts) AS last_success FROM events WHERE event_type NOT IN ('error', 'signup') GROUP BY 1),
age AS (SELECT source_id, schedule_minutes, last_success, date_diff('microsecond', coalesce(last_success, created_at), TIMESTAMP '{AS_OF}') / 6e7 AS age
        FROM src LEFT JOIN ok USING (source_id)),
comp AS (SELECT source_id, schedule_minutes, last_success, CASE WHEN schedule_minutes > 0 THEN round(age, 1) END AS age_minutes,
           CASE WHEN schedule_minutes = 0 THEN 'manual' WHEN age > 2 * schedule_minutes + 10 THEN 'stalled' WHEN last_success IS NOT NULL THEN 'ok' ELSE 'waiting' END AS state FROM age)
"""


@query("schedule_compliance", f"WITH {COMPLIANCE_SQL} SELECT * FROM comp")
def compliance(spark, sf):
    return O.schedule_compliance(user_sources(spark, sf), event_runs(spark, sf), AS_OF)


@query(
    "monitoring_status",
    f"""WITH {COMPLIANCE_SQL},
        facts AS (SELECT (SELECT count(*) FROM comp WHERE state = 'stalled') AS stalled, (SELECT count(*) FROM comp WHERE state <> 'manual') AS scheduled,
          (SELECT count(*) FROM events WHERE event_type = 'signup') AS pending,
          (SELECT count(*) FROM events WHERE event_type = 'signup' AND ts < TIMESTAMP '{AS_OF}' - INTERVAL {O.BACKLOG_MINUTES} MINUTE) AS old,
          (SELECT count(*) FROM (SELECT user_id, max(ts) AS seen FROM events GROUP BY 1) WHERE seen >= TIMESTAMP '{AS_OF}' - INTERVAL 90 MINUTE) AS alive)
        SELECT CASE WHEN alive = 0 AND (pending > 0 OR scheduled > 0) THEN 'down' WHEN stalled > 0 OR old > 0 THEN 'degraded' ELSE 'ok' END AS status,
          stalled, pending, alive FROM facts""",
)
def monitoring(spark, sf):
    runs = event_runs(spark, sf)
    beats = runs.groupBy(F.col("source_id").alias("worker")).agg(F.max("run_ts").alias("last_seen"))
    return O.monitoring_status(O.schedule_compliance(user_sources(spark, sf), runs, AS_OF), runs, beats, AS_OF, ttl_seconds=5400)


def user_signals(spark, sf):
    """Each event is a signal of its user's daily run."""
    score = F.least(F.lit(1.0), F.col("value") / 200)
    return table(spark, sf, "events").select(
        F.col("user_id").alias("source_id"),
        F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("run_id"),
        F.to_date("ts").cast("timestamp_ntz").alias("run_ts"),
        F.col("event_type").alias("type"),
        F.when(F.col("event_type") != "view", "value").alias("column"),
        F.when(score >= 0.85, "critical").when(score >= 0.65, "high").when(score >= 0.4, "medium").otherwise("low").alias("severity"),
    )


def user_mutes(spark, sf):
    """Clicks are muted for everyone until a date set by the nation, purchases on one column only."""
    days = F.make_dt_interval(F.col("c_nationkey"))
    until = F.lit("2024-01-05").cast("timestamp_ntz") + days
    entries = F.array(
        F.struct(F.lit("click").alias("type"), F.lit(None).cast("string").alias("column")),
        F.struct(F.lit("purchase").alias("type"), F.lit("value").alias("column")),
        F.struct(F.lit("error").alias("type"), F.lit("other").alias("column")),
    )
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("source_id"), F.inline(entries), until.alias("until"))


MUTE_SQL = """
mu AS (SELECT c_custkey AS source_id, TIMESTAMP '2024-01-05' + to_days(c_nationkey) AS until FROM customer),
us AS (SELECT user_id AS source_id, user_id || '/' || strftime(ts, '%Y-%m-%d') AS run_id, event_type IN ('click', 'purchase') AND mu.until > ts::DATE AS muted,
         CASE WHEN "value" / 200 >= 0.85 THEN 4 WHEN "value" / 200 >= 0.65 THEN 3 WHEN "value" / 200 >= 0.4 THEN 2 ELSE 1 END AS sev
       FROM events LEFT JOIN mu ON mu.source_id = user_id)
"""


@query(
    "active_mutes",
    """SELECT c_custkey AS source_id, t.type, TIMESTAMP '2024-01-05' + to_days(c_nationkey) AS until FROM customer, (VALUES ('click'), ('purchase'), ('error')) t(type)
       WHERE TIMESTAMP '2024-01-05' + to_days(c_nationkey) > TIMESTAMP '2024-01-15'""",
)
def mutes(spark, sf):
    return O.active_mutes(user_mutes(spark, sf), "2024-01-15 00:00:00").select("source_id", "type", "until")


@query(
    "muted_runs",
    f"WITH {MUTE_SQL} SELECT source_id, run_id, count(*) AS signals, bool_and(coalesce(muted, false)) AS muted FROM us GROUP BY 1, 2",
)
def muted(spark, sf):
    return O.muted_runs(user_signals(spark, sf), user_mutes(spark, sf))


@query(
    "notification_queue",
    f"""WITH {MUTE_SQL} SELECT source_id, run_id, ['low', 'medium', 'high', 'critical'][max(sev)] AS severity, count(*) AS signal_count
        FROM us GROUP BY 1, 2 HAVING NOT bool_and(coalesce(muted, false))""",
)
def queue(spark, sf):
    return O.notification_queue(user_signals(spark, sf), user_mutes(spark, sf))


@query(
    "latest_state",
    """SELECT entity_id, ts, decision, actor FROM (SELECT o_custkey AS entity_id, o_orderdate AS ts, o_orderstatus AS decision, o_orderpriority AS actor,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderstatus DESC, o_orderpriority DESC) AS k FROM orders) WHERE k = 1""",
)
def latest(spark, sf):
    log = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("entity_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderstatus").alias("decision"), F.col("o_orderpriority").alias("actor")
    )
    return O.latest_state(log, ["entity_id"])


@query(
    "outcome_metrics",
    """WITH fb AS (SELECT l_orderkey AS run_id, arg_max(v, (l_shipdate, v)) AS verdict FROM (
         SELECT l_orderkey, l_shipdate, CASE l_returnflag WHEN 'R' THEN 'false_positive' WHEN 'A' THEN 'resolved' ELSE 'correct_cause' END AS v FROM lineitem) GROUP BY 1)
       SELECT count(*) AS observations, count(*) FILTER (WHERE o_totalprice > 400000) AS incidents, count(verdict) AS reviewed,
         count(*) FILTER (WHERE verdict = 'false_positive') AS false_positive_reviews, count(*) FILTER (WHERE verdict = 'resolved') AS resolved_reviews,
         (SELECT count(*) FROM lineitem) AS repair_attempts, (SELECT count(*) FROM lineitem WHERE l_linestatus = 'F') AS validated_repairs,
         round(median(o_totalprice), 6) AS median_scan_seconds FROM orders LEFT JOIN fb ON fb.run_id = o_orderkey""",
)
def outcomes(spark, sf):
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    runs = orders.select(F.col("o_orderkey").alias("run_id"), F.col("o_totalprice").alias("duration_s"))
    signals = orders.filter("o_totalprice > 400000").select(F.col("o_orderkey").alias("run_id"))
    verdict = F.when(F.col("l_returnflag") == "R", "false_positive").when(F.col("l_returnflag") == "A", "resolved").otherwise("correct_cause")
    feedback = lines.select(F.col("l_orderkey").alias("run_id"), F.col("l_shipdate").alias("ts"), verdict.alias("verdict"))
    repairs = lines.select((F.col("l_linestatus") == "F").alias("passed"))
    return O.outcome_metrics(runs, signals, feedback, repairs)


@query(
    "list_incidents",
    with_sql(
        """SELECT rep.run_id, rep.severity, rep.signal_count, rep.top_rule, r.run_ts, CASE WHEN rep.run_id < '1999' THEN 'closed' END AS triage
           FROM rep JOIN runs r USING (run_id) WHERE rep.severity = 'critical'""",
        ",".join([RUNS_SQL, hypothesis_sql(), REPORT_SQL]),
    ),
)
def incidents(spark, sf):
    signals = materialize(month_signals(spark, sf))
    reports = A.reports(signals, A.hypotheses(signals, schema_changes(spark, sf)))
    triage = signals.filter("run_id < '1999'").select("run_id", F.lit("closed").alias("status")).distinct()
    found = O.list_incidents(reports, month_source_runs(spark, sf), triage, severity="critical")
    return found.select("run_id", "severity", "signal_count", "top_rule", "run_ts", "triage")


@query(
    "list_observations",
    with_sql(
        """SELECT run_id, run_ts, quality, total_rows, (SELECT count(*) FROM sig s WHERE s.run_id = r.run_id) AS signals
           FROM runs r""",
        RUNS_SQL,
    ),
)
def observations(spark, sf):
    found = O.list_observations(month_source_runs(spark, sf), month_signals(spark, sf), source_id="orders")
    return found.select("run_id", "run_ts", "quality", "total_rows", "signals")


@query(
    "list_datasets",
    with_sql(
        """SELECT 'orders' AS dataset, 7::BIGINT AS columns, count(*) AS runs, max(run_id) AS latest_run, max(run_ts) AS latest_ts, 'success' AS latest_status FROM runs""",
        RUNS_SQL,
    ),
)
def datasets(spark, sf):
    profiles = month_profiles(spark, sf).withColumn("dataset", F.lit("orders"))
    return O.list_datasets(profiles, month_source_runs(spark, sf))


@query(
    "timeline",
    """WITH e AS (SELECT o_orderkey AS event_id, o_custkey AS source_id, o_orderdate AS created_at, o_orderstatus AS kind FROM orders)
       , t AS (SELECT 'run/' || c_custkey AS run_id, event_id, created_at, kind FROM customer JOIN e ON e.source_id = c_custkey
       UNION SELECT 'run/' || c_custkey, event_id, created_at, kind FROM customer JOIN e ON e.source_id = c_custkey + 1)
       SELECT run_id, event_id, created_at, kind FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY created_at DESC, event_id) AS k FROM t)""",
)
def timeline(spark, sf):
    events = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("event_id"),
        F.col("o_custkey").alias("source_id"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderstatus").alias("kind"),
        F.array(F.concat(F.lit("c:"), F.col("o_custkey").cast("string"))).alias("assets"),
    )
    scope = table(spark, sf, "customer").select(
        F.concat(F.lit("run/"), F.col("c_custkey").cast("string")).alias("run_id"),
        F.col("c_custkey").alias("source_id"),
        F.concat(F.lit("c:"), (F.col("c_custkey") + 1).cast("string")).alias("asset"),
    )
    return O.timeline(events, scope)


@query(
    "content_digest",
    """SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_nationkey":' || c_nationkey || '}') AS digest FROM customer""",
)
def digests(spark, sf):
    rows = table(spark, sf, "customer").withColumn("schedule_minutes", F.lit(5))
    return O.content_digest(rows, ["c_nationkey", "c_custkey", "c_mktsegment", "schedule_minutes"]).select("c_custkey", "digest")


@query(
    "risk_by_source",
    f"""WITH r AS (SELECT user_id AS source_id, count(*) AS signal_count, max(least(1.0, "value" / 200)) AS top, bool_or(event_type = 'error') AS broken
                  FROM events GROUP BY 1),
        k AS (SELECT source_id, signal_count, round(least(1.0, CASE WHEN broken THEN 35.0::DOUBLE / 60 ELSE 0 END + 25.0::DOUBLE / 60 * top)::DECIMAL(28,10), 4)::DOUBLE AS risk FROM r)
        SELECT source_id, signal_count, risk, {SEVERITY_SQL.format('risk')} AS severity FROM k""",
)
def risk_by_source(spark, sf):
    """Each event is a signal of its user, as strong as its value; errors break the contract."""
    signals = table(spark, sf, "events").select(
        F.col("user_id").alias("source_id"),
        F.least(F.lit(1.0), F.col("value") / 200).alias("score"),
        F.when(F.col("event_type") == "error", "contract").otherwise("baseline").alias("source"),
    )
    return incident_risk(signals, ["source_id"])
