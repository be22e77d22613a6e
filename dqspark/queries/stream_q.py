"""Streaming operators, drained over the whole event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqspark.operators.contract import check_contract
from dqspark.operators.profile import profile_table
from dqspark.operators.scoring import incident_risk, number_signals, score_violations
from dqspark.plans.analyze import Analysis, History, Options, analyze_table
from dqspark.queries.base import query, table
from dqspark.queries.sources_q import EVENT_EDGES_SQL, run_events
from dqspark.runtime import materialize, scratch_path
from dqspark.streaming.silence import learned_silence, stream_silence
from dqspark.streaming.streams import (
    LateRows,
    freshness_status,
    newest_rows,
    run_available_now,
    run_quarantine,
    stream_analyze,
    stream_contract,
    stream_freshness,
    stream_lineage,
    stream_profile,
    stream_value_rules,
    value_rule_totals,
)


def event_stream(spark, sf):
    return spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events*.parquet")


def _drain(spark, stream, name, keys=None):
    """Drain a stream; with keys every update is written and the last one of each key read."""
    out, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    run_available_now(stream, out, state, "update" if keys else "append")
    return newest_rows(spark, out, keys) if keys else spark.read.parquet(out)


@query(
    "stream_profile",
    """SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, 'value' AS "column", count(*) AS row_count, round(1 - count("value") / count(*), 6) AS null_ratio,
          round(round(avg("value"), 6)::DECIMAL(28,6), 4)::DOUBLE AS mean, round(round(stddev_pop("value"), 6)::DECIMAL(28,6), 4)::DOUBLE AS stddev, min("value" + 0.0) AS "min", max("value") AS "max"
        FROM events GROUP BY 1""",
)
def windows(spark, sf):
    stream = stream_profile(event_stream(spark, sf), "ts", "1 day", "1 hour", ["value"])
    return _drain(spark, stream, "stream-profile", ["window_start", "column"]).select(
        "window_start", "column", "row_count", "null_ratio", F.round("mean", 4).alias("mean"), F.round("stddev", 4).alias("stddev"), "min", "max"
    )


CONTRACT = {
    "rules": [
        {"type": "range", "column": "value", "min": 1, "max": 150},
        {"type": "allowed_values", "column": "event_type", "values": ["click", "purchase", "signup", "view"]},
    ]
}


@query(
    "stream_contract",
    """WITH w AS (SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS n, count(*) FILTER (WHERE "value" < 1 OR "value" > 150) AS a,
          count(*) FILTER (WHERE event_type = 'error') AS b FROM events GROUP BY 1)
        SELECT window_start, 'range:value' AS rule, n AS row_count, a AS violations FROM w UNION ALL SELECT window_start, 'allowed_values:event_type', n, b FROM w""",
)
def window_rules(spark, sf):
    stream = stream_contract(event_stream(spark, sf), CONTRACT, "ts", "1 day", "1 hour")
    return _drain(spark, stream, "stream-contract", ["window_start", "rule"]).drop("window_end")


VALUE_CONTRACT = {
    "rules": [
        {"type": "uniqueness", "columns": ["user_id", "event_type"]},
        {"type": "referential_integrity", "column": "user_id", "reference": "first_customers"},
    ]
}


@query(
    "stream_value_rules",
    """WITH d AS (SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, user_id, event_type FROM events),
         u AS (SELECT window_start, count(*) AS n FROM d WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY window_start, user_id, event_type HAVING count(*) > 1),
         o AS (SELECT window_start, count(*) AS n FROM d WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0) GROUP BY window_start, user_id)
       SELECT window_start, 'uniqueness:user_id,event_type' AS rule, count(*) AS "values", sum(n - 1)::BIGINT AS violations FROM u GROUP BY window_start
       UNION ALL SELECT window_start, 'referential_integrity:user_id', count(*), sum(n)::BIGINT FROM o GROUP BY window_start""",
)
def window_value_rules(spark, sf):
    """Uniqueness of (user, event type) within a day, and users that are no customers."""
    known = {"first_customers": table(spark, sf, "customer").filter("c_custkey % 3 <> 0").select("c_custkey")}
    stream = stream_value_rules(event_stream(spark, sf), VALUE_CONTRACT, "ts", "1 day", "1 hour", known)
    return value_rule_totals(_drain(spark, stream, "stream-values", ["window_start", "rule", "value_digest"]))


@query(
    "stream_quarantine",
    """SELECT concat_ws(';', CASE WHEN "value" < 1 OR "value" > 150 THEN 'range:value' END, CASE WHEN event_type = 'error' THEN 'allowed_values:event_type' END) AS failed,
         count(*) AS n FROM events GROUP BY 1""",
)
def quarantine(spark, sf):
    good, bad, state = (scratch_path(spark, n) for n in ("good", "bad", "quarantine-state"))
    run_quarantine(event_stream(spark, sf), CONTRACT, good, bad, state).awaitTermination()
    kept = spark.read.parquet(good).select(F.lit("").alias("failed"))
    failed = spark.read.parquet(bad).select(F.concat_ws(";", "failed_rules").alias("failed"))
    return kept.unionByName(failed).groupBy("failed").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_freshness",
    """SELECT user_id AS source_id, max(ts) AS latest, round(date_diff('microsecond', max(ts), TIMESTAMP '2024-01-31') / 6e7, 2) AS lag_minutes,
         (c_nationkey + 1) * 600 AS max_lag_minutes, date_diff('microsecond', max(ts), TIMESTAMP '2024-01-31') / 6e7 > (c_nationkey + 1) * 600 AS late
       FROM events JOIN customer ON c_custkey = user_id GROUP BY user_id, c_nationkey""",
)
def freshness(spark, sf):
    latest = _drain(spark, stream_freshness(event_stream(spark, sf), "user_id", "ts"), "stream-freshness", ["source_id"])
    limits = table(spark, sf, "customer").select(F.col("c_custkey").alias("source_id"), ((F.col("c_nationkey") + 1) * 600).alias("max_lag_minutes"))
    return freshness_status(latest, limits, "2024-01-31 00:00:00")


@query(
    "stream_silence",
    """WITH m AS (SELECT DISTINCT user_id, date_trunc('minute', ts) AS m FROM events WHERE ts < TIMESTAMP '2024-01-16'),
         g AS (SELECT user_id, gap FROM (SELECT user_id, date_diff('second', lag(m) OVER (PARTITION BY user_id ORDER BY m), m) / 60 AS gap FROM m) WHERE gap IS NOT NULL),
         t AS (SELECT user_id, quantile_cont(gap, 0.5) AS typical FROM g GROUP BY user_id HAVING count(*) >= 5),
         s AS (SELECT g.user_id, typical, quantile_cont(abs(gap - typical), 0.5) AS mad FROM g JOIN t ON t.user_id = g.user_id GROUP BY g.user_id, typical),
         l AS (SELECT user_id, round(greatest(typical + 6 * 1.4826 * mad, 2 * typical, typical + 15), 6) AS limit_minutes FROM s),
         e AS (SELECT e.user_id, (epoch_us(ts) // 1000) AS seen_ms, limit_minutes, (epoch_us(ts) // 1000) + floor(limit_minutes * 60000)::BIGINT AS due FROM events e JOIN l ON l.user_id = e.user_id
               WHERE ts >= TIMESTAMP '2024-01-16'),
         n AS (SELECT *, lead(seen_ms) OVER (PARTITION BY user_id ORDER BY seen_ms) AS following FROM e),
         w AS (SELECT (epoch_us(max(ts)) // 1000) - 3600000 AS w FROM events)
       SELECT user_id::VARCHAR AS source_id, seen_ms AS silent_from_ms, round(limit_minutes, 3) AS limit_minutes, following IS NULL AS still_silent
       FROM n, w WHERE following > due OR (following IS NULL AND due < w)""",
)
def silence(spark, sf):
    """Limits learned from the first half of the month; the stream of the second half reports every longer silence, also
    of users who never come back."""
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    limits = materialize(learned_silence(table(spark, sf, "events").filter(F.col("ts") < cut), "user_id", "ts"))
    # The newest event lies in the second half, whoever it is of, so other users' rows move the watermark.
    later = event_stream(spark, sf).filter(F.col("ts") >= cut)
    alarms = _drain(spark, stream_silence(later, "user_id", "ts", limits, "1 hour"), "stream-silence")
    last = table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("source_id")).agg(F.max("ts").alias("last"))
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    return alarms.join(last, "source_id").select(
        "source_id", ms("silent_from").alias("silent_from_ms"), F.round("limit_minutes", 3).alias("limit_minutes"), (ms("silent_from") == ms("last")).alias("still_silent")
    )


@query(
    "stream_late_rows",
    """WITH s AS (SELECT DISTINCT date_trunc('second', ts) AS s FROM events), w AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 DAY AS w FROM events)
       SELECT count(*) FILTER (WHERE s + INTERVAL 1 SECOND <= w) AS late_rows FROM s, w""",
)
def late(spark, sf):
    """All events twice, each delivery drained for itself on one checkpoint. The second meets the watermark of the first:
    every second that ended two days before the newest event is late."""
    path, out, state = (scratch_path(spark, n) for n in ("late-events", "late-out", "late-state"))
    events = table(spark, sf, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{path}/turn=*")
    counted = stream.withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", "2 days").groupBy(F.window("t", "1 second")).agg(F.count(F.lit(1)).alias("n"))
    listener = LateRows()
    spark.streams.addListener(listener)
    try:
        for turn in range(2):
            events.write.parquet(f"{path}/turn={turn}")
            finished = run_available_now(counted, out, state)
        dropped = listener.of(finished)
    finally:
        spark.streams.removeListener(listener)
    return spark.range(1).select(F.lit(dropped).cast("bigint").alias("late_rows"))


@query(
    "stream_lineage",
    EVENT_EDGES_SQL.replace("SELECT DISTINCT", "SELECT").replace("UNION ALL SELECT DISTINCT", "UNION ALL SELECT"),
)
def lineage(spark, sf):
    """Run events delivered twice arrive as JSON files; each gives its edges once, so edges count events here."""
    from dqspark.sources.lineage_events import EVENT

    path = scratch_path(spark, "run-events")
    for _ in range(2):
        run_events(spark, sf).write.mode("append").json(path)
    stream = spark.readStream.schema(EVENT).json(path)
    # All files are there, so they are one batch, in which no event is behind the watermark yet.
    return _drain(spark, stream_lineage(stream), "stream-lineage")


@query(
    "stream_analyze",
    """SELECT 'range' AS type, 'value' AS "column", count(*) AS violation_count FROM events WHERE "value" < 1 OR "value" > 150
       UNION ALL SELECT 'semantic_drift', 'event_type', count(*) FROM events WHERE event_type = 'error'""",
)
def analyze(spark, sf):
    out, state = scratch_path(spark, "stream-analyze"), scratch_path(spark, "stream-analyze-state")

    def one(batch, run_id):
        stamped = batch.drop("props").withColumn("run_id", F.lit(run_id))
        profiles = profile_table(stamped, ["run_id"], parts=("distinct",))
        signals = number_signals(score_violations(check_contract(stamped, CONTRACT, runs=["run_id"])), ["run_id"])
        risk = incident_risk(signals, ["run_id"], stamped.select("run_id").distinct())
        return Analysis(profiles.drop("top_values"), signals, risk, None)

    stream_analyze(event_stream(spark, sf), one, out, state).awaitTermination()
    amount = F.element_at("evidence", "violation_count").cast("bigint")
    return spark.read.parquet(f"{out}/signals").groupBy("type", "column").agg(F.sum(amount).alias("violation_count"))


@query(
    "stream_analyze_history",
    """WITH h AS (SELECT CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 0 ELSE 1 END AS half,
           CASE WHEN ts < TIMESTAMP '2024-01-16' THEN "value" ELSE "value" * 100 END AS v FROM events),
         p AS (SELECT half, count(*) AS n, round(avg(v), 6) AS m, round(stddev_pop(v), 6) AS s FROM h GROUP BY half),
         z AS (SELECT b.n AS base_n, c.n, (c.m - b.m) / b.s AS z FROM p b JOIN p c ON b.half = 0 AND c.half = 1)
       SELECT 'batch-1' AS run_id, 'distribution' AS type, 'value' AS "column",
         round(least(1.0, (abs(z) - 3.0) / 3.0 + 0.5)::DECIMAL(28,10), 4)::DOUBLE AS score FROM z WHERE abs(z) >= 3
       UNION ALL SELECT 'batch-1', 'volume', NULL, round(least(1.0, abs(n - base_n) / base_n)::DECIMAL(28,10), 4)::DOUBLE FROM z WHERE abs(n - base_n) / base_n >= 0.3""",
)
def analyze_history(spark, sf):
    """Two micro-batches of many files, the second in other units: it is analysed against the stored result of the first."""
    path, out, state = (scratch_path(spark, n) for n in ("halves", "stream-history", "stream-history-state"))
    events = table(spark, sf, "events").select("ts", F.col("value").cast("double").alias("value"))
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    halves = [events.filter(early), events.filter(~early).withColumn("value", F.col("value") * 100)]
    stream = spark.readStream.schema(events.schema).parquet(f"{path}/half=*")

    def one(batch, run_id):
        session = batch.sparkSession
        known = None
        if run_id != "batch-0":
            runs = session.read.parquet(f"{out}/runs").withColumn("quality", F.lit("accepted"))
            known = History(runs, session.read.parquet(f"{out}/profiles"))
        as_of = F.lit("2024-02-01").cast("timestamp_ntz") + F.make_interval(days=F.lit(int(run_id.removeprefix("batch-"))))
        return analyze_table(batch.select("value"), {"rules": []}, known, as_of, run_id, "events", options=Options(parts=("distinct",)))

    for i, half in enumerate(halves):
        half.write.parquet(f"{path}/half={i}")
        stream_analyze(stream, one, out, state).awaitTermination()
    return spark.read.parquet(f"{out}/signals").select("run_id", "type", "column", "score")
