"""Reports over the run, signal and event tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dqspark.functions.columns import as_instant, digest, severity_label, severity_rank

# Grace periods of the operations reports.
STALL_GRACE_MINUTES = 10
BACKLOG_MINUTES = 15
WORKER_TTL_SECONDS = 90


def _minutes(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(6e7)


def newest_per(df: DataFrame, keys: Sequence[str], n: int | None, order: Sequence[Column]) -> DataFrame:
    """n newest rows per key, all without n; the rank filter is applied in every task before the shuffle."""
    if n is None:
        return df.withColumn("_rank", F.lit(0))
    if n < 1:
        raise ValueError("a limit is at least 1")
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= n)


def metric_history(runs: DataFrame, profiles: DataFrame, signals: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(source_id, run_id, run_ts, rows, signals, quality, column, null_ratio, mean): runs of each source
    that share the newest run's configuration, out of its newest `limit` runs if given."""
    newest = runs.groupBy("source_id").agg(F.max_by("config_hash", F.struct("run_ts", "run_id")).alias("newest_config"))
    recent = newest_per(runs, ["source_id"], limit, [F.col("run_ts").desc(), F.col("run_id").desc()])
    kept = recent.join(newest, "source_id").filter(F.col("config_hash").eqNullSafe(F.col("newest_config")))
    if signals is not None:
        counts = signals.groupBy("run_id").agg(F.count(F.lit(1)).alias("signals"))
        kept = kept.join(counts, "run_id", "left").withColumn("signals", F.coalesce("signals", F.lit(0)))
    else:
        kept = kept.withColumn("signals", F.lit(0).cast("bigint"))
    return kept.join(profiles.select("run_id", "column", "null_ratio", "mean"), "run_id").select(
        "source_id", "run_id", "run_ts", F.col("total_rows").alias("rows"), "signals", "quality", "column", "null_ratio", "mean"
    )


def history_columns(history: DataFrame, limit: int | None = None) -> DataFrame:
    """Column names per source that carry a mean; the first `limit` by name if given."""
    names = history.filter("mean is not null").select("source_id", "column").distinct()
    return newest_per(names, ["source_id"], limit, [F.col("column").asc()]).drop("_rank")


def schedule_compliance(sources: DataFrame, runs: DataFrame, as_of) -> DataFrame:
    """(source_id, schedule_minutes, last_success, age_minutes, state): manual, stalled, ok or waiting.

    `sources(source_id, schedule_minutes, created_at)`, `runs(source_id, run_ts, status)`.
    """
    last = runs.filter("status = 'success'").groupBy("source_id").agg(F.max("run_ts").alias("last_success"))
    now = as_instant(as_of)
    age = _minutes(now, F.coalesce("last_success", "created_at"))
    minutes = F.col("schedule_minutes")
    state = (
        F.when(F.coalesce(minutes, F.lit(0)) == 0, "manual")
        .when(age > 2 * minutes + STALL_GRACE_MINUTES, "stalled")
        .when(F.col("last_success").isNotNull(), "ok")
        .otherwise("waiting")
    )
    return sources.join(last, "source_id", "left").select(
        "source_id",
        "schedule_minutes",
        "last_success",
        F.when(F.coalesce(minutes, F.lit(0)) > 0, F.round(age, 1)).alias("age_minutes"),
        state.alias("state"),
    )


def monitoring_status(compliance: DataFrame, runs: DataFrame, beats: DataFrame, as_of, ttl_seconds: int = WORKER_TTL_SECONDS) -> DataFrame:
    """One row: ok, degraded (stalled source or old backlog) or down (work but no live worker).

    `runs(status, run_ts)` with pending ones, `beats(worker, last_seen)`.
    """
    now = as_instant(as_of)
    facts = [
        compliance.agg(
            F.count_if(F.col("state") == "stalled").alias("stalled"),
            F.count_if(F.col("state") != "manual").alias("scheduled"),
        ).selectExpr("stack(2, 'stalled', stalled, 'scheduled', scheduled) as (fact, n)"),
        runs.filter("status = 'pending'")
        .agg(
            F.count(F.lit(1)).alias("pending"),
            F.count_if(_minutes(now, F.col("run_ts")) > BACKLOG_MINUTES).alias("old"),
        )
        .selectExpr("stack(2, 'pending', pending, 'old', old) as (fact, n)"),
        beats.agg(F.count_if(_minutes(now, F.col("last_seen")) * 60 <= ttl_seconds).alias("alive")).selectExpr(
            "'alive' as fact", "alive as n"
        ),
    ]
    merged = facts[0].unionByName(facts[1]).unionByName(facts[2])
    names = ("stalled", "scheduled", "pending", "old", "alive")
    row = merged.agg(*[F.max(F.when(F.col("fact") == n, F.col("n"))).alias(n) for n in names])
    status = (
        F.when((F.col("alive") == 0) & ((F.col("pending") > 0) | (F.col("scheduled") > 0)), "down")
        .when((F.col("stalled") > 0) | (F.col("old") > 0), "degraded")
        .otherwise("ok")
    )
    return row.select(status.alias("status"), "stalled", "pending", "alive")


def active_mutes(mutes: DataFrame, as_of) -> DataFrame:
    return mutes.filter(F.col("until") > as_instant(as_of))


def muted_signals(signals: DataFrame, mutes: DataFrame) -> DataFrame:
    """Signals with `muted`. `signals(source_id, run_id, run_ts, type, column, …)`,
    `mutes(source_id, type, column, start, until)`; a mute without a column covers all columns.

    Mutes are folded to the latest end per (source, type, column) first, so the two left joins never
    multiply signals.
    """
    slot = F.coalesce("column", F.lit("*"))
    ends = mutes.groupBy("source_id", "type", slot.alias("slot")).agg(F.max("until").alias("until"))
    exact = ends.filter("slot <> '*'").select("source_id", "type", F.col("slot").alias("column"), F.col("until").alias("_a"))
    wide = ends.filter("slot = '*'").select("source_id", "type", F.col("until").alias("_b"))
    joined = signals.join(exact, ["source_id", "type", "column"], "left").join(wide, ["source_id", "type"], "left")
    muted = F.coalesce(F.greatest("_a", "_b") > F.col("run_ts"), F.lit(False))
    return joined.withColumn("muted", muted).drop("_a", "_b")


def muted_runs(signals: DataFrame, mutes: DataFrame) -> DataFrame:
    """(source_id, run_id, signals, muted): a run is muted when each of its signals is."""
    return (
        muted_signals(signals, mutes)
        .groupBy("source_id", "run_id")
        .agg(F.count(F.lit(1)).alias("signals"), F.bool_and("muted").alias("muted"))
    )


def notification_queue(signals: DataFrame, mutes: DataFrame, impact: DataFrame | None = None) -> DataFrame:
    """(source_id, run_id, severity, signal_count, priority): runs with signals that are not muted as a whole."""
    queue = (
        muted_signals(signals, mutes)
        .groupBy("source_id", "run_id")
        .agg(
            F.bool_and("muted").alias("_muted"),
            severity_label(F.max(severity_rank(F.col("severity")))).alias("severity"),
            F.count(F.lit(1)).alias("signal_count"),
        )
        .filter("not _muted")
        .drop("_muted")
    )
    if impact is None:
        return queue
    return queue.join(impact.select("run_id", "priority"), "run_id", "left")


def latest_state(log: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Newest entry per entity of an append-only log."""
    rest = [c for c in log.columns if c not in keys]
    others = [c for c in rest if c != ts]
    newest = F.max_by(F.struct(*rest), F.struct(ts, *others))
    return log.groupBy(*keys).agg(newest.alias("_n")).select(*keys, *[F.col(f"_n.{c}").alias(c) for c in rest])


def outcome_metrics(runs: DataFrame, signals: DataFrame, feedback: DataFrame, repairs: DataFrame) -> DataFrame:
    """One row of observed outcomes. The median scan time is exact and distributed."""
    from dqspark.operators.profile import exact_quantiles

    marked = (
        runs.select("run_id")
        .join(signals.select("run_id").distinct().withColumn("hit", F.lit(1)), "run_id", "left")
        .join(latest_state(feedback.select("run_id", "ts", "verdict"), ["run_id"]).select("run_id", "verdict"), "run_id", "left")
    )
    counts = marked.agg(
        F.count(F.lit(1)).alias("observations"),
        F.count("hit").alias("incidents"),
        F.count("verdict").alias("reviewed"),
        F.count_if(F.col("verdict") == "false_positive").alias("false_positive_reviews"),
        F.count_if(F.col("verdict") == "resolved").alias("resolved_reviews"),
    )
    names = counts.columns
    long = counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("fact"), F.col(n).cast("double").alias("n")) for n in names])))
    tries = repairs.agg(F.count(F.lit(1)).alias("a"), F.count_if("passed").alias("b")).selectExpr(
        "stack(2, 'repair_attempts', double(a), 'validated_repairs', double(b)) as (fact, n)"
    )
    median = exact_quantiles(runs.select("duration_s"), ["duration_s"], (0.5,)).select(
        F.lit("median_scan_seconds").alias("fact"), F.col("q0").alias("n")
    )
    merged = long.unionByName(tries).unionByName(median)
    whole = [*names, "repair_attempts", "validated_repairs"]

    def value(n: str) -> Column:
        return F.max(F.when(F.col("fact") == n, F.col("n")))

    return merged.agg(*[value(n).cast("bigint").alias(n) for n in whole], F.round(value("median_scan_seconds"), 6).alias("median_scan_seconds"))


def list_incidents(reports: DataFrame, runs: DataFrame, triage: DataFrame, severity: str | None = None, limit: int | None = None) -> DataFrame:
    """Incidents with their triage state, the newest `limit` if given; filters reach the report table before the joins."""
    chosen = reports if severity is None else reports.filter(F.col("severity") == severity)
    joined = chosen.join(runs.select("run_id", "source_id", "run_ts"), "run_id").join(
        triage.select("run_id", F.col("status").alias("triage")), "run_id", "left"
    )
    return joined if limit is None else joined.orderBy(F.col("run_ts").desc(), "run_id").limit(limit)


def list_observations(runs: DataFrame, signals: DataFrame, source_id: str | None = None, limit: int | None = None) -> DataFrame:
    """Runs with their signal counts, the newest `limit` if given, which is applied before the signals are joined."""
    chosen = runs if source_id is None else runs.filter(F.col("source_id") == source_id)
    newest = chosen if limit is None else chosen.orderBy(F.col("run_ts").desc(), "run_id").limit(limit)
    counts = signals.join(newest.select("run_id"), "run_id", "left_semi").groupBy("run_id").agg(F.count(F.lit(1)).alias("signals"))
    return newest.join(counts, "run_id", "left").withColumn("signals", F.coalesce("signals", F.lit(0)))


def list_datasets(profiles: DataFrame, runs: DataFrame) -> DataFrame:
    """(dataset, columns, runs, latest_run, latest_ts, latest_status)."""
    width = profiles.groupBy("dataset").agg(F.count_distinct("column").alias("columns"))
    latest = runs.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("runs"),
        F.max_by(F.struct("run_id", "run_ts", "status"), F.struct("run_ts", "run_id")).alias("r"),
    )
    return width.join(latest, "dataset", "full_outer").select(
        "dataset",
        "columns",
        "runs",
        F.col("r.run_id").alias("latest_run"),
        F.col("r.run_ts").alias("latest_ts"),
        F.col("r.status").alias("latest_status"),
    )


def timeline(events: DataFrame, scope: DataFrame, limit: int | None = None) -> DataFrame:
    """Events of a run's source or touching one of its assets, the newest `limit` per run if given.

    `events(event_id, source_id, created_at, kind, assets array<string>)`, `scope(run_id, source_id, asset)`
    with one row per neighbouring asset. With a limit each asset and each source is cut to its newest events before
    the join, which loses nothing and keeps busy ones from multiplying with their runs.
    """
    order = [F.col("created_at").desc(), F.col("event_id").asc()]
    shown = ["run_id", "event_id", "created_at", "kind"]
    by_asset = newest_per(events.withColumn("asset", F.explode(F.array_distinct("assets"))), ["asset"], limit, order)
    touched = by_asset.join(scope.select("run_id", "asset").distinct(), "asset").select(*shown)
    by_source = newest_per(events, ["source_id"], limit, order)
    own = by_source.join(scope.select("run_id", "source_id").distinct(), "source_id").select(*shown)
    return newest_per(touched.unionByName(own).distinct(), ["run_id"], limit, order).drop("_rank")


def detection_cases(cases: DataFrame, signals: DataFrame, found: DataFrame) -> DataFrame:
    """One row per case: what was expected, what was seen, and each reason why the case is not passed.

    `cases(run_id, expected_types, expected_rule[, min_confidence])`, `found` = ranked strong hypotheses. A case
    without an expected rule accepts any; one without hypotheses has confidence 0 and no bad evidence.
    """
    observed = signals.groupBy("run_id").agg(
        F.array_sort(F.collect_set("type")).alias("types"), F.collect_set("signal_id").alias("ids")
    )
    top = found.groupBy("run_id").agg(
        F.min_by(F.struct("rule_id", "confidence"), "rank").alias("t"),
        F.flatten(F.collect_list("evidence_ids")).alias("used"),
        F.min(F.size("evidence_ids")).alias("least"),
    )
    none = F.array().cast("array<string>")
    least = F.col("min_confidence") if "min_confidence" in cases.columns else F.lit(0.0)
    complete = F.size("missing_types") == 0
    reasons = {"missing_types": complete, "rule": F.col("rule_match"), "confidence": F.col("confidence_ok"), "evidence": F.col("evidence_valid")}
    unknown = F.array_except(F.coalesce("used", none), F.coalesce("ids", none))
    return (
        cases.join(observed, "run_id", "left")
        .join(top, "run_id", "left")
        .select(
            "run_id",
            "expected_types",
            F.coalesce("types", none).alias("observed_types"),
            F.array_sort(F.array_except("expected_types", F.coalesce("types", none))).alias("missing_types"),
            "expected_rule",
            F.col("t.rule_id").alias("top_rule"),
            F.coalesce("t.confidence", F.lit(0.0)).alias("top_confidence"),
            (F.col("expected_rule").isNull() | F.coalesce(F.col("t.rule_id") == F.col("expected_rule"), F.lit(False))).alias("rule_match"),
            (F.coalesce("t.confidence", F.lit(0.0)) >= F.coalesce(least, F.lit(0.0))).alias("confidence_ok"),
            ((F.size(unknown) == 0) & (F.coalesce("least", F.lit(1)) > 0)).alias("evidence_valid"),
        )
        .withColumn("failures", F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in reasons.items()])))
        .withColumn("passed", F.size("failures") == 0)
    )


def detection_metrics(cases: DataFrame, signals: DataFrame, found: DataFrame) -> DataFrame:
    """One row: recall, top-1 accuracy, mean confidence when right, evidence precision over `detection_cases`."""
    named = F.col("rule_match") & F.col("expected_rule").isNotNull()
    return detection_cases(cases, signals, found).agg(
        F.count(F.lit(1)).alias("cases"),
        F.round(F.avg((F.size("missing_types") == 0).cast("double")), 6).alias("detection_recall"),
        F.round(F.avg(F.col("rule_match").cast("double")), 6).alias("top1_accuracy"),
        F.round(F.coalesce(F.avg(F.when(named, F.col("top_confidence"))), F.lit(0.0)), 6).alias("mean_confidence"),
        F.round(F.avg(F.col("evidence_valid").cast("double")), 6).alias("evidence_precision"),
    )


# Keys of a source configuration that do not change what is scanned.
OPERATIONAL_KEYS = ("schedule_minutes", "auto_baseline", "adaptive_detection", "multivariate")


def content_digest(df: DataFrame, columns: Sequence[str] | None = None, name: str = "digest") -> DataFrame:
    """sha256 over the canonical JSON of the chosen columns; operational columns never count."""
    chosen = [c for c in (columns or df.columns) if c not in OPERATIONAL_KEYS]
    return df.withColumn(name, digest(df, chosen))


def sync_actions(drafts: DataFrame, existing: DataFrame, decisions: DataFrame) -> DataFrame:
    """(incident_id, type, description, requires_approval, status): drafts of the newest report joined with
    earlier actions; a decision on the same key survives re-analysis, everything else is pending."""
    keys = ["incident_id", "type", "description"]
    # An action that already exists keeps its own approval flag.
    merged = (
        drafts.select(*keys, "requires_approval", F.lit(1).alias("_new"))
        .unionByName(existing.select(*keys, "requires_approval", F.lit(0).alias("_new")))
        .groupBy(*keys)
        .agg(F.min_by("requires_approval", "_new").alias("requires_approval"))
    )
    decided = latest_state(decisions.select(*keys, "ts", "decision"), keys).select(*keys, "decision")
    status = F.when(F.col("decision") == "approve", "approved").when(F.col("decision") == "reject", "rejected").otherwise("pending")
    return merged.join(decided, keys, "left").select(*keys, "requires_approval", status.alias("status"))
