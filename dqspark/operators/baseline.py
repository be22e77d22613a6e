"""Which earlier run a new run is compared with, and what the history of a source counts as normal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dqspark.functions.columns import evidence, is_identifier, minutes_between
from dqspark.operators.drift import _signal, finish
from dqspark.types import contract_type

# History depth and limits.
SEASONAL_RUNS = 12
SEASONAL_MINIMUM = 3
MIN_HISTORY = 8
MIN_COHORT_HISTORY = 5
MAX_HISTORY = 30
HISTORY_Z = 6.0
MAD_TO_SIGMA = 1.4826
HISTORY_SEQ = 20_000_000
STALENESS_SEQ = 40_000_000

_METRICS = ("row_count", "null_ratio", "distinct_ratio", "mean", "stddev", "min", "max", "p50", "p95", "p99")


def latest_clean_baseline(
    runs: DataFrame, signals: DataFrame, profiles: DataFrame, exclude: str | None = None
) -> DataFrame:
    """Profile rows of the newest clean run of each job: successful, not fault-marked, without any signal.

    Only the newest run per job is kept by a max_by aggregate, so a job with a third of all runs is no skew.
    """
    clean = runs.filter("status = 'success' and fault_id is null")
    if exclude is not None:
        clean = clean.filter(F.col("run_id") != exclude)
    clean = clean.join(signals.select("run_id").distinct(), "run_id", "left_anti")
    newest = clean.groupBy("job_id").agg(
        F.max_by("run_id", F.struct("run_ts", "run_id")).alias("run_id"),
        F.max_by("row_count", F.struct("run_ts", "run_id")).alias("baseline_row_count"),
    )
    return newest.join(profiles, "run_id")


def cohort(ts) -> list:
    """Seasonal cohort of a run: UTC weekday (Monday = 0) and hour."""
    return [F.weekday(ts).alias("weekday"), F.hour(ts).alias("hour")]


def number_runs(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`seen` = accepted runs of the same keys before each line (run_ts, is_target, run_id).

    Counted per day first: the running sum over days is short, and the ordered part works on one day of one
    source, so a source with a third of all runs still spreads over many tasks. At equal times the target
    comes first, so a run never becomes its own baseline.
    """
    dated = lines.withColumn("_day", F.to_date("run_ts"))
    accepted = 1 - F.col("is_target")
    days = dated.groupBy(*keys, "_day").agg(F.sum(accepted).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    offsets = days.select(*keys, "_day", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    within = (
        Window.partitionBy(*keys, "_day")
        .orderBy("run_ts", F.col("is_target").desc(), "run_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = F.coalesce(F.sum(accepted).over(within), F.lit(0))
    return (
        dated.withColumn("_local", local)
        .join(offsets, [*keys, "_day"])
        .withColumn("seen", F.col("_offset") + F.col("_local"))
        .drop("_day", "_local", "_offset")
    )


def previous_run(runs: DataFrame, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """(keys…, run_id, base_run): the run just before each run; null for the first."""
    keys = list(keys)
    lines = runs.select(*keys, "run_id", "run_ts", F.lit(0).alias("is_target"))
    numbered = number_runs(lines, keys)
    past = numbered.select(*keys, F.col("run_id").alias("base_run"), (F.col("seen") + 1).alias("seen"))
    return numbered.join(past, [*keys, "seen"], "left").select(*keys, "run_id", "run_ts", "base_run")


def choose_baseline(
    runs: DataFrame,
    profiles: DataFrame,
    targets: DataFrame,
    seasonal: bool = False,
    minimum: int = SEASONAL_MINIMUM,
) -> tuple[DataFrame, DataFrame]:
    """As-of baseline of every target run: (states, profiles).

    `runs(source_id, run_id, run_ts, quality, config_hash, total_rows)`; only accepted runs with the
    target's configuration and an earlier time count. Plain: the newest one. Seasonal: up to twelve newest
    of the same weekday and hour, at least `minimum`, numeric metrics as medians.

    Seasonal cohorts are joined on (source, configuration, weekday, hour). The plain choice ranks runs once
    with a running max per source instead of pairing every run with every earlier one.
    """
    wanted = targets.select("source_id", "run_id", "run_ts", "config_hash", *cohort(F.col("run_ts")))
    accepted = runs.filter(F.col("quality") == "accepted").select(
        "source_id", "run_id", "run_ts", "config_hash", "total_rows", *cohort(F.col("run_ts"))
    )
    keys = ["source_id", "config_hash", *(["weekday", "hour"] if seasonal else [])]
    depth = SEASONAL_RUNS if seasonal else 1
    lines = (
        accepted.select(*keys, "run_ts", F.lit(0).alias("is_target"), "run_id", "total_rows")
        .unionByName(
            wanted.select(
                *keys,
                "run_ts",
                F.lit(1).alias("is_target"),
                "run_id",
                F.lit(None).cast("bigint").alias("total_rows"),
            )
        )
    )
    numbered = number_runs(lines, keys)
    # An accepted run number i serves the targets that have seen i < n <= i + depth runs: an equi join on n.
    past = numbered.filter("is_target = 0").select(
        *keys,
        F.explode(F.sequence(F.col("seen") + 1, F.col("seen") + depth)).alias("seen"),
        F.col("run_id").alias("base_run"),
        F.col("run_ts").alias("base_ts"),
        F.col("total_rows").alias("base_rows"),
    )
    asked = numbered.filter("is_target = 1").select(*keys, "seen", "run_id", "run_ts")
    pairs = asked.join(past, [*keys, "seen"], "left")
    need = minimum if seasonal else 1
    states = pairs.groupBy("source_id", "run_id").agg(
        F.count("base_run").alias("base_runs"),
        F.max("seen").alias("available"),
        F.max_by("base_run", F.struct("base_ts", "base_run")).alias("newest_base"),
        F.floor(F.percentile("base_rows", 0.5)).cast("bigint").alias("row_count"),
    )
    ready = F.col("base_runs") >= need
    states = states.select(
        "source_id",
        "run_id",
        "base_runs",
        F.when(F.col("base_runs") == 0, "cold_start")
        .when(~ready, "insufficient_history")
        .otherwise("ready")
        .alias("state"),
        F.when(ready, F.col("newest_base")).alias("newest_base"),
        F.when(ready, F.col("row_count")).alias("row_count"),
    )
    usable = pairs.join(states.filter("state = 'ready'").select("run_id", "newest_base"), "run_id").select(
        "source_id", "run_id", "base_run", "newest_base"
    )
    metrics = [m for m in _METRICS if m in profiles.columns]
    base = profiles.withColumnRenamed("run_id", "base_run").drop("source_id")
    newest = usable.filter("base_run = newest_base").join(base, "base_run").drop("base_run", "newest_base")
    if not seasonal:
        return states, newest
    medians = (
        usable.join(base.select("base_run", "column", *metrics), "base_run")
        .groupBy("source_id", "run_id", "column")
        .agg(*[F.percentile(m, 0.5).alias(f"_m_{m}") for m in metrics])
    )
    joined = newest.join(medians, ["source_id", "run_id", "column"])
    replaced = {m: F.when(F.col(m).isNotNull(), F.col(f"_m_{m}")) for m in metrics}
    return states, joined.withColumns(replaced).drop(*[f"_m_{m}" for m in metrics])


def _history(runs: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """(target run, earlier run) pairs, at most MAX_HISTORY newest per target, by run number arithmetic.

    Each accepted run is repeated MAX_HISTORY times at most and the join is an equi join, so the pair count
    is runs x 30 and not runs squared.
    """
    lines = (
        runs.filter(F.col("quality") == "accepted")
        .select(*keys, "run_ts", "run_id", F.lit(0).alias("is_target"))
        .unionByName(targets.select(*keys, "run_ts", "run_id", F.lit(1).alias("is_target")))
    )
    numbered = number_runs(lines, keys)
    past = numbered.filter("is_target = 0").select(
        *keys,
        F.explode(F.sequence(F.col("seen") + 1, F.col("seen") + MAX_HISTORY)).alias("seen"),
        F.col("run_id").alias("base_run"),
    )
    return numbered.filter("is_target = 1").select(*keys, "seen", "run_id").join(past, [*keys, "seen"])


def melt(profiles: DataFrame, run_rows: DataFrame) -> DataFrame:
    """(run_id, kind, column, value, ordinal): row counts, means of non-key columns and null ratios."""
    columns = profiles.select(
        "run_id",
        F.inline(
            F.array(
                F.struct(
                    F.lit("distribution").alias("kind"),
                    F.col("column").alias("column"),
                    F.when(~is_identifier(F.col("column")), F.col("mean")).alias("value"),
                    (F.col("ordinal") * 2 + 1).cast("bigint").alias("position"),
                ),
                F.struct(
                    F.lit("completeness").alias("kind"),
                    F.col("column").alias("column"),
                    F.col("null_ratio").alias("value"),
                    (F.col("ordinal") * 2 + 2).cast("bigint").alias("position"),
                ),
            )
        ),
    ).filter("value is not null")
    rows = run_rows.select(
        "run_id",
        F.lit("volume").alias("kind"),
        F.lit(None).cast("string").alias("column"),
        F.col("total_rows").cast("double").alias("value"),
        F.lit(0).cast("bigint").alias("position"),
    )
    return rows.unionByName(columns)


def history_anomalies(
    runs: DataFrame,
    profiles: DataFrame,
    targets: DataFrame | None = None,
    existing: DataFrame | None = None,
    seasonal: bool = False,
) -> DataFrame:
    """Small but sustained deviations from a source's usual range: median and MAD of up to 30 accepted runs.

    `existing(run_id, type, column)` are pairs already raised; they are not raised again.
    """
    targets = runs if targets is None else targets
    keys = ["source_id", "config_hash"]
    if seasonal:
        runs = runs.select("*", *cohort(F.col("run_ts")))
        targets = targets.select("*", *cohort(F.col("run_ts")))
        keys += ["weekday", "hour"]
    minimum = MIN_COHORT_HISTORY if seasonal else MIN_HISTORY
    pairs = _history(runs, targets, keys).select("run_id", "base_run")
    metrics = melt(profiles, runs)
    past = pairs.join(metrics.withColumnRenamed("run_id", "base_run"), "base_run")
    on = ["run_id", "kind", F.coalesce("column", F.lit("")).alias("slot")]
    centers = past.groupBy(*on).agg(
        F.percentile("value", 0.5).alias("center"),
        F.count("value").alias("runs"),
        F.collect_list("value").alias("values"),  # at most MAX_HISTORY numbers
    )
    spread = centers.withColumn("value", F.explode("values")).groupBy("run_id", "kind", "slot").agg(
        F.max("center").alias("center"),
        F.max("runs").alias("runs"),
        F.percentile(F.abs(F.col("value") - F.col("center")), 0.5).alias("mad"),
    )
    current = melt(profiles, targets).withColumn("slot", F.coalesce("column", F.lit("")))
    judged = current.join(spread.filter(F.col("runs") >= minimum), ["run_id", "kind", "slot"])
    if existing is not None:
        raised = existing.select(
            "run_id", F.col("type").alias("kind"), F.coalesce("column", F.lit("")).alias("slot")
        ).distinct()
        judged = judged.join(raised, ["run_id", "kind", "slot"], "left_anti")
    center, value = F.col("center"), F.col("value")
    sigma = F.greatest(MAD_TO_SIGMA * F.col("mad"), 0.02 * F.abs(center), F.lit(1e-9))
    z = (value - center) / sigma
    relative = F.abs(value - center) / F.greatest(F.abs(center), F.lit(1e-9)) >= 0.05
    practical = F.when(F.col("kind") == "completeness", (value - center >= 0.02) & (z >= 0)).otherwise(relative)
    score = F.least(F.lit(1.0), 0.58 + F.least(F.abs(z), F.lit(30.0)) / 75.0)
    facts = evidence(
        method="history",
        z_score=F.round(F.greatest(F.lit(-1e6), F.least(F.lit(1e6), z)), 3),
        typical=F.round(center, 6),
        history_runs=F.col("runs"),
        current=value,
    )
    fired = judged.filter((F.abs(z) >= HISTORY_Z) & practical).select(
        "run_id",
        (F.lit(HISTORY_SEQ) + F.col("position")).cast("bigint").alias("seq"),
        F.col("kind").alias("type"),
        "column",
        score.alias("score"),
        F.lit("baseline").alias("source"),
        facts.alias("evidence"),
    )
    return finish(fired, ["run_id"])


def learned_staleness(
    runs: DataFrame,
    profiles: DataFrame,
    columns: Sequence[str],
    targets: DataFrame | None = None,
    minimum_runs: int = 5,
) -> DataFrame:
    """Freshness without a configured limit: the usual lag between a run and its newest value is learned."""
    targets = runs if targets is None else targets
    newest = profiles.filter(F.col("column").isin(list(columns)) & F.col("max_ts").isNotNull()).select(
        "run_id", "column", "ordinal", "max_ts"
    )

    def lags(table: DataFrame) -> DataFrame:
        return table.select("run_id", "run_ts").join(newest, "run_id").select(
            "run_id", "column", "ordinal", "max_ts", minutes_between(F.col("run_ts"), F.col("max_ts")).alias("lag")
        )

    pairs = _history(runs, targets, ["source_id", "config_hash"]).select("run_id", "base_run")
    past = pairs.join(lags(runs).select(F.col("run_id").alias("base_run"), "column", "lag"), "base_run")
    centers = past.groupBy("run_id", "column").agg(
        F.percentile("lag", 0.5).alias("typical"),
        F.count("lag").alias("runs"),
        F.collect_list("lag").alias("lags"),  # at most MAX_HISTORY numbers
    )
    spread = centers.withColumn("lag", F.explode("lags")).groupBy("run_id", "column").agg(
        F.max("typical").alias("typical"),
        F.max("runs").alias("runs"),
        F.percentile(F.abs(F.col("lag") - F.col("typical")), 0.5).alias("mad"),
    )
    judged = lags(targets).join(spread.filter(F.col("runs") >= minimum_runs), ["run_id", "column"])
    typical, lag = F.col("typical"), F.col("lag")
    threshold = F.greatest(typical + 6 * MAD_TO_SIGMA * F.col("mad"), 2 * typical, typical + 15)
    score = F.least(F.lit(1.0), 0.5 + F.least(lag / threshold - 1, F.lit(1.0)) * 0.4)
    facts = evidence(
        method="learned",
        lag_minutes=F.round(lag, 1),
        typical_lag_minutes=F.round(typical, 1),
        threshold_minutes=F.round(threshold, 1),
        history_runs=F.col("runs"),
        latest_value=F.col("max_ts"),
    )
    fired = judged.filter(lag > threshold).select(
        "run_id",
        (F.lit(STALENESS_SEQ) + F.col("ordinal")).cast("bigint").alias("seq"),
        F.lit("staleness").alias("type"),
        "column",
        score.alias("score"),
        F.lit("baseline").alias("source"),
        facts.alias("evidence"),
    )
    return finish(fired, ["run_id"])


def schema_diff(profiles: DataFrame, runs: DataFrame) -> DataFrame:
    """(dataset, run_id, column, change): dropped = known for the dataset but not profiled in this run,
    added = profiled now and never in an earlier run."""
    seen = profiles.select("dataset", "run_id", "column").distinct().join(runs.select("run_id", "run_ts"), "run_id")
    first = seen.groupBy("dataset", "column").agg(F.min("run_ts").alias("first_ts"))
    # One array per dataset and one per run; both are bounded by the number of columns.
    known = first.groupBy("dataset").agg(F.collect_list(F.struct("column", "first_ts")).alias("known"))
    present = seen.groupBy("dataset", "run_id", "run_ts").agg(F.collect_set("column").alias("present"))
    found = present.join(known, "dataset").select(
        "dataset", "run_id", "run_ts", "present", F.inline("known")
    )
    here = F.array_contains("present", F.col("column"))
    change = F.when(~here & (F.col("first_ts") < F.col("run_ts")), "dropped").when(
        here & (F.col("first_ts") == F.col("run_ts")), "added"
    )
    return found.select("dataset", "run_id", "column", change.alias("change")).filter("change is not null")


def schema_catalog(column_types: DataFrame, runs: DataFrame) -> DataFrame:
    """Canonical type per (dataset, column): the newest type of runs without a fault mark; a column known
    only from fault-marked runs keeps its first type."""
    typed = column_types.select("dataset", "run_id", "column", "type").join(
        runs.select("run_id", "run_ts", "fault_id"), "run_id"
    )
    order = F.struct("run_ts", "run_id")
    healthy = F.col("fault_id").isNull()
    return typed.groupBy("dataset", "column").agg(
        F.coalesce(F.max_by(F.when(healthy, F.col("type")), F.when(healthy, order)), F.min_by("type", order)).alias(
            "type"
        ),
        F.min("run_ts").alias("first_seen"),
        F.max("run_ts").alias("last_seen"),
    )


def column_type_rows(df: DataFrame, dataset: str, run_id: str) -> list[tuple]:
    """Rows for `schema_catalog` from a DataFrame's schema."""
    return [(dataset, run_id, f.name, contract_type(f.dataType) or "string") for f in df.schema.fields]


def accept_runs(runs: DataFrame, signals: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """Which runs may join the baseline: clean ones; automatically when clean and the baseline was ready; as
    an expected change when every signal comes from history comparison and the run is its source's newest."""
    found = signals.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("signals"),
        F.bool_and(F.col("source").isin("baseline", "segment")).alias("history_only"),
    )
    newest = runs.groupBy("source_id").agg(F.max_by("run_id", F.struct("run_ts", "run_id")).alias("newest_run"))
    joined = runs.select("source_id", "run_id").join(found, "run_id", "left").join(newest, "source_id")
    if states is not None:
        joined = joined.join(states.select("run_id", "state"), "run_id", "left")
    else:
        joined = joined.withColumn("state", F.lit("ready"))
    clean = F.coalesce(F.col("signals"), F.lit(0)) == 0
    return joined.select(
        "source_id",
        "run_id",
        clean.alias("can_accept"),
        (clean & (F.coalesce(F.col("state"), F.lit("")) == "ready")).alias("auto_accept"),
        (~clean & F.col("history_only") & (F.col("run_id") == F.col("newest_run"))).alias("expected_change"),
    )
