"""Drift of one profile against another: expressions over a small join of two profile tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.functions.columns import evidence, is_identifier, rounded_score, severity
from dqspark.operators.contract import check_contract
from dqspark.operators.scoring import number_signals, score_violations
from dqspark.types import SIGNAL_STRUCT

# Thresholds of the drift tests.
Z_THRESHOLD = 3.0
NULL_DELTA = 0.05
SE_THRESHOLD = 6.0
SE_SHIFT = 0.10
SE_MIN_ROWS = 30
CARDINALITY_CHANGE = 0.5
CARDINALITY_MIN_DISTINCT = 3
VOLUME_CHANGE = 0.3
TINY = 1e-9

# Report order inside one run: contract, column drift, then dataset-level signals.
DRIFT_SEQ = 1_000_000
SEGMENT_SEQ = 15_000_000
VOLUME_SEQ = 10_000_000

_METRICS = ("row_count", "null_ratio", "distinct_ratio", "mean", "stddev")


def _signal(seq: Column, kind: str, column: Column, score: Column, facts: Column, source: str = "baseline") -> Column:
    return F.struct(
        seq.cast("bigint").alias("seq"),
        F.lit(kind).alias("type"),
        column.cast("string").alias("column"),
        score.cast("double").alias("score"),
        F.lit(source).alias("source"),
        facts.alias("evidence"),
    ).cast(SIGNAL_STRUCT)


def pair_profiles(base: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Columns present in both profiles, base metrics prefixed with `b_`. `keys` are shared run keys."""
    on = [*keys, "column"]
    before = base.select(*on, *[F.col(m).alias(f"b_{m}") for m in _METRICS])
    return current.select(*on, "ordinal", *_METRICS).join(before, on)


def completeness_drift(delta: float = NULL_DELTA) -> Column:
    change = F.col("null_ratio") - F.col("b_null_ratio")
    facts = evidence(baseline_null_ratio=F.col("b_null_ratio"), current_null_ratio=F.col("null_ratio"))
    return F.when(
        change > delta,
        _signal(_seq(0), "completeness", F.col("column"), F.least(F.lit(1.0), 0.5 + change), facts),
    )


def _seq(k: int) -> Column:
    return F.lit(DRIFT_SEQ + k) + F.col("ordinal") * 10


def _mean_usable() -> Column:
    return ~is_identifier(F.col("column")) & F.col("mean").isNotNull() & F.col("b_mean").isNotNull()


def _z_fires(z: Column, threshold: float) -> Column:
    return _mean_usable() & (F.col("b_stddev") > TINY) & (F.abs(z) >= threshold)


def _z() -> Column:
    usable = F.when(F.col("b_stddev") > TINY, F.col("b_stddev"))
    return (F.col("mean") - F.col("b_mean")) / usable


def mean_z_drift(threshold: float = Z_THRESHOLD) -> Column:
    """Mean moved by several standard deviations of the baseline rows."""
    z = _z()
    facts = evidence(
        z_score=F.round(z, 3),
        baseline_mean=F.col("b_mean"),
        current_mean=F.col("mean"),
        baseline_stddev=F.col("b_stddev"),
    )
    score = F.least(F.lit(1.0), (F.abs(z) - threshold) / threshold + 0.5)
    return F.when(_z_fires(z, threshold), _signal(_seq(1), "distribution", F.col("column"), score, facts))


def mean_se_drift(threshold: float = Z_THRESHOLD) -> Column:
    """Smaller mean shifts that the row-level z misses: significant by Welch standard error and at least 10 %."""
    n_base = F.col("b_row_count") * (1 - F.col("b_null_ratio"))
    n_now = F.col("row_count") * (1 - F.col("null_ratio"))
    sd_base = F.coalesce(F.col("b_stddev"), F.lit(0.0))
    sd_now = F.coalesce(F.col("stddev"), F.lit(0.0))
    diff = F.col("mean") - F.col("b_mean")
    error = F.sqrt(
        sd_base * sd_base / F.when(n_base > 0, n_base) + sd_now * sd_now / F.when(n_now > 0, n_now)
    )
    z = F.when(error > 1e-12, diff / F.when(error > 1e-12, error)).otherwise(
        F.when(diff < 0, F.lit(-1e6)).otherwise(F.lit(1e6))
    )
    shift = F.abs(diff) / F.greatest(F.abs(F.col("b_mean")), sd_base, F.lit(TINY))
    fires = (
        _mean_usable()
        & ~F.coalesce(_z_fires(_z(), threshold), F.lit(False))
        & (n_base >= SE_MIN_ROWS)
        & (n_now >= SE_MIN_ROWS)
        & (F.abs(z) >= SE_THRESHOLD)
        & (shift >= SE_SHIFT)
    )
    facts = evidence(
        method="standard_error",
        z_score=F.round(F.greatest(F.lit(-1e6), F.least(F.lit(1e6), z)), 3),
        relative_shift=F.round(shift, 4),
        baseline_mean=F.col("b_mean"),
        current_mean=F.col("mean"),
        baseline_stddev=sd_base,
    )
    score = F.least(F.lit(1.0), 0.45 + shift * 0.5)
    return F.when(fires, _signal(_seq(2), "distribution", F.col("column"), score, facts))


def cardinality_drift() -> Column:
    base, now = F.col("b_distinct_ratio"), F.col("distinct_ratio")
    change = (now - base) / F.when(base > TINY, base)
    fires = (
        ~is_identifier(F.col("column"))
        & (base * F.col("b_row_count") > CARDINALITY_MIN_DISTINCT)
        & (now * F.col("row_count") > CARDINALITY_MIN_DISTINCT)
        & (F.abs(change) >= CARDINALITY_CHANGE)
    )
    facts = evidence(baseline_distinct_ratio=base, current_distinct_ratio=now)
    score = F.least(F.lit(1.0), 0.4 + F.abs(change) * 0.4)
    return F.when(fires, _signal(_seq(3), "cardinality_drift", F.col("column"), score, facts))


def _emit(paired: DataFrame, keys: list[str], tests: Sequence[Column]) -> DataFrame:
    found = F.filter(F.array(*tests), lambda s: s.isNotNull())
    return paired.select(*keys, F.explode(found).alias("s")).select(*keys, "s.*")


def finish(raw: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Severity from the raw score, then the stored four-digit score."""
    rest = [c for c in raw.columns if c not in (*keys, "seq", "type", "column", "score", "source", "evidence", "severity")]
    return raw.select(
        *keys,
        "seq",
        "type",
        "column",
        severity(F.col("score")).alias("severity"),
        rounded_score(F.col("score")).alias("score"),
        "source",
        "evidence",
        *rest,
    )


TESTS = {
    "completeness": lambda z, d: completeness_drift(d),
    "mean_z": lambda z, d: mean_z_drift(z),
    "mean_se": lambda z, d: mean_se_drift(z),
    "cardinality": lambda z, d: cardinality_drift(),
}


def drift_columns(
    base: DataFrame,
    current: DataFrame,
    keys: Sequence[str] = (),
    z: float = Z_THRESHOLD,
    null_delta: float = NULL_DELTA,
    tests: Sequence[str] = tuple(TESTS),
) -> DataFrame:
    """All column tests on one join of the two profile tables; `tests` picks single ones."""
    keys = list(keys)
    paired = pair_profiles(base, current, keys)
    return finish(_emit(paired, keys, [TESTS[t](z, null_delta) for t in tests]), keys)


def drift_volume(base: DataFrame, current: DataFrame, keys: Sequence[str] = (), threshold: float = VOLUME_CHANGE) -> DataFrame:
    """Row counts (keys…, row_count) of both sides; a relative change of at least `threshold` is a signal."""
    keys = list(keys)
    if keys:
        paired = current.select(*keys, "row_count").join(
            base.select(*keys, F.col("row_count").alias("b_row_count")), keys
        )
    else:
        both = current.select(F.col("row_count").alias("row_count"), F.lit(None).cast("bigint").alias("b_row_count"))
        other = base.select(F.lit(None).cast("bigint").alias("row_count"), F.col("row_count").alias("b_row_count"))
        paired = both.unionByName(other).agg(
            F.max("row_count").alias("row_count"), F.max("b_row_count").alias("b_row_count")
        )
    return finish(_emit(paired, keys, [volume_change(threshold)]), keys)


def volume_change(threshold: float = VOLUME_CHANGE, seq: int = VOLUME_SEQ) -> Column:
    base = F.col("b_row_count")
    change = (F.col("row_count") - base) / F.when(base > 0, base)
    facts = evidence(
        baseline_row_count=base, current_row_count=F.col("row_count"), relative_change=F.round(change, 4)
    )
    return F.when(
        F.abs(change) >= threshold,
        _signal(F.lit(seq), "volume", F.lit(None), F.least(F.lit(1.0), F.abs(change)), facts),
    )


def run_counts(profiles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys…, row_count) out of a profile table."""
    if keys:
        return profiles.groupBy(*keys).agg(F.max("row_count").alias("row_count"))
    return profiles.agg(F.max("row_count").alias("row_count"))


def shift_baseline(profiles: DataFrame, mapping: DataFrame, run: str = "run_id") -> DataFrame:
    """Profiles of the baseline run relabelled with the run they are compared to.

    `mapping` has one row per run: (run, base_run). It is metadata, one row per run.
    """
    pairs = mapping.select(F.col(run).alias("_now"), F.col("base_run").alias(run))
    return profiles.join(pairs, run).drop(run).withColumnRenamed("_now", run)


def detect(
    df: DataFrame,
    contract,
    base_profiles: DataFrame | None,
    as_of=None,
    current_profiles: DataFrame | None = None,
    references=None,
    runs: Sequence[str] = (),
    copies: Sequence[str] = (),
) -> DataFrame:
    """Contract signals, then column drift in column order, then volume; one table or many runs.

    `base_profiles` carries the baseline of each run under that run's own key (see `shift_baseline`). `copies` as in
    `profile_table`.
    """
    from dqspark.operators.profile import profile_table

    runs = list(runs)
    signals = score_violations(check_contract(df, contract, as_of, references, runs, copies))
    if base_profiles is not None:
        if current_profiles is None:
            current_profiles = profile_table(df, runs, parts=("distinct",), copies=copies)
        signals = signals.unionByName(drift_columns(base_profiles, current_profiles, runs))
        volume = drift_volume(run_counts(base_profiles, runs), run_counts(current_profiles, runs), runs)
        signals = signals.unionByName(volume)
    return number_signals(signals, runs)


def drift_segments(previous: DataFrame, current: DataFrame, runs: Sequence[str] = ()) -> DataFrame:
    """Segment profiles of two runs: a vanished segment is a signal, shared segments get every drift test,
    new segments are ignored."""
    keys = [*runs, "segment"]
    gone = run_counts(previous, keys).join(current.select(*keys).distinct(), keys, "left_anti")
    missing = gone.select(
        *keys,
        F.lit(SEGMENT_SEQ).cast("bigint").alias("seq"),
        F.lit("segment_missing").alias("type"),
        F.lit(None).cast("string").alias("column"),
        F.lit(0.8).alias("score"),
        F.lit("segment").alias("source"),
        evidence(segment=F.col("segment")).alias("evidence"),
    )
    volume = drift_volume(run_counts(previous, keys), run_counts(current, keys), keys).withColumn(
        "seq", F.lit(SEGMENT_SEQ + 1).cast("bigint")
    )
    columns = drift_columns(previous, current, keys).withColumn("seq", F.col("seq") - DRIFT_SEQ + SEGMENT_SEQ + 2)
    found = (
        volume.unionByName(columns)
        .withColumn("source", F.lit("segment"))
        .withColumn("evidence", F.map_concat("evidence", F.create_map(F.lit("segment"), F.col("segment"))))
    )
    # A missing segment is high by definition, whatever its score.
    gone_signals = finish(missing, keys).withColumn("severity", F.lit("high"))
    return gone_signals.unionByName(found)


def empty_dataset(counts: DataFrame, runs: Sequence[str] = ()) -> DataFrame:
    """Runs of (runs…, row_count) without a single row."""
    return counts.filter(F.col("row_count") == 0).select(
        *runs,
        F.lit(VOLUME_SEQ - 1).cast("bigint").alias("seq"),
        F.lit("empty_dataset").alias("type"),
        F.lit(None).cast("string").alias("column"),
        F.lit("high").alias("severity"),
        F.lit(0.8).alias("score"),
        F.lit("contract").alias("source"),
        evidence(row_count=F.col("row_count")).alias("evidence"),
    )
