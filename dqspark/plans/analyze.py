"""The whole analysis of one table or of all its runs, composed from the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqspark.functions.columns import q
from dqspark.operators import baseline, drift, joint, joint_runs
from dqspark.operators.contract import check_contract
from dqspark.operators.profile import mask_sensitive, profile_segments, profile_table
from dqspark.operators.scoring import incident_risk, number_signals, score_violations
from dqspark.runtime import materialize


@dataclass
class Options:
    """What an analysis looks at besides the contract."""

    seasonal: bool = False
    segment_by: Sequence[str] = ()
    max_segments: int | None = None
    adaptive: bool = True
    learned_freshness: Sequence[str] = ()
    sensitive_columns: Sequence[str] = ()
    forest: bool = False
    #: Joint drift of every run against its baseline run, over these numeric columns (all of them with True).
    joint_drift: bool | Sequence[str] = False
    joint_min_rows: int = joint.MIN_ROWS
    exact: bool = True
    parts: Sequence[str] = ("distinct", "quantiles", "top", "hash")
    references: Mapping[str, DataFrame] = field(default_factory=dict)


@dataclass
class History:
    """Earlier runs of the source: run rows, their profiles and, for segments, their segment profiles."""

    runs: DataFrame
    profiles: DataFrame
    segments: DataFrame | None = None


class Analysis(NamedTuple):
    """Tables of an analysis; `segments` (the segment profiles) is None unless segments were asked for. Stored profiles and
    segments of accepted runs are the History of the next one."""

    profiles: DataFrame
    signals: DataFrame
    runs: DataFrame
    segments: DataFrame | None


def _known(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def analyze_table(
    df: DataFrame,
    contract: Mapping,
    history: History | None,
    as_of,
    run_id: str,
    source_id: str = "source",
    config_hash: str = "default",
    options: Options | None = None,
    reference: DataFrame | None = None,
) -> Analysis:
    """Profiles, signals, run and segment profiles of one batch against the accepted history of its source.

    `reference` is the stored data of the newest accepted run for the joint test.
    """
    stamped = df.withColumn("run_id", F.lit(run_id))
    runs = df.agg(F.count(F.lit(1)).alias("total_rows")).select(
        F.lit(source_id).alias("source_id"),
        F.lit(run_id).alias("run_id"),
        F.lit(as_of).cast("timestamp_ntz").alias("run_ts"),
        F.lit(config_hash).alias("config_hash"),
        F.lit("candidate").alias("quality"),  # no run is its own history
        "total_rows",
    )
    return _analyze(stamped, contract, runs, history, F.lit(as_of), options or Options(), reference)


def analyze_runs(
    df: DataFrame,
    contract: Mapping,
    runs: DataFrame,
    options: Options | None = None,
    as_of=None,
) -> Analysis:
    """The same for every run inside a table that carries a `run_id` column, in one job.

    `runs(source_id, run_id, run_ts, quality, config_hash, total_rows)`. The `quality` labels decide which
    runs may serve as history; each run only sees earlier ones.
    """
    options = options or Options()
    runs = materialize(runs)
    return _analyze(df, contract, runs, None, as_of, options, None)


def _analyze(df, contract, runs, history, as_of, options: Options, reference):
    keys = ["run_id"]
    plain = [c for c in df.columns if c not in ("run_id", *options.segment_by)]
    profiles = materialize(
        profile_table(df, keys, exact=options.exact, parts=options.parts)
    )
    past_runs = runs if history is None else history.runs
    past_profiles = profiles if history is None else history.profiles
    every_profile = (
        profiles if history is None else profiles.unionByName(_like(past_profiles, profiles), allowMissingColumns=True)
    )

    found = [score_violations(check_contract(df, contract, as_of, options.references, keys))]
    states, base = baseline.choose_baseline(past_runs, past_profiles, runs, options.seasonal)
    states = materialize(states)
    found.append(drift.drift_columns(base, profiles, keys))
    counts = runs.select("run_id", F.col("total_rows").alias("row_count"))
    found.append(drift.empty_dataset(counts, keys))
    ready = states.filter("state = 'ready'")
    found.append(drift.drift_volume(ready.select("run_id", "row_count"), counts, keys))
    segments = None
    if options.segment_by:
        current = profile_segments(
            df.select("run_id", *options.segment_by, *[q(c) for c in plain]), options.segment_by, keys, options.max_segments, parts=("distinct",)
        )
        if set(options.segment_by) & set(options.sensitive_columns):
            # Labels would show raw values; digests compare just as well from run to run.
            current = current.withColumn("segment", F.concat(F.lit("sha256:"), F.sha2("segment", 256)))
        segments = current = materialize(current)
        past_segments = current if history is None else history.segments
        if past_segments is not None:
            pairs = ready.select("run_id", F.col("newest_base").alias("base_run"))
            previous = drift.shift_baseline(past_segments, pairs)
            # Runs without a ready baseline have no previous side and therefore no segment signals.
            found.append(drift.drift_segments(previous, current, keys))
    signals = found[0]
    for part in found[1:]:
        signals = signals.unionByName(part, allowMissingColumns=True)
    if "segment" not in signals.columns:
        signals = signals.withColumn("segment", F.lit(None).cast("string"))
    signals = materialize(signals)
    later = []
    if options.adaptive:
        history_runs = past_runs
        existing = signals.select("run_id", "type", "column").distinct()
        later.append(
            baseline.history_anomalies(
                _with_targets(history_runs, runs, history), every_profile, runs, existing, options.seasonal
            )
        )
    if reference is not None:
        joint_signal = joint.multivariate_drift(reference, df.drop("run_id"), forest=options.forest)
        only = runs.first()["run_id"]
        later.append(joint_signal.withColumn("run_id", F.lit(only)))
    elif options.joint_drift and history is None:
        pairs = ready.select("run_id", F.col("newest_base").alias("base_run"))
        chosen = None if options.joint_drift is True else list(options.joint_drift)
        later.append(joint_runs.joint_by_run(df, pairs, chosen, min_rows=options.joint_min_rows))
    if options.learned_freshness:
        later.append(
            baseline.learned_staleness(
                _with_targets(past_runs, runs, history), every_profile, options.learned_freshness, runs
            )
        )
    for part in later:
        signals = signals.unionByName(part, allowMissingColumns=True)
    signals = number_signals(signals, keys)
    if options.sensitive_columns:
        profiles = mask_sensitive(profiles, options.sensitive_columns)
        segments = segments and mask_sensitive(segments, options.sensitive_columns)
        signals = mask_sensitive(signals, options.sensitive_columns)
    signals = materialize(signals)
    summary = runs.join(incident_risk(signals, keys, runs), keys).join(
        states.select("run_id", "state", F.col("newest_base").alias("baseline_run")), keys, "left"
    )
    return Analysis(profiles, signals, summary, segments)


def _like(df: DataFrame, wanted: DataFrame) -> DataFrame:
    return _known(df, wanted.columns)


def _with_targets(past_runs: DataFrame, runs: DataFrame, history) -> DataFrame:
    """History rows plus the current run, which is no history itself (its quality is not accepted)."""
    if history is None:
        return past_runs
    wanted = ["source_id", "run_id", "run_ts", "quality", "config_hash", "total_rows"]
    current = runs.withColumn("quality", F.lit("candidate")).select(*wanted)
    return past_runs.select(*wanted).unionByName(current)
