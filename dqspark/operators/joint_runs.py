"""Joint drift of all runs of a table at once: one Mahalanobis model per baseline run, a fixed number of scans.

Moments are one grouped aggregate, quartiles and thresholds are grouped selections, and the only Python is linear algebra on
one row of k x k numbers per baseline run. Rows meet their model through an equi join on the run; distances are arithmetic.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.functions.columns import is_identifier_name, nan_to_null, q
from dqspark.operators.drift import finish
from dqspark.operators.joint import CONTAMINATION, JOINT_SEQ, MIN_ROWS, RIDGE, _fires, _judge, median_shift
from dqspark.operators.profile import exact_quantiles
from dqspark.runtime import broadcast_if_small, materialize
from dqspark.types import contract_type

# Models that a broadcast may hold; more of them, or wider ones, are joined by a shuffle.
MODEL_BYTES = 64_000_000

MODEL = "base_run string, known bigint, used array<int>, mean array<double>, scale array<double>, inverse array<double>, median array<double>, iqr array<double>"
SIGNAL = "run_id string, seq bigint, type string, column string, score double, source string, evidence map<string,string>"


def numeric_columns(df: DataFrame) -> list[str]:
    return [
        f.name for f in df.schema.fields if contract_type(f.dataType) in ("integer", "float") and not is_identifier_name(f.name) and f.name != "run_id"
    ]


def _complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    named = [q(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]
    names = [f"c{i}" for i in range(len(columns))]
    return nan_to_null(df.select(F.col("run_id").cast("string").alias("run_id"), *named), names).dropna(subset=names)


def _quartiles(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """run_id, quartiles array<struct<q0, q1, q2>> in the order of the columns."""
    found = exact_quantiles(rows, names, (0.25, 0.5, 0.75), ["run_id"])
    each = F.struct(F.substring("column", 2, 9).cast("int").alias("at"), "q0", "q1", "q2")
    return found.groupBy("run_id").agg(F.sort_array(F.collect_list(each)).alias("quartiles"))


def _moments(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    return rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("known"),
        F.array(*[F.avg(c) for c in names]).alias("mean"),
        F.array(*[F.stddev_samp(c) for c in names]).alias("deviation"),
        F.array(*[F.max(c) > F.min(c) for c in names]).alias("varies"),
        F.array(*[F.covar_samp(a, b) for a, b in pairs]).alias("covariance"),
    )


def _solve(k: int):
    """Model of each row of moments and quartiles: scale, and the inverse over the columns that vary in the run (0 elsewhere)."""

    def run(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                iqr = np.array([x["q2"] - x["q0"] for x in row.quartiles])
                deviation = np.nan_to_num(np.array(row.deviation, float))
                scale = np.where(iqr != 0, iqr, deviation)
                scale[~(scale > 0)] = 1.0
                full = np.zeros((k, k))
                full[np.triu_indices(k)] = np.nan_to_num(np.array(row.covariance, float))
                full = (full + np.triu(full, 1).T) / np.outer(scale, scale)
                used = np.flatnonzero(np.array(row.varies, bool))
                inverse = np.zeros((k, k))
                if len(used) > 1:
                    part = full[np.ix_(used, used)]
                    inverse[np.ix_(used, used)] = np.linalg.pinv(part + RIDGE * np.trace(part) / len(used) * np.eye(len(used)))
                median = [x["q1"] for x in row.quartiles]
                out.append((row.run_id, row.known, used.tolist(), list(row.mean), scale.tolist(), inverse.ravel().tolist(), median, iqr.tolist()))
            yield pd.DataFrame(out, columns=["base_run", "known", "used", "mean", "scale", "inverse", "median", "iqr"])

    return run


def _distance(k: int) -> Column:
    """Squared distance of the columns c0, c1, … to the model in the same row."""
    z = [(F.col(f"c{i}") - F.col("mean")[i]) / F.col("scale")[i] for i in range(k)]
    total = F.lit(0.0)
    for i in range(k):
        for j in range(i, k):
            total = total + F.col("inverse")[i * k + j] * (1.0 if i == j else 2.0) * z[i] * z[j]
    return total


def joint_counts(
    df: DataFrame,
    pairs: DataFrame,
    columns: Sequence[str] | None = None,
    contamination: float = CONTAMINATION,
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """run_id, base_run, rows, flagged, known and the model's parts, for each of pairs(run_id, base_run) that can be tested.

    `df` holds the rows of all runs under run_id. A run is tested if both runs have min_rows complete rows and two or more
    columns vary in the baseline. A row is flagged beyond the (1 - contamination) quantile of the baseline's own distances.
    """
    columns = list(columns or numeric_columns(df))
    k, names = len(columns), [f"c{i}" for i in range(len(columns))]
    pairs = materialize(pairs.select(F.col("run_id").cast("string").alias("run_id"), F.col("base_run").cast("string").alias("base_run")).dropna().distinct())
    wanted = pairs.select("run_id").union(pairs.select("base_run")).distinct()
    rows = _complete(df, columns).join(broadcast_if_small(materialize(wanted)), "run_id", "left_semi")
    quartiles = materialize(_quartiles(rows, names))
    moments = _moments(rows, names).join(quartiles, "run_id")
    models = materialize(moments.mapInPandas(_solve(k), MODEL).filter((F.col("known") >= min_rows) & (F.size("used") > 1)))
    few = MODEL_BYTES // (8 * (k * k + 5 * k) + 200)
    small = lambda df: broadcast_if_small(df, few)
    own = rows.withColumnRenamed("run_id", "base_run").join(small(models), "base_run").select("base_run", _distance(k).alias("distance"))
    limits = exact_quantiles(own, ["distance"], (1 - contamination,), ["base_run"]).select("base_run", F.col("q0").alias("limit"))
    judged = materialize(pairs.join(models, "base_run").join(limits, "base_run"))
    beside = rows.join(small(judged.select("run_id", "mean", "scale", "inverse", "limit")), "run_id")
    counts = beside.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(_distance(k) > F.col("limit")).alias("flagged")
    )
    after = quartiles.select("run_id", F.transform("quartiles", lambda x: x["q1"]).alias("now"))
    tested = judged.select("run_id", "base_run", "known", "used", "median", "iqr").join(counts, "run_id").join(after, "run_id")
    return tested.filter(F.col("rows") >= min_rows)


def joint_by_run(
    df: DataFrame,
    pairs: DataFrame,
    columns: Sequence[str] | None = None,
    contamination: float = CONTAMINATION,
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """At most one `multivariate_drift` signal per run of pairs(run_id, base_run); all rows count, nothing is sampled.

    Rows with a null or NaN in one of the columns are left out, as are runs that cannot be tested (see joint_counts);
    a table with fewer than two numeric columns gives no rows.
    """
    columns = list(columns or numeric_columns(df))
    if len(columns) < 2:
        return finish(df.sparkSession.createDataFrame([], SIGNAL), ["run_id"])

    def run(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                found = _judge(int(row.flagged), int(row.rows), contamination)
                if not _fires(found, contamination):
                    continue
                used = [int(i) for i in row.used]
                facts = {
                    "method": "mahalanobis",
                    "outlier_rate": str(found["rate"]),
                    "expected_rate": str(contamination),
                    "rows": str(row.rows),
                    "flagged_rows": str(found["flagged_rows"]),
                    "columns": ",".join(columns[i] for i in used),
                    "p_value": str(found["p_value"]),
                    "mahalanobis_rate": str(found["rate"]),
                    "baseline_run": row.base_run,
                    **median_shift({columns[i]: (row.median[i], row.iqr[i]) for i in used}, {columns[i]: row.now[i] for i in used}),
                }
                out.append((row.run_id, JOINT_SEQ, "multivariate_drift", None, min(1.0, 0.5 + found["rate"]), "baseline", facts))
            yield pd.DataFrame(out, columns=["run_id", "seq", "type", "column", "score", "source", "evidence"])

    counts = joint_counts(df, pairs, columns, contamination, min_rows)
    return finish(counts.mapInPandas(run, SIGNAL), ["run_id"])
