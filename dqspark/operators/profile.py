"""Column profiles: one wide aggregate for moments, one value-count shuffle per kind for everything exact.

The wide aggregate combines on the map side. Distinct counts, top values and the value hash read the same
pre-aggregated (run, column, value) counts, so a value that fills a third of the table is one row after the
first combine. Exact quantiles are selected by rank (see quantiles.py) and shuffle only what lies near them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dqspark.functions.columns import nan_to_null, q
from dqspark.operators.quantiles import bracket_sketch, select_quantiles
from dqspark.runtime import materialize
from dqspark.types import contract_type, kind_of

PARTS = ("distinct", "quantiles", "top", "hash")
QUANTILES = (0.50, 0.95, 0.99)
TOP_VALUES = 5
HASH_VALUES = 200
TOP_TYPE = "array<struct<value:string,count:bigint>>"

#: Error of the sketch quantiles and distinct counts of `exact=False`: 1 / ACCURACY of the rank, 5 % of the count.
ACCURACY = 1_000
LONG_TEXT = 64


def _columns(df: DataFrame, runs: Sequence[str], columns: Sequence[str] | None):
    fields = {f.name: f for f in df.schema.fields}
    names = [c for c in (columns or df.columns) if c not in runs]
    return [(i, name, fields[name].dataType) for i, name in enumerate(names)]


def _wide_stats(
    df: DataFrame, runs: Sequence[str], columns, brackets: Sequence[float] = (), approximate: bool = False
) -> DataFrame:
    """One row per (run, column): counts, moments and ranges, all from a single partial aggregate."""
    aggregates = [F.count(F.lit(1)).alias("n")]
    entries = []
    null = F.lit(None)
    for i, name, data_type in columns:
        kind = kind_of(data_type)
        source = q(name)
        wanted: dict[str, Column] = {"nn": F.count(source)}
        if kind == "numeric":
            number = source.cast("double")
            wanted.update(
                mean=F.avg(number), sd=F.stddev_pop(number), mn=F.min(number), mx=F.max(number)
            )
            if brackets:
                wanted["br"] = bracket_sketch(number, brackets)
            if approximate:
                wanted["qs"] = F.percentile_approx(number, list(QUANTILES), ACCURACY)
        if kind == "datetime":
            instant = source.cast("timestamp_ntz")
            wanted.update(t0=F.min(instant), t1=F.max(instant))
        if approximate and kind != "opaque":
            wanted["dc"] = F.approx_count_distinct(source)
        for key, column in wanted.items():
            aggregates.append(column.alias(f"{key}_{i}"))

        def part(key: str, spark_type: str, wanted=wanted, i=i) -> Column:
            column = F.col(f"{key}_{i}") if key in wanted else null
            return column.cast(spark_type)

        entries.append(
            F.struct(
                F.lit(name).alias("column"),
                F.lit(i).alias("ordinal"),
                F.lit(kind).alias("kind"),
                F.col("n").alias("row_count"),
                part("nn", "bigint").alias("non_null"),
                part("mean", "double").alias("mean"),
                part("sd", "double").alias("stddev"),
                part("mn", "double").alias("min"),
                part("mx", "double").alias("max"),
                part("t0", "timestamp_ntz").alias("min_ts"),
                part("t1", "timestamp_ntz").alias("max_ts"),
                part("br", "array<double>").alias("brackets"),
                part("qs", "array<double>").alias("approx_quantiles"),
                part("dc", "bigint").alias("approx_distinct"),
            )
        )
    grouped = df.groupBy(*runs).agg(*aggregates) if runs else df.agg(*aggregates)
    return grouped.select(*runs, F.inline(F.array(*entries)))


def value_counts(df: DataFrame, runs: Sequence[str], columns) -> DataFrame:
    """(run, ordinal, value, freq) over the given (ordinal, name, type) columns, nulls left out.

    Integers, floats and everything else keep their own typed key, so long keys stay exact and no number
    is turned into text before the shuffle.
    """
    entries = []
    for i, name, data_type in columns:
        kind = contract_type(data_type)
        source = q(name)
        entries.append(
            F.struct(
                F.lit(i).alias("ordinal"),
                (source if kind == "integer" else F.lit(None)).cast("bigint").alias("lval"),
                (source if kind == "float" else F.lit(None)).cast("double").alias("dval"),
                (source.cast("string") if kind not in ("integer", "float") else F.lit(None).cast("string")).alias("sval"),
            )
        )
    return (
        df.select(*[q(r) for r in runs], F.inline(F.array(*entries)))
        .filter("lval is not null or dval is not null or sval is not null")
        .groupBy(*runs, "ordinal", "lval", "dval", "sval")
        .agg(F.count(F.lit(1)).alias("freq"))
    )


def distinct_values(df: DataFrame, runs: Sequence[str], columns, copies: Sequence[str] = ()) -> DataFrame:
    """(runs…, ordinal, distinct) of (ordinal, name, type) columns of one contract type, nulls left out. The values
    themselves are not needed, so long texts travel as their sha256. With `copies` a value carries the set of copies
    that hold it, as bits."""
    kind = contract_type(columns[0][2])
    key = {"integer": "bigint", "float": "double", "datetime": "timestamp_ntz"}.get(kind, "string")
    values = []
    for i, name, _ in columns:
        value = q(name).cast(key)
        if kind == "string":
            value = F.when(F.length(value) > LONG_TEXT, F.sha2(value, 256)).otherwise(value)
        values.append(F.struct(F.lit(i).alias("ordinal"), value.alias("_value")))
    listed = F.inline(F.array(*values)) if len(values) > 1 else values[0].alias("_one")
    known = df.select(*[q(r) for r in runs], listed)
    if len(values) == 1:
        known = known.select(*[q(r) for r in runs], "_one.*")
    known = known.filter("_value is not null")
    if not copies:
        return known.distinct().groupBy(*runs, "ordinal").agg(F.count(F.lit(1)).alias("distinct"))
    bit = F.coalesce(*[F.when(q(runs[0]) == c, F.lit(1 << i).cast("bigint")) for i, c in enumerate(copies)])
    held = known.groupBy("ordinal", "_value").agg(F.bit_or(bit).alias("held"))
    of_copy = [F.count_if(F.getbit("held", F.lit(i)) == 1).alias(f"_{i}") for i in range(len(copies))]
    each = F.array(*[F.struct(F.lit(c).alias(runs[0]), F.col(f"_{i}").alias("distinct")) for i, c in enumerate(copies)])
    return held.groupBy("ordinal").agg(*of_copy).select("ordinal", F.inline(each)).select(*runs, "ordinal", "distinct")


def _text() -> Column:
    return F.coalesce(F.col("sval"), F.col("lval").cast("string"), F.col("dval").cast("string"))


def _distinct(counts: DataFrame, keys: list[str]) -> DataFrame:
    # Reading freq keeps the value counts identical to those of the other parts, so their exchange is reused.
    return counts.groupBy(*keys).agg(F.count_if(F.col("freq") > 0).alias("distinct"))


def _top(counts: DataFrame, keys: list[str], k: int) -> DataFrame:
    """k most frequent values; the rank filter becomes a per-task top-k before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(F.col("freq").desc(), F.col("sval").asc())
    ranked = counts.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)
    return ranked.groupBy(*keys).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "sval", "freq"))),
            lambda x: F.struct(x["sval"].alias("value"), x["freq"].alias("count")),
        ).alias("top_values")
    )


def _hash(counts: DataFrame, keys: list[str], k: int) -> DataFrame:
    """sha256 over the k smallest values as text, copies included."""
    window = Window.partitionBy(*keys).orderBy("text")
    smallest = (
        counts.select(*keys, "freq", _text().alias("text"))
        .withColumn("rank", F.row_number().over(window))
        .filter(F.col("rank") <= k)
    )
    repeated = F.flatten(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "text", "freq"))),
            lambda x: F.array_repeat(x["text"], F.least(x["freq"], F.lit(k)).cast("int")),
        )
    )
    return smallest.groupBy(*keys).agg(repeated.alias("values")).select(
        *keys,
        F.concat(
            F.lit("sha256:"), F.sha2(F.array_join(F.slice("values", 1, k), "|"), 256)
        ).alias("sample_hash"),
    )


def number_rows(df: DataFrame, runs: Sequence[str], columns) -> DataFrame:
    """(runs…, ordinal, v) of the numeric columns, nulls left out."""
    entries = [F.struct(F.lit(i).alias("ordinal"), q(name).cast("double").alias("v")) for i, name, _ in columns]
    return df.select(*[q(r) for r in runs], F.inline(F.array(*entries))).filter("v is not null")


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], runs: Sequence[str] = ()
) -> DataFrame:
    """(runs…, column, q0, q1, …): exact quantiles of numeric columns, distributed also for one huge group."""
    runs = list(runs)
    described = _columns(df, runs, columns)
    df = nan_to_null(df.select(*[q(c) for c in [*runs, *columns]]))
    stats = materialize(_wide_stats(df, runs, described, brackets=probabilities))
    found = select_quantiles(number_rows(df, runs, described), stats, runs, probabilities)
    return _attach(stats.select(*runs, "column", "ordinal", "non_null"), found, [*runs, "ordinal"]).drop("ordinal")


def folded_copies(runs: Sequence[str], copies: Sequence[str]) -> list[str]:
    """The copies, if they are few enough for one bit each and the table has no other run column."""
    return list(copies) if len(runs) == 1 and 1 < len(copies) < 64 else []


def raw_profile(
    df: DataFrame,
    runs: Sequence[str] = (),
    columns: Sequence[str] | None = None,
    exact: bool = True,
    parts: Sequence[str] = PARTS,
    top_k: int = TOP_VALUES,
    copies: Sequence[str] = (),
) -> DataFrame:
    """Unrounded counts and statistics behind `profile_table`."""
    copies = folded_copies(runs, copies)
    if set(parts) - set(PARTS):
        raise ValueError(f"unknown profile parts: {sorted(set(parts) - set(PARTS))}")
    runs = list(runs)
    described = _columns(df, runs, columns)
    df = nan_to_null(df.select(*[q(c) for c in [*runs, *[name for _, name, _ in described]]]))
    numeric = [c for c in described if kind_of(c[2]) == "numeric"]
    times = [c for c in described if kind_of(c[2]) == "datetime"]
    categorical = [c for c in described if kind_of(c[2]) == "categorical"]
    quantiles = exact and "quantiles" in parts and bool(numeric)

    result = stats = _wide_stats(df, runs, described, QUANTILES if quantiles else (), approximate=not exact)
    if quantiles:
        result = stats = materialize(stats)
    keys = [*runs, "ordinal"]
    pieces: list[DataFrame] = []
    if exact:
        needs_values = "hash" in parts or "top" in parts
        # One value count per kind: the kinds read disjoint columns, so nothing is read twice.
        kinds = {"n": numeric, "c": categorical, "t": times}
        counted = {k: value_counts(df, runs, group) for k, group in kinds.items() if group} if needs_values else {}
        by_type: dict[str, list] = {}
        for c in [c for group in kinds.values() for c in group]:
            by_type.setdefault(contract_type(c[2]), []).append(c)
        if "distinct" in parts and by_type and not needs_values:
            pieces.append(_union([distinct_values(df, runs, group, copies) for group in by_type.values()]))
        elif "distinct" in parts and counted:
            pieces.append(_union([_distinct(c, keys) for c in counted.values()]))
        if "hash" in parts and counted:
            pieces.append(_union([_hash(c, keys, HASH_VALUES) for c in counted.values()]))
        if "top" in parts and categorical:
            pieces.append(_top(counted["c"], keys, top_k))
        if quantiles:
            pieces.append(select_quantiles(number_rows(df, runs, numeric), stats, runs, QUANTILES))
    for piece in pieces:
        result = _attach(result, piece, keys)
    have = set(result.columns)
    if "distinct" in have:
        distinct = F.coalesce(F.col("distinct"), F.lit(0))
    else:
        distinct = F.col("approx_distinct")
    extra = {"distinct": F.when(F.col("kind") != "opaque", distinct)}
    for j, p in enumerate(QUANTILES):
        extra[f"p{round(p * 100)}"] = F.col(f"q{j}") if f"q{j}" in have else F.col("approx_quantiles")[j]
    if "sample_hash" not in have:
        extra["sample_hash"] = F.lit(None).cast("string")
    else:
        empty = F.concat(F.lit("sha256:"), F.sha2(F.lit(""), 256))
        extra["sample_hash"] = F.when(F.col("kind") != "opaque", F.coalesce(F.col("sample_hash"), empty))
    if "top_values" not in have:
        extra["top_values"] = F.lit(None).cast(TOP_TYPE)
    return result.withColumns(extra)


def profile_table(
    df: DataFrame,
    runs: Sequence[str] = (),
    columns: Sequence[str] | None = None,
    exact: bool = True,
    parts: Sequence[str] = PARTS,
    copies: Sequence[str] = (),
) -> DataFrame:
    """Long-form profile: one row per (run, column).

    `exact=False` replaces distinct counts and quantiles by sketches and leaves out the value parts, which
    makes the whole profile one scan with no value shuffle. `parts` trims the exact profile. `copies` are the values
    of the only run column when the runs are copies of one table whose rows stand together: equal values of copies
    meet before the shuffle, which then carries them once.
    """
    raw = raw_profile(df, runs, columns, exact, parts, copies=copies)
    filled = F.col("non_null") > 0

    def ratio(part: Column) -> Column:
        return F.when(F.col("row_count") == 0, F.lit(0.0)).otherwise(F.round(part / F.col("row_count"), 6))

    def rounded(name: str) -> Column:
        return F.when(filled, F.round(name, 6)).alias(name)

    return raw.select(
        *runs,
        "column",
        "ordinal",
        "kind",
        "row_count",
        F.when(F.col("row_count") == 0, F.lit(0.0))
        .otherwise(F.round(1 - F.col("non_null") / F.col("row_count"), 6))
        .alias("null_ratio"),
        F.when(F.col("distinct").isNotNull(), ratio(F.col("distinct"))).alias("distinct_ratio"),
        "sample_hash",
        *[rounded(c) for c in ("mean", "stddev", "min", "max", "p50", "p95", "p99")],
        "min_ts",
        "max_ts",
        "top_values",
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi join on keys that may be null (segments keep nulls as a group)."""
    renamed = right.withColumnsRenamed({key: f"_r_{key}" for key in keys})
    condition = None
    for key in keys:
        one = q(key).eqNullSafe(q(f"_r_{key}"))
        condition = one if condition is None else condition & one
    return left.join(renamed, condition, how).drop(*[f"_r_{key}" for key in keys])


def _attach(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return _null_safe_join(left, right, keys, "left")


def profile_by_run(df: DataFrame, run_col: str, **options) -> DataFrame:
    """Profiles of all runs in one job instead of one job per run."""
    return profile_table(df, runs=[run_col], **options)


def profile_segments(
    df: DataFrame,
    columns: Sequence[str],
    runs: Sequence[str] = (),
    max_segments: int | None = None,
    **options,
) -> DataFrame:
    """Profile of every value combination of at most two columns; nulls form their own group.

    With `max_segments` a run with more combinations is refused before it is profiled.
    """
    columns = list(columns)
    if not 1 <= len(columns) <= 2 or any(c not in df.columns for c in columns):
        raise ValueError("one or two existing segment columns are needed")
    if max_segments is not None:
        groups = df.select(*runs, *columns).distinct().groupBy(*runs).count()
        widest = groups.agg(F.max("count")).first()[0] or 0
        if widest > max_segments:
            raise ValueError(f"{widest} segments exceed the limit of {max_segments}; choose coarser columns")
    labelled = df.withColumn("segment", segment_label(columns)).drop(*columns)
    return profile_table(labelled, runs=[*runs, "segment"], **options)


def segment_label(columns: Sequence[str]) -> Column:
    """JSON array label such as ["1-URGENT", "F"]; null parts stay null."""
    parts = [F.to_json(F.array(q(c).cast("string"))) for c in columns]
    return F.concat(F.lit("["), F.concat_ws(", ", *[F.substring(p, F.lit(2), F.length(p) - 2) for p in parts]), F.lit("]"))


def mask_sensitive(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Strip raw values of sensitive columns from profiles (or segment profiles) or from signals."""
    from dqspark.types import SENSITIVE_EVIDENCE

    hidden = F.coalesce(F.col("column").isin(list(columns)), F.lit(False))
    if "evidence" in df.columns:
        cleaned = F.map_filter("evidence", lambda k, _: ~k.isin(list(SENSITIVE_EVIDENCE)))
        return df.withColumn("evidence", F.when(hidden, cleaned).otherwise(F.col("evidence")))
    changes = {c: F.when(~hidden, F.col(c)) for c in ("top_values", "sample_hash") if c in df.columns}
    return df.withColumns(changes)
