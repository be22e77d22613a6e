"""Row-level comparison of two versions of a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.functions.columns import nan_to_null, q
from dqspark.operators.contract import check_contract
from dqspark.runtime import materialize
from dqspark.types import contract_type, kind_of

DIFF_SAMPLES = 5


def _check_keys(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> None:
    """Keys must exist, be filled and be unique on both sides, otherwise pairs would multiply in the join."""
    if not keys or any(k not in before.columns or k not in after.columns for k in keys):
        raise ValueError("key columns must exist in both tables")
    for side in (before, after):
        if key_problems(side, keys).limit(1).count():
            raise ValueError("comparison keys must be unique and filled")


def key_problems(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are null or repeated, with their row counts."""
    missing = F.lit(False)
    for key in keys:
        missing = missing | q(key).isNull()
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter((F.col("copies") > 1) | missing)
    )


def _shared(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> list[str]:
    return [c for c in before.columns if c in after.columns and c not in keys]


def _schema_changed(before: DataFrame, after: DataFrame) -> bool:
    return [(f.name, f.dataType) for f in before.schema.fields] != [(f.name, f.dataType) for f in after.schema.fields]


def _same(name: str, before: DataFrame, after: DataFrame) -> Column:
    left, right = F.col(f"b.{_safe(name)}"), F.col(f"a.{_safe(name)}")
    if contract_type(before.schema[name].dataType) != contract_type(after.schema[name].dataType):
        left, right = left.cast("string"), right.cast("string")
    return left.eqNullSafe(right)


def _safe(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def diff_rows(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join on the keys: `b` and `a` structs, `changed_columns`. One shuffle per side, none when
    both tables are bucketed on the keys."""
    shared = _shared(before, after, keys)
    left = nan_to_null(before).select(*keys, F.struct(F.lit(1).alias("_in"), *[q(c) for c in shared]).alias("b"))
    right = nan_to_null(after).select(*keys, F.struct(F.lit(1).alias("_in"), *[q(c) for c in shared]).alias("a"))
    both = F.col("b").isNotNull() & F.col("a").isNotNull()
    tests = [F.when(both & ~_same(c, before, after), F.lit(c)) for c in shared]
    changed = F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")
    return left.join(right, list(keys), "full_outer").withColumn("changed_columns", changed)


def different_keys(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are on one side only or whose rows differ, found by joining keys and 128-bit fingerprints
    instead of whole rows. Worth it when wide versions are mostly equal: only these keys need their values."""
    shared = _shared(before, after, keys)
    retyped = [c for c in shared if before.schema[c].dataType != after.schema[c].dataType]

    def marked(df: DataFrame, name: str) -> DataFrame:
        values = [q(c).cast("string") if c in retyped else q(c) for c in shared]
        # Two hash chains with different starts; null positions are part of the input.
        nulls = [q(c).isNull() for c in shared]
        chains = F.struct(F.xxhash64(F.lit(1), *values, *nulls), F.xxhash64(F.lit(2), *nulls, *values))
        return nan_to_null(df).select(*keys, chains.alias(name))

    joined = marked(before, "fb").join(marked(after, "fa"), list(keys), "full_outer")
    return joined.filter(~F.col("fb").eqNullSafe(F.col("fa"))).select(*keys)


def narrow_to_changes(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both versions cut to the keys of `different_keys`; every report but the totals is the same on them."""
    touched = materialize(different_keys(before, after, keys))
    return tuple(side.join(touched, list(keys), "left_semi") for side in (before, after))


def data_diff(
    before: DataFrame,
    after: DataFrame,
    keys: Sequence[str],
    max_change_ratio: float = 0.0,
    check_keys: bool = True,
    fingerprint: bool = False,
) -> DataFrame:
    """One row: added, removed and changed rows, changed cells, ratio over all keys, schema change, verdict.

    `fingerprint` compares hashes first and values only where they differ (see `different_keys`).
    """
    if not 0 <= max_change_ratio <= 1:
        raise ValueError("max_change_ratio lies between 0 and 1")
    if check_keys:
        _check_keys(before, after, keys)
    equal_keys = 0
    schema_changed = _schema_changed(before, after)
    if fingerprint:
        all_before = before.count()
        before, after = narrow_to_changes(before, after, keys)
        equal_keys = all_before - before.count()
    rows = diff_rows(before, after, keys)
    cells = F.size("changed_columns")
    counted = rows.agg(
        F.count_if(F.col("b").isNull()).alias("added_rows"),
        F.count_if(F.col("a").isNull()).alias("removed_rows"),
        F.count_if(cells > 0).alias("changed_rows"),
        F.coalesce(F.sum(cells.cast("bigint")), F.lit(0)).alias("changed_cells"),
        (F.count(F.lit(1)) + F.lit(equal_keys)).alias("all_keys"),
    )
    changes = F.col("changed_rows") + F.col("added_rows") + F.col("removed_rows")
    ratio = changes / F.greatest(F.col("all_keys"), F.lit(1))
    return counted.select(
        "added_rows",
        "removed_rows",
        "changed_rows",
        "changed_cells",
        F.round(ratio, 6).alias("change_ratio"),
        F.lit(schema_changed).alias("schema_changed"),
        ((ratio <= max_change_ratio) & F.lit(not schema_changed)).alias("passed"),
    )


def diff_by_column(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Changed cells per column, only columns with changes."""
    return (
        diff_rows(before, after, keys)
        .select(F.explode("changed_columns").alias("column"))
        .groupBy("column")
        .agg(F.count(F.lit(1)).alias("changed_cells"))
    )


def diff_samples(before: DataFrame, after: DataFrame, keys: Sequence[str], n: int = DIFF_SAMPLES) -> DataFrame:
    """(change, keys…, changes): the first n changed, added and removed keys with before/after values."""
    rows = diff_rows(before, after, keys)
    shared = _shared(before, after, keys)
    pairs = F.filter(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    F.col(f"b.{_safe(c)}").cast("string").alias("before"),
                    F.col(f"a.{_safe(c)}").cast("string").alias("after"),
                )
                for c in shared
                if kind_of(before.schema[c].dataType) != "opaque"
            ]
        ),
        lambda p: F.array_contains(F.col("changed_columns"), p["column"]),
    )
    kinds = {
        "changed": F.size("changed_columns") > 0,
        "added": F.col("b").isNull(),
        "removed": F.col("a").isNull(),
    }
    parts = [
        rows.filter(condition).select(F.lit(name).alias("change"), *keys, pairs.alias("changes")).orderBy(*keys).limit(n)
        for name, condition in kinds.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def diff_totals(before: DataFrame, after: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(column, before, after): sums of the shared numeric columns over all rows of each side."""
    numeric = [
        c
        for c in _shared(before, after, keys)
        if kind_of(before.schema[c].dataType) == "numeric" and kind_of(after.schema[c].dataType) == "numeric"
    ]

    def totals(df: DataFrame, side: str) -> DataFrame:
        row = nan_to_null(df).agg(*[F.coalesce(F.sum(q(c).cast("double")), F.lit(0.0)).alias(f"t{i}") for i, c in enumerate(numeric)])
        empty = F.lit(None).cast("double")
        return row.select(
            F.inline(
                F.array(
                    *[
                        F.struct(
                            F.lit(c).alias("column"),
                            (F.col(f"t{i}") if side == "before" else empty).alias("before"),
                            (F.col(f"t{i}") if side == "after" else empty).alias("after"),
                        )
                        for i, c in enumerate(numeric)
                    ]
                )
            )
        )

    return (
        totals(before, "before")
        .unionByName(totals(after, "after"))
        .groupBy("column")
        .agg(F.max("before").alias("before"), F.max("after").alias("after"))
    )


def quality_gate(
    before: DataFrame,
    after: DataFrame,
    contract: Mapping,
    keys: Sequence[str],
    max_change_ratio: float = 0.0,
    as_of=None,
    references=None,
    check_keys: bool = True,
) -> DataFrame:
    """(check, detail, passed): the diff verdict, every contract violation of the candidate, the overall gate."""
    verdict = data_diff(before, after, keys, max_change_ratio, check_keys).select(
        F.lit("diff").alias("check"),
        F.concat(F.lit("change_ratio="), F.format_number("change_ratio", 6)).alias("detail"),
        "passed",
    )
    broken = check_contract(after, contract, as_of, references).select(
        F.lit("contract").alias("check"),
        F.concat_ws(":", "rule_type", "column").alias("detail"),
        F.lit(False).alias("passed"),
    )
    # The gate row comes from the same rows by a grouping set, so the diff and the contract run once.
    return (
        verdict.unionByName(broken)
        .groupingSets([["check", "detail"], []], "check", "detail")
        .agg(F.bool_and("passed").alias("passed"), F.grouping_id().alias("_g"))
        .select(
            F.when(F.col("_g") > 0, "gate").otherwise(F.col("check")).alias("check"),
            F.when(F.col("_g") > 0, "all").otherwise(F.col("detail")).alias("detail"),
            "passed",
        )
    )
