"""Bounded repairs on a copy of the data, and the proof that they fix the contract and touch nothing else."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.functions.columns import q
from dqspark.operators.contract import check_contract
from dqspark.operators.profile import profile_table
from dqspark.types import FLOAT_TYPES, kind_of

# The factors a scale repair may use.
SCALE_FACTORS = (0.01, 0.1, 10, 100)


def batch_mask(where: Mapping) -> Column:
    """Equality filter that selects the batch to repair; nulls never match."""
    if not where or any(not isinstance(v, (str, int, float, bool)) for v in where.values()):
        raise ValueError("an equality filter with scalar values is needed")
    mask = F.lit(True)
    for name, value in where.items():
        mask = mask & F.coalesce(q(name) == F.lit(value), F.lit(False))
    return mask


def repair_scale(
    df: DataFrame, column: str, factor: float, where: Mapping, max_changed_rows: int
) -> DataFrame:
    """Multiply one numeric column of one batch; refused when it would touch no row or more than the caller allows.

    Only the batch is computed; all other values and the column's type stay as they are. An integer or decimal column is
    refused when a product does not fit its type exactly.
    """
    if column not in df.columns or kind_of(df.schema[column].dataType) != "numeric":
        raise ValueError("a numeric target column is needed")
    if factor not in SCALE_FACTORS:
        raise ValueError(f"factor must be one of {SCALE_FACTORS}")
    if any(c not in df.columns for c in where):
        raise ValueError("the filter names unknown columns")
    mask = batch_mask(where)
    kind, value = df.schema[column].dataType, q(column)
    if isinstance(kind, FLOAT_TYPES):
        scaled, inexact = value.cast("double") * float(factor), F.lit(False)
    else:
        # Divisions by 10 or 100 in place of products keep decimals exact.
        wide = value.cast("decimal(38,6)")
        exact = wide * F.lit(int(factor)).cast("decimal(4,0)") if factor > 1 else wide / F.lit(round(1 / factor)).cast("decimal(4,0)")
        scaled = exact.try_cast(kind)
        inexact = value.isNotNull() & ~F.coalesce(scaled.cast("decimal(38,6)") == exact, F.lit(False))
    affected, broken = df.filter(mask).agg(F.count(F.lit(1)), F.count_if(inexact)).first()
    if broken:
        raise ValueError(f"{broken} products do not fit {kind.simpleString()} exactly")
    if not 0 < affected <= max_changed_rows:
        raise ValueError(f"{affected} rows affected, allowed are 1 to {max_changed_rows}")
    return df.withColumn(column, F.when(mask, scaled.cast(kind)).otherwise(value))


def repair_deduplicate(df: DataFrame, keys: Sequence[str], max_changed_rows: int) -> DataFrame:
    """Drop exact copies; refused when one key still has different rows or nothing changes."""
    if not keys or any(k not in df.columns for k in keys):
        raise ValueError("existing key columns are needed")
    # One pass: copies fold first, then every key must have a single variant.
    variants = df.groupBy(*[q(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_copies"))
    facts = (
        variants.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("variants"), F.sum("_copies").alias("rows"))
        .agg(F.max("variants").alias("variants"), F.sum(F.col("rows") - 1).alias("affected"))
        .first()
    )
    if (facts["variants"] or 0) > 1:
        raise ValueError("one key has different rows; dropping one of them would be a guess")
    affected = facts["affected"] or 0
    if not 0 < affected <= max_changed_rows:
        raise ValueError(f"{affected} rows affected, allowed are 1 to {max_changed_rows}")
    return df.dropDuplicates()


def validate_repair(
    before: DataFrame,
    after: DataFrame,
    contract: Mapping,
    max_changed_rows: int,
    as_of=None,
    where: Mapping | None = None,
    references=None,
) -> DataFrame:
    """One row: was the contract broken before, is it clean after, are all rows outside the batch unchanged.

    With `where` (scale) the control group is every row outside the batch, compared as multisets; without it
    (deduplicate) the set of distinct rows must be the same. Both need one shuffle per side.
    """
    if where is not None:
        outside = ~batch_mask(where)
        kept, now = before.filter(outside), after.filter(outside)
    else:
        kept, now = before.dropDuplicates(), after
    now = now.select(*[q(f.name).cast(f.dataType) for f in before.schema.fields])
    tagged = kept.select(F.struct("*").alias("row"), F.lit(1).alias("side")).unionByName(
        now.select(F.struct("*").alias("row"), F.lit(-1).alias("side"))
    )
    differing = (
        tagged.groupBy("row")
        .agg(F.sum("side").alias("balance"))
        .agg(F.count_if(F.col("balance") != 0).alias("differing_rows"))
    )
    changed = (
        before.agg(F.count_if(batch_mask(where)).alias("changed_rows"))
        if where is not None
        else _difference(before, after)
    )
    facts = [
        ("before_rows", before.agg(F.count(F.lit(1)))),
        ("after_rows", after.agg(F.count(F.lit(1)))),
        ("before_violations", check_contract(before, contract, as_of, references).agg(F.count(F.lit(1)))),
        ("after_violations", check_contract(after, contract, as_of, references).agg(F.count(F.lit(1)))),
        ("differing_rows", differing),
        ("changed_rows", changed),
    ]
    merged = None
    for name, one_row in facts:
        part = one_row.toDF("n").select(F.lit(name).alias("fact"), F.col("n").cast("bigint").alias("n"))
        merged = part if merged is None else merged.unionByName(part)
    values = merged.agg(*[F.max(F.when(F.col("fact") == name, F.col("n"))).alias(name) for name, _ in facts])
    untouched = F.col("differing_rows") == 0
    return values.select(
        (
            F.col("changed_rows").between(1, max_changed_rows)
            & (F.col("before_violations") > 0)
            & (F.col("after_violations") == 0)
            & untouched
        ).alias("passed"),
        "changed_rows",
        "before_rows",
        "after_rows",
        "before_violations",
        "after_violations",
        untouched.alias("unchanged_control_passed"),
    )


def _difference(before: DataFrame, after: DataFrame) -> DataFrame:
    sides = before.select(F.lit(1).alias("s")).unionByName(after.select(F.lit(-1).alias("s")))
    return sides.agg(F.sum("s").alias("changed_rows"))


def repair_profiles(before: DataFrame, after: DataFrame, **options) -> DataFrame:
    """Profiles of both sides with a `side` column."""
    return (
        profile_table(before, **options)
        .withColumn("side", F.lit("before"))
        .unionByName(profile_table(after, **options).withColumn("side", F.lit("after")))
    )

