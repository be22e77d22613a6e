"""Controlled corruptions F01-F06: DataFrame in, DataFrame out, repeatable at any size.

A fault that changes rows in place is a `Change`, so that several faulted copies can be made from one scan.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dqspark.functions.columns import q
from dqspark.operators.profile import exact_quantiles
from dqspark.runtime import broadcast_if_small, materialize, stored


class Change(NamedTuple):
    """New values of columns and how often each row occurs, both as expressions over the row."""

    values: Mapping[str, Column]
    copies: Column | int = 1


def fault_drop_column(df: DataFrame, column: str) -> DataFrame:
    """F01."""
    if column not in df.columns:
        raise ValueError(f"no column {column}")
    return df.drop(column)


def fault_recode(df: DataFrame, column: str) -> DataFrame:
    """a text category becomes its 0-based position among the sorted distinct values.

    Codes come from a distributed sort with per-partition offsets, so the number of categories is not bound
    by one task. A code list proven small is broadcast: a few categories must not collect all rows in as many tasks.
    """
    values = df.select(q(column).alias("_value")).distinct().filter("_value is not null")
    # Stored with its place, so that both uses below see the same partitions.
    placed = materialize(
        values.repartitionByRange("_value").withColumn("_part", F.spark_partition_id())
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # one row per partition
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("_value"))
    codes = placed.join(offsets, "_part").select("_value", (F.col("_before") + rank - 1).cast("bigint").alias("_code"))
    codes = broadcast_if_small(materialize(codes))
    joined = df.join(codes, q(column) == F.col("_value"), "left")
    return joined.select(*[F.col("_code").alias(c) if c == column else q(c) for c in df.columns])


def row_order(key: Column, seed: int) -> Column:
    """Repeatable pseudo-random order of rows by key: 52 bits of md5, exact as a double."""
    text = F.concat_ws(":", key.cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def null_spike(df: DataFrame, column: str, key: str, ratio: float = 0.40, seed: int = 42) -> Change:
    rows = df.count()
    k = int(rows * ratio)
    if k == 0:
        return Change({})
    order = row_order(q(key), seed)
    hashed = stored(df.select(order.cast("double").alias("h")), "hashes")  # several passes read it
    cut = exact_quantiles(hashed, ["h"], ((k - 1) / max(rows - 1, 1),)).first()["q0"]
    # The quantile is interpolated; snapping it to the k-th order statistic is a count away.
    limit = _snap(hashed, cut, k)
    return Change({column: F.when(order <= F.lit(limit), F.lit(None)).otherwise(q(column))})


def fault_null_spike(df: DataFrame, column: str, key: str, ratio: float = 0.40, seed: int = 42) -> DataFrame:
    """exactly int(n * ratio) rows lose their value.

    The k-th smallest hash is found by exact distributed selection, so no global sort or numbering is needed.
    `key` must be unique.
    """
    return apply_change(df, null_spike(df, column, key, ratio, seed))


def _snap(hashed: DataFrame, near: float, k: int) -> int:
    for _ in range(64):
        row = hashed.agg(
            F.count_if(F.col("h") <= near).alias("upto"),
            F.max(F.when(F.col("h") <= near, F.col("h"))).alias("below"),
            F.min(F.when(F.col("h") > near, F.col("h"))).alias("above"),
        ).first()
        if row["upto"] == k:
            return int(row["below"])
        step = row["above"] if row["upto"] < k else row["below"] - 1
        if step is None or step == near:
            break
        near = step
    raise ValueError("the key column must be unique")


def duplicate(fraction: float = 1.0, key: str | None = None, seed: int = 42) -> Change:
    if fraction >= 1.0:
        return Change({}, 2)
    if key is None:
        raise ValueError("a key is needed to pick a share of the rows")
    return Change({}, F.when(row_order(q(key), seed) < int(fraction * 16**13), 2).otherwise(1))


def fault_duplicate(df: DataFrame, fraction: float = 1.0, key: str | None = None, seed: int = 42) -> DataFrame:
    """all rows, or the hash share `fraction` of them by key, are loaded twice."""
    # Rows repeat in place, so the table is read once.
    return apply_change(df, duplicate(fraction, key, seed))


def scale(column: str, factor: float = 100.0, where: Column | None = None) -> Change:
    scaled = q(column) * F.lit(factor)
    return Change({column: scaled if where is None else F.when(where, scaled).otherwise(q(column))})


def fault_scale(df: DataFrame, column: str, factor: float = 100.0, where: Column | None = None) -> DataFrame:
    """F05; `where` limits the fault to a batch."""
    return apply_change(df, scale(column, factor, where))


def delay(column: str, hours: float = 3.0) -> Change:
    return Change({column: q(column) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hours * 3600))})


def fault_delay(df: DataFrame, column: str, hours: float = 3.0) -> DataFrame:
    """F06."""
    return apply_change(df, delay(column, hours))


def _repeated(value: Column, copies: Column | int) -> Column:
    return F.array_repeat(value, copies if isinstance(copies, Column) else F.lit(copies))


def apply_change(df: DataFrame, change: Change) -> DataFrame:
    changed = df.withColumns(dict(change.values)) if change.values else df
    if isinstance(change.copies, int) and change.copies == 1:
        return changed
    return df.select("*", F.explode(_repeated(F.lit(1), change.copies)).alias("_copy")).withColumns(dict(change.values)).drop("_copy")


def changed_copies(df: DataFrame, changes: Mapping[str, Change], run: str = "run_id") -> DataFrame:
    """The copies of a table that each change makes, told apart by `run`, out of one scan. The changes keep the types."""
    runs = F.concat(*[_repeated(F.lit(name), change.copies) for name, change in changes.items()])
    copies = df.select("*", F.explode(runs).alias(run))
    values = {}
    for c, kind in df.dtypes:
        value = None
        for name, change in changes.items():
            if c in change.values:
                mine = F.col(run) == name
                changed = change.values[c].cast(kind)
                value = F.when(mine, changed) if value is None else value.when(mine, changed)
        if value is not None:
            values[c] = value.otherwise(q(c))
    return copies.withColumns(values)


def fault_change(df: DataFrame, fault_id: str, columns: Mapping[str, str]) -> Change | None:
    """A fault of the catalogue as a change of rows in place; None for one that is none."""
    catalogue = {
        "F03": lambda: null_spike(df, columns["amount"], columns["key"]),
        "F04": lambda: duplicate(),
        "F05": lambda: scale(columns["amount"]),
        "F06": lambda: delay(columns["time"]),
    }
    return catalogue[fault_id]() if fault_id in catalogue else None


def apply_fault(df: DataFrame, fault_id: str, columns: Mapping[str, str]) -> DataFrame:
    """A fault of the catalogue on its target columns: keys `drop`, `recode`, `amount`, `key`, `time`."""
    catalogue = {
        "F01": lambda: fault_drop_column(df, columns["drop"]),
        "F02": lambda: fault_recode(df, columns["recode"]),
        "F03": lambda: fault_null_spike(df, columns["amount"], columns["key"]),
        "F04": lambda: fault_duplicate(df),
        "F05": lambda: fault_scale(df, columns["amount"]),
        "F06": lambda: fault_delay(df, columns["time"]),
    }
    if fault_id not in catalogue:
        raise ValueError(f"unknown fault {fault_id!r}; known are {sorted(catalogue)}")
    return catalogue[fault_id]()
