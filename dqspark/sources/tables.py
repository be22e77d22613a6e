"""Scans, typed CSV, snapshots and the append-only metadata tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dqspark.functions.columns import q
from dqspark.operators.suggest import TIME_NAME

def scan_table(
    source: DataFrame,
    partition: tuple[str, object, object] | None = None,
    columns: Sequence[str] | None = None,
    order_by: Sequence[str] = (),
    max_rows: int | None = None,
) -> DataFrame:
    """Half-open partition filter, optional projection, optional ordered row budget.

    `source` is any batch reader result (Parquet, JDBC, a catalogue table); filter, projection and limit are
    pushed into it by the optimizer. Without a budget the whole partition is read, which is the default.
    """
    df = source
    if partition is not None:
        name, start, end = partition
        df = df.filter((q(name) >= F.lit(start)) & (q(name) < F.lit(end)))
    if columns is not None:
        df = df.select(*[q(c) for c in columns])
    if order_by:
        df = df.orderBy(*[q(c) for c in order_by]) if max_rows is not None else df
    if max_rows is not None:
        if not order_by:
            raise ValueError("a row budget needs order_by, otherwise the result is arbitrary")
        df = df.limit(max_rows)
    return df


def read_table(spark: SparkSession, path: str, format: str = "parquet", options: Mapping | None = None, **scan) -> DataFrame:
    """Load by format (parquet, csv, json, orc, jdbc, …) and scan."""
    reader = spark.read.format(format)
    for key, value in (options or {}).items():
        reader = reader.option(key, value)
    return scan_table(reader.load(path) if path else reader.load(), **scan)


def scan_coverage(source: DataFrame, partition: tuple[str, object, object] | None = None, max_rows: int | None = None) -> DataFrame:
    """One row: scope, method, total rows, scanned rows, complete flag. An unfiltered Parquet count is answered
    from file footers."""
    total = scan_table(source, partition).agg(F.count(F.lit(1)).alias("total_rows"))
    scanned = F.col("total_rows") if max_rows is None else F.least(F.col("total_rows"), F.lit(max_rows))
    return total.select(
        F.lit("partition" if partition else "table").alias("scope"),
        F.lit("full" if max_rows is None else "ordered_prefix").alias("method"),
        "total_rows",
        scanned.cast("bigint").alias("scanned_rows"),
        (scanned == F.col("total_rows")).alias("complete"),
    )


def read_csv_typed(spark: SparkSession, path: str, **options) -> DataFrame:
    """CSV read as text and typed by `type_text`."""
    reader = spark.read.option("header", True)
    for key, value in options.items():
        reader = reader.option(key, value)
    return type_text(reader.csv(path))


def type_text(df: DataFrame) -> DataFrame:
    """Text columns get the narrowest type that every value has: bigint, double, boolean, else text.

    A text column becomes a timestamp only if its name looks like a time and every value parses; a column of other name
    stays text, whatever its values look like. Columns without any value stay text. One aggregate decides all columns.
    """
    pattern = re.compile(TIME_NAME)
    names = [c for c, t in df.dtypes if t == "string"]
    if not names:
        return df

    def forms(name: str) -> dict[str, Column]:
        text = F.trim(q(name))
        found = {
            "bigint": F.when(text.rlike(r"^[+-]?\d{1,19}$"), text.try_cast("bigint")),
            "double": F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(NaN|Infinity)$"), text.try_cast("double")),
            "boolean": F.when(F.lower(text).isin("true", "false"), text.try_cast("boolean")),
        }
        if pattern.search(name):
            found["timestamp_ntz"] = F.try_to_timestamp(q(name)).cast("timestamp_ntz")
        return found

    tests = [F.count(q(c)).alias(f"n{i}") for i, c in enumerate(names)]
    tests += [F.count(value).alias(f"{kind}{i}") for i, c in enumerate(names) for kind, value in forms(c).items()]
    row = df.agg(*tests).first()
    chosen = {}
    for i, c in enumerate(names):
        fitting = [value for kind, value in forms(c).items() if row[f"n{i}"] and row[f"{kind}{i}"] == row[f"n{i}"]]
        if fitting:
            chosen[c] = fitting[0]
    return df.withColumns(chosen) if chosen else df


def cast_to_contract(df: DataFrame, contract: Mapping) -> DataFrame:
    """Text columns that the contract declares as datetime are parsed; a bad value is an error (ANSI mode)."""
    wanted = contract.get("expected_schema", {})
    kinds = dict(df.dtypes)
    casts = {c: q(c).cast("timestamp_ntz") for c, t in wanted.items() if t == "datetime" and kinds.get(c) == "string"}
    return df.withColumns(casts) if casts else df


def save_snapshot(df: DataFrame, path: str, run_id: str) -> None:
    """The data behind one run, kept with its exact types; writing a run again replaces that run only."""
    df.write.mode("overwrite").parquet(f"{path}/run_id={run_id}")


def load_snapshot(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    return spark.read.parquet(f"{path}/run_id={run_id}")


def append_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


PROFILE_KEYS = ("dataset", "run_id", "column")
SIGNAL_KEYS = ("dataset", "run_id", "signal_id")


def save_profiles(profiles: DataFrame, path: str) -> None:
    """Append with a write time; readers keep the newest row per (dataset, run, column)."""
    append_table(profiles.withColumn("written_at", F.current_timestamp()), path, ["dataset"])


def save_signals(signals: DataFrame, path: str) -> None:
    append_table(signals.withColumn("written_at", F.current_timestamp()), path, ["dataset"])


def unique_rows(df: DataFrame, keys: Sequence[str], order: str = "written_at") -> DataFrame:
    """Newest row per key."""
    window = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def load_profiles(spark: SparkSession, path: str) -> DataFrame:
    return unique_rows(spark.read.parquet(path), PROFILE_KEYS).drop("written_at")


def load_signals(spark: SparkSession, path: str) -> DataFrame:
    return unique_rows(spark.read.parquet(path), SIGNAL_KEYS).drop("written_at")
