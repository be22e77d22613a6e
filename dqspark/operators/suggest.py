"""A first contract drafted from the data itself: one profile, then expressions over one row per column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqspark.functions.columns import nice_bounds
from dqspark.operators.profile import raw_profile
from dqspark.types import contract_type

# Name patterns and limits of the draft.
KEY_NAME = r"(?i)(^id$|_id$|_key$|^uuid$|_uuid$|^pk$)"
TIME_NAME = r"(?i)(_at$|_time$|_date$|^timestamp$|^date$)"
MAX_CATEGORIES = 12
MIN_ROWS = 20
MIN_ROWS_FOR_CATEGORIES = 50
SPARSE_NULL_RATIO = 0.2
MAX_CATEGORY_SHARE = 0.2

RULE_TYPE = (
    "struct<position:int,type:string,column:string,max_null_ratio:double,min:double,max:double,values:array<string>>"
)


def suggest_rules(df: DataFrame, key_columns: Sequence[str] = ()) -> DataFrame:
    """(ordinal, position, type, column, max_null_ratio, min, max, values), one row per drafted rule.

    `key_columns` marks keys whose name does not say so.
    """
    types = {f.name: contract_type(f.dataType) for f in df.schema.fields}
    known = [c for c in df.columns if types[c] is not None]
    if not known:
        raise ValueError("no column of a supported type")
    kinds = F.create_map(*[F.lit(x) for c in known for x in (c, types[c])])
    raw = raw_profile(df, columns=known, parts=("distinct", "top"), top_k=MAX_CATEGORIES)
    kind = F.element_at(kinds, F.col("column"))
    rows, filled, distinct = F.col("row_count"), F.col("non_null"), F.col("distinct")
    null_ratio = 1 - filled / F.when(rows > 0, rows)
    keyed = F.col("column").rlike(KEY_NAME) | F.col("column").isin(list(key_columns))
    judged = (rows >= MIN_ROWS) & (filled > 0)
    lower, upper = nice_bounds(F.col("min"), F.col("max"))
    nothing = F.lit(None)

    def rule(position, name, when, limit=nothing, low=nothing, high=nothing, values=nothing):
        entry = F.struct(
            F.lit(position).alias("position"),
            F.lit(name).alias("type"),
            F.col("column").alias("column"),
            limit.cast("double").alias("max_null_ratio"),
            low.cast("double").alias("min"),
            high.cast("double").alias("max"),
            values.cast("array<string>").alias("values"),
        )
        return F.when(when, entry.cast(RULE_TYPE))

    limit = F.when(keyed & (filled == rows), F.lit(0.0)).otherwise(
        F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.01), null_ratio * 2)), 4)
    )
    few = distinct.between(2, MAX_CATEGORIES) & (distinct / filled <= MAX_CATEGORY_SHARE)
    rules = F.array(
        rule(0, "not_null", null_ratio <= SPARSE_NULL_RATIO, limit=limit),
        rule(1, "uniqueness", judged & keyed & (distinct == rows) & kind.isin("integer", "string")),
        rule(2, "range", judged & ~keyed & kind.isin("integer", "float"), low=lower, high=upper),
        rule(
            3,
            "allowed_values",
            judged & (kind == "string") & (rows >= MIN_ROWS_FOR_CATEGORIES) & few,
            values=F.array_sort(F.transform("top_values", lambda t: t["value"])),
        ),
    )
    return raw.select("ordinal", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r")).select(
        "ordinal", "r.*"
    )


def suggest_contract(df: DataFrame, key_columns: Sequence[str] = ()) -> tuple[dict, DataFrame]:
    """(contract, rules). The contract is built from at most four rows per column."""
    if df.isEmpty():
        raise ValueError("no contract can be drafted from an empty table")
    rules = suggest_rules(df, key_columns)
    schema = {f.name: contract_type(f.dataType) for f in df.schema.fields}
    drafted = []
    for row in rules.orderBy("ordinal", "position").collect():
        rule: dict = {"type": row["type"], "column": row["column"]}
        for name in ("max_null_ratio", "min", "max", "values"):
            if row[name] is not None:
                rule[name] = row[name]
        drafted.append(rule)
    contract = {"version": 1, "expected_schema": {c: t for c, t in schema.items() if t}, "rules": drafted}
    return contract, rules
