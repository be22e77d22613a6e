"""Column expressions shared by the operators."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqspark.types import DATETIME_TYPES, FLOAT_TYPES, SEVERITIES

# Severity cut points, highest first.
SEVERITY_CUTS = ((0.85, "critical"), (0.65, "high"), (0.40, "medium"))

# Scores of violations whose score does not depend on the evidence.
VIOLATION_SCORES = {
    "schema_missing_column": 0.95,
    "schema_unexpected_column": 0.5,
    "schema_type_mismatch": 0.9,
    "uniqueness": 0.9,
    "referential_integrity": 0.85,
    "semantic_drift": 0.5,
    "row_count": 0.75,
}
OTHER_VIOLATION_SCORE = 0.6


def nan_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """NaN counts as missing everywhere in the library."""
    wanted = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, FLOAT_TYPES) and (columns is None or f.name in columns)
    ]
    if not wanted:
        return df
    return df.withColumns({name: F.nanvl(q(name), F.lit(None)) for name in wanted})


def q(name: str) -> Column:
    """Column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def _trimmed(text: Column) -> Column:
    """Decimal text without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def comparable_text(value: Column, data_type: T.DataType) -> Column:
    """Text in which equal values are equal whatever their type: 1, 1.0 and DECIMAL 1.00 are `1`, -0.0 is `0`, a date and
    its midnight are one. NaN must be null already. Doubles of more than 18 decimal places or 38 digits keep their own notation."""
    text = value.cast("string")
    if isinstance(data_type, T.DecimalType):
        return _trimmed(text) if data_type.scale > 0 else text
    if isinstance(data_type, FLOAT_TYPES):
        number = text.cast("double")  # a float32 counts as the number it shows
        plain, whole = text.try_cast("decimal(38,18)"), text.try_cast("decimal(38,0)")
        return (
            F.when((F.abs(number) < 2.0**63) & (number == F.floor(number)), F.floor(number).cast("string"))
            .when(plain.cast("double") == number, _trimmed(plain.cast("string")))
            .when((F.abs(number) >= 2.0**63) & (whole.cast("double") == number), whole.cast("string"))
            .otherwise(text)
        )
    if isinstance(data_type, DATETIME_TYPES):
        return F.regexp_replace(value.cast("timestamp_ntz").cast("string"), " 00:00:00$", "")
    return text


def comparable_literal(value, kind: str | None) -> str:
    """A listed value in the form that comparable_text gives to a column of that contract type."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if kind in ("integer", "float"):
        try:
            exact = Decimal(str(value))
        except InvalidOperation:
            return str(value)
        if not exact.is_finite():
            return str(value)
        text = format(exact, "f")
        text = text.rstrip("0").rstrip(".") if "." in text else text
        return "0" if text in ("-0", "") else text
    if kind == "datetime":
        if isinstance(value, str):
            try:
                value = datetime.fromisoformat(value)
            except ValueError:
                return value
        if isinstance(value, datetime):
            text = value.strftime("%Y-%m-%d %H:%M:%S") + (f".{value.microsecond:06d}".rstrip("0") if value.microsecond else "")
            return text.removesuffix(" 00:00:00")
    return str(value)


def severity(score: Column) -> Column:
    result = F.lit("low")
    for cut, label in reversed(SEVERITY_CUTS):
        result = F.when(score >= cut, F.lit(label)).otherwise(result)
    return result


def severity_rank(label: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), label)


def severity_label(rank: Column) -> Column:
    label = F.lit("low")
    for i, name in enumerate(SEVERITIES):
        label = F.when(rank == i + 1, name).otherwise(label)
    return label


def is_identifier(name: Column) -> Column:
    """Surrogate keys drift by nature, so mean and cardinality tests skip them."""
    lowered = F.lower(name)
    return lowered.endswith("_id") | (lowered == "id")


def is_identifier_name(name: str) -> bool:
    """The same rule for a name known to the driver."""
    return name.lower().endswith("_id") or name.lower() == "id"


def evidence(**items: Column | str | int | float | None) -> Column:
    """MAP<STRING,STRING>; entries whose value is null are left out."""
    pairs = []
    for key, value in items.items():
        column = value if isinstance(value, Column) else F.lit(value)
        pairs.append(F.struct(F.lit(key).alias("k"), column.cast("string").alias("v")))
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["v"].isNotNull()))


def number(evidence_column: Column, key: str, default: float = 0.0) -> Column:
    return F.coalesce(F.element_at(evidence_column, key).cast("double"), F.lit(default))


def violation_score(rule_type: Column, facts: Column) -> Column:
    """Score of a contract violation from its type and evidence."""
    fixed = F.create_map(*[F.lit(x) for pair in VIOLATION_SCORES.items() for x in pair])
    excess = F.greatest(F.lit(0.0), number(facts, "null_ratio") - number(facts, "max_allowed"))
    sla = number(facts, "max_lag_minutes", 1.0)
    sla = F.when(sla == 0, F.lit(1.0)).otherwise(sla)
    late = number(facts, "lag_minutes") / sla - 1.0
    scored = (
        F.when(rule_type == "completeness", 0.5 + excess * 2.0)
        .when(rule_type.isin("range", "column_compare"), 0.4 + number(facts, "violation_ratio") * 3.0)
        .when(rule_type == "freshness", 0.4 + late * 0.3)
        .otherwise(F.coalesce(F.element_at(fixed, rule_type), F.lit(OTHER_VIOLATION_SCORE)))
    )
    return F.least(F.lit(1.0), scored)


def rounded_score(score: Column) -> Column:
    """Stored score with four digits; the first rounding removes floating-point noise around a tie."""
    return F.round(F.round(score, 10), 4)


def nice(value: Column, up: bool) -> Column:
    """Round away to two significant digits."""
    step = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(value))) - 1)
    rounded = (F.ceil if up else F.floor)(value / step) * step
    return F.when(value == 0, F.lit(0.0)).otherwise(F.round(rounded, 6))


def nice_bounds(low: Column, high: Column) -> tuple[Column, Column]:
    """Range limits with a margin around the observed values; a non-negative column keeps 0 as its floor."""
    margin = F.greatest(
        (high - low) * 0.5, F.abs(high) * 0.1, F.when(high == low, F.lit(1.0)).otherwise(F.lit(0.0))
    )
    lower = F.when(low >= 0, F.lit(0.0)).otherwise(nice(low - margin, up=False))
    return lower, nice(high + margin, up=True)


def minutes_between(later: Column, earlier: Column) -> Column:
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return micros / F.lit(6e7)


def as_instant(value) -> Column:
    """A datetime, a string literal or a column, as TIMESTAMP_NTZ."""
    column = value if isinstance(value, Column) else F.lit(value)
    return column.cast(T.TimestampNTZType())


def is_datetime(data_type: T.DataType) -> bool:
    return isinstance(data_type, DATETIME_TYPES)


def digest(df: DataFrame, columns: list[str]) -> Column:
    """sha256 of the chosen columns as JSON, keys in alphabetical order, missing values left out."""
    return F.sha2(F.to_json(F.struct(*[q(c) for c in sorted(columns)])), 256)


def empty_array(struct_type: str) -> Column:
    return F.array().cast(f"array<{struct_type}>")
