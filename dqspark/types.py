"""Contract types, fixed thresholds and the schemas of the metadata tables."""

from __future__ import annotations

from pyspark.sql import types as T

INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)
DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)

# Types, compare operators and sensitive evidence of the contract format.
CONTRACT_TYPES = ("integer", "float", "string", "boolean", "datetime")
COMPARE_OPERATORS = ("<", "<=", ">", ">=", "==", "!=")
SENSITIVE_EVIDENCE = ("sample", "sample_value", "allowed_values", "message")
SEVERITIES = ("low", "medium", "high", "critical")


def contract_type(data_type: T.DataType) -> str | None:
    """Canonical contract type of a Spark type; None for nested and binary columns."""
    if isinstance(data_type, INTEGER_TYPES):
        return "integer"
    if isinstance(data_type, (*FLOAT_TYPES, T.DecimalType)):
        return "float"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, DATETIME_TYPES):
        return "datetime"
    return None


def type_accepts(expected: str, actual: str | None) -> bool:
    """An integer column also satisfies `float`; every other type must be equal."""
    return actual == expected or (expected == "float" and actual == "integer")


def kind_of(data_type: T.DataType) -> str:
    """Profile kind: numeric, datetime, categorical (strings, booleans) or opaque."""
    return {
        "integer": "numeric",
        "float": "numeric",
        "datetime": "datetime",
        "string": "categorical",
        "boolean": "categorical",
    }.get(contract_type(data_type), "opaque")


EVIDENCE = T.MapType(T.StringType(), T.StringType())

SIGNAL_FIELDS = ("seq", "type", "column", "severity", "score", "source", "evidence")

SIGNAL_STRUCT = "struct<seq:bigint,type:string,column:string,score:double,source:string,evidence:map<string,string>>"
VIOLATION_STRUCT = (
    "struct<seq:bigint,rule_type:string,column:string,severity:string,evidence:map<string,string>>"
)
