"""What a contract rule may say: one field table per rule kind, read by one checker."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from dqspark.types import COMPARE_OPERATORS, CONTRACT_TYPES

NUMBERS = frozenset({"integer", "float"})
ANY = frozenset(CONTRACT_TYPES)


@dataclass(frozen=True)
class Field:
    """Form of a value: `number` within low..high (low itself excluded when `above`), `list`, `name` or one of `choices`."""

    form: str
    low: float = -math.inf
    high: float = math.inf
    above: bool = False
    choices: tuple[str, ...] = ()
    required: bool = False

    def complaint(self, value) -> str | None:
        if self.form == "number":
            plain = isinstance(value, (int, float)) and not isinstance(value, bool)
            if not plain or not math.isfinite(value):
                return "a finite number is needed"
            inside = (value > self.low if self.above else value >= self.low) and value <= self.high
            return None if inside else f"{value} is out of bounds"
        if self.form == "list":
            return None if isinstance(value, (list, tuple, set, frozenset)) else "a list is needed"
        if self.choices:
            return None if value in self.choices else f"{value!r} is none of {', '.join(self.choices)}"
        return None if isinstance(value, str) and value else "a name is needed"


@dataclass(frozen=True)
class Kind:
    fields: Mapping[str, Field]
    columns: str = "one"  # one, several or none
    types: frozenset[str] = ANY
    ordered: tuple[str, str] | None = None  # fields of which the first may not exceed the second
    one_of: tuple[str, ...] = ()


NAME = Field("name")
KINDS = {
    "not_null": Kind({"max_null_ratio": Field("number", 0, 1)}),
    "range": Kind({"min": Field("number"), "max": Field("number")}, types=NUMBERS, ordered=("min", "max")),
    "uniqueness": Kind({"columns": Field("list")}, columns="several"),
    "freshness": Kind({"max_lag_minutes": Field("number", 0, above=True)}, types=frozenset({"datetime"})),
    "allowed_values": Kind({"values": Field("list")}),
    "referential_integrity": Kind({"reference_values": Field("list"), "reference": NAME}),
    "row_count": Kind(
        {"min_rows": Field("number", 0), "max_rows": Field("number", 0)},
        columns="none",
        ordered=("min_rows", "max_rows"),
        one_of=("min_rows", "max_rows"),
    ),
    "column_compare": Kind(
        {"other": Field("name", required=True), "operator": Field("name", choices=COMPARE_OPERATORS, required=True)},
        types=NUMBERS | {"datetime"},
    ),
}
COMMON = {"type", "column", "as_of"}


def rule_columns(rule: Mapping) -> list[str]:
    return list(rule.get("columns") or ([rule["column"]] if rule.get("column") else []))


def complaints(rule: Mapping, schema: Mapping[str, str]) -> list[str]:
    """Everything wrong with a rule, given the expected column types if there are any."""
    kind = KINDS.get(rule.get("type"))
    if kind is None:
        return [f"unknown rule type {rule.get('type')!r}"]
    given = {k: v for k, v in rule.items() if k not in COMMON and v is not None}
    found = [f"unknown field {k}" for k in given if k not in kind.fields]
    for name, field in kind.fields.items():
        if name in given:
            said = field.complaint(given[name])
            found += [f"{name}: {said}"] if said else []
        elif field.required:
            found.append(f"{name} is needed")
    if kind.one_of and not any(n in given for n in kind.one_of):
        found.append(f"{' or '.join(kind.one_of)} is needed")
    if not found and kind.ordered and all(n in given for n in kind.ordered):
        low, high = (given[n] for n in kind.ordered)
        found += [f"{kind.ordered[0]} exceeds {kind.ordered[1]}"] if low > high else []
    columns = rule_columns(rule)
    if kind.columns != "none" and not columns:
        found.append("column is needed")
    return found or (_type_complaints(kind, columns, rule.get("other"), schema) if schema else [])


def _type_complaints(kind: Kind, columns: list[str], other: str | None, schema: Mapping[str, str]) -> list[str]:
    named = columns + ([other] if other else [])
    missing = [c for c in named if c not in schema]
    if missing:
        return [f"not in the schema: {', '.join(missing)}"]
    wrong = [c for c in named if schema[c] not in kind.types]
    if wrong:
        return [f"{c} is {schema[c]}, which the rule does not take" for c in wrong]
    # Two numbers of either type compare; other types only with themselves.
    families = {"number" if schema[c] in NUMBERS else schema[c] for c in named}
    if other and (len(families) > 1 or other in columns):
        return ["two different columns of one family are needed"]
    return []


def check_arguments(contract: Mapping) -> None:
    """Reject a malformed contract before any job starts."""
    schema = contract.get("expected_schema") or {}
    bad = {c: t for c, t in schema.items() if t not in CONTRACT_TYPES}
    if bad:
        raise ValueError(f"unknown contract types: {bad}")
    wrong = [f"rules[{i}]: {w}" for i, r in enumerate(contract.get("rules") or []) for w in complaints(r, schema)]
    if wrong:
        raise ValueError("; ".join(wrong))
