"""The metadata filter language, compiled to a column over JSON text.

``{field: literal | {op: value, ..}, ..}``; fields and operators are joined by and.
A missing key and JSON null are the same; a bool equals 0 or 1 as a number;
comparing text with a number never holds; a comparison with null always does.
``$ne`` fails on a missing key, ``$nin`` holds.  Unknown operators are an error
when the filter is compiled.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = {"$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin"}


class _Value:
    """Views of one metadata field: its type, number and text."""

    def __init__(self, metadata: Column, field: str):
        name = field.replace("'", "\\'")
        v = F.try_variant_get(F.try_parse_json(metadata), f"$['{name}']", "variant")
        kind = F.schema_of_variant(v)
        self.missing = v.isNull() | F.is_variant_null(v)
        flag = F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double"))
        numeric = F.rlike(kind, F.lit("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"))
        self.number = F.coalesce(flag, F.when(numeric, F.try_variant_get(v, "$", "double")))
        self.text = F.when(kind == "STRING", F.try_variant_get(v, "$", "string"))

    def side(self, value: Any) -> tuple[Column, Column]:
        if isinstance(value, str):
            return self.text, F.lit(value)
        if isinstance(value, (bool, int, float)):
            return self.number, F.lit(float(value))
        raise ValueError(f"cannot compare with {value!r}")

    def equals(self, value: Any) -> Column:
        if value is None:
            return self.missing
        own, other = self.side(value)
        return F.coalesce(own == other, F.lit(False))


def _test(x: _Value, op: str, value: Any) -> Column:
    if op not in OPERATORS:
        raise ValueError(f"unknown operator {op}")
    if op in ("$in", "$nin"):
        if not isinstance(value, (list, tuple)):
            raise ValueError(f"{op} needs a list")
        hit = F.lit(False)
        for v in value:
            hit = hit | x.equals(v)
        return hit if op == "$in" else ~hit
    if op == "$eq":
        return x.equals(value)
    if op == "$ne":
        return ~x.missing if value is None else ~x.missing & ~x.equals(value)
    if value is None:
        return F.lit(True)
    own, other = x.side(value)
    made = {"$gt": own > other, "$gte": own >= other, "$lt": own < other, "$lte": own <= other}[op]
    return F.coalesce(made, F.lit(False))


def compile_where(where: dict[str, Any] | None, metadata: Column) -> Column:
    """The filter as a boolean column that is never null."""
    out = F.lit(True)
    for field, spec in (where or {}).items():
        x = _Value(metadata, field)
        for op, value in spec.items() if isinstance(spec, dict) else [("$eq", spec)]:
            out = out & _test(x, op, value)
    return out


def as_text(wanted: dict[str, str], metadata: Column) -> Column:
    """Whether all fields, as text, equal the given ones; a missing field never does."""
    out = F.lit(True)
    for field, value in wanted.items():
        out = out & F.coalesce(F.get_json_object(metadata, f"$.{field}") == value, F.lit(False))
    return out


def glob_to_regex(glob: str) -> str:
    """Anchored regular expression of a shell pattern with * and ?."""
    special = ".^$+{}[]()|\\"
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else f"\\{c}" if c in special else c for c in glob) + "$"


def type_glob(kind: Column, globs: list[str]) -> Column:
    """Whether the type matches one of the patterns."""
    out = F.lit(False)
    for g in globs:
        out = out | F.rlike(kind, F.lit(glob_to_regex(g)))
    return F.coalesce(out, F.lit(False))
