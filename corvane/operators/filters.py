"""Metadata filters: a list of field predicates, all of which must hold, compiled to one column.

A missing value is an ordinary one: it differs from every operand, and no order holds for it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.errors import EmptyQueryError

#: The operators.
OPERATORS = ("eq", "ne", "in", "nin", "gt", "gte", "lt", "lte", "contains", "exists", "regex")


def operator_name(name: str) -> str:
    found = name.strip().lower().removeprefix("$")
    if found not in OPERATORS:
        raise ValueError(f"unknown operator {name!r}; known: {', '.join(OPERATORS)}")
    return found


@dataclass(frozen=True)
class FieldFilter:
    field: str
    operator: str
    value: Any

    def __post_init__(self):
        if not self.field.strip():
            raise ValueError("a filter needs a field")
        object.__setattr__(self, "operator", operator_name(self.operator))
        if self.operator in ("in", "nin") and not (self.value is None or isinstance(self.value, (list, tuple, set, frozenset))):
            raise ValueError(f"{self.operator} needs a list of values")


@dataclass(frozen=True)
class FilterSpec:
    filters: tuple[FieldFilter, ...] = ()

    @classmethod
    def of(cls, criteria: dict[str, Any] | None) -> FilterSpec:
        """From {field: criterion}: a dict of operators, a list of values, one value, or None for no restriction."""
        spec = cls()
        for field, c in (criteria or {}).items():
            if isinstance(c, dict):
                for op, value in c.items():
                    spec = spec.add(field, op, value)
            elif isinstance(c, (list, tuple, set, frozenset)):
                spec = spec.add(field, "in", [*c])
            elif c is not None:
                spec = spec.add(field, "eq", c)
        return spec

    def add(self, field: str, operator: str, value: Any) -> FilterSpec:
        return FilterSpec((*self.filters, FieldFilter(field, operator, value)))

    def fields(self) -> set[str]:
        return {f.field for f in self.filters}

    def merged(self) -> dict[str, dict[str, Any]]:
        """By field and operator; of two predicates with the same, the later one counts."""
        out: dict[str, dict[str, Any]] = {}
        for f in self.filters:
            out.setdefault(f.field, {})[f.operator] = f.value
        return out

    def __len__(self) -> int:
        return len(self.filters)

    def __bool__(self) -> bool:
        return bool(self.filters)

    def __iter__(self) -> Iterator[FieldFilter]:
        return iter(self.filters)


@dataclass(frozen=True)
class Query:
    """What to look for.  top_k counts unless the search is told another."""

    text: str
    filters: FilterSpec = FilterSpec()
    top_k: int | None = None

    def __post_init__(self):
        if not self.text.strip():
            raise EmptyQueryError("a query needs text")
        if isinstance(self.filters, dict):
            object.__setattr__(self, "filters", FilterSpec.of(self.filters))

    def with_filter(self, field: str, operator: str, value: Any) -> Query:
        return replace(self, filters=self.filters.add(field, operator, value))


def _family(x: Any) -> str | None:
    if isinstance(x, T.DataType):
        return "bool" if isinstance(x, T.BooleanType) else "number" if isinstance(x, T.NumericType) else "text" if isinstance(x, T.StringType) else None
    return "bool" if isinstance(x, bool) else "number" if isinstance(x, (int, float)) else "text" if isinstance(x, str) else None


def _comparable(kind: T.DataType, value: Any) -> bool:
    """Booleans are numbers here; text compares with text only."""
    a, b = _family(kind), _family(value)
    return a is not None and b is not None and (a == b or {a, b} == {"bool", "number"})


def _operand(kind: T.DataType, value: Any) -> Any:
    if _family(kind) == "number" and isinstance(value, bool):
        return int(value)
    return value


def java_pattern(pattern: str) -> str:
    """A Python pattern in Java's spelling: named groups, and classes over all of Unicode."""
    return "(?U)" + re.sub(r"\(\?P<", "(?<", re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern))


def predicate(column: Column, kind: T.DataType, operator: str, value: Any) -> Column:
    """One predicate; true or false, never null."""
    op = operator_name(operator)
    false = F.lit(False)
    if isinstance(kind, T.BooleanType) and not isinstance(value, bool) and isinstance(value, (int, float)):
        column, kind = column.cast("int"), T.IntegerType()
    if op == "exists":
        return column.isNotNull() if value else column.isNull()
    if op in ("eq", "ne"):
        same = column.isNull() if value is None else column.eqNullSafe(F.lit(_operand(kind, value))) if _comparable(kind, value) else false
        return same if op == "eq" else ~same
    if op in ("in", "nin"):
        values = [*(value or [])]
        known = [_operand(kind, v) for v in values if v is not None and _comparable(kind, v)]
        inside = F.coalesce(column.isin(known), false) if known else false
        inside = inside | column.isNull() if None in values else inside
        return inside if op == "in" else ~inside
    if op == "contains":
        if value is None:
            return false
        if isinstance(kind, T.StringType):
            return F.coalesce(column.contains(value), false) if isinstance(value, str) else false
        if isinstance(kind, T.ArrayType):
            return F.coalesce(F.exists(column, lambda x: x.eqNullSafe(F.lit(value))), false) if _comparable(kind.elementType, value) else false
        if isinstance(kind, T.MapType):
            return F.coalesce(F.map_contains_key(column, value), false) if _comparable(kind.keyType, value) else false
        return false
    if op == "regex":
        return F.coalesce(column.cast("string").rlike(java_pattern(str(value))), false)
    if value is None or not _comparable(kind, value):
        return false
    other = F.lit(_operand(kind, value))
    return F.coalesce({"gt": column > other, "gte": column >= other, "lt": column < other, "lte": column <= other}[op], false)


def compiled(spec: FilterSpec | dict[str, Any] | None, schema: T.StructType) -> Column:
    """All predicates of a spec over a table's columns; a column that the table lacks is missing in every row."""
    spec = spec if isinstance(spec, FilterSpec) else FilterSpec.of(spec)
    kinds = {f.name: f.dataType for f in schema}
    parts = []
    for field, ops in spec.merged().items():
        kind = kinds.get(field, T.StringType())
        column = F.col(f"`{field}`") if field in kinds else F.lit(None).cast("string")
        parts += [predicate(column, kind, op, value) for op, value in ops.items()]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def apply(df: DataFrame, spec: FilterSpec | dict[str, Any] | None) -> DataFrame:
    spec = spec if isinstance(spec, FilterSpec) else FilterSpec.of(spec)
    return df.where(compiled(spec, df.schema)) if spec else df
