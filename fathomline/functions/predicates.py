"""Expressions as columns: leaves are true or false, never null, so that NOT has two values."""

from __future__ import annotations

import operator
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..ast import And, Compare, Expr, In, Not, Or
from ..schema import CORE, NUMBERS, TIMES, EventSchema
from .times import parse_time

OPS = {"=": operator.eq, "!=": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}


def literal(kind: str, value: Any) -> Any:
    """The value as the field holds it, or None if the field cannot hold such a value."""
    if kind in TIMES:
        return parse_time(value)
    if kind == "bool":
        if isinstance(value, str):
            value = {"true": True, "false": False}.get(value.lower(), value)
        return value if isinstance(value, bool) else None
    if kind in NUMBERS:
        if isinstance(value, bool):
            return None
        if isinstance(value, str):
            try:
                return float(value) if any(c in value for c in ".eE") else int(value)
            except ValueError:
                return None
        return value
    return str(value).lower() if isinstance(value, bool) else str(value)


def compare(schema: EventSchema, name: str, op: str, value: Any) -> Column:
    kind = schema.kind(name)
    got = None if kind is None else literal(kind, value)
    if got is None:
        return F.lit(False)
    if kind in ("string", "enum") and op not in ("=", "!="):
        return F.lit(False)  # texts have no order
    return OPS[op](F.col(f"`{name}`"), F.lit(got))


def among(schema: EventSchema, name: str, values: tuple) -> Column:
    kind = schema.kind(name)
    got = [] if kind is None else [x for x in (literal(kind, v) for v in values) if x is not None]
    return F.col(f"`{name}`").isin(got) if got else F.lit(False)


def predicate(expr: Expr, schema: EventSchema, negated: bool = False) -> Column:
    """Rows for which expr holds; under a NOT nulls are made false, elsewhere a null leaf drops the row as well and can be pushed down."""
    if isinstance(expr, And):
        return predicate(expr.left, schema, negated) & predicate(expr.right, schema, negated)
    if isinstance(expr, Or):
        return predicate(expr.left, schema, negated) | predicate(expr.right, schema, negated)
    if isinstance(expr, Not):
        return ~predicate(expr.inner, schema, True)
    name = own_name(expr.field, schema.event_type)
    leaf = compare(schema, name, expr.op, expr.value) if isinstance(expr, Compare) else among(schema, name, expr.values)
    return F.coalesce(leaf, F.lit(False)) if negated else leaf


def own_name(field: str, event_type: str) -> str:
    return field[len(event_type) + 1 :] if field.startswith(f"{event_type}.") else field


def fields_of(expr: Expr | None) -> set[str]:
    if expr is None:
        return set()
    if isinstance(expr, (And, Or)):
        return fields_of(expr.left) | fields_of(expr.right)
    return fields_of(expr.inner) if isinstance(expr, Not) else {expr.field}


def side_of(expr: Expr | None, event_type: str) -> Expr | None:
    """The part of a sequence's condition that speaks of one type: other types' leaves are left out."""
    if expr is None:
        return None
    if isinstance(expr, (And, Or)):
        left, right = side_of(expr.left, event_type), side_of(expr.right, event_type)
        return type(expr)(left, right) if left and right else left or right
    if isinstance(expr, Not):
        inner = side_of(expr.inner, event_type)
        return Not(inner) if inner else None
    return expr if "." not in expr.field or expr.field.startswith(f"{event_type}.") else None


def ambiguous(expr: Expr | None, schemas: list[EventSchema]) -> list[str]:
    """Fields without a type's name that several types have."""
    return sorted(f for f in fields_of(expr) if "." not in f and f not in CORE and sum(f in s.fields for s in schemas) > 1)
