"""The fluent API: the same commands without text.

    Events(engine).query("purchase").where(field("value") > 10).per("day").by("user_id").count().frame()
"""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame

from . import ast


class Condition:
    def __init__(self, expr: ast.Expr):
        self.expr = expr

    def __and__(self, other: Condition) -> Condition:
        return Condition(ast.And(self.expr, other.expr))

    def __or__(self, other: Condition) -> Condition:
        return Condition(ast.Or(self.expr, other.expr))

    def __invert__(self) -> Condition:
        return Condition(ast.Not(self.expr))


class field:  # noqa: N801
    def __init__(self, name: str):
        self.name = name

    def _is(self, op: str, value: Any) -> Condition:
        return Condition(ast.Compare(self.name, op, value))

    def __eq__(self, value: Any) -> Condition:  # type: ignore[override]
        return self._is("=", value)

    def __ne__(self, value: Any) -> Condition:  # type: ignore[override]
        return self._is("!=", value)

    def __gt__(self, value: Any) -> Condition:
        return self._is(">", value)

    def __ge__(self, value: Any) -> Condition:
        return self._is(">=", value)

    def __lt__(self, value: Any) -> Condition:
        return self._is("<", value)

    def __le__(self, value: Any) -> Condition:
        return self._is("<=", value)

    def isin(self, *values: Any) -> Condition:
        return Condition(ast.In(self.name, values))

    __hash__ = None  # type: ignore[assignment]


class QueryBuilder:
    def __init__(self, engine, query: ast.Query):
        self.engine, self.query = engine, query

    def _with(self, **changes: Any) -> QueryBuilder:
        return QueryBuilder(self.engine, replace(self.query, **changes))

    def for_context(self, context_id: str) -> QueryBuilder:
        return self._with(context_id=context_id)

    def since(self, value: Any, using: str | None = None) -> QueryBuilder:
        return self._with(since=value, using=using or self.query.using)

    def using(self, name: str) -> QueryBuilder:
        return self._with(using=name)

    def where(self, condition: Condition) -> QueryBuilder:
        return self._with(where=ast.And(self.query.where, condition.expr) if self.query.where else condition.expr)

    def returning(self, *names: str) -> QueryBuilder:
        return self._with(returns=names)

    def per(self, granularity: str, using: str | None = None) -> QueryBuilder:
        return self._with(bucket=ast.Bucket(granularity.lower(), using))

    def by(self, *names: str) -> QueryBuilder:
        return self._with(by=names)

    def _metric(self, kind: str, name: str | None) -> QueryBuilder:
        return self._with(aggs=(*self.query.aggs, ast.Agg(kind, name)))

    def count(self, name: str | None = None) -> QueryBuilder:
        return self._metric("count", name)

    def count_unique(self, name: str) -> QueryBuilder:
        return self._metric("count_unique", name)

    def total(self, name: str) -> QueryBuilder:
        return self._metric("total", name)

    def avg(self, name: str) -> QueryBuilder:
        return self._metric("avg", name)

    def min(self, name: str) -> QueryBuilder:
        return self._metric("min", name)

    def max(self, name: str) -> QueryBuilder:
        return self._metric("max", name)

    def order_by(self, name: str, desc: bool = False) -> QueryBuilder:
        return self._with(order=ast.Order(name, desc))

    def limit(self, n: int, offset: int | None = None) -> QueryBuilder:
        return self._with(limit=n, offset=offset)

    def followed_by(self, event_type: str, linked_by: str, using_time: str | None = None) -> QueryBuilder:
        return self._with(links=(ast.Link(True, event_type),), linked_by=linked_by, using_time=using_time)

    def preceded_by(self, event_type: str, linked_by: str, using_time: str | None = None) -> QueryBuilder:
        return self._with(links=(ast.Link(False, event_type),), linked_by=linked_by, using_time=using_time)

    def versus(self, *others: QueryBuilder) -> DataFrame:
        return self.engine.execute(ast.CompareQueries((self.query, *(o.query for o in others))))

    def frame(self, user: str | None = None) -> DataFrame:
        return self.engine.execute(self.query, user)


class Events:
    def __init__(self, engine):
        self.engine = engine

    def define(self, event_type: str, fields: dict[str, Any], version: int | None = None) -> str:
        return self.engine.execute(ast.Define(event_type, fields, version))

    def store(self, event_type: str, context_id: str, payload: dict[str, Any]) -> str:
        return self.engine.execute(ast.Store(event_type, context_id, payload))

    def query(self, event_type: str) -> QueryBuilder:
        return QueryBuilder(self.engine, ast.Query(event_type))

    def replay(self, context_id: str, event_type: str | None = None, since: Any = None, returning: tuple[str, ...] = ()) -> DataFrame:
        return self.engine.execute(ast.Replay(context_id, event_type, since, returns=returning))
