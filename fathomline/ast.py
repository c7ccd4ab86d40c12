"""What a command says, whichever way it was given: text, PlotQL, JSON or the fluent API."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any, Union

GRANULARITIES = ("hour", "day", "week", "month", "year")


@dataclass(frozen=True)
class Compare:
    field: str
    op: str  # = != > >= < <=
    value: Any


@dataclass(frozen=True)
class In:
    field: str
    values: tuple


@dataclass(frozen=True)
class And:
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Or:
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Not:
    inner: Expr


Expr = Union[Compare, In, And, Or, Not]


@dataclass(frozen=True)
class Agg:
    """kind: count, count_unique, total, avg, min, max; field None only for count."""

    kind: str
    field: str | None = None

    @property
    def name(self) -> str:
        return self.kind if self.field is None else f"{self.kind}_{self.field.replace('.', '_')}"


@dataclass(frozen=True)
class Order:
    field: str
    desc: bool = False


@dataclass(frozen=True)
class Bucket:
    granularity: str
    field: str | None = None


@dataclass(frozen=True)
class Link:
    followed: bool  # else preceded
    event_type: str


@dataclass(frozen=True)
class Query:
    event_type: str
    context_id: str | None = None
    since: Any = None
    using: str | None = None
    using_time: str | None = None
    returns: tuple[str, ...] = ()
    where: Expr | None = None
    aggs: tuple[Agg, ...] = ()
    bucket: Bucket | None = None
    by: tuple[str, ...] = ()
    limit: int | None = None
    offset: int | None = None
    order: Order | None = None
    links: tuple[Link, ...] = ()
    linked_by: str | None = None


@dataclass(frozen=True)
class CompareQueries:
    """PLOT ... VS ...: the same metric over several queries, joined on bucket and groups."""

    sides: tuple[Query, ...]
    limit: int | None = None
    order: Order | None = None


@dataclass(frozen=True)
class Replay:
    context_id: str
    event_type: str | None = None
    since: Any = None
    using: str | None = None
    returns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Define:
    event_type: str
    fields: dict[str, Any] = field(hash=False)
    version: int | None = None


@dataclass(frozen=True)
class Store:
    event_type: str
    context_id: str
    payload: dict[str, Any] = field(hash=False)


@dataclass(frozen=True)
class Remember:
    query: Query
    name: str


@dataclass(frozen=True)
class Show:
    name: str


@dataclass(frozen=True)
class Flush:
    pass


@dataclass(frozen=True)
class Ping:
    pass


@dataclass(frozen=True)
class Batch:
    commands: tuple


@dataclass(frozen=True)
class CreateUser:
    user: str
    key: str | None = None
    roles: tuple[str, ...] = ()


@dataclass(frozen=True)
class RevokeKey:
    user: str


@dataclass(frozen=True)
class ListUsers:
    pass


@dataclass(frozen=True)
class Grant:
    user: str
    event_types: tuple[str, ...]
    permissions: tuple[str, ...]


@dataclass(frozen=True)
class Revoke:
    user: str
    event_types: tuple[str, ...]
    permissions: tuple[str, ...] = ()  # none named: all


@dataclass(frozen=True)
class ShowPermissions:
    user: str


def to_json(x: Any) -> Any:
    """A command as JSON values; from_json gives it back."""
    if is_dataclass(x):
        return {"_": type(x).__name__, **{f.name: to_json(getattr(x, f.name)) for f in fields(x)}}
    return [to_json(v) for v in x] if isinstance(x, (tuple, list)) else x


def from_json(x: Any) -> Any:
    if isinstance(x, dict) and "_" in x:
        return globals()[x["_"]](**{k: from_json(v) for k, v in x.items() if k != "_"})
    return tuple(map(from_json, x)) if isinstance(x, list) else x
