"""Selection: type, context, time and condition; projection, order, offset and limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ast import Order, Query
from ..errors import CommandError
from ..functions.predicates import own_name, predicate
from ..functions.times import parse_time
from ..schema import EventSchema
from ..sources.catalog import columns_of


def time_field(schema: EventSchema, using: str | None) -> str:
    name = own_name(using, schema.event_type) if using else "timestamp"
    if schema.kind(name) is None:
        raise CommandError(f"{schema.event_type} has no field {name}")
    return name


def filtered(frame: DataFrame, schema: EventSchema, q: Query, context: bool = True) -> DataFrame:
    """Rows that FOR, SINCE (inclusive; what is no time is ignored) and WHERE let through."""
    if context and q.context_id is not None:
        frame = frame.where(F.col("context_id") == q.context_id)
    since = parse_time(q.since)
    if since is not None:
        frame = frame.where(F.col(f"`{time_field(schema, q.using)}`") >= since)
    if q.where is not None:
        frame = frame.where(predicate(q.where, schema))
    return frame


def cut(frame: DataFrame, limit: int | None, offset: int | None) -> DataFrame:
    if offset and limit is None:
        raise CommandError("OFFSET needs LIMIT")
    if offset:
        frame = frame.offset(offset)
    return frame if limit is None else frame.limit(limit)


def ordered(frame: DataFrame, order: Order | None, *ties: str) -> DataFrame:
    if order is None:
        return frame
    if order.field not in frame.columns:
        raise CommandError(f"cannot order by {order.field}")
    column = F.col(f"`{order.field}`")
    return frame.orderBy(column.desc() if order.desc else column.asc(), *(F.col(t) for t in ties if t != order.field))


def select(frame: DataFrame, schema: EventSchema, q: Query) -> DataFrame:
    """Events in the order asked for (ties by event_id), or in none."""
    if q.offset is not None and q.limit is None:
        raise CommandError("OFFSET needs LIMIT")
    out = filtered(frame, schema, q)
    if q.order:
        order = Order(own_name(q.order.field, schema.event_type), q.order.desc)
        out = ordered(out, order, "event_id")
    returns = tuple(own_name(f, schema.event_type) for f in q.returns)
    return cut(out, q.limit, q.offset).select(*(f"`{c}`" for c in columns_of(out, returns)))
