"""Metrics by groups and time buckets.

Groups are texts; those with a null or empty key are left out, and no rows give no row. COUNT UNIQUE is exact and
counts missing values as one empty text. TOTAL and AVG of no values are 0. Without ORDER BY, groups come by bucket,
then keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ast import Agg, Order, Query
from ..errors import CommandError
from ..functions.predicates import own_name
from ..functions.times import bucket
from ..schema import EventSchema
from .select import cut, filtered, ordered, time_field


@dataclass(frozen=True)
class BucketOptions:
    zone: str = "UTC"
    week_start: str = "mon"
    naive: bool = False


def metric(agg: Agg, schema: EventSchema) -> Column:
    if agg.field is None:
        return F.count(F.lit(1)).alias(agg.name)
    name = own_name(agg.field, schema.event_type)
    kind = schema.kind(name)
    column = F.lit(None).cast("string") if kind is None else F.col(f"`{name}`")
    number = column if kind in ("u64", "i64", "f64", "datetime", "date") else column.try_cast("double") if kind else F.lit(None).cast("long")
    zero = F.lit(0.0) if kind in ("f64", "string", "enum", "bool") else F.lit(0).cast("long")
    out = {
        "count": F.count(column),
        "count_unique": F.count_distinct(F.coalesce(column.cast("string"), F.lit(""))),
        "total": F.coalesce(F.sum(number), zero),
        "avg": F.coalesce(F.avg(number), F.lit(0.0)),
        "min": F.min(column),
        "max": F.max(column),
    }
    return out[agg.kind].alias(Agg(agg.kind, name).name)


def grouped(frame: DataFrame, schema: EventSchema, q: Query, options: BucketOptions = BucketOptions()) -> DataFrame:
    """Bucket and key columns, then metrics; no order yet."""
    frame = filtered(frame, schema, q)
    keys = []
    if q.bucket:
        at = F.col(f"`{time_field(schema, q.bucket.field or q.using)}`")
        keys.append(bucket(at, q.bucket.granularity, options.zone, options.week_start, options.naive).alias("bucket"))
    for by in q.by:
        name = own_name(by, schema.event_type)
        if schema.kind(name) is None:
            raise CommandError(f"{schema.event_type} has no field {name}")
        key = F.col(f"`{name}`").cast("string")
        frame = frame.where(key.isNotNull() & (key != ""))
        keys.append(key.alias(name))
    metrics = [metric(a, schema) for a in dict.fromkeys(q.aggs or (Agg("count"),))]
    if keys:
        return frame.groupBy(*keys).agg(*metrics)
    return frame.agg(F.count(F.lit(1)).alias("_rows"), *metrics).where("_rows > 0").drop("_rows")


def key_names(q: Query) -> list[str]:
    return ["bucket"] * bool(q.bucket) + [own_name(b, q.event_type) for b in q.by]


def aggregate(frame: DataFrame, schema: EventSchema, q: Query, options: BucketOptions = BucketOptions()) -> DataFrame:
    if q.offset is not None and q.limit is None:
        raise CommandError("OFFSET needs LIMIT")
    out, keys = grouped(frame, schema, q, options), key_names(q)
    if q.order:
        out = ordered(out, Order(own_name(q.order.field, schema.event_type), q.order.desc), *keys)
    elif keys:
        out = out.orderBy(*(f"`{k}`" for k in keys))
    return cut(out, q.limit, q.offset)
