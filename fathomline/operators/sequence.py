"""A FOLLOWED BY B, A PRECEDED BY B: for each A the nearest B of the same link value, by one union and one window.

FOLLOWED BY takes the earliest B at or after A, PRECEDED BY the latest B before A; at equal times the event ids decide.
A B may serve many As; As without B and rows without link value are left out. Link values of texts and of numbers do
not meet. Both directions run through a link's rows once, with a frame that only grows.

With `slice_seconds` a link's rows are dealt out by time as well, so that a link with very many rows is many tasks: the
nearest B is looked for within its slice, and where that has none, the next slice's edge is carried over from a table
of one row for each link and slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ast import Query
from ..errors import CommandError
from ..functions.predicates import ambiguous, own_name, predicate, side_of
from ..schema import CORE, NUMBERS, TIMES, EventSchema
from ..sources.catalog import columns_of
from .select import cut, filtered, time_field


def _family(kind: str | None) -> str | None:
    return "number" if kind in NUMBERS or kind in TIMES else "text" if kind in ("string", "enum") else kind


def _side(frame: DataFrame, schema: EventSchema, q: Query, columns: tuple[str, ...]) -> DataFrame:
    """link, ts, id and the row as a struct, after the conditions of this type."""
    from dataclasses import replace

    where = side_of(q.where, schema.event_type)
    rows = filtered(frame, schema, replace(q, where=None), context=False)
    if where is not None:
        rows = rows.where(predicate(where, schema))
    link = own_name(q.linked_by, schema.event_type)
    if schema.kind(link) is None:
        raise CommandError(f"{schema.event_type} has no field {link}")
    names = columns_of(rows, columns)
    return rows.where(F.col(f"`{link}`").isNotNull()).select(F.col(f"`{link}`").cast("string").alias("link"), F.col(f"`{time_field(schema, q.using_time)}`").alias("ts"), F.col("event_id").alias("id"), F.struct(*(F.col(f"`{n}`") for n in names)).alias("row"))


def pairs(a_frame: DataFrame, a: EventSchema, b_frame: DataFrame, b: EventSchema, q: Query, compat: bool = False, slice_seconds: int | None = None) -> DataFrame:
    """(link, ts, a, b): one row for each match; a and b are structs. compat: in PRECEDED BY, only links whose first B is before their first A."""
    if len(q.links) != 1:
        raise CommandError("a sequence has two event types")
    if not q.linked_by:
        raise CommandError("a sequence needs LINKED BY")
    schemas = [a] if a is b else [a, b]
    doubtful = ambiguous(q.where, schemas)
    if doubtful:
        raise CommandError(f"in several event types: {', '.join(doubtful)}; put the type's name before it")
    followed = q.links[0].followed
    own = lambda s: tuple(own_name(r, s.event_type) for r in q.returns)
    left, right = _side(a_frame, a, q, own(a)), _side(b_frame, b, q, own(b))
    if _family(a.kind(own_name(q.linked_by, a.event_type))) != _family(b.kind(own_name(q.linked_by, b.event_type))):
        right = right.where(F.lit(False))
    both = left.select("link", "ts", "id", F.lit(0).alias("is_b"), F.col("row").alias("a"), F.lit(None).cast(right.schema["row"].dataType).alias("b"))
    both = both.unionByName(right.select("link", "ts", "id", F.lit(1).alias("is_b"), F.lit(None).cast(left.schema["row"].dataType).alias("a"), F.col("row").alias("b")))
    keys = [F.col(c).desc() if followed else F.col(c).asc() for c in ("ts", "is_b", "id")]
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(*by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    if slice_seconds:
        both = both.withColumn("slice", F.floor(F.col("ts") / slice_seconds))
        out = both.withColumn("near", F.last("b", ignorenulls=True).over(before("link", "slice", keys)))
        edge = (F.min_by if followed else F.max_by)("b", F.when(F.col("is_b") == 1, F.struct("ts", "id")))
        slices = both.groupBy("link", "slice").agg(edge.alias("edge"))
        order = [F.col("slice").desc() if followed else F.col("slice").asc()]
        slices = slices.select("link", "slice", F.last("edge", ignorenulls=True).over(before("link", order)).alias("carried"))
        out = out.join(slices, ["link", "slice"]).withColumn("near", F.coalesce("near", "carried"))
    else:
        out = both.withColumn("near", F.last("b", ignorenulls=True).over(before("link", keys)))
    if q.limit is not None or compat:
        out = out.withColumn("first_ts", F.min("ts").over(Window.partitionBy("link")))
    if compat and not followed:
        least = lambda side: F.min(F.when(F.col("is_b") == side, F.col("ts"))).over(Window.partitionBy("link"))
        out = out.withColumn("gate", least(1) < least(0)).where("gate")
    out = out.where("is_b = 0 and near is not null")
    if q.limit is not None:
        out = cut(out.orderBy("first_ts", "link", "ts", "id"), q.limit, q.offset)
    return out.select("link", "ts", "a", F.col("near").alias("b"))


def events(matches: DataFrame, followed: bool) -> DataFrame:
    """Two rows for each match, in the order of time: core columns, match (its A's event_id), then both types' fields.

    Both come from one row by explode, so that the matches are found once.
    """
    sides = {s: {f.name: f.dataType for f in matches.schema[s].dataType} for s in ("a", "b")}
    names = [*CORE, *(c for c in dict.fromkeys([*sides["a"], *sides["b"]]) if c not in CORE)]
    kinds = {}
    for c in names:
        found = [sides[s][c] for s in ("a", "b") if c in sides[s]]
        kinds[c] = found[0] if all(k == found[0] for k in found) else T.StringType()

    def row(side: str, place: int) -> Column:
        value = lambda c: F.col(side).getField(c) if c in sides[side] else F.lit(None)
        return F.struct(*(value(c).cast(kinds[c]).alias(c) for c in names), F.lit(place).alias("_place"))

    both = F.explode(F.array(row("a", 0 if followed else 1), row("b", 1 if followed else 0)))
    out = matches.select(F.col("a.event_id").alias("match"), both.alias("e"))
    field = lambda c: F.col("e").getField(c).alias(c)
    return out.select(*map(field, CORE), "match", F.col("e._place").alias("place"), *(field(c) for c in names if c not in CORE))


def sequence(a_frame: DataFrame, a: EventSchema, b_frame: DataFrame, b: EventSchema, q: Query, compat: bool = False, slice_seconds: int | None = None) -> DataFrame:
    if q.aggs:
        raise CommandError("metrics over a sequence are not supported")
    if q.offset is not None and q.limit is None:
        raise CommandError("OFFSET needs LIMIT")
    return events(pairs(a_frame, a, b_frame, b, q, compat, slice_seconds), q.links[0].followed)
