"""The same metric of several queries side by side: a full outer join on bucket and groups.

The sides are aggregated each on its own; their groups, few by then, are put under each other and added up by key,
which is the full outer join of them all in one shuffle, null keys included.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ast import CompareQueries, Order, Query
from ..errors import CommandError
from .aggregate import key_names
from .select import cut, ordered

#: Prefixes of sides where an event type comes twice.
PREFIXES = ("left", "right", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth")


def prefixes(sides: tuple[Query, ...]) -> list[str]:
    """The event types; the places' names for those that repeat an earlier one (the first keeps its name)."""
    out: list[str] = []
    for k, s in enumerate(sides):
        place = PREFIXES[k] if k < len(PREFIXES) else f"side_{k + 1}"
        out.append(s.event_type if s.event_type not in out else place)
    return out


def compare(c: CompareQueries, grouped: Callable[[Query], DataFrame]) -> DataFrame:
    """Columns: bucket, keys, then <prefix>.<metric> of each side (null where it lacks the key), by key."""
    if len(c.sides) < 2:
        raise CommandError("a comparison has two sides at least")
    first, names = c.sides[0], prefixes(c.sides)
    keys, name = key_names(first), first.aggs[0].name
    rows = None
    for k, side in enumerate(c.sides):
        one = grouped(side)
        if side.limit is not None:
            one = cut(ordered(one, side.order, *keys), side.limit, side.offset)
        one = one.select(*(F.col(f"`{x}`") for x in keys), F.lit(k).alias("_side"), F.col(f"`{name}`").alias("_value"))
        rows = one if rows is None else rows.unionByName(one)
    values = [F.max(F.when(F.col("_side") == k, F.col("_value"))).alias(f"{p}.{name}") for k, p in enumerate(names)]
    out = rows.groupBy(*(f"`{x}`" for x in keys)).agg(F.count(F.lit(1)).alias("_n"), *values).where("_n > 0").drop("_n")
    if c.order is not None:
        target = c.order.field
        target = f"{names[0]}.{target}" if target == name else target
        return cut(ordered(out, Order(target, c.order.desc), *keys), c.limit, None)
    return cut(out.orderBy(*(f"`{x}`" for x in keys)) if keys else out, c.limit, None)
