"""A command and a catalog give one lazy frame; names are resolved before Spark is asked."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..ast import CompareQueries, Query, Replay
from ..errors import CommandError
from ..operators.aggregate import BucketOptions, aggregate, grouped
from ..operators.compare import compare
from ..operators.replay import replay
from ..operators.select import select
from ..operators.sequence import sequence
from ..sources.catalog import Catalog


def plan(command: Query | CompareQueries | Replay, catalog: Catalog, options: BucketOptions = BucketOptions(), compat: bool = False, slice_seconds: int | None = None) -> DataFrame:
    if isinstance(command, CompareQueries):
        return compare(command, lambda q: grouped(catalog.frame(q.event_type), catalog.schema(q.event_type), q, options))
    if isinstance(command, Replay):
        return replay(catalog.wildcard() if command.event_type in (None, "*") else catalog.frame(command.event_type), command)
    if not isinstance(command, Query):
        raise CommandError(f"{type(command).__name__} gives no rows")
    schema, frame = catalog.schema(command.event_type), catalog.frame(command.event_type)
    if command.links:
        if len(command.links) > 1:
            raise CommandError("a sequence has two event types")
        other = command.links[0].event_type
        return sequence(frame, schema, catalog.frame(other), catalog.schema(other), command, compat, slice_seconds)
    if command.aggs or command.bucket or command.by:
        return aggregate(frame, schema, command, options)
    return select(frame, schema, command)
