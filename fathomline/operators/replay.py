"""One context's events, of one type or all, in order of time and id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ast import Replay
from ..functions.times import parse_time
from ..sources.catalog import columns_of


def replay(frame: DataFrame, r: Replay) -> DataFrame:
    out = frame.where(F.col("context_id") == r.context_id)
    since = parse_time(r.since)
    if since is not None:
        using = r.using if r.using in frame.columns else "timestamp"
        out = out.where(F.col(f"`{using}`") >= since)
    return out.orderBy("timestamp", "event_id").select(*(f"`{c}`" for c in columns_of(out, r.returns)))
