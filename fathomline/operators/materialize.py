"""REMEMBER and SHOW: stored results that take in what came since, from a high-water mark.

The mark is the greatest (time, event_id) stored; SHOW runs the query again on rows beyond it, writes them as a part of
their own and then replaces the catalog entry, which alone says which parts count. The time column is stored even where
RETURN leaves it out, and left out again by SHOW. Rows without time are new if their event_id is above all stored ones. Rows
whose time is below the mark when they come (with USING on a field of the payload) are not taken in. Results of metrics
and sequences are computed anew by each SHOW. More than MOST_PARTS parts become one. At most one writer at a time is
supported.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ast import Query, to_json
from ..errors import CommandError
from ..functions.predicates import own_name
from ..plans.planner import plan
from ..sources.catalog import Catalog, columns_of
from ..storage import Store
from .aggregate import BucketOptions
from .select import ordered

MOST_PARTS = 32


@dataclass(frozen=True)
class Retention:
    max_rows: int | None = None
    max_age_s: int | None = None


class Materializations:
    """Results by name: folders of Parquet parts and an entry each in materialized.json, which holds the query as text and as JSON. The other parameters are those of plan."""

    NAME = "materialized.json"

    def __init__(self, catalog: Catalog, store: Store, options: BucketOptions = BucketOptions(), compat: bool = False, slice_seconds: int | None = None):
        self.catalog, self.store = catalog, store
        self.options, self.compat, self.slice_seconds = options, compat, slice_seconds
        self.entries: dict[str, dict] = json.loads(store.read(self.NAME) or "{}")

    def save(self) -> None:
        self.store.write(self.NAME, json.dumps(self.entries))

    def plan(self, q: Query) -> DataFrame:
        return plan(q, self.catalog, self.options, self.compat, self.slice_seconds)

    def time_column(self, q: Query) -> str:
        name = own_name(q.using, q.event_type) if q.using else "timestamp"
        return name if self.catalog.schema(q.event_type).kind(name) else "timestamp"

    def kept(self, q: Query) -> Query:
        """The query with its time column in the result."""
        return replace(q, returns=(*q.returns, self.time_column(q))) if q.returns and self.incremental(q) else q

    @staticmethod
    def incremental(q: Query) -> bool:
        return not (q.aggs or q.bucket or q.by or q.links or q.limit is not None)

    def _write(self, name: str, rows: DataFrame, at: str) -> dict | None:
        folder = f"materialized/{name}/{uuid.uuid4().hex}"
        rows.write.parquet(self.store.path(folder))
        written = self.catalog.spark.read.schema(rows.schema).parquet(self.store.path(folder))
        has_mark = at in rows.columns and "event_id" in rows.columns
        mark = F.max(F.struct(F.col(f"`{at}`"), F.col("event_id"))) if has_mark else F.lit(None)
        n, high, last = written.agg(F.count(F.lit(1)), mark, F.max("event_id") if has_mark else F.lit(None)).first()
        if not n:
            self.store.delete(folder)
            return None
        return {"folder": folder, "rows": n, "high": list(high) if high is not None and high[0] is not None else None, "last": last, "at": int(time.time())}

    def remember(self, name: str, q: Query, text: str) -> dict:
        if name in self.entries:
            raise CommandError(f"{name} is already remembered", 409)
        rows = self.plan(self.kept(q))
        part = self._write(name, rows, self.time_column(q))
        self.entries[name] = {"query": text, "ast": to_json(q), "schema": rows.schema.json(), "parts": [part] if part else [], "high": part and part["high"], "last": part and part["last"]}
        self.save()
        return self.entries[name]

    def _entry(self, name: str) -> dict:
        if name not in self.entries:
            raise CommandError(f"nothing is remembered as {name}", 404)
        return self.entries[name]

    def stored(self, name: str) -> DataFrame:
        entry = self._entry(name)
        schema = T.StructType.fromJson(json.loads(entry["schema"]))
        folders = [self.store.path(p["folder"]) for p in entry["parts"]]
        spark = self.catalog.spark
        return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)

    def delta(self, q: Query, high: list | None, last: int | None = None) -> DataFrame:
        """What the query gives beyond the mark, and rows without time whose event_id is above `last`."""
        rows = self.plan(self.kept(q))
        if last is None:
            return rows
        t, i = F.col(f"`{self.time_column(q)}`").cast("long"), F.col("event_id").cast("long")
        new = t.isNull() & (i > last)
        if high is None:
            return rows.where(t.isNotNull() | new)
        mark = F.struct(F.lit(high[0]).cast("long").alias("t"), F.lit(high[1]).cast("long").alias("i"))
        return rows.where(((t >= high[0]) & (F.struct(t.alias("t"), i.alias("i")) > mark)) | new)

    def show(self, name: str, q: Query) -> DataFrame:
        """All that is stored, after what came since has been added."""
        entry, grows = self._entry(name), self.incremental(q)
        rows = self.delta(q, entry["high"], entry.get("last")) if grows else self.plan(q)
        if json.loads(rows.schema.json()) != json.loads(entry["schema"]):
            raise CommandError(f"the schema of {name} has changed", 500)
        old = [] if grows else entry["parts"]
        part = self._write(name, rows, self.time_column(q))
        entry["parts"] = (entry["parts"] if grows else []) + [part] * bool(part)
        if len(entry["parts"]) > MOST_PARTS:
            old = entry["parts"]
            entry["parts"] = [self._write(name, self.stored(name).coalesce(MOST_PARTS), self.time_column(q))]
        for key in ("high", "last"):
            found = [p[key] for p in entry["parts"] if p.get(key)]
            entry[key] = max([*found, *([entry[key]] if entry.get(key) and grows else [])], default=None)
        self.save()
        for p in old:
            self.store.delete(p["folder"])
        out = self.stored(name)
        if not grows:
            return out.orderBy(*_order(q, out))
        order = replace(q.order, field=own_name(q.order.field, q.event_type)) if q.order else None
        out = ordered(out, order, "event_id") if order and order.field in out.columns else out
        return out.select(*(F.col(f"`{c}`") for c in self.shown(q, out)))

    def shown(self, q: Query, stored: DataFrame) -> list[str]:
        """The columns that the query itself gives."""
        return columns_of(stored, tuple(own_name(f, q.event_type) for f in q.returns))

    def retain(self, name: str, policy: Retention, now: int | None = None) -> int:
        """Drops parts beyond the newest max_rows rows, and those whose mark is older than max_age_s. Returns how many."""
        entry = self._entry(name)
        kept, rows, now = [], 0, int(time.time()) if now is None else now
        for p in reversed(entry["parts"]):
            rows += p["rows"]
            old = policy.max_age_s is not None and p["high"] and p["high"][0] < now - policy.max_age_s
            if not old and (policy.max_rows is None or rows <= policy.max_rows):
                kept.insert(0, p)
        gone = [p for p in entry["parts"] if p not in kept]
        entry["parts"] = kept
        self.save()
        for p in gone:
            self.store.delete(p["folder"])
        return len(gone)


def _order(q: Query, frame: DataFrame) -> list:
    """The order in which the query gives its rows; stored parts have none."""
    if q.order and q.order.field in frame.columns:
        column = F.col(f"`{q.order.field}`")
        return [column.desc() if q.order.desc else column.asc()]
    keys = reduce(lambda out, c: out + [c] * (c in frame.columns), ["bucket", *q.by, "match", "place"], [])
    return [F.col(f"`{k}`") for k in keys] or [F.col(f"`{frame.columns[0]}`")]
