"""Event types as DataFrames: registered frames, and a log of Parquet files with a part that is not written yet."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CommandError
from ..schema import CORE, EventSchema, SchemaRegistry
from ..storage import Store

#: Event ids are 42 bits of milliseconds since 2021-01-01, 10 bits of a shard and 12 bits of a sequence.
ID_EPOCH_MS, SHARD_BITS, SEQUENCE_BITS = 1_609_459_200_000, 10, 12


class Catalog:
    """Event types with a schema and a frame of the core columns and the payload's.

    distinct: events that come twice (one event_id) are taken once by all that reads, at the price of a shuffle.
    """

    def __init__(self, spark: SparkSession, registry: SchemaRegistry | None = None, distinct: bool = False):
        self.spark, self.registry, self.distinct = spark, registry or SchemaRegistry(), distinct
        self.frames: dict[str, DataFrame | Callable[[], DataFrame]] = {}

    def register(self, event_type: str, frame: DataFrame | Callable[[], DataFrame], fields: dict[str, Any]) -> EventSchema:
        """A frame, or a function that makes it when it is first asked for (so that files of other types aren't looked at)."""
        schema = self.registry.schemas.get(event_type) or self.registry.define(event_type, fields)
        self.frames[event_type] = frame
        return schema

    def registered(self, event_type: str) -> DataFrame:
        frame = self.frames[event_type]
        if callable(frame):
            frame = frame()
        struct = self.schema(event_type).struct()
        if frame.schema != struct:
            frame = frame.select(*(F.col(f"`{f.name}`").cast(f.dataType) for f in struct))
        self.frames[event_type] = frame
        return self.once(frame)

    def once(self, frame: DataFrame) -> DataFrame:
        return distinct_events(frame) if self.distinct else frame

    def schema(self, event_type: str) -> EventSchema:
        return self.registry.get(event_type)

    def frame(self, event_type: str) -> DataFrame:
        schema = self.schema(event_type)
        return self.registered(event_type) if event_type in self.frames else self.spark.createDataFrame([], schema.struct())

    def wildcard(self, event_types: list[str] | None = None) -> DataFrame:
        """All types' events; columns of one name and different types become text."""
        names = event_types if event_types is not None else sorted(self.registry.schemas)
        if not names:
            raise CommandError("no event type is defined", 404)
        kinds: dict[str, set] = {}
        for n in names:
            for f in self.schema(n).struct():
                kinds.setdefault(f.name, set()).add(f.dataType.simpleString())
        mixed = {n for n, k in kinds.items() if len(k) > 1}
        out = None
        for n in names:
            frame = self.frame(n)
            frame = frame.select(*(F.col(f"`{c}`").cast("string").alias(c) if c in mixed else F.col(f"`{c}`") for c in frame.columns))
            out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
        return out


class EventLog(Catalog):
    """A catalog on files: one folder of Parquet a type. Stored events are held until flush() and are seen by queries at once.

    Each held event is a file of its own under wal/ first (unless durable is False), and a log that is opened again holds
    these events again. flush() writes to a folder named by the first event held, so that one that is repeated after a
    crash writes the same events once.
    """

    def __init__(self, spark: SparkSession, root: str, flush_after: int = 10_000, shard: int = 0, distinct: bool = False, durable: bool = True):
        self.store_files = Store(spark, root)
        super().__init__(spark, SchemaRegistry(self.store_files), distinct)
        self.flush_after, self.shard, self.durable, self.pending, self.last_id = flush_after, shard, durable, {}, -1
        if durable:
            self.recover()

    def recover(self) -> None:
        """Holds again what was stored and not flushed when an earlier log on this folder ended."""
        for event_type in self.store_files.names("wal"):
            names = [f.name for f in self.schema(event_type).struct()]
            for event_id in sorted(map(int, (n for n in self.store_files.names(f"wal/{event_type}") if n.isdigit()))):
                values = json.loads(self.store_files.read(f"wal/{event_type}/{event_id}"))
                self.pending.setdefault(event_type, []).append(tuple(values[n] for n in names))
                self.last_id = max(self.last_id, event_id)

    def folder(self, event_type: str) -> str:
        return self.store_files.path(f"events/{event_type}")

    def next_id(self, now_ms: int | None = None) -> int:
        now = int(time.time() * 1000) if now_ms is None else now_ms
        least = ((now - ID_EPOCH_MS) << (SHARD_BITS + SEQUENCE_BITS)) | (self.shard << SEQUENCE_BITS)
        if self.last_id < least:
            self.last_id = least
        else:
            self.last_id += 1
            if not self.last_id & ((1 << SEQUENCE_BITS) - 1):  # the sequence ran over: the next millisecond, same shard
                self.last_id += ((1 << SHARD_BITS) - 1) << SEQUENCE_BITS
        return self.last_id

    def append(self, event_type: str, context_id: str, payload: dict[str, Any], now: int | None = None) -> int:
        schema = self.schema(event_type)
        if not context_id:
            raise CommandError("a context is needed")
        values = schema.checked(payload)
        event_id = self.next_id()
        core = {"context_id": context_id, "event_type": event_type, "timestamp": int(time.time()) if now is None else now, "event_id": event_id}
        row = {f.name: {**values, **core}[f.name] for f in schema.struct()}
        if self.durable:
            self.store_files.write(f"wal/{event_type}/{event_id}", json.dumps(row))
        self.pending.setdefault(event_type, []).append(tuple(row.values()))
        if sum(map(len, self.pending.values())) >= self.flush_after:
            self.flush()
        return event_id

    def flush(self) -> int:
        """Writes what is held: a file of its own for each type, in order of time. Returns how many events."""
        n = 0
        for event_type, rows in list(self.pending.items()):
            struct = self.schema(event_type).struct()
            place = struct.names.index("event_id")
            self.write(event_type, self.spark.createDataFrame(rows, struct), f"flush-{rows[0][place]}")
            n += len(rows)
            del self.pending[event_type]
            if self.durable:
                self.store_files.delete(f"wal/{event_type}")
        return n

    def write(self, event_type: str, frame: DataFrame, part: str | None = None) -> None:
        """Adds a frame of events: bulk ingest, and micro-batches of a stream. A part that is written again takes its own place."""
        out = frame.sortWithinPartitions("timestamp", "event_id").write.option("parquet.bloom.filter.enabled#context_id", "true")
        if part:
            out.mode("overwrite").parquet(f"{self.folder(event_type)}/{part}")
        else:
            out.mode("append").parquet(self.folder(event_type))

    def read(self, event_type: str) -> DataFrame | None:
        """What is written, in whatever folders below the type's."""
        name = f"events/{event_type}"
        if not self.store_files.exists(name):
            if not self.store_files.exists(f"{name}.new/_SUCCESS"):
                return None
            self.store_files.rename(f"{name}.new", name)  # a compaction ended before its last step
        return self.spark.read.schema(self.schema(event_type).struct()).option("recursiveFileLookup", "true").parquet(self.folder(event_type))

    def frame(self, event_type: str) -> DataFrame:
        struct = self.schema(event_type).struct()
        if event_type in self.frames:
            out = self.registered(event_type)
        else:
            out = self.read(event_type)
        held = self.pending.get(event_type)
        if held or out is None:
            rows = self.spark.createDataFrame(held or [], struct)
            out = rows if out is None else out.unionByName(rows)
        return self.once(out)

    def compact(self, event_type: str, files: int) -> None:
        """Rewrites a type's files into `files`, by ranges of time; the new folder takes the old one's place (read() ends that where a crash came between)."""
        rows = self.read(event_type)
        if rows is None:
            return
        name = f"events/{event_type}"
        rows.repartitionByRange(files, "timestamp", "event_id").sortWithinPartitions("timestamp", "event_id").write.mode("overwrite").option("parquet.bloom.filter.enabled#context_id", "true").parquet(self.folder(event_type) + ".new")
        self.store_files.delete(name)
        self.store_files.rename(f"{name}.new", name)

    def snapshot(self, event_types: list[str], path: str) -> None:
        """The events of some types as JSON lines."""
        self.wildcard(event_types).write.mode("overwrite").json(path)

    def restore(self, path: str) -> int:
        """Appends the events of a snapshot whose types are defined. Returns how many."""
        held = self.spark.read.text(path)
        n = 0
        for event_type, schema in self.registry.schemas.items():
            rows = held.where(F.get_json_object("value", "$.event_type") == event_type).select(F.from_json("value", schema.struct()).alias("e")).select("e.*")
            count = rows.count()
            if count:
                self.write(event_type, rows)
                n += count
        return n


def distinct_events(frame: DataFrame) -> DataFrame:
    """One row for each event_id, where a source may give an event twice."""
    return frame.dropDuplicates(["event_id"])


def columns_of(frame: DataFrame, wanted: tuple[str, ...]) -> list[str]:
    """Core columns, then those wanted that there are; none wanted: all."""
    core = [c for c in CORE if c in frame.columns]
    rest = [c for c in frame.columns if c not in CORE] if not wanted else [c for c in dict.fromkeys(wanted) if c in frame.columns and c not in CORE]
    return core + rest
