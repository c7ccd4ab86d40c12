"""JSON lines to the log: checked by the schema as columns, in micro-batches; results remembered are brought up to date."""

from __future__ import annotations

import hashlib
import itertools
import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.times import normalized
from ..schema import TIMES, EventSchema
from ..sources.catalog import EventLog
from ..storage import Store


def checked(lines: DataFrame, schema: EventSchema) -> DataFrame:
    """(context_id, payload columns, valid) of a column value of {"context_id", "payload"} lines."""
    at = lambda n: F.get_json_object("value", f"$.payload['{n}']")
    keys = F.json_object_keys(F.get_json_object("value", "$.payload"))
    valid: Column = F.coalesce(F.get_json_object("value", "$.context_id") != "", F.lit(False)) & keys.isNotNull()
    valid &= F.coalesce(F.size(F.array_except(keys, F.array(*(F.lit(n) for n in schema.fields)))) == 0, F.lit(False))
    columns = []
    for name, f in schema.fields.items():
        raw = at(name)
        value = {"bool": raw.try_cast("boolean"), "f64": raw.try_cast("double"), "u64": raw.try_cast("long"), "i64": raw.try_cast("long")}.get(f.kind, normalized(raw) if f.kind in TIMES else raw)
        if f.kind in ("u64", "i64"):
            value = F.when(raw.rlike(r"^-?\d+$"), value)
        ok = value.isNotNull()
        if f.kind == "u64":
            ok &= value >= 0
        if f.kind == "enum":
            ok &= value.isin(list(f.variants))
        valid &= F.coalesce(ok, F.lit(False)) | (raw.isNull() if f.optional else F.lit(False))
        columns.append(value.cast(f.spark).alias(name))
    return lines.select(F.get_json_object("value", "$.context_id").alias("context_id"), *columns, valid.alias("valid"))


def ingest(lines: DataFrame, log: EventLog, event_type: str, checkpoint: str, rejected: str | None = None, after: Callable[[], None] | None = None, **trigger) -> StreamingQuery:
    """Starts the stream. Of each micro-batch the valid lines go to the log, the others as JSON to the folder `rejected`; then `after` runs.

    Event ids follow those that the log has given, so marks of remembered results hold for both; the first of a batch is
    written down, and a batch that is run again after a failure gives the same ids to folders named by its number.
    """
    schema = log.schema(event_type)
    struct = schema.struct()
    stream = hashlib.sha1(checkpoint.encode()).hexdigest()[:12]
    notes = Store(log.spark, checkpoint)

    def batch(rows: DataFrame, number: int) -> None:
        known = json.loads(notes.read(f"first-ids/{number}") or "null")
        if known is None:
            known = [log.next_id(), int(time.time())]
            notes.write(f"first-ids/{number}", json.dumps(known))
        first, now = known
        place = F.monotonically_increasing_id()
        out = checked(rows, schema).withColumn("event_type", F.lit(event_type)).withColumn("timestamp", F.lit(now).cast("long")).withColumn("_place", place).persist()
        try:
            part = F.shiftright("_place", 33)
            sizes = sorted((r["part"], r["n"]) for r in out.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each partition
            starts = dict(zip((p for p, _ in sizes), itertools.accumulate((n for _, n in sizes), initial=first), strict=False))
            log.last_id = max(log.last_id, first + sum(n for _, n in sizes))
            start = F.create_map(*(F.lit(x).cast("long") for pair in starts.items() for x in pair))[part] if starts else F.lit(first)
            numbered = out.withColumn("event_id", start + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1).cast("long"))).drop("_place")
            good = numbered.where("valid").select(*(F.col(f"`{f.name}`").cast(f.dataType) for f in struct))
            log.write(event_type, good, f"stream-{stream}-{number}")
            if rejected:
                numbered.where("not valid").drop("valid").write.mode("overwrite").json(f"{rejected}/stream={stream}/batch={number}")
        finally:
            out.unpersist()
        if after:
            after()

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
