"""Queries over what the engine itself has written: stored, streamed, remembered, compacted and restored events."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ast
from .operators.aggregate import BucketOptions
from .operators.materialize import Materializations, Retention
from .parser import parse
from .plans.planner import plan
from .session import Engine
from .sources.star import star_catalog
from .storage import Store

#: The events of January up to here come first, the others later.
FIRST = 1_705_276_800
PURCHASE = 'DEFINE purchase FIELDS {user_id: "int", value: "float | null", k: "int | null", even: "bool"}'


def new_root(spark: SparkSession) -> str:
    """A folder of its own in the shared one; where none is set, a local one, if all runs in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="fathomline-")
    return f"{base.rstrip('/')}/engine-{uuid.uuid4().hex}"


def shown(spark: SparkSession, sf_dir: str, command: str, event_type: str, first: str, options: BucketOptions = BucketOptions()) -> DataFrame:
    """A query remembered over a part of the events, shown twice after all have come."""
    catalog = star_catalog(spark, sf_dir)
    whole = catalog.frame(event_type)
    catalog.frames[event_type] = whole.where(first)
    q = parse(command)
    held = Materializations(catalog, Store(spark, new_root(spark)), options)
    held.remember("held", q, command)
    catalog.frames[event_type] = whole
    held.show("held", q)
    return held.show("held", q)


def retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of a remembered selection when only its newest part may stay."""
    catalog = star_catalog(spark, sf_dir)
    whole = catalog.frame("purchase")
    catalog.frames["purchase"] = whole.where(F.col("timestamp") < FIRST)
    q = parse("QUERY purchase RETURN [value]")
    held = Materializations(catalog, Store(spark, new_root(spark)))
    held.remember("held", q, "QUERY purchase RETURN [value]")
    catalog.frames["purchase"] = whole
    held.show("held", q)
    held.retain("held", Retention(max_rows=held.entries["held"]["parts"][-1]["rows"]))
    return held.stored("held")


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders added up by priority and status, each group an event by STORE, some of them flushed, read by an engine that was started anew."""
    engine = Engine(spark, new_root(spark))
    engine.execute('DEFINE group_seen FIELDS {status: "string", orders: "int", greatest: "float"}')
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    groups = orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("greatest"))
    for k, r in enumerate(sorted(groups.collect())):  # a row for each priority and status
        engine.execute(ast.Store("group_seen", r["o_orderpriority"], {"status": r["o_orderstatus"], "orders": r["n"], "greatest": r["greatest"]}))
        if k == 6:
            engine.execute("FLUSH")
    again = Engine(spark, engine.log.store_files.root)
    return again.execute("QUERY group_seen").drop("timestamp", "event_id")


def _purchases(spark: SparkSession, sf_dir: str) -> tuple[Engine, DataFrame]:
    engine = Engine(spark, new_root(spark))
    engine.execute(PURCHASE)
    return engine, star_catalog(spark, sf_dir).frame("purchase")


def compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases written in two parts and compacted."""
    engine, rows = _purchases(spark, sf_dir)
    for part in (F.col("timestamp") < FIRST, F.col("timestamp") >= FIRST):
        engine.log.write("purchase", rows.where(part))
    engine.log.compact("purchase", 3)
    return engine.execute("QUERY purchase")


def restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases written, given out as JSON lines, and restored into another log."""
    engine, rows = _purchases(spark, sf_dir)
    engine.log.write("purchase", rows)
    snapshot = f"{engine.log.store_files.root}/snapshot"
    engine.log.snapshot(["purchase"], snapshot)
    other = Engine(spark, new_root(spark))
    other.execute(PURCHASE)
    other.log.restore(snapshot)
    return other.execute("QUERY purchase")


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders from two streams of JSON lines; a selection remembered between them and shown twice after both."""
    from .streaming.ingest import ingest

    engine = Engine(spark, new_root(spark))
    engine.execute('DEFINE order_seen FIELDS {order_key: "int", total: "float", priority: "string"}')
    root = engine.log.store_files.root
    source = spark.read.parquet(f"{sf_dir}/orders.parquet")
    payload = F.struct(F.col("o_orderkey").alias("order_key"), F.col("o_totalprice").alias("total"), F.col("o_orderpriority").alias("priority"))
    lines = source.select((F.col("o_orderkey") % 2).alias("half"), F.to_json(F.struct(F.col("o_custkey").cast("string").alias("context_id"), payload.alias("payload"))).alias("value"))
    for half in (0, 1):
        lines.where(F.col("half") == half).select("value").write.text(f"{root}/lines/{half}")
        ingest(spark.readStream.text(f"{root}/lines/{half}"), engine.log, "order_seen", f"{root}/checks/{half}").awaitTermination()
        if half == 0:
            engine.execute("REMEMBER QUERY order_seen WHERE total > 100000 AS dear")
    engine.execute("SHOW dear")
    return engine.execute("SHOW dear").drop("timestamp", "event_id")


def distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics over a source that gives every event twice, each taken once."""
    catalog = star_catalog(spark, sf_dir)
    frame = catalog.frame("view")
    catalog.frames["view"], catalog.distinct = frame.unionByName(frame), True
    return plan(parse("QUERY view COUNT, TOTAL k BY even"), catalog)


def permitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which types of the click stream a user may read after GRANT and REVOKE."""
    engine = Engine(spark, new_root(spark))
    names = sorted(r["event_type"] for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type").distinct().collect())  # a row for each type
    engine.execute('CREATE USER reader WITH ROLES ["write-only"]')
    for n in names:
        engine.execute(f'DEFINE {n} FIELDS {{a: "int"}}')
    engine.execute(f"GRANT READ ON {', '.join(names)} TO reader")
    engine.execute(f"REVOKE READ ON {names[0]} FROM reader")
    return spark.createDataFrame([(n, engine.access.allowed("reader", "read", n), engine.access.allowed("reader", "write", n)) for n in names], "event_type string, may_read boolean, may_write boolean")


def wildcard_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All types' events with columns that some types lack."""
    return star_catalog(spark, sf_dir).wildcard().select("event_type", "event_id", "k", "total", "line")


def queries(ev: Callable[[str], str], orders: str, items: str, core: str, every: str) -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]]:
    """name: (query, SQL), for the tables' events as SQL."""
    early = f"timestamp < {FIRST}"
    eastern = BucketOptions(zone="US/Eastern")  # five hours behind in January
    kinds = ("click", "error", "purchase", "signup", "view")
    return {
        "show_using_return": (functools.partial(shown, command="QUERY order_placed USING placed_at WHERE total > 1000 RETURN [total]", event_type="order_placed", first="placed_at < 820454400"), f"SELECT {core}, total FROM {orders} WHERE total > 1000"),
        "show_zone_bucket": (functools.partial(shown, command="QUERY view COUNT PER DAY", event_type="view", first=early, options=eastern), f"SELECT timestamp - (timestamp - 18000) % 86400 AS bucket, count(*) AS count FROM {ev('view')} GROUP BY 1"),
        "show_after_stream": (streamed, "SELECT CAST(o_custkey AS VARCHAR) AS context_id, 'order_seen' AS event_type, o_orderkey AS order_key, o_totalprice AS total, o_orderpriority AS priority FROM orders WHERE o_totalprice > 100000"),
        "show_retained": (retained, f"SELECT {core}, value FROM {ev('purchase')} WHERE NOT {early}"),
        "store_and_restart": (stored, "SELECT o_orderpriority AS context_id, 'group_seen' AS event_type, o_orderstatus AS status, count(*) AS orders, max(o_totalprice) AS greatest FROM orders GROUP BY o_orderpriority, o_orderstatus"),
        "compact_log": (compacted, f"SELECT {every} FROM {ev('purchase')}"),
        "snapshot_restore": (restored, f"SELECT {every} FROM {ev('purchase')}"),
        "distinct_metrics": (distinct, f"SELECT CAST(even AS VARCHAR) AS even, count(*) AS count, CAST(sum(k) AS BIGINT) AS total_k FROM {ev('view')} GROUP BY 1"),
        "permissions": (permitted, "SELECT DISTINCT event_type, event_type <> (SELECT min(event_type) FROM events) AS may_read, false AS may_write FROM events"),
        "wildcard_columns": (wildcard_columns, " UNION ALL ".join([*(f"SELECT event_type, event_id, k, CAST(NULL AS DOUBLE) AS total, CAST(NULL AS BIGINT) AS line FROM {ev(x)}" for x in kinds), f"SELECT event_type, event_id, NULL, total, NULL FROM {orders}", f"SELECT event_type, event_id, NULL, NULL, line FROM {items}"])),
    }
