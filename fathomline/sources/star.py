"""The tables of a star schema and of a click stream as event types."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog

KINDS = ("click", "error", "purchase", "signup", "view")


def seconds(frame: DataFrame, column: str) -> Column:
    """Epoch seconds of a timestamp column; of one without time zone, as UTC."""
    if dict(frame.dtypes)[column] == "timestamp_ntz":
        return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")
    return F.unix_seconds(F.col(column))


def star_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """click, error, purchase, signup, view from events; order_placed from orders; item_shipped from lineitem."""
    out = Catalog(spark)
    read = functools.cache(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

    def clicks(kind: str) -> DataFrame:
        events = read("events")
        return events.where(F.col("event_type") == kind).select(
            F.col("user_id").cast("string").alias("context_id"), "event_type", seconds(events, "ts").alias("timestamp"), "event_id",
            "user_id", "value", F.get_json_object("props", "$.k").cast("long").alias("k"), (F.col("event_id") % 2 == 0).alias("even"),
        )

    def placed() -> DataFrame:
        at = seconds(read("orders"), "o_orderdate")
        return read("orders").select(
            F.col("o_custkey").cast("string").alias("context_id"), F.lit("order_placed").alias("event_type"), at.alias("timestamp"), F.col("o_orderkey").alias("event_id"),
            F.col("o_orderkey").alias("order_key"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("customer"), at.alias("placed_at"),
        )

    def shipped() -> DataFrame:
        at = seconds(read("lineitem"), "l_shipdate")
        return read("lineitem").select(
            F.col("l_orderkey").cast("string").alias("context_id"), F.lit("item_shipped").alias("event_type"), at.alias("timestamp"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("event_id"),
            F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus"), at.alias("shipped_at"),
        )

    for kind in KINDS:
        out.register(kind, functools.partial(clicks, kind), {"user_id": "int", "value": "float | null", "k": "int | null", "even": "bool"})
    out.register("order_placed", placed, {"order_key": "int", "status": "string", "total": "float", "priority": "string", "customer": "int", "placed_at": "datetime"})
    out.register("item_shipped", shipped, {"order_key": "int", "line": "int", "quantity": "float", "price": "float", "discount": "float", "returnflag": "string", "linestatus": "string", "shipped_at": "datetime"})
    return out
