"""One query for each operator of the engine, with the same in plain SQL for the tables of a star schema."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import stored_queries
from .operators.aggregate import BucketOptions
from .parser import parse
from .plans.planner import plan
from .sources.star import star_catalog

EV = """(SELECT CAST(user_id AS VARCHAR) AS context_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS timestamp, event_id, user_id, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id % 2 = 0 AS even FROM events WHERE event_type = '{}')"""
ORDERS = """(SELECT CAST(o_custkey AS VARCHAR) AS context_id, 'order_placed' AS event_type, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS timestamp, o_orderkey AS event_id, o_orderkey AS order_key, o_orderstatus AS status, o_totalprice AS total, o_orderpriority AS priority, o_custkey AS customer, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS placed_at FROM orders)"""
ITEMS = """(SELECT CAST(l_orderkey AS VARCHAR) AS context_id, 'item_shipped' AS event_type, CAST(floor(epoch(l_shipdate)) AS BIGINT) AS timestamp, l_orderkey * 8 + l_linenumber AS event_id, l_orderkey AS order_key, CAST(l_linenumber AS BIGINT) AS line, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_returnflag AS returnflag, l_linestatus AS linestatus, CAST(floor(epoch(l_shipdate)) AS BIGINT) AS shipped_at FROM lineitem)"""


def ev(kind: str) -> str:
    return EV.format(kind)


def bucket(unit: str, column: str = "timestamp") -> str:
    return f"CAST(epoch(date_trunc('{unit}', make_timestamp({column} * 1000000))) AS BIGINT)"


CORE = "context_id, event_type, timestamp, event_id"
ALL = f"{CORE}, user_id, value, k, even"

#: name: (command, SQL)
TEXT: dict[str, tuple[str, str]] = {
    "select_eq": ("QUERY view WHERE k = 7", f"SELECT {ALL} FROM {ev('view')} WHERE k = 7"),
    "select_neq": ("QUERY view WHERE k != 7", f"SELECT {ALL} FROM {ev('view')} WHERE k <> 7"),
    "select_range": ("QUERY purchase WHERE value >= 10 AND value < 25.5 AND k > -1", f"SELECT {ALL} FROM {ev('purchase')} WHERE value >= 10 AND value < 25.5 AND k > -1"),
    "select_in": ("QUERY click WHERE k IN (1, 2, 3, 50)", f"SELECT {ALL} FROM {ev('click')} WHERE k IN (1, 2, 3, 50)"),
    "select_in_string": ('QUERY order_placed WHERE status IN ("F", "P") RETURN [status, total]', f"SELECT {CORE}, status, total FROM {ORDERS} WHERE status IN ('F', 'P')"),
    "select_in_empty": ("QUERY click WHERE k IN ()", f"SELECT {ALL} FROM {ev('click')} WHERE false"),
    "select_and_or_not": ("QUERY purchase WHERE (k = 1 OR k = 2) AND NOT value > 50 OR user_id = 3", f"SELECT {ALL} FROM {ev('purchase')} WHERE ((k = 1 OR k = 2) AND NOT value > 50) OR user_id = 3"),
    "select_not_null_logic": ("QUERY purchase WHERE NOT k = 1", f"SELECT {ALL} FROM {ev('purchase')} WHERE NOT coalesce(k = 1, false)"),
    "select_bare_bool": ("QUERY view WHERE even", f"SELECT {ALL} FROM {ev('view')} WHERE even"),
    "select_string_order": ('QUERY order_placed WHERE status > "A" OR order_key = 1', f"SELECT * FROM {ORDERS} WHERE order_key = 1"),
    "select_since": ('QUERY view SINCE "2024-01-15" RETURN [value]', f"SELECT {CORE}, value FROM {ev('view')} WHERE timestamp >= 1705276800"),
    "select_since_using": ('QUERY item_shipped SINCE "1997-06-01T00:00:00Z" USING shipped_at WHERE returnflag = "R" RETURN [price]', f"SELECT {CORE}, price FROM {ITEMS} WHERE shipped_at >= 865123200 AND returnflag = 'R'"),
    "select_temporal_literal": ('QUERY order_placed WHERE placed_at >= "1998-01-01" AND placed_at < "1998-02-01" RETURN [placed_at]', f"SELECT {CORE}, placed_at FROM {ORDERS} WHERE placed_at >= 883612800 AND placed_at < 886291200"),
    "select_for_context": ('QUERY purchase FOR "17"', f"SELECT {ALL} FROM {ev('purchase')} WHERE context_id = '17'"),
    "select_return": ("QUERY click RETURN [value, nothing, user_id]", f"SELECT {CORE}, value, user_id FROM {ev('click')}"),
    "order_limit": ("QUERY purchase ORDER BY event_id LIMIT 25", f"SELECT {ALL} FROM {ev('purchase')} ORDER BY event_id LIMIT 25"),
    "order_desc_offset": ("QUERY order_placed ORDER BY event_id DESC OFFSET 40 LIMIT 60", f"SELECT * FROM {ORDERS} ORDER BY event_id DESC LIMIT 60 OFFSET 40"),
    "order_payload": ("QUERY order_placed ORDER BY total DESC LIMIT 50", f"SELECT * FROM {ORDERS} ORDER BY total DESC, event_id LIMIT 50"),
    "count_all": ("QUERY view COUNT", f"SELECT count(*) AS count FROM {ev('view')}"),
    "count_none": ("QUERY view WHERE k = -5 COUNT", f"SELECT count(*) AS count FROM {ev('view')} WHERE k = -5 HAVING count(*) > 0"),
    "count_field": ("QUERY view COUNT k", f"SELECT count(k) AS count_k FROM {ev('view')}"),
    "count_unique": ("QUERY view COUNT UNIQUE user_id BY even", f"SELECT CAST(even AS VARCHAR) AS even, count(DISTINCT coalesce(CAST(user_id AS VARCHAR), '')) AS count_unique_user_id FROM {ev('view')} GROUP BY 1"),
    "count_unique_missing": ("QUERY view COUNT UNIQUE nothing", "SELECT CAST(1 AS BIGINT) AS count_unique_nothing"),
    "total": ("QUERY purchase TOTAL k BY even", f"SELECT CAST(even AS VARCHAR) AS even, CAST(sum(k) AS BIGINT) AS total_k FROM {ev('purchase')} GROUP BY 1"),
    "avg": ("QUERY purchase AVG k BY user_id", f"SELECT CAST(user_id AS VARCHAR) AS user_id, avg(k) AS avg_k FROM {ev('purchase')} GROUP BY 1"),
    "min_max": ("QUERY purchase MIN value, MAX value, MIN k, MAX k BY user_id", f"SELECT CAST(user_id AS VARCHAR) AS user_id, min(value) AS min_value, max(value) AS max_value, min(k) AS min_k, max(k) AS max_k FROM {ev('purchase')} GROUP BY 1"),
    "min_max_text": ("QUERY order_placed MIN priority, MAX priority BY status", f"SELECT status, min(priority) AS min_priority, max(priority) AS max_priority FROM {ORDERS} GROUP BY 1"),
    "multi_metric": ("QUERY item_shipped COUNT, TOTAL line, AVG line, COUNT UNIQUE order_key BY returnflag", f"SELECT returnflag, count(*) AS count, CAST(sum(line) AS BIGINT) AS total_line, avg(line) AS avg_line, count(DISTINCT order_key) AS count_unique_order_key FROM {ITEMS} GROUP BY 1"),
    "group_by_one": ("QUERY order_placed COUNT BY priority", f"SELECT priority, count(*) AS count FROM {ORDERS} GROUP BY 1"),
    "group_by_two": ("QUERY item_shipped COUNT BY returnflag, linestatus", f"SELECT returnflag, linestatus, count(*) AS count FROM {ITEMS} GROUP BY 1, 2"),
    "group_drop_empty": ("QUERY purchase COUNT BY k", f"SELECT CAST(k AS VARCHAR) AS k, count(*) AS count FROM {ev('purchase')} WHERE k IS NOT NULL GROUP BY 1"),
    "per_hour": ("QUERY view COUNT PER HOUR", f"SELECT {bucket('hour')} AS bucket, count(*) AS count FROM {ev('view')} GROUP BY 1"),
    "per_day": ("QUERY view COUNT, TOTAL k PER DAY BY even", f"SELECT {bucket('day')} AS bucket, CAST(even AS VARCHAR) AS even, count(*) AS count, CAST(sum(k) AS BIGINT) AS total_k FROM {ev('view')} GROUP BY 1, 2"),
    "per_week": ("QUERY order_placed COUNT PER WEEK USING placed_at", f"SELECT {bucket('week', 'placed_at')} AS bucket, count(*) AS count FROM {ORDERS} GROUP BY 1"),
    "per_month": ("QUERY item_shipped COUNT PER MONTH USING shipped_at BY returnflag", f"SELECT {bucket('month', 'shipped_at')} AS bucket, returnflag, count(*) AS count FROM {ITEMS} GROUP BY 1, 2"),
    "per_year": ("QUERY order_placed COUNT UNIQUE customer PER YEAR", f"SELECT {bucket('year')} AS bucket, count(DISTINCT customer) AS count_unique_customer FROM {ORDERS} GROUP BY 1"),
    "agg_order_metric": ("QUERY order_placed COUNT BY customer ORDER BY count DESC LIMIT 20", f"SELECT CAST(customer AS VARCHAR) AS customer, count(*) AS count FROM {ORDERS} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"),
    "agg_limit_offset": ("QUERY order_placed COUNT BY customer LIMIT 30 OFFSET 15", f"SELECT CAST(customer AS VARCHAR) AS customer, count(*) AS count FROM {ORDERS} GROUP BY 1 ORDER BY 1 LIMIT 30 OFFSET 15"),
    "agg_filter_since": ('QUERY view FOR "5" SINCE "2024-01-10" WHERE value > 5 COUNT PER DAY', f"SELECT {bucket('day')} AS bucket, count(*) AS count FROM {ev('view')} WHERE context_id = '5' AND timestamp >= 1704844800 AND value > 5 GROUP BY 1"),
    "plot_breakdown": ("PLOT unique(order_key) OF item_shipped BREAKDOWN BY returnflag, linestatus", f"SELECT returnflag, linestatus, count(DISTINCT order_key) AS count_unique_order_key FROM {ITEMS} GROUP BY 1, 2"),
    "plot_over_day": ("PLOT sum(k) OF view OVER day(timestamp) FILTER even FILTER k > 10", f"SELECT {bucket('day')} AS bucket, CAST(sum(k) AS BIGINT) AS total_k FROM {ev('view')} WHERE even AND k > 10 GROUP BY 1"),
    "plot_top_n": ("PLOT count OF order_placed BREAKDOWN BY customer TOP 10 BY max(order_key)", f"SELECT CAST(customer AS VARCHAR) AS customer, count(*) AS count, max(order_key) AS max_order_key FROM {ORDERS} GROUP BY 1 ORDER BY 3 DESC LIMIT 10"),
    "compare_two": ("PLOT total(k) OF purchase VS total(k) OF view BREAKDOWN BY user_id", f"SELECT coalesce(a.g, b.g) AS user_id, a.v AS purchase_total_k, b.v AS view_total_k FROM (SELECT CAST(user_id AS VARCHAR) AS g, CAST(coalesce(sum(k), 0) AS BIGINT) AS v FROM {ev('purchase')} GROUP BY 1) a FULL JOIN (SELECT CAST(user_id AS VARCHAR) AS g, CAST(coalesce(sum(k), 0) AS BIGINT) AS v FROM {ev('view')} GROUP BY 1) b ON a.g = b.g"),
    "compare_three": ("PLOT count OF click VS count OF view VS count OF error", f"SELECT (SELECT count(*) FROM {ev('click')}) AS click_count, (SELECT count(*) FROM {ev('view')}) AS view_count, (SELECT count(*) FROM {ev('error')}) AS error_count"),
    "compare_same_type": ("PLOT avg(k) OF view FILTER even VS avg(k) OF view FILTER NOT even BREAKDOWN BY user_id", f"SELECT coalesce(a.g, b.g) AS user_id, a.v AS view_avg_k, b.v AS right_avg_k FROM (SELECT CAST(user_id AS VARCHAR) AS g, coalesce(avg(k), 0) AS v FROM {ev('view')} WHERE even GROUP BY 1) a FULL JOIN (SELECT CAST(user_id AS VARCHAR) AS g, coalesce(avg(k), 0) AS v FROM {ev('view')} WHERE NOT even GROUP BY 1) b ON a.g = b.g"),
    "compare_per_side_filter": ("PLOT unique(user_id) OF purchase FILTER value > 90 VS unique(user_id) OF view FILTER k < 5 BREAKDOWN BY even", f"SELECT coalesce(a.g, b.g) AS even, a.v AS purchase_count_unique_user_id, b.v AS view_count_unique_user_id FROM (SELECT CAST(even AS VARCHAR) AS g, count(DISTINCT user_id) AS v FROM {ev('purchase')} WHERE value > 90 GROUP BY 1) a FULL JOIN (SELECT CAST(even AS VARCHAR) AS g, count(DISTINCT user_id) AS v FROM {ev('view')} WHERE k < 5 GROUP BY 1) b ON a.g = b.g"),
    "compare_bucket_breakdown": ("PLOT count OF purchase VS count OF view BREAKDOWN BY even OVER week(timestamp)", f"SELECT coalesce(a.t, b.t) AS bucket, coalesce(a.g, b.g) AS even, a.v AS purchase_count, b.v AS view_count FROM (SELECT {bucket('week')} AS t, CAST(even AS VARCHAR) AS g, count(*) AS v FROM {ev('purchase')} GROUP BY 1, 2) a FULL JOIN (SELECT {bucket('week')} AS t, CAST(even AS VARCHAR) AS g, count(*) AS v FROM {ev('view')} GROUP BY 1, 2) b ON a.g = b.g AND a.t = b.t"),
    "replay_type": ('REPLAY purchase FOR "17" SINCE "2024-01-05" RETURN [value]', f"SELECT {CORE}, value FROM {ev('purchase')} WHERE context_id = '17' AND timestamp >= 1704412800"),
    "replay_context": ('REPLAY FOR "17" RETURN [value, total]', " UNION ALL ".join([f"SELECT {CORE}, value, CAST(NULL AS DOUBLE) AS total FROM {ev(k)} WHERE context_id = '17'" for k in ("click", "error", "purchase", "signup", "view")] + [f"SELECT {CORE}, CAST(NULL AS DOUBLE), total FROM {ORDERS} WHERE context_id = '17'", f"SELECT {CORE}, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM {ITEMS} WHERE context_id = '17'"])),
}


def _nearest(a: str, b: str, key: str, followed: bool, where_a: str = "true", where_b: str = "true", gate: str = "true", at: str = "timestamp", payload: tuple[tuple[str, str, str], ...] = ()) -> str:
    """All matches, by SQL windows. payload: columns besides, each with its expression in a and in b."""
    order = f"{at} DESC, is_b DESC, event_id DESC" if followed else f"{at}, is_b, event_id"
    more_a, more_b, more = ("".join(f", {x[k]}" if k == 0 else f", {x[k]} AS {x[0]}" for x in payload) for k in (1, 2, 0))
    held = "".join(f", '{x[0]}': {x[0]}" for x in payload)
    return f"""WITH u AS (
      SELECT {key} AS link, timestamp, 0 AS is_b, event_id, context_id, event_type{more_a} FROM {a} WHERE {where_a}
      UNION ALL SELECT {key}, timestamp, 1, event_id, context_id, event_type{more_b} FROM {b} WHERE {where_b}
    ), w AS (
      SELECT *, last_value(CASE WHEN is_b = 1 THEN {{'timestamp': timestamp, 'event_id': event_id, 'context_id': context_id, 'event_type': event_type{held}}} END IGNORE NULLS)
        OVER (PARTITION BY link ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS near,
        min(CASE WHEN is_b = 1 THEN timestamp END) OVER (PARTITION BY link) AS first_b, min(CASE WHEN is_b = 0 THEN timestamp END) OVER (PARTITION BY link) AS first_a,
        min(timestamp) OVER (PARTITION BY link) AS first_ts FROM u
    ), m AS (SELECT * FROM w WHERE is_b = 0 AND near IS NOT NULL AND {gate})"""


def _events(followed: bool, source: str = "m", payload: tuple[tuple[str, str, str], ...] = ()) -> str:
    """Two rows for each match."""
    a, b = (0, 1) if followed else (1, 0)
    mine, other = ("".join(f", {side}{x[0]}" for x in payload) for side in ("", "near."))
    return f"""SELECT context_id, event_type, timestamp, event_id, event_id AS match, {a} AS place{mine} FROM {source}
    UNION ALL SELECT near.context_id, near.event_type, near.timestamp, near.event_id, event_id, {b}{other} FROM {source}"""


def _sequence(command: str, a: str, b: str, key: str, followed: bool, **more: str) -> tuple[str, str]:
    return f"{command} RETURN [event_id]", f"{_nearest(a, b, key, followed, **more)} {_events(followed)}"


def _whole_sequence(command: str, a: str, b: str, key: str, followed: bool, payload: tuple[tuple[str, str, str], ...], **more: str) -> tuple[str, str]:
    return command, f"{_nearest(a, b, key, followed, payload=payload, **more)} {_events(followed, payload=payload)}"


CLICK = tuple((c, c, c) for c in ("user_id", "value", "k", "even"))
ORDER_ITEM = (("order_key",) * 3, ("status", "status", "NULL"), ("total", "total", "NULL"), ("line", "NULL", "line"))

TEXT |= {
    "seq_followed": _sequence("QUERY view FOLLOWED BY purchase LINKED BY user_id", ev("view"), ev("purchase"), "user_id", True),
    "seq_followed_where_a": _sequence("QUERY view FOLLOWED BY purchase LINKED BY user_id WHERE view.k > 50", ev("view"), ev("purchase"), "user_id", True, where_a="k > 50"),
    "seq_followed_where_both": _sequence("QUERY view FOLLOWED BY purchase LINKED BY user_id WHERE view.k > 50 AND purchase.value > 20", ev("view"), ev("purchase"), "user_id", True, where_a="k > 50", where_b="value > 20"),
    "seq_followed_wide": _sequence("QUERY order_placed FOLLOWED BY item_shipped LINKED BY order_key USING TIME timestamp", ORDERS, ITEMS, "order_key", True),
    "seq_preceded": _sequence("QUERY purchase PRECEDED BY view LINKED BY user_id", ev("purchase"), ev("view"), "user_id", False),
    "seq_followed_payload": _whole_sequence("QUERY view FOLLOWED BY purchase LINKED BY user_id", ev("view"), ev("purchase"), "user_id", True, CLICK),
    "seq_preceded_payload": _whole_sequence("QUERY purchase PRECEDED BY view LINKED BY user_id WHERE view.k > 20", ev("purchase"), ev("view"), "user_id", False, CLICK, where_b="k > 20"),
    "seq_payload_of_one_type": _whole_sequence("QUERY order_placed FOLLOWED BY item_shipped LINKED BY order_key RETURN [order_key, status, total, line]", ORDERS, ITEMS, "order_key", True, ORDER_ITEM),
    "seq_using_time": _sequence("QUERY view FOLLOWED BY purchase LINKED BY user_id USING TIME k", ev("view"), ev("purchase"), "user_id", True, at="k", payload=(("k", "k", "k"),)),
    "seq_preceded_compat": _sequence("QUERY purchase PRECEDED BY view LINKED BY user_id", ev("purchase"), ev("view"), "user_id", False, gate="first_b < first_a"),
    "seq_limit": (
        "QUERY view FOLLOWED BY purchase LINKED BY user_id LIMIT 40 OFFSET 5 RETURN [event_id]",
        _nearest(ev("view"), ev("purchase"), "user_id", True) + ", n AS (SELECT * FROM m ORDER BY first_ts, CAST(link AS VARCHAR), timestamp, event_id LIMIT 40 OFFSET 5) " + _events(True, "n"),
    ),
}


def run_text(spark: SparkSession, sf_dir: str, command: str, options: BucketOptions = BucketOptions(), compat: bool = False, slice_seconds: int | None = None) -> DataFrame:
    out = plan(parse(command), star_catalog(spark, sf_dir), options, compat, slice_seconds)
    return out.toDF(*(c.replace(".", "_") for c in out.columns))


def wildcard_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All types' events: how many of each, and their times."""
    from pyspark.sql import functions as F

    return star_catalog(spark, sf_dir).wildcard().groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


def distinct_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source that gives every event twice, each taken once."""
    from .sources.catalog import distinct_events

    frame = star_catalog(spark, sf_dir).frame("view")
    return distinct_events(frame.unionByName(frame))


def json_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query given as a JSON object."""
    from .json_commands import command_of

    x = {"type": "Query", "event_type": "purchase", "where": {"and": [{"field": "k", "op": "gte", "value": 10}, {"not": {"field": "user_id", "in": [1, 2, 3]}}]}, "order_by": {"field": "event_id", "desc": True}, "limit": 30}
    return plan(command_of(x), star_catalog(spark, sf_dir))


def _naive(unit: str, seconds: int) -> tuple[Callable, str]:
    return functools.partial(run_text, command=f"QUERY order_placed COUNT PER {unit}", options=BucketOptions(naive=True)), f"SELECT timestamp - timestamp % {seconds} AS bucket, count(*) AS count FROM {ORDERS} GROUP BY 1"


OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "per_naive_week": _naive("WEEK", 604800),
    "per_naive_month": _naive("MONTH", 2592000),
    "per_week_sunday": (functools.partial(run_text, command="QUERY view COUNT PER WEEK", options=BucketOptions(week_start="sun")), f"SELECT CAST(epoch(date_trunc('day', make_timestamp(timestamp * 1000000)) - to_days(CAST(dayofweek(make_timestamp(timestamp * 1000000)) AS INTEGER))) AS BIGINT) AS bucket, count(*) AS count FROM {ev('view')} GROUP BY 1"),
    "wildcard_scan": (wildcard_scan, "SELECT event_type, count(*) AS n, min(timestamp) AS first, max(timestamp) AS last FROM (" + " UNION ALL ".join([f"SELECT event_type, timestamp FROM {ev(k)}" for k in ("click", "error", "purchase", "signup", "view")] + [f"SELECT event_type, timestamp FROM {ORDERS}", f"SELECT event_type, timestamp FROM {ITEMS}"]) + ") GROUP BY 1"),
    "distinct_by_id": (distinct_by_id, f"SELECT {ALL} FROM {ev('view')}"),
    "show_after_delta": (functools.partial(stored_queries.shown, command="QUERY purchase WHERE value > 20", event_type="purchase", first="timestamp < 1705276800"), f"SELECT {ALL} FROM {ev('purchase')} WHERE value > 20"),
    "seq_followed_sliced": (functools.partial(run_text, command=TEXT["seq_followed"][0], slice_seconds=86_400), TEXT["seq_followed"][1]),
    "seq_preceded_sliced": (functools.partial(run_text, command=TEXT["seq_preceded"][0], slice_seconds=20_000), TEXT["seq_preceded"][1]),
    "json_query": (json_query, f"SELECT {ALL} FROM {ev('purchase')} WHERE k >= 10 AND NOT user_id IN (1, 2, 3) ORDER BY event_id DESC LIMIT 30"),
} | stored_queries.queries(ev, ORDERS, ITEMS, CORE, ALL)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: functools.partial(run_text, command=command, compat=name.endswith("_compat")) for name, (command, _) in TEXT.items()} | {name: f for name, (f, _) in OTHERS.items()}
SQL: dict[str, str] = {name: sql for name, (_, sql) in TEXT.items()} | {name: sql for name, (_, sql) in OTHERS.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["group_by_one"](spark, sf_dir)
