"""Commands as JSON objects."""

from __future__ import annotations

import json
from typing import Any

from . import ast
from .errors import CommandError

#: Names of comparisons.
OPS = {"eq": "=", "=": "=", "neq": "!=", "ne": "!=", "!=": "!=", "gt": ">", ">": ">", "gte": ">=", ">=": ">=", "lt": "<", "<": "<", "lte": "<=", "<=": "<="}


def expr_of(x: dict[str, Any]) -> ast.Expr:
    """{"and": [..]}, {"or": [..]}, {"not": ..}, {"field", "op", "value"} or {"field", "in": [..]}."""
    if not isinstance(x, dict):
        raise CommandError("a condition is an object")
    for word, node in (("and", ast.And), ("or", ast.Or)):
        if word in x:
            parts = [expr_of(p) for p in x[word]]
            if not parts:
                raise CommandError(f"{word} needs a condition")
            out = parts[-1]
            for p in reversed(parts[:-1]):
                out = node(p, out)
            return out
    if "not" in x:
        return ast.Not(expr_of(x["not"]))
    if "in" in x:
        return ast.In(x["field"], tuple(x["in"]))
    if x.get("op", "").lower() not in OPS:
        raise CommandError(f"unknown comparison: {x.get('op')!r}")
    return ast.Compare(x["field"], OPS[x["op"].lower()], x["value"])


def command_of(x: dict[str, Any]):
    kind = str(x.get("type", "")).lower()
    if kind == "define":
        return ast.Define(x["event_type"], x["schema"].get("fields", x["schema"]), x.get("version"))
    if kind == "store":
        return ast.Store(x["event_type"], x["context_id"], {k: json.dumps(v) if isinstance(v, (dict, list)) else v for k, v in x["payload"].items()})
    if kind == "query":
        where, order = x.get("where", x.get("where_clause")), x.get("order_by")
        return ast.Query(x["event_type"], x.get("context_id"), x.get("since"), x.get("time_field"), where=expr_of(where) if where else None, limit=x.get("limit"), offset=x.get("offset"), order=ast.Order(order["field"], bool(order.get("desc"))) if order else None)
    if kind == "replay":
        return ast.Replay(x["context_id"], x.get("event_type"), x.get("since"), x.get("time_field"))
    if kind in ("ping", "flush"):
        return ast.Ping() if kind == "ping" else ast.Flush()
    if kind == "batch":
        return ast.Batch(tuple(command_of(c) for c in x["commands"]))
    raise CommandError(f"unknown command: {kind!r}")
