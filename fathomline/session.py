"""The engine: commands as text, JSON or AST against a log of events."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from . import ast
from .access import Access
from .errors import CommandError
from .json_commands import command_of
from .operators.aggregate import BucketOptions
from .operators.materialize import Materializations
from .parser import parse
from .plans.planner import plan
from .sources.catalog import EventLog


class Engine:
    """Events, schemas, users and remembered results under one folder. `user` (None: no check) is who gives a command. slice_seconds: see operators.sequence; distinct: see Catalog."""

    def __init__(self, spark: SparkSession, root: str, options: BucketOptions = BucketOptions(), compat: bool = False, slice_seconds: int | None = None, distinct: bool = False):
        self.log = EventLog(spark, root, distinct=distinct)
        self.access = Access(self.log.store_files)
        self.materialized = Materializations(self.log, self.log.store_files, options, compat, slice_seconds)
        self.options, self.compat, self.slice_seconds = options, compat, slice_seconds

    def execute(self, command: str | dict | Any, user: str | None = None) -> DataFrame | list | str:
        """Queries give a lazy frame, BATCH a list, other commands a message."""
        text = command if isinstance(command, str) else None
        c = parse(command) if text is not None else command_of(command) if isinstance(command, dict) else command
        if isinstance(c, (ast.Query, ast.CompareQueries, ast.Replay)):
            return self.rows(c, user)
        if isinstance(c, ast.Define):
            self.access.need_admin(user)
            self.log.registry.define(c.event_type, c.fields, c.version)
            return f"{c.event_type} defined"
        if isinstance(c, ast.Store):
            self.access.need(user, "write", c.event_type)
            self.log.append(c.event_type, c.context_id, c.payload)
            return "Event accepted for storage"
        if isinstance(c, ast.Remember):
            self.read(user, c.query)
            self.log.flush()
            said = re.sub(r"^\s*REMEMBER\s+|\s+AS\s+[\w-]+\s*$", "", text, flags=re.I) if text else type(c.query).__name__
            entry = self.materialized.remember(c.name, c.query, said)
            return f"{c.name}: {sum(p['rows'] for p in entry['parts'])} rows"
        if isinstance(c, ast.Show):
            q = ast.from_json(self.materialized._entry(c.name)["ast"])
            self.read(user, q)
            self.log.flush()
            return self.materialized.show(c.name, q)
        if isinstance(c, ast.Flush):
            return f"{self.log.flush()} events written"
        if isinstance(c, ast.Ping):
            return "PONG"
        if isinstance(c, ast.Batch):
            return [self.execute(x, user) for x in c.commands]
        return self.manage(c, user)

    def read(self, user: str | None, c: ast.Query | ast.CompareQueries | ast.Replay) -> None:
        if isinstance(c, ast.CompareQueries):
            types = [s.event_type for s in c.sides]
        elif isinstance(c, ast.Replay):
            types = [c.event_type] if c.event_type else sorted(self.log.registry.schemas)
        else:
            types = [c.event_type, *(x.event_type for x in c.links)]
        for t in types:
            self.access.need(user, "read", t)

    def rows(self, c: ast.Query | ast.CompareQueries | ast.Replay, user: str | None) -> DataFrame:
        self.read(user, c)
        return plan(c, self.log, self.options, self.compat, self.slice_seconds)

    def manage(self, c: Any, user: str | None):
        self.access.need_admin(user)
        if isinstance(c, ast.CreateUser):
            return self.access.create(c.user, c.key, c.roles)
        if isinstance(c, ast.RevokeKey):
            self.access.revoke_key(c.user)
            return f"key of {c.user} revoked"
        if isinstance(c, ast.ListUsers):
            return [f"{n}: {'active' if u['active'] else 'inactive'}" for n, u in sorted(self.access.users.items())]
        if isinstance(c, (ast.Grant, ast.Revoke)):
            for t in c.event_types:
                self.log.schema(t)
            self.access.grant(c.user, c.event_types, c.permissions, isinstance(c, ast.Grant))
            return "done"
        if isinstance(c, ast.ShowPermissions):
            return [f"{t}: {', '.join(p for p in ('read', 'write') if e[p]) or 'none'}" for t, e in sorted(self.access.user(c.user)["grants"].items())]
        raise CommandError(f"not a command: {c!r}")
