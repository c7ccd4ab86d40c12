"""Event types: strict schemas in a registry kept as JSON."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import types as T

from .errors import CommandError
from .functions.times import normalize
from .storage import Store

CORE = ("context_id", "event_type", "timestamp", "event_id")
CORE_FIELDS = [T.StructField("context_id", T.StringType()), T.StructField("event_type", T.StringType()), T.StructField("timestamp", T.LongType()), T.StructField("event_id", T.LongType())]
MAX_VARIANTS = 256

#: Names of types. Any other name is a string.
NAMES = {
    "string": "string", "str": "string", "text": "string", "varchar": "string",
    "u64": "u64", "uint64": "u64",
    "i64": "i64", "int64": "i64", "int": "i64", "integer": "i64",
    "f64": "f64", "float": "f64", "double": "f64", "number": "f64",
    "bool": "bool", "boolean": "bool",
    "datetime": "datetime", "timestamp": "datetime",
    "date": "date",
}
SPARK = {"string": T.StringType(), "enum": T.StringType(), "u64": T.LongType(), "i64": T.LongType(), "f64": T.DoubleType(), "bool": T.BooleanType(), "datetime": T.LongType(), "date": T.LongType()}
TIMES = ("datetime", "date")
NUMBERS = ("u64", "i64", "f64")

_TYPE_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9_]{0,99}")


@dataclass(frozen=True)
class FieldType:
    kind: str
    optional: bool = False
    variants: tuple[str, ...] = ()

    @classmethod
    def of(cls, given: Any) -> FieldType:
        if isinstance(given, FieldType):
            return given
        if isinstance(given, (list, tuple)):
            if not given or len(given) > MAX_VARIANTS or len(set(given)) < len(given) or not all(isinstance(v, str) and v for v in given):
                raise CommandError(f"an enum takes 1 to {MAX_VARIANTS} different non-empty strings")
            return cls("enum", variants=tuple(given))
        if not isinstance(given, str):
            raise CommandError(f"not a type: {given!r}")
        parts = [p.strip().lower() for p in given.split("|")]
        kinds = [p for p in parts if p != "null"]
        return cls(NAMES.get(kinds[0], "string") if len(kinds) == 1 else "string", "null" in parts)

    @property
    def spark(self) -> T.DataType:
        return SPARK[self.kind]

    def check(self, name: str, value: Any) -> Any:
        """The value as it is stored."""
        if value is None:
            if not self.optional:
                raise CommandError(f"field {name} must not be null")
            return None
        whole = isinstance(value, int) and not isinstance(value, bool)
        fits = {
            "string": isinstance(value, str), "enum": isinstance(value, str), "bool": isinstance(value, bool),
            "u64": whole and value >= 0, "i64": whole, "f64": whole or isinstance(value, float),
            "datetime": whole or isinstance(value, (float, str)), "date": whole or isinstance(value, (float, str)),
        }[self.kind]
        if not fits:
            raise CommandError(f"field {name} takes {self.kind}, not {value!r}")
        if self.kind == "enum" and value not in self.variants:
            raise CommandError(f"field {name} takes one of {', '.join(self.variants)}")
        if self.kind in ("u64", "i64") and not -(1 << 63) <= value < 1 << 63:
            raise CommandError(f"field {name} is beyond 64 bits with sign")
        return normalize(value) if self.kind in TIMES else float(value) if self.kind == "f64" else value

    def plain(self) -> Any:
        return list(self.variants) if self.kind == "enum" else self.kind + " | null" * self.optional


@dataclass(frozen=True)
class EventSchema:
    event_type: str
    fields: dict[str, FieldType]
    version: int = 1

    def struct(self) -> T.StructType:
        """Core columns, then the payload's; a payload field named as a core column is that column."""
        return T.StructType(CORE_FIELDS + [T.StructField(n, f.spark) for n, f in self.fields.items() if n not in CORE])

    def kind(self, name: str) -> str | None:
        if name in CORE:
            return "string" if name in ("context_id", "event_type") else "datetime" if name == "timestamp" else "u64"
        return self.fields[name].kind if name in self.fields else None

    def checked(self, payload: dict[str, Any]) -> dict[str, Any]:
        extra = [n for n in payload if n not in self.fields]
        if extra:
            raise CommandError(f"fields not in the schema: {', '.join(sorted(extra))}")
        missing = [n for n, f in self.fields.items() if n not in payload and not f.optional]
        if missing:
            raise CommandError(f"missing fields: {', '.join(missing)}")
        return {n: f.check(n, payload.get(n)) for n, f in self.fields.items()}


class SchemaRegistry:
    """Schemas by event type; with a store, kept there as JSON."""

    NAME = "schemas.json"

    def __init__(self, store: Store | None = None):
        self.store, self.schemas = store, {}
        held = store.read(self.NAME) if store else None
        for x in json.loads(held or "[]"):
            self.schemas[x["event_type"]] = EventSchema(x["event_type"], {n: FieldType.of(t) for n, t in x["fields"].items()}, x["version"])

    def define(self, event_type: str, fields: dict[str, Any], version: int | None = None) -> EventSchema:
        if not _TYPE_NAME.fullmatch(event_type):
            raise CommandError(f"not a name of an event type: {event_type!r}")
        if event_type in self.schemas:
            raise CommandError(f"{event_type} is already defined", 409)
        if not fields:
            raise CommandError("a schema needs a field")
        schema = EventSchema(event_type, {n: FieldType.of(t) for n, t in fields.items()}, version or 1)
        self.schemas[event_type] = schema
        if self.store:
            self.store.write(self.NAME, json.dumps([{"event_type": s.event_type, "version": s.version, "fields": {n: f.plain() for n, f in s.fields.items()}} for s in self.schemas.values()]))
        return schema

    def get(self, event_type: str) -> EventSchema:
        if event_type not in self.schemas:
            raise CommandError(f"no schema for {event_type}", 404)
        return self.schemas[event_type]
