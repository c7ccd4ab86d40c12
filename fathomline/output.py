"""Results as JSON frames, Arrow streams or text. Only these collect, and they do so in batches."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

#: Names of column types in a schema frame.
TYPES = {"string": "String", "bigint": "Integer", "int": "Integer", "double": "Float", "boolean": "Boolean", "timestamp": "Timestamp"}


def json_frames(frame: DataFrame, batch: int = 1000) -> Iterator[str]:
    """A schema frame, frames of rows, and an end frame with the number of rows."""
    yield json.dumps({"type": "schema", "columns": [{"name": n, "logical_type": TYPES.get(t, "JSON")} for n, t in frame.dtypes]})
    rows: list[list[Any]] = []
    n = 0
    for row in frame.toLocalIterator():
        rows.append([x if isinstance(x, (int, float, str, bool, type(None))) else str(x) for x in row])
        if len(rows) == batch:
            yield json.dumps({"type": "batch", "rows": rows})
            n, rows = n + len(rows), []
    if rows:
        yield json.dumps({"type": "batch", "rows": rows})
    yield json.dumps({"type": "end", "row_count": n + len(rows)})


def arrow_stream(frame: DataFrame) -> bytes:
    """An Arrow IPC stream of the whole result."""
    table = frame.toArrow()
    out = io.BytesIO()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue()


def lines(frame: DataFrame) -> Iterator[str]:
    """Tab-separated lines, names first."""
    yield "\t".join(frame.columns)
    for row in frame.toLocalIterator():
        yield "\t".join("" if x is None else str(x) for x in row)
