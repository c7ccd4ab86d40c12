"""What the operators share: shared storage, batches of bounded size, byte-level word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text that a Python task holds at a time; a longer text is a batch of its own.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where that is unset and all runs in this process (tests), a new local one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="fathomline-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


_made: list[list[str]] = []


def new_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    for paths in _made:
        paths.append(path)
    return path


@contextlib.contextmanager
def temporary(spark: SparkSession):
    """Tables written in the block are removed at its end: what is lazy must have been written elsewhere by then."""
    paths: list[str] = []
    _made.append(paths)
    try:
        yield
    finally:
        _made[:] = [x for x in _made if x is not paths]
        delete(spark, *paths)


def write_table(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """df written as Parquet in the shared folder and read again: the lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, *paths: str) -> None:
    """Removes written tables that no lazy result reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(df: DataFrame) -> list[Column]:
    return [quoted(c) for c in df.columns]


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, with as many underscores as it takes for none of them to be among those taken."""
    held = {t.lower() for t in taken}
    while held & {n.lower() for n in names}:
        names = tuple(f"_{n}" for n in names)
    return list(names)


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(mod)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most limit bytes of the column, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size) // limit
        cut = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            yield batch.slice(a, b - a)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def release() -> None:
    """Gives freed memory back to the system: a worker lives on between tasks and stages, and would hold it beside its executor's heap."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def map_arrow(df: DataFrame, make: Callable[[], Callable], schema: str) -> DataFrame:
    """mapInArrow with a function made once in each task."""

    def run(batches):
        yield from make()(batches)
        release()

    return df.mapInArrow(run, schema)


def map_whole(df: DataFrame, make: Callable[[], Callable], *added: T.StructField) -> DataFrame:
    """map_arrow over all columns, whatever their names, which stay; `added` are put behind them."""
    names = [*df.columns, *(f.name for f in added)]
    places = [f"c{k}" for k in range(len(names))]  # dots and quotes in names mean something to Spark

    def run(batches):
        yield from map(lambda out: out.rename_columns(places), make()(b.rename_columns(names[: b.num_columns]) for b in batches))
        release()

    schema = T.StructType([T.StructField(c, f.dataType, f.nullable) for c, f in zip(places, [*df.schema.fields, *added], strict=True)])
    return df.toDF(*places[: len(df.columns)]).mapInArrow(run, schema).toDF(*names)


def record_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def split_binary(data: bytes, lengths: np.ndarray) -> pa.Array:
    """An Arrow binary array of consecutive pieces of data."""
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(data)]).cast(pa.binary())


def may_hold(ids: DataFrame, column: str, most_bits: int = 26) -> Callable[[Column], Column]:
    """A test of whether a column's value may be among ids: no for most others, always yes for these.

    A bitmap of 16 bits an id, of at most 2**most_bits bits (8 MB at 26): it is built by an aggregation, and the driver
    and each task hold it whole. With very many ids it lets more others through, and a join must decide in any case.
    """
    spark = ids.sparkSession
    bits = 1 << min(most_bits, max(16, (16 * ids.count()).bit_length()))
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    words = ids.select(at(F.col(column)).alias("b")).select(F.floor(F.col("b") / 64).alias("w"), F.expr("shiftleft(1L, cast(b % 64 as int))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m")).toPandas()
    bitmap = np.zeros(bits // 64, np.uint64)
    bitmap[words["w"].to_numpy(np.int64)] = words["m"].to_numpy(np.int64).view(np.uint64)
    shared = spark.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def test(place: pd.Series) -> pd.Series:
        p = place.to_numpy(np.int64)
        return pd.Series((shared.value[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) != 0)

    return lambda c: test(F.coalesce(at(c), F.lit(0)))


class Memo(dict):
    """What compute gives for a key. The first `core` keys stay, of the others the last `recent`, and keys over `longest` characters never: memory is bounded, results aren't touched."""

    def __init__(self, compute: Callable, core: int = 600_000, recent: int = 250_000, longest: int = 64):
        super().__init__()
        self.compute, self.core, self.recent, self.longest, self.late = compute, core, recent, longest, {}

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.compute(key)
        got = self.late.get(key)
        if got is None:
            got = self.compute(key)
            if len(self) < self.core:
                self[key] = got
            else:
                if len(self.late) >= self.recent:
                    self.late.clear()
                self.late[key] = got
        return got


# --- words as 64-bit hashes, straight from UTF-8 bytes -------------------------------------------------------------


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit hashes."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_MULT = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_MULT, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULT))
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column with one space after each row, and the offset at which each row starts (one more than rows); null: empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    column = pc.binary_join_element_wise(column, pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string()))
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if len(column) else np.zeros(0, np.uint8)
    return raw, off - off[0]


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, row starts in words, raw bytes, word starts, word ends) of words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased."""
    raw, off = utf8(column)
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    total = np.zeros(len(raw) + 1, np.uint64)
    power = _powers(_MULT, len(raw))
    np.cumsum(_BYTE[raw] * power, out=total[1:])
    inverse = _powers(_INVERSE, len(raw))
    value = (total[end] - total[start]) * (inverse[start] if len(start) else np.zeros(0, np.uint64))
    value = mix64(value + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return value, np.searchsorted(start, off), raw, start, end
