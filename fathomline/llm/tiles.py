"""Query blocks against data chunks: what both vector searches share.

A tile holds at most about QUERY_BLOCK queries (fewer where they'd take more than BLOCK_BYTES) and DATA_CHUNK rows. Rows of
a tile come together by a shuffle on (block, chunk) and are solved one tile at a time; a tile gives the k best of each of
its queries. Every row is shuffled once for each block, so blocks are as large as memory allows. Rows that are all alike
fall into one tile; its rows are solved DATA_CHUNK at a time, so it needs no more memory.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

QUERY_BLOCK, DATA_CHUNK, BLOCK_BYTES = 65_536, 8192, 32 << 20
K = 20
QUERY_MOD = 20


def query_block(dim: int) -> int:
    return max(1, min(QUERY_BLOCK, BLOCK_BYTES // (8 * dim)))


def matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("v").to_pylist()), "<f8").reshape(-1, dim)


def clean_vectors(table: DataFrame, change: Callable[[np.ndarray], np.ndarray], zero: bool) -> tuple[DataFrame, int]:
    """((vec_id, v as little-endian doubles) of all usable rows, dimension).

    Out: null vec_ids, null and empty vectors, those with null or non-finite components and, unless zero, zero
    vectors; and vectors of another dimension than most usable ones have (ties: the larger), with a warning that says
    how many.
    """

    def run(batches):
        for batch in batches:
            column = batch.column("embedding").cast(pa.list_(pa.float64()))
            size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            flat = column.flatten().to_numpy(zero_copy_only=False)  # null: NaN
            row = np.repeat(np.arange(len(size)), size)
            bad = np.bincount(row[~np.isfinite(flat)], minlength=len(size)) > 0
            if not zero:
                bad |= np.bincount(row[flat != 0], minlength=len(size)) == 0
            keep = (size > 0) & ~bad & pc.is_valid(batch.column("vec_id")).to_numpy(zero_copy_only=False)
            kept = size[keep]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(keep)).cast(pa.int64()), pa.array(kept, pa.int32()), common.split_binary(np.ascontiguousarray(change(flat[keep[row]]), "<f8").tobytes(), 8 * kept)], names=["vec_id", "dim", "v"])

    found, _ = common.write_table(table.select("vec_id", "embedding").mapInArrow(run, "vec_id long, dim int, v binary"), "vectors")
    dims = found.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = dims["dim"] if dims else 1
    others = found.where(F.col("dim") != dim).count()
    if others:
        warnings.warn(f"{others} vectors that have another dimension than {dim} take no part", stacklevel=2)
    return found.where(F.col("dim") == dim).select("vec_id", "v"), dim


def queries_of(vectors: DataFrame) -> DataFrame:
    """One row for each vec_id divisible by QUERY_MOD; if rows repeat one, the least vector (as bytes)."""
    return vectors.where(F.col("vec_id") % QUERY_MOD == 0).groupBy("vec_id").agg(F.min("v").alias("v"))


def chunk_of(n_rows: int):
    return F.pmod(F.xxhash64(F.lit(3), "vec_id", "v"), F.lit(max(1, -(-n_rows // DATA_CHUNK)))).cast("int")


def solve_tiles(queries: DataFrame, data: DataFrame, n_rows: int, solve: Callable, score: str) -> DataFrame:
    """(query_id, vec_id, score): solve(query ids, queries, ids, rows) of each tile.

    queries(block, vec_id, v), data(block, vec_id, v): block says which queries need which rows.
    """
    chunks = max(1, -(-n_rows // DATA_CHUNK))
    left = queries.select("block", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(0).alias("side"), "vec_id", "v")
    right = data.select("block", chunk_of(n_rows).alias("chunk"), F.lit(1).alias("side"), "vec_id", "v")
    dealt = left.union(right).repartition("block", "chunk").sortWithinPartitions("block", "chunk", "side", "vec_id")

    most = 2 * DATA_CHUNK

    def run(batches):
        now, asked, held, n = None, [], [], 0  # of the tile: queries, rows, how many rows
        for batch in batches:
            block, chunk, side = (batch.column(c).to_numpy() for c in ("block", "chunk", "side"))
            cut = [0, *(np.flatnonzero((np.diff(block) != 0) | (np.diff(chunk) != 0) | (np.diff(side) != 0)) + 1), batch.num_rows]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if a == b:
                    continue
                if (block[a], chunk[a]) != now:
                    yield from tile(asked + held)
                    now, asked, held, n = (block[a], chunk[a]), [], [], 0
                if side[a] == 0:
                    asked.append(batch.slice(a, b - a))
                    continue
                held.append(batch.slice(a, b - a))
                n += b - a
                if n >= most:
                    yield from tile(asked + held)
                    held, n = [], 0
        yield from tile(asked + held)

    def tile(held):
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        n = int((rows.column("side").to_numpy() == 0).sum())
        if n == 0 or n == rows.num_rows:
            return
        ids = rows.column("vec_id").to_numpy()
        v = np.frombuffer(b"".join(rows.column("v").to_pylist()), "<f8").reshape(rows.num_rows, -1)
        for a in range(0, n, 512):
            to = min(n, a + 512)
            q, x, s = solve(ids[a:to], v[a:to], ids[n:], v[n:])
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(x, pa.int64()), pa.array(s, pa.int64() if score == "long" else pa.float64())], names=["query_id", "vec_id", "score"])

    return dealt.mapInArrow(run, f"query_id long, vec_id long, score {score}")
