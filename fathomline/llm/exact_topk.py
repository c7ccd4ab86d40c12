"""Exact top-k search: a Voronoi kNN join for integer inner products.

Rows of least hash are pivots (about the square root of the number of rows, in bounds; they are rows of the data
themselves). Every vector, query or row, belongs to the cell of its nearest pivot. Of each cell's queries the summary
holds their number, the greatest distance r from the pivot p, and a bound t: the least, over its queries, of the k-th
best score among the pivots, which the k-th best of all cannot be below; of each cell's rows, with pivot o, the greatest
distance s. A cell of rows can be needed by a cell of queries only if p*o + s*|p| + r*(|o| + s) >= t; of such cells a row
x is needed only if p*x + r*|x| >= t. Cells of queries are packed into groups along a chain of near pivots (a cell of too
many queries is split by hash), each row is replicated to the groups that need it, and each group is solved in tiles
against chunks of its rows. In many dimensions r is large and few rows can be ruled
out; the groups' number, and with it the replication, then depends on the number of queries alone.

Components are floor(64 * x). Scores must stay below 2**62 / 8192 in size; products in doubles are exact up to 2**53 /
8192, and beyond that integers are used. Null, empty and non-finite vectors take no part, nor do those of another
dimension than most. Rows that repeat a vec_id are candidates each, but never for a query of their own vec_id; a
repeated query counts once. Fewer candidates than k: all of them. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tiles

#: Bounds of the number of pivots.
LEAST_PIVOTS, MOST_PIVOTS = 256, 2048


def best(query_ids, queries, ids, rows, k: int = tiles.K):
    """The k greatest inner products of each query, ties to smaller ids (ids ascend); own ids left out."""
    n = len(ids)
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * rows.shape[1]
    if bound * n < 1 << 52:
        score = queries @ rows.T
        key = score * n - np.arange(n)
        worst = -np.inf
    else:
        score = queries.astype(np.int64) @ rows.astype(np.int64).T
        key = score * n - np.arange(n)
        worst = np.iinfo(np.int64).min
    key[query_ids[:, None] == ids[None, :]] = worst
    top = np.argpartition(-key, k - 1, 1)[:, :k] if n > k else np.tile(np.arange(n), (len(query_ids), 1))
    q = np.repeat(np.arange(len(query_ids)), top.shape[1])
    top = top.ravel()
    keep = key[q, top] != worst
    q, top = q[keep], top[keep]
    return query_ids[q], ids[top], score[q, top].astype(np.int64)


def voronoi_topk(table: DataFrame, k: int = tiles.K, n_pivots: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) for table(vec_id, embedding)."""
    spark = table.sparkSession
    vectors, dim = tiles.clean_vectors(table, lambda x: np.floor(64.0 * x), zero=True)
    n_rows = vectors.count()
    n_pivots = n_pivots or min(MOST_PIVOTS, max(LEAST_PIVOTS, math.isqrt(n_rows)))
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(n_pivots).collect()  # bounded by MOST_PIVOTS
    pivots = np.array([np.frombuffer(r["v"], "<f8") for r in chosen]).reshape(-1, dim)
    pivot_ids = np.array([r["vec_id"] for r in chosen], np.int64)
    square, length = (pivots**2).sum(1), np.sqrt((pivots**2).sum(1))

    def nearest(v):
        """(scores with the pivots, cell, distance from its pivot) of each vector."""
        score = v @ pivots.T
        cell = (square - 2 * score).argmin(1)
        return score, cell, np.sqrt(((v - pivots[cell]) ** 2).sum(1))

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v, ids = tiles.matrix(batch, dim), batch.column("vec_id").to_numpy()
            score, cell, far = nearest(v)
            other = np.where(ids[:, None] == pivot_ids, -np.inf, score)
            least = np.partition(other, -k, 1)[:, -k] if len(pivots) >= k else np.full(len(ids), -np.inf)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cell, pa.int32()), pa.array(far), pa.array(least)], names=["vec_id", "v", "cell", "far", "least"])

    queries, _ = common.write_table(tiles.queries_of(vectors).mapInArrow(assign, "vec_id long, v binary, cell int, far double, least double"), "queries")
    cells = queries.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("r"), F.min("least").alias("t")).toPandas().sort_values("cell")  # a row for each pivot at most
    blocks = pack(cells, pivots, tiles.query_block(dim))
    own = spark.createDataFrame(pd.DataFrame(blocks, columns=["cell", "part", "parts", "block"], dtype="int64"), "cell int, part long, parts long, block int")
    part = F.pmod(F.xxhash64(F.lit(5), "vec_id"), F.col("parts"))
    asked = queries.join(F.broadcast(own), "cell").where(F.col("part") == part).select("block", "vec_id", "v")
    of_cell: dict[int, list[int]] = {}
    for cell, _, _, block in blocks:
        of_cell.setdefault(cell, []).append(block)
    cell_ids, r, t = cells["cell"].to_numpy(np.int64), cells["r"].to_numpy(np.float64), cells["t"].to_numpy(np.float64)
    n_blocks = 1 + max((b for *_, b in blocks), default=-1)
    holds = np.zeros((len(cell_ids), max(1, n_blocks)), np.float32)
    for i, c in enumerate(cell_ids.tolist()):
        holds[i, of_cell[c]] = 1

    def summed(batches):
        far = np.full(len(pivots), -1.0)
        for batch in batches:
            if batch.num_rows:
                _, cell, d = nearest(tiles.matrix(batch, dim))
                np.maximum.at(far, cell, d)
        used = np.flatnonzero(far >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(far[used])], names=["cell", "s"])

    summary = vectors.mapInArrow(summed, "cell int, s double").groupBy("cell").agg(F.max("s").alias("s")).toPandas()  # a row for each pivot at most
    spread = np.zeros(len(pivots))
    spread[summary["cell"].to_numpy(np.int64)] = summary["s"].to_numpy(np.float64)
    near = pivots[cell_ids] if len(cell_ids) else np.zeros((0, dim))
    slack = 1e-6 * (1 + np.abs(np.where(np.isfinite(t), t, 0)))
    meets = pivots @ near.T + spread[:, None] * length[cell_ids] + (length + spread)[:, None] * r >= t - slack  # cells of rows, cells of queries

    def route(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = tiles.matrix(batch, dim)
            need, cell = np.zeros((len(v), len(cell_ids)), np.float32), nearest(v)[1]
            norm = np.sqrt((v**2).sum(1))
            for c in np.unique(cell):
                rows, asked_by = np.flatnonzero(cell == c), np.flatnonzero(meets[c])
                need[np.ix_(rows, asked_by)] = v[rows] @ near[asked_by].T + norm[rows, None] * r[asked_by] >= (t - slack)[asked_by]
            row, block = np.nonzero(need @ holds > 0)
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), batch.column("vec_id").take(pa.array(row)), batch.column("v").take(pa.array(row))], names=["block", "vec_id", "v"])

    data = vectors.mapInArrow(route, "block int, vec_id long, v binary")
    found = tiles.solve_tiles(asked, data, n_rows, lambda *a: best(*a, k=k), "long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def pack(cells: pd.DataFrame, pivots: np.ndarray, most: int) -> list[tuple[int, int, int, int]]:
    """(cell, part, parts, block): cells along a chain of near pivots, `most` queries in a block or so."""
    left = {int(c): int(n) for c, n in zip(cells["cell"], cells["n"], strict=True)}
    out, block, held = [], 0, 0
    at = min(left, default=None)
    while left:
        n = left.pop(at)
        parts = -(-n // most)
        for p in range(parts):
            if held and held + n / parts > most:
                block, held = block + 1, 0
            out.append((at, p, parts, block))
            held += n / parts
        if left:
            rest = np.array(list(left))
            at = int(rest[((pivots[rest] - pivots[at]) ** 2).sum(1).argmin()])
    return out


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 20 best of each query."""
    return voronoi_topk(common.table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.e, x.e) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

QUERIES = {"op4_exact_topk": op4_exact_topk}
SQL = {"op4_exact_topk": ORACLE}
