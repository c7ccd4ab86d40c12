"""Nearest neighbours by a block matrix join of int8 tiles with error bounds.

Queries are dealt into blocks and rows into chunks by hash; every block meets every chunk in a tile. In a tile each
vector v becomes s * c with int8 c and an error e = |v - s * c|. Products of the int8 matrices are whole numbers and
are computed exactly (in single precision, dimensions at a time where sums could pass 2**24). The true inner product
differs from s*s'*c*c' by at most |s*c|*e' + e*|v'|, so pairs whose upper bound is below the k-th best lower bound of
the query in the tile cannot be among its k best. The others are recomputed in double precision, in order of
dimensions, and the tiles' lists are merged by a heap of k for each query. As the bounds hold, no neighbour is lost:
recall is 1.

Null, empty, zero and non-finite vectors take no part, nor do those of another dimension than most. Rows that repeat a
vec_id are candidates each, but never for a query of their own vec_id; a repeated query counts once. Fewer candidates
than k: all of them. An empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tiles

#: Dimensions whose int8 products add up exactly in single precision: 1024 * 127**2 < 2**24.
EXACT_DIMS = 1024


def quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes as float32, scale, error, norm of the codes times scale)."""
    scale = np.abs(v).max(1) / 127
    scale[scale == 0] = 1
    code = np.rint(v / scale[:, None])
    near = code * scale[:, None]
    return code.astype(np.float32), scale, np.sqrt(((v - near) ** 2).sum(1)), np.sqrt((near**2).sum(1))


def best(query_ids, queries, ids, rows, k: int = tiles.K):
    qc, qs, qe, qn = quantised(queries)
    xc, xs, xe, _ = quantised(rows)
    product = np.zeros((len(queries), len(rows)))
    for d in range(0, rows.shape[1], EXACT_DIMS):
        product += qc[:, d : d + EXACT_DIMS] @ xc[:, d : d + EXACT_DIMS].T
    product *= qs[:, None] * xs
    error = (qn[:, None] * xe + qe[:, None] * np.sqrt((rows**2).sum(1))) * (1 + 1e-9) + 1e-300
    own = query_ids[:, None] == ids[None, :]
    low = np.where(own, -np.inf, product - error)
    if len(ids) > k:
        least = np.partition(low, -k, 1)[:, -k]
        q, x = np.nonzero((product + error >= least[:, None]) & ~own)
    else:
        q, x = np.nonzero(~own)
    score = np.zeros(len(q))
    for d in range(rows.shape[1]):
        score += queries[q, d] * rows[x, d]
    order = np.lexsort((ids[x], -score, q))
    q, x, score = q[order], x[order], score[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return query_ids[q[keep]], ids[x[keep]], score[keep]


def merged(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): of the tiles' lists, each query's k best, in a heap of k."""

    def run(batches):
        now, heap = None, []
        for batch in batches:
            out = []
            for q, x, s in zip(*(batch.column(c).to_pylist() for c in ("query_id", "vec_id", "score")), strict=True):
                if q != now:
                    out += told(now, heap)
                    now, heap = q, []
                if len(heap) < k:
                    heapq.heappush(heap, (s, -x))
                else:
                    heapq.heappushpop(heap, (s, -x))
            if out:
                yield table(out)
        yield table(told(now, heap))

    def told(q, heap):
        return [(q, rank + 1, -x, s) for rank, (s, x) in enumerate(sorted(heap, reverse=True))]

    def table(out):
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "rank", "vec_id", "score"])

    return found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(run, "query_id long, rank int, vec_id long, score double")


def block_join(table: DataFrame, k: int = tiles.K) -> DataFrame:
    """(query_id, rank, vec_id, score) for table(vec_id, embedding)."""
    vectors, dim = tiles.clean_vectors(table, lambda x: x, zero=False)
    n_rows = vectors.count()
    queries, _ = common.write_table(tiles.queries_of(vectors), "queries")
    blocks = max(1, -(-queries.count() // tiles.query_block(dim)))
    asked = queries.withColumn("block", F.pmod(F.xxhash64(F.lit(9), "vec_id"), F.lit(blocks)).cast("int"))
    data = vectors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return merged(tiles.solve_tiles(asked, data, n_rows, lambda *a: best(*a, k=k), "double"), k)


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 20 nearest of each query by inner product."""
    return block_join(common.table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.e, x.e) AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

QUERIES = {"op9_ann": op9_ann}
SQL = {"op9_ann": ORACLE}
