"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

Weights are token shares raised to an exponent and normalised. The exponent is found by bisection: the largest up to 1 that
reaches the target entropy, unless a source would then be repeated more often than allowed; then the smallest that keeps
to the limit. The target is a share of the logarithm of the number of sources, or a share of the way to it from the
corpus's own entropy (`flatten`), which binds on any corpus whose sources differ. The budget in tokens times the weight is a
source's quota. A source's documents are dealt into blocks by hash; each epoch runs through all its blocks in another
permutation, and the last epoch ends where the quota does: after whole blocks and, within one block, before the first
document (by hash) that would exceed it. Blocks of all sources are then interleaved evenly.

Only counts of documents are shuffled, added up before the shuffle; a hot source is many blocks. The driver gets a row
for each source (at most MAX_SOURCES, else an error) and each block (at most MAX_BLOCKS, plus one a source: blocks grow
with the corpus), and the schedule it sends back is bounded by these and the repetition. Tokens are words
[^\\x20\\x09-\\x0D]+ unless a column is named.

Null sources are a source of their own; null and empty texts are documents of no tokens, which follow their block. Rows
that repeat a doc_id share its block. An empty table gives no rows. All columns are kept by `apply`, whatever they are named, but for those
named as its two new ones.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLOCK_TOKENS, MAX_BLOCKS, MAX_SOURCES = 100_000, 50_000, 100_000


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def tempered(shares: np.ndarray, exponent: float) -> np.ndarray:
    logs = exponent * np.log(shares)
    w = np.exp(logs - logs.max())
    return w / w.sum()


def entropy(w: np.ndarray) -> float:
    return float(-(w * np.log(w)).sum())


def bisect(fits, low: float, high: float) -> float:
    """The largest exponent that fits, if all smaller ones do."""
    if fits(high):
        return high
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if fits(mid) else (low, mid)
    return low


def least_exponent(over, low: float) -> float:
    """The smallest exponent from low to 1 that isn't over, if no larger one than such is; 1 is taken not to be."""
    if not over(low):
        return low
    high = 1.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if over(mid) else (low, mid)
    return high


def find_weights(tokens: np.ndarray, budget: float, target_entropy: float | None = None, max_repetition: float | None = None, flatten: float | None = None) -> tuple[float, np.ndarray]:
    """(exponent, weights) of sources with tokens over 0. target_entropy, flatten: from 0 to 1, see above; the greater of both holds."""
    shares = tokens / tokens.sum()
    exponent, most = 1.0, math.log(len(tokens))
    own = entropy(shares)
    target = max(-1.0 if target_entropy is None else target_entropy * most, -1.0 if flatten is None else own + flatten * (most - own))
    if len(tokens) > 1 and target >= 0:
        exponent = bisect(lambda a: entropy(tempered(shares, a)) >= target - 1e-12, 0.0, 1.0)
    if max_repetition is not None:
        if budget > max_repetition * tokens.sum() * (1 + 1e-12):
            raise ValueError("the budget is over the repetition limit of the whole corpus")
        exponent = least_exponent(lambda a: (tempered(shares, a) * budget / tokens).max() > max_repetition * (1 + 1e-9), exponent)
    return exponent, tempered(shares, exponent)


def full_pass_weights(tokens: np.ndarray, max_repetition: float) -> tuple[float, np.ndarray, float]:
    """(exponent, weights, budget): the budget just takes every source once at least, the exponent is the smallest with no source over max_repetition."""
    shares = tokens / tokens.sum()

    def over(a: float) -> bool:
        passes = tempered(shares, a) / shares
        return passes.max() > max_repetition * passes.min() * (1 + 1e-9)

    exponent = least_exponent(over, 0.0)
    w = tempered(shares, exponent)
    return exponent, w, float((tokens / w).max())


def _hash(seed: int, doc_id: str = "doc_id") -> Column:
    return F.xxhash64(F.lit(seed), F.col(doc_id))


class Schedule:
    """exponent; sources: source, n_blocks, weight, quota; rows: (source, block, epoch, slot, cut), where cut is the greatest hash taken, None: all."""

    def __init__(self, spark: SparkSession, seed: int, sources: pd.DataFrame, rows: list[tuple], exponent: float = 1.0):
        self.spark, self.seed, self.sources, self.rows, self.exponent = spark, seed, sources, rows, exponent

    def apply(self, docs: DataFrame, epoch: str = "epoch", slot: str = "slot") -> DataFrame:
        """docs with epoch and slot, a row for each time that a document is used."""
        docs = docs.drop(epoch, slot)
        place = {c.lower(): f"c{k}" for k, c in enumerate(docs.columns)}
        rows = docs.toDF(*place.values())  # whatever the columns' names, none meets those used here
        source, doc_id = F.col(place["source"]).cast("string"), place["doc_id"]
        own = self.spark.createDataFrame(list(self.sources[["source", "n_blocks"]].itertuples(index=False, name=None)), "s string, n long")
        plan = self.spark.createDataFrame(self.rows, "t string, b long, e int, at long, cut long")
        hint = F.broadcast if len(self.rows) <= 8 * (MAX_BLOCKS + MAX_SOURCES) else (lambda x: x)
        dealt = rows.join(F.broadcast(own), source.eqNullSafe(F.col("s"))).withColumn("block", F.pmod(_hash(self.seed, doc_id), "n"))
        used = dealt.join(hint(plan), (F.col("block") == F.col("b")) & F.col("s").eqNullSafe(F.col("t")))
        return used.where(F.col("cut").isNull() | (_hash(self.seed + 1, doc_id) <= F.col("cut"))).select(*place.values(), "e", "at").toDF(*docs.columns, epoch, slot)


def make_schedule(docs: DataFrame, budget: float | None = None, target_entropy: float | None = 0.95, max_repetition: float | None = 4.0, tokens: str | None = None, seed: int = 7, full_pass: bool = False, flatten: float | None = None, passes: float = 1.0) -> Schedule:
    """budget: tokens of the mixture; None: passes times as many as the corpus has. full_pass: instead, the least budget at which every source runs through at least once, at the exponent where max_repetition is just met."""
    spark = docs.sparkSession
    counted, at = common.write_table(docs.select("doc_id", F.col("source").cast("string").alias("source"), (common.quoted(tokens).cast("long") if tokens else words()).alias("n")), "mix")
    stats = counted.groupBy("source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs")).limit(MAX_SOURCES + 1).toPandas()
    if len(stats) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    stats = stats.sort_values("source", na_position="first", ignore_index=True)
    n = stats.n.to_numpy(np.float64) if len(stats) else np.zeros(0)
    total, use = n.sum(), n > 0
    w, exponent = np.zeros(len(n)), 1.0
    if use.any():
        if full_pass:
            exponent, w[use], budget = full_pass_weights(n[use], max_repetition or 1.0)
        else:
            budget = passes * total if budget is None else budget
            exponent, w[use] = find_weights(n[use], budget, target_entropy, max_repetition, flatten)
    quota = w * (budget or 0)
    per_block = max(BLOCK_TOKENS, total / MAX_BLOCKS)
    stats["n_blocks"] = np.maximum(1, np.ceil(n / per_block)).astype(np.int64)
    stats["weight"], stats["quota"] = w, quota
    own = spark.createDataFrame(list(stats[["source", "n_blocks"]].itertuples(index=False, name=None)), "s string, _n long")
    dealt = counted.join(F.broadcast(own), F.col("source").eqNullSafe(F.col("s"))).withColumn("block", F.pmod(_hash(seed), "_n"))
    sums = dealt.groupBy("source", "block").agg(F.sum("n").alias("n")).toPandas()  # a row for each block
    by_source = {(None if pd.isna(s) else s): g for s, g in sums.groupby("source", dropna=False)}
    rows, cuts = [], []
    for i, s in enumerate(stats.itertuples(index=False)):
        source = None if pd.isna(s.source) else s.source
        g = by_source[source].sort_values("block")
        block, size = g.block.to_numpy(), g.n.to_numpy(np.float64)
        left, epoch, used = s.quota if s.n else len(g) * 0.0, 0, []
        if not s.n:
            used = [(b, 0, None) for b in block]
        while s.n and left >= 1:
            order = np.random.default_rng([seed, i, epoch]).permutation(len(block))
            ends = np.cumsum(size[order])
            whole = int(np.searchsorted(ends, left * (1 + 1e-12), "right"))
            used += [(b, epoch, None) for b in block[order[:whole]]]
            left -= ends[whole - 1] if whole else 0
            if whole < len(block):
                if left >= 1:
                    cuts.append((source, int(block[order[whole]]), float(left)))
                    used.append((block[order[whole]], epoch, "cut"))
                break
            epoch += 1
        rows += [((k + 0.5) / len(used), i, source, b, e, c) for k, (b, e, c) in enumerate(used)]
    greatest = {}
    if cuts:
        part = spark.createDataFrame(cuts, "cs string, cb long, most double")  # one block a source at most
        order = F.expr("sum(n) over (partition by cs order by h, doc_id rows between unbounded preceding and current row)")
        inside = dealt.join(F.broadcast(part), F.col("source").eqNullSafe(F.col("cs")) & (F.col("block") == F.col("cb"))).withColumn("h", _hash(seed + 1)).withColumn("upto", order)
        over = inside.groupBy("cs").agg(F.min(F.when(F.col("upto") > F.col("most"), F.col("h"))).alias("first"), F.max("h").alias("last"))
        greatest = {r["cs"]: r["last"] if r["first"] is None else r["first"] - 1 if r["first"] > -(1 << 63) else r["first"] for r in over.collect()}
    rows.sort(key=lambda r: (r[0], r[1]))
    table = [(source, int(b), e, t, greatest.get(source) if c else None) for t, (_, _, source, b, e, c) in enumerate(rows)]
    common.delete(spark, at)
    return Schedule(spark, seed, stats, table, exponent)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, epoch, slot, exponent: every use of a document in a mixture half as large again as the corpus, its entropy half way from the corpus's own to the greatest, at most 4 passes over a source."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    schedule = make_schedule(docs, target_entropy=None, flatten=0.5, passes=1.5)
    return schedule.apply(docs.select("doc_id", "source")).withColumn("exponent", F.lit(schedule.exponent))


QUERIES = {"op6_mixing": op6_mixing}
