"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents of the training folds are the positives; all documents of the training folds, labelled or not
and with labels hidden, are the unlabelled text. A linear model in numpy minimises pi*E_p[l(g)] + max(0, E_u[l(-g)] - pi*E_p[l(-g)]) with the logistic loss l and class prior
pi; where the second term falls below zero its gradient is reversed.

Features are words (runs of letters, lower case) and their prefixes of 3 to 6 letters; a feature's value is the number
of distinct white-space tokens that have it. The model is fitted on at most MAX_POSITIVE positives and MAX_UNLABELLED
unlabelled documents (least hash of doc_id first) and FEATURES features; the class prior is the toxic share of all
training labels, and every whole text is scored. The driver gets the chosen features and the sample's feature counts, both bounded by these parameters.

Null and empty texts get the score of no features. Rows that repeat a doc_id are scored each. Labels that repeat a
doc_id count as toxic if one of them is; null labels are unlabelled. Without positives the score is the prior.
Other columns are ignored, and kept by `with_scores`, whatever they are named, but for one named as its new one.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MAX_POSITIVE, MAX_UNLABELLED, FEATURES, LEAST_DOCS = 3_000, 6_000, 2_000, 4
#: Standard errors by which a feature's share in positives and unlabelled rows must differ.
LEAST_Z = 3.5
FOLDS = 5
PREFIXES = (3, 4, 5, 6)

_letters = re.compile(r"[^\W\d_]+").findall


def features(token: str) -> set[str]:
    out = set()
    for word in _letters(token.lower()):
        out.add(word)
        out.update(word[:k] + "*" for k in PREFIXES if len(word) > k)
    return out


def document_features(text: str | None) -> Counter:
    out: Counter = Counter()
    for token in set((text or "").split()):
        out.update(features(token))
    return out


def fit_nnpu(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int = 300, rate: float = 0.05, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """(weights, bias) of the linear scorer, by Adam over the whole sample."""
    w, b = np.zeros(xp.shape[1], np.float64), math.log(prior / (1 - prior))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        gp, gu = xp @ w.astype(np.float32) + b, xu @ w.astype(np.float32) + b
        sp, su = 1 / (1 + np.exp(-np.clip(gp, -30, 30))), 1 / (1 + np.exp(-np.clip(gu, -30, 30)))
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        dn_u, dn_p = su / len(su), -prior * sp / len(sp)  # of the negative part
        if negative >= 0:
            du, dp = dn_u, dn_p + prior * (sp - 1) / len(sp)
        else:
            du, dp = -dn_u, -dn_p
        grad = np.append(xp.T @ dp.astype(np.float32) + xu.T @ du.astype(np.float32) + l2 * w, dp.sum() + du.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


class Model:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def scorer(self):
        weights, bias = self.weights, self.bias

        memo = common.Memo(lambda token: math.fsum(weights[f] for f in features(token) if f in weights))

        def score(text: str | None) -> float:
            g = bias + math.fsum(map(memo.__getitem__, set((text or "").split())))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, g))))

        return score


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, n_features: int = FEATURES) -> Model:
    """Fits on labels(doc_id, toxic) of all folds but the held-out one."""
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & (common.fold(F.col("doc_id"), FOLDS) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known, at = common.write_table(known.withColumn("h", F.xxhash64("doc_id")), "labels")
    n, toxic = known.agg(F.count("toxic"), F.sum(F.when(F.col("toxic") == 1, 1))).first()
    prior = min(0.99, max(0.001, (toxic or 0) / n)) if n else 0.01
    if not toxic:
        common.delete(spark, at)
        return Model({}, math.log(prior / (1 - prior)))
    p = known.where("toxic = 1").orderBy("h", "doc_id").limit(max_positive).select("doc_id", F.lit(1).alias("p"), F.lit(0).alias("u"))
    trained = docs.select("doc_id").where(F.col("doc_id").isNotNull() & (common.fold(F.col("doc_id"), FOLDS) != 0))
    u = trained.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(max_unlabelled).select("doc_id", F.lit(0).alias("p"), F.lit(1).alias("u"))
    sample = p.union(u).groupBy("doc_id").agg(F.max("p").alias("p"), F.max("u").alias("u")).toPandas()  # bounded by the two parameters
    sample = spark.createDataFrame(pd.DataFrame({"doc_id": sample.doc_id.astype("int64"), "p": sample.p.astype("int64"), "u": sample.u.astype("int64")}), "doc_id long, p long, u long")
    rows, rows_at = common.write_table(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), "sample")

    def count():
        def run(batches):
            found: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for batch in common.slices(batches):
                for text, in_p, in_u in zip(*(batch.column(c).to_pylist() for c in ("text", "p", "u")), strict=True):
                    for f in document_features(text):
                        x = found[f]
                        x[0] += in_p
                        x[1] += in_u
            yield pa.RecordBatch.from_pydict({"feature": pa.array(found, pa.string()), "p": pa.array([x[0] for x in found.values()], pa.int64()), "u": pa.array([x[1] for x in found.values()], pa.int64())})

        return run

    n_p, n_u = rows.agg(F.sum("p"), F.sum("u")).first()
    if not n_p or not n_u:
        common.delete(spark, at, rows_at)
        return Model({}, math.log(prior / (1 - prior)))
    both = common.map_arrow(rows, count, "feature string, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where(f"p + u >= {LEAST_DOCS}")
    share = (F.col("p") + F.col("u")) / (n_p + n_u)
    z = F.abs(F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u) + 1e-9)
    chosen = [r["feature"] for r in both.withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "feature").limit(n_features).collect()]
    place = {f: k for k, f in enumerate(chosen)}

    def encode():
        def run(batches):
            for batch in common.slices(batches):
                out = []
                for text in batch.column("text").to_pylist():
                    got = [(place[f], c) for f, c in document_features(text).items() if f in place]
                    out.append(np.array(got, np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("p"), batch.column("u"), pa.array(out, pa.binary())], names=["doc_id", "p", "u", "x"])

        return run

    got = sorted(tuple(r) for r in common.map_arrow(rows, encode, "doc_id long, p long, u long, x binary").collect())  # bounded by the sample
    x = np.zeros((len(got), len(chosen)), np.float32)
    for k, r in enumerate(got):
        pairs = np.frombuffer(r[3], np.int32).reshape(-1, 2)
        x[k, pairs[:, 0]] = pairs[:, 1]
    w, b = fit_nnpu(x[[r[1] == 1 for r in got]], x[[r[2] == 1 for r in got]], prior)
    common.delete(spark, at, rows_at)
    return Model(dict(zip(chosen, w.tolist(), strict=True)), b)


def with_scores(docs: DataFrame, model: Model, column: str = "toxicity_score") -> DataFrame:
    """docs with a column of scores of their whole texts (in place of one of that name)."""
    docs = docs.drop(column)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # at most FEATURES weights

    def make():
        score = Model(*shared.value).scorer()

        def run(batches):
            for batch in common.slices(batches):
                yield batch.append_column(column, pa.array(list(map(score, batch.column("text").to_pylist())), pa.float64()))

        return run

    return common.map_whole(docs, make, T.StructField(column, T.DoubleType()))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels of the held-out fifth are never seen."""
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    return with_scores(docs.select("doc_id", "text"), model, "score").select("doc_id", (common.fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op3_toxicity": op3_toxicity}
