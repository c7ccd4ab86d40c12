"""The corpus pipeline: documents through five of the operators, each stage written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents. All columns of docs are kept up to the last stage, whatever they are named. docs' null texts are empty; rows
with null doc_id are no near duplicates of others; an empty table gives no rows; see the operators for other odd rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import common, mixing, near_dups, secret_scan, sentence_pieces, toxicity

#: Most passes over a source, where the largest source has one.
MOST_PASSES = 1.5
#: Near duplicates share this part of their 5-word shingles at least (op7's own contract has 85).
NEAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier, fitted on this stage's own documents and their labels, scores below 0.5."""
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    (score,) = common.fresh(docs.columns, "toxicity_score")
    return toxicity.with_scores(docs, model, score).where(F.col(score) < 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near duplicates."""
    return near_dups.dedup(docs, NEAR_PERCENT)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; those of smaller sources again, up to MOST_PASSES passes, by temperature."""
    added = common.fresh(docs.columns, "epoch", "slot")
    return mixing.make_schedule(docs, full_pass=True, max_repetition=MOST_PASSES).apply(docs, *added).drop(*added)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, pieces, n_byte_pieces, round_trip: piece ids of each text, and whether they decode to it."""
    from public_tokenizers import path

    return sentence_pieces.encode(docs.select("doc_id", "source", "text"), path("piece_bpe_32k.model")).drop("text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near-dedup", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: Training, MinHash families and Viterbi paths are not SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents. A stage's own tables go when its result is written, and its input goes too."""
    docs, before = common.table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        path = common.new_path(spark, f"stage-{name}")
        with common.temporary(spark):
            out = stage(spark, docs, sf_dir)
            out.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        common.delete(spark, *before)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
