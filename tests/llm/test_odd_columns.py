"""Extra columns of any name, null, empty and very long texts, empty tables: operators that keep columns, and the pipeline."""

import datetime

import pytest

import corpus_pipeline as pipe
from fathomline.llm import mixing, near_dups, secret_scan, toxicity
from fathomline.llm import sentence_pieces as sp

NAMES = ["doc_id", "text", "lang", "source", "n_chars", "_n", "_cut", "_block", "_b", "_source", "a.b", "toxicity_score", "epoch", "slot", "e", "at", "s", "c0", "pieces", "a`b", "when"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n.replace('`', '``')}` {'date' if n == 'when' else 'long'}" for n in NAMES[5:])
DAY = datetime.date(2024, 2, 29)


def made(spark, texts):
    rows = [(d, t, "en", src, len(t or ""), *range(100, 100 + len(NAMES) - 6), DAY) for d, t, src in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    same = " ".join(f"w{i}" for i in range(40))
    texts = [(0, same, "a"), (1, same, "a"), (2, same + " tail", None), (3, None, "a"), (4, "", "b"), (5, "token=abcdefgh12345678 here", "b"), (None, "plain", "a"), (None, None, None), (6, "x" * 5_000_000, "c"), (6, "other text", "c")]
    return made(spark, texts)


def kept(frame, docs, *changed):
    """Each row has the values that its columns began with."""
    assert frame.columns == docs.columns and frame.schema == docs.schema
    for r in frame.collect():
        for k, n in enumerate(NAMES):
            if n not in ("doc_id", "text", "lang", "source", "n_chars", *changed):
                assert r[k] == (DAY if n == "when" else 100 + k - 5), n
    return frame


def test_mixing_keeps_columns(docs):
    out = mixing.make_schedule(docs, full_pass=True, max_repetition=1.5).apply(docs, "my_epoch", "my_slot")
    kept(out.drop("my_epoch", "my_slot"), docs)
    replaced = mixing.make_schedule(docs).apply(docs)
    assert sorted(replaced.columns) == sorted(docs.columns) and replaced.where("epoch >= 100").isEmpty()


def test_redact_keeps_columns(docs):
    out = kept(secret_scan.redact(docs), docs)
    assert {r["text"] for r in out.where("doc_id = 5").collect()} == {"[secret] here"}


def test_dedup_keeps_columns(docs):
    out = kept(near_dups.dedup(docs), docs)
    assert sorted(r["doc_id"] for r in out.where("doc_id is not null").collect()) == [0, 3, 4, 5, 6]


def test_scores_keep_columns(docs):
    out = toxicity.with_scores(docs, toxicity.Model({"w1": 3.0}, -1.0), "new")
    kept(out.drop("new"), docs)


def test_the_pipeline_keeps_columns_and_all_clean_documents(spark, docs, none, tmp_path):
    labels = spark.createDataFrame([(0, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for table, n in ((docs, 7), (none, 0)):
        now = table
        for name, stage in pipe.STAGES[:-1]:
            now = stage(spark, now, str(tmp_path))
            assert now.columns == table.columns, name
        if n:
            kept(now, docs)
        ids = [r["doc_id"] for r in now.collect()]
        assert len(set(ids)) == (6 if n else 0) and len(ids) >= n
        assert pipe.STAGES[-1][1](spark, now, str(tmp_path)).count() == len(ids)


def test_run_leaves_only_its_last_input(spark, docs, tmp_path):
    at = f"{tmp_path}/in"
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(0, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    import os

    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = set(os.listdir(shared))
    assert pipe.run(spark, at).count() >= 7
    assert [n.split("-")[:2] for n in set(os.listdir(shared)) - before] == [["stage", "mixing"]]


def test_long_parts_take_linear_time():
    import time

    from public_tokenizers import path

    model = sp.Unigram(sp.read_model(path("piece_bpe_32k.model")))
    began = time.perf_counter()
    text = "ab" * 200_000
    assert model.decode(model.encode_batch([text])[0]) == text
    import pyarrow as pa

    assert secret_scan.Scanner().scan(pa.array([".eyJ" + "eyJ" * 300_000]))[0] == []
    assert time.perf_counter() - began < 30
