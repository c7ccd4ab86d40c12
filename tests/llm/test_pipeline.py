import os

import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def test_stages(spark, tmp_path):
    import corpus_pipeline as pipe

    from fathomline.llm import mixing, near_dups, secret_scan, toxicity

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, held = docs.columns, {}
    for name, stage in pipe.STAGES:
        before = docs
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{name}")
        docs = held[name] = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == pipe.STAGES[-1][0] or docs.columns == columns
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "toxicity":
            model = toxicity.fit(before, spark.read.parquet(f"{DATA}/labels.parquet"))
            assert ids == {r["doc_id"] for r in toxicity.with_scores(before, model).where("toxicity_score < 0.5").collect()}
        if name == "near-dedup":
            from test_near import expected

            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted({c for *_, c in expected(rows)})
        if name == "secrets":
            assert ids == {r["doc_id"] for r in before.collect()}
            spans = near_dups and secret_scan.scan(docs).where(F.size("spans") > 0)
            assert spans.count() == 0 and docs.where("n_chars != char_length(text)").count() == 0
        if name == "mixing":
            assert ids == {r["doc_id"] for r in before.collect()}
            uses = docs.groupBy("doc_id").count().agg(F.max("count")).first()[0]
            assert uses <= 2 and mixing.words() is not None
        if name == "pieces":
            assert docs.where("not round_trip").count() == 0 and docs.count() == before.count()
    assert pipe.run(spark, DATA).count() == held["pieces"].count()


def test_registered_queries():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
