from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import queries


def test_stages():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert 4 <= len(names) <= 5 and len(set(names)) == len(names)
    assert [int(q[2:].split("_")[0]) for q in queries.QUERIES] == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.fixture()
def shared(spark, tmp_path):
    spark.conf.set("gridloom.shared.dir", f"file://{tmp_path}/shared")
    yield
    spark.conf.unset("gridloom.shared.dir")


def test_each_stage_on_what_the_one_before_kept(spark, shared, tmp_path):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    cols, counts = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        out.write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == cols
        if k != 2 and k != 4:
            assert docs.select("doc_id").exceptAll(before.select("doc_id").join(docs.select("doc_id").distinct(), "doc_id").union(before.select("doc_id")).union(before.select("doc_id"))).count() == 0
    labels = spark.read.parquet(f"{d}/labels.parquet")
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[4] > 0 and counts[5] == counts[4]
    assert docs.join(labels.where("quality = 0"), "doc_id").count() < 0.1 * labels.where("quality = 0").count()
    assert docs.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3


def test_run_agrees_with_the_stages_and_itself(spark, shared):
    d = "/root/testdata/sf0.001"
    a, b = (corpus_pipeline.run(spark, d) for _ in range(2))
    assert a.exceptAll(b).count() == 0 and a.count() == b.count() > 0


def test_edges_and_empty(spark, shared, edges, documents, tmp_path):
    labels = spark.createDataFrame([(1, 1), (6, 0)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, "last")], "item_id long, text string")
    for name, docs in (("edges", edges), ("none", documents([]))):
        base = f"{tmp_path}/{name}"
        docs.withColumns({"size": F.lit("s"), "copies": F.lit(7), "score": F.lit("z")}).write.parquet(f"{base}/documents.parquet")
        labels.write.parquet(f"{base}/labels.parquet")
        bench.write.parquet(f"{base}/benchmark.parquet")
        out = corpus_pipeline.run(spark, base)
        assert out.count() <= 3 * docs.count()
