from __future__ import annotations

import uuid
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gridloom.llm import shards


def check(rows, n):
    places = defaultdict(list)
    for r in rows:
        assert 0 <= r["shard"] < n and r["law"] == "bytes" and r["grown_shard"] is None
        places[r["shard"]].append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_edges(spark, edges, sf_dir):
    rows = shards.op1_shard_slots(spark, sf_dir(documents=edges)).collect()
    assert len(rows) == edges.count()
    check(rows, 40)
    want = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in edges.collect())
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in rows) == want


def test_sizes_are_near_equal_and_reruns_agree(spark):
    d = "/root/testdata/sf0.01"
    first, again = (shards.op1_shard_slots(spark, d).collect() for _ in range(2))
    check(first, 40)
    load = defaultdict(int)
    for r in first:
        load[r["shard"]] += r["size"]
    assert max(load.values()) < 1.02 * min(load.values())
    assert sorted(map(tuple, first), key=str) == sorted(map(tuple, again), key=str)


def test_empty(spark, documents, sf_dir):
    assert shards.op1_shard_slots(spark, sf_dir(documents=documents([]))).count() == 0


def test_rebalance_moves_little():
    totals = {s: (100 + s % 7, 1) for s in range(400)}
    before = shards.first_map(totals, 400, 10)
    grown = shards.rebalance(before, totals, 11)
    load = defaultdict(int)
    for s, shard in enumerate(grown):
        load[shard] += totals[s][0]
    assert len(load) == 11 and max(load.values()) - min(load.values()) < 0.1 * sum(load.values()) / 11
    moved = sum(a != b for a, b in zip(before, grown, strict=True))
    assert moved <= 2 * 400 / 11
    shrunk = shards.rebalance(grown, totals, 9)
    assert max(shrunk) == 8
    assert shards.rebalance(before, totals, 10) == before


def test_map_versions_and_clashing_columns(spark, documents, stage):
    docs = documents([(k, f"text {k}") for k in range(50)]).withColumn("size", F.lit("mine")).withColumn("virtual_slot", F.lit("x"))
    store = shards.MapStore(spark, f"test-{uuid.uuid4().hex}")
    assert shards.shard(docs, store, shards=4, slots=64).count() == 50 and store.versions() == [1] and len(store.read(1)) == 64


def test_versions_are_edited_as_a_table_grows(spark, documents, stage):
    rows = [(k, "word " * (1 + k % 9)) for k in range(3000)]
    store = shards.MapStore(spark, f"test-{uuid.uuid4().hex}")
    where = lambda docs, n=5: {r["doc_id"]: r["shard"] for r in shards.shard(docs, store, shards=n, slots=256).select("doc_id", "shard").collect()}
    first, again = where(documents(rows)), where(documents(rows))
    assert first == again and store.versions() == [1]
    grown = where(documents(rows + [(5000 + k, "longer text " * 30) for k in range(40)]))
    moved = [a != b for a, b in zip(store.read(1), store.read(2), strict=True)]
    assert store.versions() == [1, 2] and 0 < sum(moved) < 128
    assert sum(first[d] != grown[d] for d in first) < 0.5 * len(first)
    more = where(documents(rows), 6)
    assert store.versions() == [1, 2, 3] and set(more.values()) == set(range(6))
    with pytest.raises(ValueError):
        store.current({}, slots=128)


def test_query_finds_its_map_again(spark, documents, tmp_path):
    spark.conf.set("gridloom.shared.dir", f"file://{tmp_path}/shared")
    out = f"{tmp_path}/in"
    for n in (2000, 2600):
        documents([(k, "some words " * (1 + k % 7)) for k in range(n)]).write.mode("overwrite").parquet(f"{out}/documents.parquet")
        rows = shards.op1_shard_slots(spark, out).collect()
        check(rows, 40)
        load = defaultdict(int)
        for r in rows:
            load[r["shard"]] += r["size"]
        assert max(load.values()) < 1.05 * min(load.values())
    spark.conf.unset("gridloom.shared.dir")
