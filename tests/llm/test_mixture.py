from __future__ import annotations

import math
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from gridloom.llm import mixture


def filled(sizes, weights):
    """Targets by resharing until none is above its cap."""
    target, open_, budget = {}, set(sizes), float(sum(sizes.values()))
    while open_:
        w = sum(weights[s] for s in open_)
        over = {s for s in open_ if budget * weights[s] / w > 3 * sizes[s] + 1e-9}
        if not over:
            target |= {s: budget * weights[s] / w for s in open_}
            break
        for s in over:
            target[s] = 3 * sizes[s]
            budget -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [[100, 1, 1, 300], [5], [10, 10, 10, 10, 10, 10], [1, 2, 4, 1000, 0, 3], [0, 0]])
def test_targets(spark, documents, stage, sizes):
    names = [f"s{k}" for k in range(len(sizes) - 1)] + [None]
    docs = documents([(100 * k + j, "w " * 1, s) for k, (s, n) in enumerate(zip(names, sizes, strict=True)) for j in range(n)] + [(10**6 + k, "", s) for k, s in enumerate(names)])
    rows = mixture.mixed(docs, stage).collect()
    want = filled(dict(zip(names, sizes, strict=True)), {s: 1 + k % 3 for k, s in enumerate(names)})
    taken = defaultdict(int)
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]], abs=1e-6) and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in names)


def test_plain_form_agrees(spark):
    """The binned form takes what one sort of each source would."""
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    got = mixture.op3_mix_sources(spark, d)
    want = con.sql(mixture.OP3_SQL)
    order = sorted(got.columns)
    assert sorted(tuple(r[c] for c in order) for r in got.collect()) == sorted(want.select(*order).fetchall())


def test_edges(spark, edges, sf_dir):
    d = sf_dir(documents=edges)
    rows = mixture.op3_mix_sources(spark, d).collect()
    assert len(rows) == edges.count()
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixture.op3_mix_sources(spark, d).collect()))


def test_empty(spark, documents, sf_dir):
    assert mixture.op3_mix_sources(spark, sf_dir(documents=documents([]))).count() == 0


def test_junk_is_drawn_less_often(spark, documents, stage):
    text = lambda k: "good words all along " * 3 if k % 2 else "### $$$ %%% &&& *** 999 " * 3
    docs = documents([(k, text(k), f"s{k % 4 // 2}") for k in range(2000)])
    rows = mixture.mixed(docs, stage).where("source = 's0'").collect()
    drawn = [sum(r["copies"] for r in rows if r["doc_id"] % 2 == side) for side in (0, 1)]
    assert drawn[1] == 500 and drawn[0] < 300  # two thirds are taken in all
    assert math.isclose(mixture.measure(docs.limit(1)).select(mixture.quality_weight(F.lit("abc"))).first()[0], 1)


def test_a_row_repeated_very_often(spark, documents, stage):
    """Equal rows are ranked as one, and taken in part."""
    docs = documents([(1, "same words again", "s0")] * 900 + [(k, f"own {k}", "s0") for k in range(2, 60)] + [(100 + k, "w " * 40, "s1") for k in range(300)])
    rows = mixture.mixed(docs, stage).collect()
    assert len(rows) == docs.count()
    for s in ("s0", "s1"):
        mine = [r for r in rows if r["source"] == s]
        assert abs(sum(r["copies"] * r["size"] for r in mine) - mine[0]["target"]) <= 0.5 * max(r["size"] for r in mine)
    assert len({r["copies"] for r in rows if r["doc_id"] == 1}) <= 2
