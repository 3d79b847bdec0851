from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa

from gridloom.llm import line_quality as lq


def test_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5):
        unary, pairs = rng.normal(size=n), rng.normal(size=(2, 2))
        weight = {y: np.exp(sum(u * v for u, v in zip(unary, y, strict=True)) + sum(pairs[a, b] for a, b in zip(y, y[1:], strict=False))) for y in itertools.product((0, 1), repeat=n)}
        total = sum(weight.values())
        p, both = lq.marginals(unary[:, None], np.ones((n, 1), bool), pairs)
        assert np.allclose(p[:, 0], [sum(w for y, w in weight.items() if y[k]) / total for k in range(n)])
        want = np.zeros((2, 2))
        for y, w in weight.items():
            for a, b in zip(y, y[1:], strict=False):
                want[a, b] += w / total
        assert np.allclose(both, want)


def test_marginals_of_unequal_lengths():
    rng = np.random.default_rng(2)
    pairs, cols = rng.normal(size=(2, 2)), [rng.normal(size=n) for n in (4, 1, 3)]
    unary, held = np.zeros((4, 3)), np.zeros((4, 3), bool)
    for k, c in enumerate(cols):
        unary[: len(c), k], held[: len(c), k] = c, True
    p, _ = lq.marginals(unary, held, pairs)
    for k, c in enumerate(cols):
        alone, _ = lq.marginals(c[:, None], np.ones((len(c), 1), bool), pairs)
        assert np.allclose(p[: len(c), k], alone[:, 0])


def test_lines():
    texts = ["ab\n\ncd ", None, "", "\n\n", "é", "x\n", "last one"]
    f, size, row = lq.lines(pa.array(texts))
    assert size.tolist() == [2, 3, 2, 1, 8] and row.tolist() == [0, 0, 4, 5, 6]
    assert f.shape == (5, 3 * lq._OWN + 2)
    assert (f[1, lq._OWN : 2 * lq._OWN] == f[0, : lq._OWN]).all() and (f[0, lq._OWN : 2 * lq._OWN] == 0).all()


def test_accuracy_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in lq.op7_line_quality(spark, d).collect()}
    labels = spark.read.parquet(f"{d}/labels.parquet").collect()
    held = [(rows[r["doc_id"]]["predicted"], r["quality"]) for r in labels if rows[r["doc_id"]]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.93
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows.values())


def test_edges_and_no_labels(spark, edges, sf_dir):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = lq.op7_line_quality(spark, sf_dir(documents=edges, labels=none)).collect()
    assert len(rows) == edges.count() and all(r["score"] == 0.5 and r["predicted"] == 1 for r in rows)


def test_null_labels_and_clashing_columns(spark, documents, edges):
    labels = spark.createDataFrame([(1, None), (5, 1), (6, 0), (None, 1), (777, 0), (5, 0)], "doc_id long, quality int")
    field = lq.train(edges, labels)
    got = lq.score(edges.selectExpr("*", "'x' AS score"), field)
    assert got.count() == edges.count() and dict(got.dtypes)["score"] == "double"
    assert all(0 <= r["score"] <= 1 for r in got.collect())
    assert lq.score(documents([]), field).count() == 0


def test_score_looks_at_the_text_alone(spark, documents):
    texts = ["good words in a row.", "$$$ %%% ### &&&", None]
    field = lq.fit(*lq.lines(pa.array(texts)), np.array([1, 0, 1]))
    a, lines, good = lq.quality(field, pa.array(texts))
    b = lq.quality(field, pa.array(texts[::-1]))[0][::-1]
    assert lines.tolist() == [1, 1, 0] and (good <= lines).all()
    assert np.allclose(a, b)


def test_lines_take_labels_of_their_own():
    """Bad documents hold a good line: it gets the other label, and the field marks it good within a document that stays bad."""
    good = ["many plain words stand here in a row.", "and here some more of them, as before."]
    bad = ["$$$ %%% ### &&& 000 111 222 333 444 555 @@@", "### 999 === 888 *** 777 ^^^ 666 ~~~ 555 ||| 4"]
    texts = ["\n".join(good * 3), "\n".join(bad * 3)] * 20 + ["\n".join([*bad * 3, good[0], *bad * 2])] * 6
    label = np.array([1, 0] * 20 + [0] * 6)
    f, size, row = lq.lines(pa.array(texts))
    y = label[row].astype(float)
    alone = lq._ascend(f, row, y, np.zeros(f.shape[1] + 4), 300, alone=True)
    got = lq.line_labels(f, size.astype(float), row, y, alone[:-4])
    turned = np.flatnonzero(got != y)
    assert all((texts[r].split("\n")[np.flatnonzero(row == r).searchsorted(k)] in good) for k in turned.tolist() for r in [int(row[k])])
    whole = np.bincount(row, size)
    assert all(size[turned[row[turned] == r]].sum() <= lq.MIXED * whole[r] for r in np.unique(row[turned]))
    scores, _, _ = lq.quality(lq.fit(f, size.astype(float), row, label), pa.array(texts))
    assert ((scores >= 0.5) == label).all()
