from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import near_dup as nd
from gridloom.llm.common import components


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def shingles(t, k):
    w = words(t)
    return frozenset(tuple(w[a : a + k]) for a in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(texts, k, percent):
    sets = [shingles(t, k) for _, t in texts]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    low = defaultdict(list)
    for (d, _), x in zip(texts, label, strict=True):
        if d is not None:
            low[x].append(d)
    return sorted(str((d, len(s), (min(low[x], default=None) if s else d))) for (d, _), s, x in zip(texts, sets, label, strict=True))


def near(rng, base, share):
    return " ".join(f"n{rng.random()}" if rng.random() < share else w for w in base.split(" "))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    out = []
    for g in range(12):
        base = " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.choice([20, 60, 200])))
        out += [base] * rng.choice([1, 3]) + [near(rng, base, s) for s in (0.01, 0.02, 0.03, 0.05, 0.05, 0.1)] + [base.upper(), base + "\n extra"]
    out += ["a", "A", "a b", "b a", " a\tb ", "", None, " \n", "a b c", "c b a", "\x00", "\x1c a"]
    out += [" ".join(f"x{k % 700}" for k in range(20_000))] * 2
    rng.shuffle(out)
    return [(3 * k + 1, t) for k, t in enumerate(out)] + [(1, out[0]), (None, out[5]), (None, "alone without an id"), (2, out[9]), (5000, "shared id one"), (5000, "quite another text")]


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_against_brute_force(documents, stage, texts, k, percent):
    rows = nd.near_duplicates(documents(texts), stage, k, percent).collect()
    assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in rows) == brute(texts, k, percent)


def test_large_groups_in_blocks(documents, stage, texts):
    """A tiny limit sends every group through the rounds of queries against blocks."""
    rows = nd.near_duplicates(documents(texts), stage, 3, 85, group=300).collect()
    assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in rows) == brute(texts, 3, 85)


def test_query(spark, documents, sf_dir, texts):
    rows = nd.op5_near_dup(spark, sf_dir(documents=documents(texts))).collect()
    assert len(rows) == len(texts) and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_same_as_sql(spark, documents, sf_dir, texts):
    import duckdb

    for d in ("/root/testdata/sf0.01", sf_dir(documents=documents(texts))):
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet{'' if d.endswith('0.01') else '/*.parquet'}'")
        got, want = nd.op5_near_dup(spark, d), con.sql(nd.OP5_SQL)
        assert got.columns == want.columns
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


def test_empty(documents, stage):
    assert nd.near_duplicates(documents([]), stage, 3, 85).count() == 0
    assert nd.keep_one(documents([]), stage).count() == 0


@pytest.mark.parametrize(("most", "lead", "part"), [(4, 2, 10**6), (4, 2, 8)])
def test_chained_group_and_hot_nodes(documents, stage, most, lead, part):
    """Neighbours in a chain are linked, its ends are not; small nodes, few leaders and split nodes make groups pass all levels. The limits go with the tasks, so workers have them too."""
    w = [f"c{k}" for k in range(400)]
    texts = [(k, " ".join(w[4 * k : 4 * k + 200])) for k in range(40)] + [(100 + k, " ".join(w[:150] + [f"own{k}_{j}" for j in range(200)])) for k in range(40)]
    rows = nd.near_duplicates(documents(texts), stage, 3, 85, most=most, lead=lead, part=part).collect()
    assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in rows) == brute(texts, 3, 85)


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force_with_small_nodes(documents, stage, texts, seed):
    """All limits tiny, on random order."""
    rows = list(texts)
    random.Random(seed).shuffle(rows)
    got = nd.near_duplicates(documents(rows), stage, 3, 85, group=500, most=4, lead=3, part=6).collect()
    assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got) == brute(rows, 3, 85)


def test_copies_beyond_the_hot_limit(documents, stage, texts, monkeypatch):
    from gridloom.llm import common

    monkeypatch.setattr(common, "HOT", 2)
    monkeypatch.setattr(common, "SENT_ROWS", 5)
    rows = nd.near_duplicates(documents(texts + texts[:6] * 5), stage, 3, 85).collect()
    assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in rows) == brute(texts + texts[:6] * 5, 3, 85)


def template_sketches(n, share, rng):
    """Sketches of n records that share a template of that share of their shingles, in pairs that agree in 0.87 of their coordinates; no record is like a third one but for the template."""
    common = rng.integers(0, 256, nd.SKETCH, dtype=np.uint8)
    jaccard = share / (2 - share)
    out = np.where(rng.random((n, nd.SKETCH)) < jaccard, common, rng.integers(0, 256, (n, nd.SKETCH), dtype=np.uint8)).astype(np.uint8)
    for k in range(0, n, 2):
        other = rng.random(nd.SKETCH) >= 0.87
        out[k + 1] = out[k]
        out[k + 1, other] = rng.integers(0, 256, int(other.sum()), dtype=np.uint8)
    return out


@pytest.mark.parametrize(("n", "share", "part"), [(6000, 0.6, 2048), (6000, 0.8, None), (8000, 0.8, 2048)])
def test_recall_under_a_shared_template(spark, stage, n, share, part):
    """Candidate recall of pairs above the threshold where thousands of records share a template, so that popular nodes are large."""
    rng = np.random.default_rng(int(100 * share))
    sk = template_sketches(n, share, rng)
    rows = [(b"%06d" % k, s.tobytes(), [int(x) for x in s[: nd.KEPT]]) for k, s in enumerate(sk)]
    links = nd.candidates(spark.createDataFrame(rows, "fp binary, sk binary, mins array<long>").repartition(8), stage, 85, part=part)
    comps = {int(r["node"]): bytes(r["comp"]) for r in components(stage, links).collect()}
    pairs = [k for k in range(0, n, 2) if (sk[k] == sk[k + 1]).sum() >= 0.85 * nd.SKETCH]
    met = sum(k in comps and comps[k] == comps.get(k + 1) for k in pairs) / len(pairs)
    print(f"n {n}, template {share}, part {part}: {len(pairs)} pairs, recall {met:.4f}, links {links.count()}")
    assert met >= 0.99


def test_group_labels_hold_all_links():
    rng = np.random.default_rng(4)
    base = rng.integers(1, 1 << 60, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate((base[rng.random(300) > 0.06], rng.integers(1, 1 << 60, 8, dtype=np.uint64)))) for _ in range(80)]
    label = nd.group_labels(sets, 85)
    for a in range(80):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                assert label[a] == label[b]


@pytest.mark.parametrize("in_one_task", [0, 50_000])
def test_components(spark, stage, monkeypatch, in_one_task):
    monkeypatch.setattr("gridloom.llm.common.ONE_TASK_EDGES", in_one_task)
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(60)] + [(200, 300), (300, 200), (5, 5)] + [(1000, 1001 + k) for k in range(50)]
    rng.shuffle(edges)
    got = {r["node"]: r["comp"] for r in components(stage, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {200: 200, 300: 200, 1000: 1000} | {1001 + k: 1000 for k in range(50)}


def test_keep_one(documents, stage):
    base = " ".join(f"w{k}" for k in range(100))
    docs = documents([(4, base), (2, base + " end"), (9, base.upper()), (1, "other text of its own"), (7, None), (8, ""), (1, "other text of its own"), (None, base)])
    kept = sorted((str(r["doc_id"]) for r in nd.keep_one(docs.withColumn("component_id", F.lit("x")), stage).collect()))
    assert kept == ["1", "2", "7", "8"]


def test_shingles_follow_the_words():
    texts = ["one two three four", "ONE\ttwo\n three", "one two", "", None, "one two one two one two"]
    sets = nd.shingle_sets(pa.array(texts), 3)
    assert [len(s) for s in sets] == [2, 1, 1, 0, 0, 2]
    assert set(sets[1]) < set(sets[0]) and not set(sets[2]) & set(sets[0])


def test_links_across_leaders_of_a_large_node(spark, stage):
    """x is like leader A, y is like leader B only, and x is like y: in each of its ten roots the pair meets in one large node."""
    least = nd.least_agreement(85)
    sketches = [np.zeros(nd.SKETCH, np.uint8) for _ in range(nd.NODE + 200)]
    x, y, b = (np.zeros(nd.SKETCH, np.uint8) for _ in range(3))
    x[: nd.SKETCH - least] = 1
    y[: nd.SKETCH - least] = 1
    y[nd.SKETCH - least :][:10] = 2
    b[:] = y
    b[-20:] = 3
    sketches[1:4] = [b, x, y]
    agree = lambda p, q: int((sketches[p] == sketches[q]).sum()) >= least
    assert agree(0, 2) and agree(1, 3) and agree(2, 3) and not agree(0, 3) and not agree(0, 1) and not agree(1, 2)
    rows = [(b"%05d" % k, s.tobytes(), list(range(nd.KEPT))) for k, s in enumerate(sketches)]
    links = nd.candidates(spark.createDataFrame(rows, "fp binary, sk binary, mins array<long>").coalesce(1), stage, 85)
    comps = {bytes(r["node"]): r["comp"] for r in components(stage, links).collect()}
    assert len(comps) == len(rows) and len({bytes(c) for c in comps.values()}) == 1
    assert links.count() <= 30 * len(rows)


def test_recall_where_all_roots_are_large(spark, stage):
    """1000 pairs that agree in 54 of 64 coordinates, all in the same ten root nodes: which coordinates differ must not matter."""
    rng = np.random.default_rng(11)
    rows = []
    for p in range(1000):
        x = rng.integers(0, 256, nd.SKETCH, dtype=np.uint8)
        y = x.copy()
        y[rng.permutation(nd.SKETCH)[:10]] ^= 255
        rows += [(b"%05d" % (2 * p + k), s.tobytes(), [0] * 10 + s[10:].tolist()) for k, s in enumerate((x, y))]
    links = nd.candidates(spark.createDataFrame(rows, "fp binary, sk binary, mins array<long>"), stage, 85, most=64, lead=8)
    comps = {int(r["node"]): int(r["comp"]) for r in components(stage, links).collect()}
    assert comps == {k: k - k % 2 for k in range(2000)}
