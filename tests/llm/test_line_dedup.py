from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.llm import line_dedup as ld


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=14), st.lists(st.integers(0, 6), max_size=14))
def test_alignment_is_sound(a, b):
    got = ld.patience(a, b)
    assert all(a[i] == b[j] for i, j in got)
    assert all(i < k and j < n for (i, j), (k, n) in zip(got, got[1:], strict=False))


def test_alignment_of_moved_and_repeated_lines():
    assert ld.patience([1, 2, 3, 4], [1, 2, 9, 3, 4]) == [(0, 0), (1, 1), (2, 3), (3, 4)]
    w = [10] * 8
    assert ld.common_blocks([1, 2, 3, 4, 5, 6, 7, 8], [5, 6, 7, 8, 1, 2, 3, 4], w, 40) == list(range(8))
    assert ld.common_blocks([1, 1, 1, 1], [1, 1, 1, 1], w, 40) == [0, 1, 2, 3]
    assert ld.common_blocks([1, 2, 3, 4], [1, 2, 3, 9, 4], w, 40) == []


def test_blocks_without_an_anchor_and_with_blank_lines():
    w = [20] * 5
    assert ld.common_blocks([8, 1, 2, 9, 1, 2, 7], [5, 1, 2, 6, 4], w, 40) == [1, 2]
    assert ld.common_blocks([8, 1, 2, 7], [1, 2, 5, 1, 2], w, 40) == [0, 1, 3, 4]
    assert ld.common_blocks([1, 2, 3], [1, 0, 2, 0, 3], [20, 0, 20, 0, 20], 40) == [0, 1, 2, 3, 4]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12))
def test_blocks_against_all_runs(a, b):
    words = [7, 20, 40, 3, 11]
    want = set()
    for lo in range(len(b)):
        for hi in range(lo + 1, len(b) + 1):
            if sum(words[x] for x in b[lo:hi]) >= 40 and any(a[i : i + hi - lo] == b[lo:hi] for i in range(len(a))):
                want |= set(range(lo, hi))
    assert ld.common_blocks(a, b, [words[x] for x in b], 40) == sorted(want)


def test_dedup(documents, stage):
    rng = random.Random(2)
    line = lambda n=12: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage, short = [line(20) for _ in range(3)], line(10)
    one_line = line(60)
    own = lambda: [line() for _ in range(3)]
    a, b, c, d = own(), own(), own(), own()
    docs = documents([(5, "\n".join(b + passage + [""])), (1, "\n".join(a + passage)), (7, "\n".join([short] + c)), (8, "\n".join([short] + d)), (9, "\n".join([passage[0], "", passage[1], " " + passage[2] + " "] + [short])), (2, one_line), (6, f"{one_line}\nmine"), (10, None), (11, ""), (None, "\n".join(passage)), (12, "\n".join(a + passage)), (12, "\n".join(a + passage))])
    got = ld.dedup(docs.withColumn("gone", F.lit(1)).withColumn("d_", F.lit(2)).drop("gone", "d_"), stage).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r["text"])
    assert by[1] == ["\n".join(a + passage)] and by[5] == ["\n".join(b + [""])]
    assert by[7] == ["\n".join([short] + c)] and by[8] == ["\n".join([short] + d)]
    assert by[2] == [one_line] and by[6] == ["mine"] and by[10] == [None] and by[11] == [""]
    assert by[None] == [""] and by[12] == ["", ""]
    assert len(got) == 12


def test_first_document_with_the_lines_but_not_the_block(documents, stage):
    """Documents 1 and 2 hold the passage's lines scattered; 3 is the first with the passage, 4 and 5 lose it."""
    p = [" ".join(f"p{k}w{j}" for j in range(14)) for k in range(4)]
    docs = documents([(1, "\n".join([p[3], "x one", p[1], "x two", p[0]])), (2, f"y\n{p[2]}\nz"), (3, "\n".join(["three", *p])), (4, "\n".join(["four", *p, "end"])), (5, "\n".join([*p, "five"]))])
    got = {r["doc_id"]: r["text"] for r in ld.dedup(docs, stage).collect()}
    assert got[3] == "\n".join(["three", *p]) and got[4] == "four\nend" and got[5] == "five"
    assert got[1].count("\n") == 4 and got[2].count("\n") == 2


def test_every_line_stays_somewhere(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = ld.op8_line_dedup(spark, d)
    lines = lambda x: x.select(F.explode(F.split("text", "\n")).alias("l")).select(F.trim("l").alias("l")).distinct()
    assert lines(docs).exceptAll(lines(got)).count() == 0 and got.count() == docs.count()
    assert got.where("n_removed > 0").count() > 0


def test_edges(spark, documents, edges, sf_dir, stage):
    got = ld.op8_line_dedup(spark, sf_dir(documents=edges)).collect()
    assert len(got) == edges.count() and all(r["n_removed"] == 0 for r in got)
    assert ld.dedup(documents([]), stage).count() == 0
    clash = edges.withColumn("n_lines", F.lit("x")).withColumn("line", F.lit("y")).withColumn("words", F.lit(3))
    assert ld.dedup(clash, stage).count() == edges.count()


def kept_plainly(texts, least=40):
    """Lines (but blank ones) that a document keeps, by the definition: it loses those in a run of lines (blank ones aside) of enough words that an earlier document has."""
    docs = sorted(texts)
    full = {d: [k for k, x in enumerate(t.split("\n")) if x.strip()] for d, t in docs}
    lines = {d: [t.split("\n")[k].strip() for k in full[d]] for d, t in docs}
    out = {}
    for n, (d, _) in enumerate(docs):
        mine, gone = lines[d], set()
        for lo in range(len(mine)):
            for hi in range(lo + 1, len(mine) + 1):
                if sum(len(x.split()) for x in mine[lo:hi]) >= least and any(lines[e][i : i + hi - lo] == mine[lo:hi] for e, _ in docs[:n] for i in range(len(lines[e]))):
                    gone |= set(range(lo, hi))
        out[d] = [x for k, x in enumerate(mine) if k not in gone]
    return out


def test_against_brute_force_over_all_pairs(documents, stage):
    rng = random.Random(12)
    pool = [" ".join(f"l{k}w{j}" for j in range(rng.choice([3, 9, 15, 22, 45]))) for k in range(25)]
    texts = []
    for d in range(60):
        part = [rng.choice([*pool, "", " "]) for _ in range(rng.choice([1, 3, 6, 12]))]
        if texts and rng.random() < 0.6:
            old = rng.choice(texts)[1].split("\n")
            at = rng.randrange(len(old))
            part[1:1] = old[at : at + rng.choice([2, 4, 8])]
        texts.append((d, "\n".join(part)))
    got = {r["doc_id"]: [x.strip() for x in r["text"].split("\n") if x.strip()] for r in ld.dedup(documents(texts), stage).collect()}
    assert got == kept_plainly(texts) and sum(map(len, got.values())) < sum(bool(x.strip()) for _, t in texts for x in t.split("\n"))


def test_hot_runs_are_split(documents, stage, monkeypatch):
    """The same whether a run's documents meet in one task or are looked up where they lie."""
    from gridloom.llm import common

    passage = "\n".join(" ".join(f"p{k}w{j}" for j in range(20)) for k in range(3))
    docs = documents([(k, f"own {k}\n{passage}\nend {k}") for k in range(50)] + [(100 + k, "\n".join(f"two {k // 2} {j} " * 8 for j in range(3))) for k in range(40)])
    plain = sorted(map(str, ld.dedup(docs, stage).select("doc_id", "n_removed").collect()))
    monkeypatch.setattr(common, "SENT_ROWS", 3)
    monkeypatch.setattr(common, "HOT", 10)
    assert sorted(map(str, ld.dedup(docs, stage).select("doc_id", "n_removed").collect())) == plain
    assert sum("n_removed=3" in x for x in plain) == 49 + 20
