from __future__ import annotations

import hashlib
import random
import re

import pytest

from gridloom.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        n = min(10, len(b))
        for k in range(len(b) - n + 1) if n else ():
            for p in range(len(w) - n + 1):
                if w[p : p + n] == b[k : k + n]:
                    hit |= set(range(p, p + n))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(4)
    word = lambda: rng.choice(["ab", "Cd", "é1", "xyz", "q", "0"])
    items = [(k, " ".join(word() for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 25])))) for k in range(30)] + [(30, None), (31, ""), (3, "AB cd!é1")]
    texts = [(k, " ".join(word() for _ in range(rng.choice([0, 2, 12, 60])))) for k in range(60)]
    texts += [(100 + k, f"before {t} after, {(t or '').upper()}.") for k, (_, t) in enumerate(items)] + [(200, None), (200, None), (None, "ab cd")]
    return texts, items


def test_against_brute_force(spark, documents, sf_dir, case):
    texts, items = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = dc.op9_decontaminate(spark, sf_dir(documents=documents(texts), benchmark=bench)).collect()
    assert sorted(map(str, (tuple(r) for r in rows))) == sorted(str((i, *brute(t, items))) for i, t in texts)


def test_blocks_of_items_give_the_same(spark, documents, case):
    texts, items = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    cols = ["doc_id", "n_hit", "hit_spans", "hit_items"]
    one, many = (sorted(map(str, dc.find_hits(documents(texts), bench, block_windows=n).select(cols).collect())) for n in (10**6, 60))
    assert one == many


def test_removal(spark, documents):
    passage = " ".join(f"bench{k}" for k in range(12))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    clean = " ".join(f"clean{k}" for k in range(100))
    docs = documents([(1, clean), (2, f"{clean} {passage.upper()}. end"), (3, passage), (4, None), (5, "")])
    got = {r["doc_id"]: r["text"] for r in dc.remove_hits(docs.coalesce(1), bench).collect()}
    assert got == {1: clean, 2: f"{clean} . end", 4: None, 5: ""}


def test_empty_tables_and_extra_columns(spark, documents, edges):
    bench = spark.createDataFrame([(1, "plain words here")], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.find_hits(documents([]), bench).count() == 0
    assert dc.find_hits(edges, none).where("n_hit > 0").count() == 0
    clash = edges.selectExpr("*", "'x' AS n_hit", "1 AS hit_items")
    assert dc.find_hits(clash, bench).where("n_hit = 3").count() == 3
