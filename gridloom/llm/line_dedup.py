"""Line dedup by pairwise alignment.

Runs of lines that two documents share, each as short as can hold a block of BLOCK_WORDS words, bring them together; patience
diff aligns the pair; aligned blocks of at least BLOCK_WORDS words are deleted from the later document (by doc_id). A document is
held against the earliest document that has the run, for each of its runs, so the pairs are at most as many as there are shared
runs, and a run in every document costs one pair a document. Each line of a block is in such a run within the block, so the
earliest document with the block, or with that part of it, is always a partner. Blank lines do not count. A run that very many
documents have is looked up where they lie. Lines are equal if 128 bits of hash are.

A line's first document never loses it, so some copy of every line stays. Null texts have no lines and stay null. Rows that
share doc_id and text are one document; rows with a null doc_id come last. An empty table gives none. Extra columns
pass; columns named n_lines or n_removed are replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Stage, join_split, pieces, read, ship, text_key

#: Words that an aligned block must have to be deleted.
BLOCK_WORDS = 40
#: Documents that lose lines, up to which their keys (16 bytes each) are broadcast.
KEYS = 100_000
_LAST = (1 << 63) - 1


def _chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs (sorted by the first) whose second places rise."""
    tails: list[int] = []
    tops: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        back.append(tops[at - 1] if at else -1)
        if at == len(tails):
            tails.append(j)
            tops.append(k)
        else:
            tails[at], tops[at] = j, k
    out, k = [], tops[-1] if tops else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places (i, j) with a[i] == b[j], both rising: lines that are once on either side anchor, and equal neighbours join them, level by level."""
    out, work = [], [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        at: dict = {}
        for i in range(a0, a1):
            at[a[i]] = -1 if a[i] in at else i
        on: dict = {}
        for j in range(b0, b1):
            on[b[j]] = -1 if b[j] in on else j
        anchors = _chain(sorted((i, on[x]) for x, i in at.items() if i >= 0 and on.get(x, -1) >= 0))
        if anchors:
            ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            out += anchors
            work += [(i + 1, k, j + 1, n) for (i, j), (k, n) in zip(ends, ends[1:], strict=False) if k - i > 1 and n - j > 1]
    return sorted(out)


def block_runs(words: list[int], least: int) -> set[tuple[int, int]]:
    """The shortest runs (from, to) of at least ``least`` words from each place on and up to each place. Each place of a longer run is in one of these that lies within it."""
    out, lo, hi, n = set(), 0, 0, 0
    for lo in range(len(words)):
        while hi < len(words) and n < least:
            n += words[hi]
            hi += 1
        if n < least:
            break
        out.add((lo, hi))
        n -= words[lo]
    lo = n = 0
    for hi in range(len(words)):
        n += words[hi]
        while n - words[lo] >= least:
            n -= words[lo]
            lo += 1
        if n >= least:
            out.add((lo, hi + 1))
    return out


def _unanchored(a: list, b: list, words: list[int], least: int) -> list[tuple[int, int]]:
    """The shortest runs of b that a has too."""
    of, mine, part = dict(zip(b, words, strict=True)), set(), []
    for x in [*a, None]:
        if x in of:
            part.append(x)
        elif part:
            mine.update(tuple(part[lo:hi]) for lo, hi in block_runs([of[y] for y in part], least))
            part = []
    return [(lo, hi) for lo, hi in block_runs(words, least) if tuple(b[lo:hi]) in mine]


def common_blocks(a: list, b: list, words: list[int], least: int = BLOCK_WORDS) -> list[int]:
    """Lines of b that lie in blocks of at least ``least`` words which a (without blank lines) has too. Blank lines, those of no words, part no block, and go with the block they are in. What is moved
    about is found by aligning again without the lines already found; what repeats, and so has no line to anchor it, by its runs."""
    full = [j for j in range(len(b)) if words[j]]
    lines, size = [b[j] for j in full], [words[j] for j in full]
    left, blocks = list(lines), []
    while True:
        block: list[tuple[int, int]] = []
        found: list[tuple[int, int]] = []
        for i, j in [*patience(a, left), (-9, -9)]:
            if block and (i, j) != (block[-1][0] + 1, block[-1][1] + 1):
                if sum(size[y] for _, y in block) >= least:
                    found.append((block[0][1], block[-1][1] + 1))
                block = []
            block.append((i, j))
        if not found:
            break
        blocks += found
        for lo, hi in found:
            for y in range(lo, hi):
                left[y] = ("gone", y)
    blocks += _unanchored(a, lines, size, least)
    gone = bytearray(len(b))
    for lo, hi in blocks:
        gone[full[lo] : full[hi - 1] + 1] = b"\1" * (full[hi - 1] + 1 - full[lo])
    return [j for j, x in enumerate(gone) if x]


def with_lines(docs: DataFrame) -> DataFrame:
    """Rows (d, h, line, more, words): document, and its lines as hashes of the trimmed line with their numbers of words (0: blank). line and more are 128 bits that name a line."""
    rows = F.transform(F.split("text", "\n", -1), lambda x: F.struct(F.xxhash64(F.trim(x)).alias("line"), F.xxhash64(F.lit(1), F.trim(x)).alias("more"), F.coalesce(F.regexp_count(x, F.lit(WORD)), F.lit(0)).alias("words")))
    out = docs.where("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("d"), text_key(F.col("text")).alias("h"), rows.alias("rows"))
    return out.select("d", "h", F.col("rows.line").alias("line"), F.col("rows.more").alias("more"), F.col("rows.words").alias("words"))


def keyed(lined: DataFrame, least: int = BLOCK_WORDS) -> DataFrame:
    """Rows (d, h, keys): hashes of the document's shortest runs of non-blank lines that can hold a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in pieces(batches):
            keys = []
            for line, words in zip(x.column(2).to_pylist(), x.column(3).to_pylist(), strict=True):
                full = [k for k, n in enumerate(words) if n]
                lines = [line[k] for k in full]
                keys.append(list({hash(tuple(lines[lo:hi])) for lo, hi in block_runs([words[k] for k in full], least)}))
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(keys, pa.list_(pa.int64()))], names=["d", "h", "keys"])

    return lined.select("d", "h", "line", "words").mapInArrow(run, "d long, h long, keys array<long>")


def pairs(keys: DataFrame, stage: Stage) -> DataFrame:
    """Pairs (d1, h1, d2, h2) of a document of keys(d, h, keys) and the earliest that has one of its keys, if that is another."""
    each = keys.select("d", "h", F.explode("keys").alias("key"))
    firsts = each.groupBy("key").agg(F.min(F.struct("d", "h")).alias("first"), F.max(F.struct("d", "h")).alias("last"), F.count("*").alias("n")).where("first <> last").select(F.col("key").alias("k"), "first", "n")
    shared = join_split(each, stage.put(firsts), "key", "k", "n").where("first < struct(d, h)")
    return shared.select(F.col("first.d").alias("d1"), F.col("first.h").alias("h1"), F.col("d").alias("d2"), F.col("h").alias("h2")).distinct()


def removals(docs: DataFrame, stage: Stage, least: int = BLOCK_WORDS) -> DataFrame:
    """Rows (d, h, gone): the numbers of the lines that a document loses."""
    ship(docs.sparkSession)
    lined = stage.put(with_lines(docs).dropDuplicates(["d", "h"]))
    keys = stage.put(keyed(lined, least))
    both = stage.put(pairs(keys, stage))
    stage.drop(keys)
    full = lambda c: F.filter(c, lambda x, k: F.get("words", k) > 0)
    one = lined.select(F.col("d").alias("d1"), F.col("h").alias("h1"), full("line").alias("a"), full("more").alias("a_more"))
    two = lined.select(F.col("d").alias("d2"), F.col("h").alias("h2"), F.col("line").alias("b"), F.col("more").alias("b_more"), F.col("words"))
    rows = both.join(one, ["d1", "h1"]).join(two, ["d2", "h2"]).select("d2", "h2", "a", "a_more", "b", "b_more", "words")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in pieces(batches):
            d, h, a, a_more, b, b_more, w = (c.to_pylist() for c in x.columns)
            named = ((list(zip(p, q, strict=True)), list(zip(r, s, strict=True)), n) for p, q, r, s, n in zip(a, a_more, b, b_more, w, strict=True))
            gone = [common_blocks(*r, least) for r in named]
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(h, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], names=["d", "h", "gone"])

    found = rows.mapInArrow(align, "d long, h long, gone array<int>").where("size(gone) > 0")
    out = stage.put(found.groupBy("d", "h").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone")))
    stage.drop(lined, both)
    return out


def dedup(docs: DataFrame, stage: Stage, least: int = BLOCK_WORDS) -> DataFrame:
    """docs with text without the deleted lines, n_lines and n_removed."""
    found = removals(docs, stage, least).withColumnsRenamed({"d": "gl_d", "h": "gl_h", "gone": "gl_gone"})
    cols = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    docs = docs.select(cols)
    mine = (F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)) == F.col("gl_d")) & (text_key(F.col("text")) == F.col("gl_h"))
    if found.limit(KEYS + 1).count() <= KEYS:  # texts that lose nothing stay where they are
        keys = F.broadcast(found.select("gl_d", "gl_h"))
        rows = docs.join(keys, mine, "left_semi").join(found, mine, "left").drop("gl_d", "gl_h")
        rows = rows.unionByName(docs.join(keys, mine, "left_anti").withColumn("gl_gone", F.lit(None).cast("array<int>")))
    else:
        rows = docs.join(found, mine, "left").drop("gl_d", "gl_h")
    rows = rows.withColumns({"n_lines": F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long"), "n_removed": F.coalesce(F.size("gl_gone"), F.lit(0)).cast("long")})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            gone, text = b.column(b.schema.get_field_index("gl_gone")).to_pylist(), b.column(b.schema.get_field_index("text"))
            new = text.to_pylist() if any(gone) else text
            for r, g in enumerate(gone):
                if g:
                    drop = set(g)
                    new[r] = "\n".join(x for k, x in enumerate(new[r].split("\n")) if k not in drop)
            arrays = [(pa.array(new, pa.string()) if any(gone) else text) if c == "text" else b.column(b.schema.get_field_index(c)) for c in b.schema.names if c != "gl_gone"]
            yield pa.RecordBatch.from_arrays(arrays, names=[c for c in b.schema.names if c != "gl_gone"])

    return rows.mapInArrow(cut, rows.drop("gl_gone").schema)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read(spark, sf_dir, "documents").select("doc_id", "text"), Stage(spark, "op8")).select("doc_id", "n_lines", "n_removed", "text")
