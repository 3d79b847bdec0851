"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

A document word inside any occurrence of a benchmark window is hit. Windows of the training text are looked up by hash;
each hit is verified on the words themselves. The set is broadcast in blocks of items of a bounded number of windows, so
its size has a proven bound however large the benchmark is: more items mean more passes whose spans are put together.

Nulls: null texts have no words; null item_ids are written as the empty string. Documents without words have no hits.
Repeated rows give repeated results. An empty benchmark hits nothing. Extra columns of the input pass
through; ``find_hits`` replaces those named as the columns it adds (n_words, n_hit, hit_spans, hit_items).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnp
from .common import pieces, read, set_aside, ship

WINDOW = 10
#: Windows in one broadcast block. A window takes 28 bytes in a worker and its items' words about 7 bytes each: some 40 MB.
BLOCK_WINDOWS = 1_000_000
_MASK = np.uint64((1 << 22) - 1)


@dataclass
class Windows:
    """Windows of one length, sorted by hash: where the words of each lie in ``text`` (joined by NUL), and its item."""

    size: int
    hashes: np.ndarray
    first: np.ndarray
    end: np.ndarray
    item: np.ndarray
    text: bytes
    names: list[str]
    marks: np.ndarray | None = field(default=None, repr=False)

    def found(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in h of hashes that the set has, and for each the range of the set's windows of that hash."""
        if self.marks is None:
            self.marks = np.zeros(int(_MASK) + 1, bool)
            self.marks[self.hashes & _MASK] = True
        place = np.flatnonzero(self.marks[h & _MASK])
        lo, hi = np.searchsorted(self.hashes, h[place], "left"), np.searchsorted(self.hashes, h[place], "right")
        return place[hi > lo], lo[hi > lo], hi[hi > lo]

    def items(self, lo: int, hi: int, words: bytes) -> list[str]:
        """Items of those windows whose words are these."""
        return [self.names[self.item[k]] for k in range(lo, hi) if self.text[self.first[k] : self.end[k]] == words]


def _item_windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """From rows (item_id, text): rows (item, size, hashes, starts, words) of the items that have words. starts: of each word, and the end, in words."""
    table = textnp.alnum_table()
    for b in pieces(batches):
        h, first, end, at = textnp.words(b.column(1), table)
        raw, _ = textnp.text_bytes(b.column(1))
        rows = []
        for name, p, q in zip(b.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
            if q > p:
                size = min(window, q - p)
                words = b"\0".join(w for w in table[raw[first[p] : end[q - 1]]].tobytes().split(b"\0") if w)
                rows.append((name or "", size, textnp.windows(h[p:q], size).view(np.int64), np.concatenate(([0], np.cumsum(end[p:q] - first[p:q] + 1))), words))
        kinds = {"item": pa.string(), "size": pa.int32(), "hashes": pa.list_(pa.int64()), "starts": pa.list_(pa.int64()), "words": pa.binary()}
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], names=list(kinds))


def _item_blocks(items: DataFrame, window: int, most: int) -> Iterator[list[Windows]]:
    """The benchmark as blocks of about ``most`` windows. The cluster takes the items apart; the driver holds one block."""
    ship(items.sparkSession)
    rows = items.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(lambda x: _item_windows(x, window), "item string, size int, hashes array<long>, starts array<long>, words binary")
    held: dict[int, list] = {}
    n = 0
    for row in rows.toLocalIterator(prefetchPartitions=False):
        h, starts = np.array(row["hashes"], np.int64).view(np.uint64), np.array(row["starts"], np.int64)
        for k in range(0, len(h), most):  # an item longer than a block goes in parts
            part = h[k : k + most]
            held.setdefault(row["size"], []).append((row["item"], part, starts[k : k + len(part) + row["size"]], bytes(row["words"])))
            n += len(part)
            if n >= most:
                yield _packed(held)
                held, n = {}, 0
    if n:
        yield _packed(held)


def _packed(held: dict[int, list]) -> list[Windows]:
    out = []
    for size, found in held.items():
        base = np.cumsum([0, *(starts[-1] - starts[0] for _, _, starts, _ in found)])
        text = b"".join(words[starts[0] : starts[-1] - 1] + b"\0" for _, _, starts, words in found)
        hashes = np.concatenate([h for _, h, _, _ in found])
        first = np.concatenate([starts[: len(h)] - starts[0] + b for (_, h, starts, _), b in zip(found, base, strict=False)])
        end = np.concatenate([starts[size : size + len(h)] - 1 - starts[0] + b for (_, h, starts, _), b in zip(found, base, strict=False)])
        item = np.repeat(np.arange(len(found), dtype=np.int32), [len(h) for _, h, _, _ in found])
        order = np.argsort(hashes, kind="stable")
        out.append(Windows(size, hashes[order], first[order], end[order], item[order], text, [x[0] for x in found]))
    return out


def _scan(text: pa.Array, block: list[Windows]) -> tuple[list[list[int]], list[list[str]], np.ndarray]:
    """For each text: flat [first, end) spans of hit words, counted in the text, items that occur, number of words."""
    table = textnp.alnum_table()
    h, first, end, at = textnp.words(text, table)
    raw, _ = textnp.text_bytes(text)
    spans: list[list[int]] = [[] for _ in range(len(text))]
    items: list[list[str]] = [[] for _ in range(len(text))]
    for known in block:
        size = known.size
        if len(h) < size:
            continue
        place, lo, hi = known.found(textnp.windows(h, size))
        row = np.searchsorted(at, place, "right") - 1
        whole = place + size <= at[row + 1]
        for p, r, a, z in zip(place[whole].tolist(), row[whole].tolist(), lo[whole].tolist(), hi[whole].tolist(), strict=True):
            hit = known.items(a, z, b"\0".join(table[raw[first[k] : end[k]]].tobytes() for k in range(p, p + size)))
            if hit:
                own = p - int(at[r])
                if spans[r] and spans[r][-1] >= own > spans[r][-2]:
                    spans[r][-1] = max(spans[r][-1], own + size)
                else:
                    spans[r] += [own, own + size]
                items[r] += hit
    return spans, [sorted(set(x)) for x in items], np.diff(at)


def _union(spans: list[int]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS, keep: list[str] | None = None) -> DataFrame:
    """The columns keep (default: all) of each row of docs and its n_words, n_hit, hit_spans (flat first and end word numbers) and hit_items (item_ids as strings)."""
    spark = docs.sparkSession
    ship(spark)
    new = {"n_words": "long", "n_hit": "long", "hit_spans": "array<int>", "hit_items": "array<string>"}
    docs = docs.drop(*new)
    keep = docs.columns if keep is None else keep
    out = docs.withColumns({c: F.lit(None).cast(kind) for c, kind in new.items()})
    blocks = _item_blocks(benchmark, window, block_windows)
    block = next(blocks, [])
    while block is not None:
        following = next(blocks, None)
        names = [*(docs.columns if following is not None else keep), *new]
        shared = spark.sparkContext.broadcast(block)

        def look(batches: Iterator[pa.RecordBatch], shared=shared, names=names) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches):
                cols = dict(zip(b.schema.names, b.columns, strict=True))
                spans, items, count = _scan(cols["text"], shared.value)
                spans = [_union((x or []) + y) for x, y in zip(cols["hit_spans"].to_pylist(), spans, strict=True)]
                items = [sorted({*(x or ()), *y}) for x, y in zip(cols["hit_items"].to_pylist(), items, strict=True)]
                cols |= {"n_words": pa.array(count, pa.int64()), "n_hit": pa.array([sum(s[1::2]) - sum(s[::2]) for s in spans], pa.int64())}
                cols |= {"hit_spans": pa.array(spans, pa.list_(pa.int32())), "hit_items": pa.array(items, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([cols[c] for c in names], names=names)

        out = out.mapInArrow(look, out.select(names).schema)
        block = following
    return out


def remove_hits(docs: DataFrame, benchmark: DataFrame, most_hit: float = 0.2, window: int = WINDOW) -> DataFrame:
    """The rows of docs without what benchmark windows cover: hit spans go from the text, and a document whose words are hit in a larger share than most_hit goes whole."""
    schema = docs.schema
    docs, back = set_aside(docs, ["n_words", "n_hit", "hit_spans", "hit_items"])
    hits = find_hits(docs, benchmark, window)
    cols = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = textnp.alnum_table()
        for b in pieces(batches):
            text = b.column(b.schema.get_field_index("text"))
            spans = b.column(b.schema.get_field_index("hit_spans")).to_pylist()
            new = text.to_pylist()
            for r, s in enumerate(spans):
                if s:
                    raw = new[r].encode()
                    _, first, end, _ = textnp.words(pa.array([raw], pa.large_binary()), table)
                    keep, at = [], 0
                    for a, z in zip(s[::2], s[1::2], strict=True):
                        keep.append(raw[at : first[a]])
                        at = int(end[z - 1])
                    new[r] = b"".join([*keep, raw[at:]]).decode()
            arrays = [pa.array(new, pa.string()) if c == "text" else b.column(b.schema.get_field_index(c)) for c in cols]
            yield pa.RecordBatch.from_arrays(arrays, names=cols)

    return hits.where(F.col("n_hit") <= most_hit * F.col("n_words")).mapInArrow(cut, docs.schema).withColumnsRenamed(back).select(schema.names)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    hits = find_hits(docs, read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return hits.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS q, coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, k, n, array_to_string(w[k : k + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT r, k, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
n_hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hit USING (r) LEFT JOIN items USING (r)
"""
