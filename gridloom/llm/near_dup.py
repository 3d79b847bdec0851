"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its distinct word shingles. Sets that are equal are one record, so that a group of exact copies,
however large, costs one aggregate. In each of TREES independent trees a record goes to the nodes named by the minwise
values of chosen coordinates. Small nodes are compared exhaustively by sketches of 64 minwise bytes. A node of more than NODE
records first compares each with leaders it picks; one of more than PART is dealt over several tasks, which share leaders. Then, by the components of all links so far, it is done if it lies in one;
if at most NODE records are outside its largest component, those are held against all others; else all its records branch on,
by further coordinates, to the next level. What shares a node of the last level is one candidate group.
Candidates only say what to look at: their connected groups are then taken by their full sets, and a link holds if
100 * intersection >= percent * union. A pair at a threshold of 0.85 shares a root with 0.85, and if nodes stay large all the way
down a shared root brings it together with over 0.96 (p = 1 - (1 - 0.85 p)^2); the ten roots branch by coordinates of their own
(the first 20 and the next 20 are distinct), so it meets with a probability of over 0.9999, and passes the sketch test, set 4.5
standard deviations lower, with 0.9999.

Scale: what is shuffled per record is a 16-byte name and its 64-byte sketch, ten times. Nothing is emitted by pairs within a
group: a large node gives each record one row, with a link to a leader if it is like one, and the leaders' joins; a group's
members are linked through pivots (see ``verify``). Groups of more than GROUP shingles are verified in blocks, against a bounded
number of query records a round. Copies of one set beyond a thousand get their label where they lie.

Null, empty and word-less texts have an empty set and are linked with nothing. Rows with a null doc_id take part in links and
get their component's smallest id. Repeated rows are in one component. An empty table gives none. Extra columns do no harm.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stage, components, join_split, pieces, read, runs, ship, small, text_key
from .textnp import mix, white_table, windows, words

SKETCH = 64
#: Coordinates kept in full: the roots, two for each tree. Deeper levels branch by the sketch bytes of the others.
TREES, BRANCH, LEVELS = 5, 2, 7
KEPT = ROOTS = TREES * BRANCH
NODE = 512
LEADERS = 256
#: Records of a node that one task takes; a node of more is dealt over several.
PART = 2048
#: Records of a large node that one task holds against those outside its largest component.
BLOCK = 4096
#: Shingles of a group that one task verifies; larger groups go in blocks of about so many.
GROUP = 4_000_000
#: Records of a larger group that are held against all its blocks in the first round; four times as many in each next one, up to the second number.
QUERIES, MOST_QUERIES = 64, 4096

_RNG = np.random.default_rng(20240607)
_XOR = _RNG.integers(0, 1 << 63, SKETCH, dtype=np.uint64)
_ODD = _RNG.integers(0, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_agreement(percent: int) -> int:
    """Agreeing sketch bytes that a pair at the threshold has but for 4.5 standard deviations."""
    j = percent / 100
    return max(1, int(SKETCH * j - 4.5 * (SKETCH * j * (1 - j)) ** 0.5))


def shingle_sets(col: pa.Array, k: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes; a text of fewer than k words, but not none, has its whole sequence as one."""
    h, _, _, at = words(col, white_table())
    every = windows(h, k)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        out.append(np.unique(every[a : b - k + 1]) if b - a >= k else windows(h[a:b], b - a) if b > a else h[:0])
    return out


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """Minwise values (set, coordinate) of non-empty sets."""
    out = np.empty((len(sets), SKETCH), np.uint64)
    lo = 0
    while lo < len(sets):
        hi, n = lo + 1, len(sets[lo])
        while hi < len(sets) and n + len(sets[hi]) <= 1 << 17:
            n += len(sets[hi])
            hi += 1
        x = np.concatenate(sets[lo:hi])
        at = np.cumsum([0, *map(len, sets[lo : hi - 1])])
        for c in range(SKETCH):
            out[lo:hi, c] = np.minimum.reduceat((x ^ _XOR[c]) * _ODD[c], at)
        lo = hi
    return out


def sketch_bytes(values: np.ndarray) -> np.ndarray:
    return (mix(values) & np.uint64(255)).astype(np.uint8)


def name_of(s: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return struct.pack("<QQ", int(mix(s).sum(dtype=np.uint64)) ^ len(s), int(mix(s ^ np.uint64(0x5DEECE66D1234567)).sum(dtype=np.uint64)))


def digest(docs: DataFrame, k: int) -> DataFrame:
    """Rows (doc_id, h, n_shingles, fp, sk, mins) of docs(doc_id, text): fp names the set; sk is its sketch, mins the coordinates to branch on."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            sets = shingle_sets(b.column(2), k)
            full = [r for r, s in enumerate(sets) if len(s)]
            values = minwise([sets[r] for r in full]) if full else np.zeros((0, SKETCH), np.uint64)
            sk = sketch_bytes(values)
            fp, sks, mins = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            for j, r in enumerate(full):
                fp[r], sks[r], mins[r] = name_of(sets[r]), sk[j].tobytes(), values[j, :KEPT].view(np.int64)
            arrays = [b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp, pa.binary()), pa.array(sks, pa.binary()), pa.array(mins, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "h", "n_shingles", "fp", "sk", "mins"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("h"), "text").mapInArrow(run, "doc_id long, h long, n_shingles long, fp binary, sk binary, mins array<long>")


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Agreeing bytes of each row of a with each of b; work in blocks."""
    out = np.empty((len(a), len(b)), np.uint8)
    for k in range(0, len(a), 256):
        out[k : k + 256] = (a[k : k + 256, None, :] == b[None, :, :]).sum(2, dtype=np.uint8)
    return out


def _linked(near: np.ndarray) -> np.ndarray:
    """Smallest member of each row's connected group in a symmetric matrix."""
    label = np.arange(len(near))
    for k in range(len(near)):
        if label[k] != k:
            continue
        front = np.array([k])
        seen = np.zeros(len(near), bool)
        seen[k] = True
        while len(front):
            new = near[front].any(0) & ~seen
            seen |= new
            front = np.flatnonzero(new)
        label[seen] = k
    return label


def _sketches(x: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(x.column("sk").to_pylist()), np.uint8).reshape(-1, SKETCH)


def _link_batch(a: list, b: list, node: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(node, pa.int64())], names=["a", "b", "node"])


class _Leaders:
    """Up to ``lead`` records of a large node that are like none before them, and which of them are joined already."""

    def __init__(self, least: int, lead: int) -> None:
        self.least, self.lead = least, lead
        self.names: list[bytes] = []
        self.comp: list[int] = []
        self.sk = np.zeros((0, SKETCH), np.uint8)

    def take(self, fps: list[bytes], sk: np.ndarray) -> tuple[list, list[tuple[bytes, bytes]]]:
        """For each record the leader that it is like, if any, and the pairs of leaders that this joins. A record goes to the first leader it is like, and joins the others it is like to that one, unless they are; a record like none leads, if there is room."""
        joined: list[tuple[bytes, bytes]] = []
        mine = np.full(len(fps), -1)

        def join(x: int, y: int) -> None:
            old, new = self.comp[x], self.comp[y]
            if old != new:
                joined.append((self.names[x], self.names[y]))
                self.comp[:] = [new if c == old else c for c in self.comp]

        if self.names:
            like = _agree(sk, self.sk) >= self.least
            for r in np.flatnonzero(like.any(1)).tolist():
                found = np.flatnonzero(like[r]).tolist()
                mine[r] = found[0]
                for x in found[1:]:
                    join(x, found[0])
        while (mine < 0).any() and len(self.names) < self.lead:
            r, k = int(np.argmax(mine < 0)), len(self.names)
            self.names.append(fps[r])
            self.comp.append(k)
            self.sk = np.concatenate((self.sk, sk[r : r + 1]))
            near = (sk == sk[r]).sum(1) >= self.least
            for x in np.unique(mine[near & (mine >= 0)]).tolist():
                join(x, k)
            mine[near & (mine < 0)] = k
        return [self.names[k] if k >= 0 else None for k in mine.tolist()], joined

    def rows(self, fps: list[bytes], sk: np.ndarray, node: int) -> pa.RecordBatch:
        """A row (a, b, node) for each record, b its leader unless it leads itself, and a link (a, b, null) for each two leaders it joins."""
        of, joined = self.take(fps, sk)
        return _link_batch([x for x, _ in joined] + fps, [y for _, y in joined] + [None if x == y else y for x, y in zip(fps, of, strict=True)], [None] * len(joined) + [node] * len(fps))


def _part_rows(batches: Iterator[pa.RecordBatch], least: int, lead: int) -> Iterator[pa.RecordBatch]:
    """As ``_node_rows`` for a part of a split node: rows (part, own, node, fp, sk) sorted by part and own; those with own = false come first, are the same in all parts of the node, and give the leaders."""
    for t in runs(batches, "part"):
        part, own, node = t.column("part").to_numpy(), t.column("own").to_pylist(), t.column("node").to_numpy()
        fps, sk = t.column("fp").to_pylist(), _sketches(t)
        cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            mid = lo + own[lo:hi].count(False)
            leaders = _Leaders(least, lead)
            if mid > lo:
                of, joined = leaders.take(fps[lo:mid], sk[lo:mid])
                both = joined + [(x, y) for x, y in zip(fps[lo:mid], of, strict=True) if y not in (None, x)]
                yield _link_batch([x for x, _ in both], [y for _, y in both], [None] * len(both))
            if hi > mid:
                yield leaders.rows(fps[mid:hi], sk[mid:hi], int(node[lo]))


def _node_rows(batches: Iterator[pa.RecordBatch], least: int, most: int, lead: int) -> Iterator[pa.RecordBatch]:
    """From rows (node, fp, sk) sorted by node: links (a, b, null), and for each record of a node of more than ``most`` a row (a, b, node), b the leader (of up to ``lead``) that it is like, if any."""
    leaders = _Leaders(least, lead)

    def whole(t: pa.Table) -> Iterator[pa.RecordBatch]:
        node = t.column("node").to_numpy()
        cut = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1], [True])))
        size = np.diff(cut)
        if not (size > 1).any():
            return
        sk, fps = _sketches(t), t.column("fp").to_pylist()
        a, b = [], []
        two = cut[:-1][size == 2]
        for k in two[(sk[two] == sk[two + 1]).sum(1) >= least].tolist():
            a.append(fps[k])
            b.append(fps[k + 1])
        for lo, hi in zip(cut[:-1][size > 2].tolist(), cut[1:][size > 2].tolist(), strict=True):
            if hi - lo > most:
                yield _Leaders(least, lead).rows(fps[lo:hi], sk[lo:hi], int(node[lo]))
                continue
            label = _linked(_agree(sk[lo:hi], sk[lo:hi]) >= least)
            for k in np.flatnonzero(label != np.arange(hi - lo)).tolist():
                a.append(fps[lo + k])
                b.append(fps[lo + int(label[k])])
        yield _link_batch(a, b, [None] * len(a))

    held: list[pa.RecordBatch] = []
    open_node: int | None = None  # of a large node whose rows are still coming
    for batch in batches:
        if not batch.num_rows:
            continue
        node = batch.column("node").to_numpy()
        if open_node is not None:
            n = int(np.searchsorted(node, open_node, "right")) if node[0] == open_node else 0
            if n:
                part = batch.slice(0, n)
                yield leaders.rows(part.column("fp").to_pylist(), _sketches(part), open_node)
            if n == len(node):
                continue
            open_node, batch, node = None, batch.slice(n), node[n:]
        if held and held[-1].column("node")[0].as_py() != node[0]:
            yield from whole(pa.Table.from_batches(held))
            held = []
        last = int(np.searchsorted(node, node[-1]))
        if last:
            yield from whole(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = []
        held.append(batch.slice(last))
        if sum(x.num_rows for x in held) > most:
            open_node, leaders = int(node[-1]), _Leaders(least, lead)
            t = pa.Table.from_batches(held)
            yield leaders.rows(t.column("fp").to_pylist(), _sketches(t), open_node)
            held = []
    if held:
        yield from whole(pa.Table.from_batches(held))


def _outside_rows(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) from rows (part, big, fp, sk) sorted by part and big: the records with big = false, which are few, against each other and all the rest, at most one link for each two groups of them and one for a group and the rest."""
    part = None
    few: list[bytes] = []
    few_sk = np.zeros((0, SKETCH), np.uint8)
    open_: np.ndarray | None = None  # groups of the few that are not linked to the rest; None before the rest has begun
    label = np.zeros(0, int)
    for batch in batches:
        parts, big = batch.column("part").to_numpy(), batch.column("big").to_numpy(zero_copy_only=False)
        fps, sk = batch.column("fp").to_pylist(), _sketches(batch)
        cut = np.flatnonzero(np.concatenate(([True], (parts[1:] != parts[:-1]) | (big[1:] != big[:-1]), [True]))) if len(parts) else [0]
        a, b = [], []
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            if parts[lo] != part:
                part, few, few_sk, open_ = parts[lo], [], few_sk[:0], None
            if not big[lo]:
                few += fps[lo:hi]
                few_sk = np.concatenate((few_sk, sk[lo:hi]))
                continue
            if open_ is None:
                label = _linked(_agree(few_sk, few_sk) >= least)
                for k in np.flatnonzero(label != np.arange(len(few))).tolist():
                    a.append(few[k])
                    b.append(few[int(label[k])])
                open_ = np.unique(label)
            ask = np.flatnonzero(np.isin(label, open_))
            if not len(ask):
                continue
            like = _agree(few_sk[ask], sk[lo:hi]) >= least
            hit = like.any(1)
            groups, at = np.unique(label[ask[hit]], return_index=True)
            for k in np.flatnonzero(hit)[at].tolist():
                a.append(few[int(ask[k])])
                b.append(fps[lo + int(like[k].argmax())])
            open_ = np.setdiff1d(open_, groups)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def _hot_rows(level: DataFrame, part: int, lead: int) -> DataFrame:
    """The records of nodes with more than ``part`` of them (level: node, fp, sk, count), in parts of about so many; about ``lead`` records by hash go to all parts of their node, first."""
    parts = F.ceil(F.col("count") / part).cast("int")
    share = F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(1 << 30)) / float(1 << 30)
    own = level.select(F.pmod(F.xxhash64("fp"), parts).cast("int").alias("salt"), F.lit(True).alias("own"), "node", "fp", "sk")
    first = level.where(share < lead / F.col("count")).select(F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"), F.lit(False).alias("own"), "node", "fp", "sk")
    rows = own.union(first).select(F.xxhash64("node", "salt").alias("part"), "own", "node", "fp", "sk")
    return rows.repartition("part").sortWithinPartitions("part", "own", "fp")


def candidates(records: DataFrame, stage: Stage, percent: int, most: int | None = None, lead: int | None = None, part: int | None = None) -> DataFrame:
    """Links (a, b) between names of records(fp, sk, mins) that may hold; linear in the records. most, lead, part: NODE, LEADERS and PART unless given."""
    least, most, lead, part = least_agreement(percent), most or NODE, lead or LEADERS, part or PART
    node = lambda root, name: name.bitwiseAND(F.lit(-16)).bitwiseOR(root.cast("long"))  # noqa: E731  its last four bits are its root
    first = F.transform(F.sequence(F.lit(0), F.lit(ROOTS - 1)), lambda c: node(c, F.xxhash64(c, F.get("mins", c))))
    level = records.select("fp", "sk", F.explode(first).alias("node"))
    every = None
    for depth in range(LEVELS):
        hot = stage.put(level.groupBy(F.col("node").alias("p")).count().where(F.col("count") > part)) if depth == 0 or level.count() > part else None
        split = hot is not None and not hot.isEmpty()
        whole = level.join(small(hot), F.col("node") == F.col("p"), "left_anti") if split else level
        out = whole.select("node", "fp", "sk").repartition("node").sortWithinPartitions("node", "fp").mapInArrow(lambda x: _node_rows(x, least, most, lead), "a binary, b binary, node long")
        if split:
            out = out.union(_hot_rows(level.join(small(hot), F.col("node") == F.col("p")), part, lead).mapInArrow(lambda x: _part_rows(x, least, lead), "a binary, b binary, node long"))
        out = stage.put(out)
        links = out.where("b IS NOT NULL").select("a", "b")
        every = every.union(links) if every is not None else links
        on = out.where("node IS NOT NULL").select(F.col("a").alias("fp"), F.col("node").alias("path"))
        if on.isEmpty():
            break
        if depth == LEVELS - 1:  # records that agree in every chosen coordinate: one candidate group a node
            low = on.groupBy("path").agg(F.min("fp").alias("b")).withColumnRenamed("path", "p")
            every = every.union(on.join(low, F.col("path") == F.col("p")).select(F.col("fp").alias("a"), "b").where("a <> b"))
            break
        known = components(stage, every).withColumnRenamed("node", "f")
        on = stage.put(on.join(known, F.col("fp") == F.col("f"), "left").select("fp", "path", F.coalesce("comp", "fp").alias("comp")))
        sizes = on.groupBy("path", "comp").count().groupBy(F.col("path").alias("p")).agg(F.sum("count").alias("n"), F.max("count").alias("n_big"), F.max_by("comp", F.struct("count", "comp")).alias("big"))
        sizes = stage.put(sizes.where("n > n_big"))  # a node within one component has nothing to add
        few = on.join(small(sizes.where(F.col("n") - F.col("n_big") <= most)), F.col("path") == F.col("p")).join(records.select("fp", "sk"), "fp")
        few = few.withColumns({"big": F.col("comp") == F.col("big"), "blocks": F.ceil(F.col("n") / BLOCK).cast("int")})
        block = F.when(F.col("big"), F.array(F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
        few = few.select("path", "big", "fp", "sk", F.explode(block).alias("block")).select(F.xxhash64("path", "block").alias("part"), "big", "fp", "sk")
        every = every.union(stage.put(few.repartition("part").sortWithinPartitions("part", "big").mapInArrow(lambda x: _outside_rows(x, least), "a binary, b binary")))
        on = on.join(small(sizes.where(F.col("n") - F.col("n_big") > most).select("p")), F.col("path") == F.col("p")).select("fp", "path")
        # a coordinate of a path is not chosen again, and each root's next ones are others: the order starts at a place that depends on the root and goes round
        root = F.col("path").bitwiseAND(F.lit(15))
        pick = lambda j, depth=depth, root=root: (F.lit(ROOTS) + F.pmod(root * BRANCH + depth * ROOTS * BRANCH + j, F.lit(SKETCH - ROOTS))).cast("int")
        step = lambda j, root=root, pick=pick: node(root, F.xxhash64("path", pick(j), F.col("sk").substr(pick(j) + 1, F.lit(1))))
        level = on.join(records, "fp").select("fp", "sk", F.explode(F.array(*map(step, range(BRANCH)))).alias("node"))
        level = stage.put(level)
    return every


def _overlaps(q: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of q with each."""
    x = np.concatenate(others)
    at = np.searchsorted(q, x)
    hit = q[np.minimum(at, len(q) - 1)] == x
    return np.add.reduceat(hit, np.cumsum([0, *map(len, others[:-1])]), dtype=np.int64)


def links_of(q: int, sets: list[np.ndarray], sk: np.ndarray, among: np.ndarray, percent: int) -> np.ndarray:
    """Those of ``among`` whose full sets are linked with that of q."""
    among = among[(sk[among] == sk[q]).sum(1) >= least_agreement(percent)]
    out = []
    for k in range(0, len(among), 2048):
        part = among[k : k + 2048]
        both = _overlaps(sets[q], [sets[x] for x in part])
        size = np.array([len(sets[x]) for x in part])
        out.append(part[100 * both >= percent * (len(sets[q]) + size - both)])
    return np.concatenate(out) if out else among


def group_labels(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Component number of each set of a candidate group. All linked pairs lie within one: each record outside the largest component has been held against all others."""
    n = len(sets)
    sk = sketch_bytes(minwise(sets))
    comp, done = np.arange(n), np.zeros(n, bool)
    mode = np.array([np.bincount(c, minlength=256).argmax() for c in sk.T], np.uint8)
    q = int((sk == mode).sum(1).argmax())
    while True:
        done[q] = True
        found = links_of(q, sets, sk, np.flatnonzero(comp != comp[q]), percent)
        if len(found):
            comp[np.isin(comp, comp[found])] = comp[q]
        rest = np.flatnonzero(~done & (comp != np.bincount(comp).argmax()))
        if not len(rest):
            return comp
        q = int(rest[0])


def _whole_groups(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(fp, comp) from rows (cluster, fp, text) sorted by cluster."""
    for t in runs(batches, "cluster"):
        names, clusters = t.column("fp").to_pylist(), t.column("cluster").to_pylist()
        sets = shingle_sets(pa.chunked_array(t.column("text").chunks).combine_chunks(), k)
        out: list[tuple[bytes, bytes]] = []
        lo = 0
        while lo < len(names):
            hi, mine = lo, {}
            while hi < len(names) and clusters[hi] == clusters[lo]:
                if name_of(sets[hi]) == names[hi]:  # a doc_id may have several texts
                    mine[names[hi]] = sets[hi]
                hi += 1
            keys = list(mine)
            if keys:
                label = group_labels([mine[x] for x in keys], percent)
                out += [(x, keys[int(c)]) for x, c in zip(keys, label.tolist(), strict=True)]
            lo = hi
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], names=["fp", "comp"])


def _block_links(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of component names from rows (part, query, fp, comp, text) sorted by part: queries against the block's records, at most one link a record and one for each two queries it joins."""
    for t in runs(batches, "part"):
        parts, query, comp = (t.column(c).to_pylist() for c in ("part", "query", "comp"))
        sets = shingle_sets(pa.chunked_array(t.column("text").chunks).combine_chunks(), k)
        a, b = [], []
        lo = 0
        while lo < len(parts):
            hi = lo
            while hi < len(parts) and parts[hi] == parts[lo]:
                hi += 1
            mine = sets[lo:hi]
            sk = sketch_bytes(minwise(mine))
            of = {x: i for i, x in enumerate(dict.fromkeys(comp[lo:hi]))}
            back, now = list(of), np.array([of[x] for x in comp[lo:hi]])
            for q in range(hi - lo):
                if not query[lo + q]:
                    continue
                found = links_of(q, mine, sk, np.flatnonzero(now != now[q]), percent)
                for x in np.unique(now[found]).tolist():
                    a.append(back[x])
                    b.append(back[int(now[q])])
                now[np.isin(now, now[found])] = now[q]
            lo = hi
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def verify(docs: DataFrame, members: DataFrame, stage: Stage, k: int, percent: int, group: int = GROUP) -> DataFrame:
    """(fp, comp) for members(cluster, fp, doc_id, h, n_shingles): components of the links that hold on full sets."""
    heavy = stage.put(members.groupBy("cluster").agg(F.sum("n_shingles").alias("n")).where(F.col("n") > group).select(F.col("cluster").alias("c"), F.ceil(F.col("n") / group).cast("int").alias("blocks")))
    keys = small(members.select("cluster", "fp", F.col("doc_id").alias("d"), F.col("h").alias("h_")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("h"), "text").join(keys, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("h_"))).select("cluster", "fp", "text")
    rows = rows.join(small(heavy), F.col("cluster") == F.col("c"), "left").drop("c")
    light = rows.where("blocks IS NULL").select("cluster", "fp", "text").repartition("cluster").sortWithinPartitions("cluster")
    out = light.mapInArrow(lambda x: _whole_groups(x, k, percent), "fp binary, comp binary")
    if heavy.isEmpty():
        return out
    texts = stage.put(rows.where("blocks IS NOT NULL").dropDuplicates(["fp"]))
    state = stage.put(texts.select("cluster", "fp", F.col("fp").alias("comp"), F.lit(False).alias("done")))
    first, queries = True, QUERIES
    while True:
        big = state.groupBy("cluster", "comp").count().groupBy("cluster").agg(F.max_by("comp", F.struct("count", "comp")).alias("big")).withColumnRenamed("cluster", "c")
        open_ = state.join(big, F.col("cluster") == F.col("c")).where(F.lit(first) | (F.col("comp") != F.col("big"))).where("NOT done")
        rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.xxhash64("fp")))
        ask = stage.put(open_.withColumn("r", rank).where(F.col("r") <= queries).select(F.col("fp").alias("q")))
        if ask.isEmpty():
            return out.union(state.select("fp", "comp"))
        now = texts.join(state.select(F.col("fp").alias("f"), "comp"), F.col("fp") == F.col("f")).drop("f").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        asked = now.join(small(ask, 5000), F.col("fp") == F.col("q"), "left_semi").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        part = F.xxhash64("cluster", "block")
        both = now.select(part.alias("part"), F.lit(False).alias("query"), "fp", "comp", "text").union(asked.select(part, F.lit(True), "fp", "comp", "text"))
        links = stage.put(both.repartition("part").sortWithinPartitions("part").mapInArrow(lambda x: _block_links(x, k, percent), "a binary, b binary"))
        merged = components(stage, links)
        state = stage.put(
            state.join(merged.withColumnRenamed("comp", "now"), F.col("comp") == F.col("node"), "left").join(ask, F.col("fp") == F.col("q"), "left").select("cluster", "fp", F.coalesce("now", "comp").alias("comp"), (F.col("done") | F.col("q").isNotNull()).alias("done"))
        )
        first, queries = False, min(4 * queries, MOST_QUERIES)


def near_duplicates(docs: DataFrame, stage: Stage, k: int, percent: int, group: int = GROUP, most: int | None = None, lead: int | None = None, part: int | None = None) -> DataFrame:
    """Rows (doc_id, h, n_shingles, component_id) for each row of docs(doc_id, text); h is a hash of the text. most, lead, part: see ``candidates``."""
    docs = docs.select("doc_id", "text")
    digests = stage.put(digest(docs, k))
    records = digests.where("fp IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("low"), F.max(F.struct("doc_id", "h")).alias("at"), F.first("sk").alias("sk"), F.first("mins").alias("mins"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("copies"))
    records = stage.put(records)
    groups = components(stage, candidates(records.select("fp", "sk", "mins"), stage, percent, most, lead, part))
    members = stage.put(groups.withColumnRenamed("comp", "cluster").join(records, F.col("node") == F.col("fp")).select("cluster", "fp", "at.doc_id", "at.h", "n_shingles", "low"))
    found = stage.put(verify(docs, members, stage, k, percent, group))
    lows = found.join(members.select(F.col("fp").alias("f"), "low"), F.col("fp") == F.col("f")).select("fp", "comp", "low")
    least = lows.groupBy("comp").agg(F.min("low").alias("component_id")).withColumnRenamed("comp", "c")
    lows = lows.join(least, F.col("comp") == F.col("c")).select(F.col("fp").alias("f"), "component_id")
    labels = records.select("fp", "low", "copies").join(lows, F.col("fp") == F.col("f"), "left").select(F.col("fp").alias("f"), F.coalesce("component_id", "low").alias("component_id"), "copies")
    labels = stage.put(labels)
    stage.drop(records, members, found)
    out = ["doc_id", "h", "n_shingles", "component_id"]
    wordless = digests.where("fp IS NULL").select("doc_id", "h", "n_shingles", F.col("doc_id").alias("component_id"))
    return join_split(digests.where("fp IS NOT NULL").select("doc_id", "h", "n_shingles", "fp"), labels, "fp", "f", "copies").select(out).union(wordless)


def keep_one(docs: DataFrame, stage: Stage, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay: of each group the document of smallest doc_id, once; documents in no group, and rows without words."""
    found = stage.put(near_duplicates(docs, stage, k, percent))
    out = found.where(F.coalesce(F.col("doc_id") != F.col("component_id"), F.col("component_id").isNotNull())).select(F.col("doc_id").alias("gl_d"), F.col("h").alias("gl_h")).distinct()
    kept = docs.join(small(out), F.col("doc_id").eqNullSafe(F.col("gl_d")) & (text_key(F.col("text")) == F.col("gl_h")), "left_anti")
    again = found.where("doc_id = component_id").groupBy("doc_id", "component_id").count().where("count > 1").select(F.col("doc_id").alias("gl_d"))
    if again.isEmpty():
        return kept
    twice = kept.join(small(again), F.col("doc_id") == F.col("gl_d"), "left_semi").dropDuplicates(["doc_id"])
    return kept.join(small(again), F.col("doc_id") == F.col("gl_d"), "left_anti").union(twice)


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"), Stage(spark, "op5"), 3, 85)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


#: The same by prefix filtering: the rarest shingles of a set, one more than it may lack, hold one that every linked set has too.
OP5_SQL = r"""
WITH RECURSIVE
words AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS MATERIALIZED (
  SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])
                                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s
  FROM words),
records AS MATERIALIZED (SELECT min(r) AS id, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
each AS MATERIALIZED (SELECT id, n, unnest(s) AS t FROM records),
often AS (SELECT t, count(*) AS c FROM each GROUP BY t),
placed AS (SELECT id, n, t, row_number() OVER (PARTITION BY id ORDER BY c, t) AS k FROM each JOIN often USING (t)),
prefix AS MATERIALIZED (SELECT id, n, t FROM placed WHERE k <= n - (85 * n + 99) // 100 + 1),
pairs AS MATERIALIZED (SELECT DISTINCT a.id AS a, b.id AS b FROM prefix a JOIN prefix b ON a.t = b.t AND a.id < b.id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n),
shared AS (SELECT p.a, p.b, x.n AS n, y.n AS m, len(list_intersect(x.s, y.s)) AS common FROM pairs p JOIN records x ON x.id = p.a JOIN records y ON y.id = p.b),
links AS MATERIALIZED (SELECT a, b FROM shared WHERE 100 * common >= 85 * (n + m - common)),
ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT id AS a, id AS b FROM records UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a),
named AS MATERIALIZED (SELECT a AS id, min(b) AS comp FROM reach GROUP BY a),
placed_docs AS (SELECT d.doc_id, len(d.s) AS n_shingles, n.comp FROM sets d LEFT JOIN records x ON x.s = d.s LEFT JOIN named n ON n.id = x.id),
lows AS (SELECT comp, min(doc_id) AS low FROM placed_docs WHERE comp IS NOT NULL GROUP BY comp)
SELECT doc_id, n_shingles, CASE WHEN p.comp IS NULL THEN doc_id ELSE low END AS component_id,
       doc_id IS NOT DISTINCT FROM CASE WHEN p.comp IS NULL THEN doc_id ELSE low END AS kept
FROM placed_docs p LEFT JOIN lows l ON p.comp = l.comp
"""
