"""Document quality from a linear-chain conditional random field over lines.

Every line gets a label, good or bad, from its own features, its neighbours' features and the labels beside it. The field is
fitted on documents that carry a quality label, by gradient ascent on the conditional likelihood: lines start with their document's
label, those whose features surely tell the contrary get the other (see ``line_labels``), and the field is fitted again.
Forward-backward gives each line's marginal; weighted by line lengths they give the document's score, the probability
of label 1.

Fitting takes at most TRAIN_DOCS labelled documents, those of smallest hash of doc_id, of at most TRAIN_LINES lines each; this
bound holds for the fit alone. Scoring takes whole texts and looks at nothing but the text.

A null or empty text, or one without a line that has characters, scores the share of good documents in the training sample.
Without labelled documents every score is 0.5. Null labels and labels without a document do not train; of several labels of a
document the smallest counts, of several texts of a doc_id that of the smallest hash. Rows with a null doc_id are scored, and are not held out. Repeated rows repeat; an empty table
gives none; extra columns pass through ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, read, ship, text_key
from .textnp import text_bytes, white_table, words

TRAIN_DOCS, TRAIN_LINES = 2000, 300
STEPS, RATE, PENALTY = 300, 0.15, 1e-4
#: How sure a line's features must be to give it another label than its document's, and the share of a document that may have another.
SURE, MIXED = 0.95, 0.4
_OWN = 10


@dataclass
class Field:
    """Weights of a line's features for label 1 against 0, of the four neighbouring label pairs, and the share of label 1."""

    weights: np.ndarray
    pairs: np.ndarray
    prior: float


def lines(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, length in bytes and row of each line that has bytes, in order."""
    raw, at = text_bytes(col)
    raw = np.concatenate((raw, np.zeros(1, np.uint8)))
    n = len(raw) - 1
    breaks = np.flatnonzero(raw[:n] == 10)
    start = np.union1d(at[:-1], breaks + 1)
    start = start[start < n].astype(np.int64)
    row = np.searchsorted(at, start, "right") - 1
    end = np.minimum(np.concatenate((breaks, [n]))[np.searchsorted(breaks, start)], at[row + 1])
    start, end, row = start[end > start], end[end > start], row[end > start]
    if not len(start):
        return np.zeros((0, 3 * _OWN + 2)), start, row
    cuts = np.stack((start, end), 1).ravel()
    count = lambda mask: np.add.reduceat(mask, cuts, dtype=np.int32)[::2].astype(np.float64)
    size = (end - start).astype(np.float64)
    kind = np.full(256, 4, np.uint8)  # 0 letter, 1 digit, 2 space, 3 stop or comma, 4 other
    kind[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 0
    kind[48:58] = 1
    kind[[9, 11, 12, 13, 32]] = 2
    kind[[33, 44, 46, 63]] = 3
    k = kind[raw]
    letters, digits, spaces, stops, others = (count(k == j) / size for j in range(5))
    capitals = count((raw >= 65) & (raw < 91)) / size
    again = np.zeros(len(raw), bool)
    again[1:] = (raw[1:] == raw[:-1]) & (k[1:] > 2)
    h, word_at, _, _ = words(col, white_table())
    line = np.searchsorted(start, word_at, "right") - 1
    in_line = np.maximum(np.bincount(line, minlength=len(start)), 1)
    said = np.zeros(len(h), bool)
    said[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    repeats = np.bincount(line[said], minlength=len(start)) / in_line
    own = np.stack((letters, np.sqrt(digits), spaces, stops, np.sqrt(others), capitals, np.sqrt(count(again) / size), np.sqrt(repeats), np.log1p(size) / 10, 1 / (1 + spaces * size)), 1)
    first, last = np.concatenate(([True], row[1:] != row[:-1])), np.concatenate((row[1:] != row[:-1], [True]))
    before, after = np.roll(own, 1, 0), np.roll(own, -1, 0)
    before[first], after[last] = 0, 0
    return np.concatenate((own, before, after, np.ones((len(own), 1)), (first | last)[:, None]), 1), end - start, row


def _padded(values: np.ndarray, row: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """values laid out (place in the document, document), which cells are filled, and for each value its place."""
    first = np.searchsorted(row, rows)
    place = np.arange(len(row)) - first[np.searchsorted(rows, row)]
    out = np.zeros((int(place.max()) + 1, len(rows)))
    cell = place, np.searchsorted(rows, row)
    out[cell] = values
    held = np.zeros(out.shape, bool)
    held[cell] = True
    return out, held, place


def marginals(unary: np.ndarray, held: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of label 1 of each cell, and of each label pair summed over each column's neighbouring cells. unary: scores of label 1; that of 0 is 0."""
    steps, n = unary.shape
    up = np.zeros((steps, 2, n))
    up[0, 1] = unary[0]
    for t in range(1, steps):
        for y in (0, 1):
            up[t, y] = np.logaddexp(up[t - 1, 0] + pairs[0, y], up[t - 1, 1] + pairs[1, y]) + y * unary[t]
    down = np.zeros((steps, 2, n))
    both = np.zeros((2, 2))
    for t in range(steps - 2, -1, -1):
        on = held[t + 1]
        for x in (0, 1):
            down[t, x] = np.where(on, np.logaddexp(pairs[x, 0] + down[t + 1, 0], pairs[x, 1] + unary[t + 1] + down[t + 1, 1]), 0)
        total = np.logaddexp(up[t, 0] + down[t, 0], up[t, 1] + down[t, 1])
        for x in (0, 1):
            for y in (0, 1):
                both[x, y] += np.exp(up[t, x] + pairs[x, y] + y * unary[t + 1] + down[t + 1, y] - total)[on].sum()
    odds = (up[:, 1] + down[:, 1]) - (up[:, 0] + down[:, 0])
    return 0.5 * (1 + np.tanh(odds / 2)), both


def _ascend(features: np.ndarray, row: np.ndarray, y: np.ndarray, theta: np.ndarray, steps: int, alone: bool = False) -> np.ndarray:
    """Adam on the mean conditional log-likelihood of a line's label y, from theta (feature weights, then the four pair weights; alone: these stay 0)."""
    rows = np.unique(row)
    at = np.searchsorted(rows, row)
    same = np.flatnonzero(row[1:] == row[:-1])
    seen_pairs = np.zeros((2, 2))
    np.add.at(seen_pairs, (y[same].astype(int), y[same + 1].astype(int)), 1)
    want = features.T @ y
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        score = features @ theta[:-4]
        if alone:
            p, both = 0.5 * (1 + np.tanh(score / 2)), seen_pairs
        else:
            unary, held, place = _padded(score, row, rows)
            p, both = marginals(unary, held, theta[-4:].reshape(2, 2))
            p = p[place, at]
        grad = np.concatenate((want - features.T @ p, (seen_pairs - both).ravel())) / len(row) - PENALTY * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta


def line_labels(features: np.ndarray, size: np.ndarray, row: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Labels of lines from the labels y of their documents: lines whose own features tell the contrary with a probability of SURE or more take it, the surest first, up to a share MIXED of the document's length."""
    q = 0.5 * (1 + np.tanh(features @ weights / 2))
    against = np.where(y > 0.5, 1 - q, q)
    order = np.lexsort((np.arange(len(row)), -against, row))
    run = np.cumsum(size[order])
    first = np.searchsorted(row[order], row[order])
    upto = run - run[first] + size[order][first]
    whole = np.bincount(row, size)[row[order]]
    out = y.copy()
    turned = order[(against[order] >= SURE) & (upto <= MIXED * whole)]
    out[turned] = 1 - y[turned]
    return out


def fit(features: np.ndarray, size: np.ndarray, row: np.ndarray, label: np.ndarray) -> Field:
    """row: document number of each line, ascending; size: length of each line; label: of each document. Lines start with their document's label; a first fit tells which lines do not go with it, and the field is fitted on the lines' own labels, so that it learns where good and bad lines meet."""
    rows = np.unique(row)
    if not len(rows):
        return Field(np.zeros(3 * _OWN + 2), np.zeros((2, 2)), 0.5)
    y = label[row].astype(np.float64)
    theta = _ascend(features, row, y, np.zeros(features.shape[1] + 4), STEPS, alone=True)
    theta = _ascend(features, row, line_labels(features, size, row, y, theta[:-4]), theta, STEPS)
    return Field(theta[:-4], theta[-4:].reshape(2, 2), float(label[rows].mean()))


def quality(field: Field, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: score, lines that have characters, and how many of them are rather good. Documents of like numbers of lines are run together."""
    features, size, row = lines(col)
    out, good = np.full(len(col), field.prior), np.zeros(len(col), np.int64)
    counts = np.bincount(row, minlength=len(col))
    unary = features @ field.weights
    band = np.ceil(np.log2(np.maximum(counts, 1))).astype(int)
    for b in np.unique(band[counts > 0]):
        rows = np.flatnonzero((band == b) & (counts > 0))
        mine = band[row] == b
        u, held, place = _padded(unary[mine], row[mine], rows)
        p, _ = marginals(u, held, field.pairs)
        at = np.searchsorted(rows, row[mine])
        weight = size[mine].astype(np.float64)
        out[rows] = np.bincount(at, p[place, at] * weight) / np.bincount(at, weight)
        good[rows] = np.bincount(at, p[place, at] >= 0.5)
    return np.clip(out, 0.0, 1.0), counts, good


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Field:
    """Fits on labelled documents that are not held out; at most ``most`` of them come to the driver, as line features."""
    ship(docs.sparkSession)
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    mine = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", text_key(F.col("text")).alias("h"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            x, size, row = lines(b.column(3))
            x = np.concatenate((x, size[:, None]), 1).astype("<f4")
            counts = np.bincount(row, minlength=b.num_rows)
            packed = [x[row == r].tobytes() if 0 < counts[r] <= TRAIN_LINES else None for r in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(packed, pa.binary())], names=["doc_id", "quality", "h", "x"])

    found = mine.mapInArrow(run, "doc_id long, quality int, h long, x binary").where("x IS NOT NULL")
    found = found.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min_by("x", "h").alias("x")).collect()  # one text a doc_id, so at most ``most`` rows
    found.sort(key=lambda r: r["doc_id"])
    parts = [np.frombuffer(bytes(r["x"]), "<f4").reshape(-1, 3 * _OWN + 3).astype(np.float64) for r in found]
    x = np.concatenate(parts) if parts else np.zeros((0, 3 * _OWN + 3))
    return fit(x[:, :-1], x[:, -1], np.repeat(np.arange(len(parts)), [len(p) for p in parts]), np.array([r["quality"] for r in found]))


def score(docs: DataFrame, field: Field, keep: list[str] | None = None, name: str = "score", counts: bool = False) -> DataFrame:
    """The columns keep (default: all) of docs and the score, with counts also n_lines and n_good_lines; columns of these names are replaced."""
    ship(docs.sparkSession)
    new = {name: "double"} | ({"n_lines": "long", "n_good_lines": "long"} if counts else {})
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            arrays = [b.column(b.schema.get_field_index(c)) for c in keep]
            made = quality(field, b.column(b.schema.get_field_index("text")))
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(made[k]) for k in range(len(new)))], names=[*keep, *new])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, docs.select(keep).withColumns({c: F.lit(None).cast(kind) for c, kind in new.items()}).schema)


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, read(spark, sf_dir, "labels")), ["doc_id"], counts=True)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_lines", "n_good_lines")
