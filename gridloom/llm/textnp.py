"""Words of a whole Arrow batch as 64-bit numbers, by numpy over the batch's bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEGMENT = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Tables:
    made: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if cls.made is None or len(cls.made[1]) < n:
            base = 0xD1342543DE82EF95
            value = np.random.default_rng(12345).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            value[0] = 0
            cls.made = value, _powers(base, n), _powers(pow(base, -1, 1 << 64), n)
        return cls.made


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: near inputs give far outputs."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def white_table() -> np.ndarray:
    """A-Z lower-cased; white space of the word rule becomes 0. A NUL byte is a word byte: it becomes 0xFF, which UTF-8 never has."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[0] = 255
    t[[9, 10, 11, 12, 13, 32]] = 0
    return t


def alnum_table() -> np.ndarray:
    """A-Z lower-cased; of ASCII only letters and digits are word bytes; bytes from 0x80 are."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    for low, high in ((0, 48), (58, 65), (91, 97), (123, 128)):
        t[low:high] = 0
    return t


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and where each row's bytes begin (n + 1 places); null rows are empty."""
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    at = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def words(col: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of every word, and where each row's words begin (n + 1 places).

    A word's hash depends on its bytes alone: a polynomial over random byte values, finalised with the length.
    Bytes are taken in segments that end between words, so memory follows the segment, not the text.
    """
    raw, at = text_bytes(col)
    hashes, firsts, ends = [], [], []
    lo = 0
    while lo < len(raw):
        hi, step = min(len(raw), lo + _SEGMENT), _SEGMENT
        while hi < len(raw) and not (cut := np.flatnonzero(table[raw[max(lo, hi - 4096) : hi]] == 0)).size:
            step *= 2  # a word longer than what was looked at
            hi = min(len(raw), lo + step)
        if hi < len(raw):
            hi = max(lo, hi - 4096) + int(cut[-1]) + 1
        x = table[raw[lo:hi]]
        inside = x != 0
        new = np.zeros(len(x) + 1, bool)
        rows = at[np.searchsorted(at, lo) : np.searchsorted(at, hi, "right")] - lo
        new[rows] = True
        prev = np.concatenate(([False], inside[:-1]))
        start = np.flatnonzero(inside & (~prev | new[:-1]))
        nxt = np.concatenate((inside[1:], [False]))
        end = np.flatnonzero(inside & (~nxt | new[1:])) + 1
        value, power, inverse = _Tables.get(max(len(x) + 1, _SEGMENT + 1))
        total = np.empty(len(x) + 1, np.uint64)
        total[0] = 0
        np.cumsum(value[x] * power[: len(x)], out=total[1:])
        h = (total[end] - total[start]) * inverse[start]
        hashes.append(mix(h + (end - start).astype(np.uint64) * _ODD))
        firsts.append(start + lo)
        ends.append(end + lo)
        lo = hi
    none = np.zeros(0, np.int64)
    first = np.concatenate(firsts) if firsts else none
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), first, (np.concatenate(ends) if ends else none), np.searchsorted(first, at)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """A number for each run of n neighbouring hashes, order kept; empty when there are fewer."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD1342543DE82EF95) + h[k : k + len(out)]
    return mix(out + np.uint64(n))
