"""Telephony audio as a media column: G.711 mu-law and A-law by lookup tables, IMA ADPCM by numpy across blocks, resampled PCM.

The stored form is a WAVE file: one byte a sample for mu-law and A-law, blocks of a 4-byte state and 192 bytes (two 4-bit
steps a byte) for ADPCM. All three hold any byte string without loss. Decoding gives 16-bit PCM at 8 kHz, resampled to 16 kHz
by an integer half-band filter, so that results are the same on every machine. The PCM is stored as a column beside the media and
the features are taken from what is read back; in the query it goes when they are taken.

Nulls and empty texts are a payload of 192 spaces. Long texts are decoded in pieces; memory follows the piece. Equal payloads
give equal files. Repeated rows give repeated results; an empty table gives none; extra columns pass, but those named as the
columns that a step adds (n_bytes, media, pcm, gl_wave and the features) are replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, pieces, read, ship

RATE, OUT_RATE = 8000, 16000
#: Payloads are padded with spaces to a multiple of this; it is also the data of one ADPCM block.
UNIT = 192
CODECS = ("mulaw", "alaw", "adpcm")
_TAG = {"alaw": 6, "mulaw": 7, "adpcm": 0x11}
_PIECE = 1 << 20
#: Parts in which PCM is stored and used: it takes 4 (G.711) or 8 (ADPCM) times the payload, and only one part is there at a time.
WAVES = 8

# Fixed values of the IMA ADPCM format: quantiser steps, and by how much a code moves the step's index.
STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767])
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8])


def mulaw_table() -> np.ndarray:
    """16-bit value of each mu-law byte, by the rule of G.711."""
    code = ~np.arange(256) & 0xFF
    size = ((((code & 15) << 3) + 132) << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit value of each A-law byte, by the rule of G.711."""
    code = np.arange(256) ^ 0x55
    power = (code >> 4) & 7
    size = ((code & 15) << 4) + 8 + np.where(power > 0, 256, 0)
    size = size << np.maximum(power - 1, 0)
    return np.where(code & 128, size, -size).astype(np.int16)


_TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}


def adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples of ADPCM blocks (one a row: 4 bytes of state, then data); step k of all blocks is decoded at once."""
    value = blocks[:, 0].astype(np.int32) | (blocks[:, 1].astype(np.int8).astype(np.int32) << 8)
    index = np.clip(blocks[:, 2].astype(np.int32), 0, len(STEPS) - 1)
    data = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * len(data), len(blocks)), np.int16)
    out[0] = value
    # the change of each (index, code), and the index after it
    code = np.arange(16)
    step = STEPS[:, None]
    change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    change = np.where(code & 8, -change, change).astype(np.int32).ravel()
    after = np.clip(np.arange(len(STEPS))[:, None] + MOVES[code & 7], 0, len(STEPS) - 1).astype(np.int32).ravel()
    for k, byte in enumerate(data):
        for half, c in enumerate((byte & 15, byte >> 4)):
            at = index * 16 + c
            value = np.clip(value + change[at], -32768, 32767)
            index = after[at]
            out[1 + 2 * k + half] = value
    return out.T


class Doubler:
    """Twice the rate: between two samples, the half-band mean (9 (b + c) - (a + d)) / 16 in integers. Takes pieces in order."""

    def __init__(self) -> None:
        self.held: np.ndarray | None = None

    def feed(self, x: np.ndarray, last: bool = False) -> np.ndarray:
        x = x.astype(np.int32)
        if self.held is None:
            x = np.concatenate((x[:1], x))
        else:
            x = np.concatenate((self.held, x))
        if last:
            x = np.concatenate((x, x[-1:], x[-1:]))
        if len(x) < 4:
            self.held = x
            return np.zeros(0, np.int16)
        a, b, c, d = x[:-3], x[1:-2], x[2:-1], x[3:]
        out = np.empty((len(b), 2), np.int16)
        out[:, 0] = b
        out[:, 1] = np.clip((9 * (b + c) - (a + d) + 8) >> 4, -32768, 32767)
        self.held = x[-3:]
        return out.ravel()


def wrap(codec: str, payload: bytes) -> bytes:
    """The WAVE file that holds the payload."""
    if codec == "adpcm":
        data = np.zeros((len(payload) // UNIT, UNIT + 4), np.uint8)
        data[:, 4:] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
        body, fmt = data.tobytes(), struct.pack("<HHIIHHHH", _TAG[codec], 1, RATE, RATE * (UNIT + 4) // (2 * UNIT + 1), UNIT + 4, 4, 2, 2 * UNIT + 1)
    else:
        body, fmt = payload, struct.pack("<HHIIHHH", _TAG[codec], 1, RATE, RATE, 1, 8, 0)
    chunks = b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def unwrap(media: bytes) -> tuple[str, memoryview]:
    """Codec and data chunk of a WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, codec, view = 12, None, memoryview(media)
    while at + 8 <= len(media):
        kind, n = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if kind == b"fmt ":
            tag = int.from_bytes(media[at + 8 : at + 10], "little")
            codec = next((k for k, v in _TAG.items() if v == tag), None)
        elif kind == b"data" and codec:
            return codec, view[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data of a known codec")


def payload_of(codec: str, data: memoryview) -> bytes:
    return np.frombuffer(data, np.uint8).reshape(-1, UNIT + 4)[:, 4:].tobytes() if codec == "adpcm" else bytes(data)


def pcm_pieces(codec: str, data: memoryview) -> Iterator[np.ndarray]:
    """16-bit samples at 8 kHz, piece by piece."""
    raw = np.frombuffer(data, np.uint8)
    if codec == "adpcm":
        raw = raw.reshape(-1, UNIT + 4)
        for k in range(0, len(raw), _PIECE // UNIT):
            yield adpcm(raw[k : k + _PIECE // UNIT]).ravel()
    else:
        for k in range(0, len(raw), _PIECE):
            yield _TABLES[codec][raw[k : k + _PIECE]]


def resampled(pieces: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    doubler = Doubler()
    for x in pieces:
        yield doubler.feed(x)
    if doubler.held is not None:
        yield doubler.feed(np.zeros(0, np.int16), last=True)


def _batch_pieces(media: list[bytes]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(row, pieces of PCM at 8 kHz): the short ADPCM files of a batch are decoded together, others one by one."""
    parts = [unwrap(m) for m in media]
    group, n = [], 0
    for row, (codec, data) in enumerate([*parts, ("end", memoryview(b""))]):
        if codec == "adpcm" and len(data) < _PIECE:
            group.append(row)
            n += len(data)
        elif codec != "end":
            yield row, list(pcm_pieces(codec, data)) if len(data) < _PIECE else pcm_pieces(codec, data)
        if n >= _PIECE or codec == "end" and group:
            x = adpcm(np.frombuffer(b"".join(parts[r][1] for r in group), np.uint8).reshape(-1, UNIT + 4))
            at = 0
            for r in group:
                k = len(parts[r][1]) // (UNIT + 4)
                yield r, [x[at : at + k].ravel()]
                at += k
            group, n = [], 0


def payload_bytes(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def encode(docs: DataFrame) -> DataFrame:
    """docs without text, with n_bytes and media, a WAVE file that holds the padded text; the codec follows from the payload."""
    ship(docs.sparkSession)
    cols = [c for c in docs.columns if c not in ("text", "n_bytes", "media")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            made = [payload_bytes(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            media = [wrap(CODECS[zlib.crc32(p) % len(CODECS)], p) for _, p in made]
            arrays = [b.column(b.schema.get_field_index(c)) for c in cols]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([n for n, _ in made], pa.int64()), pa.array(media, pa.binary())], names=[*cols, "n_bytes", "media"])

    shape = docs.select(cols).withColumns({"n_bytes": F.lit(None).cast("long"), "media": F.lit(None).cast("binary")}).schema
    return docs.select(*cols, "text").mapInArrow(run, shape)


def to_pcm(media: DataFrame) -> DataFrame:
    """media rows with pcm, the decoded and resampled samples (16-bit little-endian, 16 kHz), to be stored as a column."""
    ship(media.sparkSession)
    media = media.drop("pcm")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 200):
            files = b.column(b.schema.get_field_index("media")).to_pylist()
            pcm: list[bytes] = [b""] * len(files)
            for row, found in _batch_pieces(files):
                pcm[row] = b"".join(x.astype("<i2").tobytes() for x in resampled(iter(found)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pcm, pa.binary())], names=[*b.schema.names, "pcm"])

    return media.mapInArrow(run, media.withColumn("pcm", F.lit(None).cast("binary")).schema)


def _told(media: bytes) -> tuple:
    codec, data = unwrap(media)
    payload = payload_of(codec, data)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), codec


def _heard(pcm: bytes) -> str:
    """Samples, peak, mean square, sign changes and a digest of stored PCM."""
    n = peak = power = turns = 0
    before = False
    for k in range(0, len(pcm), 2 * _PIECE):
        x = np.frombuffer(pcm, "<i2", min(_PIECE, (len(pcm) - k) // 2), k)
        negative = x < 0
        turns += int(np.count_nonzero(negative[1:] != negative[:-1])) + int(n > 0 and bool(negative[0]) != before)
        before = bool(negative[-1])
        n, peak, power = n + len(x), max(peak, int(np.abs(x.astype(np.int32)).max())), power + int(np.dot(x.astype(np.float64), x))
    return f"{n}:{peak}:{power // max(n, 1)}:{turns}:{hashlib.sha256(pcm).hexdigest()[:16]}"


#: What ``features`` adds.
FEATURES = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}


def features(stored: DataFrame) -> DataFrame:
    """Rows of stored(media, pcm) without these, with payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, and feature: codec, samples at 16 kHz, peak, mean square, sign changes and a digest of the PCM."""
    ship(stored.sparkSession)
    cols = [c for c in stored.columns if c not in ("media", "pcm", *FEATURES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            of = lambda c, b=b: b.column(b.schema.get_field_index(c))
            rows = []
            for media, pcm in zip(of("media"), of("pcm"), strict=True):
                *told, codec = _told(media.as_py())
                rows.append((*told, f"{codec}:{_heard(pcm.as_py())}"))
            made = [pa.array([r[k] for r in rows], pa.int64() if kind == "long" else pa.string()) for k, kind in enumerate(FEATURES.values())]
            yield pa.RecordBatch.from_arrays([*map(of, cols), *made], names=[*cols, *FEATURES])

    shape = stored.select(cols).withColumns({c: F.lit(None).cast(kind) for c, kind in FEATURES.items()}).schema
    return stored.select(*cols, "media", "pcm").mapInArrow(run, shape)


def stored_features(docs: DataFrame, stage: Stage, waves: int = WAVES) -> DataFrame:
    """n_bytes and the features of docs(.., text). The media column is stored; wave by wave (rows are dealt in turn, so that no group of copies fills one) the PCM column is stored, read back for the features, and removed."""
    cols = [c for c in docs.columns if c not in ("text", "n_bytes", "media", "gl_wave")]
    dealt = encode(docs.select(*cols, "text")).withColumn("gl_wave", F.pmod(F.monotonically_increasing_id(), F.lit(waves)).cast("int"))
    media = stage.put(dealt, by="gl_wave")
    out = []
    for wave in range(waves):
        pcm = stage.put(to_pcm(media.where(F.col("gl_wave") == wave).select(*cols, "n_bytes", "media")))
        out.append(stage.put(features(pcm)))
        stage.drop(pcm)
    stage.drop(media)
    return reduce(DataFrame.unionByName, out)


def op6_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stored_features(read(spark, sf_dir, "documents").select("doc_id", "text"), Stage(spark, "op6"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
