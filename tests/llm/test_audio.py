from __future__ import annotations

import hashlib
import random
import wave
import zlib

import numpy as np
import pytest

from gridloom.llm import audio


def adpcm_plainly(block):
    """One block, sample by sample."""
    value = int.from_bytes(block[:2], "little", signed=True)
    index = min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(audio.STEPS[index])
            diff = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                diff += part if code & bit else 0
            value = max(-32768, min(32767, value - diff if code & 8 else value + diff))
            index = max(0, min(88, index + int(audio.MOVES[code & 7])))
            out.append(value)
    return out


def test_tables():
    mu, a = audio.mulaw_table(), audio.alaw_table()
    assert mu[0xFF] == 0 and mu[0x80] == 32124 and mu[0x00] == -32124 and (mu[:128] == -mu[128:]).all()
    assert a[0xD5] == 8 and a[0x55] == -8 and a[0xAA] == 32256 and len(np.unique(a)) == 256


def test_adpcm_across_blocks():
    rng = random.Random(1)
    blocks = np.array([[rng.randrange(256) for _ in range(2)] + [rng.randrange(120), 0] + [rng.randrange(256) for _ in range(192)] for _ in range(9)], np.uint8)
    assert audio.adpcm(blocks).tolist() == [adpcm_plainly(b.tolist()) for b in blocks]


def test_resampling_in_pieces_is_the_same():
    x = np.random.default_rng(2).integers(-32768, 32768, 5000).astype(np.int16)
    whole = np.concatenate(list(audio.resampled(iter([x]))))
    assert len(whole) == 2 * len(x) and (whole[::2] == x).all()
    for cuts in ([1, 2, 3, 700], [2500], [4999]):
        assert (np.concatenate(list(audio.resampled(iter(np.split(x, cuts))))) == whole).all()


@pytest.mark.parametrize("codec", audio.CODECS)
def test_container(codec):
    payload = bytes(range(256)) * 3
    media = audio.wrap(codec, payload)
    got, data = audio.unwrap(media)
    assert got == codec and audio.payload_of(got, data) == payload
    with pytest.raises(ValueError):
        audio.unwrap(b"RIFF....WAVE")


def test_query(spark, edges, sf_dir):
    rows = audio.op6_telephony_audio(spark, sf_dir(documents=edges)).collect()
    assert len(rows) == edges.count()
    by = {}
    for d, t in edges.select("doc_id", "text").collect():
        raw = (t or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        by.setdefault(d, []).append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
    for r in rows:
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) in by[r["doc_id"]]
    assert len({(r["payload_sha256"], r["media_sha256"], r["feature"]) for r in rows}) == len({r["payload_sha256"] for r in rows})


def test_pcm_column(spark, documents):
    media = audio.encode(documents([(k, f"text {k} " * k) for k in range(30)] + [(99, "long " * 500_000)]))
    rows = audio.to_pcm(media).collect()
    for r in rows:
        codec, data = audio.unwrap(bytes(r["media"]))
        want = b"".join(x.astype("<i2").tobytes() for x in audio.resampled(audio.pcm_pieces(codec, data)))
        assert bytes(r["pcm"]) == want and "n_chars" in r.asDict()
    assert audio.features(audio.to_pcm(audio.encode(documents([])))).count() == 0


def test_wave_module_knows_the_container():
    assert wave.WAVE_FORMAT_PCM not in audio._TAG.values()


def test_waves_and_clashing_columns(documents, stage):
    """What is stored in waves gives the features of the whole; columns named as those that steps add are replaced."""
    docs = documents([(k, f"text {k % 7} " * (k % 7)) for k in range(40)] + [(99, None)]).selectExpr("*", "'x' AS media", "1 AS n_bytes", "2 AS pcm", "'y' AS feature", "3 AS gl_wave")
    rows = [sorted(map(str, audio.stored_features(docs, stage, waves).select("doc_id", "n_bytes", "payload_sha256", "feature", "lang").collect())) for waves in (1, 3)]
    assert rows[0] == rows[1] and len(rows[0]) == 41
    media = {r["doc_id"]: bytes(r["media"]) for r in audio.encode(docs.select("doc_id", "text")).collect()}
    for r in audio.stored_features(docs, stage, 2).collect():
        codec, data = audio.unwrap(media[r["doc_id"]])
        pcm = np.concatenate(list(audio.resampled(audio.pcm_pieces(codec, data)))).astype("<i2").tobytes()
        assert r["feature"].startswith(f"{codec}:{len(pcm) // 2}:") and r["feature"].endswith(hashlib.sha256(pcm).hexdigest()[:16])
