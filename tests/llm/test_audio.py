import hashlib
import random
import zlib

import numpy as np
import pytest

from strandline.llm import audio as A


def plain_mulaw(code):
    code = ~code & 0xFF
    size = ((code & 0xF) * 2 + 33 << (code >> 4 & 7)) - 33
    return -4 * size if code & 0x80 else 4 * size


def plain_alaw(code):
    code ^= 0x55
    exponent, part = code >> 4 & 7, code & 0xF
    size = part * 2 + 1 if exponent == 0 else (part * 2 + 33) << (exponent - 1)
    return 8 * size if code & 0x80 else -8 * size


def test_tables():
    assert A.TABLES["mulaw"].tolist() == [plain_mulaw(c) for c in range(256)]
    assert A.TABLES["alaw"].tolist() == [plain_alaw(c) for c in range(256)]


def plain_adpcm(block):
    sample = int.from_bytes(block[:2], "little", signed=True)
    index = min(block[2], 88)
    out = [sample]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = int(A.IMA_STEPS[index])
            size = step // 8 + (step if nibble & 4 else 0) + (step // 2 if nibble & 2 else 0) + (step // 4 if nibble & 1 else 0)
            sample = max(-32768, min(32767, sample - size if nibble & 8 else sample + size))
            index = max(0, min(88, index + int(A.IMA_MOVES[nibble])))
            out.append(sample)
    return out


def test_adpcm_blocks_side_by_side(monkeypatch):
    monkeypatch.setattr(A, "STEPS_AT_ONCE", 3)
    rng = random.Random(1)
    files = [("ima_adpcm", rng.randbytes(64 * n)) for n in (1, 5, 2)]
    for (_, data), pcm in zip(files, A.pcm_of(files)):
        assert pcm.tolist() == [s for i in range(0, len(data), 64) for s in plain_adpcm(data[i : i + 64])]


@pytest.mark.parametrize("rate,target", [(8000, 16000), (8000, 8000), (8000, 11025), (16000, 8000)])
def test_resample(rate, target, monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(A, "RESAMPLED", 37)
    pcm = np.array([rng.randrange(-32768, 32768) for _ in range(200)], np.int16)
    want = []
    for k in range(len(pcm) * target // rate):
        left, part = divmod(k * rate, target)
        right = min(left + 1, len(pcm) - 1)
        want.append((int(pcm[left]) * (target - part) + int(pcm[right]) * part) // target)
    assert A.resample(pcm, rate, target).tolist() == want


@pytest.mark.parametrize("codec", list(A.CODECS))
@pytest.mark.parametrize("size", [0, 1, 64, 65, 1000])
def test_files_round_trip(codec, size):
    payload = A.pad(bytes(i % 251 for i in range(size)))
    assert len(payload) % 64 == 0 and len(payload) >= 64
    media = A.wav(payload, codec)
    assert media[:4] == b"RIFF" and int.from_bytes(media[4:8], "little") == len(media) - 8
    assert A.unwrap(media) == (codec, 8000, payload)


def test_every_row_comes_back(spark):
    texts = [None, "", "é" * 40, "x" * 100_000, "same", "same", "last"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, media int")
    stored = A.decode(A.encode(df, "doc_id", "text"), ("doc_id", "n_bytes"))
    heard = {r.doc_id: r.feature for r in A.features(stored, ("doc_id",)).collect()}
    out = {r.doc_id: r for r in stored.collect()}
    for i, t in enumerate(texts):
        body = (t or "").encode()
        payload = A.pad(body)
        row = out[i]
        assert (row.n_bytes, row.payload_bytes) == (len(body), len(payload))
        assert row.payload_sha256 == hashlib.sha256(payload).hexdigest() and row.tail_crc32 == zlib.crc32(payload[-64:])
        assert row.media_sha256 == hashlib.sha256(A.wav(payload, row.codec)).hexdigest()
        sound = A.resample(A.pcm_of([(row.codec, payload)])[0], 8000, 16000)
        assert bytes(row.pcm) == sound.astype("<i2").tobytes() and heard[row.doc_id] == A.summary(row.codec, sound)
    assert heard[4] == heard[5] and out[4].media_sha256 == out[5].media_sha256
    assert A.decode(A.encode(df.limit(0), "doc_id", "text")).count() == 0


@pytest.mark.parametrize("size", [0, 1, 2, 3, 1001])
def test_pairs_lose_no_sample(size):
    rng = np.random.default_rng(5)
    pcm = rng.integers(-32768, 32768, size).astype(np.int16)
    assert A.unpaired(*A.paired(pcm)).tolist() == pcm.tolist()


def test_features_in_pieces(monkeypatch):
    pcm = np.random.default_rng(6).integers(-32768, 32768, 1000).astype(np.int16)
    whole = A.summary("mulaw", pcm)
    monkeypatch.setattr(A, "RESAMPLED", 7)
    assert A.summary("mulaw", pcm) == whole


def test_query_hears_every_sample(spark, tmp_path):
    from strandline.llm import queries

    texts = [None, "", "quiet", "a" * 99 + "b", "a" * 98 + "ba", "x" * 5000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    for row in queries.QUERIES["op4_telephony_audio"](spark, str(tmp_path)).collect():
        payload = A.pad((texts[row.doc_id] or "").encode())
        assert row.feature == A.summary(row.codec, A.resample(A.pcm_of([(row.codec, payload)])[0], 8000, 16000))
