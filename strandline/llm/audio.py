"""Telephony audio as a media column: store, decode and resample.

A payload is stored as a WAV file with one of three 8 kHz mono codings: mu-law
or A-law (one sample a byte) or IMA ADPCM in blocks of 64 bytes.  Decoding
expands mu-law and A-law by lookup tables and walks ADPCM through all blocks of
many files at once with numpy, one sample step after the other; the PCM is then
resampled by linear interpolation in integers, so equal bytes give equal sound
everywhere.

Defined cases: a null or empty payload is one block of zero bytes.  A last block
shorter than 64 bytes cannot occur, as payloads are padded.  An ADPCM header may
name any step index; it is clamped.  Repeated rows give repeated rows.  Very long
payloads are decoded a bounded number of samples at a time.  Empty tables give no
rows; kept columns may have any name that is not one of the results.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import free_name, in_arrow, slices

UNIT = 64
RATE, TARGET_RATE = 8_000, 16_000
PACKED = {"parquet.compression.codec.zstd.level": "12", "parquet.page.size": str(8 << 20)}  # how the query stores media and samples
RESAMPLED = 1 << 20  # samples made at a time
CODECS = {"mulaw": 7, "alaw": 6, "ima_adpcm": 17}  # format tags of WAV
HEADER = struct.Struct("<4sI4s4sIHHIIHHHH4sI")
BLOCK_SAMPLES = 1 + 2 * (UNIT - 4)
STEPS_AT_ONCE = 16_384  # ADPCM blocks decoded together

# fixed values of the IMA coding: step sizes, and how a nibble moves the index
IMA_STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
     130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
     1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
     7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)
IMA_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << (code >> 4 & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    high = code >> 4 & 7
    size = (code & 0x0F) << 4
    size = np.where(high == 0, size + 8, size + 0x108 << np.maximum(high - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}


def ima_nibble_tables() -> tuple[np.ndarray, np.ndarray]:
    """What a nibble adds to the sample, and the next index, for every index."""
    step = IMA_STEPS[:, None]
    nibble = np.arange(16)[None, :]
    size = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
    index = np.clip(np.arange(len(IMA_STEPS))[:, None] + IMA_MOVES[None, :], 0, len(IMA_STEPS) - 1)
    return np.where(nibble & 8, -size, size).astype(np.int32), index.astype(np.int32)


_ADD, _NEXT = (t.ravel() for t in ima_nibble_tables())


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples of every 64-byte block, all blocks side by side: (blocks, 121)."""
    head = blocks[:, :4]
    sample = (head[:, 0].astype(np.int32) | head[:, 1].astype(np.int8).astype(np.int32) << 8)
    index = np.minimum(head[:, 2].astype(np.int32), len(IMA_STEPS) - 1)
    body = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((BLOCK_SAMPLES, len(blocks)), np.int16)
    out[0] = sample
    for i, byte in enumerate(body):
        for k, nibble in enumerate((byte & 15, byte >> 4)):
            at = (index << 4) + nibble
            sample = np.clip(sample + _ADD[at], -32768, 32767)
            index = _NEXT[at]
            out[1 + 2 * i + k] = sample
    return np.ascontiguousarray(out.T)


def resample(pcm: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Linear interpolation between neighbours, rounded down, in integers."""
    n = len(pcm) * target // rate
    out = np.empty(n, np.int16)
    for start in range(0, n, RESAMPLED):
        at = np.arange(start, min(n, start + RESAMPLED), dtype=np.int64) * rate
        left, part = at // target, at % target
        right = np.minimum(left + 1, len(pcm) - 1)
        out[start : start + len(at)] = (pcm[left].astype(np.int64) * (target - part) + pcm[right].astype(np.int64) * part) // target
    return out


def paired(pcm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every second sample, and how far the ones between are from the mean of their neighbours: no sample is lost."""
    even, odd = pcm[::2], pcm[1::2]
    return even, (odd - _means(even, len(odd))).astype(np.int16)


def unpaired(even: np.ndarray, residue: np.ndarray) -> np.ndarray:
    out = np.empty(len(even) + len(residue), np.int16)
    out[::2] = even
    out[1::2] = _means(even, len(residue)) + residue
    return out


def _means(even: np.ndarray, n: int) -> np.ndarray:
    wide = even.astype(np.int32)
    return (wide[:n] + np.append(wide[1:], wide[-1:])[:n]) >> 1


def pad(payload: bytes) -> bytes:
    return payload + bytes(max(UNIT, -(-len(payload) // UNIT) * UNIT) - len(payload))


def wav(payload: bytes, codec: str) -> bytes:
    """A WAV file around coded bytes."""
    adpcm = codec == "ima_adpcm"
    align, bits = (UNIT, 4) if adpcm else (1, 8)
    second = RATE * UNIT // BLOCK_SAMPLES if adpcm else RATE
    head = HEADER.pack(
        b"RIFF", HEADER.size - 8 + len(payload), b"WAVE", b"fmt ", 20, CODECS[codec], 1, RATE, second, align, bits, 2,
        BLOCK_SAMPLES if adpcm else 1, b"data", len(payload),
    )
    return head + payload


def unwrap(media: bytes) -> tuple[str, int, bytes]:
    """(codec, rate, coded bytes) of a file made by ``wav``."""
    fields = HEADER.unpack_from(media)
    codec = {tag: name for name, tag in CODECS.items()}[fields[5]]
    return codec, fields[7], media[HEADER.size : HEADER.size + fields[14]]


def codec_of(payload: Column) -> Column:
    """A coding that depends on the bytes alone, so that every coding is in use."""
    names = list(CODECS)
    part = F.pmod(F.crc32(payload), F.lit(len(names)))
    return F.when(part == 0, names[0]).when(part == 1, names[1]).otherwise(names[2])


def encode(rows: DataFrame, id_col: str, payload_col: str, codec: Column | None = None) -> DataFrame:
    """(id, n_bytes, codec, media): every payload, padded, as a WAV file."""
    body = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    source = rows.select(
        F.col(id_col).cast("long").alias("doc_id"), body.alias("body"), (codec_of(body) if codec is None else codec).alias("codec")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bodies, codecs = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(b) for b in bodies], pa.int64()),
                    batch.column(2),
                    pa.array([wav(pad(b), c) for b, c in zip(bodies, codecs)], pa.binary()),
                ],
                names=["doc_id", "n_bytes", "codec", "media"],
            )

    return in_arrow(source, work, "doc_id long, n_bytes long, codec string, media binary")


def pcm_of(files: list[tuple[str, bytes]]) -> list[np.ndarray]:
    """PCM of several coded payloads; the ADPCM blocks of all of them are decoded together."""
    blocks = [np.frombuffer(data, np.uint8).reshape(-1, UNIT) for codec, data in files if codec == "ima_adpcm"]
    ends = np.cumsum([len(b) for b in blocks])
    if blocks:
        joined = np.concatenate(blocks)
        parts = [decode_adpcm(joined[i : i + STEPS_AT_ONCE]) for i in range(0, len(joined), STEPS_AT_ONCE)]
        split = iter(np.split(np.concatenate(parts), ends[:-1]))
    out = []
    for codec, data in files:
        out.append(next(split).ravel() if codec == "ima_adpcm" else TABLES[codec][np.frombuffer(data, np.uint8)])
    return out


def summary(codec: str, pcm: np.ndarray) -> str:
    """Whole-number features of a sound: length, extremes, sums, sign changes, checksum."""
    low, high, total, squares, signs = 0, 0, 0, 0, 0
    if len(pcm):
        low, high = int(pcm.min()), int(pcm.max())
    for start in range(0, len(pcm), RESAMPLED):
        wide = pcm[start : start + RESAMPLED].astype(np.int64)
        total, squares = total + int(wide.sum()), squares + int(np.dot(wide, wide))
        # one sample more, so that a change at the edge of two pieces counts
        signs += np.count_nonzero(np.diff(pcm[start : start + RESAMPLED + 1] < 0))
    return f"codec={codec};samples={len(pcm)};low={low};high={high};sum={total};squares={squares};crossings={signs}"


def decode(media: DataFrame, keep: tuple[str, ...] = ("doc_id",), media_col: str = "media", target: int = TARGET_RATE, pairs: bool = False) -> DataFrame:
    """``keep`` plus ``codec``, ``payload`` as stored, and ``pcm`` at ``target`` Hz with its ``rate``.

    With ``pairs`` the samples are stored as ``paired`` gives them, in ``pcm`` and ``residue``.

    ``payload`` is given as its length, SHA-256, and CRC-32 of the last 64 bytes
    next to length and SHA-256 of the file, all from the bytes read back.
    """
    import hashlib
    import zlib

    source = media.select(*keep, F.col(media_col).alias(free_name(list(keep), "media")))
    at = len(keep)
    names = [*keep, "codec", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "rate", "pcm", *(["residue"] if pairs else [])]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            stored = batch.column(at).to_pylist()
            files = [unwrap(m) for m in stored]
            sounds = [resample(p, rate, target) for p, (_, rate, _) in zip(pcm_of([(c, d) for c, _, d in files]), files)]
            halves = [paired(s) for s in sounds] if pairs else [(s,) for s in sounds]
            columns = [
                pa.array([c for c, _, _ in files]),
                pa.array([len(d) for _, _, d in files], pa.int64()),
                pa.array([hashlib.sha256(d).hexdigest() for _, _, d in files]),
                pa.array([zlib.crc32(d[-UNIT:]) for _, _, d in files], pa.int64()),
                pa.array([len(m) for m in stored], pa.int64()),
                pa.array([hashlib.sha256(m).hexdigest() for m in stored]),
                pa.array([target] * len(files), pa.int32()),
                *[pa.array([h.astype("<i2").tobytes() for h in half], pa.binary()) for half in zip(*halves)],
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *columns], names=names)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:at]]
    fields += ["codec string", "payload_bytes long", "payload_sha256 string", "tail_crc32 long", "media_bytes long"]
    fields += ["media_sha256 string", "rate int", "pcm binary", *(["residue binary"] if pairs else [])]
    return in_arrow(source, work, ", ".join(fields))


def features(sounds: DataFrame, keep: tuple[str, ...] = ("doc_id", "codec"), codec_col: str = "codec", pcm_col: str = "pcm", residue_col: str | None = None) -> DataFrame:
    """``keep`` and the ``feature`` of every stored sound, from all samples as they are read."""
    columns = [codec_col, pcm_col, *([residue_col] if residue_col else [])]
    own = [free_name(list(keep), n) for n in ("sound_codec", "sound_pcm", "sound_residue")]
    source = sounds.select(*keep, *[F.col(c).alias(o) for c, o in zip(columns, own)])
    at = len(keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            codecs, *halves = (batch.column(at + i).to_pylist() for i in range(len(columns)))
            parts = ([np.frombuffer(h, "<i2") for h in half] for half in zip(*halves))
            found = pa.array([summary(c, unpaired(*p) if residue_col else p[0]) for c, p in zip(codecs, parts)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], found], names=[*keep, "feature"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:at]]
    return in_arrow(source, work, ", ".join([*fields, "feature string"]))
