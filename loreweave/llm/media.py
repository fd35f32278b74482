"""Media columns: payloads as WAV, spectral-peak pair fingerprints as time-coded arrays.

A payload is stored as 8-bit mono samples by the wave module and read back from
the stored bytes. A short-time Fourier transform (Hann window) gives magnitudes
by frame; in each frequency band of a frame the strongest place is a peak if it
is not weaker than in the frames beside it. Each peak is paired with the next
few peaks that follow it in time: a pair's code holds both frequencies and
their distance in frames, its time is the first frame. Frames are transformed in
blocks, so memory does not follow the payload's length.

Defined cases: null and empty texts are the payload of 64 zero bytes (silence,
no pairs); equal payloads have equal media and features; repeated rows return
once each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from loreweave.llm.common import slices, texts_of

RATE = 8000
UNIT = 64
FRAME = 512
HOP = 256
#: Frames transformed at a time.
BLOCK = 2048
#: Frequency bands, as places of the transform.
BANDS = ((2, 12), (12, 32), (32, 80), (80, 160), (160, FRAME // 2 + 1))
#: Peaks that each peak is paired with, and the most frames between the two.
FAN_OUT = 3
REACH = 63


def payload_of(text: str) -> tuple[int, bytes]:
    """Unpadded length, and the bytes with zeros up to a positive multiple of 64."""
    raw = text.encode()
    return len(raw), raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b"\0")


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        if (r.getnchannels(), r.getsampwidth(), r.getcomptype()) != (1, 1, "NONE"):
            raise ValueError("not 8-bit mono PCM")
        return r.readframes(r.getnframes())


WINDOW = np.hanning(FRAME).astype(np.float32)


def magnitudes(samples: np.ndarray, first: int, last: int) -> np.ndarray:
    """Spectrum magnitudes of frames ``first`` to ``last``; samples beyond the end are silence."""
    part = samples[first * HOP : (last - 1) * HOP + FRAME].astype(np.float32) - 128
    need = (last - 1 - first) * HOP + FRAME
    if len(part) < need:
        part = np.pad(part, (0, need - len(part)))
    frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
    return np.abs(np.fft.rfft(frames * WINDOW, axis=1)).astype(np.float32)


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames and frequency places of the peaks, in order of frame, then place."""
    n = max(1, -(-(len(samples) - FRAME) // HOP) + 1)
    times, places = [], []
    for at in range(0, n, BLOCK):
        low, high, end = max(0, at - 1), min(n, at + BLOCK + 1), min(n, at + BLOCK)
        m = magnitudes(samples, low, high)
        rows = np.arange(at - low, end - low)
        for a, b in BANDS:
            best = a + m[rows, a:b].argmax(1)
            here = m[rows, best]
            prior = np.where(rows > 0, m[np.maximum(rows - 1, 0), best], 0)
            later = np.where(rows + 1 < len(m), m[np.minimum(rows + 1, len(m) - 1), best], 0)
            is_peak = (here > 1e-3) & (here >= prior) & (here >= later)
            times.append(rows[is_peak] + low)
            places.append(best[is_peak])
    t, f = np.concatenate(times), np.concatenate(places)
    order = np.lexsort((f, t))
    return t[order], f[order]


def pairs(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``times, codes`` of the peak pairs, in order of time."""
    t, f = peaks(samples)
    times, codes, ranks = [], [], []
    for step in range(1, FAN_OUT + 1):
        a, b = slice(None, -step or None), slice(step, None)
        gap = t[b] - t[a]
        near = gap <= REACH
        times.append(t[a][near])
        codes.append((f[a][near] << 15 | f[b][near] << 6 | gap[near]))
        ranks.append(np.nonzero(near)[0] * (FAN_OUT + 1) + step)
    order = np.argsort(np.concatenate(ranks), kind="stable")
    return np.concatenate(times)[order].astype("<i4"), np.concatenate(codes)[order].astype("<i4")


def feature_of(times: np.ndarray, codes: np.ndarray) -> str:
    """Number of pairs and a digest of the time-coded arrays."""
    return f"{len(times)}:{xxhash.xxh3_64_hexdigest(times.tobytes() + codes.tobytes())}"


def media_columns(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media, times, codes``: stored WAV bytes and the arrays read from them."""

    def run(batches):
        for part in slices(batches):
            rows = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                n, payload = payload_of(text)
                media = to_wav(payload)
                times, codes = pairs(np.frombuffer(from_wav(media), np.uint8))
                rows.append({"doc_id": doc_id, "n_bytes": n, "media": media, "times": times, "codes": codes})
            yield pa.RecordBatch.from_pylist(rows, MEDIA)

    return texts_of(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary, times array<int>, codes array<int>")


MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("times", pa.list_(pa.int32())), ("codes", pa.list_(pa.int32()))])
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def media_digests(docs: DataFrame) -> DataFrame:
    """As ``media_columns``, with digests made where the media are: they never leave the worker."""

    def run(batches):
        for part in slices(batches):
            rows = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                n, payload = payload_of(text)
                media = to_wav(payload)
                back = from_wav(media)
                rows.append({"doc_id": doc_id, "n_bytes": n, "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-UNIT:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature_of(*pairs(np.frombuffer(back, np.uint8)))})
            yield pa.RecordBatch.from_pylist(rows, DIGESTS)

    return texts_of(docs).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every text as WAV and its fingerprints, as digests."""
    return media_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
