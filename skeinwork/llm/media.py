"""Media columns: texts as 8-bit mono WAV, read back with the wave module, and spectral-peak pair fingerprints.

A payload is the UTF-8 text and bytes 255 up to a positive multiple of 576. Frames of 576 samples are transformed by a
short-time Fourier transform; a frame's peaks are its strongest local maxima, and each peak is paired with peaks of the
next frames. A pair is coded as (first bin, second bin, frames between, first frame): a time-coded array of integers.
Frames are taken in blocks, so memory is bounded by the payload and one block. Rows are independent.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skeinwork.llm.common import few_rows

FRAME = 576
TAIL = 32
RATE = 8000
PEAKS = 3
AHEAD = 2
BLOCK = 512

SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, n_pairs long, fingerprint array<long>"
)
HELD_BYTES = 16 << 20
_WINDOW = np.hanning(FRAME).astype(np.float32)


def padded(data: bytes) -> bytes:
    """The payload of a text's bytes."""
    return data + b"\xff" * (-len(data) % FRAME or (0 if data else FRAME))


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
        return r.readframes(r.getnframes())


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frame and bin of the PEAKS strongest local maxima of each frame's magnitude, strongest first, ties to lower bins."""
    x = np.frombuffer(samples, np.uint8)
    frames = len(x) // FRAME
    times, bins = [], []
    for a in range(0, frames, BLOCK):
        block = x[a * FRAME : min(frames, a + BLOCK) * FRAME].reshape(-1, FRAME).astype(np.float32) - 128.0
        power = np.abs(np.fft.rfft(block * _WINDOW, axis=1)).astype(np.float32)
        inner = power[:, 1:-1]
        strength = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]), np.round(inner, 1), -1.0)
        top = np.argsort(-strength, axis=1, kind="stable")[:, :PEAKS]
        good = np.take_along_axis(strength, top, 1) > 0
        row, col = np.nonzero(good)
        times.append(row + a)
        bins.append(top[row, col] + 1)
    return (np.concatenate(times), np.concatenate(bins)) if times else (np.empty(0, int), np.empty(0, int))


def fingerprint(samples: bytes) -> np.ndarray:
    """Codes time << 22 | first bin << 12 | second bin << 2 | frames between, in order of time."""
    t, b = peaks(samples)
    if not len(t):
        return np.empty(0, np.int64)
    first = np.searchsorted(t, np.arange(t[-1] + AHEAD + 2))
    out = []
    for d in range(1, AHEAD + 1):
        lo, hi = first[t + d], first[t + d + 1]
        n = hi - lo
        left = np.repeat(np.arange(len(t)), n)
        right = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        out.append(t[left].astype(np.int64) << 22 | b[left].astype(np.int64) << 12 | b[right].astype(np.int64) << 2 | d)
    return np.sort(np.concatenate(out))


def digest(codes: np.ndarray) -> str:
    """A short form of a fingerprint: number of pairs and the 64-bit hash of its codes."""
    return f"{len(codes)}:{hashlib.blake2b(codes.astype('<i8').tobytes(), digest_size=8).hexdigest()}"


def media_columns(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """Stored form and features of every text; a null text is empty, so one frame of 255. Repeated rows and null ids are kept.

    with_media adds the stored WAV itself as column media. Equal texts give equal values. An empty table gives no rows; columns
    other than doc_id and text are left out, whatever their names. A very long text is one task's work; rows are sent on after
    64, or HELD_BYTES of codes and media, so one such text doesn't hold others back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            rows: list[tuple] = []
            held = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (text or "").encode()
                media = to_wav(padded(data))
                back = from_wav(media)
                codes = fingerprint(back)
                rows.append((
                    doc_id, len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-TAIL:]), len(media),
                    hashlib.sha256(media).hexdigest(), digest(codes), len(codes), codes, media if with_media else None,
                ))
                held += codes.nbytes + (len(media) if with_media else 0)
                if len(rows) == 64 or held >= HELD_BYTES:
                    yield pack(rows)
                    rows, held = [], 0
            yield pack(rows)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * 11
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
        names = [x.split()[0] for x in SCHEMA.split(", ")] + ["media"]
        k = 11 if with_media else 10
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols[:k], kinds, strict=False)], names=names[:k])

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, SCHEMA + (", media binary" if with_media else ""))
