"""Media columns: WAV files in a binary column, short-time Fourier transforms, and spectral-peak pair fingerprints.

A file is written and read by the wave module: mono, 8 bits a sample. The signal is cut into frames of FRAME samples
without overlap (the last one padded with silence), each windowed and transformed. In each of BANDS bands of a frame
the strongest bin is a peak if it isn't silent. A peak is paired with those of higher bands in its frame and with all of the next REACH frames; a
fingerprint is an array of (frame << 32 | bin << 20 | other bin << 8 | distance), ordered by frame.

Defined results: null and empty payloads are one block of 64 zero bytes; equal payloads have equal media and features,
whatever stands beside them; a null id is kept; repeated rows are handled alike; an empty table gives an empty
result; other columns are ignored.
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
from pyspark.sql import functions as F

from tessera.llm.common import text_bytes

RATE, FRAME, BANDS, REACH = 8000, 512, 4, 1
#: Samples that are transformed at once; a multiple of FRAME.
PIECE = FRAME * 1024
_WINDOW = np.hanning(FRAME)


def pad(text: bytes, unit: int = 64) -> bytes:
    return text + b"\0" * (-len(text) % unit if text else unit)


def store(payload: bytes) -> bytes:
    """A WAV file of one 8-bit sample per byte."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def load(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not a mono 8-bit file")
        return w.readframes(w.getnframes())


def spectrum(samples: bytes) -> Iterator[np.ndarray]:
    """Power by frame and frequency, a bounded number of frames at a time."""
    for at in range(0, len(samples), PIECE):
        x = np.frombuffer(samples[at : at + PIECE], np.uint8).astype(np.float64) - 128
        x = np.concatenate([x, np.zeros(-len(x) % FRAME)]).reshape(-1, FRAME)
        f = np.fft.rfft((x - x.mean(axis=1, keepdims=True)) * _WINDOW, axis=1)[:, 1:]
        yield f.real**2 + f.imag**2


def fingerprint(samples: bytes) -> np.ndarray:
    """Time-coded peak pairs."""
    peaks = []
    for power in spectrum(samples):
        bands = power.reshape(len(power), BANDS, -1)
        best = bands.argmax(axis=2)
        loud = np.take_along_axis(bands, best[:, :, None], axis=2)[:, :, 0] > 1e-6
        peaks.append(np.where(loud, best + np.arange(BANDS) * bands.shape[2], -1))
    p = np.concatenate(peaks).astype(np.int64) if peaks else np.zeros((0, BANDS), np.int64)
    t, out = np.arange(len(p))[:, None, None] << 32, []
    higher = np.triu(np.ones((BANDS, BANDS), bool), 1)
    for d in range(REACH + 1):
        if len(p) > d:
            a, b = p[: len(p) - d, :, None], p[d:, None, :]
            if d == 0:
                b = np.where(higher, b, -1)
            out.append(np.where((a >= 0) & (b >= 0), t[: len(p) - d] | a << 20 | b << 8 | d, -1).reshape(-1))
    codes = np.concatenate(out) if out else np.zeros(0, np.int64)
    return np.sort(codes[codes >= 0])


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, fingerprint[, media])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in text_bytes(batch.column(1)):
                stored = store(pad(text))
                payload = load(stored)
                codes = fingerprint(payload)
                feature = f"{len(codes)}:{hashlib.blake2b(codes.tobytes(), digest_size=16).hexdigest()}"
                rows.append((len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, codes, stored))
            columns = list(zip(*rows)) if rows else [()] * 9
            offsets = np.concatenate([[0], np.cumsum([len(c) for c in columns[7]])]).astype(np.int32)
            codes = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(columns[7]) if rows else np.zeros(0, np.int64)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            arrays = [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds)), codes, *([pa.array(columns[8], pa.binary())] if keep else [])]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, fingerprint array<long>" + ", media binary" * keep
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op5_media(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import read

    return media(read(spark, sf_dir, "documents"), keep=False).withColumnRenamed("id", "doc_id")
