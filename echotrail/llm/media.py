"""Texts as sound: WAV media columns and spectral fingerprints.

A text's UTF-8 bytes, padded with spaces to a positive multiple of BLOCK, are
the 8-bit samples of a mono WAV file, written and read by the ``wave``
module. Of the samples read back a short-time Fourier transform is taken
(Hann window of BLOCK samples, half overlapping); frames whose strongest bin
stands above its neighbours in time are peaks, and each peak paired with the
next FAN peaks (up to REACH frames on) is a fingerprint: its time in the high
bits, the two frequencies and the time between in the low ones. Magnitudes are
compared to DIGITS decimals, so that ties don't hang on the order of a sum.

A null text is an empty one (a block of spaces). Equal texts have equal
values; nothing depends on the row's place. Of equally strong bins the lowest,
of equally strong neighbouring frames the first is taken. Rows that repeat a
doc_id, or have none, are rows like others; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, slices, table, texts_of

BLOCK, RATE, FAN, REACH, DIGITS = 192, 8000, 3, 63, 3
#: Frames transformed at once.
FRAMES = 8192
_HOP = BLOCK // 2
_HANN = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(BLOCK) / BLOCK)


def payload_of(text: bytes) -> bytes:
    return text + b" " * (-len(text) % BLOCK or (0 if text else BLOCK))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as f:
        return f.readframes(f.getnframes())


def spectral_peaks(samples: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The strongest bin (not the constant) and its magnitude, of the frames at ``starts``."""
    bins, size = np.empty(len(starts), dtype=np.int64), np.empty(len(starts))
    view = np.lib.stride_tricks.sliding_window_view(samples, BLOCK)
    for lo in range(0, len(starts), FRAMES):
        frames = view[starts[lo : lo + FRAMES]].astype(np.float64) - 128
        power = np.round(np.abs(np.fft.rfft(frames * _HANN, axis=1))[:, 1:], DIGITS)
        at = power.argmax(axis=1)
        bins[lo : lo + FRAMES] = at + 1
        size[lo : lo + FRAMES] = power[np.arange(len(at)), at]
    return bins, size


def fingerprints(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of all payloads in order, each payload's offsets, and its number of peaks."""
    samples = np.frombuffer(b"".join(payloads), dtype=np.uint8)
    ends = np.cumsum([len(p) for p in payloads])
    starts = np.arange(0, len(samples) - BLOCK + 1, _HOP)
    owner = np.searchsorted(ends, starts, side="right")
    whole = starts + BLOCK <= ends[owner]
    starts, owner = starts[whole], owner[whole]
    bins, size = spectral_peaks(samples, starts)
    time = starts // _HOP - ((ends - [len(p) for p in payloads]) // _HOP)[owner]
    same = owner[1:] == owner[:-1]
    lower = np.ones(len(size), dtype=bool)
    lower[1:] &= ~same | (size[1:] > size[:-1])
    lower[:-1] &= ~same | (size[:-1] >= size[1:])
    peak = np.flatnonzero(lower)
    where, t, f = owner[peak], time[peak], bins[peak]
    codes, at = [], []
    for k in range(1, FAN + 1):
        gap = t[k:] - t[:-k]
        near = (where[k:] == where[:-k]) & (gap <= REACH)
        i = np.flatnonzero(near)
        codes.append(t[i] << 20 | f[i] << 13 | f[i + k] << 6 | gap[i])
        at.append(where[i])
    code, at = np.concatenate(codes), np.concatenate(at)
    order = np.lexsort((code, at))
    offsets = np.searchsorted(at[order], np.arange(len(payloads) + 1))
    return code[order], offsets, np.bincount(where, minlength=len(payloads))


_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()),
    T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()),
    T.StructField("fingerprints", T.ArrayType(T.LongType())), T.StructField("media", T.BinaryType()),
])


def media_column(docs: DataFrame, keep_media: bool = True) -> DataFrame:
    """For every row: the WAV file (or null), its digests and its fingerprints."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch.column(1))
        rows, prints, size = [], [], []
        for lo, hi in slices(texts):
            media = [to_wav(payload_of(t)) for t in texts[lo:hi]]
            back = [from_wav(m) for m in media]
            code, offsets, peaks = fingerprints(back)
            prints.append(code)
            size.append(np.diff(offsets))
            for i, (t, p, m) in enumerate(zip(texts[lo:hi], back, media, strict=True)):
                own = code[offsets[i] : offsets[i + 1]]
                feature = f"{len(p) // _HOP - 1}:{peaks[i]}:{len(own)}:{hashlib.sha1(own.astype('<i8').tobytes()).hexdigest()}"
                rows.append((len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature, m if keep_media else None))
        columns = list(zip(*rows, strict=True))
        ends = np.concatenate(([0], np.cumsum(np.concatenate(size)))).astype(np.int32)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.record_batch(
            [
                batch.column(0).cast(pa.int64()), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=False)],
                pa.ListArray.from_arrays(ends, pa.array(np.concatenate(prints).astype(np.int64))), pa.array(columns[7], pa.binary()),
            ],
            names=_SCHEMA.names,
        )

    return map_batches(docs, ["doc_id", "text"], run, _SCHEMA)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprints as text, separated by commas."""
    found = media_column(table(spark, sf_dir, "documents"), keep_media=False).drop("media")
    return found.withColumn("fingerprints", F.array_join(F.col("fingerprints").cast("array<string>"), ","))
