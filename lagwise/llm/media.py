"""Media columns: payloads as 8-bit PCM WAV, short-time Fourier transforms and
spectral-peak pair fingerprints kept as time-coded arrays."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Payloads fill whole frames of so many samples.
BLOCK = 576
RATE = 8_000
FRAME, HOP = 576, 288
#: Peaks are sought below this bin; each frame keeps the strongest of each band.
BANDS = ((4, 24), (24, 72), (72, 144), (144, 288))
#: A peak is paired with all peaks of so many next frames.
AHEAD = 2
#: Frames transformed at a time, which bounds memory for long payloads.
FRAMES_AT_ONCE = 2_048


def pad(data: bytes, block: int = BLOCK, fill: int = 255) -> bytes:
    """data and fill bytes up to a positive multiple of block."""
    return data + bytes([fill]) * (block * max(1, -(-len(data) // block)) - len(data))


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """One channel of unsigned 8-bit samples, one for each byte."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("expected one channel of 8-bit samples")
        return w.readframes(w.getnframes())


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of the strongest bin in each band of each frame, where it stands
    above the frame's mean magnitude."""
    x = np.frombuffer(samples, np.uint8)
    n = max(1, 1 + (len(x) - FRAME) // HOP)
    window = np.hanning(FRAME).astype(np.float32)
    times, bins = [], []
    for first in range(0, n, FRAMES_AT_ONCE):
        last = min(n, first + FRAMES_AT_ONCE)
        part = x[first * HOP : (last - 1) * HOP + FRAME].astype(np.float32) - 128
        part = np.pad(part, (0, (last - first - 1) * HOP + FRAME - len(part)))
        view = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        # whole numbers, so that equal samples give equal peaks wherever they are computed
        power = np.rint(np.abs(np.fft.rfft(view * window, axis=1)) * 16)
        floor = power[:, BANDS[0][0] : BANDS[-1][1]].mean(axis=1)
        for lo, hi in BANDS:
            best = power[:, lo:hi].argmax(axis=1)
            strong = power[np.arange(len(best)), best + lo] > floor
            times.append(np.flatnonzero(strong) + first)
            bins.append(best[strong] + lo)
    t, b = np.concatenate(times), np.concatenate(bins)
    order = np.lexsort((b, t))
    return t[order], b[order]


def pairs(t: np.ndarray, b: np.ndarray, ahead: int = AHEAD) -> tuple[np.ndarray, np.ndarray]:
    """Time-coded fingerprints of the peaks (t, b), which are in order: for each anchor peak
    and each peak of the next `ahead` frames, in whichever band, the anchor's frame and a
    code of (anchor bin, other bin, frames between), in order of anchors and others."""
    first = np.searchsorted(t, t, side="right")
    n = np.searchsorted(t, t + ahead, side="right") - first
    anchor = np.repeat(np.arange(len(t)), n)
    other = np.arange(len(anchor)) - np.repeat(np.cumsum(n) - n, n) + first[anchor]
    code = (b[anchor] << 15) | (b[other] << 6) | (t[other] - t[anchor])
    return t[anchor].astype(np.int32), code.astype(np.int32)


def describe(data: bytes) -> tuple:
    """The digest columns of one text's bytes, and its fingerprint arrays."""
    stored = to_wav(pad(data))
    back = from_wav(stored)
    when, code = pairs(*peaks(back))
    feature = hashlib.sha256(when.astype("<i4").tobytes() + code.astype("<i4").tobytes()).hexdigest()[:32]
    return (len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored),
            hashlib.sha256(stored).hexdigest(), f"{len(when)}:{feature}", when, code)


_COLUMNS = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature",
            "peak_times", "peak_codes")
_SCHEMA = ("n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
           "media_sha256 string, feature string, peak_times array<int>, peak_codes array<int>")


def media_columns(docs: DataFrame, text: str = "text", keep_media: bool = False) -> DataFrame:
    """docs plus one struct column `media` made of the text's UTF-8 bytes.

    The bytes are padded with 255 to a positive multiple of 576, written as a WAV
    of 8-bit samples and read back; every figure is taken of what was read back.
    peak_times and peak_codes are the fingerprint, in order of time; `feature` is
    its size and digest. keep_media adds the WAV itself as binary. A null text
    counts as empty (one frame of padding). Equal texts give equal values; rows
    are independent, so repeated rows and null ids pass through. A column of docs
    named `media` is replaced.
    """

    schema = _SCHEMA + (", wav binary" if keep_media else "")

    @F.pandas_udf(schema)
    def media(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            data = [t.encode("utf-8", "surrogatepass") for t in s]
            out = pd.DataFrame([describe(d) for d in data], columns=_COLUMNS)
            if keep_media:
                out["wav"] = [to_wav(pad(d)) for d in data]
            yield out

    return docs.withColumn("media", media(F.coalesce(F.col(text), F.lit(""))))


def query(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return media_columns(docs).select("doc_id", *[F.col(f"media.{c}").alias(c) for c in _COLUMNS])
