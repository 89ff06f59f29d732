"""Media columns: audio that is stored losslessly, and features of it.

The stored form is a WAV file of unsigned 8-bit mono samples. Features come
from what is read back: the samples are resampled by a polyphase filter, cut
into overlapping frames, and turned into log-mel energies; spans of energy come
from a threshold with hysteresis. Log-mel energies are kept as Arrow tensors of
one fixed shape (frames, bands), the last one padded, each with the span of
time that it covers.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm.words import arrow_schema, chunks

#: Payloads fill whole blocks of so many bytes.
BLOCK = 64
#: Frames that are transformed at a time; bounds the memory of a long recording.
FRAMES_AT_ONCE = 4096


@dataclass(frozen=True)
class Audio:
    """Sample rates in Hz, frame sizes in samples of the new rate, levels in dB over the quietest tenth of the frames."""

    rate: int = 24_000
    new_rate: int = 16_000
    half_taps: int = 8
    frame: int = 400
    hop: int = 160
    fft: int = 512
    bands: int = 64
    tensor_frames: int = 32
    enter: float = 3.0
    leave: float = 1.5
    least_ms: int = 30


def payload_of(text: bytes) -> bytes:
    """``text`` and zeros up to a positive multiple of ``BLOCK``."""
    return text + bytes(-len(text) % BLOCK if text else BLOCK)


def to_wav(samples: bytes, rate: int) -> bytes:
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(samples) % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + bytes(len(samples) % 2)


def from_wav(stored: bytes) -> tuple[int, bytes]:
    """Rate and samples of a stored recording; ValueError if it is not 8-bit mono PCM."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(stored):
        kind, size = struct.unpack_from("<4sI", stored, at)
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", stored, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif kind == b"data":
            return rate, stored[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


@lru_cache
def _filter(up: int, down: int, half: int) -> np.ndarray:
    """A Hann-windowed sinc below the lower Nyquist rate, filled up with zeros to whole rounds of phases."""
    wide = max(up, down)
    t = np.arange(-half * wide, half * wide + 1)
    h = np.sinc(t / wide) / wide * np.hanning(len(t) + 2)[1:-1] * up
    return np.concatenate([h, np.zeros(-len(h) % up)]).astype(np.float32)


def resample(x: np.ndarray, up: int, down: int, half: int) -> np.ndarray:
    """``x`` at ``up / down`` times its rate.

    Output m looks at the inputs around m * down / up through the taps of its
    phase, (m * down + lead) mod up; no zeros are stuffed and nothing is
    computed that is not kept. Outputs of a phase are one strided product.
    """
    g = int(np.gcd(up, down))
    up, down = up // g, down // g
    if up == down or not len(x):
        return x
    lead, h, n = half * max(up, down), _filter(up, down, half), -(-len(x) * up // down)
    k = len(h) // up
    out = np.empty(n, np.float32)
    padded = np.concatenate([np.zeros(k - 1, np.float32), x, np.zeros(lead // up + 1, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, k)
    for m in range(min(up, n)):
        newest, phase = divmod(m * down + lead, up)
        out[m::up] = windows[newest::down][: len(out[m::up])] @ h[phase::up][::-1]
    return out


@lru_cache
def mel_filters(rate: int, fft: int, bands: int) -> np.ndarray:
    """Triangles of equal width on the mel scale, (fft / 2 + 1, bands)."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), bands + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, fft // 2 + 1)[:, None]
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(0, np.minimum((f - low) / (mid - low), (high - f) / (high - mid))).astype(np.float32)


def log_mel(x: np.ndarray, a: Audio) -> np.ndarray:
    """Natural logarithms of mel energies, (frames, bands); a recording shorter than a frame is one padded frame."""
    x = np.concatenate([x, np.zeros(max(0, a.frame - len(x)), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, a.frame)[:: a.hop]
    window, filters, out = np.hanning(a.frame).astype(np.float32), mel_filters(a.new_rate, a.fft, a.bands), []
    for at in range(0, len(frames), FRAMES_AT_ONCE):
        spectrum = np.fft.rfft(frames[at : at + FRAMES_AT_ONCE] * window, a.fft)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        out.append(np.log(power @ filters + 1e-6))
    return np.concatenate(out)


def spans(mel: np.ndarray, a: Audio) -> list[tuple[int, int]]:
    """Times in ms of runs over the leaving level that reach the entering level, of ``least_ms`` at least."""
    level = 10 * np.log10(np.exp(mel).mean(axis=1))
    floor = np.quantile(level, 0.1)
    over = np.concatenate([[False], level > floor + a.leave, [False]])
    edges = np.flatnonzero(np.diff(over.astype(np.int8)))
    peaks = np.concatenate([[0], np.cumsum(level > floor + a.enter)])
    ms = 1000 / a.new_rate
    found = [(round(s * a.hop * ms), round(((e - 1) * a.hop + a.frame) * ms)) for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()) if peaks[e] > peaks[s]]
    return [(s, e) for s, e in found if e - s >= a.least_ms]


def tensors(mel: np.ndarray, a: Audio) -> pa.RecordBatch:
    """Fixed-shape tensors of ``mel`` with their frames and spans of time; values as half floats."""
    n = -(-len(mel) // a.tensor_frames)
    full = np.zeros((n, a.tensor_frames, a.bands), np.float16)
    full.reshape(-1, a.bands)[: len(mel)] = np.round(mel, 2)
    used = np.minimum(a.tensor_frames, len(mel) - np.arange(n) * a.tensor_frames)
    starts = np.arange(n) * a.tensor_frames * a.hop * 1000 // a.new_rate
    ends = ((np.arange(n) * a.tensor_frames + used - 1) * a.hop + a.frame) * 1000 // a.new_rate
    return pa.RecordBatch.from_arrays([pa.FixedShapeTensorArray.from_numpy_ndarray(full), pa.array(used, pa.int32()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["log_mel", "frames", "start_ms", "end_ms"])


def read_tensors(stored: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(stored).read_next_batch()


def features(samples: bytes, rate: int, a: Audio) -> tuple[int, list[tuple[int, int]], bytes]:
    """Number of frames, spans, and the tensors as an Arrow stream."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    mel = log_mel(resample(x, a.new_rate, rate, a.half_taps), a)
    sink = pa.BufferOutputStream()
    batch = tensors(mel, a)
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return len(mel), spans(mel, a), sink.getvalue().to_pybytes()


PLAIN = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames long"
SPAN = pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())])


def media_columns(docs: DataFrame, a: Audio = Audio(), keep_media: bool = True) -> DataFrame:
    """Recordings and features of ``docs`` (doc_id, text): PLAIN, spans, tensors and, if kept, media.

    Null and empty texts give one block of zeros. Digests are of what is read
    back from the stored bytes. Each row depends on its own text alone, so equal
    texts have equal values; rows that repeat stay. Other columns are left out.
    Texts go through Python one at a time, in batches of a few MB.
    """
    extra = [pa.field("spans", pa.list_(SPAN)), pa.field("tensors", pa.binary())] + [pa.field("media", pa.binary())] * keep_media
    schema = pa.schema([*arrow_schema(PLAIN), *extra])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in chunks(batches):
            rows = []
            for key, text in zip(piece.column(0).to_pylist(), texts):
                stored = to_wav(payload_of(text), a.rate)
                rate, payload = from_wav(stored)
                frames, found, tensor = features(payload, rate, a)
                rows.append((key, len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(stored), hashlib.sha256(stored).hexdigest(), frames, [{"start_ms": s, "end_ms": e} for s, e in found], tensor, stored)[: len(schema)])
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    ddl = f"{PLAIN}, spans array<struct<start_ms: long, end_ms: long>>, tensors binary" + ", media binary" * keep_media
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(apply, ddl)


def op1_audio_features(spark, sf_dir: str) -> DataFrame:
    """Digests of the recordings and features of all documents."""
    m = media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_media=False)
    feature = F.concat_ws(":", "frames", F.size("spans"), F.sha2("tensors", 256), F.to_json("spans"))
    return m.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
