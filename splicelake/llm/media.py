"""Media columns: payloads kept as 8-bit audio, and audio features as fixed-shape Arrow tensors with time spans."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from splicelake.llm.common import written

#: Payloads are filled with FILL up to a positive multiple of ALIGN bytes.
ALIGN, FILL = 576, b"\xff"
RATE, TARGET_RATE = 8000, 6000
FRAME, HOP, BANDS = 512, 256, 16
#: Frames of one tensor.
SPAN_FRAMES = 16
_HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")
_MEDIA = "doc_id long, n_bytes long, media binary"
_FEATURES = "doc_id long, n_bytes long, media binary, payload binary, n_frames int, spans array<struct<start_s: double, end_s: double, frames: int>>, tensors binary, segments array<struct<start_s: double, end_s: double>>, bands array<float>"


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """One channel of unsigned 8-bit samples, one for each byte, in a WAV container."""
    return _HEADER.pack(b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload


def from_wav(media: bytes) -> tuple[int, bytes]:
    """Sample rate and samples of an 8-bit WAV of one channel; other chunks are passed over."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV container")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (code, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit PCM of one channel")
        elif name == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


@cache
def _phases(up: int, down: int, half: int = 8) -> np.ndarray:
    """A windowed-sinc low-pass, one row of taps for each of ``up`` phases."""
    wide = max(up, down)
    taps = -(-(2 * half * wide + 1) // up) * up
    t = np.arange(taps) - (taps - 1) / 2
    h = np.sinc(t / wide) * np.hamming(taps)
    return np.ascontiguousarray((h / h.sum() * up).reshape(-1, up).T[:, ::-1], np.float32)


def resample(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """``x`` at another rate. Output n uses only the filter phase (n * down) mod up, on samples about n * down / up."""
    up, down = target // gcd(rate, target), rate // gcd(rate, target)
    h = _phases(up, down)
    taps = h.shape[1]
    padded = np.concatenate([np.zeros(taps // 2, np.float32), x.astype(np.float32), np.zeros(taps + down, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, taps)
    n = -(-len(x) * up // down)
    out = np.empty(n, np.float32)
    for first in range(min(up, n)):
        rows = -(-(n - first) // up)
        out[first::up] = windows[first * down // up :: down][:rows] @ h[first * down % up]
    return out


@cache
def _mel(rate: int, frame: int, bands: int) -> np.ndarray:
    """Triangles evenly spaced in mel: frequency bins x bands."""
    mel = lambda f: 2595 * np.log10(1 + np.asarray(f) / 700)
    edges = np.linspace(0, mel(rate / 2), bands + 2)
    at = mel(np.fft.rfftfreq(frame, 1 / rate))[:, None]
    rise = (at - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - at) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(x: np.ndarray, rate: int, frame: int = FRAME, hop: int = HOP, bands: int = BANDS) -> np.ndarray:
    """Frames x bands: log power of overlapped Hann-windowed frames. The last frame is filled with zeros."""
    n = max(1, -(-max(0, len(x) - frame) // hop) + 1)
    padded = np.zeros((n - 1) * hop + frame, np.float32)
    padded[: len(x)] = x
    frames = np.lib.stride_tricks.sliding_window_view(padded, frame)[::hop] * np.hanning(frame).astype(np.float32)
    spectrum = np.fft.rfft(frames, axis=1)
    power = spectrum.real**2 + spectrum.imag**2
    return np.log(power.astype(np.float32) @ _mel(rate, frame, bands) + np.float32(1e-6)).astype(np.float32)


def segments(energy: np.ndarray, rise: float = 0.5, fall: float = -0.25) -> list[tuple[int, int]]:
    """Runs of frames: each begins where energy passes mean + rise sd and ends where it drops below mean + fall sd."""
    mean, sd = float(energy.mean()), float(energy.std())
    if sd < 1e-6:
        return []
    mark = np.where(energy > mean + rise * sd, 1, np.where(energy < mean + fall * sd, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = (last >= 0) & (mark[last] == 1)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def tensor_stream(mel: np.ndarray, starts: list[float], ends: list[float]) -> bytes:
    """An Arrow stream of ``start_s``, ``end_s`` and ``log_mel``, tensors of one shape (span frames x bands)."""
    whole = np.zeros((len(starts) * SPAN_FRAMES, mel.shape[1]), np.float32)
    whole[: len(mel)] = mel
    tensors = pa.FixedShapeTensorArray.from_numpy_ndarray(whole.reshape(len(starts), SPAN_FRAMES, -1))
    batch = pa.record_batch([pa.array(starts), pa.array(ends), tensors], ["start_s", "end_s", "log_mel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def store(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes`` and ``media``, written to a table of the shared folder and read back from it.

    A text's UTF-8 bytes are filled with bytes 255 to a positive multiple of 576 and kept as WAV samples. Null texts are
    empty ones, so they hold 576 bytes 255. Repeated rows are stored each, null doc_ids pass through, other columns are
    left out, an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            media = [to_wav(t + FILL * (-len(t) % ALIGN or ALIGN * (not t))) for t in texts]
            yield pa.record_batch([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _MEDIA), "media")


def analyse(media: DataFrame) -> DataFrame:
    """A table of ``store`` with each row's ``payload`` as read back, and its audio features.

    ``tensors``: an Arrow stream of fixed-shape log-mel tensors with their time spans, the last filled with zeros;
    ``spans``: these spans and their true numbers of frames; ``segments``: where energy is high, with hysteresis;
    ``bands``: each band's mean.
    """

    def row(media: bytes) -> tuple:
        rate, payload = from_wav(media)
        x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
        mel = log_mel(resample(x, rate, TARGET_RATE), TARGET_RATE)
        second = HOP / TARGET_RATE
        begin = list(range(0, len(mel), SPAN_FRAMES))
        end = [min(b + SPAN_FRAMES, len(mel)) for b in begin]
        starts, ends = [b * second for b in begin], [((e - 1) * HOP + FRAME) / TARGET_RATE for e in end]
        spans = [{"start_s": s, "end_s": e, "frames": n - b} for s, e, b, n in zip(starts, ends, begin, end, strict=True)]
        loud = [{"start_s": a * second, "end_s": b * second} for a, b in segments(mel.mean(1))]
        return payload, len(mel), spans, tensor_stream(mel, starts, ends), loud, mel.mean(0).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int32())])
        loud = pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])
        types = [pa.binary(), pa.int32(), pa.list_(span), pa.binary(), pa.list_(loud), pa.list_(pa.float32())]
        names = ["payload", "n_frames", "spans", "tensors", "segments", "bands"]
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                found = [row(m) for m in batch.column(2).to_pylist()]
                yield pa.record_batch([*batch.columns, *(pa.array([f[k] for f in found], t) for k, t in enumerate(types))], [*batch.schema.names, *names])

    return media.mapInArrow(run, _FEATURES)


def read_bands(features: DataFrame) -> DataFrame:
    """``features`` (``n_frames`` and ``tensors`` of ``analyse``, as they were stored) with ``n_tensors``, ``shape`` and
    ``means``, each band's mean over the true frames, from the tensors as read back."""
    schema = StructType([*features.schema.fields, StructField("n_tensors", IntegerType()), StructField("shape", StringType()), StructField("means", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, shapes, means = [], [], []
            for n, stream in zip(batch.column("n_frames").to_pylist(), batch.column("tensors"), strict=True):
                tensors = pa.ipc.open_stream(stream.as_buffer()).read_all()["log_mel"].combine_chunks().to_numpy_ndarray()
                counts.append(len(tensors))
                shapes.append("x".join(map(str, tensors.shape[1:])))
                means.append(tensors.reshape(-1, tensors.shape[-1])[:n].mean(0, dtype=np.float64).tolist())
            yield pa.record_batch([*batch.columns, pa.array(counts, pa.int32()), pa.array(shapes, pa.string()), pa.array(means, pa.list_(pa.float64()))], [*batch.schema.names, "n_tensors", "shape", "means"])

    return features.mapInArrow(run, schema)
