"""Audio columns: lossless 8-bit samples in RIFF/WAVE form and features computed from what was stored.

Features: polyphase resampling of the samples, overlapped frames through a log-mel filterbank, and
hysteresis segmentation by energy. Each segment's log-mel frames are pooled to one tensor
of a fixed shape; a row's tensors are stored as an Arrow fixed-shape tensor column, with time spans.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

RATE, UP, DOWN, TAPS = 8000, 3, 4, 12
FRAME, HOP, MELS, STEPS = 256, 128, 20, 4
#: Frames that one step transforms at once: a bound on memory for very long payloads.
CHUNK = 4096
SCHEMA = (
    "id {id}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "media binary, tensors binary, spans array<struct<start_s:double,end_s:double>>"
)


def to_wave(payload: bytes, rate: int = RATE) -> bytes:
    """Unsigned 8-bit mono PCM in a RIFF/WAVE container; the payload's length must be even."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    data = struct.pack("<4sI", b"data", len(payload)) + payload
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + len(data), b"WAVE") + fmt + data


def from_wave(media: bytes) -> tuple[bytes, int]:
    """Samples and rate, by walking the container's chunks."""
    riff, _, wave = struct.unpack_from("<4sI4s", media)
    if (riff, wave) != (b"RIFF", b"WAVE"):
        raise ValueError("not a RIFF/WAVE file")
    at, rate = 12, None
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif name == b"data":
            if rate is None or at + 8 + size > len(media):
                raise ValueError("data without format, or cut short")
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@lru_cache(maxsize=1)
def _phases() -> list[np.ndarray]:
    """The low-pass filter of the resampler, one branch for each output phase."""
    n = np.arange(TAPS * UP) - (TAPS * UP - 1) / 2
    h = np.sinc(n / max(UP, DOWN)) * np.hamming(TAPS * UP)
    h = (h / h.sum() * UP).astype(np.float32)
    return [np.ascontiguousarray(h[p::UP][::-1]) for p in range(UP)]


@lru_cache(maxsize=1)
def _mel() -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale, as (bins, MELS)."""
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), MELS + 2) / 2595) - 1)
    freq = np.arange(FRAME // 2 + 1) * rate / FRAME
    rise = (freq[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[None, 2:] - freq[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


_WINDOW = np.hanning(FRAME).astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """``UP / DOWN`` times the rate: output m takes branch ``m * DOWN mod UP`` at input ``m * DOWN // UP``."""
    n_out = -(-len(x) * UP // DOWN)
    padded = np.concatenate([np.zeros(TAPS - 1, np.float32), x, np.zeros(DOWN, np.float32)])
    seen = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    out = np.empty(n_out, np.float32)
    for p, h in ((m * DOWN % UP, m) for m in range(UP)):
        branch = _phases()[p]
        start, count = h * DOWN // UP, len(range(h, n_out, UP))
        for at in range(0, count, CHUNK * 16):
            rows = slice(start + at * DOWN, start + min(at + CHUNK * 16, count) * DOWN, DOWN)
            out[h + at * UP : h + min(at + CHUNK * 16, count) * UP : UP] = seen[rows] @ branch
    return out


def log_mel(y: np.ndarray) -> np.ndarray:
    """(frames, MELS), frames overlapping by half; a short or ragged end is filled with zeros."""
    frames = max(1, -(-(len(y) - FRAME + HOP) // HOP))
    y = np.concatenate([y, np.zeros(max(0, (frames - 1) * HOP + FRAME - len(y)), np.float32)])
    seen = np.lib.stride_tricks.sliding_window_view(y, FRAME)[:: HOP]
    out = np.empty((frames, MELS), np.float32)
    for at in range(0, frames, CHUNK):
        spectrum = np.fft.rfft(seen[at : at + CHUNK] * _WINDOW, axis=1)
        out[at : at + CHUNK] = np.log((spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ _mel() + np.float32(1e-6))
    return out


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames that begin above the upper threshold and last until below the lower one."""
    mean, spread = float(energy.mean()), float(energy.std())
    mark = np.where(energy >= mean + 0.5 * spread, 1, np.where(energy < mean - 0.5 * spread, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.where(last >= 0, mark[last] == 1, False)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def pool(frames: np.ndarray) -> np.ndarray:
    """Mean frames in STEPS equal parts; parts may share a frame where there are fewer frames than parts."""
    n = len(frames)
    cut = [(i * n // STEPS, max(-(-(i + 1) * n // STEPS), i * n // STEPS + 1)) for i in range(STEPS)]
    return np.stack([frames[a:b].mean(0) for a, b in cut])


def tensor_column(parts: list[np.ndarray]) -> bytes:
    """An Arrow stream with one fixed-shape tensor column ``logmel`` of shape (STEPS, MELS)."""
    kind = pa.fixed_shape_tensor(pa.float32(), (STEPS, MELS))
    flat = np.concatenate(parts).ravel() if parts else np.zeros(0, np.float32)
    column = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(flat, pa.float32()), STEPS * MELS))
    batch = pa.RecordBatch.from_arrays([column], ["logmel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(stream: bytes) -> np.ndarray:
    """The tensors of ``tensor_column`` as (segments, STEPS, MELS)."""
    column = pa.ipc.open_stream(stream).read_all().column("logmel").combine_chunks()
    return column.to_numpy_ndarray() if len(column) else np.zeros((0, STEPS, MELS), np.float32)


def describe(text: str | None) -> tuple:
    """One row's values in the order of SCHEMA after the id; all depend on the text alone."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
    media = to_wave(payload)
    back, rate = from_wave(media)
    x = (np.frombuffer(back, np.uint8).astype(np.float32) - 128) / 128
    mel = log_mel(resample(x))
    runs = segments(mel.mean(1))
    tensors = tensor_column([pool(mel[a:b]) for a, b in runs])
    second = HOP / (rate * UP / DOWN)
    spans = [{"start_s": a * second, "end_s": b * second} for a, b in runs]
    active = sum(b - a for a, b in runs)
    feature = f"frames={len(mel)};segments={len(runs)};active={active};mel={','.join(str(round(v * 10)) for v in mel.mean(0, dtype=np.float64).tolist())}"
    return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, media, tensors, spans


def audio_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """The payload of every whole text as stored audio, with features, one row per input row.

    ``columns`` names the columns to return beside the id (default: all of SCHEMA, the media and the tensors too).
    Null text counts as empty: 64 zero bytes. Repeated rows and null ids keep a row each, equal texts
    have equal values, other columns are ignored; an empty table gives none.
    """
    # Media leave as they came in, so a batch is bounded by the bytes of its texts.
    small_batches(docs.sparkSession, rows=128, mb=16)
    kind = docs.schema[id_col].dataType.simpleString()
    fields = SCHEMA.format(id=kind).split(", ")
    names = [f.split()[0] for f in fields]
    wanted = [0] + [i for i, n in enumerate(names) if i and (columns is None or n in columns)]
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<struct<start_s:double,end_s:double>>": pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))}

    def run(batches):
        for batch in batches:
            rows = [describe(t) for t in batch.column(1).to_pylist()]
            arrays = [batch.column(0)] + [pa.array([r[i - 1] for r in rows], types[fields[i].split(" ", 1)[1]]) for i in wanted[1:]]
            yield pa.RecordBatch.from_arrays(arrays, [names[i] for i in wanted])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join(fields[i] for i in wanted)).withColumnRenamed("id", id_col)


def op8_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``audio_features`` over ``documents``: the digests, and each segment's tensor and time span."""
    digests = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return audio_features(table(spark, sf_dir, "documents"), columns=[*digests, "tensors", "spans"])
