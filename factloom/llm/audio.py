"""Media columns: audio held as 8-bit WAV, and log-mel features as fixed-shape Arrow tensors.

The payload is stored as unsigned 8-bit mono PCM. Features come from the stored
bytes: rational resampling by a polyphase filter, overlapped windows, a log-mel
filterbank, and hysteresis segmentation of frame energy (a span opens above the
high threshold and closes below the low one, both relative to the clip's mean).
Frames are cut into tensors of FRAMES x MELS (the last one padded with the floor)
with their time spans, held as one Arrow IPC stream a row.

Defined results: a null text counts as empty and still has one padded unit of
samples; equal payloads give equal bytes and features; repeated rows repeat; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = 192
SOURCE_RATE, RATE, UP, DOWN, TAPS = 12_000, 8_000, 2, 3, 24
WINDOW, HOP, MELS, FRAMES = 256, 128, 24, 32
HIGH_DB, LOW_DB = 1.0, -1.0
#: Frames worked at a time, so that memory does not grow with a clip.
BLOCK = 4096
TENSOR = pa.fixed_shape_tensor(pa.float32(), [FRAMES, MELS])


def payload(text: Column, unit: int = UNIT) -> Column:
    """UTF-8 bytes, padded with blanks to a positive multiple of ``unit``."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    n = F.octet_length(raw)
    return F.concat(raw, F.repeat(F.lit(" "), F.greatest(F.ceil(n / unit), F.lit(1)).cast("int") * unit - n).cast("binary"))


def wav(samples: bytes, rate: int = SOURCE_RATE) -> bytes:
    odd = len(samples) & 1
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + odd, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + samples + b"\0" * odd


def read_wav(media: bytes) -> tuple[int, bytes]:
    """Rate and samples of an 8-bit mono PCM file."""
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif name == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


@cache
def polyphase(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """(up, taps) branches of a Hann-windowed sinc low-pass filter."""
    n = np.arange(up * taps) - (up * taps - 1) / 2
    cutoff = 1 / max(up, down)
    h = np.sinc(n * cutoff) * cutoff * np.hanning(up * taps + 2)[1:-1] * up
    return h.reshape(taps, up).T.astype(np.float32).copy()


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Output k is branch (k * down) % up over the inputs that end at (k * down) // up."""
    branches = polyphase(up, down)
    taps, n = branches.shape[1], -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(taps - 1, np.float32), x, np.zeros(taps, np.float32)])
    out = np.zeros(n, np.float32)
    for first in range(min(up, n)):
        count, start = len(out[first::up]), first * down // up
        acc = np.zeros(count, np.float32)
        for t, w in enumerate(branches[first * down % up]):
            at = start + taps - 1 - t
            acc += w * padded[at : at + count * down : down][:count]
        out[first::up] = acc
    return out


@cache
def mel_bank(mels: int = MELS, window: int = WINDOW, rate: int = RATE) -> np.ndarray:
    """(window // 2 + 1, mels) triangles, evenly spaced on the mel scale."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, window // 2 + 1)[:, None]
    lo, mid, hi = edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(0, np.minimum((f - lo) / (mid - lo), (hi - f) / (hi - mid))).astype(np.float32)


def features(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames (n, MELS) and frame energies in dB."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    y = resample(x)
    n = max(1, -(-(len(y) - WINDOW) // HOP) + 1)
    y = np.concatenate([y, np.zeros(max(0, (n - 1) * HOP + WINDOW - len(y)), np.float32)])
    mel, energy, hann = np.empty((n, MELS), np.float32), np.empty(n), np.hanning(WINDOW).astype(np.float32)
    view = np.lib.stride_tricks.sliding_window_view(y, WINDOW)[::HOP]
    for at in range(0, n, BLOCK):
        frames = view[at : min(at + BLOCK, n)] * hann
        power = np.abs(np.fft.rfft(frames, axis=1)).astype(np.float32) ** 2
        mel[at : at + BLOCK] = np.log(power @ mel_bank() + 1e-6)
        energy[at : at + BLOCK] = 10 * np.log10((frames * frames).mean(1) + 1e-9)
    return mel, energy


def active_spans(energy: np.ndarray, high_db: float = HIGH_DB, low_db: float = LOW_DB) -> np.ndarray:
    """(k, 2) frame spans: open at or above mean + high, held until below mean + low."""
    level = energy - energy.mean()
    state = np.where(level >= high_db, 1, np.where(level < low_db, 0, -1))
    at = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    on = np.where(at >= 0, state[at], 0)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
    return edges.reshape(-1, 2)


def tensor_stream(mel: np.ndarray, spans: np.ndarray) -> bytes:
    """Arrow IPC stream: one row a tensor, with start and end in seconds and its share of active frames."""
    n = len(mel)
    rows = -(-n // FRAMES)
    full = np.full((rows * FRAMES, MELS), np.log(1e-6), np.float32)
    full[:n] = mel
    active = np.zeros(rows * FRAMES, np.float32)
    for a, b in spans:
        active[a:b] = 1
    start = np.arange(rows) * FRAMES * HOP / RATE
    end = (np.minimum((np.arange(rows) + 1) * FRAMES, n) - 1) * HOP / RATE + WINDOW / RATE
    tensors = pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(full.ravel()), FRAMES * MELS))
    batch = pa.RecordBatch.from_arrays([pa.array(start), pa.array(end), pa.array(active.reshape(rows, FRAMES).mean(1)), tensors], ["start_s", "end_s", "active", "logmel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def store_audio(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (the WAV file) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([wav(p.as_py()) for p in part.column(2)], pa.binary())], ["doc_id", "n_bytes", "media"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(F.coalesce(text, F.lit(""))).cast("long").alias("n_bytes"), payload(text).alias("payload"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def audio_features(clips: DataFrame) -> DataFrame:
    """Adds, from the stored ``media`` bytes: payload, n_frames, spans (seconds), tensors (IPC stream)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "media", "payload", "n_frames", "spans", "tensors"]
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                out: list[list] = [[], [], [], []]
                for media in part.column("media"):
                    _, samples = read_wav(media.as_py())
                    mel, energy = features(samples)
                    spans = active_spans(energy)
                    seconds = [{"start_s": a * HOP / RATE, "end_s": b * HOP / RATE} for a, b in spans.tolist()]
                    for o, v in zip(out, (samples, len(mel), seconds, tensor_stream(mel, spans)), strict=True):
                        o.append(v)
                kinds = (pa.binary(), pa.int64(), pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(n) for n in names[:3]] + [pa.array(o, k) for o, k in zip(out, kinds, strict=True)], names)

    return clips.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, media binary, payload binary, n_frames long, spans array<struct<start_s: double, end_s: double>>, tensors binary")


def audio_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: sizes and digests of payload, stored form and features."""
    f = audio_features(store_audio(docs, id_col, text_col))
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("frames="), F.col("n_frames")),
        F.concat(F.lit("spans="), F.size("spans")),
        F.concat(F.lit("tensors_sha256="), F.sha2("tensors", 256)),
    )
    return f.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )
