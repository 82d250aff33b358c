"""Media columns: 8-bit audio with polyphase resampling, log-mel filterbanks and energy segments, as fixed-shape Arrow tensors."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import pieces, utf8

PAD, UNIT = 255, 576
RATE, UP, DOWN = 8000, 3, 4
TAPS = 16
FRAME, HOP, FFT, MELS = 216, 108, 256, 16
CHUNK = 64
HEADER = 44


def to_wav(payload: bytes) -> bytes:
    """The payload as the samples of an 8-bit mono WAV file."""
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def from_wav(media: bytes) -> memoryview:
    """The samples of a WAV file: its data chunk."""
    view, at = memoryview(media), 12
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    while at < len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"data":
            return view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def _polyphase() -> np.ndarray:
    """One row for each input sample in reach, one column for each of the UP outputs that a step of DOWN inputs gives."""
    n = TAPS * UP
    t = np.arange(n) - (n - 1) / 2
    low_pass = np.sinc(t / DOWN) / DOWN * np.hamming(n) * UP
    out = np.zeros((TAPS + DOWN, UP), np.float32)
    for r in range(UP):
        first, phase = divmod(DOWN * r, UP)
        out[first : first + TAPS, r] = low_pass[phase::UP][::-1]
    return out


def _mel() -> np.ndarray:
    """Triangles, evenly spaced on the mel scale, over the bins of the spectrum."""
    top = 2595 * np.log10(1 + RATE * UP / DOWN / 2 / 700)
    centres = 700 * (10 ** (np.linspace(0, top, MELS + 2) / 2595) - 1)
    bins = np.arange(FFT // 2 + 1) * (RATE * UP / DOWN / FFT)
    up = (bins[:, None] - centres[:-2]) / (centres[1:-1] - centres[:-2])
    down = (centres[2:] - bins[:, None]) / (centres[2:] - centres[1:-1])
    return np.clip(np.minimum(up, down), 0, None).astype(np.float32)


FILTER, MEL, WINDOW = _polyphase(), _mel(), np.hanning(FRAME).astype(np.float32)


def resample(samples: np.ndarray) -> np.ndarray:
    """UP outputs for every DOWN inputs; the filter sees silence beyond the ends."""
    padded = np.zeros(len(samples) + TAPS + DOWN, np.float32)
    padded[TAPS // 2 : TAPS // 2 + len(samples)] = samples
    steps = np.lib.stride_tricks.as_strided(padded, (len(samples) // DOWN, TAPS + DOWN), (DOWN * 4, 4))
    return (steps @ FILTER).ravel()


def log_mel(samples: np.ndarray) -> np.ndarray:
    """Frames of half overlap by mel bands, in steps of 1/64 so that rounding noise does not show."""
    frames = np.lib.stride_tricks.as_strided(samples, ((len(samples) - FRAME) // HOP + 1, FRAME), (HOP * 4, 4))
    out = np.empty((len(frames), MELS), np.float32)
    for at in range(0, len(frames), 4096):
        spectrum = np.fft.rfft(frames[at : at + 4096] * WINDOW, FFT)
        out[at : at + 4096] = np.log((spectrum.real**2 + spectrum.imag**2) @ MEL + 1e-6)
    return np.round(out * 64) / 64


def segments(mel: np.ndarray) -> np.ndarray:
    """Start and end frames of the loud stretches: a frame above the high threshold, and all around it above the low one."""
    energy = mel.mean(1)
    middle, spread = np.median(energy), energy.std()
    low = energy > middle
    edges = np.flatnonzero(np.diff(np.concatenate(([0], low, [0])).astype(np.int8))).reshape(-1, 2)
    if not len(edges):
        return edges
    loud = np.maximum.reduceat(energy, edges[:, 0]) if len(edges) == 1 else np.array([energy[a:b].max() for a, b in edges])
    return edges[loud > middle + spread]


TENSOR = pa.fixed_shape_tensor(pa.float32(), [CHUNK, MELS])
STORED = pa.schema([("log_mel", TENSOR), ("start_ms", pa.float64()), ("end_ms", pa.float64()), ("loud", pa.list_(pa.list_(pa.int32(), 2)))])
#: Milliseconds from one frame to the next.
STEP_MS = 1000 * HOP * DOWN / (RATE * UP)


def to_tensors(mel: np.ndarray, loud: np.ndarray) -> bytes:
    """An Arrow stream with a row for each CHUNK of frames: the tensor, its time span, the loud stretches in it; the last is filled up with silence."""
    n = -(-len(mel) // CHUNK)
    full = np.full((n * CHUNK, MELS), np.log(np.float32(1e-6)), np.float32)
    full[: len(mel)] = mel
    tensors = pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(full.ravel()), CHUNK * MELS))
    at = np.arange(n) * CHUNK
    inside: list[list[list[int]]] = [[] for _ in range(n)]
    for a, b in loud.tolist():
        for c in range(a // CHUNK, (b - 1) // CHUNK + 1):
            inside[c].append([max(a, c * CHUNK), min(b, (c + 1) * CHUNK)])
    ends = np.minimum(at + CHUNK, len(mel)) - 1
    batch = pa.RecordBatch.from_arrays([tensors, pa.array(at * STEP_MS), pa.array(ends * STEP_MS + 1000 * FRAME * DOWN / (RATE * UP)), pa.array(inside, STORED.field("loud").type)], schema=STORED)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, STORED) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_tensors(stored: bytes) -> pa.Table:
    return pa.ipc.open_stream(stored).read_all()


def features(media: bytes) -> bytes:
    """The stored file's features, computed from the samples read back."""
    samples = np.frombuffer(from_wav(media), np.uint8).astype(np.float32)
    mel = log_mel(resample((samples - 128) / 128))
    return to_tensors(mel, segments(mel))


def audio_columns(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes``, ``media`` (a WAV file of the text's bytes) and ``tensors`` (Arrow stream, see to_tensors) for ``text``.

    The text's UTF-8 bytes, null as none, are the samples, with bytes of 255 appended up to a positive multiple of 576; so an
    empty text gives 576 samples; an empty table gives an empty table. Each row depends on its own text alone; equal texts get equal bytes. Memory is bounded by
    4 MB of text, or one text if longer. Columns by the names of the result are replaced.
    """
    docs = docs.drop("n_bytes", "media", "tensors")
    kept = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            n_bytes, media, tensors = [], [], []
            for value in utf8(batch.column(text)):
                n_bytes.append(len(value))
                media.append(to_wav(value + bytes([PAD]) * (max(1, -(-len(value) // UNIT)) * UNIT - len(value))))
                tensors.append(features(media[-1]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(n_bytes, pa.int64()), pa.array(media, pa.binary()), pa.array(tensors, pa.binary())], names=[*kept, "n_bytes", "media", "tensors"])

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in kept)
    return docs.mapInArrow(run, f"{fields}n_bytes long, media binary, tensors binary")


def digest(stored: DataFrame) -> DataFrame:
    """The contract's columns, taken from the stored bytes."""
    payload = F.expr(f"substring(media, {HEADER + 1})")
    return stored.select(
        "doc_id", "n_bytes", F.length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(media, -32)")).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), F.concat(F.lit(f"logmel-{CHUNK}x{MELS}:"), F.sha2("tensors", 256)).alias("feature"),
    )
