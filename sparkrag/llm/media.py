"""Media columns: text bytes stored as 8-bit audio, read back, with fixed-shape log-mel tensors.

`audio_features` keeps the payload as a mono 8-bit PCM WAV column and derives features from the
stored bytes: polyphase resampling from 12 kHz to 8 kHz, overlapped log-mel frames, and energy
segments found with hysteresis. Features of one row are an Arrow IPC stream whose `mel` column has
the fixed-shape tensor type (FRAMES x MELS), beside each tensor's time span. `media_digests` reads
these columns, and nothing else, and tells the payload, the tensors, their spans and the segments from them.

Cases: null or empty text stores one block of 576 bytes of 255. Long texts are worked through in
blocks of bounded size. Repeated rows and ties give repeated equal rows; an empty table gives an
empty result; columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrag.llm.common import slices

BLOCK = 576
RATE_IN, RATE_OUT = 12_000, 8_000
UP, DOWN, TAPS = 2, 3, 12
FRAME, HOP, FFT, MELS = 200, 80, 256, 24
FRAMES = 64
#: Samples resampled at a time; a multiple of DOWN.
SPAN = 3 << 18


def wav_bytes(payload: bytes, rate: int = RATE_IN) -> bytes:
    """A mono 8-bit PCM WAV file; RIFF chunks have an even length."""
    pad = len(payload) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * pad


def wav_payload(media: bytes) -> bytes:
    """The samples of a WAV file, found by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def _filters() -> np.ndarray:
    """UP phases of a windowed-sinc low pass, each of TAPS taps with unit sum."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(UP, DOWN)) * np.hamming(n)
    phases = h.reshape(TAPS, UP).T[:, ::-1]
    return (phases / phases.sum(axis=1, keepdims=True)).astype(np.float32)


def _mel() -> np.ndarray:
    """MELS triangular filters over the FFT bins."""
    top = 2595 * np.log10(1 + RATE_OUT / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, MELS + 2) / 2595) - 1)
    bins = np.arange(FFT // 2 + 1) * RATE_OUT / FFT
    rise = (bins[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[None, 2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


_PHASES, _MEL, _WINDOW = _filters(), _mel(), np.hanning(FRAME).astype(np.float32)


def resampled(samples: np.ndarray) -> Iterator[np.ndarray]:
    """Blocks of the signal at RATE_OUT: output i takes phase i*DOWN % UP at input i*DOWN // UP."""
    total = (len(samples) * UP + DOWN - 1) // DOWN
    for at in range(0, len(samples), SPAN):
        first, last = at * UP // DOWN, min(total, (at + SPAN) * UP // DOWN)
        part = samples[max(0, at - TAPS + 1) : at + SPAN + 1].astype(np.float32)
        part = (part - 128) / 128
        short = max(0, TAPS - 1 - at)
        part = np.concatenate([np.zeros(short, np.float32), part, np.zeros(2, np.float32)])
        views = np.lib.stride_tricks.sliding_window_view(part, TAPS)
        i = np.arange(first, last) * DOWN
        out = np.empty(last - first, np.float32)
        for phase in range(UP):
            mine = i % UP == phase
            out[mine] = views[(i[mine] // UP) - at] @ _PHASES[phase]
        yield out


def log_mel(samples: np.ndarray) -> np.ndarray:
    """Overlapped log-mel frames (frames x MELS) of 8-bit samples; the end is padded with silence."""
    rows, rest = [], np.zeros(0, np.float32)
    for block in resampled(samples):
        rest = np.concatenate([rest, block])
        n = (len(rest) - FRAME) // HOP + 1 if len(rest) >= FRAME else 0
        if n:
            rows.append(_frames(rest, n))
            rest = rest[n * HOP :]
    if len(rest) or not rows:
        n = max(1, -(-(len(rest) - FRAME) // HOP) + 1)
        rows.append(_frames(np.concatenate([rest, np.zeros(FRAME + HOP, np.float32)]), n))
    return np.concatenate(rows)


def _frames(signal: np.ndarray, n: int) -> np.ndarray:
    views = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[: n * HOP : HOP][:n]
    out = np.empty((n, MELS), np.float32)
    for at in range(0, n, 4096):
        spectrum = np.fft.rfft(views[at : at + 4096] * _WINDOW, FFT)
        out[at : at + 4096] = np.log(((spectrum.real**2 + spectrum.imag**2).astype(np.float32)) @ _MEL + 1e-6)
    return out


def energy_segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames that start where the energy passes the upper level and end below the lower one."""
    ordered = np.sort(energy)
    low, high = ordered[int(0.4 * (len(energy) - 1))], ordered[int(0.7 * (len(energy) - 1))]
    out, start = [], None
    above, below = energy >= high, energy < low
    for i in np.flatnonzero(above | below).tolist():
        if start is None and above[i]:
            start = i
        elif start is not None and below[i]:
            out.append((start, i))
            start = None
    if start is not None:
        out.append((start, len(energy)))
    return out


def tensor_ipc(mel: np.ndarray) -> bytes:
    """Arrow IPC stream: mel fixed_shape_tensor(FRAMES, MELS), start_s, end_s; the last tensor is padded."""
    n = -(-len(mel) // FRAMES)
    padded = np.full((n * FRAMES, MELS), np.float32(np.log(1e-6)), np.float32)
    padded[: len(mel)] = mel
    tensors = pa.FixedShapeTensorArray.from_numpy_ndarray(padded.reshape(n, FRAMES, MELS))
    starts = np.arange(n) * (FRAMES * HOP / RATE_OUT)
    ends = (np.minimum((np.arange(n) + 1) * FRAMES, len(mel)) - 1) * HOP / RATE_OUT + FRAME / RATE_OUT
    batch = pa.record_batch([tensors, pa.array(starts), pa.array(ends)], names=["mel", "start_s", "end_s"])
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue()


def stored_media(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8")
    return wav_bytes(raw + b"\xff" * (-len(raw) % BLOCK or (0 if raw else BLOCK)))


SCHEMA = "doc_id long, n_bytes long, media binary, features binary, segments array<struct<start_s: double, end_s: double>>"
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _row(text: str | None) -> tuple[int, bytes, np.ndarray, list[tuple[float, float]]]:
    media = stored_media(text)
    mel = log_mel(np.frombuffer(wav_payload(media), np.uint8))
    spans = [(a * HOP / RATE_OUT, (b - 1) * HOP / RATE_OUT + FRAME / RATE_OUT) for a, b in energy_segments(mel.mean(axis=1))]
    return len((text or "").encode("utf-8")), media, mel, spans


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, size = [], 0
        for doc_id, text in ((i, t) for part in slices(batch, "text") for i, t in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True)):
            n, media, mel, spans = _row(text)
            rows.append((doc_id, n, media, tensor_ipc(mel), [{"start_s": a, "end_s": b} for a, b in spans]))
            size += len(media) + mel.nbytes
            if size > 8 << 20:
                yield _record(rows)
                rows, size = [], 0
        yield _record(rows)


def _record(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    span = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), span), strict=True)], names=["doc_id", "n_bytes", "media", "features", "segments"])


def read_tensors(features: bytes | pa.Buffer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The log-mel frames of a row's tensors (frames x MELS, without the padding of the last), and the start and end of each tensor."""
    table = pa.ipc.open_stream(features).read_all()
    tensors = np.concatenate([c.to_numpy_ndarray() for c in table["mel"].chunks])
    start, end = table["start_s"].to_numpy(), table["end_s"].to_numpy()
    frames = int(round((end[-1] * RATE_OUT - FRAME) / HOP)) + 1
    return tensors.reshape(-1, MELS)[:frames], start, end


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in DIGEST.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            media = batch["media"][i].as_py()
            payload = wav_payload(media)
            mel, start, _ = read_tensors(batch["features"][i].as_buffer())
            spans = batch["segments"][i].as_py()
            feature = f"frames={len(mel)};tensors={len(start)};segments={len(spans)};first={spans[0]['start_s'] if spans else -1:.3f};last={start[-1]:.3f};mean={float(mel.mean(dtype=np.float64)):.2f}"
            rows.append((batch["doc_id"][i].as_py(), batch["n_bytes"][i].as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        cols = list(zip(*rows, strict=True)) or [[]] * len(types)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def audio_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, media (WAV), features (Arrow IPC with fixed-shape tensors), energy segments."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_features, SCHEMA)


def media_digests(rows: DataFrame) -> DataFrame:
    """Digests of what `audio_features` stored, read back from its columns."""
    return rows.mapInArrow(_digests, DIGEST)
