"""Media columns: audio features as fixed-shape tensors with time spans.

Two tables are written, and each step reads what the one before has stored:

* media: each payload losslessly as 8-bit mono PCM in a WAV container;
* features, from the samples of the stored media: polyphase resampling by a rational
  factor, overlapped log-mel filterbanks, and energy segmentation with hysteresis.
  Log-mel frames are quantised to hundredths and cut into patches of ``PATCH`` frames.
  A clip's patches are one Arrow stream in a binary column, where ``logmel`` has the type
  fixed_shape_tensor(int16, [PATCH, MELS]) beside each patch's time span (Parquet has no
  such type, and Spark's writer none for the stream: a lost executor leaves no half file).

``digests`` describes both from the second table alone.

Defined cases: a null or empty text becomes one block of 64 zero bytes; ids may be null
or repeat; an empty table gives no rows; other columns are ignored. Frames are computed in
blocks of ``BLOCK``, so a very long payload does not need memory in proportion beyond its
samples. Each document is computed alone, hence equal texts get equal values.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import materialize, slices

RATE, UP, DOWN = 12_000, 2, 3
OUT_RATE = RATE * UP // DOWN
FRAME, HOP, MELS, PATCH, BLOCK = 256, 128, 20, 32, 4096
HIGH_DB, LOW_DB = 3.0, -1.0  # against the clip's mean level: a span opens above HIGH and closes below LOW
ALIGN = 64


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % ALIGN or (0 if raw else ALIGN))


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """RIFF/WAVE with unsigned 8-bit mono samples."""
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def from_wav(media: bytes) -> tuple[int, bytes]:
    """(sample rate, samples) of an 8-bit mono WAV; chunks other than fmt and data are skipped."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is read")
        elif name == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@lru_cache(None)
def _phases(up: int, down: int) -> tuple[np.ndarray, int]:
    """Rows: the taps of each phase of a windowed-sinc low-pass, reversed for a sliding dot product."""
    half = 8 * max(up, down)
    n = np.arange(-half, half + 1)
    taps = np.sinc(n / max(up, down)) * np.hanning(2 * half + 3)[1:-1]
    taps *= up / taps.sum()
    per = -(-len(taps) // up)
    bank = np.zeros((up, per))
    for p in range(up):
        own = taps[p::up]
        bank[p, : len(own)] = own
    return bank[:, ::-1].astype(np.float32).copy(), half


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Polyphase: output n uses phase (n * down + half) % up only; no sample is computed and thrown away."""
    bank, half = _phases(up, down)
    per, n_out = bank.shape[1], -(-len(x) * up // down)
    out = np.empty(n_out, np.float32)
    ahead = half // up + 1
    padded = np.concatenate([np.zeros(per - 1, np.float32), x, np.zeros(ahead, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, per)
    for first in range(min(up, n_out)):
        at = np.arange(first, n_out, up) * down + half
        out[first::up] = windows[at[0] // up :: down][: len(at)] @ bank[at[0] % up]
    return out


@lru_cache(None)
def _mel_bank() -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(40), mel(OUT_RATE / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, 1 / OUT_RATE)[:, None]
    lo, mid, hi = edges[:-2], edges[1:-1], edges[2:]
    return np.clip(np.minimum((f - lo) / (mid - lo), (hi - f) / (hi - mid)), 0, None).astype(np.float32)


_WINDOW = np.hanning(FRAME + 1)[:-1].astype(np.float32)


def log_mel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames, MELS) in hundredths as int16, and each frame's level in dB."""
    n = max(1, -(-max(len(x) - FRAME, 0) // HOP) + 1)
    x = np.concatenate([x, np.zeros((n - 1) * HOP + FRAME - len(x), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    mels, level = np.empty((n, MELS), np.int16), np.empty(n, np.float32)
    for at in range(0, n, BLOCK):
        part = frames[at : at + BLOCK]
        power = np.abs(np.fft.rfft(part * _WINDOW)) ** 2
        mels[at : at + BLOCK] = np.rint(100 * np.log10(power @ _mel_bank() + 1e-6))
        level[at : at + BLOCK] = 10 * np.log10((part**2).mean(1) + 1e-8)
    return mels, level


def segments(level: np.ndarray, high: float = HIGH_DB, low: float = LOW_DB) -> np.ndarray:
    """(k, 2) frame spans: on from the first frame at or over ``high``, until one under ``low``; between, the state holds."""
    mark = np.where(level >= high, 1, np.where(level < low, -1, 0))
    at = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.concatenate([[False], (at >= 0) & (mark[at] > 0), [False]])
    return np.flatnonzero(on[1:] != on[:-1]).reshape(-1, 2)


def patches(mels: np.ndarray) -> np.ndarray:
    """(k, PATCH, MELS); the last patch is filled up with the smallest value."""
    n = -(-len(mels) // PATCH)
    out = np.full((n * PATCH, MELS), -600, np.int16)
    out[: len(mels)] = mels
    return out.reshape(n, PATCH, MELS)


def _ms(frame):
    return frame * HOP * 1000 // OUT_RATE


TENSOR = pa.fixed_shape_tensor(pa.int16(), (PATCH, MELS))
STREAM = pa.schema([("patch", pa.int32()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("frames", pa.int32()), ("voiced_frames", pa.int32()), ("logmel", TENSOR)])


def analyse(data: bytes) -> tuple[pa.RecordBatch, np.ndarray]:
    """A clip's patches, as ``STREAM`` has them, and its energetic segments (frames, ends exclusive)."""
    x = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
    mels, level = log_mel(resample(x))
    spans = segments(level - np.float32(level.mean(dtype=np.float64)))
    cut = patches(mels)
    voiced = np.zeros(len(cut) * PATCH, np.int32)
    for s, e in spans:
        voiced[s:e] = 1
    k = np.arange(len(cut))
    own = np.minimum(len(mels) - k * PATCH, PATCH)
    tensors = pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(cut.reshape(-1)), PATCH * MELS))
    columns = [pa.array(k, pa.int32()), pa.array(_ms(k * PATCH), pa.int64()), pa.array(_ms((k + 1) * PATCH), pa.int64()), pa.array(own, pa.int32()), pa.array(voiced.reshape(-1, PATCH).sum(1), pa.int32()), tensors]
    return pa.RecordBatch.from_arrays(columns, schema=STREAM), spans


def to_stream(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_stream(raw: bytes) -> pa.Table:
    """The patches of a stored cell."""
    return pa.ipc.open_stream(raw).read_all()


def describe(clip: pa.Table, n_spans: int) -> str:
    """The feature string, from stored tensors."""
    frames = int(sum(clip.column("frames").to_pylist()))
    cut = np.concatenate([c.to_numpy_ndarray() for c in clip.column("logmel").chunks])
    means = ",".join(str(int(v)) for v in np.rint(cut.reshape(-1, MELS)[:frames].mean(0, dtype=np.float64)))
    digest = hashlib.sha256(cut.astype("<i2").tobytes()).hexdigest()[:16]
    return f"frames={frames};mean={means};voiced={sum(clip.column('voiced_frames').to_pylist())};spans={n_spans};tensor={digest}"


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def store_media(docs: DataFrame) -> DataFrame:
    """The written table of media: doc_id, n_bytes (of the text, before padding), media."""

    def work(batches):
        for b in slices(batches, 256):
            texts = b.column("text").to_pylist()
            media = [to_wav(payload_of(t)) for t in texts]
            sizes = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return materialize(docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_bytes long, media binary"), "media", "zstd")


_ABOUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
_ABOUT_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]


def store_features(media: DataFrame) -> DataFrame:
    """The written table of features of a table of media: what was read (sizes and digests), spans (start_ms, end_ms of the energetic segments), patches (an Arrow stream, see ``from_stream``)."""
    names = [f.split()[0] for f in _ABOUT.split(", ")] + ["spans", "patches"]
    types = [*_ABOUT_TYPES, pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())])), pa.binary()]

    def work(batches):
        for b in slices(batches, 64):
            rows = []
            for i, n, raw in zip(b.column("doc_id").to_pylist(), b.column("n_bytes").to_pylist(), b.column("media").to_pylist(), strict=True):
                _, data = from_wav(raw)
                clip, spans = analyse(data)
                rows.append((i, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), [{"start_ms": int(_ms(s)), "end_ms": int(_ms(e))} for s, e in spans], to_stream(clip)))
            yield _batch(rows, names, types)

    schema = f"{_ABOUT}, spans array<struct<start_ms: long, end_ms: long>>, patches binary"
    return materialize(media.select("doc_id", "n_bytes", "media").mapInArrow(work, schema), "features", "zstd")


def digests(features: DataFrame) -> DataFrame:
    """One row per clip of a table of features: its sizes and digests, and its feature string, worked out from the stored tensors."""
    about = [f.split()[0] for f in _ABOUT.split(", ")]

    def work(batches):
        for b in slices(batches, 256):
            own = [describe(from_stream(raw), len(spans)) for raw, spans in zip(b.column("patches").to_pylist(), b.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in about], pa.array(own, pa.string())], names=[*about, "feature"])

    return features.select(*about, "spans", "patches").mapInArrow(work, f"{_ABOUT}, feature string")


def audio_digests(docs: DataFrame) -> DataFrame:
    """Media and features of a table of documents, stored and read back: ``digests`` of them."""
    return digests(store_features(store_media(docs)))


def audio_patches(features: DataFrame) -> DataFrame:
    """One row per patch of a table of features: doc_id, patch, start_ms, end_ms, frames, voiced_frames, logmel (PATCH x MELS numbers, row by row)."""

    def work(batches):
        for b in slices(batches, 16):
            for i, raw in zip(b.column("doc_id").to_pylist(), b.column("patches").to_pylist(), strict=True):
                for clip in from_stream(raw).to_batches(max_chunksize=1024):
                    cut = clip.column("logmel").to_numpy_ndarray().reshape(-1)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(clip.num_rows + 1) * PATCH * MELS, pa.int32()), pa.array(cut))
                    yield pa.RecordBatch.from_arrays([pa.array([i] * clip.num_rows, pa.int64()), *[clip.column(c) for c in STREAM.names[:-1]], lists], names=["doc_id", *STREAM.names])

    return features.select("doc_id", "patches").mapInArrow(work, "doc_id long, patch int, start_ms long, end_ms long, frames int, voiced_frames int, logmel array<short>")
