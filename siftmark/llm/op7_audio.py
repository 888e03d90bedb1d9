"""Media columns, audio: polyphase resampling, log-mel filterbanks and hysteresis segments as fixed-shape tensors with time spans."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import gcd

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, documents, frugal, materialise

#: Samples a second as stored, and as analysed.
RATE_IN, RATE_OUT = 16_000, 10_000
#: Taps on each side of a phase's filter, in samples of the slower rate.
HALF = 8
FRAME, HOP, FFT, MELS = 250, 100, 256, 32
#: Frames in a tensor of fixed shape (PATCH, MELS).
PATCH = 64
#: A segment opens HIGH dB above the median frame energy and closes below LOW dB above it.
HIGH, LOW = 1.0, 0.25
#: Frames analysed at once: memory for a text doesn't grow beyond its samples.
BLOCK = 8192


@lru_cache
def _phases(up: int, down: int) -> np.ndarray:
    """The windowed-sinc low-pass for up/down, a row of taps for each of `up` phases."""
    width = HALF * max(up, down)
    t = np.arange(-width, width + 1)
    cut = 1.0 / max(up, down)
    h = cut * np.sinc(t * cut) * np.hanning(2 * width + 3)[1:-1] * up
    taps = -(-len(h) // up)
    return np.pad(h, (0, taps * up - len(h))).reshape(taps, up).T.astype(np.float32)


def resample(x: np.ndarray, rate_in: int = RATE_IN, rate_out: int = RATE_OUT) -> np.ndarray:
    """Polyphase resampling: only the outputs kept are computed, each by the one phase of the filter that it needs."""
    g = gcd(rate_in, rate_out)
    up, down = rate_out // g, rate_in // g
    filters = _phases(up, down)
    taps, centre = filters.shape[1], (HALF * max(up, down))
    n = -(-len(x) * up // down)
    out = np.zeros(n, np.float32)
    padded = np.pad(x.astype(np.float32), (taps, taps + down))
    for first in range(min(up, n)):  # outputs first, first + up, ... share a phase and step `down` inputs
        at = first * down + centre
        base, phase, count = at // up, at % up, -(-(n - first) // up)
        acc = np.zeros(count, np.float32)
        for k in range(taps):
            start = base - k + taps
            piece = padded[start : start + (count - 1) * down + 1 : down]
            acc[: len(piece)] += filters[phase, k] * piece
        out[first::up] = acc
    return out


@lru_cache
def _mel() -> np.ndarray:
    """Triangular filters, even on the mel scale, from 50 Hz to half the rate."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(50), mel(RATE_OUT / 2), MELS + 2) / 2595) - 1)
    f = np.arange(FFT // 2 + 1) * RATE_OUT / FFT
    up, down = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames x MELS log energies, frame energies in dB) of overlapped Hann frames; a short signal is padded to one frame."""
    n = max(1, 1 + -(-max(0, len(x) - FRAME) // HOP))
    x = np.pad(x, (0, max(0, (n - 1) * HOP + FRAME - len(x))))
    window = np.hanning(FRAME).astype(np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP][:n]
    mels, energy = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    for i in range(0, n, BLOCK):
        power = np.abs(np.fft.rfft(frames[i : i + BLOCK] * window, FFT).astype(np.complex64)) ** 2
        mels[i : i + BLOCK] = np.log(power @ _mel() + 1e-6)
        energy[i : i + BLOCK] = 10 * np.log10(power.mean(1) + 1e-6)
    return mels, energy


def segments(energy: np.ndarray, high: float = HIGH, low: float = LOW) -> list[tuple[int, int]]:
    """Frame spans [start, end) that open at `high` and last while the energy is at least `low`, over the median."""
    rel = energy - np.median(energy)
    mark = np.where(rel >= high, 1, np.where(rel < low, 0, -1))
    last = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    on = np.where(last >= 0, mark[np.maximum(last, 0)], 0)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], on, [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def encode_wav(payload: bytes) -> bytes:
    """Payload as 8-bit mono samples in a RIFF WAVE container, without loss."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE_IN)
        w.writeframes(payload)
    return out.getvalue()


def decode_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media)) as w:
        return w.readframes(w.getnframes())


MEDIA = "doc_id long, n_bytes long, media binary"
FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "n_frames long, tensors binary, segments array<struct<start_ms:long,end_ms:long>>, mean_mel array<float>"
)
DIGESTED = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")
READ_BACK = ", ".join(c for c in FEATURES.split(", ")[: len(DIGESTED)]) + ", feature string, mel_crc32 long, end_ms long"
#: The cell of the column `tensors`: an Arrow IPC stream with one row for each patch.
TENSORS = pa.schema([("start_ms", pa.int64()), ("end_ms", pa.int64()), ("tensor", pa.fixed_shape_tensor(pa.float32(), [PATCH, MELS], dim_names=["frame", "mel"]))])
#: Texts that a task takes at a time, and bytes of results that it holds.
TEXTS, HELD = 256, 8_000_000


def pack_tensors(mels: np.ndarray, samples: int) -> bytes:
    """Frames x MELS as fixed-shape tensors (PATCH, MELS), the last one padded with silence, and the span of the sound that
    each covers; the last span ends with the sound, of `samples` samples as stored."""
    fixed = np.pad(mels, ((0, -len(mels) % PATCH), (0, 0)), constant_values=np.log(np.float32(1e-6))).astype(np.float32)
    n, span, end = len(fixed) // PATCH, PATCH * HOP * 1000 // RATE_OUT, -(-samples * 1000 // RATE_IN)
    start = np.arange(n, dtype=np.int64) * span
    flat = pa.FixedSizeListArray.from_arrays(pa.array(fixed.ravel(), pa.float32()), PATCH * MELS)
    batch = pa.record_batch([pa.array(start), pa.array(np.minimum(start + span, max(end, 1))), pa.ExtensionArray.from_storage(TENSORS.field("tensor").type, flat)], schema=TENSORS)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, TENSORS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return out.getvalue().to_pybytes()


def unpack_tensors(cell: bytes) -> pa.Table:
    """start_ms, end_ms and tensor, a fixed-shape tensor column, of one cell."""
    with pa.ipc.open_stream(cell) as r:
        return r.read_all()


def mel_of(cell: bytes) -> np.ndarray:
    """The patches of a cell as one array (n, PATCH, MELS)."""
    tensor = unpack_tensors(cell)["tensor"].combine_chunks()
    return tensor.to_numpy_ndarray() if len(tensor) else np.empty((0, PATCH, MELS), np.float32)


def _encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), TEXTS):
            part = pdf.iloc[at : at + TEXTS]
            raw = [t.encode() for t in part["t"]]
            media = [encode_wav(b.ljust(max(64, -(-len(b) // 64) * 64), b"\0")) for b in raw]
            yield pd.DataFrame({"doc_id": part["doc_id"], "n_bytes": [len(b) for b in raw], "media": media})


def _analyse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in FEATURES.split(", ")]
    for pdf in batches:
        rows, held = [], 0
        for doc_id, n_bytes, media in zip(pdf["doc_id"], pdf["n_bytes"], pdf["media"], strict=True):
            payload = decode_wav(media)
            mels, energy = log_mel(resample((np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128))
            spans = [{"start_ms": s * HOP * 1000 // RATE_OUT, "end_ms": e * HOP * 1000 // RATE_OUT} for s, e in segments(energy)]
            tensors = pack_tensors(mels, len(payload))
            rows.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), len(mels), tensors, spans, mels.mean(0)))
            held += len(tensors)
            if len(rows) == TEXTS or held > HELD:
                yield pd.DataFrame(rows, columns=names)
                rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and the WAV file of each text.  A null text is empty: one block of 64 zero bytes.  Repeated rows give
    repeated results; an empty table gives no rows; other columns take no part, whatever their names."""
    return docs.select(column(id_col).alias("doc_id"), F.coalesce(column(text_col), F.lit("")).alias("t")).mapInPandas(frugal(_encode), MEDIA)


def audio_features(media: DataFrame) -> DataFrame:
    """Features of stored files: tensors is a cell that unpack_tensors reads (fixed-shape tensors of log-mel patches with their
    time spans); segments are time spans.  One pass, no exchange; equal bytes give equal values."""
    return media.mapInPandas(frugal(_analyse), FEATURES)


def tensor_table(pdf: pd.DataFrame) -> pa.Table:
    """Rows of audio_features as one Arrow table: doc_id, start_ms, end_ms, tensor, a row for each patch."""
    tables = [unpack_tensors(c) for c in pdf["tensors"]]
    ids = np.repeat(pdf["doc_id"].to_numpy(), [t.num_rows for t in tables])
    whole = pa.concat_tables([TENSORS.empty_table(), *tables])
    return whole.add_column(0, "doc_id", pa.array(ids, pa.int64(), from_pandas=True))


def _read_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        crc = [zlib.crc32(mel_of(c).astype("<f4").tobytes()) for c in pdf["tensors"]]
        end = [int(unpack_tensors(c)["end_ms"][-1].as_py()) for c in pdf["tensors"]]
        yield pdf.drop(columns="tensors").assign(mel_crc32=crc, end_ms=end)


def op7_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the media column of every document: tensors are written with their spans, and read again for it.  A null text
    is empty; equal texts have equal values."""
    stored = materialise(audio_features(encode_media(documents(spark, sf_dir))))
    feature = F.to_json(F.struct(
        F.lit(RATE_OUT).alias("rate"), "n_frames", F.lit([PATCH, MELS]).alias("shape"), F.transform("mean_mel", lambda x: F.round(x, 2)).alias("mean_mel"), "segments",
    ))
    rows = stored.select(*DIGESTED, "tensors", feature.alias("feature")).mapInPandas(frugal(_read_back), READ_BACK)
    whole = F.concat(F.lit('{"mel_crc32":'), F.col("mel_crc32").cast("string"), F.lit(',"end_ms":'), F.col("end_ms").cast("string"), F.lit(","), F.substring("feature", F.lit(2), F.length("feature")))
    return rows.select(*DIGESTED, whole.alias("feature"))


QUERIES = {"op7_audio": op7_audio}
#: Signal processing isn't SQL: tests hold round trips, a direct resampler and spectra of pure tones against it.
ORACLES: dict[str, str] = {}
