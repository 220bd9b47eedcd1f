"""Audio columns: lossless 8-bit storage, resampling, log-mel tensors, and energy segments."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.wordcodec import text_groups as bounded

RATE, TARGET = 16_000, 8_000
FRAME, HOP, BANDS = 256, 128, 24
#: Frames in one tensor; the last tensor of a recording is filled with zeros.
BLOCK = 16
UNIT = 192


def wav_bytes(samples: bytes, rate: int = RATE) -> bytes:
    """A RIFF/WAVE file of 8-bit unsigned mono samples."""
    odd = len(samples) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + odd, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * odd


def wav_samples(media: bytes) -> tuple[bytes, int]:
    """The samples and rate of such a file, found by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is read")
        elif name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


@lru_cache(maxsize=256)
def _phase_filter(cutoff: float, taps: int, part: float) -> np.ndarray:
    t = np.arange(2 * taps) - (taps - 1) - part
    h = cutoff * np.sinc(cutoff * t) * (0.5 + 0.5 * np.cos(np.pi * np.clip(t / taps, -1, 1)))
    return (h / h.sum()).astype(np.float32)


def resample(x: np.ndarray, up: int, down: int, half: int = 8) -> np.ndarray:
    """Polyphase resampling by up / down with a Hann-windowed sinc of ``half`` zero crossings to a side.

    Output m lies at input time m * down / up; each of the ``up`` phases is one short filter, applied to the
    windows of the input that its outputs need.
    """
    cutoff = min(1.0, up / down)
    taps = int(np.ceil(half / cutoff))
    n = -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(taps, x.dtype), x, np.zeros(taps + down + 1, x.dtype)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * taps)
    out = np.empty(n, np.float32)
    for phase in range(min(up, n)):
        at = np.arange(phase, n, up)
        first, part = divmod(int(at[0]) * down, up)
        out[at] = windows[first + 1 : first + 1 + down * len(at) : down][: len(at)] @ _phase_filter(cutoff, taps, part / up)
    return out


def _mel_bank() -> np.ndarray:
    """Triangles even on the mel scale, FRAME // 2 + 1 by BANDS."""
    top = 2595 * np.log10(1 + TARGET / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, BANDS + 2) / 2595) - 1)
    hertz = np.linspace(0, TARGET / 2, FRAME // 2 + 1)[:, None]
    rise, fall = (hertz - edges[:-2]) / np.diff(edges)[:-1], (edges[2:] - hertz) / np.diff(edges)[1:]
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


MEL, HANN = _mel_bank(), np.hanning(FRAME + 1)[:-1].astype(np.float32)


def _power(frames: np.ndarray) -> np.ndarray:
    spectrum = np.fft.rfft(frames * HANN, axis=1)
    return spectrum.real**2 + spectrum.imag**2


def log_mel(x: np.ndarray) -> np.ndarray:
    """Frames by bands; frames of FRAME samples start HOP apart, the last filled with zeros."""
    frames = 1 + max(0, -(-(len(x) - FRAME) // HOP))
    padded = np.zeros((frames - 1) * HOP + FRAME, np.float32)
    padded[: len(x)] = x
    cut = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    out = np.empty((frames, BANDS), np.float32)
    for k in range(0, frames, 4096):
        power = _power(cut[k : k + 4096])
        out[k : k + 4096] = np.log(power @ MEL + np.float32(1e-6))
    return out


def segments(mel: np.ndarray) -> list[tuple[float, float]]:
    """Time spans of raised energy: one opens at half a deviation over the mean and closes at half below it."""
    energy = np.log(np.exp(mel.astype(np.float64)).sum(axis=1))
    mean, spread = energy.mean(), energy.std()
    mark = np.where(energy >= mean + spread / 2, 1, np.where(energy < mean - spread / 2, 0, -1))
    last = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    on = np.where(last >= 0, mark[last], 0)
    if spread < 1e-9:
        on[:] = 0
    edge = np.diff(np.concatenate([[0], on, [0]]))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return [(round(a * HOP / TARGET, 3), round(((b - 1) * HOP + FRAME) / TARGET, 3)) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]


TENSOR = pa.fixed_shape_tensor(pa.float16(), (BLOCK, BANDS))


def tensor_file(mel: np.ndarray) -> bytes:
    """An Arrow stream of fixed-shape half-precision tensors with the start and end second and the frames of each."""
    blocks = -(-len(mel) // BLOCK)
    filled = np.zeros((blocks * BLOCK, BANDS), np.float16)
    filled[: len(mel)] = mel
    first = np.arange(blocks) * BLOCK
    tensors = pa.FixedShapeTensorArray.from_numpy_ndarray(filled.reshape(blocks, BLOCK, BANDS))
    frames = np.minimum(BLOCK, len(mel) - first)
    ends = (first + frames - 1) * HOP + FRAME
    batch = pa.RecordBatch.from_arrays([pa.array(first * HOP / TARGET), pa.array(ends / TARGET), pa.array(frames, pa.int32()), tensors], ["start", "end", "frames", "log_mel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def tensor_frames(stream: bytes) -> np.ndarray:
    """The frames by bands that tensor_file() stored, without what fills the last tensor."""
    held = pa.ipc.open_stream(stream).read_all().combine_chunks()
    frames = np.asarray(held.column("frames")).sum(dtype=np.int64)
    return np.concatenate([c.to_numpy_ndarray().reshape(-1, BANDS) for c in held.column("log_mel").chunks])[:frames]


def store_audio(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """{doc}, n_bytes and media: each whole text's UTF-8, filled with spaces to a positive multiple of 192, as a file.

    A null text is stored as an empty one. Rows are stored one by one, so nothing is shuffled; repeated rows are
    stored each, an empty table gives no rows, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            sizes, media = [], []
            for t in batch.column(1):
                raw = (t.as_py() or "").encode()
                sizes.append(len(raw))
                media.append(wav_bytes(raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], [doc, "n_bytes", "media"])

    return docs.select(F.col(doc).cast("long").alias(doc), F.col(text).alias("text")).mapInArrow(run, f"`{doc}` long, n_bytes long, media binary")


def audio_tensors(stored: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Reads media: {doc}, n_bytes, media_bytes, media_sha256, payload_bytes, payload_sha256, tail_crc32 (last 16
    bytes), tensors and spans.

    tensors: an Arrow stream of fixed-shape log-mel tensors with time spans (see tensor_file). spans: the energy
    segments in seconds. A null media gives nulls; a damaged one is an error. Repeated rows come back each; an empty
    table gives no rows; other columns are not read.
    """
    kept = [doc, "n_bytes", "media"]
    names = [doc, "n_bytes", "media_bytes", "media_sha256", "payload_bytes", "payload_sha256", "tail_crc32", "tensors", "spans"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 2):
            rows = []
            for m in batch.column(2):
                if not m.is_valid:
                    rows.append((None,) * 7)
                    continue
                media = m.as_py()
                payload, rate = wav_samples(media)
                x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
                step = int(np.gcd(rate, TARGET))
                mel = log_mel(resample(x, TARGET // step, rate // step))
                spans = [{"start": a, "end": b} for a, b in segments(mel)]
                rows.append((len(media), hashlib.sha256(media).hexdigest(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), tensor_file(mel), spans))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names)

    return stored.select(*kept).mapInArrow(run, f"`{doc}` long, n_bytes long, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, tensors binary, spans array<struct<start:double,end:double>>")


def audio_features(read: DataFrame) -> DataFrame:
    """Adds feature to a table of audio_tensors(): its frames, band means and spans as text.

    The values come from the tensors and spans as stored; equal samples give equal values, null tensors a null.
    Repeated rows come back each; an empty table gives no rows; other columns stay.
    """

    def feature(tensors: pd.Series) -> pd.Series:
        def of(stream: bytes | None) -> str | None:
            if stream is None:
                return None
            mel = tensor_frames(stream)
            return f"{len(mel)};" + ",".join(f"{v + 0.0:.2f}" for v in np.round(mel.mean(axis=0, dtype=np.float64), 2))

        return tensors.map(of)

    second = lambda c: F.format_string("%.3f", c)
    spans = F.array_join(F.transform("spans", lambda x: F.concat(second(x["start"]), F.lit("-"), second(x["end"]))), ",")
    return read.withColumn("feature", F.concat(F.pandas_udf(feature, "string")("tensors"), F.lit(";"), spans))
