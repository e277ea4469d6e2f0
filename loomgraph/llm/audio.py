"""Audio features: resampling, log-mel frames and energy segments as fixed-shape tensors."""

from __future__ import annotations

import hashlib
import io
import wave
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm._shared import same_text, ship

#: Bytes to which a payload is padded with spaces.
UNIT = 192
#: Stored bytes that a task turns into features at once; a longer clip is alone.
BATCH_BYTES = 1 << 20


@dataclass(frozen=True)
class Audio:
    """Rates in Hz, lengths in samples at ``rate``; thresholds in the natural log of a frame's mean energy."""

    stored_rate: int = 16_000
    up: int = 441
    down: int = 640
    taps: int = 16
    frame: int = 200
    hop: int = 80
    fft: int = 256
    mels: int = 24
    block: int = 64
    open_at: float = 0.35
    close_at: float = -0.35

    @property
    def rate(self) -> int:
        return self.stored_rate * self.up // self.down


def polyphase(a: Audio) -> np.ndarray:
    """The branches (up, taps) of a Hann-windowed sinc low-pass; branch p serves outputs at phase p."""
    n = a.taps * a.up
    t = np.arange(n) - (n - 1) / 2
    cut = min(1 / a.up, 1 / a.down)
    h = np.sinc(t * cut) * cut * np.hanning(n + 2)[1:-1]
    h *= a.up / h.sum()
    return h.reshape(a.taps, a.up).T.astype(np.float32)


def mel_bank(a: Audio) -> np.ndarray:
    """Triangular filters (fft / 2 + 1, mels), evenly spaced on the mel scale up to half the rate."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(a.rate / 2), a.mels + 2) / 2595) - 1)
    f = np.linspace(0, a.rate / 2, a.fft // 2 + 1)[:, None]
    rise = (f - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def resample(x: np.ndarray, a: Audio, bank: np.ndarray) -> np.ndarray:
    """x at ``up / down`` of its rate: output m reads the taps of branch (m * down) % up."""
    out = -(-len(x) * a.up // a.down)
    pad = np.zeros(len(x) + 2 * a.taps, np.float32)
    pad[a.taps : a.taps + len(x)] = x
    view = np.lib.stride_tricks.sliding_window_view(pad, a.taps)
    taps = np.ascontiguousarray(bank[:, ::-1])
    y = np.empty(out, np.float32)
    for lo in range(0, out, 1 << 15):  # bounded memory for long clips
        at = np.arange(lo, min(out, lo + (1 << 15))) * a.down
        y[lo : lo + len(at)] = np.einsum("ij,ij->i", view[at // a.up + a.taps // 2 + 1], taps[at % a.up])
    return y


def log_mel(y: np.ndarray, a: Audio, mel: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames, mels) of overlapped frames, and the log of each frame's mean energy; the last frame is padded."""
    n = max(1, -(-(len(y) - a.frame) // a.hop) + 1)
    pad = np.zeros((n - 1) * a.hop + a.frame, np.float32)
    pad[: len(y)] = y[: len(pad)]
    frames = np.lib.stride_tricks.sliding_window_view(pad, a.frame)[:: a.hop]
    window = np.hanning(a.frame).astype(np.float32)
    out, energy = np.empty((n, a.mels), np.float32), np.empty(n, np.float64)
    for lo in range(0, n, 2048):  # bounded memory for long clips
        part = frames[lo : lo + 2048]
        spectrum = np.fft.rfft(part * window, a.fft)
        power = spectrum.real.astype(np.float32) ** 2 + spectrum.imag.astype(np.float32) ** 2
        out[lo : lo + 2048] = np.log(power @ mel + 1e-6)
        energy[lo : lo + 2048] = np.log(np.einsum("ij,ij->i", part, part, dtype=np.float64) / a.frame + 1e-9)
    return out, energy


def segments(energy: np.ndarray, a: Audio) -> list[tuple[int, int]]:
    """Frame ranges that open when the energy is above mean + open_at and close when below mean + close_at."""
    level = energy - energy.mean()
    mark = np.where(level >= a.open_at, 1, np.where(level <= a.close_at, -1, 0))
    at = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.where(at >= 0, mark[np.maximum(at, 0)], -1) > 0
    turn = np.flatnonzero(np.diff(np.r_[False, on, False].astype(np.int8)))
    return [(int(x), int(y)) for x, y in turn.reshape(-1, 2)]


def store(payload: bytes, a: Audio) -> bytes:
    """A mono WAV file of unsigned 8-bit samples: the payload byte for byte."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(a.stored_rate)
        w.writeframes(payload)
    return out.getvalue()


def load(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media)) as w:
        return w.readframes(w.getnframes())


def parts(batch: pa.RecordBatch, column: str):
    """Slices of a batch of about BATCH_BYTES in a binary column."""
    ends = np.cumsum([0, *(len(x.as_buffer()) for x in batch.column(column))])
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + BATCH_BYTES, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def _media(a: Audio):
    def run(batches):
        for batch in batches:
            for part in parts(batch, "text"):
                raw = part.column("text").to_pylist()
                media = [store(x + b" " * (-len(x) % UNIT if x else UNIT), a) for x in raw]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return run


def encode_audio(docs: DataFrame, a: Audio = Audio()) -> DataFrame:
    """(doc_id, n_bytes, media) per row of ``docs`` (doc_id, text): the text's UTF-8 as a WAV file.

    Null and empty texts are one unit of spaces; a null doc_id stays null;
    repeated rows give equal files; a very long text is one file; an empty table
    gives an empty result; other columns are ignored.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(same_text("text"), "UTF-8").alias("text"))
    return rows.mapInArrow(_media(a), "doc_id long, n_bytes long, media binary")


FEATURES = (
    "doc_id long, n_bytes long, media_bytes long, media_sha256 string, payload binary, seconds double, frames long, "
    "tensors binary, spans array<struct<start:double,end:double>>"
)


def _features(a: Audio):
    """Read each stored file; blocks have the fixed shape (block, mels), the last padded with zeros."""

    def run(batches):
        bank, mel = polyphase(a), mel_bank(a)
        span = pa.struct([("start", pa.float64()), ("end", pa.float64())])
        kinds = {"media_bytes": pa.int64(), "media_sha256": pa.string(), "payload": pa.binary(), "seconds": pa.float64(), "frames": pa.int64(), "tensors": pa.binary(), "spans": pa.list_(span)}
        for batch in batches:
            for part in parts(batch, "media"):
                columns: dict[str, list] = {k: [] for k in kinds}
                for m in part.column("media"):
                    for k, x in one(m.as_py(), bank, mel).items():
                        columns[k].append(x)
                arrays = [pa.array(columns[k], t) for k, t in kinds.items()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *arrays], names=["doc_id", "n_bytes", *kinds])

    def one(media: bytes, bank, mel) -> dict:
        payload = load(media)
        x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
        features, energy = log_mel(resample(x, a, bank), a, mel)
        seconds = lambda first, last: (first * a.hop / a.rate, ((last - 1) * a.hop + a.frame) / a.rate)
        return {
            "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "payload": payload, "seconds": len(x) / a.stored_rate, "frames": len(features),
            "tensors": store_tensors(features, a), "spans": [dict(zip(("start", "end"), seconds(s, e), strict=True)) for s, e in segments(energy, a)],
        }

    return run


def store_tensors(features: np.ndarray, a: Audio) -> bytes:
    """An Arrow stream of (start, end, frames, log_mel): log_mel holds fixed-shape tensors (block, mels)."""
    n = len(features)
    full = np.zeros((-(-n // a.block) * a.block, a.mels), np.float32)
    full[:n] = features
    first = np.arange(0, n, a.block)
    last = np.minimum(first + a.block, n)
    table = pa.RecordBatch.from_arrays(
        [pa.array(first * a.hop / a.rate), pa.array(((last - 1) * a.hop + a.frame) / a.rate), pa.array((last - first).astype(np.int32)), tensor_array(full, (a.block, a.mels))],
        names=["start", "end", "frames", "log_mel"],
    )
    out = io.BytesIO()
    with pa.ipc.new_stream(out, table.schema) as w:
        w.write_batch(table)
    return out.getvalue()


def read_tensors(tensors: bytes) -> pa.Table:
    """The table of a ``tensors`` value, with its tensor type."""
    return pa.ipc.open_stream(tensors).read_all()


def tensor_array(values: np.ndarray, shape: tuple[int, ...]) -> pa.FixedShapeTensorArray:
    """Rows of flat float32 values as a column of fixed-shape Arrow tensors."""
    flat = pa.FixedSizeListArray.from_arrays(pa.array(values.reshape(-1), pa.float32()), int(np.prod(shape)))
    return pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), shape), flat)


def audio_features(media: DataFrame, a: Audio = Audio()) -> DataFrame:
    """Features of ``media`` (doc_id, n_bytes, media: 8-bit mono WAV).

    Every file is read back, resampled with a polyphase filter, cut into
    overlapped frames and turned into log-mel energies.  ``tensors`` holds them as
    an Arrow stream of fixed-shape tensors (block, mels) with their time spans in
    seconds (the last block is padded; ``frames`` tells how far it goes), see
    ``read_tensors``; ``spans`` are the segments of a hysteresis on the frames'
    energy.  ``payload`` is the stored samples.  Equal files give equal rows, a
    null doc_id stays null, a very long clip is worked on in pieces, and an empty
    table gives an empty result; other columns are ignored.  Rows are
    independent, so nothing is shuffled and skew has no effect.
    """
    ship(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features(a), FEATURES)


def audio_table(features: DataFrame) -> DataFrame:
    """The row of digests per document that the features imply."""
    payload = F.col("payload")
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("s="), F.round("seconds", 6).cast("string")),
        F.concat(F.lit("f="), F.col("frames").cast("string")),
        F.concat(F.lit("mel="), F.hex(F.xxhash64("tensors"))),
        F.concat(F.lit("seg="), F.size("spans").cast("string")),
        F.concat(F.lit("act="), F.round(F.aggregate("spans", F.lit(0.0), lambda t, s: t + s["end"] - s["start"]), 3).cast("string")),
    )
    return features.select(
        "doc_id",
        "n_bytes",
        F.length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -16, 16)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        feature.alias("feature"),
    )
