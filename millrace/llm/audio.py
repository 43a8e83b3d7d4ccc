"""Media columns: texts stored as 8-bit mono PCM in WAV form, and audio features of what was stored.

The samples are resampled by a polyphase filter, cut into overlapped frames, and turned into log-mel energies; a
hysteresis over the frames' energy gives the active time spans. Null text counts as empty: 64 zero bytes. Equal texts
have equal media and features. A very long text is one clip, analysed in rounds. Repeated rows stay repeated; extra columns are ignored, whatever their names;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import struct
import wave
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import ship, stored

UNIT, RATE = 64, 8_000
#: Resampling by UP / DOWN with TAPS coefficients for each phase; frames of FRAME samples, HOP apart; MELS bands.
UP, DOWN, TAPS = 3, 4, 16
FRAME, HOP, MELS = 256, 128, 24
#: Seconds between the starts of two frames.
STEP = HOP * DOWN / UP / RATE
#: Frames become active at ON dB above a clip's mean energy and inactive below OFF dB above it.
ON, OFF = 1.0, -0.5
#: A tensor of the stored features has the log-mel energies of this many frames; the last one is padded with FLOOR.
BLOCK, FLOOR = 32, -6.0
#: Log-mel energies are kept to one part in LEVELS, of which a stored tensor has few different values.
LEVELS = 64
#: Samples that one round of array arithmetic takes, so that a long text needs little more than its samples and tensors.
ROUND = 1 << 20


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))


def to_wav(samples: bytes) -> bytes:
    """PCM, one channel of unsigned 8-bit samples."""
    return b"".join((b"RIFF", struct.pack("<I", 36 + len(samples)), b"WAVEfmt ", struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8), b"data", struct.pack("<I", len(samples)), samples))


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media)) as w:
        return w.readframes(w.getnframes())


def _phases() -> np.ndarray:
    """A windowed-sinc low-pass filter, dealt out to its UP phases."""
    n = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    h = np.sinc(n / DOWN) / DOWN * np.hamming(UP * TAPS) * UP
    return np.ascontiguousarray(h.reshape(TAPS, UP).T[:, ::-1]).astype(np.float32)


def _mel_bank() -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale up to the new Nyquist frequency."""
    top = RATE * UP / DOWN / 2
    mel = 2595 * np.log10(1 + np.array([0.0, top]) / 700)
    edges = 700 * (10 ** (np.linspace(*mel, MELS + 2) / 2595) - 1) / top * (FRAME // 2)
    bins = np.arange(FRAME // 2 + 1)[:, None]
    rise, fall = (bins - edges[:-2]) / np.diff(edges)[:-1], (edges[2:] - bins) / np.diff(edges)[1:]
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


PHASES, MEL_BANK, WINDOW = _phases(), _mel_bank(), np.hanning(FRAME).astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """Sample n of the result is phase n * DOWN % UP of the filter over the samples that end at n * DOWN // UP."""
    views = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(TAPS - 1, np.float32), x]), TAPS)
    out = np.empty(-(-len(x) * UP // DOWN), np.float32)
    for n in range(min(UP, len(out))):
        own, rows = out[n::UP], views[n * DOWN // UP :: DOWN]
        for at in range(0, len(own), ROUND):
            own[at : at + ROUND] = rows[at : at + ROUND][: len(own) - at] @ PHASES[n * DOWN % UP]
    return out


class Features(NamedTuple):
    #: (blocks, BLOCK, MELS) log-mel energies; seconds at which each block begins and ends; active spans in seconds.
    tensors: np.ndarray
    blocks: np.ndarray
    spans: np.ndarray
    frames: int
    active: int


def active_frames(energy: np.ndarray) -> np.ndarray:
    """Hysteresis: each frame has the state of the last frame that was above ON or below OFF."""
    relative = energy - energy.mean()
    state = np.where(relative >= ON, 1, np.where(relative < OFF, 0, -1))
    last = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    return np.where(last >= 0, state[last], 0).astype(bool)


def analyse(samples: bytes) -> Features:
    x = resample((np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128)
    frames = 1 + max(0, -(-(len(x) - FRAME) // HOP))
    x = np.concatenate([x, np.zeros((frames - 1) * HOP + FRAME - len(x), np.float32)])
    each = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    blocks = -(-frames // BLOCK)
    tensors, energy = np.full((blocks * BLOCK, MELS), FLOOR, np.float32), np.empty(frames)
    for at in range(0, frames, ROUND // FRAME):
        now = slice(at, min(frames, at + ROUND // FRAME))
        power = np.abs(np.fft.rfft(each[now] * WINDOW)).astype(np.float32) ** 2
        tensors[now] = np.rint(np.log10(power @ MEL_BANK + 10**FLOOR) * LEVELS) / LEVELS
        energy[now] = power.sum(1, dtype=np.float64)
    on = active_frames(10 * np.log10(energy + 1e-9))
    turns = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]]))).reshape(-1, 2)
    first = np.arange(blocks) * BLOCK
    return Features(tensors.reshape(blocks, BLOCK, MELS), np.stack([first, np.minimum(first + BLOCK, frames)], 1) * STEP, turns * STEP, frames, int(on.sum()))


def describe(f: Features) -> str:
    """One line: frames, active frames, spans and a checksum of their seconds, mean of each band in hundredths."""
    bands = np.rint(f.tensors.reshape(-1, MELS)[: f.frames].mean(0, dtype=np.float64) * 100).astype(int)
    spans = zlib.crc32(np.rint(f.spans * 1000).astype("<i8").tobytes())
    return f"frames={f.frames} active={f.active} spans={len(f.spans)}:{spans:08x} logmel={','.join(map(str, bands))}"


def store(docs: DataFrame, name: str = "media") -> DataFrame:
    """doc_id, n_bytes and media of each text, written as a table and read back."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for at in range(0, len(ids), 1000):
                own = texts.slice(at, 1000).to_pylist()
                media = pa.array([to_wav(payload(t)) for t in own], pa.binary())
                sizes = pa.array([len((t or "").encode()) for t in own], pa.int64())
                yield pa.RecordBatch.from_arrays([ids.slice(at, 1000), sizes, media], names=["doc_id", "n_bytes", "media"])

    media = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")
    return stored(docs.sparkSession, media, name, compression="zstd")


#: The stored form of a tensor is a flat list; its shape stands in the metadata of the column log_mel.
TENSOR = {"tensor": "fixed_shape", "shape": [BLOCK, MELS], "value_type": "float32"}
_CHECKS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
_BLOCKS = T.StructType([T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType()), T.StructField("log_mel", T.ArrayType(T.FloatType()), metadata=TENSOR)])
CLIPS = T.StructType([*(T.StructField(c, T.LongType() if kind == "long" else T.StringType()) for c, kind in map(str.split, _CHECKS.split(", "))), T.StructField("spans", T.ArrayType(T.DoubleType())), T.StructField("blocks", T.ArrayType(_BLOCKS))])
#: Clips of so many bytes of media are analysed, and so many bytes of tensors read, at a time.
SLICE_BYTES = 4_000_000


def _runs(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of rows that have SLICE_BYTES, and one row more, at most."""
    edges = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE_BYTES, prepend=0))
    return [(int(a), int(b)) for a, b in zip([0, *edges], [*edges, len(sizes)], strict=True) if a < b]


def _block_array(features: list[Features]) -> pa.Array:
    """Each clip's blocks: times, and the tensors of the fixed shape in their stored form."""
    fixed = pa.FixedShapeTensorArray.from_numpy_ndarray(np.concatenate([f.tensors for f in features])).storage
    log_mel = pa.ListArray.from_arrays(pa.array(np.arange(len(fixed) + 1) * BLOCK * MELS, pa.int32()), fixed.flatten())
    times = np.concatenate([f.blocks for f in features])
    each = pa.StructArray.from_arrays([pa.array(times[:, 0].copy()), pa.array(times[:, 1].copy()), log_mel], names=["start_s", "end_s", "log_mel"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(f.blocks) for f in features)]), pa.int32()), each)


def from_blocks(blocks: pa.ListArray, spans: pa.ListArray) -> list[Features]:
    """The features of clips from their stored blocks and spans."""
    each = blocks.flatten()
    fixed = pa.FixedSizeListArray.from_arrays(each.field("log_mel").flatten(), BLOCK * MELS)
    all_ = pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), (BLOCK, MELS)), fixed).to_numpy_ndarray()
    times = np.stack([each.field(c).to_numpy(zero_copy_only=False) for c in ("start_s", "end_s")], 1)
    seconds = spans.flatten().to_numpy(zero_copy_only=False)
    out, at, turn = [], 0, 0
    for n, m in zip(blocks.value_lengths().to_pylist(), spans.value_lengths().to_pylist(), strict=True):
        own, turns = times[at : at + n], seconds[turn : turn + m].reshape(-1, 2)
        out.append(Features(all_[at : at + n], own, turns, round(own[-1, 1] / STEP), round(float((turns[:, 1] - turns[:, 0]).sum()) / STEP)))
        at, turn = at + n, turn + m
    return out


def clips(media: DataFrame) -> DataFrame:
    """Checksums of the payload and of the stored form of each clip, its active spans (begin and end in turn, in seconds),
    and its blocks: start_s, end_s and log_mel, a tensor of the fixed shape (BLOCK, MELS)."""
    ship(media.sparkSession)

    def run(batches):
        for batch in batches:
            ids, sizes, cells = (batch.column(c) for c in ("doc_id", "n_bytes", "media"))
            for a, b in _runs(np.fromiter((len(c.as_buffer()) for c in cells), np.int64, len(cells))):
                checks, features = [], []
                for cell in cells.slice(a, b - a):
                    stored_form = cell.as_py()
                    own = from_wav(stored_form)
                    checks.append((len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-UNIT:]), len(stored_form), hashlib.sha256(stored_form).hexdigest()))
                    features.append(analyse(own))
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                made = [pa.array(c, t) for c, t in zip(zip(*checks, strict=True), types, strict=True)]
                spans = pa.array([f.spans.ravel() for f in features], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), sizes.slice(a, b - a), *made, spans, _block_array(features)], names=CLIPS.names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, CLIPS)


def tensors(media: DataFrame) -> DataFrame:
    """doc_id, block number, start_s, end_s, and log_mel: tensors of the fixed shape (BLOCK, MELS), a row for each."""
    each = clips(media).select("doc_id", F.posexplode("blocks").alias("block", "b"))
    return each.select("doc_id", "block", "b.start_s", "b.end_s", F.col("b.log_mel").alias("log_mel", metadata=TENSOR))


def digests(media: DataFrame, name: str = "tensors") -> DataFrame:
    """The checksums of each clip, and its features in one line: its tensors and spans are written as a table, and the
    line is made of what is read back."""
    kept = stored(media.sparkSession, clips(media), name, compression="zstd")
    names = CLIPS.names[:-2]

    def run(batches):
        for batch in batches:
            blocks = batch.column("blocks")
            for a, b in _runs(blocks.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) * 4 * BLOCK * MELS):
                lines = pa.array(map(describe, from_blocks(blocks.slice(a, b - a), batch.column("spans").slice(a, b - a))), pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in names), lines], names=[*names, "feature"])

    return kept.mapInArrow(run, f"{_CHECKS}, feature string")
