"""Media columns: bytes stored losslessly as 8-bit audio, and audio features from what is stored.

`store` puts a payload into a WAV container, `load` takes it out again, and `features` resamples with a polyphase
filter, computes overlapped log-mel filterbanks and cuts the signal into active segments by energy with hysteresis.
Segments carry time spans; their frames are cut into tensors of one shape (`FRAMES` x `MELS`, the last one padded with
the floor value). Tensors are stored as Arrow files of a fixed-shape tensor column beside the start and end of each, a
record batch a row of the input; a row's features name its file and batch, so a file that a lost task left behind is
never read. Every row is computed by itself, so equal payloads give equal values wherever they lie.

A null text is an empty one, whose payload is padding alone. Rows are kept one to one, whatever their ids. No rows give no
features and no files. Kept columns must not bear the names of the new ones.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fields, packed, q, raw_texts, table

UNIT, PAD = 576, b"\xff"
RATE, TARGET = 16_000, 8_000
WINDOW, HOP, FFT, MELS, FRAMES = 200, 80, 256, 32, 64
FLOOR = -10.0


_made: dict = {}


def _once(make, *args):
    """Filters are made once in a process."""
    key = (make.__name__, *map(int, args))
    if key not in _made:
        _made[key] = make(*key[1:])
    return _made[key]


def padded(body: bytes) -> bytes:
    """The body and padding up to a positive multiple of UNIT."""
    return body + PAD * (-len(body) % UNIT if body else UNIT)


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file of 8-bit samples."""
    odd = b"\0" * (len(samples) % 2)
    form = struct.pack("<HHIIHH", 1, 1, rate, rate, 1, 8)
    chunks = b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(samples)) + samples + odd
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def read_wav(data: bytes) -> tuple[bytes, int]:
    """Samples and rate of a mono 8-bit WAV file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not mono 8-bit samples")
        elif name == b"data":
            if rate is None or at + 8 + size > len(data):
                raise ValueError("a WAV file without format or cut short")
            return data[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("a WAV file without samples")


def _filters(up: int, down: int, half: int = 16) -> np.ndarray:
    """Taps of each phase of a windowed-sinc low-pass, a row a phase, for correlation."""
    most = max(up, down)
    n = np.arange(-half * most, half * most + 1)
    taps = np.sinc(n / most) * np.kaiser(len(n), 6.0) * up / most
    taps = np.concatenate([taps, np.zeros(-len(taps) % up)])
    return taps.reshape(-1, up).T[:, ::-1].astype(np.float32)


def resample(x: np.ndarray, rate: int, target: int = TARGET) -> np.ndarray:
    """Polyphase resampling: each output sample takes only the taps of its phase."""
    common = np.gcd(rate, target)
    up, down = target // common, rate // common
    if up == down:
        return x.astype(np.float32)
    phases = _once(_filters, up, down)
    width, delay = phases.shape[1], 16 * max(up, down)
    n_out = -(-len(x) * up // down)
    at = np.arange(n_out) * down + delay
    base, phase = at // up, at % up
    ready = np.concatenate([np.zeros(width - 1, np.float32), x.astype(np.float32), np.zeros(int(base[-1]) + 1 if n_out else 0, np.float32)])
    views = np.lib.stride_tricks.sliding_window_view(ready, width)
    out = np.empty(n_out, np.float32)
    for p in range(up):
        own = np.flatnonzero(phase == p)
        for i in range(0, len(own), 65_536):
            out[own[i : i + 65_536]] = views[base[own[i : i + 65_536]]] @ phases[p]
    return out


def _mel_filters(rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Analysis window and triangular filters of equal width on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60.0), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FFT, 1 / rate)[:, None]
    up, down = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.hanning(WINDOW).astype(np.float32), np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(x: np.ndarray, rate: int = TARGET) -> np.ndarray:
    """Log energies of overlapped frames, a row a frame; a signal shorter than a frame is padded to one."""
    window, filters = _once(_mel_filters, rate)
    x = np.concatenate([x, np.zeros(max(0, WINDOW - len(x)), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP]
    out = []
    for i in range(0, len(frames), 4096):
        spectrum = np.fft.rfft(frames[i : i + 4096] * window, FFT)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        out.append(np.log(np.maximum(power @ filters, np.float32(np.exp(FLOOR)))))
    return np.concatenate(out)


def segments(energy: np.ndarray, raise_: float = 0.25, drop: float = 0.25, shortest: int = 5) -> list[tuple[int, int]]:
    """Active stretches of frames: they begin above the mean by `raise_` deviations and last until the energy falls
    below it by `drop` deviations; shorter ones than `shortest` frames go."""
    mean, spread = float(energy.mean()), float(energy.std())
    turn = np.where(energy > mean + raise_ * spread, 1, np.where(energy < mean - drop * spread, -1, 0))
    last = np.maximum.accumulate(np.where(turn != 0, np.arange(len(turn)), -1))
    active = np.where(last >= 0, turn[np.maximum(last, 0)], -1) == 1
    edge = np.flatnonzero(np.diff(np.concatenate([[0], active.astype(np.int8), [0]])))
    return [(a, z) for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if z - a >= shortest]


def tensors(mel: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (in seconds) and values of the segments' frames in pieces of one shape."""
    at = [(i, min(i + FRAMES, z)) for a, z in spans for i in range(a, z, FRAMES)]
    values = np.full((len(at), FRAMES, MELS), FLOOR, "<f4")
    for k, (i, j) in enumerate(at):
        values[k, : j - i] = mel[i:j]
    edges = np.array(at, np.float64).reshape(-1, 2)
    return edges[:, 0] * HOP / TARGET, ((edges[:, 1] - 1) * HOP + WINDOW) / TARGET, values


def tensor_batch(start: np.ndarray, end: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """One Arrow record batch: start, end and the fixed-shape tensors, in the precision in which they are computed."""
    kind = pa.fixed_shape_tensor(pa.float32(), [FRAMES, MELS], dim_names=["frame", "mel"])
    held = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), FRAMES * MELS))
    return pa.RecordBatch.from_arrays([pa.array(start, pa.float64()), pa.array(end, pa.float64()), held], ["start", "end", "tensor"])


class _TensorFile:
    """An Arrow file of one task, opened with the first tensor."""

    def __init__(self, folder: str):
        self.folder, self.name, self.out, self.n = folder, None, None, 0

    def add(self, batch: pa.RecordBatch) -> tuple[str, int]:
        if self.out is None:
            system, at = fs.FileSystem.from_uri(self.folder)
            system.create_dir(at, recursive=True)
            self.name = f"tensors-{uuid.uuid4().hex}.arrow"
            self.raw = system.open_output_stream(f"{at}/{self.name}")
            self.out = pa.ipc.new_file(self.raw, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
        self.out.write_batch(batch)
        self.n += 1
        return self.name, self.n - 1

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.raw.close()


def store(docs: DataFrame, text: str = "text", keep: list[str] = ("doc_id",), rate: int = RATE) -> DataFrame:
    """The `keep` columns, n_bytes of the text, and media: its padded bytes as a WAV file; written to a table in the shared
    folder and read back from it."""
    rows = docs.select(packed(docs, list(keep)).alias("row"), docs[q(text)].cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = raw_texts(batch)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([len(b) for b in bodies], pa.int64()), pa.array([wav(padded(b), rate) for b in bodies], pa.binary())], ["row", "n_bytes", "media"])

    schema = T.StructType([rows.schema["row"], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    return table(rows.mapInArrow(run, schema), "media", compression="zstd").select(*fields("row", list(keep)), "n_bytes", "media")


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType())]))
_FEATURES = T.StructType(
    [T.StructField(n, k) for n, k in (("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("seconds", T.DoubleType()), ("n_frames", T.LongType()), ("mel_mean", T.ArrayType(T.DoubleType())))]
    + [T.StructField("spans", _SPANS), T.StructField("n_tensors", T.LongType()), T.StructField("tensor_file", T.StringType()), T.StructField("tensor_batch", T.LongType())]
)


def features(stored: DataFrame, folder: str, media: str = "media") -> DataFrame:
    """All columns but `media`, and of what is stored: media_bytes, media_sha256, payload_bytes, payload_sha256,
    tail_crc32 (of the last 32 bytes), seconds, n_frames, mel_mean (a value a band), spans (start, end of active
    segments), n_tensors, and where these are: tensor_file in `folder` and tensor_batch in it (null without tensors).
    Computed once, into a table."""
    rest = [c for c in stored.columns if c != media]
    rows = stored.select(packed(stored, rest).alias("row"), stored[q(media)].alias("media"))
    span = pa.struct([("start", pa.float64()), ("end", pa.float64())])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.float64()), pa.list_(span), pa.int64(), pa.string(), pa.int64()]

    def one(data: bytes, out: _TensorFile) -> tuple:
        payload, rate = read_wav(data)
        x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
        mel = log_mel(resample(x, rate))
        found = segments(mel.mean(axis=1, dtype=np.float64))
        spans = [{"start": a * HOP / TARGET, "end": ((z - 1) * HOP + WINDOW) / TARGET} for a, z in found]
        start, end, values = tensors(mel, found)
        at = out.add(tensor_batch(start, end, values)) if len(start) else (None, None)
        return len(data), hashlib.sha256(data).hexdigest(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(payload) / rate, len(mel), mel.mean(axis=0, dtype=np.float64).tolist(), spans, len(start), *at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _TensorFile(folder)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                got = [one(m, out) for m in part.column("media").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("row"), *(pa.array([r[k] for r in got], t) for k, t in enumerate(kinds))], ["row", *_FEATURES.names])
        out.close()

    made = table(rows.mapInArrow(run, T.StructType([rows.schema["row"], *_FEATURES.fields])), "features")
    return made.select(*fields("row", rest), *_FEATURES.names)


def with_tensors(found: DataFrame, folder: str, digest_only: bool = False) -> DataFrame:
    """The rows of `features` with their tensors read back: `tensors`, an array of (start, end, values as float32 bytes),
    or, with `digest_only`, `tensors_sha256` over all of them, empty text without tensors."""
    rows = found.select(packed(found).alias("row"), "n_tensors", "tensor_file", "tensor_batch")
    piece = pa.struct([("start", pa.float64()), ("end", pa.float64()), ("values", pa.binary())])
    name = "tensors_sha256" if digest_only else "tensors"

    def read(batch: pa.RecordBatch) -> object:
        values = batch.column("tensor").storage.flatten().to_numpy().reshape(-1, FRAMES * MELS)
        if digest_only:
            return hashlib.sha256(batch.column("start").to_numpy().tobytes() + batch.column("end").to_numpy().tobytes() + values.tobytes()).hexdigest()
        return [{"start": a, "end": z, "values": v.tobytes()} for a, z, v in zip(batch.column("start").to_pylist(), batch.column("end").to_pylist(), values, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = fs.FileSystem.from_uri(folder)
        current, raw, file = None, None, None
        for batch in batches:
            got = []
            for path, k in zip(batch.column("tensor_file").to_pylist(), batch.column("tensor_batch").to_pylist(), strict=True):
                if path is None:
                    got.append("" if digest_only else [])
                    continue
                if path != current:
                    if raw is not None:
                        raw.close()
                    raw = system.open_input_file(f"{at}/{path}")
                    current, file = path, pa.ipc.open_file(raw)
                got.append(read(file.get_batch(k)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(got, pa.string() if digest_only else pa.list_(piece))], ["row", name])

    kind = T.StringType() if digest_only else T.ArrayType(T.StructType([*_SPANS.elementType.fields, T.StructField("values", T.BinaryType())]))
    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField(name, kind)])).select(*fields("row", found.columns), name)
