"""Media columns as AVI files of motion JPEG: frames of 24 x 24 8-bit samples, each a lossless (SOF3) JPEG.

Writing pads a payload with bytes 255 to a positive multiple of 576 and makes one intra frame of every 576 bytes.
Reading parses the RIFF index (``idx1``) and each frame's JPEG headers, decodes the Huffman-coded differences of
all frames of a batch in step, and undoes the left-neighbour prediction. Shots are cut where the difference of
successive frames' histograms stands out from those just before it.

Frames are coded ``STEP`` at a time, so a very long text takes no more scratch than its own bytes and file.

Defined results: a null text is an empty text and makes one frame of padding; equal texts make equal files; rows
with a null id and repeated rows are stored each on its own; other columns are ignored; a null file has no clips;
a file that is no AVI of this kind raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import one_cache, ship, table

SIDE, FPS = 24, 12
FRAME = SIDE * SIDE
#: Payload bytes of a batch of texts, and frames that are coded at once.
CHUNK, STEP = 1 << 20, 2048
BINS, MEMORY = 16, 8
#: Smallest histogram difference of a cut, and standard deviations over the mean of the last MEMORY ones.
LEAST_CUT, SIGMAS = 0.12, 3.0

_diff = np.arange(-255, 256)
_cat = np.array([int(abs(d)).bit_length() for d in _diff])
_extra = np.where(_diff > 0, _diff, _diff + (1 << _cat) - 1) * (_cat > 0)
#: Nine categories with codes of four bits each (0000 to 1000), then the category's own bits.
CODE, LENGTH = ((_cat << _cat) | _extra).astype(np.uint16), (4 + _cat).astype(np.uint8)
HEADER = (
    b"\xff\xd8"
    + b"\xff\xc4" + struct.pack(">HB", 28, 0) + bytes([0, 0, 0, 9] + [0] * 12) + bytes(range(9))
    + b"\xff\xc3" + struct.pack(">HBHHB", 11, 8, SIDE, SIDE, 1) + b"\x01\x11\x00"
    + b"\xff\xda" + struct.pack(">HB", 8, 1) + b"\x01\x00" + b"\x01\x00\x00"
)


def padded(data: bytes) -> bytes:
    return data + b"\xff" * (max(FRAME, -(-len(data) // FRAME) * FRAME) - len(data))


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG files of (n, 576) samples."""
    n = len(samples)
    s = samples.reshape(n, SIDE, SIDE).astype(np.int16)
    d = np.empty_like(s)
    d[:, :, 1:] = s[:, :, 1:] - s[:, :, :-1]
    d[:, 1:, 0] = s[:, 1:, 0] - s[:, :-1, 0]
    d[:, 0, 0] = s[:, 0, 0] - 128
    d = d.reshape(n, FRAME) + 255
    length = np.empty((n, FRAME + 1), dtype=np.uint8)
    length[:, :FRAME] = LENGTH[d]
    bits = length[:, :FRAME].sum(axis=1, dtype=np.int64)
    length[:, FRAME] = -bits % 8  # filled with ones up to a whole byte
    code = np.empty((n, FRAME + 1), dtype=">u2")
    code[:, :FRAME] = CODE[d].astype(np.uint16) << (16 - LENGTH[d]).astype(np.uint16)
    code[:, FRAME] = 0xFFFF
    each = np.unpackbits(code.view(np.uint8).reshape(-1, 2), axis=1)
    stream = np.packbits(each[np.arange(16, dtype=np.uint8) < length.reshape(-1, 1)])
    ends = np.cumsum((bits + 7) // 8)
    full = stream == 255
    out_ends = ends + np.cumsum(full)[ends - 1]
    stuffed = np.repeat(stream, 1 + full)
    stuffed[np.flatnonzero(full) + np.cumsum(full)[full]] = 0  # a zero byte after every 255
    data, at, files = stuffed.tobytes(), 0, []
    for e in out_ends.tolist():
        files.append(HEADER + data[at:e] + b"\xff\xd9")
        at = e
    return files


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def mux(frames: list[bytes]) -> bytes:
    """An AVI file of JPEG frames."""
    n = len(frames)
    avih = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, n, 0, 1, 0, SIDE, SIDE, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, n, 0, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    size = np.array([len(f) for f in frames], dtype=np.int64)
    index = np.zeros((n, 4), dtype="<u4")
    index[:, 0], index[:, 1], index[:, 3] = int.from_bytes(b"00dc", "little"), 0x10, size
    index[:, 2] = 4 + np.concatenate(([0], np.cumsum(size + (size & 1) + 8)[:-1]))
    movi = b"".join(_chunk(b"00dc", f) for f in frames)
    return _chunk(b"RIFF", b"AVI " + head + _chunk(b"LIST", b"movi" + movi) + _chunk(b"idx1", index.tobytes()))


def index_of(avi: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the frames, from the file's RIFF index."""
    if avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    at, movi, index = 12, -1, None
    while at + 8 <= len(avi):
        name, size = avi[at : at + 4], struct.unpack_from("<I", avi, at + 4)[0]
        if name == b"LIST" and avi[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"idx1":
            index = np.frombuffer(avi, dtype="<u4", count=size // 16 * 4, offset=at + 8).reshape(-1, 4)
        at += 8 + size + (size & 1)
    if movi < 0 or index is None:
        raise ValueError("an AVI file without frames or index")
    return index[:, 2].astype(np.int64) + movi + 8, index[:, 3].astype(np.int64)


@lru_cache(64)
def tables_of(header: bytes) -> tuple[np.ndarray, np.ndarray]:
    """From a frame's headers: difference and bits used, for every 16 bits that the stream may go on with."""
    at, lut, used, kind = 2, None, None, None
    while at < len(header):
        marker, size = header[at + 1], struct.unpack_from(">H", header, at + 2)[0]
        body = header[at + 4 : at + 2 + size]
        if marker == 0xC4:
            lut, used, code, at_value = np.zeros(1 << 16, np.int16), np.zeros(1 << 16, np.uint8), 0, 17
            for bits in range(1, 17):
                for _ in range(body[bits]):
                    cat = body[at_value]
                    at_value += 1
                    if bits + cat > 16:
                        raise ValueError("a code of over 16 bits")
                    extra = np.arange(1 << cat)
                    value = np.where(extra >= (1 << cat) >> 1, extra, extra - (1 << cat) + 1) if cat else np.zeros(1, int)
                    rest = 16 - bits - cat
                    lo = code << (16 - bits)
                    lut[lo : lo + (1 << (16 - bits))] = np.repeat(value, 1 << rest)
                    used[lo : lo + (1 << (16 - bits))] = bits + cat
                    code += 1
                code <<= 1
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8:
            kind = (marker, *struct.unpack(">BHHB", body[:6]))
        elif marker == 0xDA and body[-3] != 1:
            raise ValueError("another predictor")
        at += 2 + size
    if kind != (0xC3, 8, SIDE, SIDE, 1) or lut is None:
        raise ValueError("no lossless 24 x 24 frame")
    return lut, used


def _header_size(frame: bytes) -> int:
    at = 2
    while True:
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        at += 2 + size
        if marker == 0xDA:
            return at


def decode_frames(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(n, 576) samples of the JPEG frames that stand at ``starts`` in ``data``. All have one set of headers."""
    n = len(starts)
    first = data[starts[0] : starts[0] + sizes[0]].tobytes()
    size = _header_size(first)
    if (data[starts[:, None] + np.arange(size)] != np.frombuffer(first[:size], np.uint8)).any():
        return np.concatenate([decode_frames(data, starts[i : i + 1], sizes[i : i + 1]) for i in range(n)])
    lut, used = tables_of(first[:size])
    length = sizes - size - 2
    bounds = np.concatenate(([0], np.cumsum(length)))
    scan = data[np.repeat(starts + size - bounds[:-1], length) + np.arange(bounds[-1])]
    stuffing = np.zeros(len(scan), dtype=bool)
    stuffing[1:] = (scan[1:] == 0) & (scan[:-1] == 255)
    stuffing[bounds[:-1]] = False
    removed = np.concatenate(([0], np.cumsum(stuffing)))
    scan = np.concatenate((scan[~stuffing], np.zeros(3, np.uint8))).astype(np.int32)
    window = scan[:-2] << 16 | scan[1:-1] << 8 | scan[2:]
    at = (bounds[:-1] - removed[bounds[:-1]]) * 8
    out = np.empty((FRAME, n), dtype=np.int16)
    for k in range(FRAME):  # all frames in step
        code = window[at >> 3] >> (8 - (at & 7)) & 0xFFFF
        out[k] = lut[code]
        at += used[code]
    d = out.T.reshape(n, SIDE, SIDE).astype(np.int32)
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1) + 128
    return np.cumsum(d, axis=2).astype(np.uint8).reshape(n, FRAME)


def write_avi(payloads: list[bytes]) -> list[bytes]:
    """AVI files of payloads, each a positive multiple of 576 bytes."""
    samples = np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(-1, FRAME)
    frames = [f for i in range(0, len(samples), STEP) for f in encode_frames(samples[i : i + STEP])]
    out, at = [], 0
    for p in payloads:
        n = len(p) // FRAME
        out.append(mux(frames[at : at + n]))
        at += n
    return out


def read_avi(files: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All frames' samples, and each file's bounds among them."""
    starts, sizes, at, bounds = [], [], 0, [0]
    for f in files:
        a, b = index_of(f)
        starts.append(a + at)
        sizes.append(b)
        at += len(f)
        bounds.append(bounds[-1] + len(a))
    if not bounds[-1]:
        return np.zeros((0, FRAME), np.uint8), np.array(bounds)
    data, starts, sizes = np.frombuffer(b"".join(files), dtype=np.uint8), np.concatenate(starts), np.concatenate(sizes)
    samples = np.empty((len(starts), FRAME), dtype=np.uint8)
    for i in range(0, len(starts), STEP):
        samples[i : i + STEP] = decode_frames(data, starts[i : i + STEP], sizes[i : i + STEP])
    return samples, np.array(bounds)


def histogram_steps(samples: np.ndarray) -> np.ndarray:
    """For each frame, its histogram's distance (0 to 1) from that of the frame before it; 0 for the first."""
    n = len(samples)
    h = np.empty((n, BINS), dtype=np.int64)
    for i in range(0, n, STEP):
        part = samples[i : i + STEP] >> 4
        h[i : i + STEP] = np.bincount((np.arange(len(part))[:, None] * BINS + part).ravel(), minlength=len(part) * BINS).reshape(-1, BINS)
    step = np.zeros(n)
    step[1:] = np.abs(h[1:] - h[:-1]).sum(axis=1) / (2 * FRAME)
    return step


def cuts(step: np.ndarray) -> np.ndarray:
    """Frames that start a new shot, from one file's steps."""
    n = len(step)
    if n < 2:
        return np.zeros(0, dtype=np.int64)
    x = step[1:]
    total, square = np.concatenate(([0], np.cumsum(x))), np.concatenate(([0], np.cumsum(x * x)))
    i = np.arange(len(x))
    lo = np.maximum(0, i - MEMORY)
    m = np.maximum(1, i - lo)
    mean = (total[i] - total[lo]) / m
    sd = np.sqrt(np.maximum(0, (square[i] - square[lo]) / m - mean * mean))
    limit = np.where(i - lo >= 2, np.maximum(LEAST_CUT, mean + SIGMAS * sd), 2 * LEAST_CUT)
    return np.flatnonzero(x > limit) + 1


def _by_size(values: list, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    i = total = 0
    for j, v in enumerate(values):
        if j > i and total + len(v) > limit:
            yield i, j
            i, total = j, 0
        total += len(v)
    if i < len(values):
        yield i, len(values)


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text as an AVI file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            for i, j in _by_size(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([len(x) for x in texts[i:j]], pa.int64()), pa.array(write_avi([padded(x) for x in texts[i:j]]), pa.binary())], names=["doc_id", "n_bytes", "media"])

    ship(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def clips(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Timed clip rows of every file: (doc_id, clip, start_frame, end_frame, start_s, end_s)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, files = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = [k for k, f in enumerate(files) if f is not None]
            ids, files = [ids[k] for k in keep], [files[k] for k in keep]
            for i, j in _by_size(files):
                samples, bounds = read_avi(files[i:j])
                step, rows = histogram_steps(samples), []
                for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    edges = [0, *cuts(np.concatenate(([0], step[a + 1 : b]))).tolist(), int(b - a)]
                    rows += [(ids[i + k], c, s, e, s / FPS, e / FPS) for c, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if e > s]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()), strict=True)], names=["doc_id", "clip", "start_frame", "end_frame", "start_s", "end_s"])

    ship(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(
        run, "doc_id long, clip int, start_frame int, end_frame int, start_s double, end_s double")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes each text's file, reads it back, and returns digests and shots; files stay within the worker."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256
        one_cache({})
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                part = batch.slice(s, 1024)
                texts, rows = [x or b"" for x in part.column(1).cast(pa.binary()).to_pylist()], []
                for i, j in _by_size(texts):
                    files = write_avi([padded(x) for x in texts[i:j]])
                    samples, bounds = read_avi(files)
                    step = histogram_steps(samples)
                    for text, f, a, b in zip(texts[i:j], files, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                        own = samples[a:b].tobytes()
                        steps = np.concatenate(([0], step[a + 1 : b]))
                        c = cuts(steps).tolist()
                        feature = f"frames={b - a};clips={len(c) + 1};peak={steps.max():.6f};cuts={','.join(map(str, c))}"
                        rows.append((len(text), len(own), sha(own).hexdigest(), zlib.crc32(own[-32:]), len(f), sha(f).hexdigest(), feature))
                cols = list(zip(*rows, strict=True)) if rows else [()] * 7
                types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, t) for x, t in zip(cols, types, strict=True))], names=names)

    ship(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op10(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
