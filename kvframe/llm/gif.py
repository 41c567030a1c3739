"""Media columns: GIF files to timed frames with colour histograms.

Decoding: the blocks of a file are read, the LZW streams of many frames are decoded in step, one code of each at a
time, palettes (local before global) give colours, frames are drawn on the canvas under their transparency, and the
canvas is disposed of as each frame says. A decoded code is a copy from earlier output, so the steps keep only
offsets and lengths; the bytes follow at the end by pointer doubling.

A null or broken file has no frames, and `error` says why; a stream that ends early leaves its other pixels at
index 0. Extra columns are ignored, repeated rows give repeated rows.

`text_to_gif` stores any bytes as frames of SIDE x SIDE samples on a grey palette, compressed with a table of strings for
each frame. A very long text is a file of many frames; memory goes with the longest text, some 20 bytes for each of its own.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text
from .shared import bounded_batches

SIDE = 24
FRAME = SIDE * SIDE
DELAY_CS = 10
#: Frames decoded and coded in step.
TOGETHER, CODED = 2048, 256
#: Pixels of a canvas and of all frames of a file at most; a file that asks for more has no frames, and `error` says so.
MOST_PIXELS = 1 << 26
#: Levels of each channel in a colour histogram.
LEVELS = 4
_INTERLACE = ((0, 8), (4, 8), (2, 4), (1, 2))
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


@dataclass
class Image:
    """One image block: place, palette (n x 3), code stream and graphic control."""

    left: int
    top: int
    width: int
    height: int
    palette: np.ndarray
    least: int
    stream: bytes
    interlaced: bool = False
    delay: int = 0
    disposal: int = 0
    clear: int | None = None
    index: np.ndarray = field(default=None, repr=False)


@dataclass
class Movie:
    """What a file shows: frames n x height x width x 3, whether each pixel is drawn, delays in 1/100 s."""

    width: int
    height: int
    frames: np.ndarray
    drawn: np.ndarray
    delays: list[int]


def _chain(data: bytes, at: int) -> tuple[bytes, int]:
    """The sub-blocks from `at`, joined, and where they end."""
    parts = []
    while data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def parse(data: bytes, limit: int = MOST_PIXELS) -> tuple[int, int, list[Image]]:
    """Canvas width and height and the image blocks of a file; raises ValueError if it isn't one, or if images and canvases have over `limit` pixels."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("no GIF header")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at, shared, images, control = 13, np.zeros((256, 3), np.uint8), [], (0, 0, None)
    try:
        if flags & 0x80:
            size = 2 << (flags & 7)
            shared = np.frombuffer(data, np.uint8, 3 * size, at).reshape(size, 3)
            at += 3 * size
        pixels = 0
        while data[at] != 0x3B:
            if data[at] == 0x21:
                body, end = _chain(data, at + 2)
                if data[at + 1] == 0xF9 and len(body) >= 4:
                    packed, delay, clear = struct.unpack_from("<BHB", body)
                    control = (delay, packed >> 2 & 7, clear if packed & 1 else None)
                at = end
            elif data[at] == 0x2C:
                left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
                at, palette = at + 10, shared
                pixels += w * h + width * height
                if pixels > limit:
                    raise ValueError("too many pixels")
                if flags & 0x80:
                    size = 2 << (flags & 7)
                    palette = np.frombuffer(data, np.uint8, 3 * size, at).reshape(size, 3)
                    at += 3 * size
                least = data[at]
                if not 1 <= least <= 11:
                    raise ValueError("code size out of range")
                stream, at = _chain(data, at + 1)
                images.append(Image(left, top, w, h, palette, least, stream, bool(flags & 0x40), *control))
                control = (0, 0, None)
            else:
                raise ValueError(f"unknown block {data[at]:#x}")
    except (IndexError, struct.error) as why:
        raise ValueError("file ends early") from why
    return width, height, images


def lzw(streams: list[bytes], leasts: list[int], pixels: list[int]) -> list[np.ndarray]:
    """The index streams, each cut or filled with 0 to its number of pixels; raises ValueError for an impossible code."""
    n = len(streams)
    least = np.array(leasts, np.int64)
    most = np.array(pixels, np.int64)
    size = np.array([len(s) for s in streams], np.int64)
    base = np.cumsum(size + 4) - size - 4
    data = np.frombuffer(b"\0\0\0\0".join(streams) + b"\0\0\0\0", np.uint8).astype(np.int64)
    end = 8 * size
    clear, first = 1 << least, (1 << least) + 2
    entries = int(min(4096, max(first + end // (least + 1) + 2)))
    source, length = np.zeros((n, entries), np.int32), np.zeros((n, entries), np.int32)
    bit, width, free = np.zeros(n, np.int64), least + 1, first.copy()
    place, last, last_size = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.zeros(n, np.int64)
    begins = np.cumsum(most) - most
    out = np.zeros(int(most.sum()), np.uint8)
    copies: list[tuple] = []
    live = np.flatnonzero((most > 0) & (end > 0))
    while len(live):
        b, w = bit[live], width[live]
        at = base[live] + (b >> 3)
        code = ((data[at] | data[at + 1] << 8 | data[at + 2] << 16) >> (b & 7)) & ((1 << w) - 1)
        bit[live] = b + w
        fresh, c = code == clear[live], clear[live]
        if fresh.any():
            r = live[fresh]
            width[r], free[r], last[r] = least[r] + 1, first[r], -1
        body = ~fresh & (code != c + 1)
        done = ~fresh & ~body | (b + w > end[live])
        body &= ~done
        if body.any():
            r, k = live[body], code[body]
            literal = k < clear[r]
            f, before, before_size = free[r], last[r], last_size[r]
            if ((k > f) | (k == f) & (before < 0)).any():
                raise ValueError("code before its entry")
            p = place[r]
            if literal.all():
                span = np.ones(len(r), np.int64)
                out[begins[r] + p] = k
            else:
                known = np.minimum(k, entries - 1)
                repeat = ~literal & (k == f)
                span = np.where(literal, 1, np.where(repeat, before_size + 1, length[r, known]))
                out[begins[r[literal]] + p[literal]] = k[literal]
                far = ~literal
                origin = np.where(repeat, before, source[r, known])[far]
                copies.append((begins[r[far]] + p[far], begins[r[far]] + origin, np.minimum(span[far], most[r[far]] - p[far])))
            grows = (before >= 0) & (f < 4096)
            g = r[grows]
            source[g, f[grows]], length[g, f[grows]] = before[grows], before_size[grows] + 1
            free[g] += 1
            width[g] += (free[g] == 1 << width[g]) & (width[g] < 12)
            last[r], last_size[r] = p, span
            place[r] = p + span
        live = live[~done & (place[live] < most[live]) & (bit[live] < end[live])]
    if copies:
        to, origin, count = (np.concatenate(x) for x in zip(*copies, strict=True))
        pointer = np.arange(len(out))
        pointer[text.ranges(to, count)] = text.ranges(origin, count)
        while True:
            further = pointer[pointer]
            if np.array_equal(further, pointer):
                break
            pointer = further
        out = out[pointer]
    return np.split(out, begins[1:])


def draw(width: int, height: int, images: list[Image]) -> Movie:
    """The canvas as each frame shows it."""
    if all((i.left, i.top, i.width, i.height, i.clear, i.interlaced) == (0, 0, width, height, None, False) and i.palette is images[0].palette for i in images) and images:
        full = np.zeros((256, 3), np.uint8)
        full[: len(images[0].palette)] = images[0].palette[:256]
        frames = full[np.stack([i.index for i in images])].reshape(-1, height, width, 3)
        return Movie(width, height, frames, np.ones(frames.shape[:3], bool), [i.delay for i in images])
    canvas, drawn = np.zeros((height, width, 3), np.uint8), np.zeros((height, width), bool)
    frames, masks = [], []
    for i in images:
        before = (canvas.copy(), drawn.copy()) if i.disposal == 3 else None
        index = i.index.reshape(i.height, i.width)
        if i.interlaced:
            rows = np.concatenate([np.arange(a, i.height, s) for a, s in _INTERLACE])
            index = index[np.argsort(rows)]
        index = index[: max(0, height - i.top), : max(0, width - i.left)]
        box = np.s_[i.top : i.top + index.shape[0], i.left : i.left + index.shape[1]]
        full = np.zeros((256, 3), np.uint8)
        full[: len(i.palette)] = i.palette[:256]
        seen = np.ones(index.shape, bool) if i.clear is None else index != i.clear
        canvas[box][seen] = full[index[seen]]
        drawn[box] |= seen
        frames.append(canvas.copy())
        masks.append(drawn.copy())
        if i.disposal == 2:
            canvas[box], drawn[box] = 0, False
        elif before:
            canvas, drawn = before
    shape = (len(images), height, width)
    return Movie(width, height, np.array(frames, np.uint8).reshape(*shape, 3), np.array(masks, bool).reshape(shape), [i.delay for i in images])


def decode(files: list[bytes | None], limit: int = MOST_PIXELS) -> list[Movie | str]:
    """What each file shows, or why it can't be read."""
    out: list = []
    for data in files:
        try:
            out.append(parse(data, limit) if data is not None else "null")
        except ValueError as why:
            out.append(str(why))
    images = [(n, i) for n, x in enumerate(out) if not isinstance(x, str) for i in x[2]]
    for at in range(0, len(images), TOGETHER):
        part = images[at : at + TOGETHER]
        for some in [part], [[x] for x in part]:  # one by one if one of them is broken
            try:
                for group in some:
                    for (_, i), index in zip(group, lzw([i.stream for _, i in group], [i.least for _, i in group], [i.width * i.height for _, i in group]), strict=True):
                        i.index = index
                break
            except ValueError:
                continue
        for n, i in part:
            if i.index is None:
                out[n] = "impossible code"
    return [x if isinstance(x, str) else draw(*x) for x in out]


def histograms(movie: Movie) -> np.ndarray:
    """For each frame the drawn pixels of each of LEVELS**3 colours, red slowest."""
    step = 256 // LEVELS
    level = movie.frames // step
    colour = (level[..., 0].astype(np.int64) * LEVELS + level[..., 1]) * LEVELS + level[..., 2]
    n, bins = len(colour), LEVELS**3
    slot = colour + bins * np.arange(n)[:, None, None]
    return np.bincount(slot[movie.drawn], minlength=n * bins).reshape(n, bins)


def gif_frames(files: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row for each frame of each file: key, frame, at_cs, delay_cs, width, height, pixels (RGB), histogram; one row with `error` for a file without frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(batch.column(key).to_pylist(), batch.column(column).to_pylist(), strict=True):
                movie = decode([data])[0]
                if isinstance(movie, str) or not len(movie.frames):
                    yield pa.RecordBatch.from_pylist([{"key": k, "error": movie if isinstance(movie, str) else "no frames"}], schema)
                    continue
                bins, at = histograms(movie), np.cumsum([0, *movie.delays])
                for f, delay in enumerate(movie.delays):
                    yield pa.RecordBatch.from_pylist([{"key": k, "frame": f, "at_cs": int(at[f]), "delay_cs": delay, "width": movie.width, "height": movie.height, "pixels": movie.frames[f].tobytes(), "histogram": bins[f].tolist(), "error": None}], schema)

    kinds = [("key", pa.int64()), ("frame", pa.int64()), ("at_cs", pa.int64()), ("delay_cs", pa.int64()), ("width", pa.int64()), ("height", pa.int64()), ("pixels", pa.binary()), ("histogram", pa.list_(pa.int64())), ("error", pa.string())]
    schema = pa.schema(kinds)
    bounded_batches(files.sparkSession)
    rows = files.select(F.col(key).cast("long"), F.col(column).cast("binary"))
    return rows.mapInArrow(run, "key long, frame long, at_cs long, delay_cs long, width long, height long, pixels binary, histogram array<long>, error string").withColumnRenamed("key", key)


_HEAD = b"GIF89a" + struct.pack("<HHBBB", SIDE, SIDE, 0xF7, 0, 0) + np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()
_LEAD = b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2, DELAY_CS, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, SIDE, SIDE, 0) + b"\x08"
#: Codes of a frame that are nine bits wide: the clear code and so many data codes as fill the table to 512.
_NARROW = 256
_tables: list[np.ndarray] = []


def codes_of(payload: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """LZW codes of frames of samples (n x FRAME, CODED at most), clear and end code included, and how many each frame has.

    The frames are coded in step, one sample of each at a time, with a table of the strings each has seen. A frame
    adds at most FRAME - 1 strings, so codes stay under 1024 and one clear code, the first, is enough.
    """
    if not _tables:
        _tables.append(np.zeros(CODED * (258 + FRAME) * 256, np.uint16))  # left empty for the next call
    table, n = _tables[0], len(payload)
    base, samples = np.arange(n) * ((258 + FRAME) * 256), payload.T.astype(np.int64)
    codes, free = np.full((FRAME + 2, n), 257, np.uint16), np.full(n, 258, np.uint16)
    codes[0] = 256
    count, rows, used = np.ones(n, np.int64), np.arange(n), []
    held = samples[0]
    for own in samples[1:]:
        at = base + (held << 8) + own
        longer = table[at]
        new = longer == 0
        codes[count[new], rows[new]] = held[new]
        entries = at[new]
        table[entries] = free[new]
        used.append(entries)
        count += new
        free += new
        held = np.where(new, own, longer)
    codes[count, rows] = held
    table[np.concatenate(used)] = 0
    return codes.T, count + 2


def _streams(payload: np.ndarray) -> list[bytes]:
    """The image blocks of frames of samples."""
    codes, count = codes_of(payload)
    bits = np.unpackbits(np.ascontiguousarray(codes).view(np.uint8).reshape(*codes.shape, 2), axis=2, bitorder="little")
    flat = np.concatenate([bits[:, :_NARROW, :9].reshape(len(codes), -1), bits[:, _NARROW:, :10].reshape(len(codes), -1)], 1)
    packed = np.packbits(flat, axis=1, bitorder="little")
    size = (9 * np.minimum(count, _NARROW) + 10 * np.maximum(0, count - _NARROW) + 7) // 8
    out = []
    for row, n in zip(packed, size.tolist(), strict=True):
        stream = row[:n].tobytes()
        out.append(_LEAD + b"".join(bytes([len(x)]) + x for x in (stream[at : at + 255] for at in range(0, n, 255))) + b"\0")
    return out


def text_to_gif(data: bytes) -> bytes:
    """A GIF that holds `data`, filled with bytes 255 to a positive multiple of FRAME."""
    return texts_to_gif([data])[0]


def texts_to_gif(texts: list[bytes]) -> list[bytes]:
    counts = [max(1, -(-len(t) // FRAME)) for t in texts]
    payload = b"".join(t.ljust(c * FRAME, b"\xff") for t, c in zip(texts, counts, strict=True))
    frames = np.frombuffer(payload, np.uint8).reshape(-1, FRAME)
    blocks = [x for at in range(0, len(frames), CODED) for x in _streams(frames[at : at + CODED])]
    ends = np.cumsum(counts).tolist()
    return [_HEAD + b"".join(blocks[b - c : b]) + b"\x3b" for b, c in zip(ends, counts, strict=True)]


def feature(movie: Movie) -> str:
    """Frames, duration in 1/100 s and the shares in 1/1000 of the colours that occur, of the whole file."""
    bins = histograms(movie).sum(0)
    total = max(1, int(bins.sum()))
    return f"frames={len(movie.frames)};cs={sum(movie.delays)};" + ",".join(f"{k}:{1000 * int(v) // total}" for k, v in enumerate(bins) if v)


def store_and_read(docs: DataFrame) -> DataFrame:
    """Each text as a GIF, stored, read back by the decoder and summed up: sizes, checksums and a feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text.blocks(batches, 1 << 20):
            files, out = texts_to_gif(block.texts), []
            for doc_id, size, data, movie in zip(block.columns["doc_id"], block.size.tolist(), files, decode(files, max(MOST_PIXELS, 4 * max(map(len, block.texts)) + 4 * FRAME)), strict=True):
                payload = movie.frames[..., 0].tobytes()
                out.append((doc_id, size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(movie)))
            names = [x.split()[0] for x in DIGEST.split(", ")]
            yield pa.record_batch([pa.array(x, pa.string() if n.endswith(("sha256", "feature")) else pa.int64()) for x, n in zip(zip(*out, strict=True), names, strict=True)], names=names)

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, DIGEST)
