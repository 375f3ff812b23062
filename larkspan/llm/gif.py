"""GIF: encoding, decoding and a table of timed frames.

The decoder reads LZW code streams, global and local palettes, interlacing, transparency, delays and disposal, and
composes each frame on the canvas. Codes of a segment are cut from the bit stream at once, as their widths follow from
their place after the last clear code.

Frames are decoded one at a time, so a very long medium holds a canvas and a frame. Null media have no frames; bytes that
are no GIF give one row whose error says so. Repeated rows give repeated results, empty tables empty tables.
Columns other than the id and the media are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import length_hint

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Width in samples of a row, and rows of a frame at most, of payloads stored as media.
WIDTH, ROWS = 64, 1024

_INDEX = np.arange(8192)
#: Width of the code at each place after a clear code, for 8-bit samples.
_WIDTHS = {m: np.minimum(12, np.array([int((1 << m) + 1 + i).bit_length() for i in range(8192)])) for m in range(2, 9)}


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    # Codes are kept shifted by eight bits, so that a prefix and a sample make a key at once.
    clear, end = 1 << bits, (1 << bits) + 1
    segments: list[list[int]] = []
    at, n = 0, len(data)
    while at < n:
        codes: list[int] = []
        table: dict[int, int] = {}
        get, emit = table.get, codes.append
        new, full = (end + 1) << 8, 4096 << 8
        samples = iter(data[at:] if at else data)
        prefix = next(samples) << 8
        for b in samples:
            k = prefix | b
            if c := get(k):
                prefix = c
            else:
                emit(prefix)
                table[k] = new
                prefix = b << 8
                new += 256
                if new == full:
                    break
        else:
            emit(prefix)
            segments.append(codes + [end << 8])
            break
        segments.append(codes + [clear << 8])
        at = n - 1 - length_hint(samples)
    else:
        segments.append([end << 8])
    widths = np.concatenate([[bits + 1], *(_WIDTHS[bits][: len(s)] for s in segments)])
    values = np.concatenate([[clear], *(np.array(s) >> 8 for s in segments)])
    wide = (values[:, None] >> np.arange(12)) & 1
    return np.packbits(wide[np.arange(12) < widths[:, None]].astype(np.uint8), bitorder="little").tobytes()


def lzw_decode(data: bytes, bits: int, most: int) -> bytes:
    """At most `most` samples; a broken stream gives those before the break."""
    clear, end = 1 << bits, (1 << bits) + 1
    raw = np.frombuffer(data + bytes(4), np.uint8).astype(np.int64)
    total, at, widths = 8 * len(data), 0, _WIDTHS[bits]
    singles = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    size = 0
    table, prev, place = singles.copy(), b"", 0
    while size < most:
        # Up to 4096 codes from here; those after a clear code are read again with their right widths.
        w = widths[np.minimum(_INDEX[place : place + 4096], 8191)] if place < 4096 else np.full(4096, 12)
        off = at + np.cumsum(w) - w
        n = int(np.searchsorted(off + w, total, side="right"))
        if n == 0:
            break
        off, w = off[:n], w[:n]
        byte = off >> 3
        codes = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (off & 7) & ((1 << w) - 1)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        m = int(stop[0]) if len(stop) else n
        plain = codes[:m].tolist()
        begun = len(out)
        try:
            if not prev and plain:
                prev = table[plain[0]]
                out.append(prev)
                plain = plain[1:]
            room = 4096 - len(table)
            for c in plain[:room]:
                if c < len(table):
                    s = table[c]
                    table.append(prev + s[:1])
                else:
                    table.append(prev + prev[:1])
                    s = table[c]
                out.append(s)
                prev = s
            for c in plain[room:]:
                out.append(table[c])
        except IndexError:
            return b"".join(out)[:most]
        size += sum(map(len, out[begun:]))
        if m < n:
            if codes[m] == end:
                break
            at = int(off[m] + w[m])
            table, prev, place = singles.copy(), b"", 0
        else:
            at = int(off[-1] + w[-1])
            place += m
    return b"".join(out)[:most]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode_gif(frames: list[np.ndarray], palette: bytes, delay_cs: int = 10, disposal: int = 1, transparent: int | None = None) -> bytes:
    """Frames of 8-bit palette indices, all at the top left of a canvas that holds the largest; 256 colours."""
    width, height = max(f.shape[1] for f in frames), max(f.shape[0] for f in frames)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette]
    for f in frames:
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (transparent is not None), delay_cs, transparent or 0, 0))
        out.append(struct.pack("<BHHHHB", 0x2C, 0, 0, f.shape[1], f.shape[0], 0) + b"\x08" + _blocks(lzw_encode(f.tobytes())))
    return b"".join(out) + b"\x3b"


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay_cs: int
    disposal: int
    transparent: int | None
    indices: np.ndarray
    canvas: np.ndarray  # height x width x 4, RGBA, composed


def decode_gif(data: bytes) -> list[Frame]:
    return list(frames_of(data))


def frames_of(data: bytes) -> Iterator[Frame]:
    """Frames in order of time, one at a time."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("no GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at = 13
    shared = None
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        shared, at = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, transparent = 0, 0, None

    def gather(at: int) -> tuple[bytes, int]:
        some = []
        while at < len(data) and (n := data[at]):
            some.append(data[at + 1 : at + 1 + n])
            at += 1 + n
        return b"".join(some), at + 1

    while at < len(data):
        mark = data[at]
        if mark == 0x3B:
            break
        if mark == 0x21:
            kind = data[at + 1]
            body, at = gather(at + 2)
            if kind == 0xF9 and len(body) >= 4:
                bits, delay, index = struct.unpack_from("<BHB", body)
                disposal, transparent = bits >> 2 & 7, index if bits & 1 else None
            continue
        if mark != 0x2C:
            raise ValueError(f"unknown block {mark:#x}")
        left, top, w, h, bits = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        palette = shared
        if bits & 0x80:
            n = 3 << ((bits & 7) + 1)
            palette, at = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n
        if palette is None:
            raise ValueError("no palette")
        least = data[at]
        if not 2 <= least <= 8:
            raise ValueError(f"code size {least}")
        body, at = gather(at + 1)
        flat = lzw_decode(body, least, w * h)
        indices = np.frombuffer(flat.ljust(w * h, b"\0"), np.uint8).reshape(h, w)
        if bits & 0x40:
            rows = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight = np.empty_like(indices)
            straight[rows] = indices
            indices = straight
        before = canvas.copy() if disposal == 3 else None
        hh, ww = max(0, min(h, height - top)), max(0, min(w, width - left))
        seen = indices[:hh, :ww]
        colours = np.empty((hh, ww, 4), np.uint8)
        colours[..., :3] = palette[np.minimum(seen, len(palette) - 1)]
        colours[..., 3] = 255
        area = canvas[top : top + hh, left : left + ww]
        if transparent is None:
            area[...] = colours
        else:
            drawn = seen != transparent
            area[drawn] = colours[drawn]
        yield Frame(left, top, w, h, delay, disposal, transparent, indices, canvas.copy())
        if disposal == 2:
            area[...] = 0
        elif disposal == 3:
            canvas = before
        delay, disposal, transparent = 0, 0, None


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Pixels in each of 64 colours: two bits of red, green and blue; unseen pixels do not count."""
    seen = canvas[canvas[..., 3] > 0]
    code = (seen[:, 0] >> 6).astype(np.int64) << 4 | (seen[:, 1] >> 6).astype(np.int64) << 2 | seen[:, 2] >> 6
    return np.bincount(code, minlength=64)


FRAMES = "id long, frame int, start_ms long, delay_ms long, left int, top int, width int, height int, disposal int, canvas_width int, canvas_height int, rgba binary, histogram array<long>, error string"


def gif_frames(spark: SparkSession, media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """A row for each frame, with its time, its composed canvas and its colour histogram."""
    C.arrow_limits(spark)
    names = [x.split()[0] for x in FRAMES.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.int32()] * 7, pa.binary(), pa.list_(pa.int64()), pa.string()]

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if (raw := blob.as_py()) is None:
                    continue
                rows, time = [], 0
                try:
                    for k, f in enumerate(frames_of(raw)):
                        h, w = f.canvas.shape[:2]
                        rows.append([i, k, time, 10 * f.delay_cs, f.left, f.top, f.width, f.height, f.disposal, w, h, f.canvas.tobytes(), histogram(f.canvas).tolist(), None])
                        time += 10 * f.delay_cs
                except (ValueError, IndexError, struct.error) as e:
                    rows = [[i, *[None] * 12, str(e)]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return media.select(F.col(id_col).cast("long"), F.col(media_col).cast("binary")).mapInArrow(frames, FRAMES)


#: Grey palette: sample and colour are the same number.
GREYS = bytes(x for i in range(256) for x in (i, i, i))
#: A colour for each sample: three bits of red, three of green, two of blue, in the upper bits; the others tell no samples apart.
COLOURS = bytes(x for i in range(256) for x in (i & 0xE0, (i << 3) & 0xE0, (i << 6) & 0xC0))
#: A byte that UTF-8 never has marks samples that the frame before shows already.
SEEN = 0xFF


def payload_to_gif(payload: bytes) -> bytes:
    """Samples as rows of colours, some rows a frame. Where a frame shows what is there already it is transparent. Payloads
    with the mark among their samples are stored without transparency."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    frames = [samples[i : i + ROWS] for i in range(0, len(samples), ROWS)]
    if len(frames) == 1 or SEEN in payload:
        return encode_gif(frames, COLOURS)
    shown = [frames[0]] + [np.where(f == before[: len(f)], np.uint8(SEEN), f) for before, f in zip(frames, frames[1:], strict=False)]
    return encode_gif(shown, COLOURS, transparent=SEEN)


def _samples(f: Frame) -> np.ndarray:
    """The samples whose colours a frame shows, composed over the frames before."""
    rgb = f.canvas[f.top : f.top + f.height, f.left : f.left + f.width]
    return (rgb[..., 0] & 0xE0) | (rgb[..., 1] & 0xE0) >> 3 | rgb[..., 2] >> 6


def gif_to_payload(frames: Iterable[Frame]) -> bytes:
    return b"".join(_samples(f).tobytes() for f in frames)


def text_media(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as GIF media: doc_id, n_bytes, media (binary). A null text is an empty one."""
    C.arrow_limits(spark)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in C.parts(batch.column(1), 1 << 20):
                texts = [(x.as_py() or "").encode() for x in batch.column(1).slice(a, b - a)]
                media = [payload_to_gif(x + bytes(-len(x) % WIDTH if x else WIDTH)) for x in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(make, "doc_id long, n_bytes long, media binary")


def media_digest(spark: SparkSession, media: DataFrame) -> DataFrame:
    """From the stored bytes: sizes, digests and the colour histogram of all frames, one row a medium."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames int, duration_ms long, feature string"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = blob.as_py()
                size, time, count, sha, tail, colours = 0, 0, 0, hashlib.sha256(), b"", np.zeros(64, np.int64)
                for f in frames_of(raw):
                    payload = _samples(f).tobytes()
                    size, time, count, tail = size + len(payload), time + 10 * f.delay_cs, count + 1, payload[-WIDTH:]
                    sha.update(payload)
                    colours += histogram(f.canvas[f.top : f.top + f.height])
                feature = " ".join(f"{k}:{v}" for k, v in enumerate(colours.tolist()) if v)
                rows.append((i, n, size, sha.hexdigest(), zlib.crc32(tail), len(raw), hashlib.sha256(raw).hexdigest(), count, time, feature))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return media.mapInArrow(digest, schema)
