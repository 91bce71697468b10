"""GIF media columns: writing payloads as GIF, decoding frames, and colour histograms.

The LZW codes of an image are cut out of the bit stream in whole blocks (up to the next clear
code), since the width of a code depends on its place in its block only. Frames are drawn on
the canvas by the file's palettes, transparency and disposal rules.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenumlens.llm.tables import settled, small_batches, text_bytes

#: Samples of a row, and rows of a frame: a payload is cut into frames of 64 KiB.
WIDTH, FRAME_ROWS = 64, 1024
#: Hundredths of a second that a written frame stays.
DELAY = 10
TABLE = 4096
#: Canvas pixels that a decoder agrees to, so that a forged header cannot exhaust a task.
MOST_PIXELS = 1 << 26



class PictureTooLarge(ValueError):
    """A picture whose canvas or frame has more than MOST_PIXELS pixels; it is not decoded."""


FRAME = "array<struct<frame:int,start_cs:long,delay_cs:int,left:int,top:int,width:int,height:int,histogram:array<long>>>"


def default_palette() -> np.ndarray:
    """256 different colours: three bits of red, three of green, two of blue."""
    i = np.arange(256)
    return np.stack([(i >> 5) * 36, (i >> 2 & 7) * 36, (i & 3) * 85], 1).astype(np.uint8)


@lru_cache(maxsize=16)
def _widths(low_bits: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Width and bit offset of each code after a clear code, for palettes of ``low_bits`` bits."""
    free = (1 << low_bits) + 2 + np.maximum(np.arange(n) - 1, 0)
    width = np.clip(np.floor(np.log2(free)).astype(np.int64) + 1, low_bits + 1, 12)
    return width, np.cumsum(width) - width


def lzw_pack(samples: bytes, low_bits: int = 8) -> bytes:
    """The LZW stream of samples below ``2 ** low_bits``; the table is cleared when it is full."""
    clear, end = 1 << low_bits, (1 << low_bits) + 1
    codes, table, free = [clear], {}, end + 1
    put, get = codes.append, table.get
    source = iter(samples)
    prefix = next(source, None)
    if prefix is not None:
        for sample in source:
            key = prefix << 8 | sample
            code = get(key)
            if code is not None:
                prefix = code
                continue
            put(prefix)
            if free < TABLE:
                table[key] = free
                free += 1
            else:
                put(clear)
                table.clear()
                free = end + 1
            prefix = sample
        put(prefix)
    put(end)
    values = np.array(codes, np.int64)
    cleared = np.flatnonzero(values == clear)
    # a code's place in its block; a clear code itself is the last of the block before
    place = np.arange(len(values)) - 1 - np.concatenate(([-1], np.repeat(cleared, np.diff(np.append(cleared, len(values) - 1)))))
    width = _widths(low_bits, TABLE + 2)[0][np.maximum(place, 0)]
    bits = (values[:, None] >> np.arange(12) & 1).astype(np.uint8)
    return np.packbits(bits[np.arange(12) < width[:, None]], bitorder="little").tobytes()


def lzw_unpack(stream: bytes, low_bits: int, most: int) -> bytes:
    """The samples of an LZW stream, ``most`` at most; a damaged stream gives what comes before the damage."""
    clear, end = 1 << low_bits, (1 << low_bits) + 1
    total = len(stream) * 8
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.uint32)
    singles = [bytes([i]) for i in range(clear)] + [b"", b""]
    out, size, at, ended = [], 0, 0, False
    while not ended and at < total and size < most:
        span = min(TABLE, max(16, (total - at) // (low_bits + 1) + 1))
        codes, stop = [], None
        while stop is None and at < total:  # a block may go on with a full table
            done = len(codes)
            width, offset = _widths(low_bits, TABLE + 2) if not done else (np.full(span, 12), 12 * np.arange(span))
            width, offset = width[:span], offset[:span]
            where = at + offset
            n = int(np.searchsorted(where + width, total, "right"))
            if not n:
                at = total
                break
            where, width = where[:n], width[:n]
            byte = where >> 3
            value = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (where & 7).astype(np.uint32) & ((1 << width) - 1).astype(np.uint32)
            special = np.flatnonzero((value == clear) | (value == end))
            if len(special):
                stop = int(special[0])
                ended = int(value[stop]) == end
                at = int(where[stop] + width[stop])
                codes += value[:stop].tolist()
            else:
                at = int(where[-1] + width[-1])
                codes += value.tolist()
        if not codes:
            continue
        if codes[0] >= clear:
            break
        table = singles.copy()
        free = end + 1
        last = table[codes[0]]
        got = [last]
        put, grow = got.append, table.append
        for code in codes[1:]:
            if code < free:
                entry = table[code]
            elif code == free and free < TABLE:
                entry = last + last[:1]
            else:
                ended = True
                break
            put(entry)
            if free < TABLE:
                grow(last + entry[:1])
                free += 1
            last = entry
        out.append(b"".join(got))
        size += len(out[-1])
    return b"".join(out)[:most]


def _chunks(data: bytes) -> bytes:
    parts = (data[i:i + 255] for i in range(0, len(data), 255))
    return b"".join(bytes([len(p)]) + p for p in parts) + b"\0"


def write_gif(samples: bytes, width: int = WIDTH, rows: int = FRAME_ROWS, delay: int = DELAY) -> bytes:
    """A GIF whose frames hold the samples (a multiple of ``width``), ``rows`` rows in each but the last."""
    step = width * rows
    frames = [samples[i:i + step] for i in range(0, len(samples), step)]
    tall = max((len(f) // width for f in frames), default=1)
    out = [b"GIF89a", struct.pack("<HHBBB", width, tall, 0xF7, 0, 0), default_palette().tobytes()]
    for frame in frames:
        out += [b"\x21\xf9\x04\x04", struct.pack("<HBB", delay, 0, 0), b"\x2c",
                struct.pack("<HHHHB", 0, 0, width, len(frame) // width, 0), b"\x08", _chunks(lzw_pack(frame))]
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    """One drawn frame. ``samples`` are the file's palette numbers; ``canvas`` is packed RGBA after drawing."""

    delay: int
    left: int
    top: int
    samples: np.ndarray
    canvas: np.ndarray


def _packed(palette: bytes) -> np.ndarray:
    rgb = np.zeros((256, 3), np.uint32)
    known = np.frombuffer(palette, np.uint8).reshape(-1, 3)
    rgb[: len(known)] = known
    return rgb[:, 0] | rgb[:, 1] << 8 | rgb[:, 2] << 16 | np.uint32(0xFF000000)


def _rows(height: int) -> np.ndarray:
    """The file's order of the rows of an interlaced image."""
    return np.concatenate([np.arange(first, height, step) for first, step in ((0, 8), (4, 8), (2, 4), (1, 2))])


def read_gif(data: bytes) -> Iterator[Frame]:
    """The frames in order. What isn't a GIF gives none; a file that breaks off gives those before the break.

    A picture beyond MOST_PIXELS is an error, not one without frames.
    """
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        return
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    if width * height > MOST_PIXELS:
        raise PictureTooLarge(f"a canvas of {width} x {height} pixels")
    at, colours = 13, _packed(b"")
    if flags & 0x80:
        size = 3 << (flags & 7) + 1
        colours = _packed(data[at:at + size - size % 3])
        at += size
    canvas = np.zeros((height, width), np.uint32)
    delay, disposal, clear_colour = 0, 0, None

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while at < len(data) and data[at]:
            parts.append(data[at + 1:at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(parts), at + 1

    while at < len(data):
        kind = data[at]
        if kind == 0x21 and at + 1 < len(data):
            label = data[at + 1]
            body, at = blocks(at + 2)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, body[1] | body[2] << 8
                clear_colour = body[3] if body[0] & 1 else None
        elif kind == 0x2C and at + 11 <= len(data):
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            own = colours
            if flags & 0x80:
                size = 3 << (flags & 7) + 1
                own = _packed(data[at:at + size - size % 3])
                at += size
            if at >= len(data) or not 1 <= data[at] <= 8:
                return
            if w * h > MOST_PIXELS:
                raise PictureTooLarge(f"a frame of {w} x {h} pixels")
            low_bits = data[at]
            stream, at = blocks(at + 1)
            got = np.frombuffer(lzw_unpack(stream, low_bits, w * h), np.uint8)
            full = len(got) == w * h
            if not full and not len(got):
                return
            samples = np.zeros(w * h, np.uint8)
            samples[: len(got)] = got
            samples = samples.reshape(h, w)
            if flags & 0x40:
                straight = np.empty_like(samples)
                straight[_rows(h)] = samples
                samples = straight
            before = canvas.copy() if disposal == 3 else None
            seen = samples[: max(0, height - top), : max(0, width - left)]
            area = canvas[top:top + seen.shape[0], left:left + seen.shape[1]]
            if clear_colour is None:
                area[...] = own[seen]
            else:
                np.copyto(area, own[seen], where=seen != clear_colour)
            yield Frame(delay, left, top, samples, canvas)
            if disposal == 2:
                area[...] = 0
            elif disposal == 3:
                canvas = before
            delay, disposal, clear_colour = 0, 0, None
            if not full:
                return
        else:
            return


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Pixels by colour: two bits of red, green and blue each, then one count of clear pixels (65 numbers)."""
    opaque = canvas >> 24 != 0
    bins = (canvas >> 6 & 3) << 4 | (canvas >> 14 & 3) << 2 | canvas >> 22 & 3
    return np.bincount(np.where(opaque, bins, 64).ravel(), minlength=65)


def padded(text: bytes, unit: int = WIDTH) -> bytes:
    """The bytes with zeros up to a positive multiple of ``unit``."""
    return text + bytes(max(unit, -(-len(text) // unit) * unit) - len(text))


def with_media(docs: DataFrame, text: str = "text", into: str = "media") -> DataFrame:
    """Add the text's UTF-8 bytes, padded to rows of 64 samples, as a GIF in the column ``into``.

    Null and empty texts make one row of zeros, equal texts equal media; rows stay as they are
    and a column of that name is replaced.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("binary")
    def store(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in settled(texts):
            yield batch.map(lambda t: write_gif(padded(t)))

    return docs.withColumn(into, store(text_bytes(text)))


def with_frames(media: DataFrame, column: str = "media", into: str = "frames") -> DataFrame:
    """Add the timed frames of a media column, with their place, duration and colour histogram.

    Null and unreadable media have an empty list; a picture that is too large to decode has null.
    """
    @F.pandas_udf(FRAME)
    def frames(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in settled(batches):
            out = []
            for data in batch:
                rows, clock = [], 0
                try:
                    for i, f in enumerate(read_gif(data or b"")):
                        h, w = f.samples.shape
                        rows.append({"frame": i, "start_cs": clock, "delay_cs": f.delay, "left": f.left, "top": f.top, "width": w,
                                     "height": h, "histogram": histogram(f.canvas).tolist()})
                        clock += f.delay
                except PictureTooLarge:
                    rows = None
                out.append(rows)
            yield pd.Series(out)

    return media.withColumn(into, frames(F.col(column)))


PAYLOAD = "struct<payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,media_bytes:bigint,media_sha256:string,feature:string>"


def payload_facts(data: bytes | None) -> tuple:
    """What the samples of a stored GIF are, and the feature of its drawn frames."""
    data = data or b""
    digest, size, tail, clock, count, total = hashlib.sha256(), 0, b"", 0, 0, np.zeros(65, np.int64)
    for frame in read_gif(data):
        samples = frame.samples.tobytes()
        digest.update(samples)
        size += len(samples)
        tail = (tail + samples[-64:])[-64:]
        clock += frame.delay
        count += 1
        total += histogram(frame.canvas)
    feature = f"frames={count};cs={clock};colours=" + ",".join(f"{i}:{n}" for i, n in enumerate(total.tolist()) if n)
    return size, digest.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), feature


def with_payload(media: DataFrame, column: str = "media", into: str = "payload") -> DataFrame:
    """Add the facts of the samples read back from a media column; a picture that is too large to decode is an error."""
    @F.pandas_udf(PAYLOAD)
    def facts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in settled(batches):
            yield pd.DataFrame([payload_facts(d) for d in batch], columns=names)

    return media.withColumn(into, facts(F.col(column)))
