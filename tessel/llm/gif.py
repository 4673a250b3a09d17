"""GIF media columns: texts' bytes as animated pictures, and pictures back as frames.

The writer stores a payload as 8-bit samples, 192 to a row, in frames of at most 128 rows, each LZW-coded, under a grey
palette.  The reader is a full one: logical screen, global and local palettes, interlacing, LZW with growing codes and
deferred clears, graphic control (delay, disposal to background or previous, transparency), extensions and trailer.

Nulls: a null text is an empty payload (one row of spaces); a null or broken file gives null frames and its fault in
``error``.  Very long texts are stored whole, in as many frames as they take.  Repeated rows give equal files; an empty table an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTH = 192
ROWS = 128
BINS = 16


class Broken(ValueError):
    """The file isn't a GIF that can be read."""


# ---------------------------------------------------------------------------------------------------------------- LZW


def _widths(least: int) -> np.ndarray:
    """Bits of each code after a clear, in order: the code size grows as the table does, up to 12 bits.

    When the k-th code after a clear (from 0) is read, k - 1 entries have been added, so the next free place is
    clear + 2 + (k - 1); one that fills the present size makes the following codes wider.
    """
    k = np.arange(0, 1 << 13)
    free = (1 << least) + 2 + np.maximum(k - 1, 0)
    width = np.full(len(k), least + 1)
    for bits in range(least + 1, 12):
        width[free >= (1 << bits)] = bits + 1
    return width


_WIDTHS = {n: _widths(n) for n in range(2, 12)}


def _code_list(data: bytes) -> tuple[list[int], list[int]]:
    """Codes of 8-bit samples, and where in the list each clear stands."""
    clear, end, most = 256, 257, 4096
    codes, clears = [clear], [0]
    table: dict[int, int] = {}
    find, free, add = table.get, 258, codes.append
    if data:
        prefix = data[0]
        for sample in data[1:]:
            key = prefix << 8 | sample
            known = find(key)
            if known is not None:
                prefix = known
                continue
            add(prefix)
            if free < most:
                table[key] = free
                free += 1
            else:
                clears.append(len(codes))
                add(clear)
                table.clear()
                free = 258
            prefix = sample
        add(prefix)
    add(end)
    return codes, clears


def lzw_encode(data: bytes) -> bytes:
    """The code stream of 8-bit samples."""
    codes, clears = _code_list(data)
    values = np.array(codes, np.uint16)
    width = np.empty(len(codes), np.int64)
    steps = _WIDTHS[8]
    last = 9
    for begin, stop in zip(clears, [*clears[1:], len(codes)], strict=True):
        width[begin] = last  # the clear itself still has the old size
        n = stop - begin - 1
        width[begin + 1 : stop] = steps[:n]
        last = int(steps[n])
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 2), axis=1, count=12, bitorder="little")
    return np.packbits(bits[_BITS < width[:, None]], bitorder="little").tobytes()


_BITS = np.arange(12)
_FULL = np.full(1 << 13, 12)


def lzw_decode(stream: bytes, least: int, most: int) -> bytes:
    """At most ``most`` samples of a code stream."""
    if not 2 <= least <= 11:
        raise Broken(f"code size {least}")
    clear, end = 1 << least, (1 << least) + 1
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int32)
    words = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    total = 8 * len(stream)
    parts: list[bytes] = []
    table = fresh = [bytes([x]) if x < 256 else b"" for x in range(clear)] + [b"", b""]
    made, place, steps, ends = 0, 0, _WIDTHS[least], _ENDS[least]
    while made < most:
        # Codes from here to the next clear have sizes that are known beforehand.
        room = int(np.searchsorted(ends, total - place, "right"))
        if not room:
            break
        at = place + ends[:room] - steps[:room]
        values = (words[at >> 3] >> (at & 7)) & ((1 << steps[:room]) - 1)
        stops = np.flatnonzero((values == clear) | (values == end))
        n = int(stops[0]) if len(stops) else room
        if table is fresh:
            table = fresh.copy()
        before = len(parts)
        _expand(values[:n].tolist(), clear, table, parts)
        made += sum(map(len, parts[before:]))
        if len(stops):
            if values[n] == end:
                break
            place += int(ends[n])
            table, steps, ends = fresh, _WIDTHS[least], _ENDS[least]
        elif room == len(steps):  # a full table that isn't cleared yet: 12 bits from here on
            place += int(ends[-1])
            steps, ends = _FULL, _ENDS[0]
        else:
            break
    return b"".join(parts)[:most]


_ENDS = {n: np.cumsum(w) for n, w in _WIDTHS.items()} | {0: np.cumsum(_FULL)}


def _expand(codes: list[int], clear: int, table: list[bytes], parts: list[bytes]) -> None:
    """Appends the strings of codes; the table grows by one entry a code (those beyond 4096 can't be named)."""
    if not codes:
        return
    codes = iter(codes)
    if len(table) == clear + 2:
        first = next(codes)
        if first >= clear:
            raise Broken(f"code {first} before its entry")
        parts.append(table[first])
    n, last = len(table), parts[-1]
    add, put = table.append, parts.append
    for code in codes:
        if code < n:
            found = table[code]
            add(last + found[:1])
        elif code == n:
            found = last + last[:1]
            add(found)
        else:
            raise Broken(f"code {code} before its entry")
        n += 1
        put(found)
        last = found


# ------------------------------------------------------------------------------------------------------------- writer


def _blocks(data: bytes) -> bytes:
    out = bytearray()
    for k in range(0, len(data), 255):
        part = data[k : k + 255]
        out.append(len(part))
        out += part
    out.append(0)
    return bytes(out)


_GREYS = bytes(np.repeat(np.arange(256, dtype=np.uint8), 3))


def padded(payload: bytes, unit: int = WIDTH) -> bytes:
    """Spaces up to a positive multiple of the unit."""
    return payload + b" " * (-len(payload) % unit if payload else unit)


def write_gif(payload: bytes, delay: int = 10) -> bytes:
    """A payload of a positive multiple of WIDTH samples as an animation; delay in hundredths of a second."""
    rows = len(payload) // WIDTH
    head = b"GIF89a" + struct.pack("<HHBBB", WIDTH, min(rows, ROWS), 0xF7, 0, 0) + _GREYS
    out = [head, b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00"]
    for top in range(0, rows, ROWS):
        n = min(ROWS, rows - top)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, delay, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, n, 0) + b"\x08")
        out.append(_blocks(lzw_encode(payload[top * WIDTH : (top + n) * WIDTH])))
    return b"".join([*out, b";"])


# ------------------------------------------------------------------------------------------------------------- reader


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(data):
            raise Broken("cut off in a block")
        n = data[at]
        if not n:
            return b"".join(parts), at + 1
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 2 << (flags & 7)
    if at + 3 * n > len(data):
        raise Broken("cut off in a palette")
    return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n


def _interlaced(height: int) -> np.ndarray:
    return np.concatenate([np.arange(0, height, 8), np.arange(4, height, 8), np.arange(2, height, 4), np.arange(1, height, 2)])


def read_gif(data: bytes) -> Iterator[dict]:
    """Frames in order: index, time and delay in milliseconds, place and size, disposal, the canvas as it is then shown
    (height, width, RGBA) and the frame's own region of it."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise Broken("no GIF header")
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    at, shared = 13, None
    if flags & 0x80:
        shared, at = _palette(data, at, flags)
    canvas = np.zeros((height, width, 4), np.uint8)  # the background shows as transparent, as viewers do it
    index = time = 0
    delay, disposal, clear = 0, 0, None
    while at < len(data):
        kind = data[at]
        at += 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at] if at < len(data) else 0
            body, at = _sub_blocks(data, at + 1)
            if label == 0xF9 and len(body) >= 4:
                packed, delay, transparent = struct.unpack_from("<BHB", body)
                disposal, clear = packed >> 2 & 7, transparent if packed & 1 else None
        elif kind == 0x2C:
            if at + 10 > len(data):
                raise Broken("cut off in a frame")
            left, top, w, h, local = struct.unpack_from("<HHHHB", data, at)
            at += 9
            colours = shared
            if local & 0x80:
                colours, at = _palette(data, at, local)
            if colours is None:
                raise Broken("no palette")
            least = data[at]
            stream, at = _sub_blocks(data, at + 1)
            samples = np.frombuffer(lzw_decode(stream, least, w * h), np.uint8)
            if len(samples) < w * h:
                raise Broken("too few samples")
            samples = samples.reshape(h, w)
            if local & 0x40:
                put = np.empty_like(samples)
                put[_interlaced(h)] = samples
                samples = put
            before = canvas.copy() if disposal == 3 else None
            shown = samples[: max(0, height - top), : max(0, width - left)]
            region = canvas[top : top + shown.shape[0], left : left + shown.shape[1]]
            table = np.zeros((256, 4), np.uint8)
            table[: len(colours), :3], table[: len(colours), 3] = colours, 255
            fresh = table[shown]
            if clear is None:
                region[:] = fresh
            else:
                np.copyto(region, fresh, where=(shown != clear)[..., None])
            yield {"index": index, "time_ms": time, "delay_ms": 10 * delay, "left": left, "top": top, "width": w, "height": h, "disposal": disposal, "canvas": canvas, "region": region}
            index, time = index + 1, time + 10 * delay
            if disposal == 2:
                region[:] = 0
            elif disposal == 3:
                canvas[:] = before
            delay, disposal, clear = 0, 0, None
        else:
            raise Broken(f"block {kind:#x}")
    raise Broken("no trailer")


def histogram(pixels: np.ndarray) -> np.ndarray:
    """Counts of opaque pixels by BINS steps of red, of green and of blue."""
    shown = pixels.reshape(-1, 4)
    shown = shown[shown[:, 3] > 0]
    return np.concatenate([np.bincount(shown[:, c] >> 4, minlength=BINS) for c in range(3)]) if len(shown) else np.zeros(3 * BINS, np.int64)


# ---------------------------------------------------------------------------------------------------------- operators

MEDIA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])


def text_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", slice_rows: int = 128) -> DataFrame:
    """doc_id, n_bytes of the text and media, the GIF that holds its padded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, slice_rows):
                batch = whole.slice(k, slice_rows)
                raw = batch.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([write_gif(padded(x)) for x in raw], pa.binary())], names=MEDIA.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")).mapInArrow(run, MEDIA)


FRAME = "index int, time_ms long, delay_ms long, left int, top int, width int, height int, disposal int, histogram array<long>, own array<long>"


def decoded_frames(media: DataFrame, *, media_col: str = "media", samples: bool = True, slice_rows: int = 64) -> DataFrame:
    """Adds frames (timed, each with the colour histograms of what is shown then and of its own region), payload (the red samples of the frames'
    own regions in order, if ``samples``) and error; the columns of the input are carried, but for these names."""
    carried = [c for c in media.columns if c not in ("frames", "payload", "error")]
    rows = media.select(*[F.col(f"`{c}`") for c in carried])
    extra = T.StructType.fromDDL(f"frames array<struct<{', '.join(x.replace(' ', ':', 1) for x in FRAME.split(', '))}>>, payload binary, error string")
    schema = T.StructType([*rows.schema.fields, *extra.fields])
    place = carried.index(media_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in extra.fields]
        for whole in batches:
            for k in range(0, whole.num_rows, slice_rows):
                batch = whole.slice(k, slice_rows)
                frames, payloads, errors = [], [], []
                for data in batch.column(place).to_pylist():
                    own, parts = [], []
                    try:
                        if data is None:
                            raise Broken("null")
                        for f in read_gif(data):
                            shown = histogram(f["canvas"]).tolist()
                            region = shown if f["region"].shape == f["canvas"].shape else histogram(f["region"]).tolist()
                            own.append({n: f[n] for n in ("index", "time_ms", "delay_ms", "left", "top", "width", "height", "disposal")} | {"histogram": shown, "own": region})
                            if samples:
                                parts.append(f["region"][..., 0].tobytes())
                        errors.append(None)
                    except (Broken, struct.error, IndexError) as fault:
                        own, parts = None, None
                        errors.append(str(fault))
                    frames.append(own)
                    payloads.append(b"".join(parts) if samples and parts is not None else None)
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, t) for v, t in zip((frames, payloads, errors), kinds, strict=True))], names=schema.names)

    return rows.mapInArrow(run, schema)
