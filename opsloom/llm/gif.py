"""Media columns for GIF: LZW coding both ways, frames composed over time, colour histograms.

`write_gif` stores frames of palette indexes; `read_gif` decodes any GIF: global and local palettes,
frame rectangles, interlacing, the three disposal rules and transparency, giving the composed canvas
of each frame with its delay.

`store_texts` turns each text into a GIF of 8-bit samples over a grey palette: the text's UTF-8 bytes,
filled with spaces to a positive multiple of 192, in frames 192 wide. Null text counts as empty and
gives one row of spaces; repeated rows give equal media; an empty table gives an empty table. A text
is held by one task alone. Columns named like an output are replaced.

`media_columns` reads any media and never ends the job: where they are damaged, frames and samples are null and fault
says why. Media that are null or without bytes have no frames, no samples and no fault.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom.llm.common import read, row_slices

WIDTH = 192
FRAME_ROWS = 1024
DELAY_CS = 10
_FULL = 4096
_GREY = bytes(i for i in range(256) for _ in range(3))


#: Pixels that a canvas may have: what one task holds for a frame, at three bytes each.
MOST_PIXELS = 1 << 26


class Damaged(ValueError):
    """Media that can't be read as a GIF; says why."""


def _schedule(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths of the codes since a clear, and where each starts. When code k is read, the table has its
    first entries and one for each code from the second on; a code may also be the entry to come."""
    known = (1 << bits) + 2 + np.maximum(np.arange(_FULL) - 1, 0)
    width = np.full(_FULL, bits + 1, np.int64)
    for w in range(bits + 1, 12):
        width[known >= (1 << w)] = w + 1
    return width, np.concatenate([[0], np.cumsum(width)])


_SCHEDULES = {bits: _schedule(bits) for bits in range(2, 9)}
_BITS = np.arange(12, dtype=np.uint16)


def lzw_decode(data: bytes, bits: int, most: int) -> bytes:
    """Palette indexes of a GIF code stream, `most` of them at most."""
    clear, end = 1 << bits, (1 << bits) + 1
    width, begins = _SCHEDULES[bits]
    stream = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    left, at, since, made = 8 * len(data), 0, 0, 0
    start = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, last, out = start.copy(), b"", []
    while made < most:
        # codes up to the next clear or end all have the widths of the schedule; a full table stays at 12 bits
        if since < _FULL:
            widths, begun = width[since:], begins[since:-1] - begins[since]
        else:
            widths, begun = np.full(_FULL, 12), np.arange(_FULL) * 12
        n = int(np.searchsorted(begun, left - at, "left"))
        n -= bool(n) and int(begun[n - 1] + widths[n - 1]) > left - at
        if not n:
            break
        bit = at + begun[:n]
        byte = bit >> 3
        three = stream[byte] | stream[byte + 1] << 8 | stream[byte + 2] << 16
        codes = three >> (bit & 7).astype(np.uint32) & ((1 << widths[:n]) - 1).astype(np.uint32)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if stops.size else n
        run, seen = codes[:stop].tolist(), len(out)
        add, put, size = table.append, out.append, len(table)
        if run and not last:
            if run[0] >= size:
                raise Damaged("code without an entry")
            last = table[run[0]]
            put(last)
            run = run[1:]
        room = _FULL - size
        for code in run[:room]:
            if code < size:
                entry = table[code]
            elif code == size:
                entry = last + last[:1]
            else:
                raise Damaged("code without an entry")
            add(last + entry[:1])
            size += 1
            put(entry)
            last = entry
        for code in run[room:]:
            last = table[code]
            put(last)
        made += sum(map(len, out[seen:]))
        if stop == n:
            at, since = at + int(begun[n - 1] + widths[n - 1]), since + n
        elif codes[stop] == end:
            break
        else:
            at, since = at + int(begun[stop] + widths[stop]), 0
            table, last = start.copy(), b""
    return b"".join(out)[:most]


def lzw_encode(indexes: bytes, bits: int = 8) -> bytes:
    """A GIF code stream; its table is cleared whenever it is full."""
    clear, end = 1 << bits, (1 << bits) + 1
    width, _ = _SCHEDULES[bits]
    codes, widths = [clear], [width[:1]]
    rest = iter(indexes)
    prefix = next(rest, None)
    while prefix is not None:
        table: dict[int, int] = {}
        run: list[int] = []
        find, put, entry = table.get, run.append, end + 1
        for byte in rest:
            key = prefix << 8 | byte
            code = find(key)
            if code is not None:
                prefix = code
                continue
            put(prefix)
            table[key] = entry
            entry += 1
            prefix = byte
            if entry == _FULL:
                break
        else:
            put(prefix)
            prefix = None
        put(end if prefix is None else clear)
        codes += run
        widths.append(width[: len(run)])
    if len(codes) == 1:
        codes.append(end)
        widths.append(width[:1])
    each, wide = np.array(codes, np.uint16)[:, None], np.concatenate(widths)[:, None]
    return np.packbits((each >> _BITS & 1).astype(np.uint8)[_BITS < wide], bitorder="little").tobytes()


@dataclass
class Frame:
    """A composed canvas (rows, columns, RGB) and what the frame itself covers and says."""

    canvas: np.ndarray
    left: int
    top: int
    width: int
    height: int
    delay_cs: int
    disposal: int

    def histogram(self) -> np.ndarray:
        """Pixels of the canvas by colour, four levels for each of red, green and blue."""
        level = self.canvas.reshape(-1, 3) >> 6
        return np.bincount(level[:, 0] * 16 + level[:, 1] * 4 + level[:, 2], minlength=64)


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def write_gif(frames: list[np.ndarray], palette: bytes = _GREY, delay_cs: int = DELAY_CS) -> bytes:
    """Frames are arrays (rows, columns) of indexes into a palette of 256 colours, set at the top left."""
    height, wide = max(f.shape[0] for f in frames), max(f.shape[1] for f in frames)
    out = [b"GIF89a", struct.pack("<HHBBB", wide, height, 0xF7, 0, 0), palette]
    for f in frames:
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, delay_cs, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, f.shape[1], f.shape[0], 0) + b"\x08" + _blocks(lzw_encode(f.tobytes())))
    return b"".join([*out, b"\x3b"])


def _rows_of(height: int) -> np.ndarray:
    """The order in which an interlaced frame has its rows."""
    return np.concatenate([np.arange(a, height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


def read_gif(data: bytes, most_pixels: int = MOST_PIXELS) -> Iterator[Frame]:
    """Composed frames, in order. A frame is what is seen before its own disposal. Raises Damaged where the data end
    too early, name what isn't there, or say a canvas or frame of more pixels than given."""
    try:
        yield from _frames(data, most_pixels)
    except (IndexError, struct.error) as gone:
        raise Damaged("cut off") from gone


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    """The palette at a place, and where it ends."""
    n = 3 << (flags & 7) + 1
    if at + n > len(data):
        raise Damaged("cut off")
    return np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n


def _frames(data: bytes, most_pixels: int) -> Iterator[Frame]:
    if data[:3] != b"GIF":
        raise Damaged("not a GIF")
    wide, high, flags = struct.unpack_from("<HHB", data, 6)
    if wide * high > most_pixels:
        raise Damaged("too many pixels")
    at, shared = 13, None
    if flags & 0x80:
        shared, at = _palette(data, at, flags)

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while n := data[at]:
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n
            if at > len(data):
                raise Damaged("cut off")
        return b"".join(parts), at + 1

    canvas = np.zeros((high, wide, 3), np.uint8)
    disposal, clear, delay = 0, None, 0
    while data[at] != 0x3B:
        if data[at] == 0x21:
            kind, (body, at) = data[at + 1], blocks(at + 2)
            if kind == 0xF9:
                said, delay, index = struct.unpack_from("<BHB", body)
                disposal, clear = said >> 2 & 7, index if said & 1 else None
            continue
        if data[at] != 0x2C:
            raise Damaged("unknown block")
        left, top, w, h, own = struct.unpack_from("<HHHHB", data, at + 1)
        at, palette = at + 10, shared
        if own & 0x80:
            palette, at = _palette(data, at, own)
        bits = data[at]
        body, at = blocks(at + 1)
        if palette is None:
            raise Damaged("no palette")
        if bits not in _SCHEDULES:
            raise Damaged("unknown code size")
        if w * h > most_pixels:
            raise Damaged("too many pixels")
        indexes = np.frombuffer(lzw_decode(body, bits, w * h), np.uint8)
        if indexes.size < w * h:
            raise Damaged("samples missing")
        indexes = indexes.reshape(h, w)
        if own & 0x40:
            order = _rows_of(h)
            indexes = indexes[np.argsort(order)]
        before = canvas.copy() if disposal == 3 else None
        part = canvas[top : top + h, left : left + w]
        seen = indexes[: part.shape[0], : part.shape[1]]
        colours = palette[np.minimum(seen, len(palette) - 1)]
        part[...] = colours if clear is None else np.where((seen == clear)[..., None], part, colours)
        yield Frame(canvas.copy(), left, top, w, h, delay, disposal)
        if disposal == 2:
            part[...] = 0
        elif disposal == 3:
            canvas = before
        disposal, clear, delay = 0, None, 0


def payload_frames(text: str) -> tuple[int, list[np.ndarray]]:
    """Bytes of the text, and these with filling as frames."""
    raw = text.encode()
    filled = raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH)
    rows = np.frombuffer(filled, np.uint8).reshape(-1, WIDTH)
    return len(raw), [rows[i : i + FRAME_ROWS] for i in range(0, len(rows), FRAME_ROWS)]


def _schema(df: DataFrame, *fields: T.StructField) -> T.StructType:
    made = {f.name.lower() for f in fields}
    return T.StructType([f for f in df.schema.fields if f.name.lower() not in made] + list(fields))


def store_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace text by n_bytes (long) and media (binary), the GIF that holds it."""
    schema = _schema(docs.drop(text), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType()))
    keep = schema.names[:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_slices(whole, text):
                made = [payload_frames(t or "") for t in batch.column(text).to_pylist()]
                columns = [pa.array([n for n, _ in made], pa.int64()), pa.array([write_gif(f) for _, f in made], pa.binary())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], schema.names)

    return docs.mapInArrow(run, schema)


_FRAME = T.StructType(
    [T.StructField(n, T.IntegerType()) for n in ("left", "top", "width", "height", "delay_cs", "disposal", "shown_cs")]
    + [T.StructField("histogram", T.ArrayType(T.LongType()))]
)


def media_columns(stored: DataFrame, media: str = "media") -> DataFrame:
    """Add frames (array of structs: rectangle, delay, disposal, time shown at, 64 colour counts),
    samples (binary): the red of each frame's own rectangle as it is seen, frame after frame, and
    fault (string): why damaged media have neither; null for whole ones."""
    schema = _schema(stored, T.StructField("frames", T.ArrayType(_FRAME)), T.StructField("samples", T.BinaryType()), T.StructField("fault", T.StringType()))
    keep = schema.names[:-3]
    arrow = pa.list_(pa.struct([(f.name, pa.list_(pa.int64()) if f.name == "histogram" else pa.int32()) for f in _FRAME.fields]))

    def decoded(data: bytes | None) -> tuple[list[dict] | None, bytes | None, str | None]:
        frames, samples, now = [], [], 0
        try:
            for f in read_gif(data) if data else ():
                said = {k: getattr(f, k) for k in ("left", "top", "width", "height", "delay_cs", "disposal")}
                frames.append(said | {"shown_cs": now, "histogram": f.histogram()})
                samples.append(f.canvas[f.top : f.top + f.height, f.left : f.left + f.width, 0].tobytes())
                now += f.delay_cs
        except Damaged as why:
            return None, None, str(why)
        return frames, b"".join(samples), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_slices(whole, media):
                made = [decoded(m) for m in batch.column(media).to_pylist()]
                columns = [pa.array(c, kind) for c, kind in zip(zip(*made, strict=True), (arrow, pa.binary(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], schema.names)

    return stored.mapInArrow(run, schema)


def op4_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = media_columns(store_texts(read(spark, sf_dir, "documents").select("doc_id", "text")))
    counts = F.transform("frames", lambda f: F.array_join(f["histogram"].cast("array<string>"), ","))
    return media.select(
        "doc_id",
        "n_bytes",
        F.length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, -16, 16)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.array_join(counts, ";").alias("feature"),
    )
