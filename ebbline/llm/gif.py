"""GIF media columns: a full GIF87a/89a decoder (LZW streams, palettes, interlace, disposal,
transparency, frame times) and an encoder for 8-bit samples.

``compose`` gives frames under the disposal and transparency rules, with their times;
``decode_frames`` stores them as rows with their colour histograms.
``encode_samples`` stores any bytes losslessly as indices of a palette of 256 colours, and
``read_samples`` takes them back from the colours of the composed frames. One image
is handled by one task, frame by frame, and needs memory for its file and two
canvases; a canvas or frame of more than ``MAX_PIXELS`` pixels is an error, as is a file
that claims more indices than its code stream can hold. There is no shuffle.

Defined results: a null text is the empty text (64 zero bytes are stored);
equal texts give equal media; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

WIDTH = 64
ROWS_PER_FRAME = 1024
DELAY_CS = 4
#: Pixels of a canvas or frame at most.
MAX_PIXELS = 1 << 24
#: 256 colours: three bits of red, three of green, two of blue.
COLOURS = bytes(c for i in range(256) for c in ((i >> 5) * 255 // 7, (i >> 2 & 7) * 255 // 7, (i & 3) * 85))


class GifError(ValueError):
    """A stream that breaks the GIF format."""


# LZW ------------------------------------------------------------------------


def lzw_codes(data: bytes, minimum: int = 8) -> list[list[int]]:
    """Runs of codes, each begun by a clear code; a run ends when the table of 4096 entries is full."""
    clear, first = 1 << minimum, (1 << minimum) + 2
    runs: list[list[int]] = []
    codes, table, free = [clear], {}, first
    get, stream = table.get, iter(data)
    word = next(stream, None)
    if word is None:
        return [codes]
    for byte in stream:
        key = word << 8 | byte
        code = get(key)
        if code is None:
            codes.append(word)
            table[key] = free
            free += 1
            word = byte
            if free == 4096:
                runs.append(codes)
                codes, free = [clear], first
                table.clear()
        else:
            word = code
    codes.append(word)
    runs.append(codes)
    return runs


def code_widths(count: int, minimum: int) -> np.ndarray:
    """Bits of the clear code and of the codes after it: after j codes the decoder knows first + j - 1 entries."""
    entries = (1 << minimum) + 2 + np.arange(count) - 1
    widths = np.full(count, minimum + 1, dtype=np.int64)
    for bits in range(minimum + 1, 12):
        widths[entries >= 1 << bits] = bits + 1
    return widths


def _widths_of_run(count: int, minimum: int, first_width: int) -> np.ndarray:
    """Widths of a clear code (in the width before it) and count - 1 codes after it."""
    widths = np.empty(count, dtype=np.int64)
    widths[0] = first_width
    widths[1:] = code_widths(count - 1, minimum)
    return widths


def lzw_pack(runs: list[list[int]], minimum: int = 8) -> bytes:
    """Codes as a little-endian bit stream, with the end code."""
    codes, widths, width = [], [], minimum + 1
    for i, run in enumerate(runs):
        if i == len(runs) - 1:
            run = [*run, (1 << minimum) + 1]
        w = _widths_of_run(len(run) + 1, minimum, width)
        width = int(w[-1])
        codes.append(np.array(run, dtype=np.int64))
        widths.append(w[:-1])
    code, bits = np.concatenate(codes), np.concatenate(widths)
    ends = np.cumsum(bits)
    index = np.arange(int(ends[-1])) - np.repeat(ends - bits, bits)
    stream = (np.repeat(code, bits) >> index) & 1
    return np.packbits(stream.astype(np.uint8), bitorder="little").tobytes()


def lzw_unpack(data: bytes, minimum: int, expected: int) -> bytes:
    """Decodes a code stream to at most ``expected`` indices.

    Between clear codes the width of each code follows from its place alone, so
    the codes of a run are cut out in one vector step; a table entry is the
    output of an earlier code and one sample more, so strings are copied from
    the output and no table is built.
    """
    if not 1 <= minimum <= 11:
        raise GifError("LZW minimum code size")
    clear, end, first = 1 << minimum, (1 << minimum) + 1, (1 << minimum) + 2
    padded = np.frombuffer(data + b"\0\0\0\0", dtype=np.uint8).astype(np.uint32)
    words = padded[:-3] | padded[1:-2] << 8 | padded[2:-1] << 16 | padded[3:] << 24
    total = 8 * len(data)
    out = bytearray()
    at, span, finished = 0, 4200, False
    while not finished and len(out) < expected:
        widths = code_widths(span, minimum)
        starts = at + np.cumsum(widths) - widths
        fits = int(np.searchsorted(starts + widths, total, side="right"))
        starts, widths = starts[:fits], widths[:fits]
        codes = (words[starts >> 3] >> (starts & 7).astype(np.uint32)) & ((1 << widths) - 1).astype(np.uint32)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        if len(stops):
            stop = int(stops[0])
            finished = codes[stop] == end
            at = int(starts[stop] + widths[stop])
            codes = codes[:stop]
        elif fits < span:
            finished = True
        else:
            span *= 4
            continue
        _expand(codes, clear, first, out)
        span = 4200
    return bytes(out[:expected])


def _expand(codes: np.ndarray, clear: int, first: int, out: bytearray) -> None:
    starts: list[int] = []
    put = starts.append
    known = min(4096 - first, len(codes))
    for i, code in enumerate(codes.tolist()):
        size = len(out)
        put(size)
        if code < clear:
            out.append(code)
            continue
        j = code - first
        if j >= i or j < 0 or j >= known:
            raise GifError("LZW code out of range")
        begin = starts[j]
        stop = starts[j + 1] + 1
        if stop <= size:
            out += out[begin:stop]
        else:  # the entry that this code itself completes
            out += out[begin:size]
            out.append(out[size])


# container ------------------------------------------------------------------


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def _read_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(data):
            raise GifError("truncated sub-blocks")
        size = data[at]
        at += 1
        if not size:
            return b"".join(parts), at
        parts.append(data[at : at + size])
        if len(parts[-1]) < size:
            raise GifError("truncated sub-block")
        at += size


@dataclass
class Frame:
    """One image as stored: its place, indices, palette and control values."""

    left: int
    top: int
    width: int
    height: int
    indices: bytes
    palette: bytes
    delay_cs: int
    disposal: int
    transparent: int | None


@dataclass
class StoredFrame:
    """A frame as it lies in a file: its code stream is expanded when the indices are asked for, and not kept."""

    left: int
    top: int
    width: int
    height: int
    code: bytes
    minimum: int
    interlaced: bool
    palette: bytes
    delay_cs: int
    disposal: int
    transparent: int | None

    @property
    def indices(self) -> bytes:
        w, h = self.width, self.height
        indices = lzw_unpack(self.code, self.minimum, w * h)
        if not self.interlaced:
            return indices
        rows = np.frombuffer(indices.ljust(w * h, b"\0"), dtype=np.uint8).reshape(h, w)
        straight = np.empty_like(rows)
        straight[[*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]] = rows
        return straight.tobytes()


@dataclass
class Gif:
    width: int
    height: int
    background: int
    palette: bytes
    loops: int | None
    frames: list[StoredFrame]


def encode(width: int, height: int, frames: list[Frame], palette: bytes = COLOURS, background: int = 0, loops: int | None = None) -> bytes:
    """A GIF89a file with one global palette of 256 colours; a frame whose palette differs has a local one."""
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, background, 0), palette.ljust(768, b"\0")]
    if loops is not None:
        out.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01" + struct.pack("<H", loops) + b"\0")
    for f in frames:
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", f.disposal << 2 | (f.transparent is not None), f.delay_cs, f.transparent or 0) + b"\0")
        local = f.palette if f.palette != palette else b""
        out.append(b"\x2c" + struct.pack("<HHHHB", f.left, f.top, f.width, f.height, 0x87 if local else 0))
        out.append(local.ljust(768, b"\0") if local else b"")
        out.append(b"\x08" + _blocks(lzw_pack(lzw_codes(f.indices))))
    return b"".join([*out, b"\x3b"])


def decode(data: bytes, most: int = MAX_PIXELS) -> Gif:
    """Parses a file; code streams are expanded frame by frame later. GifError where the format is broken."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise GifError("signature")
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    if width * height > most:
        raise GifError("canvas too large")
    at, palette = 13, b""
    if flags & 0x80:
        size = 3 << ((flags & 7) + 1)
        palette, at = data[at : at + size], at + size
    frames: list[StoredFrame] = []
    delay, disposal, transparent, loops = 0, 0, None, None
    while True:
        if at >= len(data):
            raise GifError("no trailer")
        kind = data[at]
        if kind == 0x3B:
            return Gif(width, height, background, palette, loops, frames)
        if kind == 0x21:
            if at + 1 >= len(data):
                raise GifError("extension")
            label = data[at + 1]
            body, at = _read_blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, body[1] | body[2] << 8
                transparent = body[3] if body[0] & 1 else None
            elif label == 0xFF and body[:11] == b"NETSCAPE2.0" and len(body) >= 14 and body[11] == 1:
                loops = body[12] | body[13] << 8
            continue
        if kind != 0x2C or at + 10 > len(data):
            raise GifError("block type")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        if w * h > most:
            raise GifError("frame too large")
        at += 10
        local = palette
        if flags & 0x80:
            size = 3 << ((flags & 7) + 1)
            local, at = data[at : at + size], at + size
        if at >= len(data):
            raise GifError("image data")
        minimum = data[at]
        body, at = _read_blocks(data, at + 1)
        frames.append(StoredFrame(left, top, w, h, body, minimum, bool(flags & 0x40), local, delay, disposal, transparent))
        delay, disposal, transparent = 0, 0, None


def compose(gif: Gif) -> Iterator[tuple[int, int, np.ndarray]]:
    """(frame number, start in centiseconds, RGBA canvas) under the disposal and transparency rules:
    2 clears the frame's rectangle afterwards, 3 restores what was there before. A canvas is good until the next one is asked for."""
    canvas = np.zeros((gif.height, gif.width), dtype=np.uint32)  # a pixel's four bytes as one number
    start = 0
    for number, f in enumerate(gif.frames):
        before = canvas.copy() if f.disposal == 3 else None
        colours = np.zeros((256, 4), dtype=np.uint8)
        known = np.frombuffer(f.palette[: len(f.palette) // 3 * 3], dtype=np.uint8).reshape(-1, 3)
        colours[: len(known), :3] = known
        colours[:, 3] = 255
        index = np.frombuffer(f.indices.ljust(f.width * f.height, b"\0"), dtype=np.uint8).reshape(f.height, f.width)
        area = canvas[f.top : f.top + f.height, f.left : f.left + f.width]
        index = index[: area.shape[0], : area.shape[1]]
        drawn = colours.view(np.uint32).ravel()[index]
        if f.transparent is None:
            area[:] = drawn
        else:
            np.copyto(area, drawn, where=index != f.transparent)
        yield number, start, canvas.view(np.uint8).reshape(gif.height, gif.width, 4)
        start += f.delay_cs
        if f.disposal == 2:
            area[:] = 0
        elif before is not None:
            canvas = before


def histogram(rgba: np.ndarray) -> np.ndarray:
    """Counts of opaque pixels in 64 cells: two bits of each of red, green and blue."""
    opaque = rgba.reshape(-1, 4)
    if not opaque[:, 3].all():
        opaque = opaque[opaque[:, 3] > 0]
    return np.bincount(opaque[:, 0] >> 6 << 4 | opaque[:, 1] >> 6 << 2 | opaque[:, 2] >> 6, minlength=64)


# samples --------------------------------------------------------------------


def pad(raw: bytes) -> bytes:
    """raw and zero bytes up to a positive multiple of 64."""
    return raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))


def encode_samples(payload: bytes) -> bytes:
    """payload (a multiple of 64 bytes) as an animation 64 samples wide, at most 1024 rows a frame."""
    step = WIDTH * ROWS_PER_FRAME
    frames = [Frame(0, 0, WIDTH, len(part) // WIDTH, part, COLOURS, DELAY_CS, 1, None) for part in (payload[i : i + step] for i in range(0, len(payload), step))]
    return encode(WIDTH, max(f.height for f in frames), frames, loops=0)


def read_samples(media: bytes) -> tuple[bytes, Gif, np.ndarray]:
    """The samples by the colours of each composed frame's rectangle, frame after frame, the parsed file, and the sum of the frames' histograms."""
    gif = decode(media)
    parts, counts = [], np.zeros(64, dtype=np.int64)
    for number, _, canvas in compose(gif):
        f = gif.frames[number]
        area = canvas[f.top : f.top + f.height, f.left : f.left + f.width]
        parts.append((area[..., 0] >> 5 << 5 | area[..., 1] >> 5 << 2 | area[..., 2] >> 6).tobytes())
        counts += histogram(area)
    return b"".join(parts), gif, counts


def sample_feature(gif: Gif, counts: np.ndarray) -> str:
    """Frames, length in centiseconds, and the colour histogram of what the frames show: the counts of 64 cells in hexadecimal."""
    return f"f{len(gif.frames)};t{sum(f.delay_cs for f in gif.frames)};h" + ",".join(f"{c:x}" for c in counts.tolist())


FRAMES_SCHEMA = "frame_no int, start_cs long, delay_cs int, width int, height int, rgba binary, histogram array<int>"


def decode_frames(media: DataFrame, key: str, column: str, most: int = MAX_PIXELS) -> DataFrame:
    """media(key, column binary) -> key, error, and a row for each composed frame (FRAMES_SCHEMA), one frame at a time.

    A null or broken file gives one row with its error and null frame columns, after the frames up to the break; a file without frames gives none.
    """
    key_type = media.schema[key].dataType.simpleString()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches(stream, 2 << 20):
            kind = batch.schema.field(0).type
            schema = pa.schema([(key, kind), ("error", pa.string()), ("frame_no", pa.int32()), ("start_cs", pa.int64()), ("delay_cs", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("rgba", pa.binary()), ("histogram", pa.list_(pa.int32()))])
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row = lambda *cells: pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, schema.types, strict=True)], schema=schema)  # noqa: B023, E731
                try:
                    if data is None:
                        raise GifError("null")
                    gif = decode(data, most)
                    for number, start, canvas in compose(gif):
                        yield row(k, None, number, start, gif.frames[number].delay_cs, gif.width, gif.height, canvas.tobytes(), histogram(canvas).tolist())
                except GifError as e:
                    yield row(k, str(e), None, None, None, None, None, None, None)

    return common.crossed_out(media, key, column).mapInArrow(run, f"`{key}` {key_type}, error string, {FRAMES_SCHEMA}")


def text_media(documents: DataFrame) -> DataFrame:
    """documents(doc_id, text) -> doc_id, n_bytes, media: each whole text stored as a GIF of 8-bit samples."""
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches(stream, 4 << 20):
            raw = batch.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x or b"") for x in raw], pa.int64()), pa.array([encode_samples(pad(x or b"")) for x in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return common.crossed_out(documents, "doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_bytes long, media binary")


def media_digests(media: DataFrame) -> DataFrame:
    """text_media's rows -> the digest columns, all from the stored bytes read back."""
    id_type = media.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def digest(data: bytes) -> tuple:
        payload, gif, counts = read_samples(data)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), sample_feature(gif, counts)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in common.batches(stream, 4 << 20):
            rows = [digest(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=names)

    return media.mapInArrow(run, f"doc_id {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op5_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(common.written(text_media(common.table(spark, sf_dir, "documents")), "media"))
