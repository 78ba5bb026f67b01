"""Media columns: GIF images written, decoded and described.

`decode` reads any GIF87a or GIF89a stream: colour tables, interlaced rows, LZW code streams of every width,
graphic control blocks with delays, transparency and disposal. Frames come back as index samples; `timed` applies
palettes, transparency and disposal and gives each frame's canvas, its time and its colour histograms, which
`frame_table` stores as columns. `encode` stores 8-bit samples losslessly, 24 a row, in frames of up to 72 rows and
LZW code streams with a growing dictionary.

Edge cases: null and empty texts give one frame of 255; equal texts give equal bytes; a broken stream raises
ValueError in `decode` (the query only reads what it has written); repeated documents are rows of their own.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparkloom.llm.arrowtext import raw, steps

SIDE = 24
#: Samples that payloads are padded to, and those of a frame: few enough that a code table never fills up.
BLOCK = SIDE * SIDE
FRAME = 3 * BLOCK
#: Hundredths of a second for each stored frame.
DELAY = 4
GREY = bytes(v for i in range(256) for v in (i, i, i))
BINS = 8
#: Text bytes coded at once.
STEP = 1 << 20


# -- LZW ---------------------------------------------------------------------------------------------------


#: Entries that a code table may have.
MOST_CODES = 4096
_ROOTS = [bytes([i]) for i in range(256)]
_known: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _widths(depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Width of the i-th code after a clear, and its first bit."""
    if depth not in _known:
        # before code i is read the table holds clear + 2 + (i - 1) entries
        entries = (1 << depth) + 1 + np.arange(2 * MOST_CODES)
        width = np.full(len(entries), depth + 1)
        for w in range(depth + 1, 12):
            width[entries >= 1 << w] = w + 1
        _known[depth] = width, np.cumsum(width) - width
    return _known[depth]


def _runs_of_codes(samples: bytes, clear: int) -> list[list[int]]:
    """The codes of a growing dictionary, a list for each time it is started anew."""
    out, rest = [], iter(samples)
    prefix = next(rest, None)
    while prefix is not None:
        codes, table, free = [], {}, clear + 2
        put, known = codes.append, table.get
        out.append(codes)
        for s in rest:
            code = known(key := prefix << 8 | s)
            if code is None:
                put(prefix)
                prefix = s
                if free == MOST_CODES:
                    break
                table[key] = free
                free += 1
            else:
                prefix = code
        else:
            put(prefix)
            prefix = None
    return out or [[]]


def lzw_compress_all(many: list[bytes], depth: int = 8) -> list[bytes]:
    """The code streams of many images, their codes put into bytes together."""
    clear = 1 << depth
    width, first = _widths(depth)
    codes, at, start, size = [], [], 0, []
    for samples in many:
        begin = bit = start
        codes.append(np.array([clear]))
        at.append(np.array([bit]))
        bit += depth + 1
        runs = _runs_of_codes(samples, clear)
        for i, run in enumerate(runs):
            run = np.array([*run, clear + (i == len(runs) - 1)])
            codes.append(run)
            at.append(bit + first[: len(run)])
            bit += int(first[len(run)])
        start = -(-bit // 8) * 8
        size.append((start - begin) // 8)
    if not codes:
        return []
    at = np.concatenate(at)
    value = np.concatenate(codes) << (at & 7)
    out = sum(np.bincount((at >> 3) + k, value >> 8 * k & 255, start // 8 + 2) for k in range(3)).astype(np.uint8).tobytes()
    ends = np.cumsum(size).tolist()
    return [out[b - n : b] for b, n in zip(ends, size)]


def lzw_compress(samples: bytes, depth: int = 8) -> bytes:
    return lzw_compress_all([samples], depth)[0]


def _codes(padded: np.ndarray, at: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Codes that begin at these bits; the data must go on for two bytes behind the last."""
    byte = at >> 3
    value = padded[byte].astype(np.int64) | padded[byte + 1].astype(np.int64) << 8 | padded[byte + 2].astype(np.int64) << 16
    return value >> (at & 7) & (1 << width) - 1


def _expand(codes: list[int], clear: int) -> bytes:
    """The samples that codes after a clear stand for."""
    if not codes:
        return b""
    table = _ROOTS[:clear] + [b"", b""]
    free = clear + 2
    if codes[0] >= clear:
        raise ValueError("a code that is not in the table")
    last = table[codes[0]]
    out = [last]
    put, know = out.append, table.append
    for code in codes[1:]:
        if code < free:
            entry = table[code]
        elif code == free < MOST_CODES:  # the entry being made
            entry = last + last[:1]
        else:
            raise ValueError("a code that is not in the table")
        put(entry)
        if free < MOST_CODES:
            know(last + entry[:1])
            free += 1
        last = entry
    return b"".join(out)


def lzw_decompress(data: bytes, depth: int, size: int) -> bytes:
    """Samples of a code stream; `size` is how many the image needs.

    The stream falls into runs between clear codes. Within a run the width of the i-th code is known from i alone, so
    its codes are taken out together, in growing pieces.
    """
    clear = 1 << depth
    width, first = _widths(depth)
    padded = np.frombuffer(data + b"\0\0\0", np.uint8)
    out, have, at, bits = [], 0, 0, 8 * len(data)
    while have < size:
        took, run, stop = 0, [], None
        while stop is None:
            upto = took + 512 + took
            w = width[np.minimum(np.arange(took, upto), len(width) - 1)]
            begin = at + np.where(np.arange(took, upto) < len(first), first[np.minimum(np.arange(took, upto), len(first) - 1)], first[-1] + (np.arange(took, upto) - len(first) + 1) * 12)
            fit = int(np.searchsorted(begin + w, bits, "right"))
            codes = _codes(padded, begin[:fit], w[:fit])
            special = np.flatnonzero((codes == clear) | (codes == clear + 1))
            if len(special):
                stop = int(special[0])
                run.append(codes[:stop])
                at = int(begin[stop] + w[stop])
            else:
                run.append(codes)
                if fit < len(w):
                    break
                took = upto
        body = _expand(np.concatenate(run).tolist(), clear)
        out.append(body)
        have += len(body)
        if stop is None or codes[stop] == clear + 1:
            break
    if have < size:
        raise ValueError("the code stream ends early")
    return b"".join(out)[:size]


def lzw_decompress_all(streams: list[bytes], depths: list[int], sizes: list[int]) -> list[bytes]:
    """Many streams. Codes of small ones are taken out together, as far as a first dictionary reaches; a stream that goes on
    behind a clear code is decoded by itself."""
    out: list[bytes | None] = [None] * len(streams)
    for depth in set(depths):
        small = [i for i, s in enumerate(streams) if depths[i] == depth and len(s) <= MOST_CODES]
        width, first = _widths(depth)
        for low in range(0, len(small), 1024):
            some = small[low : low + 1024]
            data = np.frombuffer(b"".join(streams[i] + b"\0\0\0" for i in some), np.uint8)
            length = np.array([len(streams[i]) for i in some])
            base = (np.cumsum(length + 3) - length - 3) * 8 + depth + 1  # behind the leading clear
            many = np.maximum(np.searchsorted(first + width, length * 8 - depth - 1, "right"), 0)
            row = np.repeat(np.arange(len(some)), many)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            codes = _codes(data, base[row] + first[nth], width[nth])
            lead = _codes(data, base - depth - 1, np.full(len(some), depth + 1))
            special = np.flatnonzero(codes >> 1 == 1 << depth - 1)
            ends = np.cumsum(many)
            stop = np.append(special, len(codes))[np.searchsorted(special, ends - many)]
            every = codes.tolist()
            for k, i in enumerate(some):
                if lead[k] == 1 << depth and stop[k] < ends[k] and codes[stop[k]] == (1 << depth) + 1:
                    samples = _expand(every[ends[k] - many[k] : stop[k]], 1 << depth)
                    if len(samples) >= sizes[i]:
                        out[i] = samples[: sizes[i]]
    return [lzw_decompress(s, d, n) if done is None else done for s, d, n, done in zip(streams, depths, sizes, out)]


# -- the container -----------------------------------------------------------------------------------------


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


LOOP = b"!\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"
CONTROL = b"!\xf9\x04" + struct.pack("<BHB", 1 << 2, DELAY, 0) + b"\0"


def _head(rows: int) -> bytes:
    return b"GIF89a" + struct.pack("<HHBBB", SIDE, rows, 0xF7, 0, 0) + GREY + LOOP


def _place(rows: int) -> bytes:
    return CONTROL + b"," + struct.pack("<HHHHB", 0, 0, SIDE, rows, 0) + b"\x08"


def encode(payload: bytes) -> bytes:
    """Samples, a multiple of 576, as an animated greyscale GIF."""
    return encode_all([payload])[0]


def encode_all(payloads: list[bytes]) -> list[bytes]:
    """Many payloads; the codes of all their frames are put into bytes together. A last frame may be lower than the canvas."""
    frames = [[p[i : i + FRAME] for i in range(0, len(p), FRAME)] for p in payloads]
    streams = iter(lzw_compress_all([f for own in frames for f in own]))
    return [b"".join([_head(len(own[0]) // SIDE), *[_place(len(f) // SIDE) + _blocks(next(streams)) for f in own], b";"]) for own in frames]


@dataclass
class Frame:
    """One image of the stream: where it lies, its samples, its colours and how it is shown."""

    left: int
    top: int
    width: int
    height: int
    samples: bytes
    palette: bytes
    delay: int
    disposal: int
    transparent: int | None
    depth: int = 8
    interlaced: bool = False


def decode(data: bytes) -> tuple[int, int, list[Frame]]:
    """Width, height and frames; ValueError for whatever is no whole stream."""
    try:
        return decode_all([data])[0]
    except (struct.error, IndexError) as e:
        raise ValueError("a block ends early") from e


def decode_all(media: list[bytes]) -> list[tuple[int, int, list[Frame]]]:
    """Width, height and frames of many streams, their code streams decoded together."""
    parsed = [_parsed(m) for m in media]
    every = [f for _, _, frames in parsed for f in frames]
    for f, samples in zip(every, lzw_decompress_all([f.samples for f in every], [f.depth for f in every], [f.width * f.height for f in every])):
        f.samples = _deinterlaced(samples, f.width, f.height) if f.interlaced else samples
    return parsed


def _parsed(data: bytes) -> tuple[int, int, list[Frame]]:
    """The blocks of a stream; frames still hold their code streams as samples."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at = 13
    common = b""
    if flags & 0x80:
        size = 3 << ((flags & 7) + 1)
        common, at = data[at : at + size], at + size
    frames, delay, disposal, transparent = [], 0, 0, None
    while at < len(data):
        mark = data[at]
        if mark == 0x3B:
            return width, height, frames
        if mark == 0x21:
            label = data[at + 1]
            body, at = _joined(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                packed, delay, clear = struct.unpack_from("<BHB", body)
                disposal, transparent = packed >> 2 & 7, clear if packed & 1 else None
        elif mark == 0x2C:
            left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            palette = common
            if packed & 0x80:
                size = 3 << ((packed & 7) + 1)
                palette, at = data[at : at + size], at + size
            depth = data[at]
            if not 1 <= depth <= 8:
                raise ValueError(f"samples of {depth} bits")
            body, at = _joined(data, at + 1)
            frames.append(Frame(left, top, w, h, body, palette, delay, disposal, transparent, depth, bool(packed & 0x40)))
            delay, disposal, transparent = 0, 0, None
        else:
            raise ValueError(f"an unknown block at {at}")
    raise ValueError("no trailer")


def _joined(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(data):
            raise ValueError("a block ends early")
        n = data[at]
        if n == 0:
            return b"".join(parts), at + 1
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n


def _deinterlaced(samples: bytes, w: int, h: int) -> bytes:
    rows = np.frombuffer(samples, np.uint8).reshape(h, w)
    order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
    out = np.empty_like(rows)
    out[order] = rows
    return out.tobytes()


def colours(palette: bytes) -> np.ndarray:
    """A colour table as 256 opaque RGBA values, four bytes in one number; indexes beyond it are black."""
    out = np.zeros((256, 4), np.uint8)
    table = np.frombuffer(palette[: len(palette) // 3 * 3], np.uint8).reshape(-1, 3)
    out[: len(table), :3] = table
    out[:, 3] = 255
    return out.view(np.uint32).ravel()


def canvases(width: int, height: int, frames: list[Frame]):
    """The RGBA canvas as shown during each frame, after disposal of the one before."""
    canvas = np.zeros((height, width), np.uint32)
    known: dict[bytes, np.ndarray] = {}
    for f in frames:
        before = canvas.copy() if f.disposal == 3 else None
        index = np.frombuffer(f.samples, np.uint8).reshape(f.height, f.width)
        if (table := known.get(f.palette)) is None:
            table = known[f.palette] = colours(f.palette)
        area = canvas[f.top : f.top + f.height, f.left : f.left + f.width]
        index = index[: area.shape[0], : area.shape[1]]
        if f.transparent is None:
            area[...] = table[index]
        else:
            shown = index != f.transparent
            area[shown] = table[index[shown]]
        yield canvas.copy().view(np.uint8).reshape(height, width, 4)
        if f.disposal == 2:
            area[...] = 0
        elif f.disposal == 3:
            canvas = before


#: Histogram columns.
CHANNELS = ("luma", "red", "green", "blue")
#: Bytes of canvases that are looked at, and handed on, at once.
HANDED_ON = 1 << 20


def histograms(rgba: np.ndarray) -> np.ndarray:
    """Visible pixels of each canvas by luma, red, green and blue: BINS counts each."""
    n, size = len(rgba), rgba.shape[1] * rgba.shape[2]
    pixels = np.ascontiguousarray(rgba).view(np.uint32).ravel()
    at = np.repeat(np.arange(n, dtype=np.uint32) * BINS, size)
    if not (visible := pixels >= 1 << 24).all():
        pixels, at = pixels[visible], at[visible]
    red, green, blue = pixels & 255, pixels >> 8 & 255, pixels >> 16 & 255
    levels = ((299 * red + 587 * green + 114 * blue) // 1000, red, green, blue)
    return np.stack([np.bincount(at + level * BINS // 256, minlength=n * BINS).reshape(n, BINS) for level in levels], axis=1)


def timed(width: int, height: int, frames: list[Frame]):
    """For each frame its number, start and delay in hundredths of a second, canvas and histograms."""
    clock, many = 0, max(1, HANDED_ON // max(1, 4 * width * height))
    for low, some in enumerate(batched(zip(frames, canvases(width, height, frames)), many)):
        for i, ((f, rgba), bins) in enumerate(zip(some, histograms(np.stack([c for _, c in some]))), low * many):
            yield i, clock, f.delay, rgba, bins
            clock += f.delay


_FRAME_ARROW = pa.schema([("media_id", pa.string()), ("frame", pa.int32()), ("start_cs", pa.int64()), ("delay_cs", pa.int32()), ("rgba", pa.binary()), ("width", pa.int32()), ("height", pa.int32()), *[(c, pa.list_(pa.int32())) for c in CHANNELS], ("error", pa.string())])
FRAMES = "media_id string, frame int, start_cs long, delay_cs int, rgba binary, width int, height int, " + ", ".join(f"{c} array<int>" for c in CHANNELS) + ", error string"
#: Pixels of a canvas that is shown.
MOST_PIXELS = 1 << 26


def frame_table(media: DataFrame) -> DataFrame:
    """Timed frames of a table (media_id, bytes): one row a frame, composited, with its colour histograms. A stream that is
    broken, or whose canvas has over MOST_PIXELS, is one row that says so in `error`; null bytes are none."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("media_id").to_pylist(), batch.column("bytes").to_pylist()):
                if data is None:
                    continue
                try:
                    w, h, frames = decode(data)
                    if w * h > MOST_PIXELS:
                        raise ValueError(f"a canvas of {w} by {h}")
                except ValueError as e:
                    yield pa.RecordBatch.from_pylist([{"media_id": str(name), "error": str(e)}], schema=_FRAME_ARROW)
                    continue
                rows = []
                for i, start, delay, rgba, bins in timed(w, h, frames):
                    rows.append({"media_id": str(name), "frame": i, "start_cs": start, "delay_cs": delay, "rgba": rgba.tobytes(), "width": w, "height": h, **dict(zip(CHANNELS, bins.tolist()))})
                    if len(rows) * 4 * w * h >= HANDED_ON:
                        yield pa.RecordBatch.from_pylist(rows, schema=_FRAME_ARROW)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_FRAME_ARROW)

    return media.select("media_id", "bytes").mapInArrow(run, FRAMES)


def padded(data: bytes) -> bytes:
    return data + b"\xff" * (-len(data) % BLOCK if data else BLOCK)


def described(media: bytes) -> tuple[bytes, str]:
    """The samples read back and what their frames look like: how many, how long, and their histograms added up."""
    return shown(*decode(media))


def shown(w: int, h: int, frames: list[Frame]) -> tuple[bytes, str]:
    n, time, bins = 0, 0, np.zeros((len(CHANNELS), BINS), np.int64)
    for i, start, delay, _, own in timed(w, h, frames):
        n, time = i + 1, start + delay
        bins += own
    looks = ";".join(f"{c}={','.join(map(str, b))}" for c, b in zip(CHANNELS, bins.tolist()))
    return b"".join(f.samples for f in frames), f"frames={n};time={time};{looks}"


def store(docs: DataFrame) -> DataFrame:
    """media_id and bytes: each text as a GIF."""

    def run(batches):
        for batch in batches:
            for part in steps(batch, most=STEP):
                offsets, data = raw(part.column("text"))
                at = offsets.tolist()
                yield pa.RecordBatch.from_arrays([part.column("media_id"), pa.array(encode_all([padded(data[a:b]) for a, b in zip(at, at[1:])]), pa.binary())], names=["media_id", "bytes"])

    return docs.selectExpr("cast(doc_id as string) as media_id", "text").mapInArrow(run, "media_id string, bytes binary")


def digests(docs: DataFrame) -> DataFrame:
    """Sizes, hashes and features of each text's stored form, all from the bytes read back."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType())])

    def run(batches):
        for batch in batches:
            for part in steps(batch, most=STEP):
                offsets, data = raw(part.column("text"))
                at = offsets.tolist()
                rows = []
                stored = encode_all([padded(data[a:b]) for a, b in zip(at, at[1:])])
                for a, b, media, read in zip(at, at[1:], stored, decode_all(stored)):
                    back, feature = shown(*read)
                    rows.append((b - a, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
                yield pa.RecordBatch.from_arrays([part.column("doc_id")] + [pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op4_gif(docs: DataFrame) -> DataFrame:
    return digests(docs)
