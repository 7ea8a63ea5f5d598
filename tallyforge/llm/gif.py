"""Media columns: GIF images written, decoded and described.

The format (GIF89a) is public. ``encode`` stores bytes as the indices of a grey
palette, in frames of one width; ``decode`` reads any GIF: it decodes the LZW
code streams, undoes interlacing, applies local or global palettes, transparency
and disposal, and gives the composed, timed frames. Code streams without a clear
code in between (those that ``encode`` writes, and most small images) are decoded
for a whole batch of frames at once; others code by code.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, table

#: Payloads are padded with blanks to a positive multiple of this; it is the width of a frame.
WIDTH = 192
#: Rows of a frame. 16 rows are at most 3,072 codes, so that a frame's codes never fill the 4,096 of the table.
ROWS = 16
#: Hundredths of a second of a frame.
DELAY = 4
GREY = bytes(v for i in range(256) for v in (i, i, i))
CLEAR, END = 256, 257


def widths_of(n: int, size: int = 8) -> np.ndarray:
    """Bits of each of n codes after a clear code, for a minimum code size.

    The decoder adds an entry with each code but the first, and the width grows
    when the next entry's number no longer fits, to 12 bits at most.
    """
    entry = np.arange(n) + (1 << size) + 1  # the highest entry when code i is read
    entry[0:1] = (1 << size) + 1
    return np.clip(np.ceil(np.log2(entry + 1)).astype(np.int64), size + 1, 12)


def lzw_codes(frames: list[np.ndarray]) -> list[np.ndarray]:
    """LZW codes (without clear and end) of each frame, of at most 3,838 bytes, all frames in lock step."""
    m, longest = len(frames), max(map(len, frames))
    data = np.zeros((longest, m), np.uint32)
    for i, f in enumerate(frames):
        data[: len(f), i] = f
    length = np.array([len(f) for f in frames])
    bits = 13
    slots = np.zeros(m << bits, np.uint32)  # (prefix code, byte) << 12 | code, by open addressing
    out = np.zeros((longest, m), np.uint16)
    count, entry = np.zeros(m, np.int64), np.full(m, 258, np.uint32)
    lane = np.arange(m, dtype=np.uint32)
    base = lane << np.uint32(bits)
    current = data[0].copy()
    mask = np.uint32((1 << bits) - 1)
    order = np.argsort(-length, kind="stable")
    at = np.append(length[order], 0)
    alive = m
    for t in range(1, longest):
        while at[alive - 1] <= t:
            alive -= 1
        live = order[:alive]
        byte = data[t, live]
        key = (current[live] << np.uint32(8)) | byte
        slot = (key * np.uint32(2654435761) >> np.uint32(15)) & mask
        home = base[live]
        found = slots[home + slot]
        open_ = np.flatnonzero((found != 0) & (found >> np.uint32(12) != key))
        while len(open_):
            slot[open_] = (slot[open_] + np.uint32(1)) & mask
            found[open_] = got = slots[home[open_] + slot[open_]]
            open_ = open_[(got != 0) & (got >> np.uint32(12) != key[open_])]
        hit = found != 0
        miss = np.flatnonzero(~hit)
        where = live[miss]
        out[count[where], where] = current[where]
        count[where] += 1
        slots[home[miss] + slot[miss]] = (key[miss] << np.uint32(12)) | entry[where]
        entry[where] += np.uint32(1)
        current[live] = np.where(hit, found & np.uint32(4095), byte)
    out[count, lane] = current
    return [out[: n + 1, i] for i, n in enumerate(count.tolist())]


def pack_codes(codes: np.ndarray, size: int = 8) -> bytes:
    """Clear code, codes and end code as bits, least significant first."""
    full = np.concatenate([[1 << size], codes, [(1 << size) + 1]]).astype(np.uint32)
    width = np.concatenate([[size + 1], widths_of(len(codes) + 1, size)])
    bits = ((full[:, None] >> np.arange(12, dtype=np.uint32)) & 1).astype(np.uint8)
    return np.packbits(bits[np.arange(12) < width[:, None]], bitorder="little").tobytes()


def blocks(data: bytes) -> bytes:
    """Sub-blocks of at most 255 bytes, and the empty one."""
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode(payloads: list[bytes], width: int = WIDTH, rows: int = ROWS, delay: int = DELAY) -> list[bytes]:
    """A GIF for each payload (a multiple of the width long), a byte a pixel."""
    frames = [[np.frombuffer(p[lo : lo + width * rows], np.uint8) for lo in range(0, len(p), width * rows)] for p in payloads]
    flat = [f for own in frames for f in own]
    codes: list[np.ndarray] = []
    for lo in range(0, len(flat), 2048):
        codes += lzw_codes(flat[lo : lo + 2048])
    out, k = [], 0
    for own in frames:
        height = max(len(f) for f in own) // width
        parts = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), GREY]
        if len(own) > 1:
            parts.append(b"!\xff\x0bNETSCAPE2.0\x03\x01\0\0\0")
        for f in own:
            parts += [b"!\xf9\x04", struct.pack("<BHBB", 1 << 2, delay, 0, 0), b",", struct.pack("<HHHHB", 0, 0, width, len(f) // width, 0), b"\x08", blocks(pack_codes(codes[k]))]
            k += 1
        out.append(b"".join([*parts, b";"]))
    return out


@dataclass
class Frame:
    """An image of a GIF as stored: its place, indices once decoded, and control values."""

    left: int
    top: int
    width: int
    height: int
    size: int
    data: bytes
    interlaced: bool
    palette: np.ndarray | None
    delay: int = 0
    disposal: int = 0
    transparent: int | None = None
    indices: np.ndarray | None = None


@dataclass
class Gif:
    width: int
    height: int
    background: int
    palette: np.ndarray | None
    loops: int | None = None
    frames: list[Frame] = field(default_factory=list)


def parse(raw: bytes) -> Gif:
    """The blocks of a GIF. What a cut-off file still holds is kept; ValueError if it is none."""
    if raw[:6] not in (b"GIF87a", b"GIF89a") or len(raw) < 13:
        raise ValueError("not a GIF")
    width, height, flags, background, _ = struct.unpack("<HHBBB", raw[6:13])
    at = 13

    def colours(flags):
        nonlocal at
        n = 2 << (flags & 7)
        table_ = np.frombuffer(raw[at : at + 3 * n].ljust(3 * n, b"\0"), np.uint8).reshape(-1, 3)
        at += 3 * n
        return table_

    def chained():
        nonlocal at
        got = []
        while at < len(raw) and raw[at]:
            got.append(raw[at + 1 : at + 1 + raw[at]])
            at += 1 + raw[at]
        at += 1
        return got

    gif = Gif(width, height, background, colours(flags) if flags & 0x80 else None)
    control: dict = {}
    while at < len(raw):
        kind = raw[at]
        at += 1
        if kind == 0x3B:
            break
        if kind == 0x21:
            label = raw[at] if at < len(raw) else 0
            at += 1
            got = chained()
            if label == 0xF9 and got and len(got[0]) >= 4:
                f, delay, clear = struct.unpack("<BHB", got[0][:4])
                control = {"delay": delay, "disposal": f >> 2 & 7, "transparent": clear if f & 1 else None}
            elif label == 0xFF and got and got[0].startswith(b"NETSCAPE") and len(got) > 1 and len(got[1]) >= 3:
                gif.loops = struct.unpack("<H", got[1][1:3])[0]
        elif kind == 0x2C and at + 9 < len(raw):
            left, top, w, h, flags = struct.unpack("<HHHHB", raw[at : at + 9])
            at += 9
            own = colours(flags) if flags & 0x80 else None
            size = raw[at] if at < len(raw) else 8
            at += 1
            gif.frames.append(Frame(left, top, w, h, size, b"".join(chained()), bool(flags & 0x40), own, **control))
            control = {}
    return gif


def lzw_slow(data: bytes, size: int, pixels: int) -> np.ndarray:
    """Code by code, for any stream: clear codes anywhere, a full table, a missing end."""
    clear, end = 1 << size, (1 << size) + 1
    strings = [bytes([i]) for i in range(clear)] + [b"", b""]
    width, previous, out, n = size + 1, None, [], 0
    value = held = 0
    for byte in data:
        value |= byte << held
        held += 8
        while held >= width:
            code, value, held = value & ((1 << width) - 1), value >> width, held - width
            if code == clear:
                del strings[end + 1 :]
                width, previous = size + 1, None
                continue
            if code == end or n >= pixels:
                return np.frombuffer(b"".join(out)[:pixels], np.uint8)
            if code < len(strings):
                string = strings[code]
            elif previous is not None and code == len(strings):
                string = previous + previous[:1]
            else:
                return np.frombuffer(b"".join(out)[:pixels], np.uint8)
            if previous is not None and len(strings) < 4096:
                strings.append(previous + string[:1])
            if len(strings) == 1 << width and width < 12:
                width += 1
            out.append(string)
            n += len(string)
            previous = string
    return np.frombuffer(b"".join(out)[:pixels], np.uint8)


def lzw_fast(streams: list[bytes]) -> list[np.ndarray | None]:
    """Streams of minimum code size 8 with one clear code, at their start; None where that doesn't hold.

    An entry made with code i is the text of code i - 1 and one byte more, which
    stands in the output where code i - 1 does. So lengths, then bytes, follow by
    jumping along references to earlier output, for all streams together.
    """
    n_codes, codes = [], []
    good = []
    for data in streams:
        most = min(3838 + 2, max(0, (len(data) * 8 - 9) // 9))
        ok = False
        if most >= 1:
            width = widths_of(most)
            begin = np.concatenate([[0], np.cumsum(width)[:-1]]) + 9
            fit = int(np.searchsorted(begin + width, len(data) * 8, "right"))
            begin, width = begin[:fit], width[:fit]
            raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
            at = begin >> 3
            value = (raw[at] | raw[at + 1] << np.uint32(8) | raw[at + 2] << np.uint32(16)) >> (begin & 7).astype(np.uint32)
            value = (value & ((1 << width) - 1).astype(np.uint32)).astype(np.int64)
            ends = np.flatnonzero(value == END)
            if data[0] | (data[1] & 1) << 8 == CLEAR and len(ends):
                value = value[: ends[0]]
                ok = len(value) > 0 and not (value == CLEAR).any() and value[0] < 256 and bool((value <= 257 + np.arange(len(value))).all())
        good.append(ok)
        if ok:
            n_codes.append(len(value))
            codes.append(value)
    if not codes:
        return [None] * len(streams)
    n_codes = np.array(n_codes)
    first = np.concatenate([[0], np.cumsum(n_codes)[:-1]])
    code = np.concatenate(codes)
    literal = code < 256
    # The code before the one that made the entry; lengths grow by one with each step along these.
    parent = np.where(literal, np.arange(len(code)), code - 258 + np.repeat(first, n_codes))
    length, jump = np.where(literal, 1, 0), parent.copy()
    depth = np.where(literal, 0, 1)
    while True:
        further = ~literal[jump]
        if not further.any():
            break
        depth = depth + np.where(further, depth[jump], 0)
        jump = jump[jump]
    length = depth + 1
    stop = np.cumsum(length)
    start = stop - length
    total = int(stop[-1])
    source = np.arange(total)
    copied = np.flatnonzero(~literal)
    # Bytes of a copied code come from where its parent stands.
    n = length[copied]
    offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    source[np.repeat(start[copied], n) + offset] = np.repeat(start[parent[copied]], n) + offset
    while True:
        nxt = source[source]
        if (nxt == source).all():
            break
        source = nxt
    value = np.zeros(total, np.uint8)
    value[start[literal]] = code[literal]
    value = value[source]
    bounds = start[first].tolist() + [total]
    made = iter(value[a:b] for a, b in zip(bounds, bounds[1:], strict=False))
    return [next(made) if ok else None for ok in good]


def decode_indices(gifs: list[Gif]) -> None:
    """Fill in the indices of all frames; what a stream lacks is 0."""
    every = [f for g in gifs for f in g.frames]
    for lo in range(0, len(every), 512):
        frames = every[lo : lo + 512]
        fast = lzw_fast([f.data if f.size == 8 else b"" for f in frames])
        for f, got in zip(frames, fast, strict=True):
            n = f.width * f.height
            if got is None or len(got) < n:
                got = lzw_slow(f.data, f.size, n) if 1 <= f.size <= 11 else np.zeros(0, np.uint8)
            flat = np.zeros(n, np.uint8)
            flat[: min(n, len(got))] = got[:n]
            rows = flat.reshape(f.height, f.width)
            if f.interlaced:
                order = [*range(0, f.height, 8), *range(4, f.height, 8), *range(2, f.height, 4), *range(1, f.height, 2)]
                rows_ = np.empty_like(rows)
                rows_[order] = rows
                rows = rows_
            f.indices = rows


def compose(gif: Gif):
    """(RGBA canvas, delay) after each frame, by transparency and the frame before's disposal."""
    canvas = np.zeros((gif.height, gif.width, 4), np.uint8)
    for f in gif.frames:
        y, x = slice(f.top, min(f.top + f.height, gif.height)), slice(f.left, min(f.left + f.width, gif.width))
        before = canvas[y, x].copy() if f.disposal == 3 else None
        index = f.indices[: y.stop - y.start if y.stop > y.start else 0, : x.stop - x.start if x.stop > x.start else 0]
        palette = f.palette if f.palette is not None else gif.palette if gif.palette is not None else np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, 1)
        full = np.zeros((256, 4), np.uint8)
        full[: len(palette), :3] = palette
        full[:, 3] = 255
        pixels = full[index]
        if f.transparent is not None:
            seen = index != f.transparent
            canvas[y, x][seen] = pixels[seen]
        else:
            canvas[y, x] = pixels
        yield canvas, f.delay
        if f.disposal == 2:
            canvas[y, x] = 0
        elif f.disposal == 3:
            canvas[y, x] = before


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Pixels by two bits each of red, green and blue (64 colours); transparent ones don't count."""
    seen = canvas[canvas[..., 3] > 0]
    return np.bincount((seen[:, 0] >> 6 << 4 | seen[:, 1] >> 6 << 2 | seen[:, 2] >> 6).astype(np.int64), minlength=64)


def payload_of(text: str) -> tuple[bytes, int]:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % WIDTH or (0 if raw else WIDTH)), len(raw)


def make_media():
    """Texts to what the stored images hold: the columns of the contract."""

    def fn(ids, texts):
        payloads = [payload_of(t) for t in texts]
        stored = encode([p for p, _ in payloads])
        gifs = [parse(s) for s in stored]
        decode_indices(gifs)
        columns: list[list] = [[] for _ in range(9)]
        for (_, n_bytes), media, gif in zip(payloads, stored, gifs, strict=True):
            parts, colours, time = [], np.zeros(64, np.int64), 0
            for f, (canvas, delay) in zip(gif.frames, compose(gif), strict=True):
                own = canvas[f.top : f.top + f.height, f.left : f.left + f.width]
                parts.append(own[..., 0].tobytes())
                colours += histogram(own)
                time += delay
            payload = b"".join(parts)
            feature = f"frames={len(gif.frames)};cs={time};size={gif.width}x{gif.height};" + "grey=" + ",".join(str(colours[i]) for i in (0, 21, 42, 63))
            for c, v in zip(columns, (n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(gif.frames), media), strict=True):
                c.append(v)
        return ids, columns

    return fn


DIGEST = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_frames bigint"


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """Per row: id, the digest of its image as read back and, if ``keep``, the GIF itself (``media``).

    A null or empty text is one row of blanks; equal texts give equal values;
    an empty table gives no rows; other columns are ignored. Texts of any length
    become as many frames as they need.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        fn = make_media()

        def rows(ids, texts):
            ids, columns = fn(ids, texts)
            return (ids, *columns) if keep else (ids, *columns[:-1])

        return rows

    return map_texts(docs, id_col, text_col, make, f"{id_col} {kind}, {DIGEST}" + ", media binary" * keep)


FRAME = "frame bigint, start_ms bigint, delay_ms bigint, width bigint, height bigint, disposal bigint, colours array<bigint>, rgba binary"


def frames(images: DataFrame, id_col: str, media_col: str = "media") -> DataFrame:
    """One row per composed frame of any GIF: id, time, size, disposal, 64-bin colour histogram and RGBA pixels.

    What is null or not a GIF has no frames; a cut-off file has those that it holds.
    """
    kind = images.schema[id_col].dataType.simpleString()
    target = images.sparkSession.createDataFrame([], f"{id_col} {kind}, {FRAME}").schema

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    gif = parse(raw or b"")
                except ValueError:
                    continue
                decode_indices([gif])
                at, rows = 0, []
                for k, (canvas, delay) in enumerate(compose(gif)):
                    rows.append((key, k, at * 10, delay * 10, gif.width, gif.height, gif.frames[k].disposal, histogram(canvas).tolist(), canvas.tobytes()))
                    at += delay
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return images.select(id_col, media_col).mapInArrow(run, target)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media(table(spark, sf_dir, "documents"), keep=False)
