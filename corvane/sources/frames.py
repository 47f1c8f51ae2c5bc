"""Images of several frames as RGB: the directories of a TIFF, the blocks of a GIF."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

#: TIFF's types by size, and the tags that say how a frame is stored.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR, PALETTE = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 320
#: Ways of compression and of colour.
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
WHITE_IS_ZERO, BLACK_IS_ZERO, RGB, INDEXED = 0, 1, 2, 3

Frame = tuple[int, int, bytes]


def frames(content: bytes) -> list[Frame]:
    """(width, height, RGB bytes) of every frame; ValueError if the file or a frame can't be read."""
    try:
        if content[:4] in (b"II*\0", b"MM\0*"):
            return list(_tiff(content))
        if content[:6] in (b"GIF87a", b"GIF89a"):
            return list(_gif(content))
    except (IndexError, KeyError, struct.error, zlib.error) as e:
        raise ValueError(f"a frame breaks off: {e}") from e
    raise ValueError("neither TIFF nor GIF")


# --- LZW --------------------------------------------------------------------


def lzw(data: bytes, bits: int, low_first: bool) -> bytes:
    """Decompressed bytes.  bits: of a literal.  low_first: as in GIF; else as in TIFF, where codes also widen one early."""
    clear, end, early = 1 << bits, (1 << bits) + 1, 0 if low_first else 1
    out, table, width, last = bytearray(), [], bits + 1, b""
    held = n = 0
    for byte in data:
        held = held | byte << n if low_first else held << 8 | byte
        n += 8
        while n >= width:
            n -= width
            if low_first:
                code, held = held & (1 << width) - 1, held >> width
            else:
                code, held = held >> n, held & (1 << n) - 1
            if code == clear:
                table, width, last = [bytes([k]) for k in range(clear)] + [b"", b""], bits + 1, b""
                continue
            if code == end:
                return bytes(out)
            if not table:
                raise ValueError("LZW without a start")
            if last:
                if code > len(table):
                    raise ValueError("LZW with an unknown code")
                if len(table) < 4096:
                    table.append(last + (table[code][:1] if code < len(table) else last[:1]))
            last = table[code]
            out += last
            if len(table) + early >= 1 << width and width < 12:
                width += 1
    return bytes(out)


def packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


# --- TIFF -------------------------------------------------------------------


def _tiff(content: bytes) -> Iterator[Frame]:
    order = "<" if content[:2] == b"II" else ">"
    (at,) = struct.unpack_from(order + "I", content, 4)
    seen: set[int] = set()
    while at and at not in seen:  # a chain that comes back to itself ends
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", content, at)
        tags = dict(_entry(content, order, at + 2 + 12 * k) for k in range(n))
        yield _tiff_frame(content, order, tags)
        (at,) = struct.unpack_from(order + "I", content, at + 2 + 12 * n)


def _entry(content: bytes, order: str, at: int) -> tuple[int, list[int]]:
    tag, kind, count = struct.unpack_from(order + "HHI", content, at)
    size = SIZES.get(kind, 1) * count
    where = at + 8 if size <= 4 else struct.unpack_from(order + "I", content, at + 8)[0]
    if kind not in (1, 3, 4):  # only whole numbers say how a frame is stored
        return tag, []
    return tag, list(struct.unpack_from(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I'}[kind] }", content, where))


def _tiff_frame(content: bytes, order: str, tags: dict[int, list[int]]) -> Frame:
    one = lambda tag, default: tags.get(tag, [default])[0]
    width, height, samples, bits = tags[WIDTH][0], tags[HEIGHT][0], one(SAMPLES, 1), tags.get(BITS, [1])
    way, colour, rows = one(COMPRESSION, NONE), one(PHOTOMETRIC, BLACK_IS_ZERO), min(one(ROWS, height), height)
    if len(set(bits)) > 1 or bits[0] not in (1, 8, 16) or one(PLANAR, 1) != 1 or colour not in (WHITE_IS_ZERO, BLACK_IS_ZERO, RGB, INDEXED):
        raise ValueError("a TIFF frame of a kind that is not read")
    strips = []
    for start, size in zip(tags[OFFSETS], tags[COUNTS]):
        raw = content[start : start + size]
        if way == LZW:
            raw = lzw(raw, 8, False)
        elif way in (DEFLATE, OLD_DEFLATE):
            raw = zlib.decompress(raw)
        elif way == PACKBITS:
            raw = packbits(raw)
        elif way != NONE:
            raise ValueError(f"TIFF compression {way} is not read")
        strips.append(raw)
    line = -(-width * samples * bits[0] // 8)
    whole = [s[: line * min(rows, height - k * rows)] for k, s in enumerate(strips)]
    data = np.frombuffer(b"".join(whole), np.uint8)[: line * height].reshape(height, line)
    if bits[0] == 1:
        values = np.unpackbits(data, axis=1)[:, : width * samples].reshape(height, width, samples)
        values = values if colour == INDEXED else values * 255
    elif bits[0] == 16:
        values = data.copy().view(order + "u2").reshape(height, width, samples).astype(np.int64)
    else:
        values = data.reshape(height, width, samples)
    if one(PREDICTOR, 1) == 2:
        values = np.cumsum(values.astype(np.int64), axis=1) & ((1 << bits[0]) - 1)
    values = values >> 8 if bits[0] == 16 and colour != INDEXED else values
    if colour == INDEXED:
        table = np.array(tags[PALETTE], np.int64).reshape(3, -1).T >> 8
        values = table[values[:, :, 0]]
    elif colour == RGB:
        values = values[:, :, :3]
    else:
        grey = values[:, :, :1]
        values = np.repeat(255 - grey if colour == WHITE_IS_ZERO else grey, 3, axis=2)
    return width, height, values.astype(np.uint8).tobytes()


# --- GIF --------------------------------------------------------------------


def _gif(content: bytes) -> Iterator[Frame]:
    """Every frame as it is shown: drawn over what the ones before have left.  What none has drawn is black."""
    width, height, flags = struct.unpack_from("<HHB", content, 6)
    at, common = 13, None
    if flags & 0x80:
        common, at = _table(content, at, flags)
    canvas = np.zeros((height, width, 3), np.uint8)
    clear, after = None, 0
    while content[at] != 0x3B:
        if content[at] == 0x21:
            if content[at + 1] == 0xF9:
                after, clear = content[at + 3] >> 2 & 7, content[at + 6] if content[at + 3] & 1 else None
            _, at = _sub_blocks(content, at + 2)
            continue
        if content[at] != 0x2C:
            raise ValueError("an unknown GIF block")
        x, y, w, h, own = struct.unpack_from("<HHHHB", content, at + 1)
        at, table = at + 10, common
        if own & 0x80:
            table, at = _table(content, at, own)
        if table is None:
            raise ValueError("a GIF frame without colours")
        data, at_next = _sub_blocks(content, at + 1)
        codes = np.frombuffer(lzw(data, content[at], True), np.uint8)
        if len(codes) < w * h or x + w > width or y + h > height:
            raise ValueError("a GIF frame that lacks pixels")
        at = at_next
        codes = codes[: w * h].reshape(h, w)
        if own & 0x40:  # rows in four passes
            straight = np.empty_like(codes)
            straight[[r for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(first, h, step)]] = codes
            codes = straight
        before, part = canvas.copy(), canvas[y : y + h, x : x + w]
        drawn = np.ones(codes.shape, bool) if clear is None else codes != clear
        part[drawn] = table[codes[drawn]]
        yield width, height, canvas.tobytes()
        if after == 2:
            part[:] = 0
        elif after == 3:
            canvas = before
        clear, after = None, 0


def _table(content: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 2 << (flags & 7)
    return np.frombuffer(content[at : at + 3 * n], np.uint8).reshape(n, 3), at + 3 * n


def _sub_blocks(content: bytes, at: int) -> tuple[bytes, int]:
    out = bytearray()
    while n := content[at]:
        out += content[at + 1 : at + 1 + n]
        at += 1 + n
    return bytes(out), at + 1
