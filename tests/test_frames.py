"""Frames of TIFF and GIF chains, and resizing, beside plain loops."""

import struct
import zlib

import pytest

from corvane.functions import files as fx
from corvane.sources import files as sources
from corvane.sources.frames import frames, lzw, packbits


def tiff(pictures, order="<"):
    """pictures: (width, height, tags beside the sizes, strips); a chain of directories."""
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 0))
    link = 4
    for width, height, tags, strips in pictures:
        starts = []
        for s in strips:
            starts.append(len(out))
            out += s
        every = {256: [width], 257: [height], 273: starts, 279: [len(s) for s in strips], **tags}
        values = {}
        for tag, xs in every.items():
            if len(xs) > 1:
                values[tag] = len(out)
                out += struct.pack(f"{order}{len(xs)}I", *xs)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(every))
        for tag in sorted(every):
            out += struct.pack(order + "HHII", tag, 4, len(every[tag]), values.get(tag, every[tag][0]))
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


def packed(codes, low_first):
    """(code, width) pairs as bytes."""
    bits = "".join(f"{c:0{w}b}"[::-1] if low_first else f"{c:0{w}b}" for c, w in codes)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[k : k + 8][::-1] if low_first else bits[k : k + 8], 2) for k in range(0, len(bits), 8))


def compressed(data, bits, low_first):
    """LZW with a table that grows, as writers make it."""
    clear = 1 << bits
    table, width, codes, word = {bytes([k]): k for k in range(clear)}, bits + 1, [(clear, bits + 1)], b""
    size, early = clear + 2, 0 if low_first else 1
    for k in range(len(data)):
        if word + data[k : k + 1] in table:
            word += data[k : k + 1]
            continue
        codes.append((table[word], width))
        if size < 4096:
            table[word + data[k : k + 1]] = size
            size += 1
            if size - (not early) >= 1 << width and width < 12:
                width += 1
        word = data[k : k + 1]
    codes.append((table[word], width))
    if size - (not early) + 1 >= 1 << width and width < 12:
        width += 1
    return packed([*codes, (clear + 1, width)], low_first)


def gif(parts, width, height, table):
    """parts: (x, y, w, h, codes, disposal, clear colour or None, in passes)."""
    out = b"GIF89a" + struct.pack("<HHBBB", width, height, 0x80 | 1, 0, 0) + bytes(v for c in table for v in c)
    for x, y, w, h, codes, after, clear, passes in parts:
        out += b"\x21\xf9\x04" + struct.pack("<BHB", after << 2 | (clear is not None), 0, clear or 0) + b"\0"
        data = compressed(bytes(codes), 2, True)
        blocks = b"".join(bytes([len(data[k : k + 255])]) + data[k : k + 255] for k in range(0, len(data), 255))
        out += b"\x2c" + struct.pack("<HHHHB", x, y, w, h, 0x40 if passes else 0) + b"\x02" + blocks + b"\0"
    return out + b"\x21\xfe\x03abc\0\x3b"


RED, GREEN, BLUE, WHITE = (255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 255)


def pixels(*colours):
    return bytes(v for c in colours for v in c)


@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_directories(order):
    rgb = pixels(RED, GREEN, BLUE, WHITE, RED, GREEN)
    colour = {258: [8, 8, 8], 262: [2], 277: [3]}
    turned = bytes((rgb[k] - (rgb[k - 3] if k % 9 >= 3 else 0)) % 256 for k in range(18))
    long = bytes((k * k // 7) % 251 for k in range(3 * 90 * 40))
    found = frames(
        tiff(
            [
                (3, 2, {**colour, 278: [1]}, [rgb[:9], rgb[9:]]),
                (3, 2, {**colour, 259: [8], 317: [2]}, [zlib.compress(turned)]),
                (3, 2, {258: [8], 259: [32773], 262: [1]}, [b"\xfe\x07" + b"\x02\x01\x02\x03"]),
                (4, 1, {258: [1], 262: [0]}, [b"\xa0"]),
                (2, 1, {258: [8], 262: [3], 320: [0, 65535, *[0] * 254, 65535, 0, *[0] * 254, *[0] * 256]}, [b"\x01\x00"]),
                (90, 40, {**colour, 259: [5], 278: [20]}, [compressed(long[: len(long) // 2], 8, False), compressed(long[len(long) // 2 :], 8, False)]),
            ],
            order,
        )
    )
    assert found[0] == found[1] == (3, 2, rgb)
    assert found[2] == (3, 2, bytes(v for x in (7, 7, 7, 1, 2, 3) for v in (x, x, x)))
    assert found[3] == (4, 1, bytes(v for x in (0, 255, 0, 255) for v in (x, x, x)))
    assert found[4] == (2, 1, pixels((255, 0, 0), (0, 255, 0)))
    assert found[5] == (90, 40, long)


def test_gif_blocks():
    table = [RED, GREEN, BLUE, WHITE]
    first = [0, 1, 2, 3] * 4
    found = frames(gif([(0, 0, 4, 4, first, 1, None, False), (1, 1, 2, 2, [3, 2, 2, 3], 2, 2, False), (0, 0, 4, 4, [1] * 16, 3, 1, False), (0, 0, 1, 1, [3], 0, None, False)], 4, 4, table))
    shown = [[table[k] for k in first]]
    shown.append(list(shown[0]))
    shown[1][5], shown[1][10] = WHITE, WHITE
    shown.append(list(shown[1]))
    for k in (5, 6, 9, 10):
        shown[2][k] = (0, 0, 0)
    shown.append([WHITE, *shown[2][1:]])
    assert found == [(4, 4, pixels(*s)) for s in shown]
    rows = [[k % 4] * 3 for k in range(9)]
    order = [r for a, s in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(a, 9, s)]
    assert frames(gif([(0, 0, 3, 9, [c for r in order for c in rows[r]], 0, None, True)], 3, 9, table))[0][2] == pixels(*(table[c] for r in rows for c in r))


def test_lzw_of_any_length_and_broken_files():
    for n in (1, 5, 600, 5000, 40_000):
        data = bytes((k * k // 3 + k // 200) % 256 for k in range(n))
        assert lzw(compressed(data, 8, True), 8, True) == data and lzw(compressed(data, 8, False), 8, False) == data
    assert packbits(b"\x80\x01ab\xff\x07") == b"ab\x07\x07"
    whole = tiff([(1, 1, {258: [8, 8, 8], 262: [2], 277: [3]}, [b"abc"])])
    for bad in (b"", b"nothing", whole[:30], b"GIF89a\1\0", whole.replace(struct.pack("<I", 2), struct.pack("<I", 6))):
        with pytest.raises(ValueError):
            frames(bad)
    loop = bytearray(whole)
    loop[-4:] = loop[4:8]
    assert len(frames(bytes(loop))) == 1


def test_a_row_a_frame(spark, tmp_path):
    from corvane.operators import embedders, engine, index

    (tmp_path / "a.TIF").write_bytes(tiff([(1, 1, {258: [8, 8, 8], 262: [2], 277: [3]}, [pixels(c)]) for c in (RED, BLUE)]))
    (tmp_path / "b.gif").write_bytes(gif([(0, 0, 1, 1, [1], 0, None, False)] * 3, 1, 1, [RED, GREEN, BLUE, WHITE]))
    (tmp_path / "c.gif").write_bytes(b"GIF89a")
    (tmp_path / "d.bmp").write_bytes(b"BM" + struct.pack("<IHHIIiiHHIIiiII", 58, 0, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\x00\xff\x00\0")
    found = sources.read_images(spark, str(tmp_path)).collect()
    assert sorted((r["file"][-5:], r["page"], bytes(r["pixels"])) for r in found) == [("a.TIF", 1, pixels(RED)), ("a.TIF", 2, pixels(BLUE)), *(("b.gif"[-5:], k, pixels(GREEN)) for k in (1, 2, 3)), ("d.bmp", 1, pixels(GREEN))]
    docs = spark.createDataFrame([("d", "v", "a.tif", "tiff", (tmp_path / "a.TIF").read_bytes())], "doc_id string, version_id string, file string, format string, content binary")
    own = engine.Engine(embedders.get_embedder("deterministic", dim=4, num_tokens=2), index.IndexStore(spark, str(tmp_path / "index"))).index(docs)
    assert sorted(r["page"] for r in own.store.load().collect()) == [1, 2]


def test_resizing_is_the_mean_of_areas(spark):
    made = [(k, w, h, bytes((k * 31 + j * j) % 256 for j in range(w * h * 3))) for k, (w, h) in enumerate([(7, 3), (4, 4), (3, 9), (1, 12), (5, 5), (2, 2)])]
    df = spark.createDataFrame([*made, (99, 2, 2, b"abc"), (98, 2, 2, None)], "id int, width int, height int, pixels binary")
    got = {r["id"]: r for r in sources.resized(df, 4).collect()}
    sizes = {r["id"]: (r["s"]["width"], r["s"]["height"]) for r in df.select("id", fx.fitted(df.width, df.height, 4).alias("s")).collect()}
    for k, w, h, data in made:
        a, b = sizes[k]
        wanted = []
        for y in range(b):
            for x in range(a):
                for c in range(3):
                    total = 0.0
                    for j in range(h):
                        for i in range(w):
                            share = max(0, min((y + 1) * h / b, j + 1) - max(y * h / b, j)) * max(0, min((x + 1) * w / a, i + 1) - max(x * w / a, i))
                            total += share * data[(j * w + i) * 3 + c]
                    wanted.append(total * a * b / (w * h))
        assert (got[k]["width"], got[k]["height"]) == (a, b) and len(got[k]["pixels"]) == a * b * 3
        assert all(abs(x - y) <= 0.5 + 1e-6 for x, y in zip(got[k]["pixels"], wanted))
    assert got[99]["pixels"] is None and got[98]["pixels"] is None
