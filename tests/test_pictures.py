"""TIFF and icons against pictures that the JVM's own writers made."""

import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tilewright.sources import icons, pixels, tiff

GREY, RGB, RGBA, BINARY = 10, 1, 2, 12  # BufferedImage types


def written(spark, px, kind, form, how=None):
    """Bytes of a picture (h x w array of packed ARGB ints) by javax.imageio."""
    jvm = spark._jvm
    h, w = px.shape
    image = jvm.java.awt.image.BufferedImage(w, h, kind)
    for y in range(h):
        for x in range(w):
            image.setRGB(x, y, int(np.int32(np.uint32(px[y, x]))) if px[y, x] < 1 << 31 else int(px[y, x]) - (1 << 32))
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName(form).next()
    params = writer.getDefaultWriteParam()
    if how:
        params.setCompressionMode(2)
        params.setCompressionType(how)
    out = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), params)
    stream.close()
    shown = [[image.getRGB(x, y) & 0xFFFFFFFF for x in range(w)] for y in range(h)]
    argb = np.array(shown, np.uint32)
    rgba = np.stack([argb >> s & 255 for s in (16, 8, 0, 24)], -1).astype(np.uint8)
    return bytes(out.toByteArray()), rgba, np.array([[image.getRaster().getSample(x, y, 0) for x in range(w)] for y in range(h)])


def picture(kind, h=21, w=37):
    rng = np.random.RandomState(kind)
    px = rng.randint(0, 1 << 24, (h, w)).astype(np.int64) | 255 << 24
    px[5:9] = px[5, 0]  # runs
    if kind == RGBA:
        px = px & 0xFFFFFF | rng.choice([0, 128, 255], (h, w)) << 24
    return px


@pytest.mark.parametrize("how", [None, "LZW", "ZLib", "Deflate", "PackBits"])
@pytest.mark.parametrize("kind", [GREY, RGB, RGBA, BINARY])
def test_tiff(spark, kind, how):
    data, rgba, first = written(spark, picture(kind), kind, "tiff", how)
    got = tiff.read_tiff(data)
    if kind == GREY:  # the JVM shows grey through a colour space of its own
        assert (got[..., 0] == first).all() and (got[..., 1] == first).all()
    else:
        assert (got == rgba).all()


def ifd(order, entries, rest):
    """A TIFF of 16-bit numbers; an entry's long list stands after the directory."""
    head = {"<": b"II*\0", ">": b"MM\0*"}[order] + struct.pack(order + "I", 8)
    at, body, more = 8 + 2 + 12 * len(entries) + 4, b"", b""
    for tag, values in entries:
        raw = struct.pack(f"{order}{len(values)}H", *values)
        if len(raw) > 4:
            body += struct.pack(order + "HHII", tag, 3, len(values), at + len(more))
            more += raw
        else:
            body += struct.pack(order + "HHI", tag, 3, len(values)) + raw.ljust(4, b"\0")
    assert at + len(more) <= 200
    return (head + struct.pack(order + "H", len(entries)) + body + bytes(4) + more).ljust(200, b"\0") + rest


@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_by_hand(order):
    # two samples of 16 bits, differences along a line
    px = np.array([[0, 65535, 32768], [1, 2, 257 * 9]], order + "u2")
    coded = np.diff(px.astype(np.int64), axis=1, prepend=0).astype(order + "u2").tobytes()
    packed = zlib.compress(coded)
    data = ifd(order, [(256, [3]), (257, [2]), (258, [16]), (259, [8]), (262, [1]), (273, [200]), (278, [2]), (279, [len(packed)]), (317, [2])], packed)
    assert tiff.read_tiff(data)[..., 0].tolist() == [[0, 255, 128], [0, 0, 9]]
    # planes apart, tiles of 2 x 2 of a picture of 3 x 1
    rest = b"".join(bytes((10 * p + t, 10 * p + t + 1, 99, 99)) for p in range(3) for t in (1, 3))
    tiles = [(256, [3]), (257, [1]), (258, [8, 8, 8]), (262, [2]), (277, [3]), (284, [2]), (322, [2]), (323, [2]), (324, [200 + 4 * i for i in range(6)]), (325, [4] * 6)]
    assert tiff.read_tiff(ifd(order, tiles, rest))[0].tolist() == [[1, 11, 21, 255], [2, 12, 22, 255], [3, 13, 23, 255]]
    # two bits with a palette
    table = [257 * v for v in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12)]
    indexed = [(256, [3]), (257, [1]), (258, [2]), (262, [3]), (273, [200]), (279, [1]), (320, table)]
    assert tiff.read_tiff(ifd(order, indexed, b"\x1b"))[0, :, :3].tolist() == [[1, 5, 9], [2, 6, 10], [3, 7, 11]]


@pytest.mark.parametrize("kind", [GREY, RGB, RGBA, BINARY])
def test_png(spark, kind):
    data, rgba, first = written(spark, picture(kind), kind, "png")
    got = icons.read_png(data)
    assert (got[..., 0] == first).all() if kind == GREY else (got == rgba).all()


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    rng = np.random.RandomState(kind)
    px = rng.randint(0, 256, (6, 5, 4))
    rows = b""
    for y in range(6):
        rows += bytes((kind,))
        for i in range(20):
            at = lambda yy, ii: int(px[yy].ravel()[ii]) if yy >= 0 and ii >= 0 else 0
            a, b, c = at(y, i - 4), at(y - 1, i), at(y - 1, i - 4)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            rows += bytes(((at(y, i) - (0, a, b, (a + b) // 2, paeth)[kind]) & 255,))
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + bytes(4)
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 6, 8, 6, 0, 0, 0))
    data = b"\x89PNG\r\n\x1a\n" + head + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    assert (icons.read_png(data) == px).all()


def dib(w, h, bits, lines, mask, palette=b""):
    return struct.pack("<IiiHHIIiiII", 40, w, 2 * h, 1, bits, 0, 0, 0, 0, len(palette) // 4, 0) + palette + lines + mask


def ico(*pictures):
    at, head, body = 6 + 16 * len(pictures), struct.pack("<HHH", 0, 1, len(pictures)), b""
    for w, h, bits, data in pictures:
        head += struct.pack("<BBBBHHII", w, h, 0, 0, 1, bits, len(data), at + len(body))
        body += data
    return head + body


def test_icons(spark):
    small = dib(1, 1, 24, b"\1\2\3\0", bytes(4))
    # bottom line first; the second pixel of the top line is clear
    four = dib(2, 2, 4, b"\x01\0\0\0\x10\0\0\0", b"\0\0\0\0\x40\0\0\0", b"\x0a\x0b\x0c\0\x14\x15\x16\0")
    got = icons.read_ico(ico((1, 1, 24, small), (2, 2, 4, four)))
    dark, light = [12, 11, 10], [22, 21, 20]
    assert got.tolist() == [[[*light, 255], [*dark, 0]], [[*dark, 255], [*light, 255]]]
    assert icons.read_ico(ico((1, 1, 24, small))).tolist() == [[[3, 2, 1, 255]]]
    assert icons.read_ico(ico((1, 1, 32, dib(1, 1, 32, b"\1\2\3\x50", bytes(4))))).tolist() == [[[3, 2, 1, 80]]]
    data, rgba, _ = written(spark, picture(RGBA), RGBA, "png")
    assert (icons.read_ico(ico((2, 2, 4, four), (37, 21, 32, data))) == rgba).all()
    files = [("i", "Ico", ico((2, 2, 4, four))), ("t", "Tiff", b"MM\0*"), ("e", "Ico", b""), ("w", "Webp", b"")]
    out = {r.path: r for r in pixels.surfaces(spark.createDataFrame(files, "path string, format string, content binary")).collect()}
    assert (out["i"].width, out["i"].height, out["i"].error) == (2, 2, None)
    assert out["t"].error and out["e"].error and "libwebp" in out["w"].error


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 259), st.binary(min_size=1, max_size=4), st.integers(0, 260))
def test_broken_files_are_errors(at, junk, end):
    rest = bytes(range(60))
    data = ifd("<", [(256, [5]), (257, [4]), (258, [8, 8, 8]), (259, [5]), (262, [2]), (273, [200]), (277, [3]), (278, [4]), (279, [60])], rest)
    icon = ico((2, 2, 4, dib(2, 2, 4, bytes(8), bytes(8), bytes(64))))
    for read, whole in ((tiff.read_tiff, data), (icons.read_ico, icon)):
        broken = (whole[:at] + junk + whole[at + len(junk) :])[: max(end, 0)]
        try:
            assert read(broken).shape[-1] == 4
        except (ValueError, struct.error):
            pass
