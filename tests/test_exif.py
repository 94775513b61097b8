"""Tag bytes made here, read by the metadata source."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tilewright.functions import text
from tilewright.operators import metadata
from tilewright.sources import exif


def tiff(order="<"):
    """A directory with a sub directory and a place."""
    o = order
    data = bytearray(400)
    struct.pack_into(o + "2sHI", data, 0, b"II" if o == "<" else b"MM", 42, 8)

    def entries(at, rows):
        struct.pack_into(o + "H", data, at, len(rows))
        for i, (tag, kind, n, value) in enumerate(rows):
            struct.pack_into(o + "HHI", data, at + 2 + 12 * i, tag, kind, n)
            struct.pack_into(o + ("H" if kind == 3 and n == 1 else "4s" if isinstance(value, bytes) else "I"), data, at + 10 + 12 * i, value)

    entries(8, [(0x010F, 2, 6, 200), (0x8769, 4, 1, 80), (0x8825, 4, 1, 140)])
    data[200:206] = b"Maker\0"
    entries(80, [(0x829A, 5, 1, 210), (0x829D, 5, 1, 218), (0x8827, 3, 1, 400), (0x9209, 3, 1, 1)])
    struct.pack_into(o + "IIII", data, 210, 1, 125, 28, 10)
    entries(140, [(1, 2, 2, b"S\0\0\0"), (2, 5, 3, 240)])
    struct.pack_into(o + "6I", data, 240, 33, 1, 30, 1, 15, 1)
    return bytes(data)


def jpeg(body):
    app = b"Exif\0\0" + body
    sof = struct.pack(">BHHB", 8, 1, 1, 1) + b"\1\x11\0"
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app) + 2) + app + b"\xff\xc2" + struct.pack(">H", len(sof) + 2) + sof + b"\xff\xda\0\2"


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + b"\0\0\0\0"


def icc():
    body = b"desc\0\0\0\0" + struct.pack(">I", 3) + b"P3\0"
    return b"\0" * 16 + b"RGB " + b"\0" * 108 + struct.pack(">I4sII", 1, b"desc", 144, len(body)) + body


@pytest.mark.parametrize("order", "<>")
def test_jpeg(order):
    d = exif.read_directories(jpeg(tiff(order)))
    assert d["ifd0"] == {"Make": "Maker"} and d["jpeg"] == {"Compression": "Progressive, Huffman"}
    assert d["sub_ifd"] == {"ExposureTime": "1/125 sec", "FNumber": "f/2.8", "IsoEquivalent": "400", "Flash": "Flash fired"}
    assert d["gps"] == {"Latitude": "-33° 30' 15.00\""}


def test_records(spark):
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 6, 0, 0, 0)) + chunk(b"iCCP", b"mine\0\0" + zlib.compress(icc())) + chunk(b"IEND", b"")
    files = [("j", jpeg(tiff())), ("p", png), ("cut", jpeg(tiff()[:100])), ("none", b"plain"), ("empty", None)]
    df = exif.directories(spark.createDataFrame(files, "path string, content binary"))
    out = {r.path: r for r in df.select("path", "valid", metadata.exif_record(F.col("directories")).alias("e"), text.exif_report(metadata.exif_record(F.col("directories")), F.col("valid")).alias("l")).collect()}
    assert out["j"].e.make == "Maker" and out["j"].e.compression == "Progressive, Huffman" and out["j"].e.iso == "400"
    assert (out["p"].e.icc_profile, out["p"].e.color_space, out["p"].e.color_depth, out["p"].e.color_type) == ("P3", "RGB", "8", "True Color with Alpha")
    assert not out["cut"].valid and out["cut"].l == ["<f>Failed to parse EXIF metadata.</>"]
    assert out["none"].valid and out["none"].l == ["<f>No recognized EXIF metadata</>"] == out["empty"].l
