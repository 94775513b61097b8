"""Metadata source: tag directories of JPEG, PNG and TIFF-structured bytes.

``directories(files)`` gives map<directory, map<tag, text>> for (path, content)
with the directories ifd0, sub_ifd, gps, icc, jpeg and png, as
``operators.metadata.exif_record`` reads them.  Bytes that break off or do not
parse give a null map and ``valid`` false.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tilewright.sources.psd import profile_name

# Tag numbers.
IFD0 = {0x010F: "Make", 0x0110: "Model", 0x0131: "Software"}
SUB_IFD = {
    0x829A: "ExposureTime",
    0x829D: "FNumber",
    0x8827: "IsoEquivalent",
    0x9003: "DateTimeOriginal",
    0x9209: "Flash",
    0xA001: "ColorSpace",
    0xA434: "LensModel",
    0x0103: "Compression",
}
GPS = {1: "LatitudeRef", 2: "Latitude", 3: "LongitudeRef", 4: "Longitude"}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
COLOR_SPACES = {1: "sRGB", 2: "Adobe RGB (1998)", 65535: "Undefined"}
SOF = {0xC0: "Baseline", 0xC1: "Extended sequential, Huffman", 0xC2: "Progressive, Huffman", 0xC3: "Lossless, Huffman"}
PNG_COLORS = {0: "Greyscale", 2: "True Color", 3: "Indexed Color", 4: "Greyscale with Alpha", 6: "True Color with Alpha"}


def _plain(v: float) -> str:
    return f"{v:.1f}".removesuffix(".0")


def _exposure(v: float) -> str:
    return f"1/{round(1 / v)} sec" if 0 < v < 0.5 else f"{_plain(v)} sec"


def _degrees(parts: list[float], ref: str) -> str:
    d, m, s = parts
    m, s = int(m), s + (m - int(m)) * 60
    return f"{'-' if ref in ('S', 'W') else ''}{int(d)}° {m}' {s:.2f}\""


class Tiff:
    def __init__(self, data: bytes):
        if data[:2] not in (b"II", b"MM"):
            raise ValueError("byte order")
        self.data, self.order = data, "<" if data[:2] == b"II" else ">"
        if self.read("H", 2) != 42:
            raise ValueError("magic number")

    def read(self, kind: str, at: int):
        return struct.unpack_from(self.order + kind, self.data, at)[0]

    def directory(self, at: int) -> dict[int, list]:
        out: dict[int, list] = {}
        for i in range(self.read("H", at)):
            entry = at + 2 + 12 * i
            tag, kind, n = self.read("H", entry), self.read("H", entry + 2), self.read("I", entry + 4)
            size = SIZES.get(kind, 0) * n
            if not size:
                continue
            start = entry + 8 if size <= 4 else self.read("I", entry + 8)
            if start + size > len(self.data):
                raise ValueError(f"tag {tag:#x} passes the end")
            if kind in (1, 2, 7):
                out[tag] = [self.data[start : start + n]]
            elif kind in (5, 10):
                pairs = struct.unpack_from(f"{self.order}{2 * n}{'I' if kind == 5 else 'i'}", self.data, start)
                out[tag] = [a / b if b else 0.0 for a, b in zip(pairs[::2], pairs[1::2])]
            else:
                out[tag] = list(struct.unpack_from(f"{self.order}{n}{ {3: 'H', 4: 'I', 9: 'i'}[kind]}", self.data, start))
        return out


def _text(v: list) -> str:
    return v[0].split(b"\0")[0].decode("utf-8", "replace").strip() if isinstance(v[0], bytes) else str(v[0])


def read_tiff(data: bytes, out: dict[str, dict[str, str]]) -> None:
    t = Tiff(data)
    first = t.directory(t.read("I", 4))
    out["ifd0"] = {n: _text(first[k]) for k, n in IFD0.items() if k in first}
    if 0x8769 in first:
        sub = t.directory(first[0x8769][0])
        show = {
            "ExposureTime": lambda v: _exposure(v[0]),
            "FNumber": lambda v: f"f/{_plain(v[0])}",
            "Flash": lambda v: "Flash fired" if v[0] & 1 else "Flash did not fire",
            "ColorSpace": lambda v: COLOR_SPACES.get(v[0], str(v[0])),
        }
        out["sub_ifd"] = {n: show.get(n, _text)(sub[k]) for k, n in SUB_IFD.items() if k in sub}
    if 0x8825 in first:
        g = {n: v for k, v in t.directory(first[0x8825][0]).items() if (n := GPS.get(k))}
        out["gps"] = {n: _degrees(g[n], _text(g.get(n + "Ref", [b""]))) for n in ("Latitude", "Longitude") if len(g.get(n, ())) == 3}
    if 0x8773 in first:
        read_icc(first[0x8773][0], out)


def read_icc(data: bytes, out: dict[str, dict[str, str]]) -> None:
    found = {"ColorSpace": data[16:20].decode("ascii", "replace").strip(), "Description": profile_name(data)}
    out["icc"] = {k: v for k, v in found.items() if v}


def read_jpeg(data: bytes, out: dict[str, dict[str, str]]) -> None:
    at, icc = 2, {}
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if marker == 0xDA:
            break
        if marker == 0xE1 and body[:6] == b"Exif\0\0":
            read_tiff(body[6:], out)
        elif marker == 0xE2 and body[:12] == b"ICC_PROFILE\0":
            icc[body[12]] = body[14:]
        elif marker in SOF:
            out["jpeg"] = {"Compression": SOF[marker]}
        at += 2 + size
    if icc:
        read_icc(b"".join(icc[k] for k in sorted(icc)), out)


def read_png(data: bytes, out: dict[str, dict[str, str]]) -> None:
    at, png = 8, {}
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(body) < size:
            raise ValueError("chunk passes the end")
        if kind == b"IHDR":
            png |= {"BitsPerSample": str(body[8]), "ColorType": PNG_COLORS.get(body[9], str(body[9])), "Compression": "Deflate"}
        elif kind == b"iCCP":
            name, packed = body.split(b"\0", 1)
            png["IccProfile"] = name.decode("latin-1")
            read_icc(zlib.decompress(packed[1:]), out)
        elif kind == b"eXIf":
            read_tiff(body, out)
        elif kind == b"IEND":
            break
        at += 12 + size
    out["png"] = png


def read_directories(data: bytes) -> dict[str, dict[str, str]]:
    out: dict[str, dict[str, str]] = {}
    if data[:2] == b"\xff\xd8":
        read_jpeg(data, out)
    elif data[:8] == b"\x89PNG\r\n\x1a\n":
        read_png(data, out)
    elif data[:2] in (b"II", b"MM"):
        read_tiff(data, out)
    return out


_KIND = pa.map_(pa.string(), pa.map_(pa.string(), pa.string()))


def directories(files: DataFrame) -> DataFrame:
    """path, directories, valid for (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maps, valid = [], []
            for data in b.column("content").to_pylist():
                try:
                    found = read_directories(data or b"")
                    maps.append([(k, list(v.items())) for k, v in found.items()])
                    valid.append(True)
                except (ValueError, IndexError, KeyError, struct.error, zlib.error):
                    maps.append(None)
                    valid.append(False)
            yield pa.record_batch([b.column("path"), pa.array(maps, _KIND), pa.array(valid)], names=["path", "directories", "valid"])

    return files.select("path", "content").mapInArrow(run, "path string, directories map<string,map<string,string>>, valid boolean")
