"""Layered documents (PSD, PSB): header, section index, planes.

The header is read with column expressions alone, so a listing of headers does
not start Python.  The index and the scanlines come from Arrow functions over
``content`` (Spark's ``binaryFile``): the index first lists byte ranges of
scanlines as rows, filters and projections on those rows are ordinary Spark, and
only the ranges that are left are decoded.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import binary

# Fixed values of the format.
SIGNATURE = b"8BPS"
BLOCK_SIGNATURES = (b"8BIM", b"8B64")
RESOURCE_SIGNATURE = b"8BIM"
ICC_RESOURCE = 0x040F
LONG_KEYS = (b"LMFX", b"LFX2", b"PATT", b"PAT2", b"FMsp", b"Shmd")
MODES = {0: "Bitmap", 1: "Grayscale", 2: "Indexed", 3: "Rgb", 4: "Cmyk", 7: "Multichannel", 8: "Duotone", 9: "Lab"}
COMPRESSIONS = {0: "Raw", 1: "Rle", 2: "Zip", 3: "ZipPredict"}
ROLES = {
    "Rgb": ("R", "G", "B"),
    "Cmyk": ("C", "M", "Y", "K"),
    "Grayscale": ("Gray",),
    "Indexed": ("Index",),
    "Duotone": ("Gray",),
    "Lab": ("L", "LabA", "LabB"),
}
MAX_CHANNELS = 56
MAX_PACKED_ROW = 16 << 20


class Malformed(ValueError):
    pass


def roles_of(mode: str, channels: int) -> tuple[str, ...]:
    """Roles of the leading planes; one extra channel is alpha, more are dropped."""
    if channels <= 0:
        raise Malformed(f"channel count {channels}")
    if mode == "Multichannel":
        return ("Gray",) + ("Spot",) * (channels - 1)
    if mode not in ROLES:
        raise Malformed(f"colour mode {mode} has no planes")
    base = ROLES[mode]
    return base if channels == len(base) else (*base, "A")


def header(content: Column) -> Column:
    """struct(version, channels, height, width, depth, mode, mode_name, error)."""
    u = lambda at, n: binary.unsigned(content, at, n)
    version, channels, height, width = u(4, 2), u(12, 2), binary.signed(content, 14, 4), binary.signed(content, 18, 4)
    names = F.create_map(*[F.lit(x) for kv in MODES.items() for x in kv])
    error = (
        F.when(~F.coalesce(binary.starts_with(content, SIGNATURE), F.lit(False)), "signature")
        .when(u(24, 2).isNull(), "truncated")
        .when(~version.isin(1, 2), F.concat(F.lit("version "), version.cast("string")))
        .when((height <= 0) | (width <= 0), "dimensions")
        .when((channels == 0) | (channels > MAX_CHANNELS), "channels")
    )
    mode = u(24, 2)
    return F.struct(
        version.alias("version"), channels.alias("channels"), height.alias("height"), width.alias("width"),
        u(22, 2).alias("depth"), mode.alias("mode"), names[mode.cast("int")].alias("mode_name"), error.alias("error"),
    )


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise Malformed(f"needs {n} bytes at {self.at}")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, kind: str) -> int:
        return struct.unpack(">" + kind, self.take(struct.calcsize(kind)))[0]

    def skip(self, n: int) -> None:
        self.take(n)


def pascal(r: Reader, pad: int = 2) -> str:
    n = r.number("B")
    text = r.take(n)
    r.skip(-(1 + n) % pad)
    return text.decode("ascii", "replace")


def utf16(r: Reader) -> str:
    n = r.number("i")
    return r.take(2 * n).decode("utf-16-be") if n > 0 else ""


def read_index(data: bytes) -> dict:
    """All sections by offset and length; payloads are passed over."""
    r = Reader(data)
    if r.take(4) != SIGNATURE:
        raise Malformed("signature")
    version = r.number("H")
    if version not in (1, 2):
        raise Malformed(f"version {version}")
    big = version == 2
    r.skip(6)
    channels, height, width, depth, mode = (r.number(k) for k in "HiiHH")
    if width <= 0 or height <= 0 or not 0 < channels <= MAX_CHANNELS:
        raise Malformed("dimensions or channels")
    palette = r.take(r.number("I"))
    end = r.at + 4 + struct.unpack(">I", data[r.at : r.at + 4].ljust(4, b"\0"))[0]
    r.skip(4)
    resources = []
    while r.at < end:
        if r.take(4) != RESOURCE_SIGNATURE:
            raise Malformed("resource signature")
        number, name, size = r.number("H"), pascal(r), r.number("I")
        resources.append({"id": number, "name": name, "size": size, "offset": r.at})
        if r.at + size > end:
            raise Malformed(f"resource {number} passes its section")
        r.skip(size + (size & 1))
    if r.at != end:
        raise Malformed("resources misaligned")
    wide = "Q" if big else "I"
    length = r.number(wide)
    end, layers, blocks = r.at + length, 0, []
    if end > len(data):
        raise Malformed("layer section")
    if length:
        size = r.number(wide)
        stop = r.at + size
        if stop > end:
            raise Malformed("layer info")
        layers = r.number("h") if size >= 2 else 0
        r.at = stop
        if r.at < end:
            size = r.number("I")
            if r.at + size > end:
                raise Malformed("global mask")
            r.skip(size)
            while end - r.at >= 8 and data[r.at : r.at + 4] in BLOCK_SIGNATURES:
                r.skip(4)
                key = r.take(4)
                size = r.number("Q" if big and key in LONG_KEYS else "I")
                if r.at + size + (size & 1) > end:
                    raise Malformed(f"block {key!r} passes its section")
                blocks.append({"key": key.decode("latin-1"), "offset": r.at, "size": size})
                r.skip(size + (size & 1))
        r.at = end
    compression = r.number("H")
    return {
        "version": version, "channels": channels, "height": height, "width": width, "depth": depth, "mode": MODES.get(mode, str(mode)),
        "palette": palette, "resources": resources, "layers": abs(layers), "merged_alpha": layers < 0, "blocks": blocks,
        "compression": COMPRESSIONS.get(compression, str(compression)), "offset": r.at, "length": len(data) - r.at, "error": None,
    }


INDEX_SCHEMA = (
    "version int, channels int, height int, width int, depth int, mode string, palette binary, "
    "resources array<struct<id:int,name:string,size:bigint,offset:bigint>>, layers int, merged_alpha boolean, "
    "blocks array<struct<key:string,offset:bigint,size:bigint>>, compression string, offset long, length long, error string"
)
_ARROW_INDEX = pa.schema([
    ("version", pa.int32()), ("channels", pa.int32()), ("height", pa.int32()), ("width", pa.int32()), ("depth", pa.int32()), ("mode", pa.string()),
    ("palette", pa.binary()), ("resources", pa.list_(pa.struct([("id", pa.int32()), ("name", pa.string()), ("size", pa.int64()), ("offset", pa.int64())]))),
    ("layers", pa.int32()), ("merged_alpha", pa.bool_()), ("blocks", pa.list_(pa.struct([("key", pa.string()), ("offset", pa.int64()), ("size", pa.int64())]))),
    ("compression", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("error", pa.string()),
])


def index(files: DataFrame) -> DataFrame:
    """path and the section index of (path, content); a malformed file has ``error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for data in b.column("content"):
                try:
                    rows.append(read_index(memoryview(data.as_buffer()).tobytes()))
                except (Malformed, struct.error) as e:
                    rows.append({"error": str(e) or "malformed"})
            made = pa.RecordBatch.from_pylist(rows, schema=_ARROW_INDEX)
            yield pa.RecordBatch.from_arrays([b.column("path"), *made.columns], names=["path", *_ARROW_INDEX.names])

    return files.select("path", "content").mapInArrow(run, "path string, " + INDEX_SCHEMA)


def resource(index_row: Column, number: int) -> Column:
    """The first resource block with this id."""
    return F.get(F.filter(index_row, lambda b: b["id"] == number), F.lit(0))


def unpack_bits(packed: bytes, width: int) -> bytes:
    """One run-length coded scanline; a short one is filled with zeros."""
    out, at = bytearray(), 0
    while at < len(packed) and len(out) < width:
        n = packed[at]
        at += 1
        if n < 128:
            out += packed[at : at + n + 1]
            at += n + 1
        elif n > 128 and at < len(packed):
            out += packed[at : at + 1] * (257 - n)
            at += 1
    return bytes(out[:width]).ljust(width, b"\0")


def undo_predictor(row: np.ndarray) -> np.ndarray:
    return np.cumsum(row, axis=-1, dtype=np.uint64).astype(np.uint8)


def scanline_ranges(doc: dict, data: bytes) -> np.ndarray:
    """offset and packed length of each scanline, planes one after another (for
    raw and run-length data)."""
    h, w, n = doc["height"], doc["width"], doc["channels"]
    start = doc["offset"]
    if doc["compression"] == "Raw":
        return np.stack([start + np.arange(n * h, dtype=np.int64) * w, np.full(n * h, w, np.int64)], 1)
    kind = ">u4" if doc["version"] == 2 else ">u2"
    size = np.dtype(kind).itemsize * n * h
    if start + size > len(data):
        raise Malformed("row table")
    counts = np.frombuffer(data, kind, n * h, start).astype(np.int64)
    if counts.max(initial=0) > MAX_PACKED_ROW:
        raise Malformed("packed row")
    return np.stack([start + size + np.cumsum(counts) - counts, counts], 1)


def decode_rows(doc: dict, data: bytes, y0: int = 0, y1: int | None = None) -> Iterator[tuple[int, str, int, bytes]]:
    """(plane, role, y, scanline) of the planes that have roles, rows y0 to y1."""
    if doc["depth"] != 8:
        raise Malformed(f"{doc['depth']} bits a channel")
    h, w = doc["height"], doc["width"]
    y1 = h if y1 is None else min(y1, h)
    roles = roles_of(doc["mode"], doc["channels"])
    kind = doc["compression"]
    if kind in ("Raw", "Rle"):
        ranges = scanline_ranges(doc, data)
        for p, role in enumerate(roles[: doc["channels"]]):
            for y in range(y0, y1):
                at, n = ranges[p * h + y].tolist()
                if at + n > len(data):
                    raise Malformed("image data")
                part = data[at : at + n]
                yield p, role, y, part if kind == "Raw" else unpack_bits(part, w)
        return
    if kind not in ("Zip", "ZipPredict"):
        raise Malformed(f"compression {kind}")
    try:
        raw = zlib.decompressobj().decompress(data[doc["offset"] :], doc["channels"] * h * w)
    except zlib.error as e:
        raise Malformed(str(e)) from None
    if len(raw) < len(roles) * h * w:
        raise Malformed("image data")
    planes = np.frombuffer(raw, np.uint8, len(roles) * h * w).reshape(len(roles), h, w)
    for p, role in enumerate(roles):
        part = planes[p, y0:y1]
        part = undo_predictor(part) if kind == "ZipPredict" else part
        for y, row in enumerate(part, y0):
            yield p, role, y, row.tobytes()


PLANE_ROWS = "path string, plane int, role string, y int, row binary, error string"


def plane_rows(files: DataFrame, band: int | None = None) -> DataFrame:
    """Scanlines of (path, content), and one row with ``error`` for a file that
    cannot be decoded.  With ``band`` a file is dealt out once a band of so many
    rows, with a copy of its content, over many tasks, so that raw and run-length
    data decode in parallel."""
    rows = files.select("path", "content")
    if band:
        h = F.greatest(F.lit(1), F.coalesce(header(F.col("content"))["height"], F.lit(1)).cast("int"))
        bands = F.explode(F.sequence(F.lit(0), h - 1, F.lit(band))).alias("y0")
        spark = files.sparkSession
        tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        # a fixed number, as small bands would be put together again
        rows = files.select("path", "content", bands).repartition(tasks, "path", "y0")
    else:
        rows = rows.withColumn("y0", F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "plane", "role", "y", "row", "error"]
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.string()]
        for b in batches:
            for path, content, y0 in zip(b.column("path").to_pylist(), b.column("content"), b.column("y0").to_pylist()):
                data, out = memoryview(content.as_buffer()).tobytes(), []
                try:
                    doc = read_index(data)
                    for x in decode_rows(doc, data, y0, y0 + band if band else None):
                        out.append((path, *x, None))
                        if len(out) == 4096:
                            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                            out = []
                except (Malformed, struct.error) as e:
                    out = [(path, None, None, y0, None, str(e) or "malformed")]
                if out:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return rows.select("path", "content", "y0").mapInArrow(run, PLANE_ROWS)


def profile_name(icc: bytes) -> str | None:
    """Name of an ICC profile: 'desc' text, or 'mluc' (en-US first, else the first
    that is not empty)."""
    try:
        n = struct.unpack(">I", icc[128:132])[0]
        tags = {icc[132 + 12 * i : 136 + 12 * i]: struct.unpack(">II", icc[136 + 12 * i : 144 + 12 * i]) for i in range(min(n, 200))}
        at, size = tags[b"desc"]
        body = icc[at : at + size]
        if body[:4] == b"desc":
            return clean_name(body[12 : 12 + struct.unpack(">I", body[8:12])[0]].decode("ascii", "replace"))
        if body[:4] != b"mluc":
            return None
        count, width = struct.unpack(">II", body[8:16])
        found = []
        for i in range(min(count, 200)):
            lang, length, start = struct.unpack(">4sII", body[16 + width * i : 28 + width * i])
            text = clean_name(body[start : start + length].decode("utf-16-be", "replace"))
            if text:
                found.append((lang != b"enUS", i, text))
        return min(found)[2] if found else None
    except (struct.error, KeyError):
        return None


def clean_name(text: str) -> str | None:
    text = "".join(c for c in text.strip("\0�") if c.isprintable()).strip()
    return text or None
