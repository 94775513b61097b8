"""Pixel sources: Radiance HDR, TGA, TIFF, icons, baseline images, vector sizes.

HDR, TGA, baseline TIFF and ICO are decoded with numpy in Arrow functions.  BMP,
JPEG and PNG come from Spark's own ``image`` source.  HEIF, OpenEXR and WEBP need
libraries that are not here; their rows carry that as ``error``.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.sources.icons import read_ico
from tilewright.sources.tiff import read_tiff

MISSING = {"Heif": "libheif", "Exr": "OpenEXR", "Webp": "libwebp"}
_SIZE = re.compile(rb"([-+])Y (\d+) ([-+])X (\d+)\n")


def read_hdr(data: bytes) -> np.ndarray:
    """h x w x 4 bytes (mantissas and exponent) of a Radiance picture."""
    if not data.startswith(b"#?"):
        raise ValueError("not a Radiance picture")
    head = data.find(b"\n\n")
    if head < 0 or b"FORMAT=32-bit_rle_rgbe" not in data[:head]:
        raise ValueError("format")
    size = _SIZE.match(data, head + 2)
    if not size:
        raise ValueError("size line")
    h, w, at = int(size[2]), int(size[4]), size.end()
    out = np.zeros((h, w, 4), np.uint8)
    for y in range(h):
        coded = 8 <= w <= 32767 and data[at : at + 2] == b"\2\2" and at + 3 < len(data) and data[at + 2] < 128
        if not coded:
            # flat from here on
            n = (h - y) * w * 4
            if at + n > len(data):
                raise ValueError("truncated")
            out[y:] = np.frombuffer(data, np.uint8, n, at).reshape(h - y, w, 4)
            break
        if struct.unpack(">H", data[at + 2 : at + 4])[0] != w:
            raise ValueError("scanline width")
        at += 4
        for c in range(4):
            x = 0
            while x < w:
                if at + 1 >= len(data):
                    raise ValueError("truncated")
                n = data[at]
                if n > 128:
                    run = n - 128
                    if x + run > w:
                        raise ValueError("bad run")
                    out[y, x : x + run, c] = data[at + 1]
                    at += 2
                else:
                    run = n
                    if not run or x + run > w or at + 1 + run > len(data):
                        raise ValueError("bad run")
                    out[y, x : x + run, c] = np.frombuffer(data, np.uint8, run, at + 1)
                    at += 1 + run
                x += run
    return out


def rgbe_to_float(rgbe: np.ndarray) -> np.ndarray:
    """h x w x 4 floats, alpha 1."""
    e = rgbe[..., 3].astype(np.int32)
    scale = np.where(e > 0, np.ldexp(1.0, e - 136), 0.0)
    rgb = rgbe[..., :3] * scale[..., None]
    return np.concatenate([rgb, np.ones((*e.shape, 1))], -1).astype(np.float32)


def to_bytes(pixels: np.ndarray) -> tuple[np.ndarray, bool]:
    """Tone-mapped bytes of float pixels, and whether the picture counts as grey."""
    grey = bool((pixels[..., 1] == 0).all() and (pixels[..., 2] == 0).all())
    if grey:
        pixels = np.concatenate([np.repeat(pixels[..., :1], 3, -1), pixels[..., 3:]], -1)
    v = np.nan_to_num(np.maximum(pixels.astype(np.float64), 0), nan=0.0, posinf=1e300) ** (1 / 2.2) * 255
    return np.clip(np.floor(v), 0, 255).astype(np.uint8), grey


def read_tga(data: bytes) -> np.ndarray:
    """h x w x 4 RGBA bytes: true colour, grey or palette, raw or run-length."""
    if len(data) < 18:
        raise ValueError("truncated")
    id_len, has_map, kind, map_first, map_len, map_bits, _, _, w, h, bits, flags = struct.unpack("<BBBHHBHHHHBB", data[:18])
    if kind not in (1, 2, 3, 9, 10, 11) or not w or not h:
        raise ValueError(f"image type {kind}")
    at = 18 + id_len
    table = None
    if has_map:
        n = map_len * (map_bits // 8)
        table = np.frombuffer(data[at : at + n], np.uint8).reshape(map_len, -1)
        at += n
    step = bits // 8
    if step not in (1, 3, 4):
        raise ValueError(f"{bits} bits")
    if kind < 8:
        raw = data[at : at + w * h * step]
    else:
        raw = bytearray()
        while len(raw) < w * h * step and at < len(data):
            n = (data[at] & 127) + 1
            if data[at] & 128:
                raw += data[at + 1 : at + 1 + step] * n
                at += 1 + step
            else:
                raw += data[at + 1 : at + 1 + n * step]
                at += 1 + n * step
    # what a truncated file lacks stays zero
    px = np.frombuffer(bytes(raw[: w * h * step]).ljust(w * h * step, b"\0"), np.uint8).reshape(h, w, step)
    if kind in (1, 9):
        if table is None:
            raise ValueError("no palette")
        px = table[np.clip(px[..., 0].astype(int) - map_first, 0, len(table) - 1)]
    if px.shape[-1] == 1:
        px = np.repeat(px, 3, -1)
    else:
        px = np.concatenate([px[..., 2::-1], px[..., 3:]], -1)
    if px.shape[-1] == 3:
        px = np.concatenate([px, np.full((h, w, 1), 255, np.uint8)], -1)
    px = px if flags & 32 else px[::-1]
    return np.ascontiguousarray(px[:, ::-1] if flags & 16 else px)


def _hdr(data: bytes) -> tuple[np.ndarray, bool]:
    return to_bytes(rgbe_to_float(read_hdr(data)))


def _tga(data: bytes) -> tuple[np.ndarray, bool]:
    return read_tga(data), False


def _tiff(data: bytes) -> tuple[np.ndarray, bool]:
    return read_tiff(data), False


def _ico(data: bytes) -> tuple[np.ndarray, bool]:
    return read_ico(data), False


DECODERS: dict[str, Callable[[bytes], tuple[np.ndarray, bool]]] = {"Hdr": _hdr, "Ico": _ico, "Tga": _tga, "Tiff": _tiff}
SURFACE = "path string, format string, width int, height int, grey boolean, rgba binary, error string"


def surfaces(files: DataFrame) -> DataFrame:
    """RGBA surfaces of (path, format, content); what cannot be read has ``error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.string()]
        for b in batches:
            for path, form, data in zip(*(b.column(c).to_pylist() for c in ("path", "format", "content"))):
                row: tuple = (path, form, None, None, None, None)
                try:
                    if form not in DECODERS:
                        raise ValueError(f"{form} needs {MISSING.get(form, 'another reader')}")
                    px, grey = DECODERS[form](data)
                    row = (path, form, px.shape[1], px.shape[0], grey, px.tobytes(), None)
                except (ValueError, struct.error) as e:
                    row = (*row, str(e))
                yield pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds)], names=[x.split()[0] for x in SURFACE.split(", ")])

    return files.select("path", "format", "content").mapInArrow(run, SURFACE)


def raster_images(spark: SparkSession, path: str) -> DataFrame:
    """BMP, JPEG and PNG by Spark's image source: path, width, height, channels, data (BGR[A])."""
    i = spark.read.format("image").option("dropInvalid", "true").load(path)
    return i.select(F.col("image.origin").alias("path"), "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data")


def svg_sizes(files: DataFrame) -> DataFrame:
    """path, width, height of vector pictures (path, content), by XPath: the size
    attributes, else the view box; null where there is neither."""
    text = F.decode("content", "UTF-8")
    x = files.select("path", F.regexp_replace(text, r'\sxmlns(:\w+)?="[^"]*"|<\?xml[^>]*\?>|<!DOCTYPE[^>]*>', "").alias("t")).filter(F.col("t").rlike(r"(?s)^\s*<.*>\s*$"))
    at = lambda a: F.regexp_extract(F.xpath_string("t", F.lit(f"/svg/@{a}")), r"^\s*([0-9.]+)", 1).try_cast("double")
    box = F.split(F.trim(F.xpath_string("t", F.lit("/svg/@viewBox"))), r"[\s,]+")
    return x.select("path", F.coalesce(at("width"), F.get(box, F.lit(2)).try_cast("double")).alias("width"), F.coalesce(at("height"), F.get(box, F.lit(3)).try_cast("double")).alias("height"))
