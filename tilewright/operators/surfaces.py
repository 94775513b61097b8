"""RGBA surfaces from plane rows: full, preview and tiled.

The planes of one scanline meet by (path, y), so a raster is converted line by
line in as many tasks as there are lines; a line's bytes are converted at once
in an Arrow function.  The column functions of ``operators.color`` say the same
pixel by pixel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions import raster
from tilewright.operators import tiles
from tilewright.sources import psd

#: Modes with a processor; others give rows with an error.
PROCESSORS = ("Rgb", "Cmyk", "Indexed")
_ROLES = ("R", "G", "B", "C", "M", "Y", "K", "Index", "A")
_GAMMA = np.array(raster.gamma_table(), np.uint8)


def cmyk_to_rgb(c: np.ndarray, m: np.ndarray, y: np.ndarray, k: np.ndarray, tune: bool = True) -> list[np.ndarray]:
    one, full = np.float32(1), np.float32(255)
    ink = lambda v: one - (np.float32(255) - v.astype(np.float32)) / full
    rgb = [np.clip((full * ink(v) * ink(k) + np.float32(0.5)).astype(np.int32), 0, 255) for v in (c, m, y)]
    if not tune:
        return [v.astype(np.uint8) for v in rgb]
    rgb = [_GAMMA[v].astype(np.int32) for v in rgb]
    near = np.maximum.reduce(rgb) - np.minimum.reduce(rgb) <= raster.NEUTRAL_THRESHOLD
    return [np.where(near, np.clip(v + a, 0, 255), v).astype(np.uint8) for v, a in zip(rgb, raster.NEUTRAL_ADD)]


def convert(planes: dict[str, np.ndarray], mode: str, palette: bytes | None, luts: np.ndarray | None, pixel_format: str, alpha: str) -> np.ndarray:
    """n x 4 bytes of one scanline."""
    need = {"Rgb": "RGB", "Cmyk": "CMYK", "Indexed": ("Index",)}[mode]
    missing = [r for r in need if r not in planes]
    if missing:
        raise psd.Malformed(f"no plane {missing[0]}")
    if mode == "Cmyk":
        rgb = cmyk_to_rgb(*(planes[r] for r in need), tune=luts is None)
    elif mode == "Indexed":
        if palette is None or len(palette) < 768:
            raise psd.Malformed("no palette")
        table = np.frombuffer(palette, np.uint8, 768).reshape(3, 256)
        rgb = [t[planes["Index"]] for t in table]
    else:
        rgb = [planes[r] for r in need]
    if luts is not None:
        rgb = [t[v] for t, v in zip(luts, rgb)]
    a = planes.get("A") if alpha != "opaque" else None
    a = np.full(len(rgb[0]), 255, np.uint8) if a is None else a
    if alpha == "premultiplied":
        rgb = [((v.astype(np.int32) * a + 127) // 255).astype(np.uint8) for v in rgb]
    return np.stack([*(rgb if pixel_format == "rgba" else rgb[::-1]), a], -1)


def rgba_rows(plane_rows: DataFrame, documents: DataFrame, pixel_format: str = "rgba", alpha: str = "straight", luts: DataFrame | None = None) -> DataFrame:
    """path, y, row (4 bytes a pixel), error.

    ``documents``: path, mode, palette (of ``psd.index``).  ``luts``: path, curves
    (three arrays of 256), where a calibration is known.
    """
    if pixel_format not in ("rgba", "bgra") or alpha not in ("opaque", "straight", "premultiplied"):
        raise ValueError(f"not supported: {pixel_format}, {alpha}")
    lines = plane_rows.filter("error is null").groupBy("path", "y").agg(*[F.max(F.when(F.col("role") == r, F.col("row"))).alias("role_" + r) for r in _ROLES])
    docs = documents.select("path", "mode", "palette")
    docs = docs.withColumn("curves", F.lit(None).cast("array<array<int>>")) if luts is None else docs.join(luts.select("path", "curves"), "path", "left")
    joined = lines.join(docs, "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, errors = [], []
            for r in b.to_pylist():
                try:
                    if r["mode"] not in PROCESSORS:
                        raise psd.Malformed(f"colour mode {r['mode']}")
                    planes = {k: np.frombuffer(r["role_" + k], np.uint8) for k in _ROLES if r["role_" + k] is not None}
                    curves = None if r["curves"] is None else np.array(r["curves"], np.uint8)
                    rows.append(convert(planes, r["mode"], r["palette"], curves, pixel_format, alpha).tobytes())
                    errors.append(None)
                except psd.Malformed as e:
                    rows.append(None)
                    errors.append(str(e))
            yield pa.record_batch([b.column("path"), b.column("y"), pa.array(rows, pa.binary()), pa.array(errors, pa.string())], names=["path", "y", "row", "error"])

    return joined.mapInArrow(run, "path string, y int, row binary, error string")


def full_surface(rows: DataFrame) -> DataFrame:
    """path, data: the lines of each surface joined."""
    return tiles.assemble(rows.filter("error is null"), "path")


def preview(files: DataFrame, max_w: int, max_h: int, **options) -> DataFrame:
    """path, w, h, data: surfaces scaled to fit, never enlarged; only the lines
    that the preview shows are converted."""
    if max_w <= 0 or max_h <= 0:
        raise ValueError("a preview needs a size")
    docs = psd.index(files).filter("error is null")
    size = raster.preview_size(F.col("width"), F.col("height"), F.lit(float(max_w)), F.lit(float(max_h)))
    dims = docs.select(F.col("path").alias("asset_id"), F.col("width").alias("w"), F.col("height").alias("h"), size["w"].alias("to_w"), size["h"].alias("to_h"))
    lines = psd.plane_rows(files).withColumnRenamed("path", "asset_id").filter("error is null")
    small = tiles.resample(lines, dims).select(F.col("asset_id").alias("path"), "plane", "role", "y", "row", F.lit(None).cast("string").alias("error"))
    data = full_surface(rgba_rows(small, docs, **options))
    return data.join(dims.select(F.col("asset_id").alias("path"), F.col("to_w").alias("w"), F.col("to_h").alias("h")), "path").select("path", "w", "h", "data")


def tiled(files: DataFrame, edge: int, band: int | None = None, **options) -> DataFrame:
    """path, tx, ty, data: RGBA tiles; with ``band`` files decode band by band."""
    docs = psd.index(files).filter("error is null")
    rows = rgba_rows(psd.plane_rows(files, band), docs, **options).filter("error is null")
    # a line of w pixels is cut as one of 4 * w bytes
    dims = docs.select(F.col("path").alias("asset_id"), (F.col("width") * 4).alias("w"), F.col("height").alias("h"), F.lit(4 * edge).alias("tile_w"), F.lit(edge).alias("tile_h"))
    lines = rows.select(F.col("path").alias("asset_id"), F.lit(0).alias("plane"), F.lit("RGBA").alias("role"), "y", "row")
    return tiles.cut_tiles(lines, dims).select(F.col("asset_id").alias("path"), "tx", "ty", "data")


def staged(files: DataFrame, max_w: int, max_h: int, edge: int, large_bytes: int = raster.LARGE_RASTER_BYTES, band: int | None = None, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(whole, previews, tiles): how documents come on screen.  Those of fewer RGBA
    bytes than ``large_bytes`` are one surface (path, data); of the others there is
    first a preview (path, w, h, data), then tiles (path, tx, ty, data), in the order
    in which the caller runs them; each decodes only what it shows."""
    docs = psd.index(files).filter("error is null")
    large = docs.filter(raster.rgba_bytes(F.col("width"), F.col("height")) >= large_bytes).select("path")
    big, small = files.join(large, "path", "left_semi"), files.join(large, "path", "left_anti")
    rows = rgba_rows(psd.plane_rows(small), psd.index(small).filter("error is null"), **options)
    return full_surface(rows), preview(big, max_w, max_h, **options), tiled(big, edge, band, **options)


def row_table_fits(index: DataFrame, plane_bytes: DataFrame) -> DataFrame:
    """path, fits: whether packed lengths (path, packed) and the row table fill the
    image data of run-length documents."""
    packed = plane_bytes.groupBy("path").agg(F.sum("packed").alias("packed"))
    entry = F.when(F.col("version") == 2, 4).otherwise(2)
    total = F.col("packed") + entry * F.col("channels") * F.col("height")
    return index.filter("compression = 'Rle'").join(packed, "path").select("path", (total == F.col("length")).alias("fits"))
