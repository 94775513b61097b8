"""Pixel and viewport arithmetic as columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
NEUTRAL_THRESHOLD = 20
NEUTRAL_ADD = (8, -6, 0)
OUTPUT_GAMMA = 0.95
LARGE_RASTER_BYTES = 256 << 20
TILE_BYTES = 256 << 20
MIN_EDGE, MAX_EDGE, ALIGN = 256, 8192, 64
MIN_ZOOM, MAX_ZOOM, ZOOM_FACTOR = 1, 10_000, 1.05
TILE_DEMAND = 1.05


def clamp(v: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def clamp_byte(v: Column) -> Column:
    return clamp(v, 0, 255)


def tone_map(v: Column) -> Column:
    """max(v, 0) ** (1 / 2.2) * 255, truncated, 0..255; not a number gives 0."""
    d = v.cast("double")
    return F.when(F.isnan(d), 0).otherwise(F.floor(clamp(F.pow(F.greatest(d, F.lit(0.0)), F.lit(1 / 2.2)) * 255.0, 0.0, 255.0))).cast("int")


def rgbe_component(mantissa: Column, exponent: Column) -> Column:
    return F.when(exponent > 0, mantissa * F.pow(F.lit(2.0), exponent - 136)).otherwise(0.0)


def cmyk_component(ink: Column, black: Column) -> Column:
    """One RGB component from inverted ink and black bytes, in single precision."""
    f = lambda c: ((255 - c).cast("float") / F.lit(255.0).cast("float")).cast("float")
    one, full = F.lit(1.0).cast("float"), F.lit(255.0).cast("float")
    v = (full * (one - f(ink))).cast("float") * (one - f(black))
    return clamp_byte(F.floor(v.cast("float") + F.lit(0.5).cast("float")).cast("int"))


def premultiply(c: Column, a: Column) -> Column:
    return F.floor((c * a + 127) / 255).cast("int")


def gamma_table(gamma: float = OUTPUT_GAMMA) -> list[int]:
    x = (np.arange(256, dtype=np.float32) / np.float32(255)) ** np.float32(gamma)
    return np.clip((x * np.float32(255) + np.float32(0.5)).astype(np.int32), 0, 255).tolist()


def look_up(table: Column, v: Column) -> Column:
    return F.get(table, v)


def is_neutral(r: Column, g: Column, b: Column, threshold: int = NEUTRAL_THRESHOLD) -> Column:
    return F.greatest(r, g, b) - F.least(r, g, b) <= threshold


def neutral_balance(r: Column, g: Column, b: Column) -> list[Column]:
    """Near-neutral pixels get the fixed additions, clamped."""
    near = is_neutral(r, g, b)
    return [F.when(near, clamp_byte(c + add)).otherwise(c) for c, add in zip((r, g, b), NEUTRAL_ADD)]


def is_grey(pixels: Column) -> Column:
    """Every pixel of array<struct(r, g, b)> has no green and no blue (so pure red counts)."""
    return F.forall(pixels, lambda p: (p["g"] == 0) & (p["b"] == 0))


def rgba_bytes(w: Column, h: Column) -> Column:
    return w.cast("long") * 4 * h.cast("long")


def is_large(w: Column, h: Column) -> Column:
    return rgba_bytes(w, h) >= LARGE_RASTER_BYTES


def next_zoom(zoom: Column, direction: Column) -> Column:
    """One step of 5 %, rounded half away from zero, always moving, 1..10000."""
    up = clamp(F.round(zoom * ZOOM_FACTOR), MIN_ZOOM, MAX_ZOOM).cast("int")
    down = clamp(F.round(zoom / ZOOM_FACTOR), MIN_ZOOM, MAX_ZOOM).cast("int")
    up = F.when(up <= zoom, F.least(F.lit(MAX_ZOOM), zoom + 1)).otherwise(up)
    down = F.when(down >= zoom, F.greatest(F.lit(MIN_ZOOM), zoom - 1)).otherwise(down)
    return F.when(direction > 0, up).otherwise(down)


def fit_zoom(window_w: Column, window_h: Column, image_w: Column, image_h: Column, scale: Column) -> Column:
    """Percent that fits an image into a window of physical pixels (half to even)."""
    return F.bround(F.least(window_w / image_w, window_h / image_h) * 100.0 / scale, 0).cast("int")


def initial_mode(window_w: Column, window_h: Column, image_w: Column, image_h: Column, scale: Column) -> Column:
    fits = (image_w <= window_w / scale) & (image_h <= window_h / scale)
    return F.when(image_w.isNull() | image_h.isNull(), "Undefined").when(fits, "OriginalImageSize").otherwise("FitToScreen")


def preview_size(w: Column, h: Column, max_w: Column, max_h: Column) -> Column:
    scale = F.least(F.lit(1.0), max_w / w, max_h / h)
    side = lambda s: F.greatest(F.lit(1), F.floor(s * scale).cast("int"))
    return F.struct(side(w).alias("w"), side(h).alias("h"))


def tile_edge(max_bytes: Column, hint: Column | None = None) -> Column:
    edge = F.floor(F.sqrt(F.greatest(F.lit(1), F.floor(max_bytes / 4)))).cast("int")
    if hint is not None:
        edge = F.coalesce(hint, edge)
    return F.greatest(F.lit(MIN_EDGE), F.floor(clamp(edge, MIN_EDGE, MAX_EDGE) / ALIGN).cast("int") * ALIGN)


def preview_ppu(preview_w: Column, preview_h: Column, w: Column, h: Column) -> Column:
    return F.least(preview_w / w, preview_h / h)


def needs_tiles(zoom_percent: Column, scale: Column, ppu: Column) -> Column:
    return zoom_percent / 100.0 * scale > ppu * TILE_DEMAND


def visible_rect(image_w, image_h, window_w, window_h, scale, zoom_percent, off_x, off_y) -> Column:
    """struct(left, top, right, bottom) of the visible part in image space; null
    when the image is off screen."""
    zoom = zoom_percent / 100.0

    def side(image, window, off):
        logical = window / scale
        at = (logical - image * zoom) / 2.0 + off / scale
        return F.greatest(F.lit(0.0), -at / zoom), F.least(image.cast("double"), (logical - at) / zoom)

    (left, right), (top, bottom) = side(image_w, window_w, off_x), side(image_h, window_h, off_y)
    rect = F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"))
    return F.when((left < right) & (top < bottom), rect)


def pan_clamp(offset: Column, image: Column, window: Column) -> Column:
    """An offset kept so that the drawn image covers the window where it can."""
    most = F.greatest(F.lit(0.0), (image - window) / 2.0)
    return clamp_between(offset, -most, most)


def clamp_between(v: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, v))


def intersect(a: Column, b: Column) -> Column:
    """Common part of two rectangles; null when there is none."""
    left, top = F.greatest(a["left"], b["left"]), F.greatest(a["top"], b["top"])
    right, bottom = F.least(a["right"], b["right"]), F.least(a["bottom"], b["bottom"])
    rect = F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"))
    return F.when((left < right) & (top < bottom), rect)


def spiral_position(dx: Column, dy: Column) -> Column:
    """Place of a tile at (dx, dy) from the seed in a spiral: right, down, left, up."""
    r = F.greatest(F.abs(dx), F.abs(dy))
    ring = (2 * r - 1) * (2 * r - 1)
    return (
        F.when((dx == 0) & (dy == 0), 0)
        .when((r == dx) & (dy > -r) & (dy <= r), ring + (dy + r - 1))
        .when((r == dy) & (dx < r), ring + 2 * r + (r - dx - 1))
        .when((r == -dx) & (dy < r), ring + 4 * r + (r - dy - 1))
        .otherwise(ring + 6 * r + (dx + r - 1))
    )
