"""Baseline TIFF pixels: the first page, in strips or tiles.

Grey, palette and RGB(A) samples of 1, 2, 4, 8 or 16 bits; stored raw, run-length,
LZW or deflated, with or without the horizontal predictor; chunky or planar.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from tilewright.sources.psd import unpack_bits

# Fixed values of the format: tag numbers, and bytes of a number by field type.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, PALETTE, TILE_W, TILE_H, TILE_AT, TILE_BYTES, EXTRA = 317, 320, 322, 323, 324, 325, 338
_NUMBERS = {1: "B", 3: "H", 4: "I"}
RAW, LZW, DEFLATE, OLD_DEFLATE, PACK_BITS = 1, 5, 8, 32946, 32773
#: Four bytes a pixel must fit one binary cell.
MAX_PIXELS = (1 << 29) - 1


def _tags(data: bytes) -> tuple[str, dict[int, tuple[int, ...]]]:
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None:
        raise ValueError("not a TIFF picture")
    (at,) = struct.unpack_from(order + "I", data, 4)
    (n,) = struct.unpack_from(order + "H", data, at)
    found = {}
    for i in range(n):
        tag, kind, count, value = struct.unpack_from(order + "HHII", data, at + 2 + 12 * i)
        if kind in _NUMBERS and count:
            form = f"{order}{count}{_NUMBERS[kind]}"
            size = struct.calcsize(form)
            start = at + 10 + 12 * i if size <= 4 else value
            if start + size > len(data):
                raise ValueError("truncated")
            found[tag] = struct.unpack_from(form, data, start)
    return order, found


def unpack_lzw(packed: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first, that grow one code early."""
    out, table, width, last = bytearray(), [], 9, b""
    held, bits = 0, 0
    for byte in packed:
        held, bits = (held << 8 | byte) & 0xFFFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes((i,)) for i in range(256)] + [b"", b""], 9, b""
            continue
        if not last:
            if code > 255 or not table:
                raise ValueError("bad code")
            last = table[code]
            out += last
            continue
        if code > len(table):
            raise ValueError("bad code")
        now = table[code] if code < len(table) else last + last[:1]
        table.append(last + now[:1])
        out += now
        last = now
        width = min(12, (len(table) + 1).bit_length())
    return bytes(out)


def _unpack(kind: int, part: bytes, rows: int, row_bytes: int) -> bytes:
    if kind == RAW:
        return part
    if kind == LZW:
        return unpack_lzw(part)
    if kind in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(part, rows * row_bytes)
        except zlib.error as e:
            raise ValueError("deflate") from e
    if kind == PACK_BITS:
        return unpack_bits(part, rows * row_bytes)
    raise ValueError(f"compression {kind}")


def _samples(raw: bytes, rows: int, width: int, per: int, bits: int, order: str) -> np.ndarray:
    """rows x width x per numbers; rows begin at whole bytes, missing ones are 0."""
    row_bytes = (width * per * bits + 7) // 8
    raw = raw[: rows * row_bytes].ljust(rows * row_bytes, b"\0")
    if bits == 16:
        return np.frombuffer(raw, order + "u2").reshape(rows, width, per)
    lines = np.frombuffer(raw, np.uint8).reshape(rows, row_bytes)
    if bits < 8:
        places = np.arange(8 - bits, -1, -bits)
        lines = (lines[..., None] >> places & (1 << bits) - 1).astype(np.uint8).reshape(rows, -1)
    return lines[:, : width * per].reshape(rows, width, per)


def read_tiff(data: bytes) -> np.ndarray:
    """h x w x 4 RGBA bytes of the first page."""
    order, tags = _tags(data)
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    w, h, per = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    if not w or not h or w * h > MAX_PIXELS:
        raise ValueError("size")
    depths, kind, seen = set(tags.get(BITS, (1,))), one(COMPRESSION, RAW), one(PHOTOMETRIC, 0)
    bits = depths.pop()
    if depths or bits not in (1, 2, 4, 8, 16) or seen not in (0, 1, 2, 3) or (seen == 2) != (per >= 3):
        raise ValueError(f"photometric {seen}, {per} samples of {sorted(depths | {bits})} bits")
    tiled = TILE_AT in tags
    part_w, part_h = (one(TILE_W), one(TILE_H)) if tiled else (w, min(h, one(STRIP_ROWS, h)))
    starts, sizes = (tags.get(TILE_AT if tiled else STRIP_AT), tags.get(TILE_BYTES if tiled else STRIP_BYTES))
    if not starts or not sizes or not part_w or not part_h:
        raise ValueError("no strips")
    planes, inside = (per, 1) if one(PLANAR, 1) == 2 else (1, per)
    across, down = -(-w // part_w), -(-h // part_h)
    if len(starts) < planes * across * down or len(sizes) < planes * across * down:
        raise ValueError("truncated")
    px = np.zeros((h, w, per), np.uint16 if bits == 16 else np.uint8)
    for n in range(planes * across * down):
        plane, y0, x0 = n // (across * down), n // across % down * part_h, n % across * part_w
        rows = part_h if tiled else min(part_h, h - y0)
        if starts[n] + sizes[n] > len(data):
            raise ValueError("truncated")
        raw = _unpack(kind, data[starts[n] : starts[n] + sizes[n]], rows, (part_w * inside * bits + 7) // 8)
        part = _samples(raw, rows, part_w, inside, bits, order)
        if one(PREDICTOR, 1) == 2 and bits >= 8:
            part = np.cumsum(part, axis=1, dtype=np.uint64).astype(px.dtype)
        part = part[: h - y0, : w - x0]
        px[y0 : y0 + part.shape[0], x0 : x0 + part.shape[1], plane : plane + inside] = part
    full = (1 << bits) - 1
    if seen == 3:
        table = np.array(tags.get(PALETTE, ()), np.uint32)
        if table.size < 3 << bits:
            raise ValueError("no palette")
        rgb = (table[: 3 << bits].reshape(3, -1).T >> 8).astype(np.uint8)[px[..., 0]]
    else:
        byte = (px.astype(np.uint32) * 255 + full // 2) // full
        rgb = np.repeat(byte[..., :1] if seen else 255 - byte[..., :1], 3, -1) if seen < 2 else byte[..., :3]
    colours = 3 if seen == 2 else 1
    has_alpha = per > colours and one(EXTRA, 0) in (1, 2)
    alpha = (px[..., colours].astype(np.uint32) * 255 + full // 2) // full if has_alpha else np.full((h, w), 255)
    if has_alpha and one(EXTRA) == 1:
        # associated: colours are stored multiplied by alpha
        rgb = np.where(alpha[..., None] > 0, np.minimum(255, (rgb.astype(np.uint32) * 255 + alpha[..., None] // 2) // np.maximum(alpha[..., None], 1)), 0)
    return np.concatenate([rgb, alpha[..., None]], -1).astype(np.uint8)
