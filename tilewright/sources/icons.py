"""Windows icons: the largest picture of the file, a bitmap or a PNG."""

from __future__ import annotations

import struct
import zlib

import numpy as np

# Fixed values of the format: samples a pixel by PNG colour type.
_PNG_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_PNG = b"\x89PNG\r\n\x1a\n"
MAX_EDGE = 4096


def _unpacked_bits(lines: np.ndarray, bits: int, width: int) -> np.ndarray:
    places = np.arange(8 - bits, -1, -bits)
    return (lines[..., None] >> places & (1 << bits) - 1).astype(np.uint8).reshape(len(lines), -1)[:, :width]


def _unfilter(raw: bytes, rows: int, row_bytes: int, step: int) -> np.ndarray:
    out = np.zeros((rows + 1, row_bytes + step), np.uint8)
    for y in range(rows):
        at = y * (row_bytes + 1)
        kind, line = raw[at], np.frombuffer(raw, np.uint8, row_bytes, at + 1)
        up, now = out[y], out[y + 1]
        if kind == 0:
            now[step:] = line
        elif kind == 1:
            pad = np.zeros(-row_bytes % step, np.uint8)
            now[step:] = np.cumsum(np.concatenate([line, pad]).reshape(-1, step), axis=0, dtype=np.uint64).astype(np.uint8).ravel()[:row_bytes]
        elif kind == 2:
            now[step:] = line + up[step:]
        elif kind in (3, 4):
            for x in range(row_bytes):
                a, b, c = int(now[x]), int(up[x + step]), int(up[x])
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    # the neighbour nearest to a + b - c; ties: left, above, diagonal
                    guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                now[x + step] = (int(line[x]) + guess) & 255
        else:
            raise ValueError(f"filter {kind}")
    return out[1:, step:]


def read_png(data: bytes) -> np.ndarray:
    """h x w x 4 RGBA bytes of a PNG that is not interlaced."""
    if not data.startswith(_PNG):
        raise ValueError("not a PNG picture")
    at, head, table, clear, packed = 8, None, None, b"", bytearray()
    while at + 8 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body[:13])
        elif name == b"PLTE":
            table = np.frombuffer(body[: len(body) // 3 * 3], np.uint8).reshape(-1, 3)
        elif name == b"tRNS":
            clear = body
        elif name == b"IDAT":
            packed += body
        elif name == b"IEND":
            break
        at += 12 + size
    if head is None:
        raise ValueError("truncated")
    w, h, bits, kind, _, _, interlaced = head
    if kind not in _PNG_SAMPLES or bits not in (1, 2, 4, 8, 16) or interlaced or not 0 < w <= MAX_EDGE or not 0 < h <= MAX_EDGE:
        raise ValueError(f"PNG of type {kind}, {bits} bits, {w} x {h}")
    per = _PNG_SAMPLES[kind]
    row_bytes = (w * per * bits + 7) // 8
    try:
        raw = zlib.decompressobj().decompress(bytes(packed), h * (row_bytes + 1))
    except zlib.error as e:
        raise ValueError("deflate") from e
    lines = _unfilter(raw.ljust(h * (row_bytes + 1), b"\0"), h, row_bytes, max(1, per * bits // 8))
    deep = lines.reshape(h, w, per, 2).astype(np.uint16) if bits == 16 else None
    px = deep[..., 0] << 8 | deep[..., 1] if bits == 16 else (_unpacked_bits(lines, bits, w * per) if bits < 8 else lines).reshape(h, w, per)
    alpha = np.full((h, w), 255, np.uint8)
    if kind == 3:
        if table is None or not len(table):
            raise ValueError("no palette")
        index = np.minimum(px[..., 0], len(table) - 1)
        alpha = np.frombuffer(clear.ljust(len(table), b"\xff")[: len(table)], np.uint8)[index]
        return np.concatenate([table[index], alpha[..., None]], -1)
    if clear and kind in (0, 2):
        alpha = np.where((px == np.frombuffer(clear, ">u2", per)).all(-1), 0, 255).astype(np.uint8)
    byte = (px >> 8 if bits == 16 else px * (255 // ((1 << bits) - 1))).astype(np.uint8)
    if kind in (4, 6):
        alpha = byte[..., -1]
    rgb = byte[..., :3] if per >= 3 else np.repeat(byte[..., :1], 3, -1)
    return np.concatenate([rgb, alpha[..., None]], -1)


def read_dib(data: bytes) -> np.ndarray:
    """h x w x 4 RGBA bytes of an icon's bitmap: colours, then a mask of clear pixels."""
    size, w, high, _, bits, kind = struct.unpack_from("<IiiHHI", data)
    h = abs(high) // 2
    if size < 40 or kind or bits not in (1, 4, 8, 24, 32) or not 0 < w <= MAX_EDGE or not 0 < h <= MAX_EDGE:
        raise ValueError(f"bitmap of {bits} bits, {w} x {h}")
    at, table = size, None
    if bits <= 8:
        n = struct.unpack_from("<I", data, 32)[0] or 1 << bits
        if n > 1 << bits or at + 4 * n > len(data):
            raise ValueError("palette")
        table = np.zeros((1 << bits, 3), np.uint8)
        table[:n] = np.frombuffer(data, np.uint8, 4 * n, at).reshape(n, 4)[:, 2::-1]
        at += 4 * n
    row_bytes, mask_bytes = (w * bits + 31) // 32 * 4, (w + 31) // 32 * 4
    # what a truncated file lacks stays zero
    raw = data[at : at + h * (row_bytes + mask_bytes)].ljust(h * (row_bytes + mask_bytes), b"\0")
    lines = np.frombuffer(raw, np.uint8, h * row_bytes).reshape(h, row_bytes)
    mask = _unpacked_bits(np.frombuffer(raw, np.uint8, h * mask_bytes, h * row_bytes).reshape(h, mask_bytes), 1, w)
    alpha = np.where(mask == 1, 0, 255).astype(np.uint8)
    if table is not None:
        rgb = table[lines[:, :w] if bits == 8 else _unpacked_bits(lines, bits, w)]
    else:
        px = lines[:, : w * bits // 8].reshape(h, w, bits // 8)
        rgb = px[..., 2::-1]
        if bits == 32 and px[..., 3].any():
            alpha = px[..., 3]
    out = np.concatenate([rgb, alpha[..., None]], -1)
    return np.ascontiguousarray(out[::-1] if high > 0 else out)


def read_ico(data: bytes) -> np.ndarray:
    """The picture with most pixels; the one with more bits among equals."""
    if len(data) < 6:
        raise ValueError("truncated")
    zero, kind, n = struct.unpack_from("<HHH", data)
    if zero or kind != 1 or not n or len(data) < 6 + 16 * n:
        raise ValueError("not an icon")
    entries = [struct.unpack_from("<BBBBHHII", data, 6 + 16 * i) for i in range(n)]
    # a side of 0 stands for 256
    best = max(entries, key=lambda e: ((e[0] or 256) * (e[1] or 256), e[5]))
    part = data[best[7] : best[7] + best[6]]
    return read_png(part) if part.startswith(_PNG) else read_dib(part)
