"""Shingle sets of Arrow text columns in numpy: 63-bit tokens, whole texts.

``powers`` serves the rolling names of windows of the suffix dedup.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_P = 0x9E3779B97F4A7C15
_PI = pow(_P, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


#: A-Z as a-z
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: What is read of the last 8 bytes of a word, by how many are left.
_LEFT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Where the two word hashes start.
_SEEDS = np.uint64(0x6A09E667F3BCC909), np.uint64(0xBB67AE8584CAA73B)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n (kept between calls)."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        made = []
        for p in (_P, _PI):
            a = np.full(size, p, np.uint64)
            a[0] = 1
            made.append(np.multiply.accumulate(a))
        _powers = made[0], made[1]
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (null: empty) and the n + 1 offsets."""
    if pa.types.is_binary(text.type) or pa.types.is_large_binary(text.type):
        text = pc.fill_null(text.cast(pa.large_binary()), b"")
    else:
        text = pc.fill_null(text.cast(pa.large_string()), "")
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def hash_slices(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: np.uint64) -> np.ndarray:
    """64-bit hashes of slices: 8 bytes a round go through a full scrambling with
    all that came before, so unlike sums of powers they have no structure that
    texts could have too."""
    words = np.ndarray((len(buf) + 1,), "<u8", np.concatenate((buf, np.zeros(8, np.uint8))), strides=(1,))
    h = mix(sizes.astype(np.uint64) * np.uint64(_P) + seed)
    at, left, live = starts, sizes, None
    while True:
        part = words[at] & _LEFT[np.minimum(left, 8)]
        if live is None:
            h = mix((h ^ part) * np.uint64(_P))
        else:
            h[live] = mix((h[live] ^ part) * np.uint64(_P))
        more = np.flatnonzero(left > 8)
        if not len(more):
            return h
        live = more if live is None else live[more]
        at, left = at[more] + 8, left[more] - 8


def word_places(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and size of every word and the n + 1 word offsets of the texts."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    blank = SPACE[buf]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.concatenate(([True], blank[:-1])) | first[:n]
    after = np.concatenate((blank[1:], [True])) | first[1:]
    starts = np.flatnonzero(~blank & before)
    ends = np.flatnonzero(~blank & after) + 1
    return starts, ends - starts, np.searchsorted(starts, offsets)


def _shingles(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Tokens (below 2**63) of the n-word shingles that begin at each word, across
    texts too; of texts with fewer words the first place holds the whole sequence."""
    size = np.diff(at)
    out = np.zeros(len(h), np.uint64)
    last = max(0, len(h) - n + 1)
    for k in range(n):
        out[:last] += h[k : last + k] * np.uint64(pow(_P, k + 2, 1 << 64))
    out = mix(out)
    short = np.flatnonzero((size > 0) & (size < n))
    x = np.zeros(len(short), np.uint64)
    for k in range(n - 1):
        on = size[short] > k
        x[on] = mix((x[on] + h[at[:-1][short[on]] + k]) * np.uint64(_PI))
    out[at[:-1][short]] = x
    return out >> np.uint64(1)


def shingle_sets(text: pa.Array, n: int, names: bool = False) -> list:
    """For each text the sorted distinct tokens of its n-word shingles; with fewer
    words the whole sequence is one; without words none.  With ``names`` also each
    set's name: two 64-bit sums, of these tokens and of tokens from word hashes of
    their own."""
    buf, offsets = text_bytes(text)
    buf = LOWER[buf]
    starts, sizes, at = word_places(buf, offsets)
    tokens = _shingles(hash_slices(buf, starts, sizes, _SEEDS[0]), at, n)
    other = _shingles(hash_slices(buf, starts, sizes, _SEEDS[1]), at, n) if names else None
    sets, named = [], []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        end = max(b - n + 1, a + 1) if b > a else a
        if not names:
            sets.append(np.unique(tokens[a:end]))
            continue
        found, first = np.unique(tokens[a:end], return_index=True)
        sets.append(found)
        two = (mix(found), mix(other[a:end][first] + np.uint64(0x51ED)))
        named.append(tuple(int(x.sum(dtype=np.uint64).astype(np.int64)) for x in two))
    return [sets, named] if names else sets
