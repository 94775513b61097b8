"""Suffix-array dedup: repeated byte strings found by column-wise construction of
a collection's Burrows-Wheeler transform (BWT) with its common prefixes.

The transform is built for many short strings at once, one symbol of each a
round, from the last to the first (``Collection``).  A symbol is a few bytes and
each string stands in the collection at every alignment, which takes as many
times fewer rounds and leaves no place out.  To deal a corpus out so that
equal strings of ``length`` bytes meet, every window of that length goes to the
bucket of its minimizer, the least hash of the ``GRAM``-byte strings in it; a run
of neighbouring windows with one minimizer is a piece.  Equal windows have equal
minimizers, so no repeat is lost, and matches never leave a document.

1. Of documents with the same text only the first goes through the steps below:
   every byte of the others (from ``length`` bytes on) is a repeat.
2. Minimizers that occur once in the corpus hold no repeat; the others are marked
   in a bitmap of fixed size.  Only marked pieces go on (a full bitmap lets more
   pieces go on, nothing else).
3. Pieces with the same content are one string; all but its first place are
   repeats as a whole.
4. The different strings of a bucket are put in a collection; suffixes with a
   common prefix of ``length`` bytes are neighbours there, and all but the first
   place of such an interval are repeats.
5. A bucket with more than ``HOT`` different strings is not gathered: its windows
   are grouped by their own 128-bit names instead.

The transform of a task's collection is kept as byte arrays that every round
reads and writes once from end to end, in memory, as a collection is bounded
(``BLOCK`` strings, ``HOT`` at most of one bucket more); executors share no local
files, so none are used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.bitmaps import bitmap_of, in_bitmap
from tilewright.llm.common import materialize, release
from tilewright.llm.ragged import portions, take
from tilewright.llm.shingles import mix, powers, text_bytes

LENGTH = 100
GRAM = 32
BLOCK = 3000
BYTES = 60_000
HOT = 16_384
_RUN = 120  # windows of a piece at most
_SLICE = 128 << 10  # bytes of text cut into pieces at a time
_COUNTED = 400_000  # minimizers counted before they are passed on
_NULL_ID = -(1 << 63)


class Collection:
    """BWT and longest common prefixes of a collection of symbol strings.

    ``columns[j, i]`` is the symbol (from 1) that stands ``j`` places before the
    end of string ``i``; 0 past its start.  After round ``j`` the suffixes of up
    to ``j`` symbols of all strings are in order; their preceding symbols are the
    transform.  Round ``j`` sorts the transform by symbol (stable): that is where
    the suffixes one symbol longer stand, so the new ones are merged in at their
    ranks.  The common prefix of neighbours is one more than the least between
    their tails.
    """

    def __init__(self, columns: np.ndarray, sizes: np.ndarray):
        self.columns, self.sizes = columns, sizes
        m, longest = len(sizes), int(sizes.max(initial=0))
        self.bwt = columns[0]
        self.lcp = np.zeros(m, np.uint8)
        at = live = np.flatnonzero(sizes > 0)
        for j in range(1, longest + 1):
            more = sizes[live] >= j
            if not more.all():
                at, live = at[more], live[more]
            at = self._insert(live, at, j, m)

    def _order(self) -> tuple[np.ndarray, int]:
        order = np.argsort(self.bwt, kind="stable")
        return order, len(self.bwt) - int(np.count_nonzero(self.bwt))

    def _least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least common prefix in each range [low, high)."""
        level = np.frexp(high - low)[1] - 1
        out = np.empty(len(low), np.uint8)
        # the least of each 2**k neighbours
        table = self.lcp
        for k in range(int(level.max(initial=0)) + 1):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(table[low[at]], table[high[at] - (1 << k)])
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
        return out

    def _insert(self, live: np.ndarray, at: np.ndarray, j: int, m: int) -> np.ndarray:
        old = len(self.bwt)
        order, ends = self._order()
        rank = np.empty(old, np.int32)
        rank[order] = np.arange(m - ends, m - ends + old, dtype=np.int32)
        new_at = rank[at]
        size = old + len(live)
        fresh = np.zeros(size + 1, bool)
        fresh[new_at] = True
        stay = ~fresh[:size]
        bwt, lcp = np.empty(size, self.bwt.dtype), np.empty(size, np.uint8)
        bwt[stay] = self.bwt
        lcp[stay] = self.lcp
        bwt[new_at] = self.columns[j][live]
        # common prefixes change where a suffix is new or follows a new one
        fresh[1:] |= fresh[:-1]
        touched = np.flatnonzero(fresh[:size])
        touched = touched[touched >= m]
        tail = order[touched - (m - ends)]
        before = order[np.maximum(touched - (m - ends) - 1, 0)]
        same = np.flatnonzero((self.bwt[tail] == self.bwt[before]) & (touched > m))
        value = np.zeros(len(touched), np.uint8)
        if len(same):
            value[same] = self._least(before[same] + 1, tail[same] + 1) + 1
        lcp[touched] = value
        self.bwt, self.lcp = bwt, lcp
        return new_at

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """String and length in symbols of each suffix in order, walked through
        the transform."""
        m, n = len(self.sizes), len(self.bwt)
        order, ends = self._order()
        step = np.empty(n, np.int32)
        step[order] = np.arange(m - ends, m - ends + n, dtype=np.int32)
        del order
        string, length = np.empty(n, np.int32), np.empty(n, np.int32)
        at, live = np.arange(m), np.arange(m)
        string[at], length[at] = live, 0
        for j in range(1, int(self.sizes.max(initial=0)) + 1):
            keep = self.sizes[live] >= j
            live, at = live[keep], step[at[keep]]
            string[at], length[at] = live, j
        return string, length


def columns_of(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and sizes of strings whose symbols are ``width`` bytes.

    String ``i`` stands there ``width`` times, without its last 0, 1, ... bytes
    (string ``i * width + a`` lacks ``a``), so that a suffix from any byte on is
    a whole number of symbols in one of them.
    """
    offsets = offsets.astype(np.int32)
    n = np.diff(offsets)
    drop = np.tile(np.arange(width, dtype=np.int32), len(n))
    ends = np.repeat(offsets[1:], width) - drop
    sizes = np.maximum(np.repeat(n, width) - drop, 0) // width
    string = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    j = np.arange(len(string), dtype=np.int32) - np.repeat(np.cumsum(sizes, dtype=np.int32) - sizes, sizes)
    begin = ends[string] - width * (j + 1)
    value = np.zeros(len(begin), np.uint64)
    for _ in range(width):
        value <<= np.uint64(8)
        value |= data[begin]
        begin += 1
    del begin
    # hashed, then only the different symbols are sorted
    coded = pa.array(value).dictionary_encode()
    del value
    names = coded.dictionary.to_numpy()
    kind = np.uint8 if len(names) < 256 else np.uint16 if len(names) < 1 << 16 else np.uint32
    rank = np.empty(len(names), kind)
    rank[np.argsort(names)] = np.arange(1, len(names) + 1, dtype=kind)
    columns = np.zeros((int(sizes.max(initial=0)) + 1, len(sizes)), kind)
    columns[j, string] = rank[coded.indices.to_numpy()]
    return columns, sizes


def repeated_windows(data: np.ndarray, offsets: np.ndarray, docs: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of the windows of ``length`` bytes that occur at an
    earlier place (document, position) of the collection."""
    width = next(w for w in (5, 4, 3, 2, 1) if length % w == 0)
    columns, sizes = columns_of(data, offsets, width)
    c = Collection(columns, sizes)
    del columns
    string, symbols = c.places()
    # suffixes with a neighbour that shares ``length`` bytes; they have so many themselves
    near = np.zeros(len(c.lcp) + 1, bool)
    near[:-1] = c.lcp >= length // width
    at = np.flatnonzero(near[:-1] | near[1:])
    first = np.flatnonzero(~near[at])
    del c
    string, symbols = string[at], symbols[at].astype(np.int64)
    string, lacking = string // width, string % width
    offset = np.diff(offsets)[string] - lacking - width * symbols
    _, order = np.unique(docs, return_inverse=True)
    place = order[string].astype(np.int64)
    place <<= 40
    place += starts[string]
    place += offset
    if not len(at):
        return string, offset
    least = np.minimum.reduceat(place, first)
    later = place > np.repeat(least, np.diff(np.append(first, len(place))))
    return string[later], offset[later]


def sliding(best: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """``best`` (the least or the greatest) of each ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        x = best(x[:-have], x[have:])
        have *= 2
    return best(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    return sliding(np.minimum, x, width)


_FIRST = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x9E37))
_SECOND = mix(_FIRST ^ np.uint64(0xA5A5A5A5A5A5A5A5))


class Pieces:
    """The pieces of the texts of one slice."""

    def __init__(self, text: pa.Array, length: int):
        self.buf, self.offsets = text_bytes(text)
        n, width = len(self.buf), length - GRAM + 1
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_FIRST[self.buf] * up[:n], out=self.sums[1:])
        self._up, self._second = up, None
        self.row = self.start = self.size = np.zeros(0, np.int64)
        self.least = np.zeros(0, np.uint64)
        if n < length:
            return
        grams = self.sums[GRAM:] - self.sums[:-GRAM]
        grams *= self.down[: len(grams)]
        self.grams = grams = mix(grams)
        self._least = least = sliding_least(grams, width)
        # runs of windows with one minimizer, cut where texts begin and where the
        # windows begin that would cross into the next text
        new = np.ones(len(least) + 1, bool)
        np.not_equal(least[1:], least[:-1], out=new[1:-1])
        new[self.offsets[self.offsets < len(least)]] = True
        crossing = self.offsets[1:] - length + 1
        new[crossing[(crossing > 0) & (crossing < len(least))]] = True
        edges = np.flatnonzero(new)
        run, windows = edges[:-1], np.diff(edges)
        # empty texts share an offset with the next: take the text that holds the window
        row = np.searchsorted(self.offsets, run, "right") - 1
        inside = run + length <= self.offsets[row + 1]
        run, windows, row = run[inside], windows[inside], row[inside]
        if not len(run):
            return
        # long runs make several pieces
        parts = -(-windows // _RUN)
        skipped = _RUN * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        self.first = np.repeat(run, parts) + skipped
        self.windows = np.minimum(np.repeat(windows, parts) - skipped, _RUN)
        self.least = least[self.first]
        self.row = np.repeat(row, parts)
        self.start = self.first - self.offsets[self.row]
        self.size = self.windows + length - 1

    def _minima(self) -> np.ndarray:
        """Places of the grams that are the least of a window that holds them."""
        width = len(self.grams) - len(self._least) + 1
        edge = np.zeros(width - 1, np.uint64)
        best = sliding(np.maximum, np.concatenate((edge, self._least, edge)), width)
        return np.flatnonzero(best == self.grams)

    def occurrences(self, which: np.ndarray) -> np.ndarray:
        """How often each chosen piece holds its minimizer."""
        if not len(which):
            return np.zeros(0, np.int64)
        first = self.first[which]
        minima = self._minima()
        low, high = np.searchsorted(minima, np.concatenate((first, first + self.size[which] - GRAM + 1))).reshape(2, -1)
        n = high - low
        hit = self.grams[take(minima, low, n)] == np.repeat(self.least[which], n)
        return np.add.reduceat(hit.astype(np.int64), np.cumsum(n) - n)

    def names(self, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128-bit names of the strings at ``first``."""
        if self._second is None:
            self._second = np.zeros(len(self.buf) + 1, np.uint64)
            np.cumsum(_SECOND[self.buf] * self._up[: len(self.buf)], out=self._second[1:])
        a = (self.sums[first + size] - self.sums[first]) * self.down[first]
        b = (self._second[first + size] - self._second[first]) * self.down[first]
        return mix(a + size.astype(np.uint64)).view(np.int64), mix(b ^ np.uint64(0x77)).view(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], column: str, copies=None) -> Iterator[pa.RecordBatch]:
    """Small slices; with ``copies`` without the rows that may be exact copies,
    unless they are known to be none (``_sure``)."""
    for b in (part for whole in batches for part in portions(whole, column, 4 << 20)):
        if copies is not None:
            may = in_bitmap(copies.value, b.column("_id").to_numpy().view(np.uint64))
            b = b.filter(pa.array(b.column("_sure").to_numpy(zero_copy_only=False) | ~may))
        yield from portions(b, column, _SLICE)


def _batch(names: str, *cols) -> pa.RecordBatch:
    return pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=names.split())


def _minimizers(docs: DataFrame, copies, length: int) -> DataFrame:
    """h, n: how often each minimizer occurs, counted over some thousand texts at a time."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def counted():
            found, inverse = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            return _batch("h n", found.view(np.int64), np.bincount(inverse, np.concatenate([n for _, n in held])).astype(np.int64))

        for b in _slices(batches, "_text", copies):
            p = Pieces(b.column("_text"), length)
            if len(p.row):
                held.append((p.least, p.occurrences(np.arange(len(p.row)))))
            if sum(len(h) for h, _ in held) > _COUNTED:
                yield counted()
                held.clear()
        if held:
            yield counted()

    return docs.select("_id", "_text", "_sure").mapInArrow(run, "h long, n long")


def _marked(docs: DataFrame, copies, length: int, bits) -> DataFrame:
    def run(batches):
        for b in _slices(batches, "_text", copies):
            p = Pieces(b.column("_text"), length)
            which = np.flatnonzero(in_bitmap(bits.value, p.least))
            if len(which):
                c1, c2 = p.names(p.first[which], p.size[which])
                row = p.row[which]
                ids, texts = b.column("_id").to_numpy()[row], b.column("_k").to_numpy()[row]
                own = p.occurrences(which) > 1
                yield _batch("h c1 c2 doc k start size own", p.least[which].view(np.int64), c1, c2, ids, texts, p.start[which], p.size[which].astype(np.int32), own)

    return docs.select("_id", "_k", "_text", "_sure").mapInArrow(run, "h long, c1 long, c2 long, doc long, k long, start long, size int, own boolean")


def place_name(docs: np.ndarray, texts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return mix(docs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (texts.view(np.uint64) ^ starts.astype(np.uint64))) >> np.uint64(1)


def _named(rows: DataFrame) -> DataFrame:
    """The two bits of each (doc, k, start)."""

    def run(batches):
        for b in batches:
            names = place_name(*(b.column(c).to_numpy() for c in ("doc", "k", "start")))
            yield _batch("place", np.concatenate((names, names >> np.uint64(32))).view(np.int64))

    return rows.select("doc", "k", "start").mapInArrow(run, "place long")


def in_both(bits: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Whether the two bits of each name are set."""
    return in_bitmap(bits, names) & in_bitmap(bits, names >> np.uint64(32))


def _strings(docs: DataFrame, copies, length: int, bits, places, hot) -> DataFrame:
    """h, doc, k, start, bytes, hot of the marked pieces whose place may be wanted.
    One that is not wanted only makes its bucket larger."""

    def run(batches):
        for b in _slices(batches, "_text", copies):
            p = Pieces(b.column("_text"), length)
            which = np.flatnonzero(in_bitmap(bits.value, p.least))
            row = p.row[which]
            ids, texts = b.column("_id").to_numpy()[row], b.column("_k").to_numpy()[row]
            keep = in_both(places.value, place_name(ids, texts, p.start[which]))
            which, ids, texts = which[keep], ids[keep], texts[keep]
            if len(which):
                cut = np.concatenate(([0], np.cumsum(p.size[which]))).astype(np.int32)
                data = take(p.buf, p.first[which], p.size[which])
                strings = pa.BinaryArray.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(cut), pa.py_buffer(data)])
                yield _batch("h doc k start bytes hot", p.least[which].view(np.int64), ids, texts, p.start[which], strings, in_bitmap(hot.value, p.least[which]))

    return docs.select("_id", "_k", "_text", "_sure").mapInArrow(run, "h long, doc long, k long, start long, bytes binary, hot boolean")


def _windows(strings: DataFrame, length: int) -> DataFrame:
    """c1, c2, doc, k, at, start of every window of the strings (at: the string's start)."""

    def run(batches):
        for b in _slices(batches, "bytes"):
            p = Pieces(b.column("bytes"), length)
            n = np.maximum(np.diff(p.offsets) - length + 1, 0)
            r = np.repeat(np.arange(len(n)), n)
            s = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            c1, c2 = p.names(p.offsets[r] + s, np.full(len(s), length))
            if len(s):
                doc, k, at = (b.column(c).to_numpy()[r] for c in ("doc", "k", "start"))
                yield _batch("c1 c2 doc k at start", c1, c2, doc, k, at, at + s)

    return strings.select("doc", "k", "start", "bytes").mapInArrow(run, "c1 long, c2 long, doc long, k long, at long, start long")


def _later_spans(strings: DataFrame, length: int, blocks: int) -> DataFrame:
    """doc, k, at, start, end of the repeats inside each block's collection (at:
    the start of the string that holds them)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("h")
        h, docs, texts, starts = (table.column(c).to_numpy() for c in ("h", "doc", "k", "start"))
        data, offsets = text_bytes(table.column("bytes").combine_chunks())
        found, at = [], 0
        ends = np.append(np.flatnonzero(h[1:] != h[:-1]) + 1, len(h))
        while at < len(h):
            # whole buckets, as many as fit
            end = ends[max(np.searchsorted(offsets[ends], offsets[at] + BYTES, "right") - 1, np.searchsorted(ends, at, "right"))]
            part = repeated_windows(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], docs[at:end], starts[at:end], length)
            found.append((part[0] + at, part[1]))
            at = end
        string, offset = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((offset, string))
        string, offset = string[order], offset[order]
        new = np.concatenate(([True], (string[1:] != string[:-1]) | (offset[1:] != offset[:-1] + 1))) if len(string) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(string)) - 1 if len(string) else first
        at = starts[string[first]]
        # what large buckets took goes back to the machine
        pa.default_memory_pool().release_unused()
        return pa.table({"doc": docs[string[first]], "k": texts[string[first]], "at": at, "start": at + offset[first], "end": at + offset[last] + length})

    block = F.pmod(F.xxhash64("h"), F.lit(blocks)).alias("block")
    return strings.select(block, "h", "doc", "k", "start", "bytes").groupBy("block").applyInArrow(run, "doc long, k long, at long, start long, end long")


_ROWS = 64
_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _removal(rows: DataFrame, digest: bool) -> DataFrame:
    """Cut the ``spans`` (array of start, end; or null) out of each packed text."""
    kind = _OUT.replace("kept binary", "kept_sha256 string") if digest else _OUT

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for b in (b.slice(at, _ROWS) for b in batches for at in range(0, b.num_rows, _ROWS)):
            out = [[], [], [], []]
            for packed, done, n, spans in zip(*(b.column(c).to_pylist() for c in ("_packed", "_done", "n_bytes", "spans"))):
                if packed is None:
                    for column, v in zip(out, (n, 0, 0, done)):
                        column.append(v)
                    continue
                data = np.frombuffer(unpack(packed), np.uint8)
                gone = np.zeros(len(data) + 1, np.int32)
                for s in spans or ():
                    gone[s["start"]] += 1
                    gone[min(s["end"], len(data))] -= 1
                gone = np.cumsum(gone)[: len(data)] > 0
                kept = data[~gone].tobytes() if spans else data.tobytes()
                edges = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
                out[0].append(len(data)), out[1].append(int(gone.sum())), out[2].append(edges)
                out[3].append(hashlib.sha256(kept).hexdigest() if digest else kept)
            yield pa.record_batch(
                [b.column("doc_id"), *[pa.array(x, pa.int64()) for x in out[:3]], pa.array(out[3], pa.string() if digest else pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"],
            )

    return rows.select("doc_id", "_packed", "_done", "n_bytes", "spans").mapInArrow(run, kind)


def _maybe(docs: DataFrame, bits, wanted: bool = True) -> DataFrame:
    """The rows whose id the bitmap may hold (or surely does not hold)."""

    def run(batches):
        for b in batches:
            keep = in_bitmap(bits.value, b.column("_id").to_numpy().view(np.uint64))
            yield b.filter(pa.array(keep if wanted else ~keep))

    return docs.mapInArrow(run, docs.schema)


def _packed(docs: DataFrame, bits, digest: bool) -> DataFrame:
    """doc_id, _id, n_bytes, and the compressed text of the rows that may have
    spans; with ``digest`` the others have their digest instead."""

    def run(batches):
        pack = zstandard.ZstdCompressor(3).compress
        for b in (part for whole in batches for part in portions(whole, "_text", 4 << 20)):
            may = in_bitmap(bits.value, b.column("_id").to_numpy().view(np.uint64))
            texts = [(t or "").encode() for t in b.column("_text").to_pylist()]
            packed = [pack(t) if m or not digest else None for t, m in zip(texts, may)]
            done = [None if m or not digest else hashlib.sha256(t).hexdigest() for t, m in zip(texts, may)]
            size = pa.array([len(t) for t in texts], pa.int64())
            yield _batch("doc_id _id _k n_bytes _packed _done", b.column("doc_id"), b.column("_id"), b.column("_k"), size, pa.array(packed, pa.binary()), pa.array(done, pa.string()))

    return docs.select("doc_id", "_id", "_k", "_text").mapInArrow(run, "doc_id long, _id long, _k long, n_bytes long, _packed binary, _done string")


def exact_copies(docs: DataFrame, length: int) -> DataFrame:
    """doc, k, n: later documents with the text of an earlier one, of ``length`` bytes or more."""
    text = F.coalesce("_text", F.lit(""))
    n = F.octet_length(text).cast("long")
    named = docs.select("_id", F.col("_k"), F.xxhash64(F.lit(1), text).alias("h2"), n.alias("n"))
    named = named.filter(F.col("n") >= length)
    first = named.groupBy("_k", "h2", "n").agg(F.min("_id").alias("first"), F.count("*").alias("c")).filter("c > 1")
    # stored, so that the join has an exchange of its own and a hot text can be split
    first = materialize(first, "suffix-texts")
    later = named.join(first, ["_k", "h2", "n"]).filter("_id > first")
    return later.select(F.col("_id").alias("doc"), F.col("_k").alias("k"), "n")


_PLACE = ("doc", "k", "start")


def spans_of(docs: DataFrame, length: int) -> DataFrame:
    """doc, k, start, end: byte ranges covered by windows that occur earlier, of the
    rows with id ``doc`` and a text with hash ``k``."""
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    again = materialize(exact_copies(docs, length), "suffix-copies")
    maybe = send(bitmap_of(again, "doc", again.count()))
    # what may be a copy is joined with the copies; all else surely is none
    rest = _maybe(docs, maybe).join(again.select(F.col("doc").alias("_id"), F.col("k").alias("_k")), ["_id", "_k"], "left_anti")
    rest = materialize(rest.select(*docs.columns), "suffix-rest")
    docs = docs.withColumn("_sure", F.lit(False)).unionByName(rest.withColumn("_sure", F.lit(True)))
    counts = _minimizers(docs, maybe, length).groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h")
    counts = materialize(counts, "suffix-minimizers")
    bits = send(bitmap_of(counts, "h", counts.count()))
    release(counts)
    pieces = materialize(_marked(docs, maybe, length, bits), "suffix-pieces")
    contents = pieces.groupBy("c1", "c2").agg(
        F.min(F.struct("doc", "start", "k")).alias("first"), F.count("*").alias("c"), F.max("h").alias("h"), F.max("own").alias("own")
    )
    contents = materialize(contents, "suffix-contents")
    copies = pieces.join(contents.filter("c > 1").select("c1", "c2", "first"), ["c1", "c2"])
    end = (F.col("start") + F.col("size")).alias("end")
    same_place = F.struct("doc", "start") == F.struct("first.doc", "first.start")
    out = copies.filter(~same_place).select("doc", "k", "start", end)
    # different texts under one id may hold a string at one place, which is first in all of them
    ties = copies.filter(same_place & (F.col("k") != F.col("first.k")))
    ties = materialize(ties.select("doc", "k", F.col("start").alias("at"), F.col("first.k").alias("k1")).distinct(), "suffix-ties")
    buckets = contents.groupBy("h").agg(F.count("*").alias("k"), F.max("own").alias("any"))
    buckets = buckets.filter("k > 1 or any").select("h", (F.col("k") > HOT).alias("hot"))
    want = contents.join(buckets, "h").select("first.doc", "first.k", "first.start", "h", "hot")
    want = materialize(want, "suffix-wanted")
    n, n_all = want.filter("not hot").count(), want.count()
    places = send(bitmap_of(_named(want), "place", n_all, 2))
    hot = want.filter("hot").select("h").distinct()
    strings = _strings(docs, maybe, length, bits, places, send(bitmap_of(hot, "h", 1)))
    inside = _later_spans(strings.filter("not hot"), length, max(1, -(-n // BLOCK)))
    if n < n_all:
        single = materialize(_windows(strings.filter("hot"), length), "suffix-windows")
        first = single.groupBy("c1", "c2").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("c")).filter("c > 1")
        later = single.join(first, ["c1", "c2"]).filter(F.struct("doc", "start") != F.col("first"))
        inside = inside.unionByName(later.select("doc", "k", "at", "start", (F.col("start") + length).alias("end")))
    inside = materialize(inside, "suffix-inside")
    whole = again.select("doc", "k", F.lit(0).cast("long").alias("start"), F.col("n").alias("end"))
    out = out.unionByName(inside.drop("at")).unionByName(whole)
    if not ties.isEmpty():
        found = inside.select("doc", F.col("k").alias("k1"), "at", "start", "end")
        out = out.unionByName(ties.join(found, ["doc", "k1", "at"]).select("doc", "k", "start", "end"))
    out = materialize(out, "suffix-spans")
    release(again, rest, pieces, contents, want, ties, inside)
    return out


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and ``kept`` (the bytes left; with
    ``digest`` their SHA-256 instead) for every row.

    A byte goes if a string of ``length`` bytes covers it that also starts
    earlier: in a document with a smaller id, or before in the same.  Strings are
    judged on the input.  Null text: empty.  A null id comes before all others.
    Of rows with one id none comes before another: an equal string at one place
    in several of them is no repeat there, so repeated rows keep their text, and
    what goes is told for each row by its own text.  Texts are never cut; extra
    columns are not read.
    """
    send = docs.sparkSession.sparkContext.broadcast
    text = F.col(f"`{text_col}`")
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NULL_ID)).alias("_id"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("_k"),
        text.alias("_text"),
    )
    spans = spans_of(rows, length)
    grouped = spans.groupBy("doc", "k").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    n = spans.select(F.approx_count_distinct("doc")).first()[0]
    bits = send(bitmap_of(spans.select("doc").distinct(), "doc", n))
    texts = _packed(rows, bits, digest)
    found = (texts["_id"] == grouped["doc"]) & (texts["_k"] == grouped["k"])
    return _removal(texts.join(grouped, found, "left"), digest)


def op10_suffix_dedup(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs, digest=True)


OP10_SQL = r"""
with b as (
  select doc_id, lower(hex(encode(coalesce(text, '')))) x from documents
), w as (
  select doc_id, p, substr(x, 2 * p + 1, 200) s from (select doc_id, x, unnest(range(0, length(x) // 2 - 99)) p from b)
), l as (
  select doc_id, p from w qualify row_number() over (partition by s order by doc_id, p) > 1
), g as (
  select doc_id, p, p - lag(p) over (partition by doc_id order by p) d from l
), r as (
  select doc_id, p, sum(case when d is null or d > 100 then 1 else 0 end) over (partition by doc_id order by p) run from g
), s as (
  select doc_id, run, min(p) a, max(p) + 100 e from r group by doc_id, run
), k as (
  select doc_id, run, e a, lead(a) over (partition by doc_id order by run) e from s
  union all select doc_id, 0, 0, min(a) from s group by doc_id
), t as (
  select doc_id, sum(e - a)::bigint n_removed, count(*) n_spans from s group by doc_id
), j as (
  select k.doc_id, string_agg(substr(x, 2 * a + 1, case when e is null then length(x) else 2 * (e - a) end), '' order by run) x
  from k join b on k.doc_id = b.doc_id group by k.doc_id
)
select b.doc_id, (length(b.x) // 2)::bigint n_bytes, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_spans, 0)::bigint n_spans,
  sha256(unhex(case when t.doc_id is null then b.x else j.x end)) kept_sha256
from b left join t on b.doc_id = t.doc_id left join j on b.doc_id = j.doc_id"""
