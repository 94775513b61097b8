"""SentencePiece encoding and decoding as a streaming lattice search.

The search reads characters one by one and keeps, for each boundary, the best
piece that ends there.  For a unigram model the best piece is Viterbi's: the
highest sum of scores.  For a BPE model exactly one piece can end a prefix's
encoding: the one that stays apart from the piece before it when the two are
merged again; the back pointers then spell the same ids as merging the whole
text would.  Only boundaries within the longest piece's length can still be
extended; once the back pointers of all of them meet in one boundary, the ids up
to it are settled and leave the window.

``Lanes`` runs this search over many strings side by side, a character of each a
round, with the window as columns of arrays; ``Lattice`` runs it over one string.

No piece holds a word mark after another character, so every path passes through
the boundary before a word and a word's ids do not depend on its neighbours.
Texts are therefore cut into words, and a word that a batch repeats is searched
once in it; for models without this property a text is one string.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import text_batches
from tilewright.llm.ragged import encode_rows, take
from tilewright.llm.shingles import text_bytes

MARK = "▁"
_PAIRS = 1 << 20  # remembered answers of ``stays``
_NEVER = 1 << 60


class Table:
    """Fixed integer keys -> numbers, looked up by whole arrays (-1: no such key)."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(8, int(4 * len(keys)).bit_length()))
        self.mask = (1 << (64 - int(self.shift))) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.values = np.full(self.mask + 1, -1, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = np.flatnonzero(self.keys[at] == -1)
            slots, first = np.unique(at[free], return_index=True)
            placed = free[first]
            self.keys[slots], self.values[slots] = keys[left[placed]], values[left[placed]]
            rest = np.ones(len(left), bool)
            rest[placed] = False
            left, at = left[rest], (at[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        again = np.flatnonzero((found != keys) & (found != -1))
        at = at[again]
        while len(again):
            at = (at + 1) & self.mask
            found = self.keys[at]
            hit = found == keys[again]
            out[again[hit]] = self.values[at[hit]]
            more = ~hit & (found != -1)
            again, at = again[more], at[more]
        return out


class PieceModel:
    """Pieces, scores and options of a SentencePiece model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        kind = type(proto.pieces[0])
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models with identity normalisation are read")
        scores, self.bytes, self.out = {}, {}, []
        for i, p in enumerate(proto.pieces):
            out = b""
            if p.type == kind.BYTE:
                out = bytes([int(p.piece[3:5], 16)])
                self.bytes[out[0]] = i
            elif p.type in (kind.NORMAL, kind.USER_DEFINED):
                scores[p.piece] = (i, p.score)
                out = p.piece.replace(MARK, " ").encode()
            self.out.append(out)
        sizes = np.array([len(b) for b in self.out], np.int64)
        self.flat = np.frombuffer(b"".join(self.out), np.uint8)
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        self.prefix, self.unknown = norm.add_dummy_prefix, proto.trainer_spec.unk_id
        self._prepare(scores, proto.trainer_spec.model_type == 1, len(proto.pieces))

    @classmethod
    def of_scores(cls, scores: dict[str, float], unigram: bool) -> PieceModel:
        """A model without file: ids in the order of ``scores``."""
        self = cls.__new__(cls)
        self.bytes, self.prefix, self.unknown = {}, False, -1
        self._prepare({p: (i, s) for i, (p, s) in enumerate(scores.items())}, unigram, len(scores))
        return self

    def _prepare(self, pieces: dict[str, tuple[int, float]], unigram: bool, size: int) -> None:
        self.unigram, self.size = unigram, size
        self.ids = {p: i for p, (i, _) in pieces.items()}
        self.scores = {p: s for p, (_, s) in pieces.items()}
        self.longest = max(map(len, self.ids))
        self.words_apart = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.floor = min(self.scores.values()) - 10.0
        # characters that pieces hold but that are no pieces get numbers past the
        # ids; one more stands for all other characters, one for no piece at all
        chars = sorted({c for p in self.ids for c in p})
        self.numbers = dict(self.ids)
        for c in chars:
            self.numbers.setdefault(c, size + len(self.numbers) - len(self.ids))
        self.other = size + len(self.numbers) - len(self.ids)
        self.none = self.other + 1
        self.names: list[str | None] = [None] * (self.none + 1)
        for p, i in self.numbers.items():
            self.names[i] = p
        self.char_code = np.zeros(0x110000, np.int32)
        self.char_code[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.char_code[32] = self.char_code[ord(MARK)]
        self.n_codes = len(chars) + 1
        self._reversed_trie()
        self.score_of = np.full(self.none + 1, self.floor)
        for p, s in self.scores.items():
            self.score_of[self.ids[p]] = s
        if not unigram:
            self._merges()

    def _reversed_trie(self) -> None:
        """Pieces from their last character on: a state for each ending."""
        code = self.char_code
        states: dict[int, int] = {}
        piece = [-1]
        for p, i in self.numbers.items():
            at = 0
            for c in reversed(p):
                key = at * self.n_codes + int(code[ord(c)])
                at = states.get(key, 0)
                if not at:
                    at = states[key] = len(piece)
                    piece.append(-1)
            piece[at] = i
        self.next = Table(np.fromiter(states, np.int64, len(states)), np.fromiter(states.values(), np.int64, len(states)))
        self.piece_at = np.array(piece, np.int32)

    def _merges(self) -> None:
        """How each piece comes out of merging, and when: its clock is the worst
        rank among the merges it needs, as merges of independent places run in
        the order of their clocks."""
        n = self.none + 1
        order = {s: k for k, s in enumerate(sorted(set(self.scores.values()), reverse=True))}
        self.rank = np.zeros(n, np.int64)
        self.clock, self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        self.whole = np.ones(n, bool)
        pairs, numbers = {}, self.numbers
        for p, i in self.ids.items():
            self.rank[i] = order[self.scores[p]]
            for k in range(1, len(p)):
                a, b = numbers.get(p[:k]), numbers.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * n + b] = i
        for p in sorted(self.ids, key=len):
            if len(p) > 1:
                i, last = self.ids[p], self.merged(p, 2)
                self.whole[i] = len(last) == 2 and self.merged(p) == [p]
                if self.whole[i]:
                    a, b = numbers[last[0]], numbers[last[1]]
                    self.left[i], self.right[i] = a, b
                    self.clock[i] = max(self.rank[i], self.clock[a], self.clock[b])
        self.joined = Table(np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs)))
        self.seen, self.answer = np.full(_PAIRS, -1, np.int64), np.zeros(_PAIRS, bool)

    def merged(self, text: str, until: int = 1) -> list[str]:
        """BPE by definition, for short strings: best score first, then leftmost."""
        parts, scores = list(text), self.scores
        while len(parts) > until:
            best, at = None, 0
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stay(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Do the pieces come out of merging their joined text again?  Answers are
        remembered, each in one place, so memory is bounded."""
        key = before.astype(np.int64) * (self.none + 1) + piece
        slot = (key * 0x9E3779B1 >> 7) & (_PAIRS - 1)
        new = np.flatnonzero(self.seen[slot] != key)
        out = self.answer[slot]
        if len(new):
            keys, first, inverse = np.unique(key[new], return_index=True, return_inverse=True)
            found = self._stay(before[new[first]], piece[new[first]])
            out[new] = found[inverse]
            self.seen[slot[new]] = key[new]
            self.answer[slot[new]] = out[new]
        return out

    def _stay(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Undo both pieces, the later merge first, along the seam: if two parts
        that meet there at some time would be merged before either goes into its
        own next part, the pieces do not stay."""
        out = self.whole[piece].copy()
        live = np.flatnonzero(out & (before < self.other) & (piece < self.other))
        a, b = before[live].astype(np.int64), piece[live].astype(np.int64)
        a_ends, b_ends = np.full(len(live), _NEVER), np.full(len(live), _NEVER)
        slow = []
        while len(live):
            m = self.joined.get(a * (self.none + 1) + b)
            ta, tb = self.clock[a], self.clock[b]
            when = np.where(m >= 0, np.maximum(self.rank[m], np.maximum(ta, tb)), _NEVER + 1)
            ends = np.minimum(a_ends, b_ends)
            # the same clock on both sides of the seam: merge by definition
            unclear = (when == ends) | ((ta == tb) & (ta >= 0))
            crosses = (when < ends) & ~unclear
            out[live[crosses]] = False
            slow.append(live[unclear])
            go = ~crosses & ~unclear & ((ta >= 0) | (tb >= 0))
            live, a, b, a_ends, b_ends, ta, tb = live[go], a[go], b[go], a_ends[go], b_ends[go], ta[go], tb[go]
            undo = ta > tb
            a_ends, b_ends = np.where(undo, ta, a_ends), np.where(undo, b_ends, tb)
            a, b = np.where(undo, self.right[a], a), np.where(undo, b, self.left[b])
        for i in np.concatenate(slow).tolist() if slow else ():
            u, v = self.names[before[i]], self.names[piece[i]]
            out[i] = self.merged(u + v) == [u, v]
        return out

    def stays(self, before: str | None, piece: str) -> bool:
        u = self.none if before is None else self.numbers.get(before, self.other)
        return bool(self.stay(np.array([u]), np.array([self.numbers.get(piece, self.other)]))[0])

    def to_ids(self, piece: str) -> list[int]:
        found = self.ids.get(piece)
        if found is not None:
            return [found]
        return [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unknown]

    def normalise(self, text: str) -> str:
        return ((MARK if self.prefix else "") + text.replace(" ", MARK)) if text else ""


class Lattice:
    """Streaming search over one string; ``feed`` and ``close`` yield settled pieces."""

    def __init__(self, model: PieceModel):
        self.m = model
        self.n = 0  # characters read
        self.settled = 0
        self.tail = ""  # the last characters, as many as a piece can have
        self.back = {0: (0, None, 0.0)}  # boundary -> (start of its piece, the piece, score)

    def feed(self, chars: str) -> Iterator[str]:
        m, back = self.m, self.back
        for c in chars:
            self.n += 1
            n = self.n
            tail = self.tail = (self.tail + c)[-m.longest :]
            best = None
            for k in range(min(len(tail), n - self.settled), 0, -1):
                start = n - k
                if start not in back:
                    continue
                piece = tail[-k:]
                known = piece in m.ids
                if not known and k > 1:
                    continue
                before = back[start]
                if m.unigram:
                    score = before[2] + (m.scores[piece] if known else m.floor)
                    if best is None or score > best[2]:
                        best = (start, piece, score)
                elif m.stays(before[1], piece):
                    best = (start, piece, 0.0)
                    break
            if best is not None:
                back[n] = best
            if n % m.longest == 0 and n - self.settled > m.longest:
                yield from self._settle()

    def _settle(self) -> Iterator[str]:
        """Follow the live boundaries' back pointers to where they meet."""
        live = {b for b in self.back if b > self.n - self.m.longest and b >= self.settled}
        while len(live) > 1:
            last = max(live)
            live.discard(last)
            live.add(self.back[last][0])
        yield from self._emit(live.pop() if live else self.settled)

    def _emit(self, end: int) -> Iterator[str]:
        found, at = [], end
        while at > self.settled:
            start, piece, _ = self.back[at]
            found.append(piece)
            at = start
        yield from reversed(found)
        if end > self.settled:
            for b in [b for b in self.back if b < end]:
                del self.back[b]
            self.settled = end

    def close(self) -> Iterator[str]:
        yield from self._emit(self.n)


class Lanes:
    """The streaming search over many strings at once, a character of each a round.

    The window is a ring of rows, one a boundary: the piece that ends there in
    each string, its length and, for unigram models, its score.  Every
    ``longest`` rounds the live boundaries of each string are followed back to
    where they meet; what is settled leaves the ring, which only grows if some
    string does not settle in time.  ``most`` is the largest ring that was needed.
    """

    def __init__(self, model: PieceModel):
        self.m, self.searched, self.most = model, 0, 0

    def encode(self, strings: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all strings one after another, ids of each)."""
        m = self.m
        size = pc.utf8_length(strings).to_numpy().astype(np.int64)
        points = np.frombuffer(text_bytes(strings)[0].tobytes().decode().encode("utf-32-le"), np.uint32)
        self.searched += len(strings)
        lanes = np.argsort(-size, kind="stable")
        self.size, self.at = size[lanes], (np.cumsum(size) - size)[lanes]
        self.code = m.char_code[points]
        self.found = np.full(len(points), -1, np.int32)  # settled pieces, where they end
        self.settled = np.zeros(len(lanes), np.int64)
        rows = 3 * m.longest
        self.piece = np.full((rows, len(lanes)), -1, np.int32)
        self.length = np.zeros((rows, len(lanes)), np.int16)
        self.score = np.zeros((rows, len(lanes))) if m.unigram else None
        self.piece[0] = m.none
        longest = int(size.max(initial=0))
        # strings that have a character in round n: the first ``live[n]``
        live = len(size) - np.searchsorted(np.sort(size), np.arange(longest + 2))
        for n in range(1, longest + 1):
            self._round(n, int(live[n]))
            self._emit(np.arange(live[n + 1], live[n]), n)
            if n % m.longest == 0 and live[n + 1]:
                self._settle(n, int(live[n + 1]))
        self.most = max(self.most, len(self.piece))
        ends = np.flatnonzero(self.found >= 0)
        ids = self.found[ends]
        per = np.searchsorted(ends, np.cumsum(size)) - np.searchsorted(ends, np.cumsum(size) - size)
        strange = np.flatnonzero(ids >= m.size)
        if len(strange):
            # characters without a piece: their bytes, or the unknown id
            coded = [m.to_ids(chr(c)) for c in points[ends[strange]].tolist()]
            times = np.ones(len(ids), np.int64)
            times[strange] = [len(x) for x in coded]
            cut = np.concatenate(([0], np.cumsum(per)))
            after = np.concatenate(([0], np.cumsum(times)))
            ids = np.repeat(ids, times)
            ids[take(np.arange(len(ids)), after[strange], times[strange])] = np.concatenate(coded)
            per = after[cut[1:]] - after[cut[:-1]]
        return ids, per

    def _round(self, n: int, live: int) -> None:
        m, rows = self.m, len(self.piece)
        here, best = self.piece[n % rows], self.score[n % rows] if m.unigram else None
        here[:live] = -1
        lane = np.arange(live)
        state = np.zeros(live, np.int64)
        for k in range(1, min(m.longest, n) + 1):
            code = self.code[self.at[lane] + (n - k)]
            state = m.next.get(state * m.n_codes + code)
            if k == 1:
                piece = np.where(state >= 0, m.piece_at[state], m.other)
            else:
                on = state >= 0
                lane, state = lane[on], state[on]
                piece = m.piece_at[state]
            if not len(lane):
                return
            before = self.piece[(n - k) % rows, lane]
            test = np.flatnonzero((piece >= 0) & (before >= 0) & (n - k >= self.settled[lane]))
            if m.unigram:
                one = (piece[test] < m.size) | (k == 1)
                test = test[one]
                score = self.score[(n - k) % rows, lane[test]] + m.score_of[piece[test]]
                better = (here[lane[test]] < 0) | (score >= best[lane[test]])
                test = test[better]
                best[lane[test]] = score[better]
            else:
                test = test[m.stay(before[test], piece[test])]
            hit = lane[test]
            here[hit] = piece[test]
            self.length[n % rows, hit] = k
            go = state >= 0
            if not m.unigram:
                go[test] = False  # only one piece can end here
            lane, state = lane[go], state[go]

    def _settle(self, n: int, live: int) -> None:
        """Follow each string's live boundaries back to where they meet."""
        m, rows = self.m, len(self.piece)
        lane = np.arange(live)
        at = np.repeat(np.arange(max(0, n - m.longest + 1), n + 1)[:, None], live, 1)
        while True:
            top = at.max(0)
            if (top == at.min(0)).all():
                break
            back = top - self.length[top % rows, lane]
            at = np.where((at == top) & (at.min(0) < top), back, at)
        self._emit(lane, at[0])
        if n + m.longest - int(self.settled[:live].min()) >= rows:
            grown = 2 * rows
            span = np.arange(max(0, n - rows + 1), n + 1)
            for name in ("piece", "length", "score"):
                old = getattr(self, name)
                if old is not None:
                    new = np.zeros((grown, old.shape[1]), old.dtype)
                    new[span % grown] = old[span % rows]
                    setattr(self, name, new)

    def _emit(self, lane: np.ndarray, end) -> None:
        """Settle these strings up to boundary ``end``."""
        rows = len(self.piece)
        at = np.broadcast_to(end, len(lane)).astype(np.int64)
        stop = self.settled[lane]
        self.settled[lane] = np.maximum(at, stop)
        while len(lane):
            on = at > stop
            lane, at, stop = lane[on], at[on], stop[on]
            self.found[self.at[lane] + at - 1] = self.piece[at % rows, lane]
            at = at - self.length[at % rows, lane]


#: Strings of more characters than this are searched one by one.
ALONE = 512
_SIDE = 1 << 16  # strings side by side


class Codec:
    """Encodes and decodes Arrow string arrays with one model."""

    def __init__(self, model_file: str):
        self.model = PieceModel(model_file)
        self.lanes = Lanes(self.model)

    def search(self, strings: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all strings, ids of each)."""
        m = self.model
        long = np.flatnonzero(pc.utf8_length(strings).to_numpy() > ALONE)
        short = pc.if_else(pc.greater(pc.utf8_length(strings), ALONE), "", strings) if len(long) else strings
        done = [self.lanes.encode(short.slice(at, _SIDE)) for at in range(0, len(short), _SIDE)]
        ids, per = (np.concatenate([x[i] for x in done]) if done else np.zeros(0, np.int64) for i in (0, 1))
        if len(long):
            cut, parts, at = np.concatenate(([0], np.cumsum(per))), [], 0
            for i in long.tolist():
                one = Lattice(m)
                text = strings[i].as_py().replace(" ", MARK)
                found = np.array([x for ps in (one.feed(text), one.close()) for p in ps for x in m.to_ids(p)], np.int32)
                parts += [ids[at : cut[i]], found]
                at, per[i] = cut[i], len(found)
            ids = np.concatenate([*parts, ids[at:]])
        return ids.astype(np.int32), per

    def units(self, text: pa.Array) -> pa.ListArray:
        """Each text's strings that are searched by themselves."""
        m = self.model
        text = pc.replace_substring(text, MARK, " ")
        if m.prefix:
            text = pc.if_else(pc.equal(text, ""), "", pc.binary_join_element_wise(" ", text, ""))
        buf, rows = text_bytes(text)
        if m.words_apart:
            cut = buf == 32
            cut[1:] &= buf[:-1] != 32
        else:
            cut = np.zeros(len(buf), bool)
        cut[rows[:-1][rows[:-1] < len(buf)]] = True
        starts = np.flatnonzero(cut)
        offsets = np.append(starts, len(buf)).astype(np.int32)
        strings = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(buf))
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, rows), pa.int32()), strings)

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text); a string that occurs again is searched once."""
        return encode_rows(self.units(text), self.search)

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes and their number for each row of ids."""
        m = self.model
        size = m.sizes[ids] if len(ids) else np.zeros(0, np.int64)
        flat = take(m.flat, m.starts[ids] if len(ids) else size, size)
        ends = np.concatenate(([0], np.cumsum(size)))
        rows = np.concatenate(([0], np.cumsum(lengths)))
        offsets = ends[rows]
        if m.prefix and len(flat):
            # the space that the prefix stands for goes again
            first = offsets[:-1][lengths > 0]
            first = first[flat[first] == 32]
            keep = np.ones(len(flat), bool)
            keep[first] = False
            gone = np.concatenate(([0], np.cumsum(~keep)))
            flat, offsets = flat[keep], offsets - gone[offsets]
        return flat, np.diff(offsets)


@cache
def codec_of(model_file: str) -> Codec:
    """One a Python worker, for all its tasks."""
    return Codec(model_file)


_CODED = "n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean"


def code(docs: DataFrame, model_file: str, *, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (ids as little-endian unsigned 32-bit numbers),
    decoded_sha256, round_trip, and with ``ids`` the ids, for every row.

    Null text: no pieces, like an empty one.  A text with the word mark itself
    comes back with a space for it (round_trip false).  Unknown characters are
    coded byte by byte.  Texts are never cut; repeated rows are coded each.
    """
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model_file)
        for batch in batches:
            text = pc.fill_null(batch.column(1), "")
            flat, n = codec.encode(text)
            data, sizes = codec.decode(flat, n)
            little = memoryview(flat.astype("<u4")).cast("B")
            back, whole = memoryview(data), memoryview(text_bytes(text)[0])
            cut = np.concatenate(([0], np.cumsum(n)))
            byte = np.concatenate(([0], np.cumsum(sizes))).tolist()
            given = text_bytes(text)[1].tolist()
            at = (4 * cut).tolist()
            crc, sha, same = [], [], []
            for i in range(len(text)):
                crc.append(zlib.crc32(little[at[i] : at[i + 1]]))
                one = back[byte[i] : byte[i + 1]]
                sha.append(hashlib.sha256(one).hexdigest())
                same.append(one == whole[given[i] : given[i + 1]])
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())]
            names = ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "round_trip"]
            if ids:
                cols.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(flat, pa.int32())))
                names.append("ids")
            yield pa.record_batch(cols, names=names)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return text_batches(rows, "text", run, "doc_id long, " + _CODED + (", ids array<int>" if ids else ""))


def op1_sentencepiece(docs: DataFrame, model_file: str) -> DataFrame:
    return code(docs, model_file)
