"""Token ids in Arrow stream files of fixed-size lists.

A shard is one stream of record batches with the columns ``ids``
(fixed_size_list<uint16 or uint32>[SEQUENCE]) and ``mask``
(fixed_size_list<bool>[SEQUENCE], false on the padding of the last sequence).
All sequences have one length and all batches but the last one number of rows, so
sequence ``i`` is row ``i % ROWS`` of batch ``i // ROWS``, read as a view of the
mapped file without a copy.  A second stream beside it holds the documents
(doc_id, start, n_tokens).  Shards follow each other in ascending doc_id order.

Texts are encoded where they are read; their ids are dealt out by ranges of doc_id
(ties also by the text's hash, so a repeated id does not fill one task) and sorted
inside them.  A task writes files
under names of its own and returns them; only the manifest of the tasks that
counted names what is read, so lost or repeated tasks leave no trace in it.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.llm.common import SPACES, materialize, shared_path, text_batches
from tilewright.llm.ragged import encode_rows, portions, take
from tilewright.llm.shingles import SPACE, text_bytes

SEQUENCE = 1024
ROWS = 256
END_ID = 2
_MANIFEST = "part int, path string, n_docs long, n_tokens long"
_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def open_fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class ShardWriter:
    """Cuts a stream of ids into sequences; holds one batch at most."""

    def __init__(self, path: str, dtype, sequence: int = SEQUENCE, rows: int = ROWS):
        self.sequence, self.rows, self.dtype = sequence, rows, np.dtype(dtype)
        filesystem, base = open_fs(path)
        filesystem.create_dir(base.rsplit("/", 1)[0], recursive=True)
        value = pa.from_numpy_dtype(self.dtype)
        self.schema = pa.schema([("ids", pa.list_(value, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.docs_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.out = filesystem.open_output_stream(base + ".ids")
        self.docs_out = filesystem.open_output_stream(base + ".docs")
        self.stream = pa.ipc.new_stream(self.out, self.schema)
        self.docs = pa.ipc.new_stream(self.docs_out, self.docs_schema)
        self.held, self.n_held, self.n_tokens, self.n_docs = [], 0, 0, 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        starts = self.n_tokens + np.cumsum(lengths) - lengths
        self.docs.write_batch(pa.record_batch([doc_ids, pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())], schema=self.docs_schema))
        self.n_docs += len(lengths)
        self.n_tokens += len(ids)
        self.held.append(ids.astype(self.dtype))
        self.n_held += len(ids)
        whole = self.sequence * self.rows
        if self.n_held >= whole:
            have = np.concatenate(self.held)
            n = len(have) // whole * whole
            for at in range(0, n, whole):
                self._write(have[at : at + whole], whole)
            self.held, self.n_held = [have[n:]], len(have) - n

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.zeros(len(ids), bool)
        mask[:real] = True
        cols = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (ids, mask)]
        self.stream.write_batch(pa.record_batch(cols, schema=self.schema))

    def close(self) -> None:
        if self.n_held:
            have = np.concatenate(self.held)
            self._write(np.concatenate([have, np.zeros(-len(have) % self.sequence, self.dtype)]), len(have))
        for x in (self.stream, self.docs, self.out, self.docs_out):
            x.close()


class Shard:
    """A written shard; local files are mapped, others read."""

    def __init__(self, path: str):
        filesystem, base = open_fs(path)

        def opened(name: str):
            if filesystem.type_name == "local":
                return pa.ipc.open_stream(pa.memory_map(name))
            return pa.ipc.open_stream(filesystem.open_input_stream(name))

        self.batches = list(opened(base + ".ids"))
        self.docs = opened(base + ".docs").read_all()

    def sequence(self, i: int, column: str = "ids") -> np.ndarray | pa.Array:
        """Sequence ``i`` (ids: a view of the file)."""
        rows = self.batches[0].num_rows
        found = self.batches[i // rows].column(column)
        size = found.type.list_size
        flat = found.flatten().slice(i % rows * size, size)
        return flat.to_numpy(zero_copy_only=True) if column == "ids" else flat

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, start in the shard, ids (uint32) of each document in order."""
        chunks = (b.column("ids").flatten().to_numpy(zero_copy_only=True) for b in self.batches)
        held, at = np.zeros(0, np.uint32), 0
        for doc, start, n in zip(*(self.docs.column(c).to_pylist() for c in ("doc_id", "start", "n_tokens"))):
            parts, need = [], n
            while need:
                if at == len(held):
                    held, at = next(chunks), 0
                part = held[at : at + need]
                parts.append(part)
                at += len(part)
                need -= len(part)
            yield doc, start, (np.concatenate(parts) if len(parts) != 1 else parts[0]).astype("<u4")


#: Letters whose words are encoded many at a time, if the tokenizer agrees that
#: they stay letters: ASCII, Latin with accents, Greek and Cyrillic.
_LETTERS = [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x180), *range(0x391, 0x3CA), *range(0x410, 0x450)]


class WordEncoder:
    """Encodes words with a lower-casing tokenizer whose words end in marked tokens.

    A word of plain letters makes one pre-token, and a run of ``MARKS`` after it
    one more, so both are encoded apart.  Many words of plain letters are encoded
    as one text and cut apart at the tokens that end a pre-token; a count that
    does not come out, like any other word, goes word by word.  A letter is plain
    if the tokenizer itself cuts it from a mark: some letters turn into a letter
    and a combining sign, which would join the mark.
    """

    MARKS = '.,;:!?"#$%&()*+/<=>@[]^_`{|}~'
    TEXT = 500
    KNOWN = 200_000  # words of plain letters that are remembered between batches

    def __init__(self, tokenizer_file: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.normalizers import Sequence
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tok = Tokenizer.from_file(tokenizer_file)
        # lower-case ASCII letters pass the normaliser and the pre-tokenizer as they are
        self.quick = Tokenizer.from_file(tokenizer_file)
        self.quick.normalizer, self.quick.pre_tokenizer = Sequence([]), WhitespaceSplit()
        self.known, self.store, self.size = pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(0, np.int64)
        size = self.tok.get_vocab_size()
        self.id_type = np.dtype(np.uint16 if size <= 1 << 16 else np.uint32)
        self.ends = np.zeros(size, bool)
        for token, i in self.tok.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        plain = "".join(c for c in map(chr, _LETTERS) if c.isalpha() and self._plain(c))
        self.plain, self.simple = plain, f"^[{plain}]+[{re.escape(self.MARKS)}]*$"

    def _plain(self, c: str) -> bool:
        text = self.tok.normalizer.normalize_str(f"a{c}a{c}.") if self.tok.normalizer else f"a{c}a{c}."
        cut = [text[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)]
        return len(cut) == 2 and cut[0].isalpha() and cut[1] == "."

    @staticmethod
    def _ids(tok, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _single(self, words: list[str]) -> list[np.ndarray]:
        return self._ids(self.tok, words)

    def _together(self, words: pa.StringArray, tok) -> tuple[list[np.ndarray], list[np.ndarray]]:
        ids, sizes = [], []
        starts = range(0, len(words), self.TEXT)
        texts = [" ".join(words.slice(at, self.TEXT).to_pylist()) for at in starts]
        for at, found in zip(starts, self._ids(tok, texts)):
            n = min(self.TEXT, len(words) - at)
            cut = np.flatnonzero(self.ends[found]) + 1
            if len(cut) == n and cut[-1] == len(found):
                ids.append(found), sizes.append(np.diff(cut, prepend=0))
            else:
                each = self._single(words.slice(at, n).to_pylist())
                ids += each
                sizes.append(np.array([len(x) for x in each], np.int64))
        return ids, sizes

    def _bases(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(store of ids, start and number of each) of different words of plain letters."""
        at = pc.index_in(words, value_set=self.known) if len(self.known) else pa.nulls(len(words), pa.int32())
        new = words.filter(pc.is_null(at))
        ascii_ = pc.string_is_ascii(new)
        groups = [(new.filter(ascii_), self.quick), (new.filter(pc.invert(ascii_)), self.tok)]
        done = [self._together(w, tok) for w, tok in groups]
        ids, sizes = ([x for g in done for x in g[i]] for i in (0, 1))
        # where the new words come to stand: those of ASCII letters first
        place = np.argsort(np.argsort(~ascii_.to_numpy(zero_copy_only=False), kind="stable"), kind="stable") + len(self.known)
        self.known = pa.concat_arrays([self.known, *[w for w, _ in groups]])
        self.store, self.size = np.concatenate([self.store, *ids]), np.concatenate([self.size, *sizes])
        starts = np.cumsum(self.size) - self.size
        is_new = at.is_null().to_numpy(zero_copy_only=False)
        at = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        at[is_new] = place
        out = self.store, starts[at], self.size[at]
        if len(self.known) > self.KNOWN:
            # start again with the words in use
            self.known, self.store, self.size = words, take(*out), out[2]
        return out

    def __call__(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, ids of each); white space at their ends counts for nothing."""
        words = pc.utf8_rtrim(words, SPACES)
        simple = pc.match_substring_regex(words, self.simple)
        some = words.filter(simple)
        marks = pc.utf8_ltrim(some, self.plain).dictionary_encode()
        bases = pc.ascii_lower(pc.utf8_rtrim(some, self.MARKS)).dictionary_encode()
        flat, base_starts, size = self._bases(bases.dictionary)
        rest = self._single(words.filter(pc.invert(simple)).to_pylist())
        # one store of ids: the bases, then the marks, then the other words
        more = [np.zeros(0, np.int32), *self._single(marks.dictionary.to_pylist()), *rest]
        store = np.concatenate([flat, *more])
        lengths = np.concatenate([size, [len(x) for x in more]]).astype(np.int64)
        starts = np.concatenate([base_starts, len(flat) + np.cumsum(lengths[len(size) :]) - lengths[len(size) :]])
        simple = simple.to_numpy(zero_copy_only=False)
        part = np.zeros((len(words), 2), np.int64)  # the two parts of each word in the store
        part[simple, 0] = bases.indices.to_numpy()
        part[simple, 1] = len(size) + 1 + marks.indices.to_numpy()
        part[~simple, 0] = len(size) + 1 + len(marks.dictionary) + np.arange(len(rest))
        part[~simple, 1] = len(size)
        return take(store, starts[part].ravel(), lengths[part].ravel()), lengths[part].sum(1)


def word_slices(text: pa.Array) -> pa.ListArray:
    """Each text's words with the white space after them (and the white space that
    a text begins with), as slices of the texts' own bytes."""
    buf, rows = text_bytes(text)
    blank = SPACE[buf]
    cut = ~blank
    cut[1:] &= blank[:-1]
    cut[rows[:-1][rows[:-1] < len(buf)]] = True
    starts = np.flatnonzero(cut)
    strings = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(buf)).astype(np.int32)), pa.py_buffer(buf))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, rows), pa.int32()), strings)


@cache
def _encoder(tokenizer_file: str) -> WordEncoder:
    """One a Python worker, for all its tasks."""
    return WordEncoder(tokenizer_file)


def _encoded(rows: DataFrame, tokenizer_file: str, bounds: list[int], end_id: int) -> DataFrame:
    """part, doc_id, h, ids (binary numbers of ``id_type``) from doc_id, h, text.

    ``part``: the range of doc_id.  An id that fills several ranges, so that it is
    a bound more than once, is dealt over them by ranges of h.
    """
    edges = np.array(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _encoder(tokenizer_file)
        for b in batches:
            text = pc.fill_null(b.column("text"), "")
            ids, n = encode_rows(word_slices(text), units)
            data = np.insert(ids, np.cumsum(n), end_id).astype(units.id_type)
            cut = np.concatenate(([0], np.cumsum(n + 1))) * data.itemsize
            binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(cut), pa.py_buffer(data)])
            doc = pc.fill_null(b.column("doc_id"), np.iinfo(np.int64).min).to_numpy()
            low, high = np.searchsorted(edges, doc, "left"), np.searchsorted(edges, doc, "right")
            # the upper 31 bits of h, from 0: times fewer than 2**31 ranges fits
            place = (b.column("h").to_numpy() >> 33) + (1 << 30)
            part = low + (place * np.maximum(high - low, 1) >> 31)
            yield pa.record_batch([pa.array(part, pa.int32()), b.column("doc_id"), b.column("h"), binary.cast(pa.binary())], names=["part", "doc_id", "h", "ids"])
            # what Arrow keeps of a portion's arrays would stay with the worker
            del text, ids, n, data, cut, binary, doc, low, high, place, part
            pa.default_memory_pool().release_unused()

    return text_batches(rows, "text", run, "part int, doc_id long, h long, ids binary", 2 << 20)


def write_tokens(
    docs: DataFrame, path: str, tokenizer_file: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID
) -> DataFrame:
    """Writes shards under ``path``; returns the manifest (part, path, n_docs, n_tokens, base).

    The tokenizer drops white space and never joins across it, so each distinct
    word of a batch is encoded once.  Null text: empty, the end id alone.  Null
    ids come first, equal ids in the order of their texts' hashes, repeated rows
    stay.  Texts are never cut.  An empty table has an empty manifest.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, part = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                kind = _encoder(tokenizer_file).id_type
                name, part = f"{path}/{uuid.uuid4().hex}", batch.column("part")[0].as_py()
                writer = ShardWriter(name, kind)
            for b in portions(batch, "ids", 8 << 20):
                data, cut = text_bytes(b.column("ids"))
                writer.add(b.column("doc_id"), np.frombuffer(data.tobytes(), kind), np.diff(cut) // kind.itemsize)
        if writer is not None:
            writer.close()
            row = (part, name, writer.n_docs, writer.n_tokens)
            yield pa.record_batch([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["part", "path", "n_docs", "n_tokens"])

    spark = docs.sparkSession
    doc_id = F.col(f"`{id_col}`").cast("long")
    # ranges from the ids alone: the texts are read once, and only ids are shuffled
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / n for i in range(1, n)] or [0.5]
    found = docs.select(F.percentile_approx(doc_id, shares, max(10_000, 20 * n))).first()[0] or []
    rows = docs.select(doc_id.alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("h"), F.col(f"`{text_col}`").alias("text"))
    rows = _encoded(rows, tokenizer_file, found[: n - 1], end_id)
    rows = rows.repartitionById(n, F.col("part")).sortWithinPartitions("part", "doc_id", "h", "ids")
    manifest = materialize(rows.mapInArrow(write, _MANIFEST), "token-manifest")
    # one row a shard
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                rows = [(d, base + s, len(x), zlib.crc32(x.tobytes())) for d, s, x in Shard(path).documents()]
                for at in range(0, len(rows), 10_000):
                    cols = zip(*rows[at : at + 10_000])
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.sparkSession.sparkContext.defaultParallelism)
    return manifest.select("path", "base").repartition(4 * n, "path").mapInArrow(read, _READ)


def op3_token_output(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    return read_tokens(write_tokens(docs, shared_path(docs.sparkSession, "tokens"), tokenizer_file))
