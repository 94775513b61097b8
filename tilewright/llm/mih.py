"""Approximate nearest neighbours by multi-index hashing.

Vectors are turned by a learned rotation (iterative quantisation on a bounded
sample) and their signs form a code of one bit a dimension.  The code is cut into
substrings, each with an index of its own.  Two codes within Hamming radius ``r``
agree in some substring up to ``r // m`` bits (pigeonhole), so probing every
index for substrings that near finds all codes within ``r``; those are then
ranked by the inner product of the original vectors in double precision.

More exactly, with ``r = m a + b`` the first ``b + 1`` substrings need ``a`` bits
and the others ``a - 1``.

Every base vector is dealt out once a substring, by its number and the leading
bits of its value; a query goes to those buckets whose leading bits are near
enough.  In a bucket the near values are looked up by key, the whole codes found
there are compared, and a row is ranked by the first substring that finds it, so
by one task only.  Buckets of many rows are split by a hash of the id, and so are
the queries of a bucket (the base rows then go to each part), so no task holds
more than a bounded number of rows.  A query's best of every bucket meet in a
bounded merge; queries for which too few rows were found are asked again with a
larger radius.  The radius is the least that finds the wanted share of true
neighbours for a sample of queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.llm.common import materialize, release
from tilewright.llm.ragged import take

TOP = 20
#: Rows of the fitting sample and its queries (documented bounds).
SAMPLE, SAMPLE_QUERIES = 20_000, 200
RECALL = 0.96
BASE_BLOCK, QUERY_BLOCK = 16_384, 32_768
_BITS = 16
_ROUNDS = 20


def fit_rotation(sample: np.ndarray, rounds: int = _ROUNDS) -> np.ndarray:
    """An orthogonal matrix that brings the vectors near the corners of a cube."""
    d = sample.shape[1]
    q, _ = np.linalg.qr(np.random.RandomState(11).randn(d, d))
    for _ in range(rounds):
        signs = np.where(sample @ q >= 0, 1.0, -1.0)
        u, _, vt = np.linalg.svd(signs.T @ sample)
        q = (u @ vt).T
    return q


def encode(vectors: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """Codes as rows of 16-bit substrings (the last padded with zeros)."""
    bits = vectors @ rotation >= 0
    pad = -bits.shape[1] % _BITS
    bits = np.pad(bits, ((0, 0), (0, pad)))
    packed = np.packbits(bits, axis=1)
    return packed.view(">u2").astype(np.uint16)


_POP = np.array([bin(i).count("1") for i in range(1 << _BITS)], np.uint8)


_VALUES = 1 << _BITS
#: All values of a substring in the order of their bits: masks of up to so many bits lead.
_MASKS = np.argsort(_POP, kind="stable").astype(np.uint16)
_MASK_ENDS = np.cumsum(np.bincount(_POP))


def radii(radius: int, parts: int) -> list[int]:
    """How far each substring must be probed to find all codes within ``radius``
    (below 0: not at all)."""
    a, b = divmod(radius, parts)
    return [min(_BITS, a if j <= b else a - 1) for j in range(parts)]


class Bucket:
    """Rows of one bucket of substring ``j``, in a table by the substring's value."""

    def __init__(self, codes: np.ndarray, j: int):
        self.j, self.order = j, np.argsort(codes[:, j], kind="stable")
        self.codes = codes[self.order]
        self.words = as_words(self.codes)
        self.count = np.bincount(self.codes[:, j], minlength=_VALUES)
        self.start = np.cumsum(self.count) - self.count

    def within(self, code: np.ndarray, words: np.ndarray, radius: int) -> np.ndarray:
        """Rows within ``radius`` of ``code`` that no substring before finds."""
        near = radii(radius, len(code))
        if near[self.j] < 0:
            return np.zeros(0, np.int64)
        keys = _MASKS[: _MASK_ENDS[near[self.j]]] ^ code[self.j]
        keys = keys[self.count[keys] > 0]
        rows = take(np.arange(len(self.order)), self.start[keys], self.count[keys])
        far = np.zeros(len(rows), np.uint16)
        for w, q in zip(self.words, words):
            far += np.bitwise_count(w[rows] ^ q)
        rows = rows[far <= radius]
        for i in range(self.j):
            rows = rows[_POP[self.codes[rows, i] ^ code[i]].astype(np.int64) > near[i]]
        return self.order[rows]


def as_words(codes: np.ndarray) -> np.ndarray:
    """Codes as columns of 64-bit words."""
    pad = -codes.shape[1] % 4
    return np.ascontiguousarray(np.pad(codes, ((0, 0), (0, pad)))).view(np.uint64).T.copy()


def inner(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, each summed from the first component to the last, so equal
    vectors get equal scores wherever they stand."""
    out = np.zeros(len(vectors))
    for k in range(len(query)):
        out += vectors[:, k] * query[k]
    return out


def best_of(ids: np.ndarray, vectors: np.ndarray, query: np.ndarray, top: int):
    """The ``top`` best rows for a query, equal scores by id."""
    if len(ids) > top:
        # a quick product with its rounding as a margin leaves few rows to rank
        quick = vectors @ query
        margin = 4 * len(query) * np.finfo(float).eps * np.abs(query).sum() * np.abs(vectors).max()
        keep = quick >= np.partition(quick, len(quick) - top)[len(quick) - top] - margin
        ids, vectors = ids[keep], vectors[keep]
    scores = inner(vectors, query)
    order = np.lexsort((ids, -scores))[:top]
    return ids[order], scores[order]


def fit_radius(sample: np.ndarray, codes: np.ndarray, top: int, recall: float) -> int:
    """The least radius that holds ``recall`` of the true neighbours of the
    sample's first rows.  In a larger table the true ones are nearer still."""
    n = min(SAMPLE_QUERIES, len(sample))
    far = []
    for i in range(n):
        scores = sample @ sample[i]
        scores[i] = -np.inf
        near = np.argsort(-scores)[: min(top, len(sample) - 1)]
        far.append(_POP[codes[near] ^ codes[i]].sum(1, dtype=np.int64))
    far = np.concatenate(far) if far else np.zeros(0, np.int64)
    return int(np.quantile(far, recall, method="higher")) if len(far) else 0


def sample_of(rows: DataFrame) -> list:
    """The ``SAMPLE`` rows with the least hashes of their ids.

    Each task would send as many rows to the driver, so of large tables only about
    a fifth more rows than are wanted are looked at, by their hashes.  Repeated ids
    may all be among them or not; without any the sample is whatever comes first.
    """
    hashed, share = F.xxhash64("id"), 1.2 * SAMPLE / max(1, rows.count())
    few = rows.filter(hashed < int((share - 0.5) * 2.0**64)) if share < 1 else rows
    return few.orderBy(hashed, "id").limit(SAMPLE).collect() or rows.limit(SAMPLE).collect()


def search(
    table: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, top: int = TOP, recall: float = RECALL
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest found for every row whose
    id is divisible by ``every``, among all other rows.

    Vectors that are null, zero, of another length than most of the sample, or
    hold null or non-finite components take no part; neither do null ids.  Ties
    go to the smaller id.  Repeated ids are candidates row by row, but never of
    a query with the same id.  Fewer candidates than ``top``: all of them.
    """
    spark = table.sparkSession
    v = F.col(f"`{vec_col}`")
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.cast("array<double>").alias("v")).filter(
        F.col("id").isNotNull() & v.isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    rows = rows_table = materialize(rows, "vectors")
    sample = sample_of(rows)
    schema = "query_id long, rank int, vec_id long, score double"
    if not sample:
        release(rows)
        return spark.createDataFrame([], schema)
    lengths = np.bincount([len(r["v"]) for r in sample])
    dim = int(lengths.argmax())
    data = np.array([r["v"] for r in sample if len(r["v"]) == dim], np.float64)
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    rotation = fit_rotation(unit)
    radius = fit_radius(data, encode(unit, rotation), top, recall)
    rows = rows.filter(F.size("v") == dim)
    coded = materialize(_coded(rows, spark.sparkContext.broadcast(rotation), dim), "vector-codes")
    total = coded.count()
    queries = coded.filter(F.col("id") % every == 0)
    left = materialize(queries.groupBy("id").agg((F.lit(total) - F.count("*")).alias("others")), "vector-queries")
    parts, found = -(-dim // _BITS), None
    while True:
        asked = queries if found is None else queries.join(left, "id", "left_semi")
        hits = materialize(_probe(coded, asked, dim, radius, total, top), "vector-hits")
        found = hits if found is None else found.join(left.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(hits)
        if radius >= dim:
            break
        got = hits.groupBy("query_id").agg(F.count("*").alias("got"))
        short = left.join(got, left["id"] == got["query_id"], "left").filter(F.coalesce("got", F.lit(0)) < F.least(F.lit(top), "others"))
        left = materialize(short.select("id", "others"), "vector-queries")
        if left.isEmpty():
            break
        radius = min(dim, radius + 2 * parts)
    release(rows_table, coded)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _matrix(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim)


def _coded(rows: DataFrame, rotation, dim: int) -> DataFrame:
    """id, v, code (the substrings' values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes = encode(_matrix(b.column("v"), dim), rotation.value).astype(np.int32)
                offsets = pa.array(np.arange(len(codes) + 1) * codes.shape[1], pa.int32())
                yield pa.record_batch([b.column("id"), b.column("v"), pa.ListArray.from_arrays(offsets, pa.array(codes.ravel()))], names=["id", "v", "code"])

    return rows.mapInArrow(run, "id long, v array<double>, code array<int>")


def _probe(coded: DataFrame, queries: DataFrame, dim: int, radius: int, total: int, top: int) -> DataFrame:
    """query_id, vec_id, score: each query's best in each bucket."""
    parts = -(-dim // _BITS)
    near = radii(radius, parts)
    lead = min(_BITS, max(0, math.ceil(math.log2(max(1, total / BASE_BLOCK)))))  # leading bits that name a bucket
    place = [F.posexplode("code").alias("j", "value")]
    bucket = F.shiftright("value", _BITS - lead).alias("b")
    base = coded.select("id", "v", "code", *place).select("id", "v", "code", "j", bucket)
    asked = queries.select("id", "v", "code", *place).select("id", "v", "code", "j", bucket.alias("own"))
    cells = base.groupBy("j", "b").agg(F.count("*").alias("n"))
    reach = F.get(F.array(*map(F.lit, near)), F.col("j"))
    near_by = F.filter(F.sequence(F.lit(0), F.lit((1 << lead) - 1)), lambda b: F.bit_count(b.bitwiseXOR(F.col("own"))) <= reach)
    asked = asked.withColumn("b", F.explode(near_by)).drop("own")
    counts = asked.groupBy("j", "b").agg(F.count("*").alias("nq"))
    cells = cells.join(counts, ["j", "b"]).select("j", "b", F.ceil(F.col("n") / BASE_BLOCK).alias("sn"), F.ceil(F.col("nq") / QUERY_BLOCK).alias("qn"))
    own = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "id"), F.col(n)).alias
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias
    cells = materialize(cells, "vector-buckets")  # at most 2**16 rows a substring
    base = base.join(cells, ["j", "b"]).select("id", "v", "code", "j", "b", own(1, "sn")("s"), each("qn")("q"))
    asked = asked.join(cells, ["j", "b"]).select(
        F.col("id").alias("qid"), F.col("v").alias("qv"), F.col("code").alias("qcode"),
        F.col("j").alias("j2"), F.col("b").alias("b2"), own(2, "qn")("q2"), each("sn")("s2"),
    )

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [])
        if left.num_rows and right.num_rows:
            code = lambda t, name: t.column(name).combine_chunks().flatten().to_numpy().reshape(-1, parts).astype(np.uint16)
            ids, vectors = left.column("id").to_numpy(), _matrix(left.column("v"), dim)
            codes = code(right, "qcode")
            bucket = Bucket(code(left, "code"), left.column("j")[0].as_py())
            for qid, query, c, words in zip(right.column("qid").to_numpy(), _matrix(right.column("qv"), dim), codes, as_words(codes).T):
                rows = bucket.within(c, words, radius)
                rows = rows[ids[rows] != qid]
                best, scores = best_of(ids[rows], vectors[rows], query, top)
                out[0].append(np.full(len(best), qid)), out[1].append(best), out[2].append(scores)
        cols = [np.concatenate(x) if x else np.zeros(0) for x in out]
        return pa.table([pa.array(x.astype(t)) for x, t in zip(cols, (np.int64, np.int64, np.float64))], names=["query_id", "vec_id", "score"])

    groups = base.groupBy("j", "b", "s", "q").cogroup(asked.groupBy("j2", "b2", "s2", "q2"))
    return groups.applyInArrow(pair, "query_id long, vec_id long, score double")


def op6_nearest_neighbours(table: DataFrame) -> DataFrame:
    return search(table)
