"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets.

1. Documents with the same set form a class; classes are joined, not documents.
2. Light sets (at most ``x`` shingles) enumerate their subsets of the sizes that
   two linked light sets must share; one shared subset makes a candidate.  Heavy
   sets are found by inverted lists: each set enters the lists of its first
   tokens, as many as it must have for a linked set to share one, in an order
   that puts common tokens last.  Sets near the boundary enter both.  ``x`` is
   where the estimated cost of both kinds is least.
3. Candidates are first held against counts of tokens in 256 cells, whose sum of
   minima bounds the intersection from above, and then verified exactly on their
   sets.  Lists are first tested against a few leaders each (first of all the set
   with the most shared tokens, which near copies have the most in common with);
   what the links found so far connect needs no further test, so a list with thousands of near copies
   costs thousands of tests, not millions.  More rounds with other leaders follow
   while many pairs are open.  Then all pairs of a list that are not yet
   connected are tested, so no link that matters to the components is lost.

The order needs a mark for common tokens.  It is a bitmap of bounded size, which
is broadcast; any bitmap gives right results, and if there are too many common
tokens for it only the most common are marked.  Another such bitmap lets tasks
skip texts that no candidate needs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.bitmaps import MOST, bitmap_of, in_bitmap
from tilewright.llm.common import materialize, release, text_batches
from tilewright.llm.components import components
from tilewright.llm.ragged import portions
from tilewright.llm.shingles import mix, shingle_sets

SHINGLE, PERCENT = 5, 80
_SLICE = 1 << 20  # bytes of text whose sets are made at a time
_LOCAL = 3  # a token in so many sets of a batch is reported in any case
_COMMON = 24  # and common if reported so often in all
_SMALL = 64  # sizes in the cost histogram
_MOST_LIGHT = 24
_BLOCK_NODES = 1024
_BLOCK_SKETCHES = 2048
_STARS = 6
_LEADERS = 3
_OPEN = 2000  # open pairs a list row up to which all are tested at once
_SHORT = 32  # lists up to this length are joined, longer ones tested in blocks
_LIST_BLOCK = 512
_CELLS = 256


def overlap(s: int, m: int, percent: int) -> int:
    """The least intersection of two linked sets of these sizes."""
    return -(-percent * (s + m) // (100 + percent))


def prefix(s: int, percent: int) -> int:
    return s - -(-percent * s // 100) + 1


def subset_sizes(s: int, x: int, percent: int) -> list[int]:
    """Sizes of the subsets that a light set of size ``s`` enumerates."""
    return sorted({overlap(s, m, percent) for m in range(1, x + 1) if 100 * min(s, m) >= percent * max(s, m)})


def light_rows(s: int, x: int, percent: int) -> int:
    return sum(math.comb(s, k) for k in subset_sizes(s, x, percent))


def boundary(sizes: dict[int, int], list_length: float, percent: int) -> int:
    """The size up to which subsets are cheaper than lists: rows made and, for
    lists, rows scanned."""

    def cost(x: int) -> float:
        light = sum(c * light_rows(s, x, percent) for s, c in sizes.items() if s <= x)
        return light + sum(c * prefix(s, percent) * (1 + list_length) for s, c in sizes.items() if 100 * s >= percent * (x + 1))

    return min(range(_MOST_LIGHT + 1), key=cost)


def keys_of(tokens: np.ndarray, common: np.ndarray | None, x: int, percent: int) -> np.ndarray:
    """Subset keys and list tokens of one set."""
    s, out = len(tokens), []
    if s <= x:
        scrambled = mix(tokens)
        for k in subset_sizes(s, x, percent):
            picks = np.array(list(combinations(range(s), k)), np.int64)
            out.append(mix(scrambled[picks].sum(1, dtype=np.uint64) + np.uint64(k)) >> np.uint64(1))
    if 100 * s >= percent * (x + 1):
        marked = in_bitmap(common, tokens) if common is not None else np.zeros(s, bool)
        out.append(np.concatenate((tokens[~marked], tokens[marked]))[: prefix(s, percent)])
    return np.unique(np.concatenate(out)).astype(np.int64) if out else np.zeros(0, np.int64)


def _lists(arrays: list[np.ndarray], kind) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def _statistics(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """kind, value, number.  0: a token and in how many sets it was seen, for the
    tokens that would lead a set if none were marked, and for all that are common
    within a batch.  1: sizes.  2: list lengths."""

    def run(batches):
        for batch in batches:
            lead, often, sizes, seen = [], [], np.zeros(_SMALL + 1, np.int64), np.zeros(2, np.int64)
            for b in portions(batch, "_text", _SLICE):
                sets = shingle_sets(b.column(1), n)
                lead += [s[: prefix(len(s), percent)] for s in sets if len(s)]
                tokens, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                often.append((tokens[counts > 1], counts[counts > 1]))
                sizes += np.bincount(np.minimum([len(s) for s in sets], _SMALL), minlength=_SMALL + 1)
                small = [s for s in sets if 0 < len(s) < _SMALL]
                if small:
                    found = counts[np.searchsorted(tokens, np.concatenate(small))]
                    seen += (found.sum(), len(found))
            first, count = np.unique(np.concatenate(lead), return_counts=True) if lead else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            tokens, inverse = np.unique(np.concatenate([t for t, _ in often]), return_inverse=True)
            total = np.bincount(inverse, np.concatenate([c for _, c in often]), len(tokens)).astype(np.int64)
            new = (total >= _LOCAL) & ~np.isin(tokens, first)
            values = np.concatenate((first.astype(np.int64), tokens[new].astype(np.int64), np.arange(_SMALL + 1), [0, 1]))
            numbers = np.concatenate((count, total[new], sizes, seen))
            kinds = np.concatenate((np.zeros(len(first) + new.sum(), np.int32), np.full(_SMALL + 1, 1, np.int32), np.array([2, 2], np.int32)))
            yield pa.record_batch([pa.array(kinds, pa.int32()), pa.array(values, pa.int64()), pa.array(numbers, pa.int64())], names=["kind", "value", "number"])

    return text_batches(docs.select("_id", "_text"), "_text", run, "kind int, value long, number long", 4 * _SLICE)


def _keyed(docs: DataFrame, n: int, percent: int, common, x: int) -> DataFrame:
    def run(batches):
        for b in batches:
            sets, names = shingle_sets(b.column(1), n, names=True)
            keys = [keys_of(s, common.value, x, percent) for s in sets]
            cells = [sketch(s) if len(k) else b"" for s, k in zip(sets, keys)]
            yield pa.record_batch(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in names], pa.int64()), pa.array([c for _, c in names], pa.int64()), _lists(keys, pa.int64()), pa.array(cells, pa.binary())],
                names=["_id", "n", "h1", "h2", "keys", "cells"],
            )

    return text_batches(docs.select("_id", "_text"), "_text", run, "_id long, n long, h1 long, h2 long, keys array<long>, cells binary", _SLICE)


def common_bitmap(tokens: DataFrame) -> np.ndarray:
    """A bitmap of common tokens (value, number), at most one bit in eight: if there
    are more than that, only those from the power of two on that fits are marked,
    so the longest lists are avoided at every table size."""
    powers = tokens.groupBy(F.floor(F.log2("number")).alias("p")).agg(F.count("*").alias("n")).orderBy(F.desc("p")).collect()
    least, total = 0, 0
    for r in powers:
        if total + r["n"] > MOST // 8:
            least = 2 ** (r["p"] + 1)
            break
        total += r["n"]
    return bitmap_of(tokens.filter(F.col("number") >= least), "value", total)


def sketch(tokens: np.ndarray) -> bytes:
    """Tokens in each cell, 255 for that many or more."""
    cells = np.bincount((tokens & np.uint64(_CELLS - 1)).astype(np.int64), minlength=_CELLS)
    return np.minimum(cells, 255).astype(np.uint8).tobytes()


def bound(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Upper bounds of the intersections of sets with these cells and sizes."""
    least = np.minimum(a, b)
    return np.where((least == 255).any(1), np.minimum(n, m), least.sum(1, dtype=np.int64))


def _sets(docs: DataFrame, n: int, wanted) -> DataFrame:
    """_id, tokens (binary) of the documents that the bitmap ``wanted`` may hold."""

    def run(batches):
        for b in batches:
            ids = b.column(0)
            keep = in_bitmap(wanted.value, ids.fill_null(0).to_numpy().view(np.uint64))
            b = b.filter(pa.array(keep))
            if b.num_rows:
                sets = [s.tobytes() for s in shingle_sets(b.column(1), n)]
                yield pa.record_batch([b.column(0), pa.array(sets, pa.binary())], names=["node", "tokens"])

    return text_batches(docs.select("_id", "_text"), "_text", run, "node long, tokens binary", _SLICE)


def _dealt(pairs: DataFrame, data: DataFrame, blocks: int):
    """Pairs and the data of their nodes, grouped by the blocks of both nodes: each
    node's data go once to every block pair that needs them."""
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    pairs = pairs.select("u", "v", F.struct(block("u").alias("a"), block("v").alias("b")).alias("k"))
    need = pairs.select(F.col("k").alias("k2"), F.explode(F.array("u", "v")).alias("node")).distinct().join(data, "node")
    return pairs.groupBy("k").cogroup(need.groupBy("k2"))


def _picked(left: pa.Table, linked) -> pa.Table:
    keep = pa.array(linked, pa.bool_())
    return pa.table({"u": left.column("u").filter(keep), "v": left.column("v").filter(keep)})


def _possible(pairs: DataFrame, nodes: DataFrame, percent: int, blocks: int) -> DataFrame:
    """The pairs (u, v) that the cells of their sets do not rule out."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left.select(["u", "v"])
        # rows with one id may have several sets: those are left to the exact test
        ids, first, times = np.unique(right.column("node").to_numpy(), return_index=True, return_counts=True)
        n, many = right.column("n").to_numpy()[first], times > 1
        cells = np.frombuffer(b"".join(right.column("cells").to_pylist()), np.uint8).reshape(-1, _CELLS)[first]
        u, v = (np.searchsorted(ids, left.column(c).to_numpy()) for c in ("u", "v"))
        ok = np.zeros(len(u), bool)
        for at in range(0, len(u), 4096):
            a, b = u[at : at + 4096], v[at : at + 4096]
            top = bound(cells[a], cells[b], n[a], n[b])
            ok[at : at + 4096] = 100 * top >= percent * (n[a] + n[b] - top)
        ok |= many[u] | many[v]
        return _picked(left, ok)

    return _dealt(pairs, nodes, blocks).applyInArrow(run, "u long, v long")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int, blocks: int) -> DataFrame:
    """The linked ones of (u, v)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known: dict[int, list[np.ndarray]] = {}
        for node, tokens in zip(right.column("node").to_pylist(), right.column("tokens").to_pylist()):
            known.setdefault(node, []).append(np.frombuffer(tokens, np.uint64))
        us, vs, linked = left.column("u").to_pylist(), left.column("v").to_pylist(), []
        for u, v in zip(us, vs):
            hit = False
            for a in known.get(u, ()):
                for b in known.get(v, ()):
                    low, high = (a, b) if len(a) <= len(b) else (b, a)
                    if not len(low) or 100 * len(low) < percent * len(high):
                        continue
                    at = np.searchsorted(high, low)
                    at[at == len(high)] = 0
                    common = int((high[at] == low).sum())
                    hit |= 100 * common >= percent * (len(a) + len(b) - common)
            linked.append(hit)
        return _picked(left, linked)

    return _dealt(pairs, sets, blocks).applyInArrow(run, "u long, v long")


def _fits(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _least_first(a: str, b: str) -> list:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def _long_lists(rows: DataFrame, nodes: DataFrame, percent: int, n_rows: int) -> DataFrame:
    """Possible pairs (u, v) of different components in long lists (key, node,
    component, size).  A list is cut into blocks of members; each pair of blocks
    is one group, and lists of one block are grouped many at a time."""
    cut = F.ceil(F.col("size") / _LIST_BLOCK).cast("int")
    rows = rows.select("key", "node", "component", cut.alias("cut")).join(nodes.select("node", "n", "cells"), "node")
    own = F.pmod(F.xxhash64(F.lit(7), "node"), F.col("cut")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    lot = F.pmod(F.xxhash64("key"), F.lit(max(1, n_rows // 2000)))
    group = F.struct(
        F.when(F.col("cut") == 1, lot).otherwise(F.col("key")).alias("k"), (F.col("cut") == 1).alias("lot"),
        F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"),
    ).alias("group")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        key, node, comp, n, own = (table.column(c).to_numpy() for c in ("key", "node", "component", "n", "own"))
        cells = np.frombuffer(b"".join(table.column("cells").to_pylist()), np.uint8).reshape(-1, _CELLS)
        us, vs = [], []
        cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            names, count = np.unique(comp[lo:hi], return_counts=True)
            if len(names) == 1:
                continue
            blocks = own[lo:hi].min() != own[lo:hi].max()
            # every row outside the largest component against all rows
            for i in np.flatnonzero(comp[lo:hi] != names[count.argmax()]) + lo:
                small, large = np.minimum(n[lo:hi], n[i]), np.maximum(n[lo:hi], n[i])
                fits = (comp[lo:hi] != comp[i]) & (100 * small >= percent * large)
                if blocks:
                    fits &= own[lo:hi] != own[i]
                at = np.flatnonzero(fits) + lo
                top = bound(cells[at], cells[i], n[at], n[i])
                at = at[100 * top >= percent * (n[at] + n[i] - top)]
                us.append(np.minimum(node[at], node[i])), vs.append(np.maximum(node[at], node[i]))
        u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
        pairs = np.unique(np.stack([u, v], 1), axis=0)
        return pa.table({"u": pairs[:, 0].copy(), "v": pairs[:, 1].copy()})

    return rows.select(group, "key", "node", "component", "n", "cells", "own").groupBy("group").applyInArrow(run, "u long, v long")


def _connect(docs: DataFrame, lists: DataFrame, nodes: DataFrame, shingle: int, percent: int) -> DataFrame | None:
    """node, component for the nodes of ``lists`` (key, node, n) that have links."""
    spark = docs.sparkSession
    n_lists, n_nodes = lists.count(), lists.select(F.approx_count_distinct("node")).first()[0]
    sketch_blocks = max(1, -(-n_nodes // _BLOCK_SKETCHES))
    links = tested = comp = None
    weights = lists.groupBy("node").agg(F.count("*").alias("weight"))
    base, last, r = lists.withColumn("component", F.col("node")), False, 0
    while not last:
        now = base if r else base.join(weights, "node")
        if comp is not None:
            now = base.drop("component").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
            now = materialize(now, "jaccard-lists")
        lead = lambda o: F.min(F.struct(o.alias("o"), "node", "n", "component"))
        orders = [F.xxhash64(F.lit(_LEADERS * r + i), "node") for i in range(_LEADERS)]
        orders[0] = -F.col("weight") if r == 0 else orders[0]
        heads = now.groupBy("key").agg(
            F.array_distinct(F.array(*map(lead, orders))).alias("leads"), F.count("*").alias("size"),
            F.min("component").alias("c1"), F.max("component").alias("c2"),
        ).filter("c1 <> c2").drop("c1", "c2")
        open_rows = now.join(heads, "key")
        first = F.get("leads", F.lit(0))["component"]
        if r:
            rows = open_rows.filter(F.col("component") != first).agg(F.sum("size")).first()[0] or 0
            last = rows <= _OPEN * n_lists or r >= _STARS
        if last:
            short, long = open_rows.filter(F.col("size") <= _SHORT), open_rows.filter(F.col("size") > _SHORT)
            left = short.filter(F.col("component") != first).select("key", "node", "n", "component")
            right = short.select("key", F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("component").alias("component2"))
            pairs = left.join(right, "key").filter("component <> component2").filter(_fits("n", "n2", percent))
            pairs = pairs.select(*_least_first("node", "node2")).distinct()
        else:
            pairs = open_rows.select("node", "n", "component", F.explode("leads").alias("lead"))
            pairs = pairs.filter(F.col("component") != F.col("lead.component")).filter(_fits("n", "lead.n", percent))
            pairs = pairs.select(*_least_first("node", "lead.node")).distinct()
        possible = _possible(materialize(pairs, "jaccard-pairs"), nodes, percent, sketch_blocks)
        if last:
            possible = possible.union(_long_lists(long, nodes, percent, n_lists))
        if tested is not None:
            possible = possible.join(tested, ["u", "v"], "left_anti")
        possible = materialize(possible.distinct(), "jaccard-possible")
        tested = possible if tested is None else tested.union(possible)
        r += 1
        some = possible.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        n_some = some.count()
        if not n_some:
            continue
        wanted = spark.sparkContext.broadcast(bitmap_of(some, "node", n_some))
        sets = materialize(_sets(docs, shingle, wanted), "jaccard-sets")
        found = materialize(_verify(possible, sets.distinct(), percent, max(1, -(-n_some // _BLOCK_NODES))), "jaccard-links")
        release(sets)
        if found.isEmpty():
            continue
        links = found if links is None else links.union(found)
        comp = materialize(components(links), "jaccard-components")
    return comp


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id for every row.

    Two documents link when 100 * intersection >= percent * union of their sets
    of ``shingle``-word shingles (A-Z lowered; fewer words: the whole sequence).
    class_id is the smallest id with the same set, component_id the smallest id
    reachable by links.  Null, empty and blank texts have no shingles and no
    links: both are their own id.  Rows that share an id are one document: its
    links are those of any of its rows.  A null id keeps null.  Texts are never
    cut; extra columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    stats = _statistics(docs, shingle, percent).groupBy("kind", "value").agg(F.sum("number").alias("number"))
    stats = materialize(stats.filter(F.col("kind").isin(1, 2) | (F.col("number") >= _COMMON)), "jaccard-statistics")
    totals = stats.filter("kind > 0").collect()  # at most _SMALL + 3 rows
    sizes = {r["value"]: r["number"] for r in totals if r["kind"] == 1 and 0 < r["value"] < _SMALL}
    seen = {r["value"]: r["number"] for r in totals if r["kind"] == 2}
    x = boundary(sizes, seen.get(0, 0) / max(1, seen.get(1, 0)), percent)
    common = spark.sparkContext.broadcast(common_bitmap(stats.filter("kind = 0")))
    keyed = materialize(_keyed(docs, shingle, percent, common, x), "jaccard-keys")
    classes = keyed.filter("n > 0").groupBy("h1", "h2").agg(
        F.min("_id").alias("node"), F.max("n").alias("n"), F.any_value(F.struct("keys", "cells")).alias("s")
    )
    classes = materialize(classes.select("h1", "h2", "node", "n", "s.keys", "s.cells"), "jaccard-classes")
    rows = classes.filter("node is not null").select(F.explode("keys").alias("key"), "node", "n")
    shared = rows.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    lists = materialize(rows.join(shared, "key"), "jaccard-lists")
    nodes = classes.filter("node is not null").select("node", "n", "cells")
    comp = _connect(docs, lists, nodes, shingle, percent)
    release(stats, lists)
    named = keyed.select("_id", "n", "h1", "h2").join(classes.select("h1", "h2", "node"), ["h1", "h2"], "left")
    if comp is None:
        named = named.withColumn("component", F.col("node"))
    else:
        named = named.join(comp.withColumnRenamed("component", "_c"), "node", "left").withColumn("component", F.coalesce("_c", "node"))
    out = named.select(
        F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.coalesce("component", "_id").alias("component_id"), F.coalesce("node", "_id").alias("class_id"),
    )
    return out


def op2_ngram_jaccard(docs: DataFrame) -> DataFrame:
    return join(docs, shingle=4, percent=85)


def keep_representatives(docs: DataFrame) -> DataFrame:
    """``docs`` with one document, the one with the smallest id, of each component.
    Rows without an id stay if one of them stands for itself."""
    ids = join(docs).filter("doc_id <=> component_id").select(F.col("doc_id").alias("_keep")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_keep"]), "left_semi")
