"""An ordered collection of paths and navigation over it.

``order_collection`` numbers the whole collection once; every later operator
works from ``idx`` or inside a directory, so only the numbering needs a total
order.  It is a range-partitioned sort with per-partition counts, not a window
over one partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.functions import paths


def distinct_paths(df: DataFrame, path: str = "path", ordinal: str | None = None, fold: bool = False) -> DataFrame:
    """First occurrence of each path (by ``ordinal`` if given)."""
    k = paths.key(F.col(path), fold)
    if ordinal is None:
        return df.withColumn("_k", k).dropDuplicates(["_k"]).drop("_k")
    rest = [c for c in df.columns if c != ordinal]
    first = F.min_by(F.struct(*rest), ordinal).alias("r")
    return df.groupBy(k.alias("_k")).agg(F.min(ordinal).alias(ordinal), first).select(ordinal, "r.*")


def number_rows(df: DataFrame, *order: str | Column, into: str = "idx") -> DataFrame:
    """``df`` with 1-based positions in ``order``, over any number of partitions."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(*cols).withColumn("_p", F.spark_partition_id()).persist()
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    base = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*cols))
    out = ranged.withColumn("_i", inside).join(F.broadcast(base), "_p")
    return out.withColumn(into, F.col("_base") + F.col("_i")).drop("_p", "_i", "_base")


def order_collection(df: DataFrame, path: str = "path", utf16: bool = False) -> DataFrame:
    """Rows with dir, name and idx: sorted by directory, then name, then path."""
    d = df.withColumn("dir", F.coalesce(paths.directory(F.col(path)), F.lit(""))).withColumn("name", paths.name(F.col(path)))
    by = [paths.utf16_order(F.col(c)) if utf16 else F.col(c) for c in ("dir", "name", path)]
    return number_rows(d, *by)


def directory_runs(ordered: DataFrame, dir_col: str = "dir", idx: str = "idx") -> DataFrame:
    """run, dir_index, dir_count: contiguous rows of one directory.  An ordered
    collection has each directory in one run, so runs are numbered by directory
    and no window spans directories."""
    runs = ordered.groupBy(dir_col).agg(F.min(idx).alias("run_first"), F.max(idx).alias("run_last"), F.count("*").alias("dir_count"))
    runs = number_rows(runs, "run_first", into="run")
    out = ordered.join(runs.withColumnRenamed(dir_col, "_d"), F.col(dir_col).eqNullSafe(F.col("_d"))).drop("_d")
    return out.withColumn("dir_index", F.col(idx) - F.col("run_first") + 1)


def neighbourhood(ordered: DataFrame, depth: int, value: str = "path", idx: str = "idx") -> DataFrame:
    """idx, neighbours: values within ``depth`` positions, clipped at both ends;
    a negative depth gives none.  Rows are sent to the 2 * depth + 1 positions
    that see them, so it stays an aggregation by position."""
    if depth < 0:
        return ordered.select(idx, F.array().cast("array<string>").alias("neighbours"))
    near = ordered.select(F.col(idx).alias("_at"), F.col(value).alias("_v"), F.explode(F.sequence(F.col(idx) - depth, F.col(idx) + depth)).alias(idx))
    seen = near.groupBy(idx).agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_v"))), lambda s: s["_v"]).alias("neighbours"))
    return ordered.select(idx).join(seen, idx)


def moves(runs: DataFrame, idx: str = "idx") -> DataFrame:
    """Targets of every navigation step, from rows with directory runs.

    next, previous (clamped), first, last, dir_first and dir_last (already at that
    edge: the near end of the neighbouring run; none: first or last of all), and
    has_next, has_previous.
    """
    total = runs.agg(F.count("*").alias("_total"))
    x = runs.withColumn("_j", F.lit(1)).join(F.broadcast(total.withColumn("_j", F.lit(1))), "_j").drop("_j")
    i, n = F.col(idx), F.col("_total")
    return x.select(
        *runs.columns,
        F.least(i + 1, n).alias("next"),
        F.greatest(i - 1, F.lit(1)).alias("previous"),
        F.lit(1).cast("long").alias("first"),
        n.alias("last"),
        F.when(i == F.col("run_first"), F.greatest(i - 1, F.lit(1))).otherwise(F.col("run_first")).alias("dir_first"),
        F.when(i == F.col("run_last"), F.least(i + 1, n)).otherwise(F.col("run_last")).alias("dir_last"),
        (i < n).alias("has_next"),
        (i > 1).alias("has_previous"),
    )


def anchor_index(ordered: DataFrame, anchor: str | None, path: str = "path", idx: str = "idx") -> DataFrame:
    """One row: the anchor's position, else the first, else -1."""
    hit = F.min(F.when(F.col(path) == F.lit(anchor), F.col(idx)))
    return ordered.agg(F.coalesce(hit, F.min(idx), F.lit(-1)).alias("index"))


def directories(df: DataFrame, path: str = "path") -> DataFrame:
    return df.select(paths.directory(F.col(path)).alias("dir")).filter(~paths.is_blank(F.col("dir"))).distinct()


def top_directory(df: DataFrame, path: str = "path") -> DataFrame:
    """One row: the common directory of all non-blank paths; the least and the
    greatest path decide it, so it is a plain aggregation."""
    used = df.filter(~paths.is_blank(F.col(path)))
    ends = used.agg(F.min(paths.trim_separator(F.col(path))).alias("a"), F.max(paths.trim_separator(F.col(path))).alias("b"))
    return ends.select(paths.top_of(F.col("a"), F.col("b")).alias("top_directory"))


def collection_type(files: Column, dirs: Column, same_dir: Column, single_file: Column, has_subdirs: Column) -> Column:
    """Kind of a collection from what was dropped."""
    return (
        F.when(files + dirs == 0, "Undefined")
        .when(single_file, "SingleDirectoryCollection")
        .when((dirs == 1) & (files == 0), F.when(has_subdirs, "MultiDirectorySelection").otherwise("SingleDirectoryCollection"))
        .when((dirs == 0) & same_dir, "SingleDirectorySelection")
        .otherwise("MultiDirectorySelection")
    )


def keep_set(neighbours: DataFrame, current: int, idx: str = "idx") -> DataFrame:
    """The paths around one position, a few rows."""
    return neighbours.filter(F.col(idx) == current).select(F.explode("neighbours").alias("path"))


def evict(cache: DataFrame, keep: DataFrame) -> DataFrame:
    """Cached rows that no kept path needs."""
    return cache.join(keep, "path", "left_anti")


def to_preload(wanted: DataFrame, cache: DataFrame, allowed: Column | None = None) -> DataFrame:
    """Wanted paths that are not cached yet and whose format may be preloaded."""
    wanted = wanted if allowed is None else wanted.filter(allowed)
    return wanted.join(cache.select("path"), "path", "left_anti")
