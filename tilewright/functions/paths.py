"""Path columns (Unix separators; ``fold`` compares without case)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_blank(c: Column) -> Column:
    """Null, empty or white space of any kind."""
    return c.isNull() | ~F.coalesce(c, F.lit("")).rlike(r"[^\s\p{Z}\x85]")


def key(path: Column, fold: bool = False) -> Column:
    """What two equal paths share: the path itself, or its lower case."""
    return F.lower(path) if fold else path


def utf16_order(path: Column) -> Column:
    """Sort key by UTF-16 code units; plain strings sort by UTF-8 bytes."""
    return F.hex(F.encode(path, "UTF-16BE"))


def trim_separator(path: Column) -> Column:
    return F.when(path.rlike("^/+$"), "/").otherwise(F.regexp_replace(path, "/+$", ""))


def directory(path: Column) -> Column:
    """Parent directory; '/' for entries of the root; null for blank or bare names."""
    parent = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(is_blank(path) | (F.instr(path, "/") == 0), F.lit(None)).when(parent == "", "/").otherwise(parent)


def name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def extension(path: Column) -> Column:
    """From the last dot of the name on; a lone trailing dot counts as none."""
    found = F.regexp_extract(name(path), r"(\.[^.]*)$", 1)
    return F.when(found == ".", "").otherwise(found)


def normalise_directory(path: Column, is_dir: Column, exists: Column) -> Column:
    """The directory itself, a file's parent, or for what does not exist the parent
    if the name has an extension."""
    p = trim_separator(path)
    as_file = (exists & ~is_dir) | (~exists & (extension(p) != ""))
    return F.when(is_blank(path), F.lit(None)).when(as_file, directory(p)).otherwise(p)


def is_hidden(path: Column) -> Column:
    return F.coalesce(name(trim_separator(path)).startswith("."), F.lit(False))


def common_length(a: Column, b: Column) -> Column:
    """Number of leading characters that two strings share."""
    n = F.least(F.length(a), F.length(b))
    walk = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, i: F.when((acc == i - 1) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), i).otherwise(acc),
    )
    return F.when(n < 1, 0).otherwise(walk)


def top_of(low: Column, high: Column) -> Column:
    """Common directory of a sorted set of paths from its least and greatest.

    The common prefix is cut at its last separator, even when it is a whole path
    of the set; a single path is its own; '/' when only the root is shared; null
    when nothing is.
    """
    c = F.substring(low, F.lit(1), common_length(low, high))
    cut = F.length(c) - F.length(F.substring_index(c, "/", -1))
    return (
        F.when(low == high, low)
        .when((c == "") | (F.instr(c, "/") == 0), F.lit(None))
        .when(cut == 1, "/")
        .otherwise(F.substring(c, F.lit(1), cut - 1))
    )
