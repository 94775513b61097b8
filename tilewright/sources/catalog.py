"""Python data source ``tilewright_catalog``: files under directories, depth first.

    spark.read.format("tilewright_catalog").option("roots", json).load()

Options: ``roots`` (JSON list), ``recursive`` (true), ``hidden`` (false),
``follow_links`` (false), ``extensions`` (JSON list; also pushed down from
equality and IN filters on ``extension``).  One partition a root.  A directory
that cannot be read gives a warning and is passed over.  Files are keyed by
their canonical path, so a link loop ends.
"""

from __future__ import annotations

import json
import logging
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

log = logging.getLogger(__name__)
SCHEMA = "path string, dir string, name string, extension string, size long, is_link boolean"


def extension_of(name: str) -> str:
    ext = os.path.splitext("x" + name if name.startswith(".") else name)[1].lower()
    return "" if ext == "." else ext


def is_link(path: str) -> bool:
    try:
        return os.path.islink(path)
    except OSError:
        return False


def canonical(path: str, follow: bool) -> str:
    try:
        return os.path.realpath(path) if follow else os.path.abspath(path)
    except OSError:
        return os.path.abspath(path)


def valid_paths(given: list[str | None] | None) -> list[str]:
    """Existing paths in full, without trailing separators, first occurrence each."""
    found: dict[str, None] = {}
    for p in given or ():
        if p and p.strip():
            full = os.path.abspath(p)
            if os.path.exists(full):
                found.setdefault(full.rstrip("/") or "/")
    return list(found)


def has_subdirectories(path: str | None) -> bool:
    """Raises for a blank or missing directory; one that cannot be read counts as having some."""
    if not path or not path.strip():
        raise ValueError("a directory is needed")
    if not os.path.isdir(path):
        raise NotADirectoryError(path)
    try:
        with os.scandir(path) as found:
            return any(e.is_dir() for e in found)
    except OSError:
        return True


def same_parent(given: list[str]) -> bool:
    """Whether all lie in one directory; a directory counts as its own parent."""
    if not given:
        raise ValueError("paths are needed")
    parents = set()
    for p in given:
        full = os.path.abspath(p)
        if not os.path.exists(full):
            raise FileNotFoundError(p)
        parents.add(full if os.path.isdir(full) else os.path.dirname(full))
    return len(parents) == 1


def walk(root: str, recursive: bool, hidden: bool, follow: bool) -> Iterator[tuple[str, int, bool]]:
    """(path, size, is_link) of the files below ``root``, without recursion on the stack."""
    stack, seen = [root], set()
    while stack:
        at = stack.pop()
        key = canonical(at, follow)
        if key in seen:
            continue
        seen.add(key)
        try:
            entries = sorted(os.scandir(at), key=lambda e: e.name)
        except OSError as error:
            log.warning("cannot read %s: %s", at, error)
            continue
        deeper = []
        for e in entries:
            if e.name.startswith(".") and not hidden:
                continue
            link = is_link(e.path)
            try:
                if e.is_dir():
                    if recursive and (follow or not link):
                        deeper.append(e.path)
                else:
                    yield e.path, e.stat().st_size, link
            except OSError as error:
                log.warning("cannot read %s: %s", e.path, error)
        stack += reversed(deeper)


class Root(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class CatalogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        flag = lambda k, d: str(options.get(k, d)).lower() == "true"
        self.roots = json.loads(options.get("roots", "[]"))
        self.recursive, self.hidden, self.follow = flag("recursive", "true"), flag("hidden", "false"), flag("follow_links", "false")
        wanted = json.loads(options.get("extensions", "null"))
        self.wanted = None if wanted is None else {w.lower() for w in wanted}

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("extension",):
                values = set(f.value if isinstance(f, In) else (f.value,))
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f

    def partitions(self):
        return [Root(r) for r in self.roots]

    def read(self, partition):
        if partition is None:
            return
        for path, size, link in walk(partition.path, self.recursive, self.hidden, self.follow):
            folder, name = os.path.split(path)
            ext = extension_of(name)
            if self.wanted is None or ext in self.wanted:
                yield path, folder, name, ext, size, link


class CatalogSource(DataSource):
    @classmethod
    def name(cls):
        return "tilewright_catalog"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return CatalogReader(self.options)


def scan(spark: SparkSession, roots: list[str], **options) -> DataFrame:
    spark.dataSource.register(CatalogSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("tilewright_catalog").option("roots", json.dumps(roots))
    for k, v in options.items():
        reader = reader.option(k, json.dumps(v) if isinstance(v, list) else str(v).lower())
    return reader.load()


def first_existing(candidates: list[str]) -> str | None:
    """The first candidate that is a file, such as a default colour profile."""
    return next((p for p in candidates if os.path.isfile(p)), None)


def counted(df: DataFrame, name: str = "catalogue") -> DataFrame:
    """``df`` (with supported) that counts its rows as they pass: metrics
    ``enumerated`` and ``supported`` of an observation."""
    from pyspark.sql import functions as F

    return df.observe(name, F.count(F.lit(1)).alias("enumerated"), F.count_if(F.col("supported")).alias("supported"))
