"""From dropped paths to an ordered collection."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import formats
from tilewright.operators.collection import distinct_paths, order_collection, top_directory
from tilewright.sources import catalog


@dataclass
class Drop:
    """What was dropped: full paths, split into files and directories."""

    files: list[str] = field(default_factory=list)
    dirs: list[str] = field(default_factory=list)

    @property
    def single_file(self) -> bool:
        return len(self.files) == 1 and not self.dirs

    @property
    def same_dir(self) -> bool:
        return bool(self.files) and not self.dirs and len({os.path.dirname(f) for f in self.files}) == 1

    @property
    def anchor(self) -> str | None:
        return self.files[0] if self.single_file else None


@dataclass
class Plan:
    roots: list[str]
    files: list[str]
    recursive: bool


def analyse(given: list[str | None] | None) -> Drop:
    found = catalog.valid_paths(given)
    return Drop([p for p in found if not os.path.isdir(p)], [p for p in found if os.path.isdir(p)])


def build(drop: Drop, recurse: bool | None = None) -> Plan:
    """A single file: its directory, flat.  Files of one directory: those alone.
    Else directories, by default with all below, and the files."""
    if drop.single_file:
        return Plan([os.path.dirname(drop.files[0])], [], bool(recurse))
    if drop.same_dir:
        return Plan([], drop.files, bool(recurse))
    return Plan(drop.dirs, drop.files, True if recurse is None else recurse)


def kind_of(drop: Drop) -> str:
    if not drop.files and not drop.dirs:
        return "Undefined"
    if drop.single_file:
        return "SingleDirectoryCollection"
    if len(drop.dirs) == 1 and not drop.files:
        return "MultiDirectorySelection" if catalog.has_subdirectories(drop.dirs[0]) else "SingleDirectoryCollection"
    return "SingleDirectorySelection" if drop.same_dir else "MultiDirectorySelection"


def collection(spark: SparkSession, given: list[str | None] | None, recurse: bool | None = None, **options) -> tuple[DataFrame, Drop]:
    """(collection, drop): the supported files in order, with format and idx."""
    drop = analyse(given)
    plan = build(drop, recurse)
    named = spark.createDataFrame([(p,) for p in plan.files], "path string")
    supported = [r[0] for r in formats.extensions(spark).filter("not disabled").select("extension").collect()]
    found = catalog.scan(spark, plan.roots, recursive=plan.recursive, extensions=supported, **options).select("path") if plan.roots else named.limit(0)
    every = distinct_paths(named.unionByName(found))
    ext = F.regexp_extract(F.regexp_extract("path", "([^/]*)$", 1), r"(\.[^.]*)$", 1)
    known = formats.with_format(every, ext).filter("supported").select("path", "extension", "format")
    return order_collection(known), drop


def top(files: DataFrame, drop: Drop, spark: SparkSession) -> str | None:
    """Common directory of the collection, else of what was dropped."""
    row = top_directory(files.select(F.col("dir").alias("path"))).first()
    if row and row[0]:
        return row[0]
    inputs = [*drop.dirs, *map(os.path.dirname, drop.files)]
    row = top_directory(spark.createDataFrame([(p,) for p in inputs], "path string")).first()
    return row[0] if row else None
