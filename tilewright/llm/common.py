"""Helpers that several of the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.ragged import portions

#: The six ASCII white-space characters that separate words.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach (spark.checkpoint.dir).

    Only where the session has none and its master is local (tests) a temporary one
    is set; on a cluster a folder of one machine would lose data.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        java = spark.sparkContext._jsc.sc().getCheckpointDir()
        if java.isDefined():
            found = java.get()
        elif re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            found = "file://" + tempfile.mkdtemp(prefix="tilewright-")
            spark.sparkContext.setCheckpointDir(found)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def text_batches(rows: DataFrame, column: str, run: Callable, schema: str, size: int = 3 << 20) -> DataFrame:
    """``rows.mapInArrow``, with ``run`` given batches of about ``size`` bytes of a
    string column (one row at least).  Spark bounds the bytes of what it sends
    (spark.sql.execution.arrow.maxBytesPerBatch); this bounds the working memory."""

    def bounded(batches):
        return run(part for whole in batches for part in portions(whole, column, size))

    return rows.mapInArrow(bounded, schema)


#: Tables that ``materialize`` has written in this process and nobody has released.
MADE: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and
    survives lost executors.  Files that a (lazy) result may still read stay until
    the folder is cleaned; others go by ``release``."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    MADE.append(path)
    return out


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in MADE:
        MADE.remove(path)


def release(*tables: DataFrame | None) -> None:
    """Delete the files of materialized tables that nothing reads any more."""
    for t in tables:
        path = getattr(t, "stored_at", None)
        if path:
            delete(t.sparkSession, path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def fingerprint(*cols: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes; together they name a value."""
    return F.xxhash64(*cols), F.xxhash64(F.lit(0x5EED), *cols)
