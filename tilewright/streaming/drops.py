"""Drop ingest as Structured Streaming.

A log of drops (seq, event, path) is read as a stream of files; each micro-batch
replaces the published collection, as a new drop does, and counters are taken
with the batch.  A cancel event in a batch keeps what was found before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from tilewright.functions import formats, paths
from tilewright.operators.collection import distinct_paths, order_collection

LOG = "seq long, event string, path string"


def read_log(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_batch).json(folder)


def until_cancel(batch: DataFrame) -> DataFrame:
    """Rows before the first cancel of the batch."""
    stop = batch.filter("event = 'cancel'").agg(F.min("seq").alias("_stop"))
    return batch.join(F.broadcast(stop), F.expr("_stop is null or seq < _stop")).drop("_stop")


def collect(batch: DataFrame) -> DataFrame:
    """The ordered collection of a batch's files of supported formats."""
    files = until_cancel(batch).filter("event = 'file'").filter(~paths.is_blank(F.col("path")))
    known = formats.with_format(files, paths.extension(F.col("path"))).filter("supported")
    return order_collection(distinct_paths(known.select("seq", "path", "format"), ordinal="seq"))


def counters(batch: DataFrame) -> DataFrame:
    """One row: paths, files, supported, aborted, active."""
    known = formats.with_format(batch, paths.extension(F.col("path")))
    has = lambda e: F.coalesce(F.max((F.col("event") == e).cast("int")), F.lit(0)) == 1
    return known.agg(
        F.count_if(F.col("event") == "path").alias("paths"),
        F.count_if(F.col("event") == "file").alias("files"),
        F.count_if((F.col("event") == "file") & F.col("supported")).alias("supported"),
        has("cancel").alias("aborted"),
        (has("begin") & ~has("complete")).alias("active"),
    )


def lifecycle(log: DataFrame, *keys: str) -> DataFrame:
    """The status after each event of a log (``keys``, seq, event, supported):
    paths, files, found, active, aborted.

    begin: counters to 0, active, not aborted.  reset: counters to 0 only.
    complete: not active.  cancel: aborted, not active.  path and file: counted.
    Nothing is active or aborted before the first such event; a null event
    changes nothing.
    """
    by = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = log.withColumn("_epoch", F.count_if(F.col("event").isin("begin", "reset")).over(by))
    since = Window.partitionBy(*keys, "_epoch").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = lambda on, off: F.coalesce(F.last(F.when(F.col("event").isin(*on), True).when(F.col("event").isin(*off), False), ignorenulls=True).over(by), F.lit(False))
    return rows.select(
        *keys, "seq", "event",
        F.count_if(F.col("event") == "path").over(since).alias("paths"),
        F.count_if(F.col("event") == "file").over(since).alias("files"),
        F.count_if((F.col("event") == "file") & F.col("supported")).over(since).alias("found"),
        state(["begin"], ["complete", "cancel"]).alias("active"),
        state(["cancel"], ["begin"]).alias("aborted"),
    )


def publish(stream: DataFrame, target: str, checkpoint: str, on_counters: Callable[[int, DataFrame], None] | None = None) -> StreamingQuery:
    """Start: every batch overwrites ``target``; all that is there is read, then it ends."""

    def one(batch: DataFrame, epoch: int) -> None:
        collect(batch).write.mode("overwrite").parquet(target)
        if on_counters:
            on_counters(epoch, counters(batch))

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
