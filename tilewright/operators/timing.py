"""Load-time statistics: size buckets, moving averages, nearest-bucket estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

UNIT = 256_000.0
SAMPLES = 20
SAVE_EVERY = 5


def size_bucket(size: Column) -> Column:
    """Least power of two of units of 256 000 bytes that holds the size, 1 at least."""
    power = F.pow(F.lit(2.0), F.ceil(F.log2(size / UNIT)))
    return F.when(size.isNull() | (size <= 0), 1).otherwise(F.greatest(F.lit(1), F.least(power, F.lit(2147483647.0)).cast("int")))


def running_estimates(samples: DataFrame, order: str = "seq", ms: str = "ms") -> DataFrame:
    """Estimate before each sample: the mean of the up to 20 before it of its
    format and bucket (null for the first)."""
    w = Window.partitionBy("format", "bucket").orderBy(order).rowsBetween(-SAMPLES, -1)
    return samples.withColumn("estimate", F.avg(ms).over(w))


def recent(samples: DataFrame, order: str = "seq") -> DataFrame:
    """The last 20 samples of each format and bucket."""
    w = Window.partitionBy("format", "bucket").orderBy(F.col(order).desc())
    return samples.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= SAMPLES).drop("_n")


def bucket_means(samples: DataFrame, order: str = "seq", ms: str = "ms") -> DataFrame:
    return recent(samples, order).groupBy("format", "bucket").agg(F.avg(ms).alias("mean"))


def estimate(wanted: DataFrame, means: DataFrame) -> DataFrame:
    """``wanted`` (format, bucket) with the mean of the same bucket, else of the
    nearest one of the format (ties: the lower), else null.

    A format has as many buckets as sizes have powers of two, so the join on the
    format is bounded; it runs over distinct wanted pairs only.
    """
    pairs = wanted.select("format", "bucket").distinct()
    have = means.select("format", F.col("bucket").alias("nearest"), "mean")
    j = pairs.join(have, "format", "left")
    best = F.min_by(F.struct("nearest", "mean"), F.struct(F.abs(F.col("nearest") - F.col("bucket")), "nearest"))
    found = j.filter("nearest is not null").groupBy("format", "bucket").agg(best.alias("b"))
    found = found.select("format", "bucket", F.col("b.nearest").alias("nearest"), F.col("b.mean").alias("estimate"))
    return wanted.join(found, ["format", "bucket"], "left")


def stats_key(format_col: Column, bucket: Column) -> Column:
    return F.concat_ws("_", F.upper(format_col), bucket.cast("string"))


def parse_key(key: Column) -> Column:
    """struct(format, bucket); null where the key has no number after its first '_'."""
    parts = F.split(key, "_", 2)
    bucket = F.get(parts, F.lit(1)).try_cast("int")
    return F.when(bucket.isNotNull() & (F.get(parts, F.lit(0)) != ""), F.struct(F.get(parts, F.lit(0)).alias("format"), bucket.alias("bucket")))


def save_points(samples: DataFrame, *session: str, order: str = "seq") -> DataFrame:
    """``samples`` with ``unsaved`` (recorded and not yet saved, this one included)
    and ``saves``: the table is written after every 5th sample of a session and,
    on exit, after its last one."""
    by = Window.partitionBy(*session).orderBy(order)
    unsaved = F.pmod(F.row_number().over(by) - 1, F.lit(SAVE_EVERY)) + 1
    last = F.lead(F.lit(1)).over(by).isNull()
    return samples.withColumn("unsaved", unsaved).withColumn("saves", (F.col("unsaved") == SAVE_EVERY) | last)


def record_stats(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run: samples (seq, format, bucket, ms) join the table at ``path`` once five or
    more are new, and what is left when the stream ends.

    What the table needs, 20 samples of each format and bucket at most, is kept
    beside it under the batch's number, made from that of the batch before: a batch
    that runs again replaces its own and counts nothing twice.
    """
    spark, kept, state = stream.sparkSession, path + "-samples", {"unsaved": 0, "batch": None}

    def save() -> None:
        write_stats(spark.read.schema(stream.schema).parquet(f"{kept}/{state['batch']}"), path)
        state["unsaved"] = 0

    def one(batch: DataFrame, number: int) -> None:
        rows = batch
        if number:
            rows = rows.unionByName(spark.read.schema(stream.schema).parquet(f"{kept}/{number - 1}"))
        recent(rows).write.mode("overwrite").parquet(f"{kept}/{number}")
        if number > 1:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{kept}/{number - 2}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        state.update(unsaved=state["unsaved"] + batch.count(), batch=number)
        if state["unsaved"] >= SAVE_EVERY:
            save()

    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if state["unsaved"]:
        save()
    return query


def write_stats(samples: DataFrame, path: str) -> None:
    """A text table 'KEY: [ms, ...]', one line per format and bucket (20 numbers at most)."""
    kept = recent(samples)
    lists = kept.groupBy("format", "bucket").agg(F.sort_array(F.collect_list(F.struct("seq", "ms"))).alias("v"))
    numbers = F.array_join(F.transform("v", lambda s: s["ms"].cast("string")), ", ")
    lists.select(F.concat(stats_key(F.col("format"), F.col("bucket")), F.lit(": ["), numbers, F.lit("]"))).write.mode("overwrite").text(path)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """format, bucket, seq, ms from such a table; lines and numbers that do not
    parse are skipped."""
    line = spark.read.text(path)
    kv = line.select(parse_key(F.regexp_extract("value", r"^\s*([^:]+):", 1)).alias("k"), F.regexp_extract("value", r"\[(.*)\]", 1).alias("v"))
    kv = kv.filter("k is not null")
    out = kv.select("k.format", "k.bucket", F.posexplode(F.split("v", r"\s*,\s*")).alias("seq", "t"))
    return out.select("format", "bucket", F.col("seq").cast("long").alias("seq"), F.trim("t").try_cast("double").alias("ms")).filter("ms is not null")
