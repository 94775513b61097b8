"""Load jobs: state folding, terminal states, progress, suppressed repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STATES = ("Pending", "Loading", "Ready", "Complete", "Failed", "Cancelled", "Disposed")
_TERMINAL = ("Complete", "Failed", "Cancelled")


def next_state(state: Column, event: Column) -> Column:
    """begin, ready, complete, failed, cancelled, disposed; each signal counts once
    and nothing leaves a terminal state but disposal."""
    over = state.isin(*_TERMINAL)
    return (
        F.when(state == "Disposed", state)
        .when(event == "disposed", "Disposed")
        .when(over, state)
        .when((event == "begin") & (state == "Pending"), "Loading")
        .when((event == "ready") & state.isin("Pending", "Loading"), "Ready")
        .when(event == "complete", "Complete")
        .when(event == "failed", "Failed")
        .when(event == "cancelled", "Cancelled")
        .otherwise(state)
    )


def job_states(events: DataFrame) -> DataFrame:
    """path, state after all events (path, seq, event) of each job, in order; a
    job has a handful of events."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("seq", "event"))), lambda s: s["event"])
    return events.groupBy("path").agg(F.aggregate(ordered, F.lit("Pending"), next_state).alias("state"))


def terminal_counts(states: DataFrame) -> DataFrame:
    kind = F.when(F.col("state").isin(*_TERMINAL, "Disposed"), F.col("state")).otherwise("Unfinished")
    return states.groupBy(kind.alias("state")).agg(F.count("*").alias("n"))


def is_promoted(state: Column, kind: Column) -> Column:
    """Ready work that needs nothing more counts as complete: all but large rasters."""
    return (state == "Ready") & (kind != "RasterLarge")


def first_requests(requests: DataFrame, order: str = "seq") -> DataFrame:
    """One job a path; a path comes again after a failed start."""
    started = requests.filter(~F.coalesce("start_failed", F.lit(False))) if "start_failed" in requests.columns else requests
    return started.groupBy("path").agg(F.min(order).alias(order))


def without_repeats(log: DataFrame, *by: str, order: str = "seq", message: str = "message") -> DataFrame:
    """Rows whose message differs from the one just before (of the same keys)."""
    before = F.lag(message).over(Window.partitionBy(*by).orderBy(order))
    return log.withColumn("_b", before).filter(~F.col(message).eqNullSafe(F.col("_b"))).drop("_b")


def latest(log: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return log.groupBy(key).agg(F.max_by(value, order).alias(value))


def drop_progress(log: DataFrame, format_dim: DataFrame) -> DataFrame:
    """One row of counters (paths, files, supported) and the state of a drop from
    its log (event, extension)."""
    known = log.join(F.broadcast(format_dim), "extension", "left")
    has = lambda e: F.max(F.when(F.col("event") == e, 1).otherwise(0)) == 1
    return known.agg(
        F.count_if(F.col("event") == "path").alias("paths"),
        F.count_if(F.col("event") == "file").alias("files"),
        F.count_if((F.col("event") == "file") & ~F.coalesce("disabled", F.lit(True))).alias("supported"),
        has("cancel").alias("aborted"),
        (has("begin") & ~has("complete")).alias("active"),
    )
