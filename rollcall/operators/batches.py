"""Progress of upload batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions import outcomes as o


def latest_outcomes(reports: DataFrame, order: str) -> DataFrame:
    """The last reported state of each task."""
    newest = F.max_by(F.struct("state", "error_class"), F.col(order)).alias("last")
    return reports.groupBy("task_id").agg(newest).select("task_id", "last.*")


def file_status(manifest: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row per file of a batch; a task nobody reported on is pending.

    Of a failure only the error class is shown, never its message.
    """
    known = outcomes.select("task_id", "state", "error_class")
    state = F.coalesce("state", F.lit("PENDING"))
    status = o.task_status(state)
    return manifest.join(known, "task_id", "left").select(
        "batch_id",
        "pos",
        "task_id",
        "file",
        state.alias("state"),
        status.alias("status"),
        F.when(status == "failed", F.coalesce("error_class", F.lit("Unknown"))).alias("error"),
    )


def batch_status(manifest: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Counts, progress and completion per batch; the join is on unique task ids."""
    status = file_status(manifest, outcomes)
    counts = status.groupBy("batch_id").agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("done", "failed", "pending")],
    )
    return with_progress(counts, F.col("done") + F.col("failed"))


def with_progress(counts: DataFrame, finished: Column) -> DataFrame:
    return counts.withColumn("complete", o.is_complete(finished, F.col("total"))).withColumn(
        "progress", o.progress(finished, F.col("total"))
    )


def finished_files(reports: DataFrame) -> DataFrame:
    """Distinct files per batch that reached an end; a repeated report counts once.

    Spark counts distinct values in two steps, first by batch and file, so a batch with
    most of the reports is not counted in one task.
    """
    ended = F.when(o.is_terminal(F.col("state")), F.col("file"))
    counts = reports.groupBy("batch_id").agg(
        F.count_distinct("file").alias("total"), F.count_distinct(ended).alias("finished")
    )
    return counts.withColumn("complete", o.is_complete(F.col("finished"), F.col("total")))


def dispatch(accepted: DataFrame, created_at: Column) -> DataFrame:
    """Manifest rows of accepted members: a task per file, paired by position."""
    task = F.sha2(F.concat_ws("\x00", "batch_id", F.col("idx").cast("string")), 256)
    return accepted.select(
        "batch_id",
        F.col("idx").alias("pos"),
        task.alias("task_id"),
        F.col("member").alias("file"),
        created_at.alias("created_at"),
    )
