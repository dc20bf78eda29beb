"""Batch completion as a stream of task reports."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rollcall.functions.outcomes import is_complete, is_terminal

TTL = "24 hours"


def first_endings(reports: DataFrame, ttl: str | None = None, event_time: str = "ts") -> DataFrame:
    """The first report of each file that it has ended; retries and repeats drop out.

    The state is keyed by batch and file, so a batch of any size is spread over all
    tasks. With a TTL a file is forgotten that long after its event time.
    """
    ended = reports.where(is_terminal(F.col("state")))
    keys = ["batch_id", "file"]
    if ttl is None:
        return ended.select(*keys).dropDuplicates(keys)
    timed = ended.select(*keys, event_time).withWatermark(event_time, ttl)
    return timed.dropDuplicatesWithinWatermark(keys).select(*keys)


class ProgressCounts:
    """Keeps per micro-batch how many files of each batch ended in it.

    Writing a micro-batch again replaces its own folder, so a replay changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def __call__(self, endings: DataFrame, epoch: int) -> None:
        counts = endings.groupBy("batch_id").agg(F.count("*").alias("ended"))
        counts.write.mode("overwrite").parquet(f"{self.root}/epoch={epoch}")

    def finished(self, totals: DataFrame) -> DataFrame:
        """Progress per batch, and the micro-batch in which its last file ended."""
        schema = "batch_id string, ended long, epoch long"
        counted = self.spark.read.schema(schema).parquet(self.root)
        sums = counted.groupBy("batch_id").agg(
            F.sum("ended").alias("finished"), F.max("epoch").alias("last_epoch")
        )
        finished = F.coalesce("finished", F.lit(0))
        complete = is_complete(finished, F.col("total"))
        return totals.join(sums, "batch_id", "left").select(
            "batch_id",
            "total",
            finished.alias("finished"),
            complete.alias("complete"),
            F.when(complete, F.col("last_epoch")).alias("completed_in"),
        )


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rocksdb_state(spark: SparkSession) -> None:
    """Keep the state of streams started from now on in RocksDB, which timers and state with a TTL need."""
    spark.conf.set(STATE_STORE, ROCKSDB)


class BatchCompletion(StatefulProcessor):
    """Per batch the files that have ended, forgotten `ttl_seconds` after the last report.

    A batch has no more files than an archive may have, so they are one value. A report of a file that is
    known changes nothing. Gives one row whenever the number grows; `complete` is true once, when the last
    file ends.
    """

    def __init__(self, ttl_seconds: float):
        self.ttl = int(ttl_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ended = handle.getValueState("ended", "files array<string>, complete boolean", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        files, complete = self.ended.get() if self.ended.exists() else ([], False)
        known, total = set(files or []), 0
        before = len(known)
        for row in rows:
            known.add(row["file"])
            total = max(total, row["total"])
        if len(known) == before or complete:
            return
        complete = total > 0 and len(known) >= total
        self.ended.update((sorted(known), complete))
        yield Row(batch_id=key[0], total=total, finished=len(known), complete=complete)

    def close(self) -> None:
        pass


COMPLETION = "batch_id string, total long, finished long, complete boolean"


def completions(reports: DataFrame, totals: DataFrame, ttl_seconds: float = 24 * 3600.0) -> DataFrame:
    """Progress of batches as a stream: one row for each growth, the last of a batch when it is complete.

    `totals` says how many files each batch has. Needs `rocksdb_state`.
    """
    ended = reports.where(is_terminal(F.col("state")) & F.col("file").isNotNull()).select("batch_id", "file")
    known = totals.select("batch_id", F.col("total").cast("long").alias("total"))
    counted = ended.join(known, "batch_id")
    return counted.groupBy("batch_id").transformWithState(BatchCompletion(ttl_seconds), COMPLETION, "Update", "ProcessingTime")


class ProgressRows:
    """Keeps per micro-batch what `completions` gave; a micro-batch written again replaces its own folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def __call__(self, rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/epoch={epoch}")

    def rows(self) -> DataFrame:
        return self.spark.read.schema(f"{COMPLETION}, epoch long").parquet(self.root)

    def finished(self, totals: DataFrame) -> DataFrame:
        """Progress per batch, and the micro-batch in which its last file ended."""
        latest = self.rows().groupBy("batch_id").agg(
            F.max("finished").alias("finished"), F.max(F.when(F.col("complete"), F.col("epoch"))).alias("completed_in")
        )
        finished = F.coalesce("finished", F.lit(0).cast("long"))
        return totals.join(latest, "batch_id", "left").select(
            "batch_id", "total", finished.alias("finished"), is_complete(finished, F.col("total")).alias("complete"), "completed_in"
        )
