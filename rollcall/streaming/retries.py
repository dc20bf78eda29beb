"""Retries of a stream: transient failures come back until their budget is used up."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from rollcall.functions.outcomes import MAX_RETRIES, retry_delay
from rollcall.plans.scratch import exists
from rollcall.streaming.progress import rocksdb_state

# Adds `error_class` to rows with `file` and `attempt`: null, transient or permanent.
Attempt = Callable[[DataFrame], DataFrame]


class RetryingStream:
    """Runs every file until it succeeds, fails for good or has no attempts left.

    Each step takes the new files and the retries that are due, and writes what came of
    them and the retries that remain in one folder of its own. The next step reads only
    the folder before it, so a step that is run again gives the same result. Columns named in
    `payload` are kept while a file waits and dropped once it has ended.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        attempt: Attempt,
        max_retries: int = MAX_RETRIES,
        payload: Sequence[str] = (),
    ):
        self.spark, self.root, self.attempt = spark, root.rstrip("/"), attempt
        self.max_retries, self.payload = max_retries, payload

    def _folder(self, step: int, part: str) -> DataFrame:
        """`ended` or `waiting` rows of a step; the other part is not read."""
        rows = self.spark.read.parquet(f"{self.root}/step-{step}")
        return rows.where(F.col("part") == part).drop("part")

    def waiting(self, step: int) -> DataFrame:
        """The retries left over by a step, without what the failed attempt gave."""
        return self._folder(step, "waiting").drop("outcome", "result")

    def step(self, files: DataFrame | None, step: int, now: Column) -> DataFrame:
        """One round; returns the retries still waiting."""
        work, later = None, None
        if files is not None:
            work = files.withColumn("attempt", F.lit(0))
        if step:
            queue = self.waiting(step - 1)
            due = queue.where(F.col("next_at") <= now).drop("next_at")
            work = due if work is None else work.unionByName(due)
            later = queue.where(F.col("next_at") > now)
        transient = F.col("error_class") == "transient"
        again = F.coalesce(transient & (F.col("attempt") < self.max_retries), F.lit(False))
        outcome = (
            F.when(F.col("error_class").isNull(), "done")
            .when(transient, "exhausted")
            .otherwise("failed")
        )
        delay = retry_delay(F.col("attempt"), F.col("file"))
        tried = self.attempt(work)
        given = [c for c in tried.columns if c not in work.columns]
        done = (
            tried.withColumn("part", F.when(again, "waiting").otherwise("ended"))
            .withColumn("outcome", F.when(~again, outcome))
            .withColumns({name: F.when(again, F.col(name)) for name in self.payload})
            .withColumn("next_at", F.when(again, F.timestamp_seconds(F.unix_timestamp(now) + delay)))
            .withColumn("attempt", F.col("attempt") + again.cast("int"))
            .withColumn("result", F.struct(*given))
            .drop(*given)
        )
        if later is not None:
            done = done.unionByName(
                later.withColumn("part", F.lit("waiting")), allowMissingColumns=True
            )
        done.write.mode("overwrite").partitionBy("part").parquet(f"{self.root}/step-{step}")
        return self.waiting(step)

    def drain(self, step: int, clock: Column) -> int:
        """Run the waiting retries to their end, with the clock moved past every delay.

        At most as many steps as there are retries to a file.
        """
        while not self.waiting(step).isEmpty():
            step += 1
            clock = clock + F.expr("INTERVAL 1 HOUR")
            self.step(None, step, clock)
        return step

    def ended_in(self, step: int) -> DataFrame:
        """Files that succeeded or failed for good in one step."""
        return self._folder(step, "ended").drop("next_at", *self.payload).select("*", "result.*").drop("result")

    def ended(self, last_step: int) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.ended_in(s) for s in range(last_step + 1)])


class DueTimes(StatefulProcessor):
    """Per file the attempt that is to come, and a processing-time timer for when it is due.

    A row whose attempt has failed sets both; when the timer fires, the row comes out with its next
    attempt. Kept are the columns of the row, not the file's content.
    """

    def __init__(self, kept: Sequence[str], schema: str, second: float):
        self.kept, self.schema, self.second = list(kept), schema, second

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for row in rows:
            if row["attempt"] < 0:  # a new file
                yield Row(**{c: row[c] for c in self.kept}, attempt=0)
                continue
            self.waiting.update(tuple([*(row[c] for c in self.kept), row["attempt"] + 1]))
            now = timerValues.getCurrentProcessingTimeInMs()
            self.handle.registerTimer(now + max(1, int(row["delay"] * self.second * 1000)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.waiting.exists():
            value = self.waiting.get()
            self.waiting.clear()
            yield Row(**dict(zip([*self.kept, "attempt"], value, strict=True)))

    def close(self) -> None:
        pass


class TimedRetries:
    """Runs every file of a stream until it succeeds, fails for good or has no attempts left, on a clock.

    One stream: files that are new or due come out of the state, a micro-batch attempts them and writes
    what came of it, and failures that may pass are an input of the same stream again, which keeps
    them until their timer fires. Timers fire on an idle stream too. A micro-batch that is run again
    replaces its own folders. `second` is the length of a second of delay.
    """

    def __init__(
        self, spark: SparkSession, root: str, attempt: Attempt, max_retries: int = MAX_RETRIES, second: float = 1.0
    ):
        self.spark, self.root, self.attempt = spark, root.rstrip("/"), attempt
        self.max_retries, self.second = max_retries, second

    def start(self, files: DataFrame, interval: str = "0 seconds") -> StreamingQuery:
        """`files` has a column `file` that names each, and others of small values, such as a path."""
        rocksdb_state(self.spark)
        kept = files.schema
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", attempt int"
        failed = f"{self.root}/failed"
        if not exists(self.spark, failed):
            self.spark.createDataFrame([], f"{schema}, delay int").write.parquet(f"{failed}/epoch=-1")
        again = self.spark.readStream.schema(f"{schema}, delay int").parquet(failed)
        new = files.withColumn("attempt", F.lit(-1)).withColumn("delay", F.lit(0))
        due = new.unionByName(again.select(new.columns)).groupBy("file").transformWithState(
            DueTimes(kept.names, schema, self.second), schema, "Append", "ProcessingTime"
        )
        writer = due.writeStream.outputMode("append").option("checkpointLocation", f"{self.root}/checkpoint")
        return writer.foreachBatch(self._step).trigger(processingTime=interval).start()

    def _step(self, due: DataFrame, epoch: int) -> None:
        tried = self.attempt(due)
        transient = F.col("error_class") == "transient"
        again = F.coalesce(transient & (F.col("attempt") < self.max_retries), F.lit(False))
        outcome = (
            F.when(again, None).when(F.col("error_class").isNull(), "done").when(transient, "exhausted").otherwise("failed")
        )
        told = tried.withColumn("outcome", outcome).withColumn("at", F.current_timestamp())
        path = f"{self.root}/attempts/epoch={epoch}"
        told.write.mode("overwrite").parquet(path)
        rows = self.spark.read.parquet(path).where("outcome is null")
        lost = rows.select(*due.columns, retry_delay(F.col("attempt"), F.col("file")).alias("delay"))
        lost.write.mode("overwrite").parquet(f"{self.root}/failed/epoch={epoch}")

    def attempts(self) -> DataFrame:
        """Every attempt that was made; `outcome` is null where another one follows."""
        return self.spark.read.parquet(f"{self.root}/attempts")

    def ended(self) -> DataFrame:
        return self.attempts().where("outcome is not null")

    def run_to_end(self, files: DataFrame, total: int, seconds: float = 600.0) -> DataFrame:
        """Start the stream and stop it when so many files have ended."""
        query = self.start(files)
        limit = time.monotonic() + seconds
        try:
            while query.isActive and time.monotonic() < limit:
                if exists(self.spark, f"{self.root}/attempts") and self._count() >= total:
                    break
                time.sleep(0.2)
            if query.exception():
                raise query.exception()
        finally:
            query.stop()
        return self.ended()

    def _count(self) -> int:
        try:
            return self.ended().count()
        except AnalysisException:  # no micro-batch has been written yet
            return 0
