"""Continuous ingest: arriving files become merged rows, exactly once."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rollcall.operators.encode import Encoder, encode_candidates
from rollcall.operators.key_index import KeyIndex
from rollcall.operators.merge import freed_keys, keys_of, merge
from rollcall.operators.quality import assert_unique_keys
from rollcall.operators.records import (
    TRANSIENT,
    Extractor,
    call_extractor,
    failures,
    records,
    validate_replies,
)
from rollcall.operators.standing import StandingSearch
from rollcall.operators.tables import bulk_load_changes
from rollcall.plans.scan import number_rows
from rollcall.plans.scratch import exists, materialize, temporary_tables
from rollcall.sources.json_arrays import read_array
from rollcall.sources.snapshots import Snapshots

FILES_PER_MINUTE = 14
VERSIONS = 64


class CandidateIngest:
    """Merges each micro-batch into the snapshots.

    A replayed micro-batch finds its id among the published versions and does nothing.
    Outcomes and rejected writes are written in folders per micro-batch before the version is
    published, and only folders of published micro-batches are read. With `skip_known`, a
    file is skipped if one of that name in the same upload batch was inserted or updated before;
    a rejected one is tried again. Once the table is made of more than `versions` versions they
    are written as one, so that the plan that reads it does not grow with the age of the stream.
    `encoder` names what made the vectors of the writes, if they have any. With `index`, the stored rows
    that a micro-batch meets come from an index of their keys, made here if the table is older than it,
    and the table is not read. `standing` keeps results of standing searches up with the table.
    """

    def __init__(
        self,
        store: Snapshots,
        stream: str,
        now: Callable[[], Column],
        skip_known: bool = False,
        versions: int = VERSIONS,
        encoder: str | None = None,
        index: KeyIndex | None = None,
        standing: StandingSearch | None = None,
    ):
        self.store, self.stream, self.now, self.skip_known = store, stream, now, skip_known
        self.versions, self.encoder = versions, encoder
        self.index, self.standing = index, standing
        self.outcome_root = f"{store.root}/outcomes/{stream}"
        self.rejected_root = f"{store.root}/rejected/{stream}"

    def __call__(self, writes: DataFrame, epoch: int) -> None:
        batch = f"{self.stream}-{epoch}"
        if self.store.has_batch(batch):
            return
        if self.skip_known:
            known = self.outcomes()
            if known is not None:
                done = known.where(F.col("action").isin("insert", "update")).select(
                    F.col("source_file").alias("_file"), F.col("batch_id").alias("_batch")
                ).distinct()
                same = F.col("source_file").eqNullSafe(F.col("_file")) & F.col("batch_id").eqNullSafe(F.col("_batch"))
                writes = writes.join(done, same, "left_anti")
        with temporary_tables(self.store.spark):
            writes = materialize(writes, "micro-batch")
            version = self.store.version()
            if self.index is not None and version and self.index.rows(version).isEmpty():
                rows = keys_of(self.store.read())
                self.index.append(rows, rows.limit(0).select(F.lit("").alias("key")), version)
            result = merge(self.store.read(), writes, self.now(), index=self.index, version=version)
            names = writes.select("seq", "batch_id", "source_file")
            result.rejected.write.mode("overwrite").parquet(f"{self.rejected_root}/{batch}")
            result.outcomes.join(names, "seq").write.mode("overwrite").parquet(
                f"{self.outcome_root}/{batch}"
            )
            if self.index is not None:
                # Entries of a version count once that version does.
                self.index.append(keys_of(result.rows), freed_keys(result), version + 1)
            self.store.publish(result.rows, batch, encoder=self.encoder, gate=assert_unique_keys)
            if self.standing is not None:
                self._keep_up(result.rows, version)
        self.store.compact(self.versions)

    def _keep_up(self, changed: DataFrame, before: int) -> None:
        corpus = self.store.read()
        if self.standing.has(before):
            self.standing.update(corpus, changed, before, before + 1)
        else:
            self.standing.build(corpus, before + 1)

    def outcomes(self) -> DataFrame | None:
        return self._published(self.outcome_root)

    def rejected(self) -> DataFrame | None:
        """The rejected writes with all their columns, as dead letters."""
        return self._published(self.rejected_root)

    def _published(self, root: str) -> DataFrame | None:
        done = [m["batch"] for m in self.store.markers() if m["batch"].startswith(f"{self.stream}-")]
        if not done:
            return None
        return self.store.spark.read.parquet(*[f"{root}/{batch}" for batch in done])


def start(
    source: DataFrame,
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    available_now: bool = False,
    interval: str = "1 minute",
    mode: str = "append",
) -> StreamingQuery:
    """Run a stream into a micro-batch function.

    To keep to a rate that counts retries, read from `admission.admitted_files`.
    """
    writer = source.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def run_until_idle(query: StreamingQuery, seconds: float = 600.0) -> None:
    """Stop a stream once it has nothing new to read.

    For a stream with timers or a state with a TTL, which never ends by itself, as time alone
    may change its state: it is idle after a micro-batch without any row.
    """
    limit = time.monotonic() + seconds
    try:
        while query.isActive and time.monotonic() < limit:
            last = query.lastProgress
            if last and last["numInputRows"] == 0:
                break
            time.sleep(0.1)
        if query.exception():
            raise query.exception()
    finally:
        query.stop()


def extraction_attempt(extractor: Extractor) -> Callable[[DataFrame], DataFrame]:
    """The attempt of a RetryingStream over `file, content`: adds `reply` and the kind of error."""

    def attempt(work: DataFrame) -> DataFrame:
        named = work.withColumnRenamed("file", "source_file")
        answers = call_extractor(named, extractor, keep_content=True)
        kind = F.when(F.col("error_class") == TRANSIENT, "transient").when(
            F.col("error_class").isNotNull(), "permanent"
        )
        return answers.withColumnRenamed("source_file", "file").withColumn("error_class", kind)

    return attempt


def replies_to_writes(
    replies: DataFrame, encoder: Encoder, batch_id: Column
) -> tuple[DataFrame, DataFrame]:
    """(rows to merge in the order of their file names, dead letters)."""
    validated = validate_replies(replies)
    good = number_rows(records(validated).withColumn("batch_id", batch_id), "source_file")
    return encode_candidates(good, encoder), failures(validated)


def documents_to_writes(
    documents: DataFrame, extractor: Extractor, encoder: Encoder, batch_id: Column
) -> tuple[DataFrame, DataFrame]:
    """The same for a micro-batch of `source_file, content`.

    The extractor's answers are written down first: each file is sent to it once.
    """
    answers = materialize(call_extractor(documents, extractor), "replies")
    return replies_to_writes(answers, encoder, batch_id)


def load_results(store: Snapshots, path: str, batch: str, now: Column) -> bool:
    """Load JSON arrays of results into the stored table by email: only rows that change are written.

    The records are numbered in the order of their files and places, and the last of an email wins.
    A batch that was loaded before is not loaded again.
    """
    if store.has_batch(batch):
        return False
    with temporary_tables(store.spark):
        numbered = number_rows(read_array(store.spark, path, places=True), "_place").drop("_place")
        incoming = numbered.withColumn("email", F.nullif(F.col("email"), F.lit("")))
        changes = bulk_load_changes(store.read(), materialize(incoming, "records"), "seq", now)
        return store.publish(changes, batch)


class SearchResults:
    """Search results kept per version of the corpus and dropped when it changes."""

    def __init__(self, spark: SparkSession, store: Snapshots, root: str):
        self.spark, self.store, self.root = spark, store, root.rstrip("/")

    def get(self, key: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The stored result of `key` for the present version, computed if there is none."""
        path = f"{self.root}/{self.store.version()}/{key.replace(':', '_')}"
        if not exists(self.spark, f"{path}/_SUCCESS"):
            compute(self.store.read()).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)
