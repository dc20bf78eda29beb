"""Exact deduplication against a persistent digest index.

The index is a Parquet table (digest, keep_id) clustered and sorted by digest. New rows
are reduced to one row per digest, joined to the index by sort-merge without moving the
index, and digests the index lacks are appended.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm.common import BLANKS
from rollcall.plans.scratch import exists, materialize


def text_digest(text: Column) -> Column:
    """SHA-256 of a text with runs of blanks made one space; a null text counts as empty."""
    whole = F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")
    return F.unhex(F.sha2(whole.cast("binary"), 256))


class DigestIndex:
    """Digests seen so far, under `path` in a folder that all executors share.

    `buckets` counts when the index is made and is read back afterwards; by default it is the
    session's number of shuffle partitions. Each append adds a file to a bucket; `compact`
    rewrites the index with one sorted file per bucket.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        layout = f"{self.path}/layout"
        if exists(spark, layout):
            row = spark.read.schema("buckets int, version int").json(layout)
            self.buckets, self.version = row.agg(F.max(F.struct("version", "buckets"))).first()[0][::-1]
        else:
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            self.version = 0
            self._note()
        self._open()

    def _note(self) -> None:
        row = self.spark.range(1).select(
            F.lit(self.buckets).alias("buckets"), F.lit(self.version).alias("version")
        )
        row.coalesce(1).write.mode("append").json(f"{self.path}/layout")

    def _open(self) -> None:
        location = f"{self.path}/digests-{self.version}"
        self.table = "digest_index_" + hashlib.md5(location.encode()).hexdigest()
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS "
            f"LOCATION '{location}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, rows: DataFrame) -> None:
        """Add (digest, keep_id) rows; the files become visible when the whole write ends."""
        writer = rows.select("digest", "keep_id").repartition(self.buckets, "digest").write
        writer.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy(
            "digest"
        ).saveAsTable(self.table)

    def compact(self) -> None:
        """Rewrite as one sorted file per bucket; earlier files stay until they are deleted."""
        old = self.rows()
        self.version += 1
        self._open()
        self.append(old)
        self._note()


def decide(documents: DataFrame, index: DigestIndex) -> DataFrame:
    """(digest, keep_id, group_size) per digest of the batch; new digests go into the index.

    `documents` is (doc_id, digest), read twice, so pass a stored table.
    """
    groups = documents.groupBy("digest").agg(
        F.min("doc_id").alias("_first"), F.count("*").alias("group_size")
    )
    seen = index.rows().hint("merge")
    new = groups.join(seen, "digest", "left_anti").select(
        "digest", F.col("_first").alias("keep_id"), "group_size", F.lit(True).alias("_new")
    )
    known = groups.join(seen, "digest").select(
        "digest", "keep_id", "group_size", F.lit(False).alias("_new")
    )
    decided = materialize(new.union(known), "digests")
    index.append(decided.where("_new"))
    return decided.drop("_new")


def deduplicate(documents: DataFrame, index: DigestIndex) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the smallest doc_id stays, or the one an earlier batch stored in the index.
    group_size counts the rows of this batch. Running a batch again gives the same rows.
    Null texts count as empty. A null doc_id stays only where no row of its group has one; rows
    that repeat an id share its decision. Other columns are ignored. An empty batch gives no
    rows.
    """
    rows = materialize(
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("digest")),
        "text-digests",
    )
    decided = decide(rows, index)
    return rows.join(decided, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_new(documents: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows whose text is new, one per text and with all their columns.

    Rows are combined before they move, so a text's copies never meet in one task. Of equal
    texts the row with the smallest doc_id stays, and of rows with that id one. Texts that an
    earlier batch stored are dropped, except its own row on a repeated run. A column named
    `_digest`, `_row` or `_at` is kept.
    """
    columns = documents.columns
    packed = documents.select(
        text_digest(F.col("text")).alias("digest"),
        F.struct(F.col("doc_id").isNull(), F.col("doc_id")).alias("_at"),
        F.struct(*[documents[f"`{c}`"] for c in columns]).alias("_row"),
    )
    first = packed.groupBy("digest").agg(
        F.min_by("_row", "_at").alias("_row"), F.min("_at").alias("_at")
    )
    first = materialize(first.withColumn("doc_id", F.col("_at.doc_id").cast("long")).drop("_at"), "new-texts")
    decided = decide(first.select("doc_id", "digest"), index)
    kept = first.join(decided, "digest").where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return kept.select([F.col("_row").getField(c).alias(c) for c in columns])
