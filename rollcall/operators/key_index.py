"""An index of the keys that stored rows hold, so that a merge need not scan them.

For every primary key and email there is an entry per version that changed who holds it: the row with
both of its keys, or none where it was given up. The index is bucketed and sorted by key; looking up the
keys of a micro-batch moves these, not the index.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rollcall.plans.scratch import exists

ENTRY = "key STRING, version BIGINT, id BIGINT, k STRING, e STRING, created_at TIMESTAMP"
COLUMNS = ["key", "version", "id", "k", "e", "created_at"]


def email_key(column: str = "e"):
    return F.concat(F.lit("e:"), F.col(column))


class KeyIndex:
    """Entries under `path`, in a folder all executors share; `buckets` counts when it is made."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        layout = f"{self.path}/layout"
        if exists(spark, layout):
            self.buckets = spark.read.schema("buckets int, version long, largest long").json(layout).agg(F.max("buckets")).first()[0]
        else:
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            self._note(0, -1)
        self.table = "key_index_" + hashlib.md5(self.path.encode()).hexdigest()
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({ENTRY}) USING parquet CLUSTERED BY (key) SORTED BY (key) "
            f"INTO {self.buckets} BUCKETS LOCATION '{self.path}/entries'"
        )

    def _note(self, version: int, largest: int) -> None:
        row = self.spark.range(1).select(F.lit(self.buckets).alias("buckets"), F.lit(version).alias("version"), F.lit(largest).alias("largest"))
        row.coalesce(1).write.mode("append").json(f"{self.path}/layout")

    def rows(self, version: int) -> DataFrame:
        """Entries of versions that count; those of a later one may come from a run that was cut off."""
        return self.spark.table(self.table).where(F.col("version") <= version)

    def largest(self, version: int) -> int:
        """The largest id up to a version, from the notes alone."""
        notes = self.spark.read.schema("buckets int, version long, largest long").json(f"{self.path}/layout")
        return notes.where(F.col("version") <= version).agg(F.max("largest")).first()[0]

    def holders(self, keys: DataFrame, version: int) -> DataFrame:
        """(id, k, e, created_at) of the rows that hold one of the keys. The index is not moved."""
        met = self.rows(version).hint("merge").join(keys.select("key").distinct(), "key")
        newest = met.groupBy("key").agg(
            F.max_by(F.struct("id", "k", "e", "created_at"), F.struct("version", F.col("id").isNotNull())).alias("row")
        )
        return newest.where("row.id is not null").select("row.*").distinct()

    def append(self, rows: DataFrame, freed: DataFrame, version: int) -> None:
        """Note the rows (id, k, e, created_at) that a version wrote and the keys that it freed."""
        held = F.array(*[F.when(F.col(c).isNotNull(), key) for c, key in (("k", F.col("k")), ("e", email_key()))])
        entries = rows.select(F.explode(held).alias("key"), F.lit(version).cast("long").alias("version"), "id", "k", "e", "created_at")
        gone = freed.select(
            "key", F.lit(version).cast("long").alias("version"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("k"),
            F.lit(None).cast("string").alias("e"), F.lit(None).cast("timestamp").alias("created_at"),
        )
        seen = Observation()
        both = entries.where("key is not null").unionByName(gone).observe(seen, F.max("id").alias("largest"))
        writer = both.repartition(self.buckets, "key").write.mode("append").format("parquet")
        writer.bucketBy(self.buckets, "key").sortBy("key").saveAsTable(self.table)
        self._note(version, max(seen.get["largest"] or -1, self.largest(version)))
