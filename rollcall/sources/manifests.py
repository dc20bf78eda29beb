"""Batch manifests with an expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.plans.scratch import exists
from rollcall.schemas import MANIFEST

TTL_SECONDS = 24 * 3600
ROWS = "batch_id string, pos long, task_id string, file string, created_at timestamp"


def save_manifest(manifest: DataFrame, path: str) -> None:
    manifest.select("batch_id", "pos", "task_id", "file", "created_at").write.mode("append").parquet(path)


def load_manifest(spark: SparkSession, path: str, now: Column, ttl: int = TTL_SECONDS) -> DataFrame:
    """Manifest rows that have not expired; an unknown batch simply has none."""
    if not exists(spark, path):  # none written yet, so every batch is unknown
        return spark.createDataFrame([], ROWS)
    rows = spark.read.schema(ROWS).parquet(path)
    return rows.where(F.col("created_at") > now - F.make_dt_interval(secs=F.lit(ttl)))


def parse_manifests(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Rows of manifests kept as JSON text; malformed text counts as missing."""
    parsed = payloads.where(F.try_parse_json(payload).isNotNull()).select(
        F.from_json(payload, MANIFEST).alias("m")
    )
    files = parsed.where("m.batch_id is not null").select(
        F.col("m.batch_id").alias("batch_id"), F.posexplode("m.files").alias("pos", "f")
    )
    return files.select("batch_id", F.col("pos").cast("long").alias("pos"), "f.task_id", "f.file")
