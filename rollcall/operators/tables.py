"""Table-level operators: last write wins, bulk load by email, backfill, set operations."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.phones import normalize_phone

BULK_COLUMNS = ["name", "raw_title", "experience_years", "phone", "skills", "source_file"]


def last_write_wins(df: DataFrame, key: Column, order: str) -> DataFrame:
    """One row per key, the one with the largest `order`; rows without a key all stay.

    Picks the positions with an aggregation of one number per key, which combines before
    the shuffle, and joins the rows on their unique position.
    """
    keyed = df.select(F.col(order), key.alias("_key"))
    newest = keyed.where("_key is not null").groupBy("_key").agg(F.max(order).alias(order))
    winners = newest.select(order).unionByName(keyed.where("_key is null").select(order))
    return df.join(winners, order, "left_semi")


def bulk_load_changes(stored: DataFrame, incoming: DataFrame, order: str, now: Column) -> DataFrame:
    """The rows that a load keyed on email alone inserts or changes, with `is_update`.

    A known email updates six columns and leaves the vector, the phone key and the batch
    as they were; a new one is inserted with none of these; the last record of an email
    wins, and records without an email are all inserted. A row that would stay as it is is not there.
    """
    known, unknown = F.col("email").isNotNull(), F.col("email").isNull()
    spans = incoming.where(known).groupBy("email").agg(
        F.max(order).alias("last"), F.min(order).alias("first")
    )
    payload = incoming.select(F.col(order).alias("last"), "email", *BULK_COLUMNS)
    latest = payload.join(spans.drop("email"), "last")

    # Which row gets which record is settled on ids and emails alone; the stored rows are
    # joined on their unique id, with as few rows as the load meets.
    emails = stored.where(known).select("id", "email")
    fresh = emails.join(latest, "email").select("id", F.struct(*BULK_COLUMNS).alias("_new"))
    met = stored.join(fresh, "id")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_new.{c}")) for c in BULK_COLUMNS])
    updated = met.where(~same).select(
        *[F.col(f"_new.{c}").alias(c) if c in BULK_COLUMNS else F.col(c) for c in stored.columns], F.lit(True).alias("is_update")
    )
    largest = stored.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("largest")).scalar()
    loose = payload.where(unknown).withColumn("first", F.col("last"))
    inserted = latest.join(emails, "email", "left_anti").unionByName(loose)
    inserted = inserted.select(
        (largest + 1 + F.col("first")).alias("id"), "email", *BULK_COLUMNS, now.alias("created_at"), F.lit(False).alias("is_update")
    )
    return updated.unionByName(inserted, allowMissingColumns=True).select(*stored.columns, "is_update")


def bulk_load_by_email(stored: DataFrame, incoming: DataFrame, order: str, now: Column) -> DataFrame:
    """The whole table after `bulk_load_changes`."""
    changes = bulk_load_changes(stored, incoming, order, now)
    untouched = stored.join(changes.where("is_update").select("id"), "id", "left_anti")
    return untouched.unionByName(changes.drop("is_update")).select(*stored.columns)


def backfill_phone_keys(df: DataFrame) -> DataFrame:
    key = F.coalesce(F.col("phone_normalized"), normalize_phone(F.col("phone")))
    return df.withColumn("phone_normalized", key)


def append(prior: DataFrame, new: DataFrame) -> DataFrame:
    """Add rows without looking at keys; repeating it repeats the rows."""
    return prior.unionByName(new, allowMissingColumns=True)


def pending(files: DataFrame, done: DataFrame, name: str = "source_file") -> DataFrame:
    """Files not yet processed, matched on the name alone."""
    return files.join(done.select(name).distinct(), name, "left_anti")


def pending_counts(files: DataFrame, done: DataFrame, name: str = "source_file") -> DataFrame:
    handled = done.select(name).distinct().withColumn("_done", F.lit(True))
    return files.join(handled, name, "left").agg(
        F.count("*").alias("found"),
        F.count_if("_done").alias("skipped"),
        F.count_if(F.col("_done").isNull()).alias("pending"),
    )


def task_summary(df: DataFrame) -> DataFrame:
    """What a task reports: never the vector."""
    return df.drop("embedding")
