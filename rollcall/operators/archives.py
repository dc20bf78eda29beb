"""Archive entries: which to read, their positions, and the limits of an upload."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.functions import files
from rollcall.plans.scan import position_within


@dataclass(frozen=True)
class Limits:
    """Largest accepted values; each is itself still accepted."""

    files: int = 500
    total_bytes: int = 500 * 1024 * 1024
    file_bytes: int = 25 * 1024 * 1024
    ratio: float = 100.0


def candidate_entries(members: DataFrame, width: int = 1_000_000) -> DataFrame:
    """Usable members with their index in the archive and a generated name."""
    usable = members.where(files.is_candidate_entry(F.col("member")))
    numbered = position_within(usable, "archive", "pos", "idx", width)
    return numbered.withColumn("spool_name", files.spool_name(F.col("idx"), F.col("member")))


def check_limits(members: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One verdict per archive: the first rule it breaks, or null.

    Rules apply in the order none usable, count, total size, then member by member in
    archive order first the size and then the compression ratio. Everything is one
    aggregation that combines before the shuffle.
    """
    usable = files.is_candidate_entry(F.col("member"))
    ratio = files.compression_ratio(F.col("file_size"), F.col("compress_size"))
    broken = F.when(F.col("file_size") > limits.file_bytes, "file too large").when(
        ratio > limits.ratio, "ratio too high"
    )
    # Position first, so the smallest is the first member that breaks a rule.
    first = F.when(usable & broken.isNotNull(), F.struct("pos", broken.alias("rule"), "member"))
    stats = members.groupBy("archive").agg(
        F.count_if(usable).alias("files"),
        F.coalesce(F.sum(F.when(usable, F.col("file_size"))), F.lit(0)).alias("total_bytes"),
        F.max(F.when(usable, F.col("file_size"))).alias("largest_file"),
        F.max(F.when(usable, ratio)).alias("largest_ratio"),
        F.min(first).alias("first"),
    )
    rejection = (
        F.when(F.col("files") == 0, "no supported files")
        .when(F.col("files") > limits.files, "too many files")
        .when(F.col("total_bytes") > limits.total_bytes, "too large in total")
        .otherwise(F.col("first.rule"))
    )
    checked = stats.withColumn("rejection", rejection)
    by_member = F.col("rejection").isin("file too large", "ratio too high")
    return checked.withColumn("member", F.when(by_member, F.col("first.member"))).drop("first")


def accepted_members(members: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Usable members of the archives that keep the limits."""
    fine = check_limits(members, limits).where("rejection is null").select("archive")
    return candidate_entries(members).join(fine, "archive", "left_semi")


def upload_receipts(accepted: DataFrame) -> DataFrame:
    """Batch id, number of queued files and their names in archive order.

    The list is as long as an accepted archive, which the count limit bounds.
    """
    entry = F.struct("idx", "member")
    return accepted.groupBy("batch_id").agg(
        F.count("*").alias("queued"),
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["member"]).alias("files"),
    )
