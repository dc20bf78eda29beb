"""Duplicate-phone checks over the stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollcall.functions import phones
from rollcall.plans.scan import BLOCK_ROWS


def phone_report(df: DataFrame) -> DataFrame:
    """Rows per kind of phone number."""
    digits = phones.digits_only(F.col("phone"))
    key = phones.last_digits(digits)
    kind = (
        F.when(F.col("phone").isNull(), "missing")
        .when(F.length(digits) < phones.SIGNIFICANT_DIGITS, "too short")
        .when(phones.is_placeholder(key), "placeholder")
        .otherwise("usable")
    )
    return df.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def duplicate_counts(df: DataFrame) -> DataFrame:
    """Usable phone keys on more than one row, with the number of rows."""
    keyed = df.select(phones.normalize_phone(F.col("phone")).alias("key"))
    return keyed.where("key is not null").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")


def duplicate_rows(df: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, n, id) for every row of a duplicate group.

    One row per id rather than one list per key: a key may be on any number of rows. Ids
    are unique integers; every key is cut into blocks of `block_rows` of them, and only the
    counts of the blocks come together by key.
    """
    keyed = df.select(
        phones.normalize_phone(F.col("phone")).alias("key"),
        "id",
        F.expr(f"id div {block_rows}").alias("block"),
    ).where("key is not null")
    per_block = keyed.groupBy("key", "block").agg(F.count("*").alias("rows"))
    counts = per_block.select("key", "block", F.sum("rows").over(Window.partitionBy("key")).alias("n"))
    return keyed.join(counts.where("n > 1"), ["key", "block"]).select("key", "n", "id")


def largest_duplicates(df: DataFrame, limit: int = 20) -> DataFrame:
    """The largest groups, with only the last digits of the number shown."""
    top = duplicate_counts(df).orderBy(F.col("n").desc(), "key").limit(limit)
    return top.select(phones.mask_phone(F.col("key")).alias("phone"), "n")


def assert_unique_phones(df: DataFrame) -> None:
    """The gate in front of publishing: refuses a table with a shared phone key."""
    groups = duplicate_counts(df).count()
    if groups:
        raise ValueError(f"{groups} phone number(s) are on more than one row")


def assert_unique_keys(rows: DataFrame) -> None:
    """The same gate over the phone keys that rows were written with."""
    shared = rows.where("phone_normalized is not null").groupBy("phone_normalized").count().where("count > 1")
    groups = shared.count()
    if groups:
        raise ValueError(f"{groups} phone number(s) are on more than one row")
