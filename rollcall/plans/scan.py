"""Scans and flags within a key that no single task has to run alone.

A window function sends all rows of a key to one task. Here every key is cut into blocks of
positions of a bounded width, so a block holds at most that many of its rows whatever the
key. Blocks are scanned on their own, and what the other blocks contribute is added from a
summary of one row per key and block; only that summary is scanned by key.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.plans.scratch import materialize

# Positions in a block, and so the most rows of one key that a task scans at once.
BLOCK_ROWS = 1_000_000


def nearest(
    df: DataFrame,
    key: str,
    order: str,
    block: str | None = None,
    before: dict[str, Column] | None = None,
    after: dict[str, Column] | None = None,
    inclusive: bool = False,
) -> DataFrame:
    """Add, per name, the value of the closest earlier or later row of the key with one.

    Every value is a struct whose first field is the row's own position, or null where
    the row has none, so the closest earlier value is the running maximum and the
    closest later one the running minimum from the end. `block` names the block of a row;
    leave it out if all positions lie in one. Pass a frame read from a table if they do
    not: it is used twice.
    """
    before, after = before or {}, after or {}
    names = [*before, *after]
    last = Window.currentRow if inclusive else -1
    rows = Window.partitionBy(key, block) if block else Window.partitionBy(key)
    forward = rows.orderBy(F.col(order).asc()).rowsBetween(Window.unboundedPreceding, last)
    backward = rows.orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, last)
    scanned = df.select(
        *[c for c in df.columns if c not in names],
        *[F.max(value).over(forward).alias(name) for name, value in before.items()],
        *[F.min(value).over(backward).alias(name) for name, value in after.items()],
    )
    if block is None:
        return scanned

    per_block = df.groupBy(key, block).agg(
        *[F.max(value).alias(name) for name, value in before.items()],
        *[F.min(value).alias(name) for name, value in after.items()],
    )
    blocks = Window.partitionBy(key)
    earlier = blocks.orderBy(F.col(block).asc()).rowsBetween(Window.unboundedPreceding, -1)
    later = blocks.orderBy(F.col(block).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_block.select(
        key,
        block,
        *[F.max(name).over(earlier).alias(f"_carry_{name}") for name in before],
        *[F.min(name).over(later).alias(f"_carry_{name}") for name in after],
    )
    # Most keys lie in one block and carry nothing.
    carried = carried.where(reduce(or_, [F.col(f"_carry_{name}").isNotNull() for name in names]))
    joined = scanned.join(carried, [key, block], "left")
    return joined.select(
        *[F.col(c) for c in df.columns if c not in names],
        *[F.coalesce(F.col(name), F.col(f"_carry_{name}")).alias(name) for name in names],
    )


def flag_keys(
    df: DataFrame,
    key: str,
    block: str,
    name: str,
    value: Column,
    holds: Callable[[Column, Column], Column],
) -> DataFrame:
    """Add whether `holds(smallest, largest)` for the values of all rows of the key.

    False for rows without a key. Joins by key and block, so a key on most rows is spread
    over as many tasks as it has blocks. Pass a frame read from a table: it is used twice.
    """
    per_block = (
        df.where(F.col(key).isNotNull())
        .groupBy(key, block)
        .agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    )
    whole = Window.partitionBy(key)
    told = per_block.select(
        key, block, holds(F.min("_low").over(whole), F.max("_high").over(whole)).alias(name)
    )
    joined = df.join(told.where(name), [key, block], "left")
    return joined.select(*df.columns, F.coalesce(name, F.lit(False)).alias(name))


def position_within(
    df: DataFrame, key: str, order: str, name: str, width: int = BLOCK_ROWS
) -> DataFrame:
    """Number the rows of each key from 0 in the order of a unique integer column.

    A block covers `width` values of the order column, so it holds at most that many
    rows however many the key has.
    """
    blocked = df.withColumn("_block", F.expr(f"`{order}` div {width}"))
    per_block = blocked.groupBy(key, "_block").agg(F.count("*").alias("_rows"))
    earlier = (
        Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = per_block.select(
        key, "_block", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset")
    )
    inside = F.row_number().over(Window.partitionBy(key, "_block").orderBy(order)) - 1
    numbered = blocked.withColumn("_inside", inside)
    return (
        numbered.join(offsets, [key, "_block"])
        .withColumn(name, (F.col("_inside") + F.col("_offset")).cast("long"))
        .select(*df.columns, name)
    )


def number_rows(df: DataFrame, order: str, name: str = "seq") -> DataFrame:
    """Number all rows from 0 in the order of a column, without a single-task sort.

    Rows are sorted by range partition; a partition's first number is the count of the
    rows in the partitions before it.
    """
    shift, mask = 33, (1 << 33) - 1  # how monotonically_increasing_id() is made up
    placed = materialize(
        df.repartitionByRange(F.col(order))
        .sortWithinPartitions(order)
        .withColumn("_place", F.monotonically_increasing_id()),
        "numbered",
    )
    placed = placed.withColumn("_part", F.shiftright("_place", shift))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the range sort.
    starts = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    )
    number = F.col("_start") + F.col("_place").bitwiseAND(F.lit(mask))
    return placed.join(starts, "_part").select(*df.columns, number.cast("long").alias(name))
