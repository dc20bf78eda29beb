"""All pairs of similar sets, exactly, by prefixes of their rarest members.

Two sets as similar as asked for share one of the rarest members of the smaller and one of a few
more of the larger. Any order that all sets agree on gives the same pairs: it is by counts per
cell of a fixed number of cells, so members are counted without a shuffle of them, and only the
prefixes move. Only sets of different components meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.plans.scratch import materialize

CELLS = 1 << 20
BLOCK_ROWS = 4096
HELD_ROWS = 200_000
SALTS = 16


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros(CELLS, np.int64)
    for batch in batches:
        for data in batch["shingles"]:
            # Members of one set may share a cell.
            np.add.at(counts, np.frombuffer(data, np.uint64) % np.uint64(CELLS), 1)
    cells = np.flatnonzero(counts)
    yield pd.DataFrame({"cell": cells.astype(np.int32), "n": counts[cells]})


def _prefixes(counts: np.ndarray, threshold: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, size = [], 0
            for id_, component, data in zip(batch["id"], batch["component"], batch["shingles"], strict=True):
                members = np.frombuffer(data, np.uint64)
                n = len(members)
                if not n:
                    continue
                often = counts[members % np.uint64(CELLS)]
                # Common members, at least: with a set of its size or more, and of any size allowed.
                indexed = n + 1 + (-2 * threshold * n // (100 + threshold))
                probed = n + 1 + (-threshold * n // 100)
                first = np.lexsort((members, often))[:probed]
                held.append(
                    pd.DataFrame(
                        {
                            "member": members[first].view(np.int64), "position": np.arange(len(first)), "id": id_,
                            "component": component, "n": n, "indexed": np.arange(len(first)) < indexed,
                        }
                    )
                )
                size += len(first)
                if size > HELD_ROWS:
                    yield pd.concat(held, ignore_index=True)
                    held, size = [], 0
            if held:
                yield pd.concat(held, ignore_index=True)

    return run


def meetings(sets: DataFrame, threshold: int) -> DataFrame:
    """(a, b), a < b, with repetitions: rows of two components that share a member of their prefixes.

    Per member, rows of its largest component meet only the rows of others: what most hold costs no
    more than (rows) x (rows outside its largest component), and nothing in one component alone.
    Both sides are dealt in blocks whose numbers follow from the counts.
    """
    seen = sets.select("shingles").mapInPandas(_count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CELLS, np.int64)
    counts[seen["cell"].to_numpy()] = seen["n"].to_numpy()
    schema = "member long, position int, id long, component long, n int, indexed boolean"
    rows = materialize(sets.mapInPandas(_prefixes(counts, threshold), schema), "prefix-rows")
    sizes = rows.groupBy("member", "component").agg(F.count("*").alias("c"))
    told = sizes.groupBy("member").agg(
        F.max_by("component", F.struct("c", "component")).alias("major"), F.sum("c").alias("every"), F.max("c").alias("most")
    ).where("most < every")
    told = told.select(
        "member", "major", F.expr(f"1 + (every - most) div {BLOCK_ROWS}").alias("minors"), F.expr(f"1 + every div {BLOCK_ROWS}").alias("wide"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
    )
    told = materialize(told, "shared-members")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(told, ["member", "salt"])
    own = ["id", "component", "n", "position", "indexed"]

    def dealt(by: str, blocks: str, name: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(name), by), F.col(blocks)).alias(name)

    def every(blocks: str, name: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1)).alias(name)

    x = salted.where("component <> major").select("member", dealt("id", "minors", "down"), every("wide", "across"), *[F.col(c).alias(f"x_{c}") for c in own])
    y = salted.select(
        "member", every("minors", "down"), dealt("id", "wide", "across"), F.expr("component = major").alias("y_major"), *[F.col(c).alias(f"y_{c}") for c in own]
    )
    once = F.expr("x_component <> y_component and (y_major or x_id < y_id)")
    smaller = F.expr("if(x_n < y_n or (x_n = y_n and x_id < y_id), x_indexed, y_indexed)")
    alike = F.expr(f"100L * least(x_n, y_n) >= {threshold} * greatest(x_n, y_n)")
    # Of the first member in common, which similar sets have here: it and all after it suffice.
    enough = F.expr(f"(100L + {threshold}) * least(x_n - x_position, y_n - y_position) >= {threshold} * (0L + x_n + y_n)")
    met = x.join(y, ["member", "down", "across"]).where(once & smaller & alike & enough)
    return met.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"))


def close_pairs(sets: DataFrame, threshold: int) -> DataFrame:
    """(a, b), a < b: every similar pair of ids of two components, and others, to be confirmed.

    `sets` holds (id, component, shingles), the last as sorted 64-bit numbers. It is read twice.
    """
    return meetings(sets, threshold).distinct()
