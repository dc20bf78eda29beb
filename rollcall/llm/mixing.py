"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each document is repeated k times, k drawn from a Poisson distribution with the mean
target rows / present rows of its source. The draw inverts the distribution at a uniform
number hashed from seed and id, so it needs no state and repeats itself on a retry.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.plans.scratch import materialize

HEX_DIGITS = 13
# The largest mean that one draw inverts, and the parts of a row that are counted together.
LARGEST = 64
PART_BLOCK = 1 << 16


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts joined by colons."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts)), 1, HEX_DIGITS)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**HEX_DIGITS))


def cumulative_poisson(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... until what is left is far below 2^-52.

    Terms are carried as logarithms, so a large mean does not underflow.
    """
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    first = F.struct((-mean).alias("log"), F.exp(-mean).alias("sum"), F.array(F.exp(-mean)).alias("all"))

    def step(state: Column, k: Column) -> Column:
        log = state["log"] + F.ln(mean) - F.ln(k.cast("double"))
        total = state["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(state["all"], F.array(total)).alias("all"))

    sums = F.aggregate(F.sequence(F.lit(1), last), first, step, lambda state: state["all"])
    return F.when(mean > 0, sums).otherwise(F.array(F.lit(1.0)))


def source_rates(
    documents: DataFrame, weights: Mapping[str, float] | DataFrame | None, rows: int | None
) -> DataFrame:
    """(_source, _mean) per source of the table: the mean number of copies of its rows."""
    counts = documents.groupBy(F.col("source").alias("_source")).agg(F.count("*").alias("_rows"))
    if weights is None:
        weighted = counts.withColumn("_weight", F.lit(1.0))
    else:
        if isinstance(weights, Mapping):
            pairs = [(str(k) if k is not None else None, float(v)) for k, v in weights.items()]
            weights = documents.sparkSession.createDataFrame(pairs, "source string, weight double")
        given = weights.groupBy(F.col("source").alias("_given")).agg(F.sum("weight").alias("_weight"))
        weighted = counts.join(given, F.col("_source").eqNullSafe(F.col("_given")), "left").drop("_given")
    weighted = weighted.withColumn("_weight", F.greatest(F.coalesce("_weight", F.lit(0.0)), F.lit(0.0)))
    all_weight = weighted.agg(F.sum("_weight").alias("w")).scalar()
    wanted = F.lit(rows) if rows is not None else counts.agg(F.sum("_rows").alias("n")).scalar()
    mean = F.try_divide(F.col("_weight"), all_weight) * wanted / F.col("_rows")
    return weighted.select("_source", F.coalesce(mean, F.lit(0.0)).alias("_mean"))


def replicate(
    documents: DataFrame,
    weights: Mapping[str, float] | DataFrame | None = None,
    rows: int | None = None,
    seed: int = 17,
) -> DataFrame:
    """(row, n_copies, copy_index, mix_key): whole input rows as structs, in a global random order.

    See `mix`. A mean above LARGEST is drawn in equal parts of at most that, whose sum is Poisson as
    well: the parts of a row are counted in blocks, dealt over all tasks, and repeated there, so no
    task makes all copies of one row.
    """
    rates = source_rates(documents, weights, rows).where("_mean > 0")
    parts = F.ceil(F.col("_mean") / LARGEST).cast("long")
    of_source = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))
    rates = rates.select(of_source(F.col("_source")).alias("source"), parts.alias("parts"), (F.col("_mean") / parts).alias("mean"))
    # Stored, so that Spark knows its size before it plans the join.
    rates = materialize(rates.withColumn("sums", cumulative_poisson(F.col("mean"))), "source-rates")
    packed = documents.select(
        F.struct(*[documents[f"`{c}`"] for c in documents.columns]).alias("row"),
        F.coalesce(documents["doc_id"].cast("string"), F.lit("null")).alias("name"),
        of_source(documents["source"]).alias("source"),
    )
    met = packed.join(rates, "source")
    start, name = F.lit(str(seed)), F.col("name")

    def drawn(at: Column) -> Column:
        return F.size(F.filter("sums", lambda x: x < at)).cast("long")

    few = met.where("parts = 1").withColumn("n_copies", drawn(uniform(start, name)))
    few = few.select("row", "name", "n_copies", F.lit(0).cast("long").alias("first"), F.col("n_copies").alias("here"))

    large = rates.where("parts > 1")
    many = few.limit(0)
    if not large.isEmpty():
        # Without the texts: copies in each part, and in the parts before it.
        ids = met.where("parts > 1").select("name", "source", "parts", "sums").groupBy("name", "source").agg(
            F.first("parts").alias("parts"), F.first("sums").alias("sums")
        )
        block = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(parts - 1) div {PART_BLOCK}"))).alias("block")
        blocks = ids.select("name", "source", "parts", "sums", block).repartition("name", "block")
        within = F.sequence(F.col("block") * PART_BLOCK, F.least((F.col("block") + 1) * PART_BLOCK, F.col("parts")) - 1)
        each = blocks.select("name", "source", "block", "sums", F.explode(within).alias("part"))
        each = materialize(each.select("name", "source", "block", "part", drawn(uniform(start, name, F.col("part"))).alias("here")), "parts")
        of_block = Window.partitionBy("name", "source", "block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        earlier = Window.partitionBy("name", "source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        totals = each.groupBy("name", "source", "block").agg(F.sum("here").alias("in_block"))
        totals = totals.select(
            "name", "source", "block", F.coalesce(F.sum("in_block").over(earlier), F.lit(0)).alias("passed"),
            F.sum("in_block").over(Window.partitionBy("name", "source")).alias("n_copies"),
        )
        placed = each.select("*", F.coalesce(F.sum("here").over(of_block), F.lit(0)).alias("inside")).join(
            totals, ["name", "source", "block"]
        )
        placed = placed.where("here > 0").select(
            "name", "source", "part", "here", "n_copies", (F.col("passed") + F.col("inside")).alias("first")
        )
        rows_ = met.where("parts > 1").select("row", "name", "source", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
        many = rows_.join(placed, ["name", "source", "part"]).select("row", "name", "n_copies", "first", "here")

    copies = few.union(many).where("here > 0").select(
        "row", "name", "n_copies", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("here") - 1)).alias("copy_index")
    )
    key = F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed} order"), "name", F.col("copy_index"))), 1, 16)
    keyed = copies.select("row", "n_copies", "copy_index", key.alias("mix_key"))
    return keyed.repartition("mix_key").sortWithinPartitions("mix_key")


def unpacked(rows: DataFrame, columns: list[str]) -> list[Column]:
    """The columns of the input rows that `replicate` packed."""
    return [rows["row"].getField(c).alias(c) for c in columns]


def mix(
    documents: DataFrame,
    weights: Mapping[str, float] | DataFrame | None = None,
    rows: int | None = None,
    seed: int = 17,
) -> DataFrame:
    """Documents in a global random order, each repeated as often as its draw says.

    `weights` gives each source its share of the result (None: all sources alike); a source
    it does not name, or names with null or less than 0, gets none. `rows` is the expected
    size of the result, by default the present one. Adds n_copies, copy_index (from 0) and
    mix_key, which orders the result; input columns of these names are replaced, all others are
    kept whatever their names. A null source is a source of its own. A null doc_id draws as an id of
    its own; rows that repeat an id draw alike. Texts are not looked at. An empty table gives an
    empty one.

    A source's size does not matter: rows are counted before they move and each is drawn where
    it is read. The rates, one row per source, are joined as Spark finds their size. Only the
    rows of the result are shuffled, once, by a hash that is unique to each, but for rows of a
    source so rare that each is repeated more than LARGEST times: these move once more, part by part.
    """
    kept = [c for c in documents.columns if c.lower() not in ("n_copies", "copy_index", "mix_key")]
    found = replicate(documents, weights, rows, seed)
    return found.select(*unpacked(found, kept), "n_copies", "copy_index", "mix_key")
