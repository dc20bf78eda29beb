"""A z-fast trie of conversations: shared beginnings are stored once.

A conversation is a sequence of turns, and the hash of its first d turns names a prefix. The
trie holds compacted nodes only: the root, ends of conversations and places where they part.
A node stands for the prefixes longer than its parent's, up to its own, and is filed under the
hash of one of them, its handle: the prefix whose length is divisible by the highest power of
two. Conversations are inserted in batches. A batch first finds where each of its members leaves
the trie, by a fat binary search over handles that takes a number of joins logarithmic in the
longest conversation; only turns beyond that place, and the edges they split, are then looked
at. Counts are summed over the compacted nodes by pointer doubling, and edges are expanded to one
row per prefix at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollcall.plans.scan import BLOCK_ROWS, nearest, number_rows, position_within
from rollcall.plans.scratch import materialize

KEY = ["depth", "p", "q"]
IDS_PER_CHUNK = 1 << 16
NODE = "depth long, p long, q long, up long, up_p long, up_q long, rep long, size long, up_size long, top_p long, top_q long"


@dataclass(frozen=True)
class Batches:
    """One conversation in `first` makes up the first batch, all others the second. `salts`: rows
    that look up the same node, such as a first turn that a third of them share, are dealt over
    so many tasks."""

    first: int = 16
    salts: int = 8


def _block(column: str) -> Column:
    return F.expr(f"{column} div {BLOCK_ROWS}")


def _blocks_to(last: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), _block(last))).alias("block")


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, size): turns in order, from 0; size counts code points of the text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        digest.alias("digest"),
        F.length(text).cast("long").alias("size"),
    )
    rows = rows.select("conv_id", F.struct("conv_id", "turn", "digest").alias("_order"), "digest", "size")
    placed = position_within(number_rows(rows, "_order", "_seq"), "conv_id", "_seq", "pos")
    return materialize(placed.select("conv_id", "pos", "digest", "size"), "numbered-turns")


def rebuilt(conversations: DataFrame, most: int = 6, family: int = 100) -> tuple[DataFrame, DataFrame]:
    """The turns (conv_id, depth, digest, size, is_last) and the lengths (conv_id, n) of conversations
    that begin as the first of their family of `family` ids does, for fewer than `most` turns.

    The first of a family is c - c % family, where % truncates. How many turns c takes over is crc32 of its decimal id modulo `most`; its own turns after as
    many follow.
    """
    turns = numbered(conversations)
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    borrowed = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most))
    whole = sizes.select("conv_id", "own", borrowed.alias("h"), F.expr(f"conv_id - conv_id % {family}").alias("head"))
    heads = sizes.where(f"conv_id % {family} = 0").select(F.col("conv_id").alias("head"), F.col("own").alias("there"))
    lent = F.least("h", F.coalesce("there", F.lit(0)))
    plan = whole.join(heads, "head", "left").select("conv_id", "head", "own", "h", lent.alias("lent"))
    plan = materialize(plan.withColumn("n", F.expr("lent + greatest(own - h, 0)")), "rebuilt-conversations")
    # Keyed by blocks of turns too, as one conversation may hold most of the table.
    spread = plan.select("conv_id", "h", "lent", "n", _blocks_to("own"))
    kept = turns.withColumn("block", _block("pos")).join(spread, ["conv_id", "block"]).where("pos >= h")
    kept = kept.select("conv_id", F.expr("lent + pos - h + 1").alias("depth"), "digest", "size", "n")
    first = turns.where(f"pos < {most} and conv_id % {family} = 0").withColumnRenamed("conv_id", "head")
    taken = first.join(plan, "head").where("pos < lent").select("conv_id", F.expr("pos + 1").alias("depth"), "digest", "size", "n")
    both = kept.union(taken).withColumn("is_last", F.expr("depth = n")).drop("n")
    return both, plan.select("conv_id", "n")


def prefixes(turns: DataFrame) -> DataFrame:
    """Per turn the hash (p, q) of the conversation up to it and the one (p0, q0) before it.

    A prefix's hash is the exclusive or of hashes of its turns with their depths, so blocks of a
    conversation are hashed on their own. `size` and `size0` are code points up to it and before it.
    """
    own = turns.select(
        "conv_id", "depth", "is_last", "size", _block("depth").alias("block"),
        F.xxhash64(F.lit(1), "depth", "digest").alias("x"), F.xxhash64(F.lit(2), "depth", "digest").alias("y"),
    )
    own = materialize(own, "hashed-turns")
    upto = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    scanned = own.select(
        "*", F.bit_xor("x").over(upto).alias("p"), F.bit_xor("y").over(upto).alias("q"), F.sum("size").over(upto).alias("total")
    )
    totals = own.groupBy("conv_id", "block").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("size").alias("size"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        "conv_id", "block", F.bit_xor("x").over(earlier).alias("cx"), F.bit_xor("y").over(earlier).alias("cy"),
        F.sum("size").over(earlier).alias("more"),
    ).where("more is not null")
    whole = scanned.join(carried, ["conv_id", "block"], "left").withColumns(
        {"p": F.expr("p ^ coalesce(cx, 0)"), "q": F.expr("q ^ coalesce(cy, 0)"), "total": F.expr("total + coalesce(more, 0)")}
    )
    return materialize(
        whole.select(
            "conv_id", "block", "depth", "is_last", "p", "q", F.expr("p ^ x").alias("p0"), F.expr("q ^ y").alias("q0"),
            F.expr("total - size").alias("size0"), F.col("total").alias("size"),
        ),
        "prefixes",
    )


def two_fattest(low: str, high: str) -> Column:
    """The number above `low` and up to `high` that is divisible by the highest power of two."""
    return F.expr(f"{high} & shiftleft(-1L, length(bin({low} ^ {high})) - 1)").cast("long")


class ZFastTrie:
    """Compacted nodes over a table of prefixes; see the module's text.

    `nodes` has a row per compacted node: its prefix (depth, p, q), its parent's (up, up_p, up_q),
    a conversation `rep` that runs through it, code points up to both, and the hash (top_p, top_q)
    of the shortest prefix on its edge.
    """

    def __init__(self, spark: SparkSession, paths: DataFrame, settings: Batches = Batches()):
        self.paths, self.settings = paths, settings
        self.nodes = spark.createDataFrame([], NODE)

    def _salted(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(self.settings.salts - 1))))

    def _dealt(self, by: str) -> Column:
        return F.pmod(F.xxhash64(by), F.lit(self.settings.salts)).cast("int").alias("salt")

    def handles(self) -> DataFrame:
        """(depth, p, q) of each inner node's handle with the node's depth and parent: leaves need none."""
        inner = self.nodes.join(self.nodes.select(F.col("up").alias("depth"), F.col("up_p").alias("p"), F.col("up_q").alias("q")).distinct(), KEY)
        at = inner.select(F.col("rep").alias("conv_id"), two_fattest("up", "depth").alias("at"), *KEY, "up", "up_p", "up_q")
        named = at.toDF("conv_id", "depth", "extent", "ep", "eq", "up", "up_p", "up_q").join(
            self.paths.select("conv_id", *KEY), ["conv_id", "depth"]
        )
        return materialize(named.drop("conv_id"), "handles")

    def locate(self, members: DataFrame) -> DataFrame:
        """(conv_id, n, at): per member (conv_id, n) how long a prefix of it is a node, the longest such."""
        now = members.select("conv_id", "n", F.lit(0).cast("long").alias("low"), F.col("n").alias("high"), F.lit(0).cast("long").alias("up"), F.lit(0).cast("long").alias("ep"), F.lit(0).cast("long").alias("eq"))
        if self.nodes.isEmpty():
            return now.select("conv_id", "n", F.col("low").alias("at"))
        handles = self._salted(self.handles())
        rounds = int(members.agg(F.max("n")).first()[0] or 0).bit_length()
        for _ in range(rounds):
            asked = now.withColumn("depth", F.when(F.expr("low < high"), two_fattest("low", "high")))
            keyed = asked.join(self.paths.select("conv_id", *KEY), ["conv_id", "depth"], "left").withColumn("salt", self._dealt("conv_id"))
            hit = handles.select(*KEY, "salt", F.col("extent"), F.col("ep").alias("hp"), F.col("eq").alias("hq"), F.col("up").alias("hup"))
            found = keyed.join(hit, [*KEY, "salt"], "left")
            # A node's prefix may be longer than what the member shares with it: then nothing below it matches.
            now = found.select(
                "conv_id", "n",
                F.coalesce("extent", "low").alias("low"),
                F.expr("case when depth is null then high when extent is null then depth - 1 else greatest(high, extent) end").alias("high"),
                F.coalesce("hup", "up").alias("up"), F.coalesce("hp", "ep").alias("ep"), F.coalesce("hq", "eq").alias("eq"),
            )
            now = materialize(now.withColumn("high", F.expr("greatest(least(high, n), low)")), "located")
        # The last node found is where the member leaves the trie; does it hold the whole of it?
        there = self.paths.select("conv_id", F.col("depth").alias("low"), "p", "q")
        ended = now.join(there, ["conv_id", "low"], "left")
        whole = F.expr("low = 0 or (p = ep and q = eq)")
        return materialize(ended.select("conv_id", "n", F.when(whole, F.col("low")).otherwise(F.col("up")).alias("at")), "exits")

    def _edge_rows(self, nodes: DataFrame, *carried: str) -> DataFrame:
        """One row per prefix on the edges of the nodes, found on their representatives."""
        every = nodes.where("depth > 0").select(
            F.col("rep").alias("conv_id"), F.col("depth").alias("extent"), *carried,
            F.explode(F.sequence(F.col("up") + 1, F.col("depth"))).alias("depth"),
        )
        return every.join(self.paths, ["conv_id", "depth"])

    def insert(self, members: DataFrame) -> None:
        """Add members (conv_id, n) that all differ from each other."""
        exits = self.locate(members)
        fresh = self.paths.join(exits.select("conv_id", "n", "at", _blocks_to("n")), ["conv_id", "block"]).where("depth > at")
        columns = [*KEY, F.col("conv_id").alias("rep"), "p0", "q0", "size", "size0"]
        fresh = materialize(fresh.select(*columns, F.expr("depth = n").alias("named"), F.expr("depth = at + 1").alias("top")), "new-prefixes")
        tops = fresh.where("top").select((F.col("depth") - 1).alias("up"), F.col("p").alias("top_p"), F.col("q").alias("top_q")).distinct()
        split = materialize(self.nodes.join(tops, ["up", "top_p", "top_q"], "left_semi").select(self.nodes.columns), "split-edges")
        old = self._edge_rows(split).select(*columns, F.expr("depth = extent").alias("named"))
        points = fresh.drop("top").union(old).groupBy(*KEY).agg(
            F.min("rep").alias("rep"), F.max("named").alias("named"), *[F.min(c).alias(c) for c in ("p0", "q0", "size", "size0")]
        )
        points = materialize(points, "points")
        parted = points.groupBy((F.col("depth") - 1).alias("depth"), F.col("p0").alias("p"), F.col("q0").alias("q")).agg(F.count("*").alias("ways"))
        marked = points.join(parted.where("ways > 1"), KEY, "left").withColumn("node", F.expr("named or ways is not null"))
        marked = materialize(marked.select(*points.columns, "node", _block("depth").alias("block")), "marked-points")
        # Prefixes with the same representative follow each other; where they begin, another's is above.
        seen = nearest(marked, "rep", "depth", "block", before={"_last": F.struct("depth")})
        above = F.struct((F.col("depth") - 1).alias("depth"), F.col("p0").alias("p"), F.col("q0").alias("q"), F.col("size0").alias("size"))
        begins = F.expr("_last is null or _last.depth < depth - 1")
        begun = materialize(seen.withColumn("_above", F.when(begins, above)).drop("_last"), "begun-points")
        passed = F.when(F.col("node"), F.struct("depth", "p", "q", "size")).otherwise(F.col("_above"))
        scanned = nearest(begun, "rep", "depth", "block", before={"_up": passed}).where("node")
        grown = scanned.withColumn("_up", F.coalesce("_above", "_up"))
        grown = grown.select(*KEY, F.col("_up.depth").alias("up"), F.col("_up.p").alias("up_p"), F.col("_up.q").alias("up_q"), "rep", "size", F.col("_up.size").alias("up_size"))
        top = marked.select("rep", (F.col("depth") - 1).alias("up"), F.col("p").alias("top_p"), F.col("q").alias("top_q"))
        grown = grown.join(top, ["rep", "up"]).select(self.nodes.columns)
        kept = self.nodes.join(split.select(*KEY), KEY, "left_anti").select(self.nodes.columns)
        self.nodes = materialize(kept.union(grown), "nodes")

    def counted(self, ends: DataFrame) -> DataFrame:
        """The nodes, the root too, with sums over their subtrees; `ends` holds (conv_id, depth, p, q).

        Every round adds to each node what its descendants up to twice as far down have, so the
        number of rounds is the logarithm of the number of nodes on a path.
        """
        here = ends.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("conv_id").alias("low"))
        root = here.sparkSession.range(1).selectExpr(*[f"cast({0 if c in ('depth', 'p', 'q', 'size', 'up_size') else 'null'} as long) {c}" for c in self.nodes.columns])
        ways = self.nodes.groupBy(F.col("up").alias("depth"), F.col("up_p").alias("p"), F.col("up_q").alias("q")).agg(F.count("*").alias("ways"))
        start = self.nodes.union(root).join(here, KEY, "left").join(ways, KEY, "left").select(
            *self.nodes.columns, F.coalesce("ways", F.lit(0)).alias("ways"), F.coalesce("n", F.lit(0)).alias("n"), "low",
            F.expr("coalesce(n, 0) * size").alias("sizes"), F.expr("size - up_size").alias("own"),
            F.when(F.col("ways").isNull(), 1).otherwise(0).cast("long").alias("leaves"),
            F.col("up").alias("to"), F.col("up_p").alias("to_p"), F.col("up_q").alias("to_q"),
        )
        now = materialize(start, "counted")
        sums = ("n", "sizes", "own", "leaves")
        while not now.where("to is not null").isEmpty():
            sent = now.where("to is not null").groupBy(F.col("to").alias("depth"), F.col("to_p").alias("p"), F.col("to_q").alias("q")).agg(
                *[F.sum(c).alias(f"_{c}") for c in sums], F.min("low").alias("_low")
            )
            jumps = self._salted(now.where("ways > 0 and to is not null").select(F.col("depth").alias("to"), F.col("p").alias("to_p"), F.col("q").alias("to_q"), F.col("to").alias("_to"), F.col("to_p").alias("_to_p"), F.col("to_q").alias("_to_q")))
            rest = [c for c in now.columns if c not in (*sums, "low", "to", "to_p", "to_q")]
            grown = now.withColumn("salt", self._dealt("p")).join(jumps, ["to", "to_p", "to_q", "salt"], "left").join(sent, KEY, "left")
            now = materialize(
                grown.select(
                    *[F.col(c) for c in rest], *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums],
                    F.least("low", "_low").alias("low"), *[F.col(f"_{c}").alias(c) for c in ("to", "to_p", "to_q")],
                ),
                "counted",
            )
        return now

    def expanded(self, counted: DataFrame) -> DataFrame:
        """One row per prefix: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, p, q."""
        above = self._salted(counted.where("ways > 0").select(F.col("depth").alias("up"), F.col("p").alias("up_p"), F.col("q").alias("up_q"), F.col("low").alias("above")))
        nodes = counted.withColumn("salt", self._dealt("p")).join(above, ["up", "up_p", "up_q", "salt"], "left")
        nodes = materialize(nodes.drop("salt"), "counted")
        rows = self._edge_rows(nodes, "up", "up_size", "low", "above", "n", "ways", "leaves", "sizes", "own")
        deep = rows.select(
            F.col("low").alias("conv_id"), "depth", F.when(F.expr("depth = up + 1"), F.col("above")).otherwise(F.col("low")).alias("parent_conv_id"),
            F.col("n").alias("n_convs"), F.when(F.expr("depth = extent"), F.col("ways")).otherwise(1).cast("long").alias("n_children"),
            F.col("leaves").alias("n_leaves"),
            # Code points from here on, once for each member, less those that are stored.
            F.expr("(sizes - n * size0) - (own - (size0 - up_size))").alias("saved_tokens"), "p", "q",
        )
        root = nodes.where("depth = 0 and n > 0").select(
            F.col("low").alias("conv_id"), "depth", F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"),
            F.col("ways").alias("n_children"), F.col("leaves").alias("n_leaves"), F.expr("sizes - own").alias("saved_tokens"), "p", "q",
        )
        return deep.union(root)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 per key over its chunks, which come sorted; one chunk is held at a time."""
    schema = pa.schema([("depth", pa.int64()), ("p", pa.int64()), ("q", pa.int64()), ("ends_sha256", pa.string())])
    key, running = None, hashlib.sha256()
    for batch in batches:
        done = []
        for depth, p, q, chunk in zip(*(batch.column(c).to_pylist() for c in ("depth", "p", "q", "ids")), strict=True):
            if (depth, p, q) != key:
                if key:
                    done.append((*key, running.hexdigest()))
                key, running = (depth, p, q), hashlib.sha256(chunk.encode())
            else:
                running.update(b"," + chunk.encode())
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True)) for row in done], schema)
    if key:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*key, running.hexdigest()), strict=True))], schema)


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, p, q, ends_sha256): SHA-256 of the ids that end at a prefix, ascending and comma-joined.

    Ids are joined in chunks of a bounded range of ids first, so that a group of equal
    conversations, however large, reaches the task that hashes it as few rows.
    """
    joined = ends.groupBy(*KEY, F.expr(f"conv_id div {IDS_PER_CHUNK} - cast(conv_id % {IDS_PER_CHUNK} < 0 as int)").alias("chunk")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids")
    )
    ordered = joined.repartition(*KEY).sortWithinPartitions(*KEY, "chunk")
    return ordered.select(*KEY, "ids").mapInArrow(_digests, "depth long, p long, q long, ends_sha256 string")


def build(turns: DataFrame, lengths: DataFrame, settings: Batches = Batches()) -> DataFrame:
    """The expanded trie of conversations with `lengths` (conv_id, n) and `turns` (conv_id, depth, digest, size, is_last)."""
    paths = prefixes(turns)
    zero = F.lit(0).cast("long")
    ends = paths.where("is_last").select("conv_id", *KEY).union(lengths.where("n = 0").select("conv_id", zero, zero, zero))
    ends = materialize(ends, "conversation-ends")
    # Equal conversations are looked up once.
    members = ends.where("depth > 0").groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"))
    members = materialize(members.select("conv_id", F.col("depth").alias("n"), F.pmod(F.xxhash64("conv_id"), F.lit(settings.first)).alias("draw")), "members")
    trie = ZFastTrie(turns.sparkSession, paths, settings)
    for batch in ("draw = 0", "draw > 0"):
        trie.insert(members.where(batch).select("conv_id", "n"))
    found = trie.expanded(trie.counted(ends))
    empty = hashlib.sha256(b"").hexdigest()
    told = found.join(end_digests(ends), KEY, "left")
    return told.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256")
    )


def conversation_trie(conversations: DataFrame, settings: Batches = Batches()) -> DataFrame:
    """The prefix trie of all conversations, each rebuilt from the first of its family (`rebuilt`).

    One row per distinct sequence of first turns: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens (code points that sharing saves in its subtree) and
    ends_sha256 (of the ids that end there).

    Null roles and texts are empty. A null turn comes before all others; rows of the same turn are
    ordered by the MD5 of role and text, and repeated rows are turns of their own. Rows without a
    conv_id belong to no conversation and are left out. Other columns are ignored. A table without
    conversations gives no rows, not even a root.
    """
    turns, lengths = rebuilt(conversations)
    return build(turns, lengths, settings)
