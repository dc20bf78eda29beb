"""The three-key merge as a set-based job.

Writes are applied in the order of `seq`. Each has a primary key, which is its phone
key, or else its batch and file, or none; and it may have an email. At most one stored
row owns a primary key and at most one owns an email.

    owner of the primary key   owner of the email     result
    none                       none                   a new row
    none                       a row                  that row is overwritten
    a row                      none or the same row   that row is overwritten
    a row                      another row            the write is rejected

Overwriting replaces every column but `id` and `created_at`, nulls included, so a row
always carries the keys of the last write it accepted.

How it is computed without replaying the writes one by one:

*   Only a write whose email also appears with another primary key can be rejected. All
    writes not connected to such an email follow "last write wins" per key, which is
    one aggregation of two numbers.
*   For the others, assume that all are accepted. Given which writes are accepted, the
    owners a write meets follow from its neighbours: the last accepted write j on the
    key still owns it unless an accepted write on j's other key came in between. That
    gives a new set of accepted writes; repeat until it no longer changes. A write
    depends on earlier writes only, so there is exactly one such set and every round
    settles at least the next write of each group. Usually two or three rounds do, and
    groups that are settled leave the rounds that others still need.
*   The history of a row is a chain of accepted writes. Runs on one key are shortened
    to their first write by a scan, the few links that remain by pointer doubling.

No group is ever collected: aggregations combine before the shuffle, and ordered scans and
lookups cut every key into blocks of a bounded number of positions. Only keys and positions
travel until the last write of each row is known.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.phones import normalize_phone
from rollcall.operators.key_index import KeyIndex, email_key
from rollcall.plans.scan import BLOCK_ROWS, flag_keys, nearest
from rollcall.plans.scratch import materialize
from rollcall.schemas import WRITTEN_COLUMNS

# Stored rows come before all writes: they get positions below zero.
STORED = -(1 << 62)

# After this many rounds, and twice as many each time, groups that are settled leave.
SPLIT_AFTER = 2


@dataclass
class MergeResult:
    """What a merge did; the frames join written tables with the incoming rows."""

    rows: DataFrame  # new and overwritten rows, `is_update` tells which
    outcomes: DataFrame  # seq, strategy, action: insert, update or reject
    rejected: DataFrame  # the writes that met two different rows
    touched: DataFrame  # the stored rows that shared a key with a write, as (id, k, e, created_at)


def batch_file_key(batch_id: Column, source_file: Column) -> Column:
    """The length in front keeps different pairs from giving the same text."""
    return F.concat(F.lit("b:"), F.length(batch_id).cast("string"), F.lit(":"), batch_id, source_file)


def primary_key(phone_normalized: Column, batch_id: Column, source_file: Column) -> Column:
    phone_key = F.concat(F.lit("p:"), phone_normalized)
    return F.coalesce(phone_key, batch_file_key(batch_id, source_file))


def clean_writes(incoming: DataFrame) -> DataFrame:
    """Derive the phone key and treat an empty email or batch id as none."""
    return (
        incoming.withColumn("phone_normalized", normalize_phone(F.col("phone")))
        .withColumn("email", F.nullif(F.col("email"), F.lit("")))
        .withColumn("batch_id", F.nullif(F.col("batch_id"), F.lit("")))
    )


def strategy(phone_normalized: Column, batch_id: Column) -> Column:
    return (
        F.when(phone_normalized.isNotNull(), "phone")
        .when(batch_id.isNotNull(), "batch_file")
        .otherwise("plain")
    )


def merge(
    stored: DataFrame,
    incoming: DataFrame,
    now: Column,
    block_rows: int = BLOCK_ROWS,
    split_after: int = SPLIT_AFTER,
    index: KeyIndex | None = None,
    version: int = 0,
) -> MergeResult:
    """Apply `incoming`, ordered by its unique `seq` of 0 and up, to `stored`.

    With an `index` of the stored keys as of `version`, the stored rows are not read.

    Rows of `stored` that no write touches are not in the result. A new row's id is
    the largest stored id plus one plus the `seq` of its first write: unique, in the
    order of the writes, with gaps where writes updated rows, and the same on a re-run.
    """
    writes = clean_writes(incoming)
    narrow = writes.select(
        "seq",
        primary_key(F.col("phone_normalized"), F.col("batch_id"), F.col("source_file")).alias("k"),
        F.col("email").alias("e"),
        strategy(F.col("phone_normalized"), F.col("batch_id")).alias("strategy"),
    )
    narrow = materialize(narrow, "writes")
    touched = materialize(_touched(stored, narrow) if index is None else _held(index, narrow, version), "touched")
    events = materialize(_events(touched, narrow, block_rows), "events")

    contested = events.where("contested")
    last_block = contested.agg(F.max("block")).first()[0]
    if last_block is None:
        final, rejects, moved = _uncontested(events), None, None
    else:
        blocked = last_block > 0
        settled = _settle(contested, blocked, split_after)
        chains = materialize(_chains(settled, blocked), "chains")
        final = _uncontested(events.where("not contested")).unionByName(_owners(chains))
        rejects = settled.where("not accepted").select(F.col("ord").alias("seq"))
        moved = chains.where("accepted and ord >= 0").select(
            F.col("ord").alias("seq"), F.col("via").alias("via")
        )
    final = materialize(final, "owners")
    outcomes = _outcomes(narrow, final, rejects, moved)
    return MergeResult(
        rows=_written_rows(stored, touched, writes, final, now, None if index is None else index.largest(version)),
        outcomes=outcomes,
        rejected=writes.join(
            outcomes.where("action = 'reject'").select("seq"), "seq", "left_semi"
        ),
        touched=touched.select((F.col("ord") - F.lit(STORED)).alias("id"), "k", "e", "created_at"),
    )


def keys_of(rows: DataFrame) -> DataFrame:
    """(id, k, e, created_at) of stored rows, as the index holds them."""
    key = primary_key(F.col("phone_normalized"), F.col("batch_id"), F.col("source_file"))
    return rows.select("id", key.alias("k"), F.col("email").alias("e"), "created_at")


def freed_keys(result: MergeResult) -> DataFrame:
    """Keys that rows overwritten by the merge held before it."""
    updated = result.touched.join(result.rows.where("is_update").select("id"), "id", "left_semi")
    return updated.select(F.explode(F.array("k", email_key())).alias("key")).where("key is not null").distinct()


def next_snapshot(stored: DataFrame, result: MergeResult) -> DataFrame:
    """The whole table after the merge."""
    replaced = result.rows.where("is_update").select("id")
    untouched = stored.join(replaced, "id", "left_anti")
    return untouched.unionByName(result.rows.drop("is_update"), allowMissingColumns=True)


def _touched(stored: DataFrame, narrow: DataFrame) -> DataFrame:
    """The stored rows the writes can meet, as (ord, k, e, created_at)."""
    kept = stored.select(
        (F.lit(STORED) + F.col("id")).alias("ord"),
        primary_key(F.col("phone_normalized"), F.col("batch_id"), F.col("source_file")).alias("k"),
        F.col("email").alias("e"),
        "created_at",
    )
    keys = narrow.where("k is not null").select("k").distinct()
    emails = narrow.where("e is not null").select("e").distinct()
    # A stored row changes keys only through a write on one of them, so one hop is
    # enough. Stored keys are unique: neither join can be skewed.
    by_key = kept.join(keys, "k", "left_semi")
    return by_key.unionByName(kept.join(emails, "e", "left_semi")).distinct()


def _held(index: KeyIndex, narrow: DataFrame, version: int) -> DataFrame:
    """The same from the index."""
    keys = narrow.select(F.explode(F.array("k", email_key())).alias("key")).where("key is not null")
    found = index.holders(keys, version)
    return found.select((F.lit(STORED) + F.col("id")).alias("ord"), "k", "e", "created_at")


def _events(touched: DataFrame, narrow: DataFrame, block_rows: int) -> DataFrame:
    """Stored rows and writes in one order, as (ord, k, e, block, contested).

    Stored rows lie in the first block; a key has one of them at most.
    """
    writes = narrow.select(F.col("seq").alias("ord"), "k", "e")
    block = F.expr(f"greatest(ord, 0L) div {block_rows}")
    events = touched.select("ord", "k", "e").unionByName(writes).withColumn("block", block)
    events = materialize(events, "ordered")
    keys = F.coalesce("k", F.lit(""))
    marked = materialize(
        flag_keys(events, "e", "block", "shared", keys, lambda low, high: low != high), "marked"
    )
    fought = flag_keys(marked, "k", "block", "fought", F.col("shared"), lambda low, high: high)
    return fought.withColumn("contested", F.col("shared") | F.col("fought")).drop("shared", "fought")


def _uncontested(events: DataFrame) -> DataFrame:
    """Last write wins; the first event of the key decides which row it is."""
    alone = F.concat(F.lit("n:"), F.col("ord").cast("string"))
    owner = F.coalesce(F.col("k"), F.concat(F.lit("e:"), F.col("e")), alone)
    return (
        events.groupBy(owner.alias("owner"))
        .agg(F.min("ord").alias("root"), F.max("ord").alias("last"))
        .select("root", "last")
    )


def _scan(df: DataFrame, side: str, blocked: bool, **columns) -> DataFrame:
    """One ordered scan by primary key ("k") or email ("e")."""
    if blocked:
        df = materialize(df, "scan")
    return nearest(df, side, "ord", "block" if blocked else None, **columns)


def _settle(contested: DataFrame, blocked: bool, split_after: int) -> DataFrame:
    """Find which contested events are accepted; adds the owners each one meets."""
    closed = []
    rounds = 0
    # A missing key never meets another: give each its own.
    alone = F.concat(F.lit("n:"), F.col("ord").cast("string"))
    state = contested.select(
        "ord",
        F.coalesce("k", alone).alias("k"),
        F.coalesce("e", alone).alias("e"),
        "block",
        F.lit(True).alias("accepted"),
    )
    own = F.when(F.col("accepted"), F.struct("ord"))
    state = materialize(_scan(state, "e", blocked, after={"e_next": own}), "round")
    while True:
        # By primary key: the accepted write before this one, and whether a write on
        # that one's email has taken its row elsewhere by now.
        owner = F.when(F.col("accepted"), F.struct("ord", F.col("e_next.ord").alias("gone")))
        state = _scan(state, "k", blocked, before={"k_owner": owner}, after={"k_next": own})
        # By email: the same, the other way round.
        owner = F.when(F.col("accepted"), F.struct("ord", F.col("k_next.ord").alias("gone")))
        state = _scan(state, "e", blocked, before={"e_owner": owner})
        k_taken, e_taken = _still("k_owner"), _still("e_owner")
        verdict = ~(k_taken & e_taken & (F.col("k_owner.ord") != F.col("e_owner.ord")))
        state = (
            state.withColumn("k_taken", k_taken)
            .withColumn("e_taken", e_taken)
            .withColumn("verdict", verdict)
            .drop("e_next")
        )
        next_own = F.when(F.col("verdict"), F.struct("ord"))
        state = materialize(_scan(state, "e", blocked, after={"e_next": next_own}), "round")
        changed = state.where("accepted <> verdict")
        if changed.isEmpty():
            return reduce(DataFrame.unionByName, closed, state)
        rounds += 1
        if rounds == split_after:
            split_after *= 2
            parts = _split(state, hops=2 * rounds)
            if parts:
                closed.append(parts[0])
                state = parts[1]
        state = state.withColumn("accepted", F.col("verdict")).drop(
            "verdict", "k_owner", "k_next", "e_owner", "k_taken", "e_taken"
        )


def _split(state: DataFrame, hops: int) -> tuple[DataFrame, DataFrame] | None:
    """(settled, open) events, or None where most are open or not found in so many hops.

    Events that share a key, directly or through others, form a group. A group in which
    nothing changed is settled. The open ones are reached from the changes key by key.
    """
    changed = (F.col("accepted") != F.col("verdict")).alias("open")
    reached = materialize(state.select("ord", "k", "e", "block", changed), "reached")
    size = 0
    for _ in range(hops):
        total, grown = reached.agg(F.count("*"), F.count_if("open")).first()
        if grown * 2 >= total:
            return None
        if grown == size:
            still_open = reached.where("open").select("ord")
            return (
                materialize(state.join(still_open, "ord", "left_anti"), "settled"),
                materialize(state.join(still_open, "ord", "left_semi"), "open"),
            )
        size = grown
        for side in ("k", "e"):
            found = flag_keys(reached, side, "block", "found", F.col("open"), lambda low, high: high)
            reached = materialize(found.drop("open").withColumnRenamed("found", "open"), "reached")
    return None


def _still(owner: str) -> Column:
    """The previous owner is there and nothing took its row away before this event."""
    gone = F.col(f"{owner}.gone")
    return F.col(owner).isNotNull() & (gone.isNull() | (gone >= F.col("ord")))


def _chains(settled: DataFrame, blocked: bool) -> DataFrame:
    """Per accepted event, how it reached its row, the run it is in, and if it is last."""
    via = F.when(F.col("k_taken"), "k").when(F.col("e_taken"), "e").otherwise("new")
    chains = settled.withColumn("via", via).withColumn(
        "is_last",
        F.col("accepted") & F.col("k_next").isNull() & F.col("e_next").isNull(),
    )
    # Events that found their row by primary key continue the run on that key.
    head = F.when(F.col("accepted") & (F.col("via") != "k"), F.struct("ord"))
    chains = _scan(chains, "k", blocked, before={"run": head}, inclusive=True)
    # A run that starts with a row found by email continues that row's run. Several
    # such steps in a row on one email lead to the last event not found that way.
    came_from = F.when(
        F.col("accepted") & (F.col("via") != "e"),
        F.struct("ord", F.col("run.ord").alias("run")),
    )
    chains = _scan(chains, "e", blocked, before={"origin": came_from})
    return chains.select(
        "ord",
        "accepted",
        "via",
        "is_last",
        F.col("run.ord").alias("run"),
        F.col("origin.run").alias("origin"),
    )


def _owners(chains: DataFrame) -> DataFrame:
    """(first event, last event) of every row the contested events leave behind."""
    last = chains.where("is_last").select(F.col("ord").alias("last"), "run")
    links = chains.where("accepted and via = 'e'").select("ord", "origin")
    # Only links that a run or another link leads to are needed. Rows do not share
    # writes, so no two of these have the same origin and the joins cannot be skewed.
    wanted = last.select(F.col("run").alias("ord")).unionByName(
        links.select(F.col("origin").alias("ord")).distinct()
    )
    links = materialize(links.join(wanted.distinct(), "ord", "left_semi"), "links")
    while not links.isEmpty():
        further = links.select(F.col("ord").alias("origin"), F.col("origin").alias("beyond"))
        stepped = links.join(further, "origin", "left")
        if stepped.where("beyond is not null").isEmpty():
            break
        links = materialize(
            stepped.select("ord", F.coalesce("beyond", "origin").alias("origin")), "links"
        )
    return last.join(links, last.run == links.ord, "left").select(
        F.coalesce("origin", "run").alias("root"), "last"
    )


def _outcomes(
    narrow: DataFrame,
    final: DataFrame,
    rejects: DataFrame | None,
    moved: DataFrame | None,
) -> DataFrame:
    """One row per write. All joins are on `seq`, which is unique."""
    inserted = final.where("root >= 0").select(
        F.col("root").alias("seq"), F.lit(True).alias("is_root")
    )
    by_email = F.col("k").isNull() & F.col("e").isNotNull()
    found_by_email = F.when(by_email & F.col("is_root").isNull(), F.lit("e"))
    joined = narrow.join(inserted, "seq", "left")
    if rejects is None:
        joined = joined.withColumn("refused", F.lit(False)).withColumn("via", found_by_email)
    else:
        joined = (
            joined.join(rejects.withColumn("refused", F.lit(True)), "seq", "left")
            .join(moved.withColumnRenamed("via", "via_contested"), "seq", "left")
            .withColumn("via", F.coalesce("via_contested", found_by_email))
        )
    action = (
        F.when(F.col("refused"), "reject")
        .when(F.coalesce(F.col("is_root"), F.col("via") == "new", F.lit(False)), "insert")
        .otherwise("update")
    )
    named = (
        F.when(action == "reject", "conflict")
        .when(F.col("via") == "e", "email")
        .otherwise(F.col("strategy"))
    )
    return joined.select("seq", named.alias("strategy"), action.alias("action"))


def _written_rows(
    stored: DataFrame, touched: DataFrame, writes: DataFrame, final: DataFrame, now: Column, known_largest: int | None = None
) -> DataFrame:
    """Payload of the last write of every row that any write reached."""
    changed = final.where("last >= 0").select(
        F.col("last").alias("seq"),
        F.col("root"),
        F.when(F.col("root") < 0, F.col("root") - F.lit(STORED)).alias("old_id"),
    )
    if known_largest is None:
        largest = stored.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("largest")).scalar()
    else:
        largest = F.lit(known_largest)
    known = touched.select(
        (F.col("ord") - F.lit(STORED)).alias("old_id"), F.col("created_at").alias("old_created")
    )
    kept = [c for c in WRITTEN_COLUMNS if c in writes.columns]
    # Both sides of these joins are unique on their key.
    placed = changed.join(known, "old_id", "left")
    return writes.join(placed, "seq").select(
        F.coalesce(F.col("old_id"), largest + 1 + F.col("root")).alias("id"),
        *kept,
        F.when(F.col("old_id").isNotNull(), F.col("old_created")).otherwise(now).alias("created_at"),
        F.col("old_id").isNotNull().alias("is_update"),
    )
