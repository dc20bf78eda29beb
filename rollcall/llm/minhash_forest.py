"""Near-duplicate documents by an LSH forest of MinHash signatures.

Every tree is one sorted order: its rows are the documents' sequences of MinHash values,
dealt by range and sorted. Candidates are the neighbours of a row that share a prefix with
it. A region, the rows of a tree that share the least prefix, may hold more rows than a window
of neighbours spans: the documents of such a region that the links so far leave apart go
through an exact join of their shingle sets. Candidates are confirmed on their full shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import WordHashes, blocks, inside, mix64, window_hashes
from rollcall.llm.components import components
from rollcall.llm.set_join import close_pairs
from rollcall.plans.scan import flag_keys
from rollcall.plans.scratch import materialize

REGION_BLOCKS = 256
# Rows without an id take part under numbers of their own, from here on.
NUMBERED = 1 << 62


@dataclass(frozen=True)
class Forest:
    """A pair of similarity s shares a prefix of `shallowest` values in one tree of
    `trees` with probability 1 - (1 - s**shallowest)**trees: 0.9999998 at 0.85 with the
    defaults. `neighbours` earlier rows are compared with each row of a tree; regions of more
    rows than these and the row itself go through the exact join."""

    words: int = 5
    threshold: int = 85
    trees: int = 16
    depth: int = 8
    shallowest: int = 3
    neighbours: int = 4
    first_trees: int = 4


def shingle_sets(texts: list[bytes], words: int, cache: WordHashes) -> list[np.ndarray]:
    """Sorted distinct shingle hashes per text; a short text is one shingle, an empty one none."""
    hashes, starts = cache.of([data.lower() for data in texts])  # of bytes: A-Z only
    every = window_hashes(hashes, words)
    valid = inside(starts, words)
    bounds = np.searchsorted(valid, starts)
    shingles = every[valid]
    found = []
    for i in range(len(texts)):
        if bounds[i] < bounds[i + 1]:
            found.append(np.unique(shingles[bounds[i] : bounds[i + 1]]))
        elif starts[i] < starts[i + 1]:
            own = hashes[starts[i] : starts[i + 1]]
            found.append(window_hashes(own, len(own), seed=len(own)))
        else:
            found.append(np.empty(0, np.uint64))
    return found


def signatures(sets: list[np.ndarray], size: int) -> list[bytes]:
    """`size` MinHash values per set, as big-endian 32-bit numbers so that bytes sort alike."""
    full = [i for i, s in enumerate(sets) if len(s)]
    result = [b""] * len(sets)
    if not full:
        return result
    joined = np.concatenate([sets[i] for i in full])
    starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
    draws = mix64(np.arange(1, 2 * size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    values = np.empty((size, len(full)), ">u4")
    for k in range(size):
        scrambled = (joined ^ draws[2 * k]) * (draws[2 * k + 1] | np.uint64(1))
        values[k] = np.minimum.reduceat(scrambled >> np.uint64(32), starts)
    for column, i in enumerate(full):
        result[i] = values[:, column].tobytes()
    return result


def _sign(forest: Forest) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordHashes()
        for batch in batches:
            at = 0
            for texts in blocks(batch["text"]):
                sets = shingle_sets(texts, forest.words, cache)
                yield pd.DataFrame(
                    {
                        "doc_id": batch["doc_id"].iloc[at : at + len(texts)].astype("Int64").array,
                        "key": batch["key"].iloc[at : at + len(texts)].array,
                        "set_id": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                        "n_shingles": [len(s) for s in sets],
                        "signature": signatures(sets, forest.trees * forest.depth),
                    }
                )
                at += len(texts)

    return run


def _pack(words: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordHashes()
        for batch in batches:
            at = 0
            for texts in blocks(batch["text"]):
                sets = shingle_sets(texts, words, cache)
                ids = batch["key"].iloc[at : at + len(texts)].array
                yield pd.DataFrame({"id": ids, "shingles": [s.tobytes() for s in sets]})
                at += len(texts)

    return run


class Crowds:
    """The rows of regions with more than `most` rows, of one sorted partition that comes in batches. The
    regions at its ends may go on in other partitions, so their rows are always told."""

    def __init__(self, most: int, shallow: int):
        self.most, self.shallow = most, shallow
        self.name: int | None = None  # of the region that the last row is in
        self.waiting: list[int] = []  # its rows that are not told yet
        self.count, self.first = 0, True

    def _named(self, tree: int, prefix: bytes) -> int:
        return xxhash.xxh3_64_intdigest(b"%d:" % tree + prefix[: self.shallow]) - (1 << 63)

    def _extend(self, name: int, ids: np.ndarray, told: list[tuple[np.ndarray, int]]) -> None:
        if name != self.name:
            self.first = self.name is None
            self.name, self.waiting, self.count = name, [], 0
        self.count += len(ids)
        self.waiting += ids.tolist()
        if self.first or self.count > self.most:
            told.append((np.array(self.waiting, np.int64), name))
            self.waiting = []

    def feed(self, rows: pd.DataFrame) -> pd.DataFrame:
        trees, ids, prefixes = rows["tree"].to_numpy(), rows["id"].to_numpy(), rows["prefix"]
        keys = np.frombuffer(b"".join(p[: self.shallow] for p in prefixes), np.uint32).reshape(len(rows), -1)
        begins = np.concatenate([[0], np.flatnonzero((trees[1:] != trees[:-1]) | (keys[1:] != keys[:-1]).any(axis=1)) + 1])
        ends = np.append(begins[1:], len(rows))
        told: list[tuple[np.ndarray, int]] = []
        # Regions inside the batch are whole; the first may go on from the batch before, the last into the next.
        wanted = (ends - begins > self.most) | (begins == 0) | (ends == len(rows))
        for a, b in zip(begins[wanted].tolist(), ends[wanted].tolist(), strict=True):
            self._extend(self._named(trees[a], prefixes.iloc[a]), ids[a:b], told)
        return self._frame(told)

    def rest(self) -> pd.DataFrame:
        return self._frame([(np.array(self.waiting, np.int64), self.name)] if self.waiting else [])

    @staticmethod
    def _frame(told: list[tuple[np.ndarray, int]]) -> pd.DataFrame:
        ids = np.concatenate([np.empty(0, np.int64), *[own for own, _ in told]])
        return pd.DataFrame({"a": ids, "region": np.repeat(np.array([n for _, n in told], np.int64), [len(own) for own, _ in told])})


def _neighbours(forest: Forest) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Pairs of close rows of one sorted partition, its first and last rows as they are, and the rows
    of crowded regions."""

    def pairs(rows: pd.DataFrame, fresh: int) -> Iterator[pd.DataFrame]:
        n = len(rows)
        keys = np.frombuffer(b"".join(rows["prefix"]), ">u4").reshape(n, forest.depth)
        trees, ids, sizes = (rows[c].to_numpy() for c in ("tree", "id", "n_shingles"))
        for lag in range(1, min(forest.neighbours, n - 1) + 1):
            near = (trees[lag:] == trees[:-lag]) & (
                keys[lag:, : forest.shallowest] == keys[:-lag, : forest.shallowest]
            ).all(axis=1)
            small, large = np.minimum(sizes[lag:], sizes[:-lag]), np.maximum(sizes[lag:], sizes[:-lag])
            near &= (100 * small >= forest.threshold * large) & (ids[lag:] != ids[:-lag])
            near[: max(0, n - fresh - lag)] = False  # both rows were in the batch before
            at = np.flatnonzero(near)
            a, b = np.minimum(ids[at], ids[at + lag]), np.maximum(ids[at], ids[at + lag])
            early = (trees[at] < forest.first_trees) & (lag == 1)
            yield pd.DataFrame({"a": a, "b": b, "early": early})

    def border(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.rename(columns={"id": "a"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["a", "b", "early", "tree", "prefix", "n_shingles", "region"]
        w, seen, last = forest.neighbours, 0, None
        crowds = Crowds(w + 1, 4 * forest.shallowest)
        for batch in batches:
            if not len(batch):
                continue
            if seen < w:
                yield border(batch.iloc[: w - seen]).reindex(columns=columns)
            seen += len(batch)
            rows = batch if last is None else pd.concat([last, batch], ignore_index=True)
            for found in pairs(rows, len(batch)):
                yield found.reindex(columns=columns)
            last = rows.iloc[-w:]
            yield crowds.feed(batch).reindex(columns=columns)
        if last is not None:
            yield border(last).reindex(columns=columns)
            yield crowds.rest().reindex(columns=columns)

    return run


def candidates(signed: DataFrame, forest: Forest) -> tuple[DataFrame, DataFrame]:
    """(a, b, early): neighbours in a sorted order; and (region, id): the rows of regions that a window
    does not span, and of a few others. `signed` is (id, n_shingles, signature).

    Rows are dealt by range over tree, prefix and id, so a crowded region is divided among
    tasks whatever its size. The few rows at the ends of each partition go through once more
    together, so that neighbours on two sides of a border meet.
    """
    width = 4 * forest.depth
    tree = F.explode(F.sequence(F.lit(0), F.lit(forest.trees - 1))).alias("tree")
    rows = signed.select("id", "n_shingles", "signature", tree).select(
        "tree", F.expr(f"substring(signature, tree * {width} + 1, {width})").alias("prefix"), "id", "n_shingles"
    )
    order = ["tree", "prefix", "id"]
    schema = "a long, b long, early boolean, tree int, prefix binary, n_shingles long, region long"
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    found = materialize(sorted_rows.mapInPandas(_neighbours(forest), schema), "neighbours")
    ends = found.where("b is null and region is null").select("tree", "prefix", F.col("a").alias("id"), "n_shingles")
    met = ends.distinct().coalesce(1).sortWithinPartitions(*order).mapInPandas(_neighbours(forest), schema)
    pairs = found.union(met).where("b is not null")
    crowds = found.where("region is not null").select("region", F.col("a").alias("id"))
    return pairs.groupBy("a", "b").agg(F.max("early").alias("early")), crowds


def crowded(crowds: DataFrame, linked: DataFrame) -> DataFrame:
    """(id, component): documents of crowded regions that `linked` (id, component_id) does not connect.

    The rows of a region are dealt by a hash of theirs, as a third of all documents may be in one.
    """
    told = crowds.distinct().join(linked, "id", "left").select("region", "id", F.coalesce("component_id", "id").alias("component"))
    told = materialize(told.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(REGION_BLOCKS))), "crowds")
    several = flag_keys(told, "region", "block", "several", F.col("component"), lambda low, high: low < high)
    return several.where("several").select("id", "component").distinct()


def _confirm(threshold: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            linked = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(p) + len(q) - len(np.union1d(p, q))
                linked.append(100 * common >= threshold * (len(p) + len(q) - common) and common > 0)
            yield batch.loc[linked, ["a", "b"]]

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets are as similar as asked for."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return both.mapInPandas(_confirm(threshold), "a long, b long")


def row_key(doc_id: Column, text: Column) -> Column:
    """The id of a row, or for rows without one a number from NUMBERED on, the same for equal texts."""
    own = F.xxhash64(text).bitwiseAND(F.lit(NUMBERED - 1)).bitwiseOR(F.lit(NUMBERED))
    return F.coalesce(doc_id.cast("long"), own)


def components_of(documents: DataFrame, forest: Forest) -> DataFrame:
    """(doc_id, key, n_shingles, component) per row of (doc_id, text); see `near_duplicates`."""
    ids_and_texts = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("key"), "text"
    )
    signed = materialize(
        ids_and_texts.mapInPandas(
            _sign(forest), "doc_id long, key long, set_id binary, n_shingles long, signature binary"
        ),
        "signatures",
    )
    classes = (
        signed.where("n_shingles > 0")
        .groupBy("set_id")
        .agg(F.min("key").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    )
    classes = materialize(classes, "classes")
    pairs, crowds = candidates(classes, forest)
    pairs = materialize(pairs, "candidates")
    involved = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    # By sort-merge at every size: the ids grow with the table, so they are never broadcast.
    texts = ids_and_texts.join(involved.hint("merge"), "key")
    sets = materialize(texts.mapInPandas(_pack(forest.words), "id long, shingles binary"), "sets")

    first = materialize(confirmed(pairs.where("early"), sets, forest.threshold), "links")
    joined = materialize(components(first), "components")
    of_a = joined.select(F.col("id").alias("a"), F.col("component_id").alias("_a"))
    of_b = joined.select(F.col("id").alias("b"), F.col("component_id").alias("_b"))
    apart = (
        pairs.where("not early")
        .join(of_a, "a", "left")
        .join(of_b, "b", "left")
        .where(F.coalesce("_a", "a") != F.coalesce("_b", "b"))
        .select("a", "b")
    )
    second = confirmed(apart, sets, forest.threshold)
    whole = materialize(components(first.union(second)), "components")

    rest = materialize(crowded(crowds, whole), "crowded")
    if not rest.isEmpty():
        crowd_texts = ids_and_texts.join(rest.select(F.col("id").alias("key")).hint("merge"), "key")
        crowd = materialize(crowd_texts.mapInPandas(_pack(forest.words), "id long, shingles binary"), "crowd-sets")
        close = materialize(close_pairs(crowd.join(rest, "id"), forest.threshold), "close-pairs")
        stars = whole.where("id <> component_id").select(F.col("component_id").alias("a"), F.col("id").alias("b"))
        whole = materialize(components(stars.union(confirmed(close, crowd, forest.threshold))), "components")

    named = classes.select("set_id", "id").join(whole, "id", "left").select(
        "set_id", F.coalesce("component_id", "id").alias("_component")
    )
    decided = signed.drop("signature").join(named, "set_id", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("_component")).otherwise(F.col("key"))
    return decided.select("doc_id", "key", "n_shingles", component.alias("component"))


def near_duplicates(documents: DataFrame, forest: Forest = Forest()) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents with equal sets count once on the way. Links are confirmed in rounds: close
    neighbours of the first trees, then whatever the components so far do not connect. Regions
    that a window does not span are completed by an exact join. A pair of lower similarity is
    never linked; one above the threshold is missed with the probability that Forest states,
    whatever stands between the two.

    A null or empty text, or one of blanks, has no shingle, is linked with nothing and is its own
    component. Rows without an id are linked like others: they are not kept if their component holds
    an id, and of a component without ids the rows of one text are kept, with a null component_id. Ids
    are taken to be below 2^62. Rows that repeat an id are one document with the links of all its
    texts. Other columns are ignored. An empty table gives no rows.
    """
    told = components_of(documents, forest)
    shown = F.when(F.col("doc_id").isNotNull() | (F.col("component") < NUMBERED), F.col("component"))
    return told.select("doc_id", "n_shingles", shown.alias("component_id"), (F.col("key") == F.col("component")).alias("kept"))


def keep_first(documents: DataFrame, forest: Forest = Forest()) -> DataFrame:
    """The rows, with all their columns, that `near_duplicates` keeps."""
    told = components_of(documents, forest)
    gone = materialize(told.where("key <> component").select("key").distinct(), "near-copies")
    rows = documents.select(
        F.struct(*[documents[f"`{c}`"] for c in documents.columns]).alias("row"), row_key(F.col("doc_id"), F.col("text")).alias("key")
    )
    kept = rows.join(gone, "key", "left_anti")
    return kept.select([F.col("row").getField(c).alias(c) for c in documents.columns])
