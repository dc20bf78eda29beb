"""Removal of passages that repeat across documents, with a count-min prefilter.

Two equal windows hold the same anchor: the smallest hash among the shorter word runs inside
them. So the count of a window's anchor is at least the window's own count, and one anchor
stands for several windows. A first pass counts anchors in count-min sketches, one part
per task, merged by cell range; a second pass hashes just the windows whose anchor is
estimated to occur twice or more, and groups those exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import WordHashes, blocks, inside, mix64, window_hashes
from rollcall.plans.scratch import materialize, scratch_path, temporary_tables

LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Windows:
    """`words` to a window, `run` words to an anchor run. The sketch has `rows` rows of
    `cells` cells per expected anchor, in parts of 2**part cells, one bit each once merged.
    Up to `broadcast_bytes` of it are broadcast; a larger one is joined to the anchors."""

    words: int = 20
    run: int = 10
    rows: int = 2
    cells: float = 8.0
    part: int = 20
    broadcast_bytes: int = 64 << 20
    flush: int = 1_000_000

    def parts(self, words: int) -> int:
        anchors = 2 * words / (self.words - self.run + 2) + 1
        return max(1, -(-int(anchors * self.cells) >> self.part))


def anchor_hashes(hashes: np.ndarray, starts: np.ndarray, spec: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts that lie within one text, the place of each window's anchor, run hashes."""
    valid = inside(starts, spec.words)
    runs = window_hashes(hashes, spec.run, seed=1)
    if not len(valid):
        return valid, valid, runs
    anchors, least = valid.copy(), runs[valid]
    for k in range(1, spec.words - spec.run + 1):
        here = runs[valid + k]
        lower = here < least
        anchors[lower], least[lower] = valid[lower] + k, here[lower]
    return valid, anchors, runs


def cells_of(anchors: np.ndarray, spec: Windows, parts: int) -> list[np.ndarray]:
    """The cell of each hash in every row of the sketch."""
    total = np.uint64(parts << spec.part)
    return [mix64(anchors + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))) % total for k in range(spec.rows)]


def _sketch(spec: Windows, parts: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Per task and cell range: the cells met once, and those met more often."""

    def flush(held: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        every = np.concatenate(held)
        for row, cells in enumerate(cells_of(every, spec, parts)):
            met, count = np.unique(cells, return_counts=True)
            where = (met >> np.uint64(spec.part)).astype(np.int64)
            low = (met & np.uint64((1 << spec.part) - 1)).astype(np.uint32)
            cuts = np.flatnonzero(np.diff(where)) + 1
            chunks = zip(np.split(low, cuts), np.split(count > 1, cuts), strict=True)
            yield pd.DataFrame(
                [(row, int(part), c[~m].tobytes(), c[m].tobytes()) for part, (c, m) in zip(where[np.r_[0, cuts]], chunks, strict=True)],
                columns=["row", "part", "once", "more"],
            )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, held, size = WordHashes(), [], 0
        for batch in batches:
            for texts in blocks(batch["text"]):
                hashes, starts = cache.of(texts)
                _, anchors, runs = anchor_hashes(hashes, starts, spec)
                if len(anchors):
                    held.append(runs[np.unique(anchors)])
                    size += len(held[-1])
                if size > spec.flush:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _merge(spec: Windows) -> Callable[[tuple, Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """One bit per cell of a range: met at least twice."""

    def run(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, again = (np.zeros(1 << spec.part, bool) for _ in range(2))
        for batch in batches:
            for once, more in zip(batch["once"], batch["more"], strict=True):
                cells = np.frombuffer(once, np.uint32)
                again[cells[seen[cells]]] = True
                seen[cells] = True
                cells = np.frombuffer(more, np.uint32)
                again[cells] = True
        yield pd.DataFrame([(*map(int, key), np.packbits(again).tobytes())], columns=["row", "part", "bits"])

    return run


def merged_sketch(texts: DataFrame, spec: Windows, parts: int) -> DataFrame:
    """(row, part, bits): the cells whose count is two or more, merged over all tasks."""
    partial = texts.select("text").mapInPandas(_sketch(spec, parts), "row int, part long, once binary, more binary")
    merged = partial.groupBy("row", "part").applyInPandas(_merge(spec), "row int, part long, bits binary")
    return materialize(merged, "sketch")


def _loaded(sketch: DataFrame, spec: Windows, parts: int) -> Broadcast:
    """The whole sketch, of a size that the caller has checked."""
    bits = np.zeros((spec.rows, parts << (spec.part - 3)), np.uint8)
    width = 1 << (spec.part - 3)
    for row, part, own in sketch.toLocalIterator():
        bits[row, part * width : (part + 1) * width] = np.frombuffer(own, np.uint8)
    return sketch.sparkSession.sparkContext.broadcast(bits)


def _windows(hashes: np.ndarray, at: np.ndarray, ids: np.ndarray, starts: np.ndarray, spec: Windows) -> pd.DataFrame:
    text = np.searchsorted(starts, at, side="right") - 1
    first, second = (window_hashes(hashes, spec.words, seed=s)[at].view(np.int64) for s in (2, 3))
    return _sorted_out(first, second, ids[text], (at - starts[text]).astype(np.int32))


def _sorted_out(h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, at: np.ndarray) -> pd.DataFrame:
    """Of equal windows of one block the earliest, and the places of the others.

    A document is in one block as a whole, so a window that is met in several rows of the
    result is in several blocks, and the smallest id tells the earliest.
    """
    order = np.lexsort((at, ids, h2, h1))
    h1, h2, ids, at = h1[order], h2[order], ids[order], at[order]
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(h1)), 0))
    later = (ids != ids[lead]) | (at != at[lead])
    keep = new | later
    frame = pd.DataFrame({"h1": h1, "h2": h2, "id": ids, "at": at, "later": later})[keep]
    frame.loc[frame["later"], ["h1", "h2"]] = 0
    return frame


def _repeated(spec: Windows, parts: int, sketch: Broadcast) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The windows that the sketch estimates to occur twice or more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, bits = WordHashes(), sketch.value
        for batch in batches:
            at = 0
            for texts in blocks(batch["text"]):
                hashes, starts = cache.of(texts)
                valid, anchors, runs = anchor_hashes(hashes, starts, spec)
                places, back = np.unique(anchors, return_inverse=True)
                hit = np.ones(len(places), bool)
                for row, cells in enumerate(cells_of(runs[places], spec, parts)):
                    hit &= (bits[row][cells >> np.uint64(3)] >> (7 - (cells & np.uint64(7))).astype(np.uint8) & 1).astype(bool)
                chosen = valid[hit[back]] if len(valid) else valid
                if len(chosen):
                    yield _windows(hashes, chosen, batch["id"].to_numpy()[at : at + len(texts)], starts, spec)
                at += len(texts)

    return run


def _anchors(spec: Windows, parts: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """(id, place, cell) of every anchor, for a sketch too large to broadcast; first row only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordHashes()
        for batch in batches:
            at = 0
            for texts in blocks(batch["text"]):
                hashes, starts = cache.of(texts)
                _, anchors, runs = anchor_hashes(hashes, starts, spec)
                places = np.unique(anchors)
                text = np.searchsorted(starts, places, side="right") - 1
                cells = cells_of(runs[places], spec, parts)[0].astype(np.int64)
                ids = batch["id"].to_numpy()[at : at + len(texts)]
                yield pd.DataFrame({"id": ids[text], "place": (places - starts[text]).astype(np.int32), "cell": cells})
                at += len(texts)

    return run


def _cells(spec: Windows) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, bits in zip(batch["part"], batch["bits"], strict=True):
                low = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8)))
                yield pd.DataFrame({"cell": low + (int(part) << spec.part)})

    return run


def _at_places(spec: Windows) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The windows of each text whose anchor is at one of the given places."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordHashes()
        for batch in batches:
            at = 0
            for texts in blocks(batch["text"]):
                hashes, starts = cache.of(texts)
                valid, anchors, _ = anchor_hashes(hashes, starts, spec)
                given = batch["places"].iloc[at : at + len(texts)]
                wanted = np.concatenate([np.asarray(p, np.int64) + s for p, s in zip(given, starts, strict=False)])
                chosen = valid[np.isin(anchors, wanted)]
                if len(chosen):
                    yield _windows(hashes, chosen, batch["id"].to_numpy()[at : at + len(texts)], starts, spec)
                at += len(texts)

    return run


def candidate_windows(texts: DataFrame, spec: Windows, words: int) -> DataFrame:
    """(h1, h2, id, at, later): every window that occurs twice or more, and a few that do not.

    `texts` is (id, text) with `words` words in all. h1 and h2 are two 64-bit hashes. `later`
    marks windows that begin earlier in the same block of texts; of them only the place is
    told, so a window has one row with its hashes for each block, however common it is.
    """
    parts = spec.parts(words)
    sketch = merged_sketch(texts, spec, parts)
    schema = "h1 long, h2 long, id long, at int, later boolean"
    if spec.rows * parts << (spec.part - 3) <= spec.broadcast_bytes:
        return texts.mapInPandas(_repeated(spec, parts, _loaded(sketch, spec, parts)), schema)
    again = sketch.where("row = 0").select("part", "bits").mapInPandas(_cells(spec), "cell long")
    found = texts.mapInPandas(_anchors(spec, parts), "id long, place int, cell long")
    places = found.join(again, "cell").groupBy("id").agg(F.collect_list("place").alias("places"))
    return texts.join(places, "id").mapInPandas(_at_places(spec), schema)


def _kept(spec: Windows) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, places, copy in zip(batch["text"], batch["places"], batch["copy"], strict=True):
                words = [] if text is None else text.encode("utf-8", "surrogatepass").split()
                n = len(words)
                if copy and n >= spec.words:
                    words = []
                elif places is not None and len(places):
                    at = np.asarray(places)
                    at = at[at + spec.words <= n]
                    edges = np.zeros(n + 1, np.int64)
                    np.add.at(edges, at, 1)
                    np.add.at(edges, at + spec.words, -1)
                    covered = np.cumsum(edges)[:n] > 0
                    words = [w for w, gone in zip(words, covered, strict=True) if not gone]
                kept = b" ".join(words)
                rows.append((n, n - len(words), kept.decode("utf-8", "surrogatepass"), hashlib.sha256(kept).hexdigest()))
            own = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_text", "kept_sha256"])
            yield pd.concat([batch[["doc_id"]].reset_index(drop=True), own], axis=1)

    return run


def marked_texts(rows: DataFrame, spec: Windows) -> DataFrame:
    """(id, places, copy) of the texts that lose words: the starts of their windows that begin
    earlier elsewhere, or that the whole text is a copy. `rows` is (id, text)."""
    normal = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    size = F.when(normal == "", 0).otherwise(F.length(normal) - F.length(F.replace(normal, F.lit(" "))) + 1)
    seen = materialize(
        rows.select("id", F.unhex(F.sha2(normal.cast("binary"), 256)).alias("same"), size.cast("long").alias("n")),
        "word-digests",
    )
    first = seen.groupBy("same").agg(F.min("id").alias("_first"))
    mixed = seen.groupBy("id").agg(F.min("same").alias("_low"), F.max("same").alias("_high")).where("_low != _high")
    later_ids = seen.join(first, "same").where("id > _first").select("id").distinct()
    copies = materialize(later_ids.join(mixed, "id", "left_anti"), "copies")
    total = seen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    texts = rows.select("id", "text").join(copies, "id", "left_anti")
    windows = materialize(candidate_windows(texts, spec, total), "windows")
    met = windows.where(~F.col("later")).select("h1", "h2", "id", "at")
    firsts = met.groupBy("h1", "h2").agg(F.min("id").alias("_first"), F.max("id").alias("_last"))
    firsts = firsts.where("_first < _last").drop("_last")
    elsewhere = met.join(firsts, ["h1", "h2"]).where("id > _first").select("id", "at")
    later = windows.where("later").select("id", "at").union(elsewhere)
    places = later.groupBy("id").agg(F.collect_set("at").alias("places"))
    return places.withColumn("copy", F.lit(False)).unionByName(
        copies.withColumn("copy", F.lit(True)), allowMissingColumns=True
    )


def remove_repeats(documents: DataFrame, spec: Windows = Windows()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, kept_sha256 per input row.

    Words covered by a window of `spec.words` words that starts earlier (smaller doc_id, or
    same document and earlier) are removed. Windows are judged on the input. A null text has
    no words. Rows without an id are one document with the largest id. Rows that repeat an id
    are one document, so a window at the same place in both is not earlier in either; if their
    texts differ, a place found in one of them counts in the others as well. Other columns are
    ignored. An empty table gives no rows.

    Texts with equal words are copies: all of a later copy is removed if it is as long as a
    window, so only the first takes part in the search.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    rows = documents.select("doc_id", key.alias("id"), "text")
    path = scratch_path(documents.sparkSession, "places")
    with temporary_tables(documents.sparkSession):  # the windows are large and done with
        marked_texts(rows, spec).write.parquet(path)
    marked = documents.sparkSession.read.parquet(path)
    joined = rows.join(marked, "id", "left").select("doc_id", "text", "places", F.coalesce("copy", F.lit(False)).alias("copy"))
    schema = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"
    return joined.mapInPandas(_kept(spec), schema)
