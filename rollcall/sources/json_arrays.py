"""Large JSON arrays, read by many tasks.

A JSON array has no place to split at that shows without what comes before it. Each block of bytes is
therefore scanned for every state that it may begin in: outside a string, inside, or after a backslash
inside. What a block does to each state is a few numbers; composed in order, they give the state and the
depth at which each block really begins. Then every block finds the elements that begin in it, and
reads on for the last one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.plans.scratch import exists, materialize
from rollcall.sources.files import RESULT
from rollcall.sources.paths import located

BLOCK_BYTES = 4 << 20
TASK_BLOCKS = 8
OUTSIDE, INSIDE, ESCAPED = 0, 1, 2
# By byte: whether it is blank, and how it changes the depth.
BLANK, STEP = np.zeros(256, bool), np.zeros(256, np.int8)
BLANK[list(b" \t\r\n")] = True
STEP[list(b"[{")], STEP[list(b"]}")] = 1, -1


def scan(data: np.ndarray, state: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Which bytes stand outside of strings, the change of depth up to and with each, and the last state."""
    n, inner = len(data), int(state != OUTSIDE)
    quote, slashes = data == 34, np.flatnonzero(data == 92)
    # Runs of backslashes; one more in the first if the block begins after one.
    firsts, lasts = slashes[np.diff(slashes, prepend=-2) > 1], slashes[np.diff(slashes, append=n + 1) > 1]
    runs = lasts - firsts + 1
    if state == ESCAPED and n:
        if data[0] == 92:
            runs[0] += 1
        else:
            quote[0] = False
    escaped = lasts[runs % 2 == 1] + 1
    quote[escaped[escaped < n]] = False
    # Quotes before each byte, modulo 256.
    inside = (np.cumsum(quote, dtype=np.uint8) - quote + inner) % 2 == 1
    plain = ~inside & ~quote
    if n:
        tail = int(runs[-1]) if len(runs) and lasts[-1] == n - 1 else 0
    else:
        tail = int(state == ESCAPED)
    ends_inside = (np.count_nonzero(quote) + inner) % 2
    return plain, np.cumsum(STEP[data] * plain, dtype=np.int64), (ESCAPED if tail % 2 else INSIDE) if ends_inside else OUTSIDE


class Blocks(NamedTuple):
    """Rows of (path, length, block), and over how many tasks they are dealt out."""

    rows: DataFrame
    tasks: int

    def count(self) -> int:
        return self.rows.count()


def _blocks(spark: SparkSession, path: str, size: int) -> Blocks:
    found = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {size}"))).alias("block")
    # Rows of a few bytes each: dealt out by their number, as by their size they would all be one task's.
    count = found.agg(F.sum(F.expr(f"(length - 1) div {size} + 1"))).first()[0] or 0
    tasks = max(1, -(-count // TASK_BLOCKS))
    return Blocks(found.select("path", "length", block).repartition(tasks, "path", "block"), tasks)


def _read(path: str, offset: int, size: int) -> np.ndarray:
    system, place = located(path)
    with system.open_input_file(place) as file:
        file.seek(offset)
        return np.frombuffer(file.read(size), np.uint8)


def _summaries(size: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, block in zip(frame["path"], frame["block"], strict=True):
                data = _read(path, block * size, size)
                told = []
                for state in (OUTSIDE, INSIDE, ESCAPED):
                    _, depth, end = scan(data, state)
                    told += [end, int(depth[-1]) if len(depth) else 0]
                rows.append((path, block, told))
            yield pd.DataFrame(rows, columns=["path", "block", "told"])

    return run


def _composed(rows: pd.DataFrame) -> pd.DataFrame:
    """State and depth at which each block of a file begins, and with block -1 those at its end."""
    state, depth, found = OUTSIDE, 0, []
    for path, block, told in rows.sort_values("block")[["path", "block", "told"]].itertuples(index=False):
        found.append((path, block, state, depth))
        state, depth = told[2 * state], depth + told[2 * state + 1]
    found.append((path, -1, state, depth))
    return pd.DataFrame(found, columns=["path", "block", "state", "depth"])


def _elements(size: int):
    """(path, at, text) of the elements that begin in a block; a null text where something is wrong."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, block, length, state, depth in frame[["path", "block", "length", "state", "depth"]].itertuples(index=False):
                yield pd.DataFrame(_of_block(path, block * size, length, state, depth, size), columns=["path", "at", "text"])

    return run


def _of_block(path: str, offset: int, length: int, state: int, depth: int, size: int) -> list[tuple]:
    data = _read(path, offset, size)
    plain, steps, end = scan(data, state)
    level = depth + steps
    before = np.concatenate([[depth], level[:-1]])
    opens = plain & (data == 91) & (before == 0)
    commas = plain & (data == 44) & (level == 1) & (before == 1)
    closes = plain & (level == 0) & (before == 1)
    found = []
    # At depth 0 only the array itself and blanks may stand.
    stray = (before == 0) & ~opens & ~BLANK[data]
    if stray.any() or (closes & (data != 93)).any():
        found.append((path, offset, None))
    # A blank text tells of the beginning of an array.
    found += [(path, offset + start, "") for start in np.flatnonzero(opens).tolist()]
    starts = np.flatnonzero(opens | commas)
    borders = np.flatnonzero(commas | closes)
    nexts = np.searchsorted(borders, starts, "right")
    whole = data.tobytes()
    for start, k in zip(starts.tolist(), nexts.tolist(), strict=True):
        if k < len(borders):
            text = whole[start + 1 : borders[k]]
            closed = bool(closes[borders[k]])
        else:
            text, closed = _rest(path, whole[start + 1 :], offset + len(data), length, end, int(level[-1]), size)
        if text is None or (not text.strip() and not (closed and opens[start])):
            found.append((path, offset + start, None))
        elif text.strip():
            found.append((path, offset + start, text.decode("utf-8", "replace")))
    return found


def _rest(path: str, held: bytes, offset: int, length: int, state: int, depth: int, size: int) -> tuple[bytes | None, bool]:
    """The element that a block ends in, read on to the next border."""
    parts = [held]
    while offset < length:
        data = _read(path, offset, size)
        plain, steps, end = scan(data, state)
        level = depth + steps
        before = np.concatenate([[depth], level[:-1]])
        commas, closes = plain & (data == 44) & (level == 1) & (before == 1), plain & (level == 0) & (before == 1)
        borders = np.flatnonzero(commas | closes)
        if len(borders):
            parts.append(data[: borders[0]].tobytes())
            return b"".join(parts), bool(closes[borders[0]])
        parts.append(data.tobytes())
        offset, state, depth = offset + len(data), end, int(level[-1])
    return None, False


def array_elements(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, at, text): elements of the JSON arrays in the files under `path`, by where they begin.

    A null text tells of a file that is not one array, whole and nothing else, and so does a second
    blank one, which stands for the beginning of an array; its elements may be among the rows.
    """
    blocks, tasks = _blocks(spark, path, block_bytes)
    told = blocks.select("path", "block").mapInPandas(_summaries(block_bytes), "path string, block long, told array<long>")
    # A row of a few numbers for each block.
    begins = told.repartition(tasks, "path").groupBy("path").applyInPandas(_composed, "path string, block long, state int, depth long")
    begins = materialize(begins, "block-states")
    found = blocks.join(begins, ["path", "block"]).mapInPandas(_elements(block_bytes), "path string, at long, text string")
    unclosed = begins.where(f"block = -1 and (state <> {OUTSIDE} or depth <> 0)").select(
        "path", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("string").alias("text")
    )
    return found.unionByName(unclosed)


def read_array(
    spark: SparkSession, path: str, schema: T.StructType = RESULT, block_bytes: int = BLOCK_BYTES, places: bool = False
) -> DataFrame:
    """Records of JSON arrays, as `files.read_results` gives them, whatever their size. With `places`, a
    struct `_place` of file and offset is added.

    A missing or empty file gives no rows, nor does one that is not a JSON array through and through.
    """
    if not exists(spark, path):
        nothing = spark.createDataFrame([], schema)
        return nothing.withColumn("_place", F.lit(None).cast("struct<path:string,at:long>")) if places else nothing
    elements = materialize(array_elements(spark, path, block_bytes), "elements")
    parsed = elements.select(
        "path", "at", "text", F.from_json("text", schema).alias("r"), F.try_parse_json("text").isNull().alias("unread")
    )
    wrong = F.count_if(F.expr("text is null or (unread and text <> '')")) + F.greatest(F.count_if(F.col("text") == "") - 1, F.lit(0))
    broken = parsed.groupBy("path").agg(wrong.alias("wrong")).where("wrong > 0").select("path")
    good = parsed.join(materialize(broken, "broken-files"), "path", "left_anti").where("r is not null and trim(text) not in ('', 'null')")
    return good.select("r.*", F.struct("path", "at").alias("_place")) if places else good.select("r.*")
