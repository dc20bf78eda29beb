"""Helpers shared by the operators: tables, blocks of text, word and window hashes."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"
BLOCK_BYTES = 4 << 20
CACHED_WORDS = 250_000
_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xBF58476D1CE4E5B9)
_M3 = np.uint64(0x94D049BB133111EB)


T = TypeVar("T")


def _kept() -> dict:
    return sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker")).__dict__


def kept_by_worker(kind: str, key: str, make: Callable[[], T]) -> T:
    """What `make` returns, kept by the Python worker for its later tasks; one per kind, the last key's.

    This package's functions are sent anew with each task, so what they keep lives in a module of its own.
    """
    held = _kept()
    if held.get(kind, (None,))[0] != key:
        held.pop(kind, None)
        held[kind] = key, make()
    return held[kind][1]


def dropped_by_worker(kind: str) -> None:
    """Let go of what `kept_by_worker` holds of this kind."""
    _kept().pop(kind, None)


def give_back() -> None:
    """Return free memory to the system; allocators else hold it, while the executor's JVM needs it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def letters(text: Column) -> Column:
    """Whether a text holds a letter; null texts hold none."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def blocks(texts: Iterable[str | None], limit: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """Consecutive texts as UTF-8, in lists of about `limit` bytes (one text at least)."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        data = b"" if text is None else text.encode("utf-8", "surrogatepass")
        if held and size + len(data) > limit:
            yield held
            held, size = [], 0
        held.append(data)
        size += len(data)
    if held:
        yield held


class WordHashes(dict):
    """64-bit hash per word, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of the texts, and where each text begins (one more at the end).

        bytes.split() splits at exactly the code points 0x20 and 0x09 to 0x0D.
        """
        split = [data.split() for data in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        get = self.__getitem__
        hashes = np.fromiter(
            (get(word) for words in split for word in words), np.uint64, int(starts[-1])
        )
        return hashes, starts


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def window_hashes(hashes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """One hash per `width` consecutive entries, over the whole array."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = np.uint64((int(_M1) + 2 * seed * 0xD1342543DE82EF95) % (1 << 64)) | np.uint64(1)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = total * base + hashes[k : k + n]
    return mix64(total + np.uint64(seed))


def inside(starts: np.ndarray, width: int) -> np.ndarray:
    """Positions at which a window of `width` words lies within one text."""
    total = int(starts[-1])
    if total < width:
        return np.empty(0, np.int64)
    ends = np.repeat(starts[1:], np.diff(starts))[: total - width + 1]
    at = np.arange(total - width + 1, dtype=np.int64)
    return at[at + width <= ends]
