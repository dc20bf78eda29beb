"""Text to vector, through any encoder that takes a batch of texts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.functions.skills import embedding_text
from rollcall.schemas import EMBEDDING_DIMENSIONS

ENCODE_BATCH = 256
TOKEN = re.compile("[a-z0-9]+")

Encoder = Callable[[Sequence[str]], np.ndarray]


class HashingEncoder:
    """Counts of words hashed into buckets.

    Compares words, not meaning: it stands in where no model is at hand. The bucket is
    taken from the md5 of the word so any SQL engine can check the result. Counts are whole
    numbers and not scaled to unit length, so that equal similarities stay equal; cosines do not
    depend on the length.
    """

    def __init__(self, dimensions: int = EMBEDDING_DIMENSIONS):
        self.dimensions = dimensions
        self.encoder_id = f"hashing-{dimensions}"
        self._buckets: dict[str, int] = {}

    def bucket(self, word: str) -> int:
        if word not in self._buckets:
            if len(self._buckets) > 1_000_000:
                self._buckets.clear()
            digest = hashlib.md5(word.encode()).hexdigest()
            self._buckets[word] = int(digest[:8], 16) % self.dimensions
        return self._buckets[word]

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        cells = [
            row * self.dimensions + self.bucket(word)
            for row, text in enumerate(texts)
            for word in TOKEN.findall(text.lower())
        ]
        size = len(texts) * self.dimensions
        counts = np.bincount(np.array(cells, np.int64), minlength=size)
        return counts.reshape(len(texts), self.dimensions).astype(np.float32)


def encode(
    df: DataFrame, text: str, encoder: Encoder, vector: str = "embedding", batch: int = ENCODE_BATCH
) -> DataFrame:
    """Add a vector column; rows without text get none.

    The encoder is shipped to the tasks once and called with up to `batch` texts.
    """
    if vector in df.columns:
        df = df.drop(vector)
    schema = T.StructType([*df.schema.fields, T.StructField(vector, T.ArrayType(T.FloatType()))])
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record_batch in batches:
            for start in range(0, record_batch.num_rows, batch):
                part = record_batch.slice(start, batch)
                texts = part.column(place)
                known = texts.drop_null().to_pylist()
                flat = np.asarray(encoder(known), dtype=np.float32) if known else np.zeros((0, 0))
                sizes = np.where(texts.is_valid().to_numpy(zero_copy_only=False), flat.shape[1], 0)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                vectors = pa.ListArray.from_arrays(
                    pa.array(offsets), pa.array(flat.ravel(), pa.float32()), mask=texts.is_null()
                )
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, vectors], names=[*part.schema.names, vector]
                )

    return df.mapInArrow(run, schema)


def encode_candidates(df: DataFrame, encoder: Encoder) -> DataFrame:
    """Vectors of candidate rows, always made from the one text format."""
    text = embedding_text(F.col("raw_title"), F.col("experience_years"), F.col("skills"))
    columns = [c for c in df.columns if c != "embedding"]
    return encode(df.withColumn("_text", text), "_text", encoder).select(*columns, "embedding")


def missing_vectors(df: DataFrame) -> DataFrame:
    return df.where(F.col("embedding").isNull())


def backfill_vectors(df: DataFrame, encoder: Encoder) -> DataFrame:
    """Encode only rows without a vector; the others do not pass through Python."""
    known = df.where(F.col("embedding").isNotNull())
    return known.unionByName(encode_candidates(missing_vectors(df), encoder))
