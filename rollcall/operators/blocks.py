"""Top-k search of many queries in one plan.

Queries and corpus are dealt into blocks of a bounded size, each packed into one row on the
executors. Every query block meets every corpus block once, in tiles of a matrix product; a task keeps k
rows per query of a block over all corpus blocks of its share, and these are merged per query. With B
bytes to a block, q bytes of queries and c bytes of corpus, about qc / B bytes are shuffled, and k rows
per query and share. No vector passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from rollcall.functions.scores import RANK_DECIMALS
from rollcall.operators.search import DEFAULT_K, unpack

BLOCK_BYTES = 8 << 20
FLOAT_BYTES = 4
# A table that would fill fewer blocks is cut into so many smaller ones, if they have so many rows.
LEAST_BLOCKS, LEAST_ROWS = 8, 1024
# Shares of the corpus per query block: enough for so many tasks in all.
TASKS = 96
# Queries and corpus rows of a product at once, and numbers computed again at once.
TILE_QUERIES, TILE_ROWS = 512, 2048
EXACT_CELLS = 1 << 20


def _size(df: DataFrame, vector: str) -> tuple[int, int]:
    """Rows with a vector, and the dimensions of one of them."""
    known = df.where(F.col(vector).isNotNull())
    n, size = known.agg(F.count("*"), F.max(F.size(vector) if isinstance(df.schema[vector].dataType, T.ArrayType) else F.length(vector) / FLOAT_BYTES)).first()
    return n, int(size or 0)


def packed(df: DataFrame, id_column: str, vector: str, blocks: int, dimensions: int) -> DataFrame:
    """(block, ids, matrix): the vectors of a block as float32 bytes, one row each."""
    id_type = df.schema[id_column].dataType
    schema = T.StructType(
        [T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("matrix", T.BinaryType())]
    )

    def pack(table: pa.Table) -> pa.Table:
        whole = table.combine_chunks()
        matrix = unpack(whole.column("vector").chunk(0), dimensions).astype("<f4")
        ids = pa.array([whole.column("id").to_pylist()], pa.list_(to_arrow_type(id_type)))
        return pa.table({"block": whole.column("block")[:1], "ids": ids, "matrix": pa.array([matrix.tobytes()], pa.binary())})

    block = F.pmod(F.xxhash64(id_column), F.lit(blocks)).alias("block")
    rows = df.where(F.col(vector).isNotNull()).select(block, F.col(id_column).alias("id"), F.col(vector).alias("vector"))
    return rows.groupBy("block").applyInArrow(pack, schema)


def _block_count(n: int, most_rows: int) -> int:
    return -(-n // min(most_rows, max(LEAST_ROWS, -(-n // LEAST_BLOCKS))))


def _numbers(count: int):
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))


def _directed(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and the places of the vectors that have a direction."""
    with np.errstate(over="ignore", invalid="ignore"):
        lengths = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    return lengths, np.flatnonzero(np.isfinite(lengths) & (lengths > 0))


class Nearest:
    """The k best corpus rows of each query of a block, over the corpus blocks added so far.

    Unit vectors are multiplied in single precision, which errs by less than `margin`. Pairs that may
    be among the best by that are computed again in double precision, and only this decides.
    """

    def __init__(self, queries: np.ndarray, k: int):
        lengths, self.places = _directed(queries)
        self.queries, self.lengths = queries[self.places], lengths[self.places]
        self.unit = (self.queries / self.lengths[:, None]).astype(np.float32)
        self.k, n = k, len(self.places)
        # Twice the bound for products of unit vectors rounded to 24 bits, summed in any order.
        self.margin = 2 * (queries.shape[1] + 8) * 2.0**-24
        self.scores, self.ids = np.full((n, k), -np.inf), np.zeros((n, k), np.int64)
        self.unnamed = np.zeros((n, k), bool)

    def add(self, ids: pa.Array, vectors: np.ndarray) -> None:
        lengths, places = _directed(vectors)
        vectors, lengths = vectors[places], lengths[places]
        unit = (vectors / lengths[:, None]).astype(np.float32)
        unnamed = ids.is_null().to_numpy(zero_copy_only=False)[places]
        numbers = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[places]
        for row in range(0, len(unit), TILE_ROWS):
            tile = unit[row : row + TILE_ROWS]
            for query in range(0, len(self.unit), TILE_QUERIES):
                asked, rows = self._possible(query, tile)
                if len(asked):
                    rows += row
                    scores = self._exact(asked, rows, vectors, lengths)
                    self._merge(asked, scores, numbers[rows], unnamed[rows])

    def _possible(self, query: int, tile: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(queries, rows of the tile) of all pairs that may be among the k best, in the order of queries."""
        about = self.unit[query : query + TILE_QUERIES] @ tile.T
        limit = self.scores[query : query + TILE_QUERIES, -1] - self.margin
        unset = np.flatnonzero(limit == -np.inf)
        if len(unset) and len(tile) > self.k:
            limit[unset] = np.partition(about[unset], len(tile) - self.k, axis=1)[:, -self.k] - 2 * self.margin
        asked, rows = np.divmod(np.flatnonzero(about >= limit.astype(np.float32)[:, None]), len(tile))
        return asked + query, rows

    def _exact(self, asked: np.ndarray, rows: np.ndarray, vectors: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        dots, step = np.empty(len(asked)), max(1, EXACT_CELLS // vectors.shape[1])
        for start in range(0, len(asked), step):
            part = slice(start, start + step)
            dots[part] = np.einsum("ij,ij->i", vectors[rows[part]], self.queries[asked[part]])
        return np.clip(np.round(dots / (lengths[rows] * self.lengths[asked]), RANK_DECIMALS), -1.0, 1.0)

    def _merge(self, asked: np.ndarray, scores: np.ndarray, ids: np.ndarray, unnamed: np.ndarray) -> None:
        # Ties with the k-th best stay in until ids decide.
        high = scores >= self.scores[asked, -1]
        asked, scores, ids, unnamed = asked[high], scores[high], ids[high], unnamed[high]
        met = asked[np.flatnonzero(np.diff(asked, prepend=-1))]
        query = np.concatenate([np.repeat(met, self.k), asked])
        scores = np.concatenate([self.scores[met].ravel(), scores])
        ids = np.concatenate([self.ids[met].ravel(), ids])
        unnamed = np.concatenate([self.unnamed[met].ravel(), unnamed])
        order = np.lexsort((ids, unnamed, -scores, query))
        many = np.bincount(query, minlength=len(self.unit))[met]
        firsts = np.cumsum(many) - many
        best = order[firsts[:, None] + np.arange(self.k)]
        self.scores[met], self.ids[met], self.unnamed[met] = scores[best], ids[best], unnamed[best]

    def found(self) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """(place of the query, id, similarity) of each of the best."""
        query, rank = np.nonzero(self.scores > -np.inf)
        ids = pa.array(self.ids[query, rank], mask=self.unnamed[query, rank])
        return self.places[query], ids, pa.array(self.scores[query, rank])


def block_top_k(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = DEFAULT_K,
    id_column: str = "id",
    vector_column: str = "embedding",
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(query_id, id, similarity, rank): the k most similar corpus rows of every query.

    Ids are unique on both sides, those of the corpus integers. Equal similarities are ordered by id.
    Rows without a vector and zero vectors are no hits.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    (n_queries, dimensions), (n_corpus, _) = _size(queries, query_vector), _size(corpus, vector_column)
    query_type, corpus_type = queries.schema[query_id].dataType, corpus.schema[id_column].dataType
    schema = T.StructType(
        [T.StructField(query_id, query_type), T.StructField(id_column, corpus_type), T.StructField("similarity", T.DoubleType())]
    )
    if not n_queries or not n_corpus or not k:
        return corpus.sparkSession.createDataFrame([], schema.add("rank", T.IntegerType()))
    rows = max(1, block_bytes // (FLOAT_BYTES * max(1, dimensions)))
    n_q, n_c = _block_count(n_queries, rows), _block_count(n_corpus, rows)
    shares = min(n_c, -(-TASKS // n_q))
    asked = packed(queries, query_id, query_vector, n_q, dimensions).select(
        F.col("block").alias("q"), _numbers(shares).alias("share"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix")
    )
    held = packed(corpus, id_column, vector_column, n_c, dimensions).select(
        _numbers(n_q).alias("q"), (F.col("block") % shares).alias("share"), F.col("ids").alias("c_ids"), F.col("matrix").alias("c_matrix")
    )
    names, id_type = [query_id, id_column, "similarity"], to_arrow_type(corpus_type)

    def block(row: pa.RecordBatch, side: str) -> tuple[pa.Array, np.ndarray]:
        ids, matrix = row.column(f"{side}_ids").flatten(), row.column(f"{side}_matrix")[0].as_buffer()
        return ids, np.frombuffer(matrix, "<f4").reshape(len(ids), dimensions).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = (batch.slice(i, 1) for batch in batches for i in range(batch.num_rows))
        # The join has sorted the pairs by query block.
        for _, same in groupby(pairs, key=lambda row: row.column("q")[0].as_py()):
            first = next(same)
            ids, matrix = block(first, "q")
            nearest = Nearest(matrix, k)
            for row in chain([first], same):
                nearest.add(*block(row, "c"))
            asked_at, found, similarity = nearest.found()
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(asked_at)), found.cast(id_type), similarity], names)

    met = held.hint("merge").join(asked, ["q", "share"]).select("q", "share", "q_ids", "q_matrix", "c_ids", "c_matrix")
    best = Window.partitionBy(query_id).orderBy(F.col("similarity").desc(), id_column)
    found = met.sortWithinPartitions("q", "share").mapInArrow(run, schema)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def with_columns(hits: DataFrame, corpus: DataFrame, id_column: str, columns: list[str], few: bool) -> DataFrame:
    """The hits with columns of their corpus rows. `few` says that the hits are of a bounded number."""
    payload = corpus.select(id_column, *columns)
    return payload.join(F.broadcast(hits) if few else hits, id_column)


