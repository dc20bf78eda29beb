"""Top-k search by cosine similarity, exact and approximate.

Each task ranks its own part of the corpus against a block of query vectors with one
matrix product per Arrow batch and keeps k rows per query, so what is shuffled is k rows
per query and task, not the similarities of all pairs. The corpus is read once and not
moved. More queries than one block go through `blocks.block_top_k`, in one plan as well.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from rollcall.functions.scores import RANK_DECIMALS, confidence_tier, match_score
from rollcall.operators.encode import Encoder, encode
from rollcall.plans.scratch import materialize
from rollcall.sources.snapshots import Snapshots

# Queries that go through the corpus together: at most this many vectors are sent to
# the tasks at once, and more of them take further passes.
QUERY_BLOCK = 2048
PRODUCT_CELLS = 4_000_000
DEFAULT_K = 5

Queries = DataFrame | list[tuple[int | str, Sequence[float]]]


def unpack(column: pa.Array, dimensions: int) -> np.ndarray:
    """Vectors of one Arrow batch, as lists of floats or as packed float32 bytes."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        flat = np.frombuffer(b"".join(column.to_pylist()), dtype="<f4")
    else:
        flat = column.flatten().to_numpy(zero_copy_only=False)
    if flat.size != len(column) * dimensions:
        raise ValueError(f"corpus vectors do not all have {dimensions} dimensions")
    return flat.reshape(len(column), dimensions).astype(np.float64)


def similarities(vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Cosines, rounded to the ranking precision; NaN for zero vectors."""
    with np.errstate(invalid="ignore", divide="ignore"):
        lengths = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        wanted = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        cosines = (vectors @ queries.T) / (lengths[:, None] * wanted[None, :])
    return np.clip(np.round(cosines, RANK_DECIMALS), -1.0, 1.0)


def best_per_query(query: np.ndarray, similarity: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best entries of each query, most similar first, then lowest id."""
    order = np.lexsort((ids, -similarity, query))
    ordered = query[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[rank < k]


def rank_batches(
    batches: Iterator[pa.RecordBatch],
    queries: np.ndarray,
    query_ids: pa.Array,
    k: int,
    id_place: int,
    vector_place: int,
    allowed: np.ndarray | None = None,
    cell_place: int | None = None,
) -> Iterator[pa.RecordBatch]:
    """The k best rows per query of one task's share of the corpus.

    `allowed[query, cell]` limits a query to some cells of an index.
    """
    best: pa.Table | None = None
    floor = np.full(len(queries), -np.inf)
    rows_at_once = max(k, PRODUCT_CELLS // max(1, len(queries)))
    for whole in batches:
        for start in range(0, whole.num_rows, rows_at_once):
            batch = whole.slice(start, rows_at_once)
            scores = similarities(unpack(batch.column(vector_place), queries.shape[1]), queries)
            if allowed is not None:
                cells = batch.column(cell_place).to_numpy(zero_copy_only=False)
                scores[~allowed[:, cells].T] = np.nan
            # NaN never counts; ties with the k-th best stay in until ids decide.
            scores = np.where(np.isnan(scores), -np.inf, scores)
            limit = floor
            if batch.num_rows > k:
                limit = np.maximum(limit, np.partition(scores, batch.num_rows - k, axis=0)[-k])
            rows, asked = np.nonzero((scores >= limit[None, :]) & (scores > -np.inf))
            if not len(rows):
                continue
            kept = [c for i, c in enumerate(batch.columns) if i != vector_place]
            names = [n for i, n in enumerate(batch.schema.names) if i != vector_place]
            found = pa.Table.from_arrays(
                [c.take(pa.array(rows)) for c in kept]
                + [pa.array(asked.astype(np.int32)), pa.array(scores[rows, asked])],
                names=[*names, "_asked", "similarity"],
            )
            best = found if best is None else pa.concat_tables([best, found])
            id_name = batch.schema.names[id_place]
            asked_all = best.column("_asked").to_numpy()
            scores_all = best.column("similarity").to_numpy()
            places = best_per_query(asked_all, scores_all, best.column(id_name).to_numpy(), k)
            best = best.take(pa.array(places)).combine_chunks()
            asked_all, scores_all = asked_all[places], scores_all[places]
            counts = np.bincount(asked_all, minlength=len(queries))
            lowest = np.full(len(queries), np.inf)
            np.minimum.at(lowest, asked_all, scores_all)
            floor = np.where(counts >= k, lowest, -np.inf)
    if best is not None:
        asked = best.column("_asked").combine_chunks()
        columns = [*best.drop_columns(["_asked", "similarity"]).columns, best.column("similarity")]
        names = [n for n in best.column_names if n not in ("_asked", "similarity")]
        named = pa.table([query_ids.take(asked), *columns], names=["_query", *names, "similarity"])
        yield from named.combine_chunks().to_batches()


def _query_blocks(queries: Queries, query_id: str, query_vector: str, size: int):
    """Blocks of (ids, matrix) on the driver, one at a time."""
    if isinstance(queries, list):
        stream = iter(queries)
    else:
        rows = queries.select(query_id, query_vector).where(F.col(query_vector).isNotNull())
        first = rows.limit(size + 1).collect()
        stream = iter(first) if len(first) <= size else rows.toLocalIterator()
    while block := list(itertools.islice(stream, size)):
        yield [row[0] for row in block], np.array([row[1] for row in block], dtype=np.float64)


def _id_type(queries: Queries, query_id: str) -> T.DataType:
    if isinstance(queries, list):
        return T.StringType() if queries and isinstance(queries[0][0], str) else T.LongType()
    return queries.schema[query_id].dataType


def top_k(
    corpus: DataFrame,
    queries: Queries,
    k: int = DEFAULT_K,
    id_column: str = "id",
    vector_column: str = "embedding",
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    block: int = QUERY_BLOCK,
    probes: "Probes | None" = None,
) -> DataFrame:
    """The k most similar corpus rows of every query, with `similarity` and `rank`.

    Queries are a frame, or a list of (id, vector) where the driver has them at hand.
    Equal similarities are ordered by `id_column`, an integer. Rows without a vector and
    zero vectors are no hits. More than `block` queries are ranked in blocks on the executors, by
    ids and vectors alone; the other columns are joined to the hits. Over an index, further blocks
    of queries are further passes, each written before the next one starts.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    id_type = _id_type(queries, query_id)
    corpus = corpus.where(F.col(vector_column).isNotNull())
    if probes is None and k:
        if isinstance(queries, list) and len(queries) > block:
            schema = T.StructType([T.StructField(query_id, id_type), T.StructField(query_vector, T.ArrayType(T.DoubleType()))])
            queries = corpus.sparkSession.createDataFrame([(i, [float(x) for x in v]) for i, v in queries], schema)
        if not isinstance(queries, list):
            few = queries.where(F.col(query_vector).isNotNull()).select(query_id, query_vector).limit(block + 1).collect()
            if len(few) > block:
                return _blocks(corpus, queries, k, id_column, vector_column, query_id, query_vector)
            queries = [(row[0], row[1]) for row in few]
    blocks = _query_blocks(queries, query_id, query_vector, block)
    first = next(blocks, None)
    if first is None or k == 0:
        empty = corpus.drop(vector_column).where(F.lit(False))
        return empty.select(
            F.lit(None).cast(id_type).alias(query_id),
            "*",
            F.lit(0.0).alias("similarity"),
            F.lit(0).alias("rank"),
        )
    args = (corpus, k, id_column, vector_column, query_id, id_type, probes)
    second = next(blocks, None)
    if second is None:
        return _pass(first, *args)
    parts = [
        materialize(_pass(part, *args), "top-k")
        for part in itertools.chain([first, second], blocks)
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _blocks(corpus, queries, k, id_column, vector_column, query_id, query_vector) -> DataFrame:
    from rollcall.operators.blocks import block_top_k, with_columns

    hits = block_top_k(corpus, queries, k, id_column, vector_column, query_id, query_vector)
    kept = [c for c in corpus.columns if c != vector_column]
    whole = with_columns(hits, corpus, id_column, [c for c in kept if c != id_column], few=False)
    return whole.select(query_id, *kept, "similarity", "rank")


def _pass(part, corpus, k, id_column, vector_column, query_id, id_type, probes) -> DataFrame:
    names, vectors = part
    id_place = corpus.columns.index(id_column)
    vector_place = corpus.columns.index(vector_column)
    allowed = cell_place = None
    if probes is not None:
        allowed = probes.allowed(vectors)
        cell_place = corpus.columns.index(probes.cell)
        wanted = np.flatnonzero(allowed.any(axis=0))
        corpus = corpus.where(F.col(probes.cell).isin([int(c) for c in wanted]))
    kept = [f for f in corpus.schema.fields if f.name != vector_column]
    schema = T.StructType(
        [
            T.StructField("_query", id_type),
            *kept,
            T.StructField("similarity", T.DoubleType()),
        ]
    )
    query_ids = pa.array(names, to_arrow_type(id_type))

    def run(batches):
        return rank_batches(
            batches, vectors, query_ids, k, id_place, vector_place, allowed, cell_place
        )

    ranked = Window.partitionBy("_query").orderBy(F.col("similarity").desc(), id_column)
    found = corpus.mapInArrow(run, schema)
    if len(names) == 1:
        # Merges the tasks' hits without a shuffle.
        found = found.orderBy(F.col("similarity").desc(), id_column).limit(k)
    return (
        found.withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select(
            F.col("_query").alias(query_id), *[f.name for f in kept], "similarity", "rank"
        )
    )


def present_hits(hits: DataFrame, *extra: str) -> DataFrame:
    """The ten fields a search answers with; needs a name, so filter before ranking."""
    return hits.select(
        *extra,
        "id",
        "name",
        F.col("raw_title").alias("title"),
        "experience_years",
        "skills",
        F.round("similarity", 3).alias("raw_similarity"),
        match_score(F.col("similarity")).alias("match_score"),
        confidence_tier(F.col("similarity")).alias("confidence_tier"),
        "phone",
        "email",
    )


def with_totals(hits: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Add the number of rows returned for the query, at most k."""
    returned = F.count("*").over(Window.partitionBy(query_id))
    return hits.withColumn("total_evaluated", returned)


def search(
    candidates: DataFrame, queries: Queries, k: int = DEFAULT_K, query_id: str = "query_id"
) -> DataFrame:
    """Candidate search: named rows only, calibrated score, tier and number of hits."""
    columns = [
        "id", "name", "raw_title", "experience_years", "skills", "phone", "email", "embedding",
    ]
    from rollcall.operators.blocks import with_columns

    named = candidates.where(F.col("name").isNotNull()).select(*columns)
    hits = top_k(named.select("id", "embedding"), queries, k, query_id=query_id)
    # What is ranked is ids and vectors; the hits get their columns afterwards.
    found = with_columns(hits, named.drop("embedding"), "id", [c for c in columns if c not in ("id", "embedding")], few=False)
    return present_hits(found, query_id, "rank")


def search_store(
    store: Snapshots, texts: DataFrame, encoder: Encoder, k: int = DEFAULT_K, text: str = "text",
    query_id: str = "query_id",
) -> DataFrame:
    """Search the stored table with texts, if its vectors come from the same encoder."""
    made_by = store.encoder()
    if made_by not in (None, encoder.encoder_id):
        raise ValueError(f"the table was encoded by {made_by}, not {encoder.encoder_id}")
    queries = encode(texts.select(query_id, text), text, encoder, "query_vector")
    return search(store.read(), queries, k, query_id)


# --- approximate search ------------------------------------------------------------


class Probes:
    """Sign-of-projection cells (random-hyperplane hashing for cosine similarity).

    A vector's cell has one bit per plane: the side it lies on. A query looks into the
    `probes` cells it is closest to, where leaving its own side of a plane costs the
    square of its distance from that plane. The planes are signs taken from md5, so they
    are the same in every job and a new row never moves an old one.
    """

    def __init__(self, dimensions: int, bits: int = 8, probes: int = 64, cell: str = "cell"):
        self.dimensions, self.bits, self.probes, self.cell = dimensions, bits, probes, cell
        signs = [
            [1.0 if hashlib.md5(f"{b}:{d}".encode()).hexdigest()[0] < "8" else -1.0
             for d in range(dimensions)]
            for b in range(bits)
        ]
        self.planes = np.array(signs)

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        sides = (vectors @ self.planes.T) >= 0
        return sides @ (1 << np.arange(self.bits))

    def allowed(self, queries: np.ndarray) -> np.ndarray:
        """For each query and cell, whether the query looks there."""
        cells = np.arange(1 << self.bits)
        distances = np.square(queries @ self.planes.T)
        wanted = np.zeros((len(queries), len(cells)), dtype=bool)
        for row, home in enumerate(self.cells(queries)):
            crossed = ((cells ^ home)[:, None] >> np.arange(self.bits)) & 1
            cost = np.round(crossed @ distances[row], RANK_DECIMALS)
            wanted[row, np.lexsort((cells, cost))[: self.probes]] = True
        return wanted


def add_cells(df: DataFrame, probes: Probes, vector_column: str = "embedding") -> DataFrame:
    """Add the cell of each vector."""
    place = df.columns.index(vector_column)
    schema = T.StructType([*df.schema.fields, T.StructField(probes.cell, T.IntegerType())])

    def run(batches):
        for batch in batches:
            vectors = unpack(batch.column(place), probes.dimensions)
            cells = pa.array(probes.cells(vectors).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, cells], names=[*batch.schema.names, probes.cell]
            )

    return df.where(F.col(vector_column).isNotNull()).mapInArrow(run, schema)


def pack_vectors(df: DataFrame, vector_column: str = "embedding") -> DataFrame:
    """Vectors as little-endian float32 bytes: read and passed on as one block per row."""
    place = df.columns.index(vector_column)
    fields = [
        T.StructField(f.name, T.BinaryType()) if f.name == vector_column else f
        for f in df.schema.fields
    ]

    def run(batches):
        for batch in batches:
            vectors = batch.column(place)
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype("<f4")
            ends = vectors.value_lengths().to_numpy(zero_copy_only=False).cumsum() * 4
            offsets = np.concatenate([[0], ends]).astype(np.int32)
            packed = pa.Array.from_buffers(
                pa.binary(), len(vectors), [None, pa.py_buffer(offsets), pa.py_buffer(flat.tobytes())]
            )
            columns = list(batch.columns)
            columns[place] = packed
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.where(F.col(vector_column).isNotNull()).mapInArrow(run, T.StructType(fields))


def write_index(
    df: DataFrame, path: str, probes: Probes, id_column: str = "id", vector_column: str = "embedding"
) -> None:
    """Write the corpus with packed vectors in one folder per cell.

    A search reads the folders its queries probe and no others. Rows are dealt by range over
    cell and a hash of the id, so a cell is written by as many tasks as its rows call for, and
    small cells share one.
    """
    celled = pack_vectors(add_cells(df, probes, vector_column), vector_column)
    dealt = celled.repartitionByRange(F.col(probes.cell), F.xxhash64(id_column))
    dealt.write.partitionBy(probes.cell).parquet(path)


def approximate_top_k(
    index: DataFrame, queries: Queries, probes: Probes, k: int = DEFAULT_K, **options
) -> DataFrame:
    """`top_k` over the probed cells of an index."""
    return top_k(index, queries, k, probes=probes, **options)


def recall(exact: DataFrame, found: DataFrame, query_id: str, id_column: str) -> DataFrame:
    """Share of the exact hits that the approximate search found, per query."""
    hit = found.select(query_id, id_column).withColumn("_found", F.lit(1))
    return (
        exact.join(hit, [query_id, id_column], "left")
        .groupBy(query_id)
        .agg(
            F.count("*").alias("exact_hits"),
            F.coalesce(F.sum("_found"), F.lit(0)).alias("found_hits"),
        )
    )
