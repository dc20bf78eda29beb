"""Approximate top-k search over product-quantised vectors, with an exact re-ranking.

A unit vector is cut into parts, and each part is stored as the number of the nearest of 256 centroids,
one byte. A query's products with all centroids make a table, and the similarity to a stored
vector is about the sum of one entry per part. The best rows by that sum are ranked again by
their own vectors, which lie in folders by a hash of the id so that few of them are read.

Centroids are learnt by k-means on a bounded sample: assignments and sums run as Spark jobs, and what
comes to the driver is one sum per centroid.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollcall.functions.scores import RANK_DECIMALS
from rollcall.operators.search import DEFAULT_K, Queries, _id_type, _query_blocks, best_per_query, pack_vectors, similarities, unpack
from rollcall.plans.scratch import materialize

FLOAT_BYTES = 4
# Queries that one scan of the codes answers, and rows to a folder of vectors.
QUERY_BLOCK = 256
FOLDER_ROWS = 4096


@dataclass(frozen=True)
class Quantisation:
    """`parts` bytes to a vector. About `sample` rows, chosen by a hash of the id, are learnt from in
    `rounds` rounds. A query re-ranks at most `refine` rows and `share` of the table, and ten for
    each hit asked for at least."""

    parts: int = 16
    centroids: int = 256
    sample: int = 50_000
    rounds: int = 10
    refine: int = 200
    share: float = 0.125


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; zero vectors stay zero."""
    lengths = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    return vectors / np.where(lengths > 0, lengths, 1.0)[:, None]


def cut(vectors: np.ndarray, parts: int) -> np.ndarray:
    """(row, part, place) of vectors, filled up with zeros."""
    width = -(-vectors.shape[1] // parts)
    padded = np.zeros((len(vectors), parts * width))
    padded[:, : vectors.shape[1]] = vectors
    return padded.reshape(len(vectors), parts, width)


def nearest(pieces: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each piece; `centroids` is (part, centroid, place)."""
    found = np.empty(pieces.shape[:2], np.uint8)
    lengths = np.einsum("pck,pck->pc", centroids, centroids)
    for part in range(pieces.shape[1]):
        found[:, part] = (lengths[part] - 2 * pieces[:, part] @ centroids[part].T).argmin(axis=1)
    return found


def train(vectors: DataFrame, dimensions: int, rows: int, s: Quantisation) -> np.ndarray:
    """Centroids (part, centroid, place) from (id, vector), of which there are `rows`."""
    draw = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) / float(1 << 30)
    sample = materialize(vectors.where(draw < s.sample / max(1, rows)).select("vector", draw.alias("draw")), "sample")
    seeds = sample.orderBy("draw").limit(s.centroids).select("vector").collect()
    first = cut(unit(np.array([row[0] for row in seeds], float).reshape(len(seeds), dimensions)), s.parts)
    centroids = np.zeros((s.parts, s.centroids, first.shape[2]))
    centroids[:, : len(seeds)] = first.transpose(1, 0, 2)
    if len(seeds) < s.centroids:
        return centroids  # every row is a centroid of its own
    size = s.parts * s.centroids

    for _ in range(s.rounds):

        def sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray = centroids) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros((size, centroids.shape[2])), np.zeros(size, np.int64)
            for batch in batches:
                pieces = cut(unit(unpack(batch.column(0), dimensions)), s.parts)
                cells = nearest(pieces, centroids).astype(np.int64) + np.arange(s.parts) * s.centroids
                count += np.bincount(cells.ravel(), minlength=size)
                for place in range(total.shape[1]):
                    total[:, place] += np.bincount(cells.ravel(), pieces[:, :, place].ravel(), minlength=size)
            met = np.flatnonzero(count)
            yield pa.RecordBatch.from_pydict(
                {"cell": met, "n": count[met], "total": pa.array(total[met].tolist(), pa.list_(pa.float64()))}
            )

        each = sample.select("vector").mapInArrow(sums, "cell long, n long, total array<double>")
        places = [F.sum(F.get("total", F.lit(i))) for i in range(centroids.shape[2])]
        told = each.groupBy("cell").agg(F.sum("n").alias("n"), F.array(*places).alias("total")).collect()
        moved = centroids.reshape(size, -1).copy()
        for cell, n, total in told:
            moved[cell] = np.array(total) / n
        moved = moved.reshape(centroids.shape)
        if np.allclose(moved, centroids, atol=1e-6):
            break
        centroids = moved
    return centroids


class QuantisedIndex:
    """Codes, vectors and centroids under one folder, as Parquet."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        about = spark.read.parquet(f"{self.path}/about").first()
        self.rows, self.dimensions, self.folders = about["rows"], about["dimensions"], about["folders"]
        self.settings = Quantisation(*about["settings"])
        held = spark.read.parquet(f"{self.path}/centroids").orderBy("part", "centroid").collect()
        self.centroids = np.array([row["place"] for row in held]).reshape(self.settings.parts, self.settings.centroids, -1)

    @staticmethod
    def write(
        df: DataFrame, path: str, s: Quantisation = Quantisation(), id_column: str = "id", vector_column: str = "embedding"
    ) -> QuantisedIndex:
        """Index the rows that have a vector. Every row is indexed; only the centroids come from a sample."""
        spark = df.sparkSession
        vectors = df.where(F.col(vector_column).isNotNull()).select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector"))
        rows, dimensions = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
        folders = max(1, rows // FOLDER_ROWS)
        centroids = train(vectors, dimensions, rows, s) if rows else np.zeros((s.parts, s.centroids, 1))

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = nearest(cut(unit(unpack(batch.column("vector"), dimensions)), s.parts), centroids)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("folder"), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "folder", "code"]
                )

        folder = F.pmod(F.xxhash64("id"), F.lit(folders)).cast("int").alias("folder")
        placed = vectors.select("id", folder, "vector")
        placed.mapInArrow(code, "id long, folder int, code binary").write.parquet(f"{path}/codes")
        dealt = pack_vectors(placed, "vector").repartitionByRange("folder", F.xxhash64("id"))
        dealt.write.partitionBy("folder").parquet(f"{path}/vectors")
        cells = [(p, c, [float(x) for x in centroids[p, c]]) for p in range(s.parts) for c in range(s.centroids)]
        spark.createDataFrame(cells, "part int, centroid int, place array<double>").coalesce(1).write.parquet(f"{path}/centroids")
        values = [s.parts, s.centroids, s.sample, s.rounds, s.refine, s.share]
        spark.createDataFrame(
            [(rows, dimensions, folders, tuple(values))],
            "rows long, dimensions int, folders int, settings struct<parts:int, centroids:int, sample:int, rounds:int, refine:int, share:double>",
        ).coalesce(1).write.parquet(f"{path}/about")
        return QuantisedIndex(spark, path)

    def refined(self, k: int) -> int:
        """Rows that are ranked again for one query."""
        return max(10 * k, min(self.settings.refine, int(self.rows * self.settings.share)))

    def bytes_read(self, k: int = DEFAULT_K) -> tuple[int, int]:
        """Bytes of codes and of re-ranked vectors for one query, and of all vectors as an exact scan reads them."""
        vector = FLOAT_BYTES * self.dimensions
        return self.rows * self.settings.parts + min(self.rows, self.refined(k)) * vector, self.rows * vector

    def candidates(self, queries: np.ndarray, k: int) -> DataFrame:
        """(asked, id, folder): the rows to rank again, by number of the query."""
        s, keep = self.settings, self.refined(k)
        table = np.einsum("qpk,pck->pcq", cut(unit(queries), s.parts), self.centroids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: list[np.ndarray] | None = None
            for batch in batches:
                codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, s.parts)
                scores = np.zeros((len(codes), table.shape[2]))
                for part in range(s.parts):
                    scores += table[part, codes[:, part]]
                if len(codes) > keep:
                    limit = np.partition(scores, len(codes) - keep, axis=0)[-keep]
                    rows, asked = np.nonzero(scores >= limit)
                else:
                    rows, asked = (a.ravel() for a in np.indices(scores.shape))
                ids, folders = (batch.column(c).to_numpy()[rows] for c in ("id", "folder"))
                found = [asked, np.round(scores[rows, asked], RANK_DECIMALS), ids, folders]
                best = found if best is None else [np.concatenate(pair) for pair in zip(best, found, strict=True)]
                kept = best_per_query(best[0], best[1], best[2], keep)
                best = [column[kept] for column in best]
            if best is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(best[0], pa.int32()), pa.array(best[1]), pa.array(best[2], pa.int64()), pa.array(best[3], pa.int32())],
                    ["asked", "score", "id", "folder"],
                )

        codes = self.spark.read.schema("id long, folder int, code binary").parquet(f"{self.path}/codes")
        first = Window.partitionBy("asked").orderBy(F.col("score").desc(), "id")
        found = codes.mapInArrow(run, "asked int, score double, id long, folder int")
        return found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= keep).select("asked", "id", "folder")

    def search(self, queries: Queries, k: int = DEFAULT_K, query_id: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
        """(query_id, id, similarity, rank): about the k most similar rows of every query.

        Similarities are exact. Queries go through the codes in blocks of QUERY_BLOCK.
        """
        id_type = _id_type(queries, query_id)
        parts = [
            materialize(self._pass(names, matrix, k, query_id, id_type), "hits")
            for names, matrix in _query_blocks(queries, query_id, query_vector, QUERY_BLOCK)
        ]
        if not parts or not k:
            empty = self.spark.range(0)
            return empty.select(F.lit(None).cast(id_type).alias(query_id), "id", F.lit(0.0).alias("similarity"), F.lit(0).alias("rank"))
        result = parts[0]
        for part in parts[1:]:
            result = result.unionByName(part)
        return result

    def _pass(self, names: list, matrix: np.ndarray, k: int, query_id: str, id_type) -> DataFrame:
        # At most QUERY_BLOCK x refine rows of three numbers.
        wanted = F.broadcast(self.candidates(matrix, k))
        vectors = self.spark.read.schema("id long, vector binary, folder int").parquet(f"{self.path}/vectors")
        met = vectors.join(wanted, ["folder", "id"]).select("asked", "id", "vector")

        def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                asked = batch.column("asked").to_numpy()
                own = unpack(batch.column("vector"), self_dimensions)
                exact = np.full(len(asked), np.nan)
                for one in np.unique(asked):
                    at = asked == one
                    exact[at] = similarities(own[at], matrix[one : one + 1])[:, 0]
                yield pa.RecordBatch.from_arrays([batch.column("asked"), batch.column("id"), pa.array(exact)], ["asked", "id", "similarity"])

        self_dimensions = self.dimensions
        ranked = met.mapInArrow(rank, "asked int, id long, similarity double").where("not isnan(similarity)")
        best = Window.partitionBy("asked").orderBy(F.col("similarity").desc(), "id")
        hits = ranked.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        named = self.spark.createDataFrame(list(enumerate(names)), "asked int, name string" if isinstance(names[0], str) else "asked int, name long")
        return hits.join(F.broadcast(named), "asked").select(F.col("name").cast(id_type).alias(query_id), "id", "similarity", "rank")
