"""Results of standing queries, maintained from what changes in the corpus.

The k best hits of every query are kept as a table. When rows are added or overwritten, their hits are
merged with the kept ones. A query that lost a hit is searched anew only if what is left and new does not
reach the old k-th place: any row that was no hit stands below it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollcall.operators.blocks import block_top_k
from rollcall.operators.search import DEFAULT_K
from rollcall.plans.scratch import exists, materialize, temporary_tables

HITS = "query_id {0}, id long, similarity double, rank int"


class StandingSearch:
    """Hits of (query_id, query_vector) per version of the corpus, in folders of their own."""

    def __init__(self, spark: SparkSession, root: str, queries: DataFrame, k: int = DEFAULT_K):
        self.spark, self.root, self.queries, self.k = spark, root.rstrip("/"), queries, k
        self.schema = HITS.format(queries.schema["query_id"].dataType.simpleString())

    def _path(self, version: int) -> str:
        return f"{self.root}/version={version:08d}"

    def has(self, version: int) -> bool:
        return exists(self.spark, f"{self._path(version)}/_SUCCESS")

    def hits(self, version: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self._path(version))

    def build(self, corpus: DataFrame, version: int) -> None:
        """Search the whole corpus (id, embedding, ...)."""
        found = block_top_k(corpus.select("id", "embedding"), self.queries, self.k)
        found.select("query_id", "id", "similarity", "rank").write.mode("overwrite").parquet(self._path(version))

    def update(self, corpus: DataFrame, changed: DataFrame, before: int, version: int) -> int:
        """From the hits of version `before` to those of `version`; returns how many queries were searched anew.

        `corpus` is the table now, `changed` its rows that were added, overwritten or, with a null
        embedding or no longer in the corpus, removed.
        """
        with temporary_tables(self.spark):
            ids = materialize(changed.select("id").distinct(), "changed-ids")
            held = self.hits(before)
            kept = held.join(ids, "id", "left_anti").select("query_id", "id", "similarity")
            present = corpus.select("id", "embedding").join(ids, "id", "left_semi")
            fresh = block_top_k(materialize(present, "changed-rows"), self.queries, self.k)
            order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id")
            merged = kept.unionByName(fresh.select("query_id", "id", "similarity")).withColumn("rank", F.row_number().over(order))
            merged = materialize(merged.where(F.col("rank") <= self.k), "merged-hits")

            lost = held.join(ids, "id", "left_semi").select("query_id").distinct()
            last = held.where(F.col("rank") == self.k).select("query_id", F.col("similarity").alias("_s"), F.col("id").alias("_id"))
            reaches = F.expr("similarity > _s or (similarity = _s and id <= _id)")
            good = merged.join(last, "query_id").where(reaches).groupBy("query_id").agg(F.count("*").alias("n"))
            # Fewer than k hits were all rows there were, so nothing else can move up.
            short = lost.join(last.select("query_id"), "query_id").join(good, "query_id", "left")
            again = materialize(short.where(F.coalesce("n", F.lit(0)) < self.k).select("query_id"), "searched-anew")
            searched = again.count()
            result = merged
            if searched:
                asked = self.queries.join(again, "query_id", "left_semi")
                anew = block_top_k(corpus.select("id", "embedding"), asked, self.k).select(merged.columns)
                result = merged.join(again, "query_id", "left_anti").select(merged.columns).unionByName(anew)
            result.select("query_id", "id", "similarity", "rank").write.mode("overwrite").parquet(self._path(version))
        return searched
