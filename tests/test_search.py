"""Search against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rollcall.operators import blocks, encode, quantise, search
from rollcall.sources.snapshots import Snapshots

VECTORS = "id long, name string, embedding array<float>"
QUERIES = "query_id string, query_vector array<float>"


def corpus_and_queries(seed=1, n=900, dims=16, asked=7):
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(n, dims)).astype("f4")
    vectors[n // 3 : 2 * n // 3] = vectors[0]  # a third of the rows are copies of one
    return vectors, rng.normal(size=(asked, dims)).astype("f4")


def brute_force(vectors, queries, k, usable=None):
    v, q = vectors.astype(float), queries.astype(float)
    cosines = (v @ q.T) / np.linalg.norm(v, axis=1)[:, None] / np.linalg.norm(q, axis=1)
    cosines = np.round(cosines, 9)
    best = {}
    for j in range(len(q)):
        ids = [i for i in range(len(v)) if usable is None or usable(i, j)]
        best[f"q{j}"] = sorted(ids, key=lambda i: (-cosines[i, j], i))[:k]
    return best


def frames(spark, vectors, queries):
    rows = [(i, f"n{i}", [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(10_000, "none", None)]
    asked = [(f"q{j}", [float(x) for x in q]) for j, q in enumerate(queries)]
    return spark.createDataFrame(rows, VECTORS).repartition(5), spark.createDataFrame(asked, QUERIES)


def found(hits):
    out = {}
    for row in hits.orderBy("query_id", "rank").collect():
        out.setdefault(row["query_id"], []).append(row["id"])
    return out


@pytest.mark.parametrize("k,block", [(5, 100), (40, 3), (400, 100)])
def test_matches_brute_force(spark, k, block):
    vectors, queries = corpus_and_queries()
    queries[0] = vectors[0]  # more ties than k: ids decide
    corpus, asked = frames(spark, vectors, queries)
    hits = search.top_k(corpus, asked, k, block=block)
    assert found(hits) == brute_force(vectors, queries, k)


def test_packed_vectors_give_the_same_hits(spark):
    vectors, queries = corpus_and_queries(2)
    corpus, asked = frames(spark, vectors, queries)
    assert found(search.top_k(search.pack_vectors(corpus), asked, 6)) == brute_force(vectors, queries, 6)


def test_single_query_and_small_corpus(spark):
    vectors, queries = corpus_and_queries(3, n=4, asked=1)
    corpus, asked = frames(spark, vectors, queries)
    assert found(search.top_k(corpus, asked, 10)) == brute_force(vectors, queries, 10)


def test_queries_from_the_driver(spark):
    vectors, queries = corpus_and_queries(8)
    corpus, _ = frames(spark, vectors, queries)
    asked = [(f"q{j}", [float(x) for x in q]) for j, q in enumerate(queries)]
    assert found(search.top_k(corpus, asked, 5, block=4)) == brute_force(vectors, queries, 5)
    numbered = search.top_k(corpus, [(3, asked[0][1])], 5)
    assert {r["query_id"] for r in numbered.collect()} == {3}


def test_zero_vectors_are_no_hits(spark):
    corpus, asked = frames(spark, np.array([[0, 0], [1, 0]], "f4"), np.array([[1, 1]], "f4"))
    assert found(search.top_k(corpus, asked, 5)) == {"q0": [1]}


def test_k_zero_negative_and_no_queries(spark):
    corpus, asked = frames(spark, *corpus_and_queries(4, n=5))
    assert search.top_k(corpus, asked, 0).count() == 0
    assert search.top_k(corpus, asked.limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        search.top_k(corpus, asked, -1)


def test_unequal_dimensions_are_refused(spark):
    corpus, _ = frames(spark, *corpus_and_queries(4, n=5))
    asked = spark.createDataFrame([("q", [1.0, 2.0])], QUERIES)
    with pytest.raises(Exception, match="dimensions"):
        search.top_k(corpus, asked, 5).collect()


def test_index_searches_only_probed_cells(spark, tmp_path):
    vectors, queries = corpus_and_queries(5)
    corpus, asked = frames(spark, vectors, queries)
    probes = search.Probes(16, bits=4, probes=5)
    path = str(tmp_path / "index")
    search.write_index(corpus, path, probes)
    index = spark.read.parquet(path)
    cells, allowed = probes.cells(vectors.astype(float)), probes.allowed(queries.astype(float))
    expected = brute_force(vectors, queries, 5, usable=lambda i, j: allowed[j, cells[i]])
    hits = search.approximate_top_k(index, asked, probes, 5)
    assert found(hits) == expected
    assert "PartitionFilters: [cell" in hits._jdf.queryExecution().toString()


def test_index_with_all_cells_probed_is_exact(spark, tmp_path):
    vectors, queries = corpus_and_queries(6)
    corpus, asked = frames(spark, vectors, queries)
    probes = search.Probes(16, bits=4, probes=16)
    search.write_index(corpus, str(tmp_path / "index"), probes)
    hits = search.approximate_top_k(spark.read.parquet(str(tmp_path / "index")), asked, probes, 5)
    assert found(hits) == brute_force(vectors, queries, 5)
    exact = search.top_k(corpus, asked, 5)
    shares = search.recall(exact, hits, "query_id", "id").collect()
    assert all(r["exact_hits"] == r["found_hits"] == 5 for r in shares)


def test_recall_of_the_default_index_on_clustered_vectors(spark, tmp_path):
    rng = np.random.default_rng(7)
    centers = rng.normal(size=(30, 64))
    vectors = (centers[rng.integers(30, size=1500)] + 0.4 * rng.normal(size=(1500, 64))).astype("f4")
    queries = (centers + 0.4 * rng.normal(size=(30, 64))).astype("f4")
    corpus, asked = frames(spark, vectors, queries)
    probes = search.Probes(64)
    search.write_index(corpus, str(tmp_path / "index"), probes)
    hits = found(search.approximate_top_k(spark.read.parquet(str(tmp_path / "index")), asked, probes, 5))
    exact = brute_force(vectors, queries, 5)
    recall = np.mean([len(set(hits.get(q, [])) & set(ids)) / 5 for q, ids in exact.items()])
    assert recall >= 0.9


def test_search_needs_a_name_and_one_encoder(spark):
    encoder = encode.HashingEncoder(32)
    rows = [(1, "A", "Welder"), (2, None, "Welder"), (3, "C", "Plumber")]
    people = spark.createDataFrame(rows, "id long, name string, raw_title string")
    people = people.select(
        "*", F.lit(3).alias("experience_years"), F.array("raw_title").alias("skills"),
        F.lit(None).cast("string").alias("phone"), F.lit(None).cast("string").alias("email"),
    )
    corpus = encode.encode_candidates(people, encoder)
    asked = encode.encode(
        spark.createDataFrame([("welder",)], "query_id string"), "query_id", encoder, "query_vector"
    )
    hits = search.search(corpus, asked, 5).orderBy("rank").collect()
    assert [r["id"] for r in hits] == [1, 3]
    assert hits[0]["title"] == "Welder" and hits[0]["confidence_tier"] in {"High Match", "Moderate Match"}


def test_a_table_of_another_encoder_is_refused(spark, tmp_path):
    encoder, other = encode.HashingEncoder(8), encode.HashingEncoder(16)
    schema = "id long, name string, raw_title string, experience_years int, skills array<string>"
    people = spark.createDataFrame([(1, "Ann", "Welder", 2, ["Welder"]), (2, "Bob", "Fitter", 3, ["Fitter"])], schema)
    store = Snapshots(spark, str(tmp_path))
    store.publish(encode.encode_candidates(people, encoder), "first", encoder=encoder.encoder_id)
    asked = spark.createDataFrame([(7, "welder welder")], "query_id long, text string")
    assert search.search_store(store, asked, encoder, 1).first()["name"] == "Ann"
    with pytest.raises(ValueError, match="hashing-8"):
        search.search_store(store, asked, other)
    store.compact()
    assert store.version() == 1 and store.encoder() == "hashing-8"
    store.publish(encode.encode_candidates(people, other), "second", encoder=other.encoder_id)
    with pytest.raises(ValueError, match="several"):
        search.search_store(store, asked, encoder)


def test_backfill_encodes_only_missing_rows(spark):
    rows = [(1, "Welder", 2, ["Welder"], [9.0] * 8), (2, "Fitter", None, None, None)]
    schema = "id long, raw_title string, experience_years int, skills array<string>, embedding array<float>"
    encoder = encode.HashingEncoder(8)
    stored = spark.createDataFrame(rows, schema)
    filled = {r["id"]: r["embedding"] for r in encode.backfill_vectors(stored, encoder).collect()}
    text = "Title: Fitter. Experience: None years. Skills: None."
    assert filled[1] == [9.0] * 8 and filled[2] == encoder([text])[0].tolist()
    assert encode.missing_vectors(stored).count() == 1


def test_encoder_sees_batches_of_bounded_size(spark):
    class Encoder:
        def __call__(self, texts):
            assert len(texts) <= 256
            return np.full((len(texts), 2), len(texts), dtype="f4")

    texts = spark.range(1000).select(F.when(F.col("id") != 7, F.col("id").cast("string")).alias("t"))
    rows = encode.encode(texts.coalesce(1), "t", Encoder()).collect()
    assert len(rows) == 1000 and sum(r["embedding"] is None for r in rows) == 1
    assert {len(r["embedding"]) for r in rows if r["embedding"]} == {2}


@pytest.mark.parametrize("block_bytes", [16 * 4 * 9, 16 * 4 * 100, 1 << 20])
def test_blocks_match_brute_force(spark, block_bytes):
    vectors, queries = corpus_and_queries(9, n=400, asked=31)
    vectors[7] = 0
    corpus, asked = frames(spark, vectors, queries)
    asked = asked.union(spark.createDataFrame([("null", None)], QUERIES))
    hits = blocks.block_top_k(corpus, asked, 6, block_bytes=block_bytes)
    assert found(hits) == brute_force(vectors, queries, 6, usable=lambda i, j: i != 7)
    plan = hits._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert blocks.block_top_k(corpus, asked.limit(0), 6).count() == 0
    assert blocks.block_top_k(corpus.limit(0), asked, 6).count() == 0


def test_blocks_take_packed_vectors_and_string_or_integer_ids(spark):
    vectors, queries = corpus_and_queries(10, n=100, asked=5)
    corpus, asked = frames(spark, vectors, queries)
    numbered = asked.select(F.substring("query_id", 2, 9).cast("long").alias("query_id"), "query_vector")
    hits = blocks.block_top_k(search.pack_vectors(corpus), numbered, 3, block_bytes=16 * 4 * 7)
    assert {f"q{q}": ids for q, ids in found(hits).items()} == brute_force(vectors, queries, 3)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_quantised_index_recall_and_bytes(spark, tmp_path, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    index = quantise.QuantisedIndex.write(rows, str(tmp_path / "pq"), id_column="vec_id")
    again = quantise.QuantisedIndex(spark, str(tmp_path / "pq"))
    assert again.rows == rows.count() and np.array_equal(again.centroids, index.centroids)
    asked = rows.where("vec_id % 50 = 0").selectExpr("vec_id query_id", "embedding query_vector")
    hits = found(again.search(asked, 5))
    held = {r["vec_id"]: r["embedding"] for r in rows.collect()}
    ids = np.array(sorted(held))
    matrix = np.array([held[i] for i in ids], float)
    shares = []
    for query in (i for i in ids if i % 50 == 0):
        cosines = np.round(matrix @ np.array(held[query]) / np.linalg.norm(matrix, axis=1) / np.linalg.norm(held[query]), 9)
        exact = ids[np.lexsort((ids, -cosines))][:5]
        shares.append(len(set(exact) & set(hits[query])) / 5)
    assert np.mean(shares) >= 0.9 and min(shares) >= 0.4
    own, whole = again.bytes_read(5)
    assert own < whole / 4
    assert spark.read.parquet(str(tmp_path / "pq" / "codes")).count() == again.rows


def test_quantised_index_reads_only_the_folders_of_its_candidates(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quantise, "FOLDER_ROWS", 4)
    monkeypatch.setattr(quantise, "QUERY_BLOCK", 2)
    vectors, queries = corpus_and_queries(12, n=600, asked=3)
    corpus, asked = frames(spark, vectors, queries)
    s = quantise.Quantisation(parts=8, centroids=64, sample=300, refine=60, share=0.1)
    index = quantise.QuantisedIndex.write(corpus, str(tmp_path / "pq"), s)
    hits = found(index.search(asked, 4))
    exact = brute_force(vectors, queries, 4)
    assert np.mean([len(set(hits[q]) & set(ids)) / 4 for q, ids in exact.items()]) >= 0.9
    plan = index._pass(["q0"], queries[:1].astype(float), 4, "query_id", asked.schema["query_id"].dataType)
    assert "dynamicpruning" in plan._jdf.queryExecution().toString()
    assert index.search(asked.limit(0), 4).count() == 0


def test_an_empty_table_can_be_quantised(spark, tmp_path):
    corpus, asked = frames(spark, *corpus_and_queries(12, n=6, asked=2))
    index = quantise.QuantisedIndex.write(corpus.where("embedding is null"), str(tmp_path / "pq"))
    assert index.rows == 0 and index.search(asked, 4).count() == 0


def test_blocks_compute_few_pairs_twice_and_rank_by_double_precision(monkeypatch):
    rng = np.random.default_rng(17)
    vectors, queries = rng.normal(size=(9000, 32)), rng.normal(size=(1100, 32))
    # Rows whose similarities to the first query differ by less than single precision tells.
    side = vectors[1] - queries[0] * (vectors[1] @ queries[0]) / (queries[0] @ queries[0])
    vectors[5000:5040] = queries[0] + side * np.sqrt(np.linspace(1e-6, 2e-6, 40))[:, None]
    vectors[[7, 8]], queries[3] = [[0.0] * 32, [np.nan] * 32], 0.0
    again = []
    exact = blocks.Nearest._exact
    monkeypatch.setattr(blocks.Nearest, "_exact", lambda self, asked, *rest: again.append(len(asked)) or exact(self, asked, *rest))
    nearest = blocks.Nearest(queries, 6)
    for start in range(0, 9000, 4500):
        nearest.add(pa.array(range(start, start + 4500)), vectors[start : start + 4500])
    asked, ids, _ = nearest.found()
    got = {f"q{j}": ids.to_numpy()[asked == j].tolist() for j in range(1100)}
    usable = brute_force(np.delete(vectors, [7, 8], axis=0), np.delete(queries, 3, axis=0), 6)
    kept = np.delete(np.arange(9000), [7, 8])
    names = [f"q{j}" for j in range(1100) if j != 3]
    assert got == {name: kept[best].tolist() for name, best in zip(names, usable.values(), strict=True)} | {"q3": []}
    assert sum(again) < 0.01 * 9000 * 1100


def test_blocks_share_a_table_smaller_than_a_block(spark):
    vectors, _ = corpus_and_queries(19, n=2100, dims=4)
    corpus, _ = frames(spark, vectors, vectors[:1])
    asked = corpus.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector"))
    assert blocks._block_count(2100, 1 << 20) == 3
    want = brute_force(vectors, vectors[:40], 3)
    got = found(blocks.block_top_k(corpus, asked, 3).where("query_id < 40"))
    assert {f"q{j}": best for j, best in got.items()} == want
