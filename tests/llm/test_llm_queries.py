"""Registered queries against their SQL or a brute-force version, over whole tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry_module
import corpus_pipeline
from compare import compare, database
from rollcall.llm import oracles, queries

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark, small_dir):
    return spark.read.parquet(f"{small_dir}/documents.parquet").collect()


def test_all_are_registered():
    assert set(queries.registered()) | {"pipeline"} <= set(entry_module.queries())
    assert [int(n[2:].split("_")[0]) for n in queries.registered()] == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(oracles.registered()))
def test_query_matches_sql(spark, small_dir, name):
    compare(spark, database(small_dir), name, small_dir)


def test_language_held_out_accuracy(spark, small_dir, documents):
    rows = {r.doc_id: r for r in queries.op1_language_id(spark, small_dir).collect()}
    assert set(rows) == {d.doc_id for d in documents}
    right = held = 0
    for d in documents:
        r = rows[d.doc_id]
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.lang_pred in {"en", "de", "fr", "es", "und"}
        if r.held_out:
            held += 1
            right += r.lang_pred == d.lang
    assert right >= 0.95 * held


def base_counts(text):
    words = WORDS.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    lines = [line for line in (text or "").split("\n") if WORDS.search(line)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_quality_base(spark, small_dir, documents):
    rows = {r.doc_id: r for r in queries.op2_quality(spark, small_dir).collect()}
    assert len(rows) == len(documents)
    for d in documents:
        r = rows[d.doc_id]
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == base_counts(d.text)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_quality_separates_the_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = queries.op2_quality(spark, sf_dir).join(labels, "doc_id").collect()
    bad = [r.kept for r in rows if r.quality == 0 and not r.base_failed]
    good = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    assert sum(good) >= 0.98 * len(good)
    assert sum(bad) <= 0.4 * len(bad)


def test_toxicity_held_out(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = queries.op4_toxicity(spark, sf_dir).join(labels, "doc_id").where("held_out").collect()
    found = sum(r.predicted for r in rows if r.toxic)
    false = sum(r.predicted for r in rows if not r.toxic)
    assert found >= 0.85 * sum(r.toxic for r in rows)
    assert false <= 0.02 * sum(1 - r.toxic for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_tokens_are_sentencepiece_ids(spark, small_dir, documents):
    sentencepiece = pytest.importorskip("sentencepiece")
    model = sentencepiece.SentencePieceProcessor(model_file=queries.TOKENIZER)
    rows = {r.doc_id: r for r in queries.op5_sentencepiece(spark, small_dir).collect()}
    assert len(rows) == len(documents)
    for d in documents:
        ids = model.encode(d.text or "")
        assert rows[d.doc_id].token_ids == ids and rows[d.doc_id].n_tokens == len(ids)
        assert rows[d.doc_id].round_trip


def secrets(text):
    kinds = [
        ("assign", r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 1),
        ("access", r"AKIA[A-Z0-9]+", 18, 0),
        ("hex", r"[0-9a-f]+", 16, 0),
    ]
    spans = [
        (m.start(), i, m.end())
        for i, (_, pattern, least, group) in enumerate(kinds)
        for m in re.finditer(pattern, text or "")
        if len(m[group]) >= least
    ]
    counts = Counter(i for _, i, _ in spans)
    joined = ",".join(f"{kinds[i][0]}:{a}:{b}" for a, i, b in sorted(spans))
    return counts[0], counts[1], counts[2], hashlib.sha256(joined.encode()).hexdigest(), joined


def test_secret_base_spans(spark, documents):
    sf_dir = "/root/testdata/sf0.1"
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    rows = {r.doc_id: r for r in queries.op7_secret_scan(spark, sf_dir).collect()}
    assert len(rows) == len(texts)
    for d in texts:
        r = rows[d.doc_id]
        *want, joined = secrets(d.text)
        assert [r.n_assign, r.n_access, r.n_hex, r.base_sha256] == want
        assert set(joined.split(",")) <= set(r.spans.split(","))


def test_pipeline_keeps_what_its_stages_say(spark, small_dir, documents):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    state = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, state = state, stage(spark, state, small_dir).cache()
        assert state.columns == docs.columns
        ids, past = Counter(r.doc_id for r in state.collect()), {r.doc_id for r in before.collect()}
        assert set(ids) <= past
        if name == "exact dedup":
            normal = {r.doc_id: re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in before.collect()}
            first = {}
            for doc_id in sorted(normal):
                first.setdefault(normal[doc_id], doc_id)
            assert set(ids) == set(first.values())
        if name == "near dedup":
            assert set(ids) == near_survivors(before.collect())
    rows = corpus_pipeline.STAGES[-1][1](spark, state, small_dir).collect()
    assert len(rows) == state.count() and all(r.round_trip for r in rows)


def near_survivors(rows):
    sets = {}
    for r in rows:
        words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        n = max(1, len(words) - 4)
        sets[r.doc_id] = {tuple(words[i : i + 5]) for i in range(n)} if words else set()
    holders = defaultdict(set)
    for doc_id, shingles in sets.items():
        for s in shingles:
            holders[s].add(doc_id)
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    pairs = {(a, b) for ids in holders.values() for a in ids for b in ids if a < b}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {d for d in sets if root(d) == d}
