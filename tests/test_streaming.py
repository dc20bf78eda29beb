"""Streams over several micro-batches, replays and restarts."""

import json
import random
import sys
import time
from pathlib import Path

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import functions as F

from rollcall.operators import merge, records
from rollcall.operators.batches import finished_files
from rollcall.operators.blocks import block_top_k
from rollcall.operators.encode import HashingEncoder
from rollcall.operators.key_index import KeyIndex
from rollcall.operators.standing import StandingSearch
from rollcall.plans import views
from rollcall.plans.queries import fixed_now
from rollcall.plans.scan import number_rows
from rollcall.plans.scratch import exists, materialize, temporary_tables
from rollcall.sources.files import read_resumes
from rollcall.sources.snapshots import Snapshots
from rollcall.streaming import admission, ingest, progress, retries

register_pickle_by_value(sys.modules[__name__])

COLUMNS = ["name", "raw_title", "experience_years", "skills", "phone", "phone_normalized", "email", "source_file", "batch_id"]


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def run_ingest(spark, source, schema, root, skip_known=False):
    store = Snapshots(spark, f"{root}/store")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    sink = ingest.CandidateIngest(store, "s", fixed_now, skip_known)
    ingest.start(stream, sink, f"{root}/checkpoint", available_now=True).awaitTermination()
    return store, sink


def test_ingest_restarts_and_replays_give_the_same_rows(spark, small_dir, tmp_path):
    source = str(tmp_path / "in")
    people = views.candidates(spark, small_dir).drop("id").where("seq < 40")
    for low in (0, 20):
        people.where(f"seq >= {low} and seq < {low + 20}").coalesce(1).write.mode("append").parquet(source)
    store, sink = run_ingest(spark, source, people.schema, str(tmp_path / "a"))
    published = rows_of(store.read())
    assert store.version() == 2

    # The same checkpoint again: nothing new.
    run_ingest(spark, source, people.schema, str(tmp_path / "a"))
    assert store.version() == 2 and rows_of(store.read()) == published
    # A replayed micro-batch: already published.
    sink(people.where("seq < 20"), 0)
    assert store.version() == 2
    # A fresh checkpoint publishes the same rows, and one merge of everything too.
    other, _ = run_ingest(spark, source, people.schema, str(tmp_path / "b"))
    assert rows_of(other.read()) == published
    nothing = store.read().limit(0)
    assert rows_of(merge.next_snapshot(nothing, merge.merge(nothing, people, fixed_now()))) == published
    actions = {r["action"]: r["count"] for r in sink.outcomes().groupBy("action").count().collect()}
    assert actions["insert"] == len(published) and sum(actions.values()) == 40
    ids = [r["id"] for r in store.read().collect()]
    assert len(ids) == len(set(ids))


def test_known_files_are_skipped(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "store"))
    sink = ingest.CandidateIngest(store, "s", fixed_now, skip_known=True)
    schema = ("seq long, name string, raw_title string, experience_years int, skills array<string>, "
              "phone string, email string, source_file string, batch_id string")
    first = spark.createDataFrame([(0, "A", None, 1, ["Other"], None, None, "a.pdf", "b")], schema)
    second = spark.createDataFrame(
        [(0, "A2", None, 1, ["Other"], None, None, "a.pdf", "b"), (1, "C", None, 1, ["Other"], None, None, "c.pdf", "b")],
        schema,
    )
    sink(first, 0)
    sink(second, 1)
    assert sorted(r["name"] for r in store.read().collect()) == ["A", "C"]


def test_the_same_name_in_another_batch_is_another_file(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "store"))
    sink = ingest.CandidateIngest(store, "s", fixed_now, skip_known=True)
    schema = ("seq long, name string, raw_title string, experience_years int, skills array<string>, "
              "phone string, email string, source_file string, batch_id string")
    for epoch, batch in enumerate(["b1", "b2"]):
        row = (0, f"of {batch}", None, 1, ["Other"], None, None, "cv.pdf", batch)
        sink(spark.createDataFrame([row], schema), epoch)
    assert sorted(r["name"] for r in store.read().collect()) == ["of b1", "of b2"]


def test_rejected_writes_keep_their_payload(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "store"))
    sink = ingest.CandidateIngest(store, "s", fixed_now)
    people = views.candidates(spark, "/root/testdata/sf0.01").drop("id")
    sink(people, 0)
    refused = sink.outcomes().where("action not in ('insert', 'update')")
    letters = sink.rejected()
    assert refused.count() > 0 and letters.count() == refused.count()
    whole = people.select("seq", "name", "phone", "email", "source_file")
    assert letters.select(whole.columns).exceptAll(whole).count() == 0


def reply(name, mime, payload):
    if "broken" in payload:
        raise records.PermanentError("unreadable")
    who, phone = payload.split(",")
    return json.dumps({"name": who, "raw_title": "Welder", "experience_years": 3, "phone": phone,
                       "email": None, "skills": ["welder"]})


def test_files_to_searchable_rows(spark, tmp_path):
    folder = tmp_path / "uploads"
    folder.mkdir()
    for name, text in [("a.txt", "Ann,9182468135"), ("b.txt", "Bob,2015550300"), ("c.txt", "broken"),
                       ("d.txt", "Ann Lee,(918) 246-8135"), ("skip.exe", "x")]:
        (folder / name).write_text(text)
    store = Snapshots(spark, str(tmp_path / "store"))
    letters = str(tmp_path / "dead")
    sink = ingest.CandidateIngest(store, "files", fixed_now)

    def process(documents, epoch):
        writes, dead = ingest.documents_to_writes(documents, reply, HashingEncoder(16), F.lit("batch"))
        dead.write.mode("overwrite").parquet(f"{letters}/{epoch}")
        sink(writes, epoch)

    stream = read_resumes(spark, str(folder), streaming=True, maxFilesPerTrigger=ingest.FILES_PER_MINUTE)
    ingest.start(stream, process, str(tmp_path / "checkpoint"), available_now=True).awaitTermination()
    rows = {r["name"]: r for r in store.read().collect()}
    assert set(rows) == {"Ann Lee", "Bob"}
    assert rows["Ann Lee"]["source_file"] == "d.txt" and len(rows["Bob"]["embedding"]) == 16
    dead = spark.read.parquet(f"{letters}/0").collect()
    assert [(r["source_file"], r["error_class"]) for r in dead] == [("c.txt", records.PERMANENT)]


def test_search_results_follow_the_corpus(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "store"))
    results = ingest.SearchResults(spark, store, str(tmp_path / "results"))
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    calls = []

    def compute(corpus):
        calls.append(1)
        return corpus.agg(F.count("*").alias("n"))

    store.publish(rows, "x")
    assert results.get("search:v1:k", compute).first()["n"] == 2
    assert results.get("search:v1:k", compute).first()["n"] == 2 and len(calls) == 1
    store.publish(rows.withColumn("id", F.col("id") + 10), "y")
    assert results.get("search:v1:k", compute).first()["n"] == 4 and len(calls) == 2


def test_progress_is_counted_once_per_file(spark, small_dir, tmp_path):
    source = str(tmp_path / "in")
    events = views.table(spark, small_dir, "events")
    for part in range(3):
        events.where(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    counts = progress.ProgressCounts(spark, str(tmp_path / "counts"))
    endings = progress.first_endings(views.task_events(stream))
    ingest.start(endings, counts, str(tmp_path / "checkpoint"), available_now=True).awaitTermination()
    expected = finished_files(views.task_events(events))
    got = counts.finished(expected.select("batch_id", "total"))
    columns = ["batch_id", "total", "finished", "complete"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, expected.select(*columns).collect()))
    assert got.where("complete <> (completed_in is not null)").count() == 0


def test_progress_forgets_files_after_the_ttl(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "batch_id string, file string, state string, ts timestamp"
    for i, when in enumerate(["2026-01-01 00:00:00", "2026-01-01 06:00:00", "2026-01-05 00:00:00", "2026-01-05 01:00:00",
                              "2026-01-05 02:00:00"]):
        frame = spark.createDataFrame([("b", "x", "SUCCESS")], "batch_id string, file string, state string")
        frame.withColumn("ts", F.lit(when).cast("timestamp")).coalesce(1).write.parquet(f"{source}/p{i}")
    seen = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option(
        "latestFirst", False).parquet(source)
    endings = progress.first_endings(stream, ttl=progress.TTL)
    ingest.start(endings, lambda df, e: seen.append(df.count()), str(tmp_path / "c"), available_now=True).awaitTermination()
    # The watermark trails by a micro-batch, so the state goes after the fourth report.
    assert [n for n in seen if n] == [1, 1]


def flaky(df):
    return df.withColumn(
        "error_class",
        F.when(F.col("attempt") < F.col("fails"), "transient").when(F.col("broken"), "permanent"),
    )


def test_retries_have_a_budget_and_wait(spark, tmp_path):
    files = spark.createDataFrame(
        [("ok", 0, False), ("twice", 2, False), ("never", 99, False), ("bad", 0, True), ("late", 5, True)],
        "file string, fails int, broken boolean",
    )
    stream = retries.RetryingStream(spark, str(tmp_path), flaky)
    waiting = stream.step(files, 0, fixed_now())
    assert sorted(r["file"] for r in waiting.collect()) == ["late", "never", "twice"]
    # Nothing is due yet one second later, and new files are still processed.
    more = files.where("file = 'ok'").withColumn("file", F.lit("new"))
    waiting = stream.step(more, 1, fixed_now() + F.expr("INTERVAL 1 SECOND"))
    assert waiting.count() == 3 and waiting.agg(F.max("attempt")).first()[0] == 1
    # The same step run again gives the same result.
    waiting = stream.step(more, 1, fixed_now() + F.expr("INTERVAL 1 SECOND"))
    assert waiting.count() == 3
    end = stream.drain(1, fixed_now())
    ended = {r["file"]: (r["outcome"], r["attempt"]) for r in stream.ended(end).collect()}
    assert ended == {
        "ok": ("done", 0), "new": ("done", 0), "twice": ("done", 2), "never": ("exhausted", 5),
        "bad": ("failed", 0), "late": ("failed", 5),
    }


def busy(name, mime, payload):
    tries = Path(payload.split("|")[1]) / name
    tries.mkdir(parents=True, exist_ok=True)
    number = len(list(tries.iterdir()))
    (tries / str(number)).write_text("")
    if number < {"b.txt": 2, "c.txt": 99}.get(name, 0):
        raise records.TransientError("quota")
    return reply(name, mime, payload.split("|")[0])


def test_retried_files_are_merged_in_a_later_step(spark, tmp_path):
    texts = {"a.txt": "Ann,9182468135", "b.txt": "Bob,2015550300", "c.txt": "Cy,2015550400", "d.rtf": "no"}
    rows = [(n, f"{t}|{tmp_path}/tries".encode()) for n, t in texts.items()]
    files = spark.createDataFrame(rows, "file string, content binary")
    store = Snapshots(spark, str(tmp_path / "store"))
    sink = ingest.CandidateIngest(store, "files", fixed_now)
    stream = retries.RetryingStream(spark, str(tmp_path / "steps"), ingest.extraction_attempt(busy))

    def merge_step(step):
        ended = stream.ended_in(step).where("outcome = 'done'")
        answers = ended.select(F.col("file").alias("source_file"), "reply", "error_class", "message")
        writes, dead = ingest.replies_to_writes(answers, HashingEncoder(4), F.lit("b"))
        assert dead.count() == 0
        sink(writes, step)

    stream.step(files, 0, fixed_now())
    merge_step(0)
    assert [r["name"] for r in store.read().collect()] == ["Ann"]
    end = stream.drain(0, fixed_now())
    for step in range(1, end + 1):
        merge_step(step)
    assert sorted(r["name"] for r in store.read().collect()) == ["Ann", "Bob"]
    outcomes = {r["file"]: r["outcome"] for r in stream.ended(end).collect()}
    assert outcomes == {"a.txt": "done", "b.txt": "done", "c.txt": "exhausted", "d.rtf": "failed"}


def test_rows_are_numbered_in_order(spark):
    names = [f"n{i:03d}" for i in range(500)]
    frame = spark.createDataFrame([(n,) for n in reversed(names)], "name string").repartition(7)
    got = number_rows(frame, "name").orderBy("seq").collect()
    assert [(r["name"], r["seq"]) for r in got] == [(n, i) for i, n in enumerate(names)]


def test_temporary_tables_are_deleted(spark):
    kept = materialize(spark.range(3).toDF("n"), "kept")
    with temporary_tables(spark):
        gone = materialize(spark.range(3).toDF("n"), "gone").inputFiles()[0]
        assert exists(spark, gone)
    assert not exists(spark, gone) and kept.count() == 3


def test_materialized_tables_survive_in_the_shared_folder(spark, tmp_path):
    frame = materialize(spark.range(5).toDF("n"), "check")
    assert frame.count() == 5 and "check-" in frame.inputFiles()[0]


SCRIPT = [("ok", 0, False), ("twice", 2, False), ("never", 99, False), ("bad", 0, True), ("late", 5, True)]


def scripted(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame(SCRIPT, "file string, fails int, broken boolean").coalesce(1).write.parquet(source)
    return spark.readStream.schema("file string, fails int, broken boolean").parquet(source)


ENDED = {
    "ok": ("done", 0), "twice": ("done", 2), "never": ("exhausted", 5), "bad": ("failed", 0), "late": ("failed", 5),
}


def test_timed_retries_run_on_an_idle_stream_and_keep_their_delays(spark, tmp_path):
    second = 0.1
    stream = retries.TimedRetries(spark, str(tmp_path / "r"), flaky, second=second)
    ended = stream.run_to_end(scripted(spark, tmp_path), len(SCRIPT), 240)
    assert {r["file"]: (r["outcome"], r["attempt"]) for r in ended.collect()} == ENDED
    tried = {}
    delay = retries.retry_delay(F.col("attempt"), F.col("file"))
    for r in stream.attempts().withColumn("delay", delay).orderBy("file", "attempt").collect():
        tried.setdefault(r["file"], []).append(r)
    for rows in tried.values():
        assert [r["attempt"] for r in rows] == list(range(len(rows)))
        for one, following in zip(rows, rows[1:]):
            assert (following["at"] - one["at"]).total_seconds() >= one["delay"] * second


def test_timed_retries_go_on_after_a_restart(spark, tmp_path):
    files = scripted(spark, tmp_path)
    stream = retries.TimedRetries(spark, str(tmp_path / "r"), flaky, second=0.1)
    query = stream.start(files)
    while not (exists(spark, f"{tmp_path}/r/attempts") and stream._count() >= 2):
        time.sleep(0.1)
    query.stop()
    again = retries.TimedRetries(spark, str(tmp_path / "r"), flaky, second=0.1)
    ended = again.run_to_end(files, len(SCRIPT), 240)
    assert {r["file"]: (r["outcome"], r["attempt"]) for r in ended.collect()} == ENDED
    assert again.attempts().groupBy("file", "attempt").count().where("count > 1").count() == 0


def test_a_batch_is_complete_once(spark, tmp_path):
    progress.rocksdb_state(spark)
    source, schema = str(tmp_path / "in"), "batch_id string, file string, state string"
    steps = [
        [("b", "x", "SUCCESS"), ("b", "x", "FAILURE"), ("c", "u", "STARTED")],
        [("b", "y", "RETRY"), ("b", "x", "SUCCESS"), ("c", "u", "SUCCESS")],
        [("b", "y", "FAILURE"), ("b", None, "SUCCESS"), ("d", "z", "SUCCESS")],
        [("b", "y", "SUCCESS"), ("b", "x", "SUCCESS")],
    ]
    for i, rows in enumerate(steps):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/p{i}")
    totals = spark.createDataFrame([("b", 2), ("c", 3), ("d", 1), ("e", 4)], "batch_id string, total long")

    def run(root):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source)
        rows = progress.ProgressRows(spark, f"{root}/rows")
        sink = progress.completions(stream, totals)
        ingest.run_until_idle(ingest.start(sink, rows, f"{root}/checkpoint", interval="0 seconds", mode="update"), 60)
        return rows

    rows = run(str(tmp_path / "a"))
    assert sorted((r["batch_id"], r["finished"]) for r in rows.rows().collect()) == [("b", 1), ("b", 2), ("c", 1), ("d", 1)]
    assert sorted(r["batch_id"] for r in rows.rows().where("complete").collect()) == ["b", "d"]
    want = [("b", 2, 2, True), ("c", 3, 1, False), ("d", 1, 1, True), ("e", 4, 0, False)]
    assert sorted(map(tuple, rows.finished(totals).drop("completed_in").collect())) == want
    # The same checkpoint with nothing new, and a replayed micro-batch, change nothing.
    rows = run(str(tmp_path / "a"))
    replayed = spark.createDataFrame(rows.rows().where("epoch = 0").drop("epoch").collect(), progress.COMPLETION)
    rows(replayed, 0)
    assert sorted(map(tuple, rows.finished(totals).drop("completed_in").collect())) == want
    assert rows.rows().count() == 4


def test_a_batch_is_forgotten_after_the_ttl(spark, tmp_path):
    progress.rocksdb_state(spark)
    source, schema = str(tmp_path / "in"), "batch_id string, file string, state string"
    totals = spark.createDataFrame([("b", 2)], "batch_id string, total long")
    for i in range(2):
        spark.createDataFrame([("b", "x", "SUCCESS")], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        rows = progress.ProgressRows(spark, str(tmp_path / "rows"))
        sink = progress.completions(stream, totals, ttl_seconds=1.0)
        ingest.run_until_idle(ingest.start(sink, rows, str(tmp_path / "c"), interval="0 seconds", mode="update"), 60)
        time.sleep(1.5)
    assert rows.rows().count() == 2  # with the state still there, the second report would change nothing


def reader(tmp_path, clock, per_minute=3):
    options = {"path": str(tmp_path / "inbox"), "log": str(tmp_path / "log"), "retries": str(tmp_path / "due"), "perMinute": str(per_minute)}
    found = admission.AdmittingReader(options)
    found.clock = lambda: clock[0]
    return found


def names(source, start, end):
    return [row[1:4:2] for part in source.partitions(start, end) for row in source.read(part)]


def test_admission_keeps_to_its_rate_and_offsets_survive_a_restart(tmp_path):
    inbox, due = tmp_path / "inbox", tmp_path / "due"
    inbox.mkdir()
    due.mkdir()
    for i in range(5):
        (inbox / f"f{i}.txt").write_text("x" * i)
    (inbox / "skip.exe").write_text("")
    clock = [1000.0]
    source = reader(tmp_path, clock)
    start = source.initialOffset()
    first = source.latestOffset()
    assert len(names(source, start, first)) == 3
    assert source.latestOffset() == first  # the minute is used up
    clock[0] += 59
    assert reader(tmp_path, clock).latestOffset() == first
    # Retries that are due come before new files, and count.
    (due / "part-0.json").write_text(json.dumps({"path": f"{inbox}/f0.txt", "source_file": "f0.txt", "length": 0, "attempt": 2}) + "\n")
    clock[0] += 2
    again = reader(tmp_path, clock)
    second = again.latestOffset()
    assert sorted(names(again, first, second)) == [("f0.txt", 2), ("f3.txt", 0), ("f4.txt", 0)] or len(names(again, first, second)) == 3
    assert ("f0.txt", 2) in names(again, first, second)
    # The same offsets mean the same files, whoever asks, and a file with an old date is still let in.
    assert names(reader(tmp_path, clock), start, first) == names(source, start, first)
    late = inbox / "a-late.txt"
    late.write_text("late")
    import os

    os.utime(late, (1, 1))
    clock[0] += 61
    third = again.latestOffset()
    assert ("a-late.txt", 0) in names(again, second, third)
    everything = names(again, start, third)
    assert len(everything) == len(set(everything)) == 7
    assert names(again, third, third) == []


def test_admitted_files_are_read_by_path(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    for i in range(4):
        (inbox / f"f{i}.txt").write_text(f"text {i}")
    seen = []

    def sink(rows, epoch):
        seen.extend((r["source_file"], bytes(r["content"])) for r in admission.read_files(rows).collect())

    for _ in range(2):
        stream = admission.admitted_files(spark, str(inbox), str(tmp_path / "log"), per_minute=100)
        ingest.start(stream, sink, str(tmp_path / "c"), available_now=True).awaitTermination()
        (inbox / "g.txt").write_text("later")
    assert sorted(seen) == [(f"f{i}.txt", f"text {i}".encode()) for i in range(4)] + [("g.txt", b"later")]


def test_ingest_by_a_key_index_gives_the_same_rows(spark, small_dir, tmp_path):
    people = views.candidates(spark, small_dir).drop("id").where("seq < 60")
    earlier = views.stored_candidates(spark, small_dir)
    stores = []
    for name in ("plain", "indexed"):
        store = Snapshots(spark, str(tmp_path / name))
        store.publish(earlier, "earlier")
        index = KeyIndex(spark, str(tmp_path / "keys"), buckets=3) if name == "indexed" else None
        sink = ingest.CandidateIngest(store, "s", fixed_now, index=index)
        for epoch, (low, high) in enumerate([(0, 23), (23, 31), (31, 60)]):
            sink(people.where(f"seq >= {low} and seq < {high}"), epoch)
        stores.append((store, sink))
    assert rows_of(stores[0][0].read()) == rows_of(stores[1][0].read())
    ids = [sorted(r["id"] for r in store.read().select("id").collect()) for store, _ in stores]
    assert ids[0] == ids[1]
    told = [sorted(map(tuple, sink.outcomes().select("seq", "strategy", "action").collect())) for _, sink in stores]
    assert told[0] == told[1]
    # Entries of a version that was never published do not count, and the index is read back from its folder.
    store, sink = stores[1]
    again = KeyIndex(spark, str(tmp_path / "keys"))
    assert again.buckets == 3
    version = store.version()
    before = sorted(map(tuple, again.holders(again.rows(version).select("key"), version).select("id", "k", "e").collect()), key=str)
    again.append(merge.keys_of(earlier.withColumn("id", F.col("id") + 1000)), spark.createDataFrame([], "key string"), version + 1)
    after = again.holders(again.rows(version).select("key"), version)
    assert sorted(map(tuple, after.select("id", "k", "e").collect()), key=str) == before
    want = sorted(map(tuple, merge.keys_of(store.read()).where("k is not null or e is not null").select("id", "k", "e").collect()), key=str)
    assert before == want
    plan = after._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[plan.index("Join") : plan.index("SelectedBucketsCount: 3 out of 3")]


def test_standing_hits_equal_a_new_search_after_any_change(spark, tmp_path):
    draw = random.Random(5)
    vector = lambda: [float(draw.choice([-1, 0, 1, 2])) for _ in range(4)]
    queries = spark.createDataFrame([(q, vector()) for q in range(12)], "query_id long, query_vector array<float>")
    corpus = {i: vector() for i in range(40)}
    frame = lambda rows: spark.createDataFrame(sorted(rows.items()), "id long, embedding array<float>")
    standing = StandingSearch(spark, str(tmp_path), queries, 4)
    standing.build(frame(corpus), 1)
    assert standing.has(1) and not standing.has(2)
    searched = []
    for version in range(2, 6):
        changed = {i: vector() for i in draw.sample(range(60), 4)}
        gone = draw.sample(sorted(corpus), 2)
        for i in gone:
            corpus.pop(i)
        changed = {i: v for i, v in changed.items() if i not in gone}
        corpus |= changed
        delta = frame({**changed, **{i: None for i in gone}})
        searched.append(standing.update(frame(corpus), delta, version - 1, version))
        want = block_top_k(frame(corpus), queries, 4).select("query_id", "rank", "id", "similarity")
        assert sorted(map(tuple, standing.hits(version).select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert any(n < 12 for n in searched)


def test_ingest_keeps_standing_searches_up(spark, tmp_path):
    schema = ("seq long, name string, raw_title string, experience_years int, skills array<string>, phone string, "
              "email string, source_file string, batch_id string, embedding array<float>")
    store = Snapshots(spark, str(tmp_path / "store"))
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query_vector array<float>")
    standing = StandingSearch(spark, str(tmp_path / "hits"), queries, 1)
    sink = ingest.CandidateIngest(store, "s", fixed_now, standing=standing)
    sink(spark.createDataFrame([(0, "A", None, 1, ["Other"], "9182468135", None, "a.pdf", "b", [1.0, 1.0])], schema), 0)
    first = standing.hits(store.version()).first()["id"]
    sink(spark.createDataFrame([(0, "B", None, 1, ["Other"], "9182468136", None, "b.pdf", "b", [1.0, 0.1])], schema), 1)
    second = standing.hits(store.version()).first()["id"]
    sink(spark.createDataFrame([(0, "B", None, 1, ["Other"], "9182468136", None, "b.pdf", "b", [-1.0, 0.1])], schema), 2)
    assert first != second and standing.hits(store.version()).first()["id"] == first
