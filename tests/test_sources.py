"""Files, archives, results, snapshots and manifests in temporary folders."""

import json
import random
import sys
import time
import zipfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import functions as F

from rollcall.operators import batches, quality, records, tables
from rollcall.operators.archives import Limits, upload_receipts
from rollcall.operators.encode import HashingEncoder
from rollcall.operators.folder_run import process_folder
from rollcall.operators.quality import assert_unique_phones, duplicate_rows
from rollcall.operators.tables import last_write_wins
from rollcall.plans.scan import position_within
from rollcall.plans.queries import fixed_now
from rollcall.sources import files, json_arrays, manifests, zip_ranges
from rollcall.sources import files as source_files
from rollcall.sources.snapshots import Snapshots
from rollcall.streaming import ingest


register_pickle_by_value(sys.modules[__name__])


def make_zip(path, entries):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, content in entries:
            archive.writestr(name, content)


def test_folder_listing(spark, tmp_path):
    for name in ["b.pdf", "a.PDF", "c.txt", "d.exe", "e.docx", ".hidden.pdf", "no"]:
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "deeper").mkdir()
    (tmp_path / "deeper" / "z.pdf").write_bytes(b"x")
    found = files.list_resumes(spark, str(tmp_path))
    assert [r["source_file"] for r in found.collect()] == ["a.PDF", "b.pdf", "c.txt", "e.docx"]


def test_archives_unpack(spark, tmp_path):
    make_zip(tmp_path / "good.zip", [
        ("one/a.pdf", b"first"), ("__MACOSX/a.pdf", b"no"), ("two/a.pdf", b"second"),
        ("../../../evil.TXT", b"third"), ("empty/", b""), ("notes.md", b"no"),
    ])
    make_zip(tmp_path / "many.zip", [(f"{i}.pdf", b"x") for i in range(9)])
    make_zip(tmp_path / "bomb.zip", [("zeros.txt", b"\0" * 500_000)])
    make_zip(tmp_path / "none.zip", [("a.exe", b"x")])
    (tmp_path / "broken.zip").write_bytes(b"not a zip")
    limits = Limits(files=5, ratio=50)
    archives = files.read_archives(spark, str(tmp_path))
    rows = files.unpack_archives(archives, limits).orderBy("idx").collect()
    assert [(r["idx"], r["member"], r["spool_name"], bytes(r["content"])) for r in rows] == [
        (0, "one/a.pdf", "00000.pdf", b"first"),
        (1, "two/a.pdf", "00001.pdf", b"second"),
        (2, "../../../evil.TXT", "00002.txt", b"third"),
    ]
    assert len({r["batch_id"] for r in rows}) == 1
    members = files.list_members(archives)
    verdicts = {r["archive"].split("/")[-1]: r["rejection"] for r in files.rejected_archives(members, limits).collect()}
    assert verdicts == {
        "many.zip": "too many files", "bomb.zip": "ratio too high",
        "none.zip": "no supported files", "broken.zip": "not a zip file",
    }
    receipt = upload_receipts(files.unpack_archives(archives, limits)).collect()
    assert [(r["queued"], r["files"]) for r in receipt] == [(3, [r["member"] for r in rows])]
    again = files.unpack_archives(files.read_archives(spark, str(tmp_path)), limits)
    assert {r["batch_id"] for r in again.collect()} == {rows[0]["batch_id"]}


def test_an_unreadable_member_does_not_end_the_job(spark, tmp_path):
    path = tmp_path / "half.zip"
    make_zip(path, [("a.txt", b"first part"), ("b.txt", b"second part")])
    whole = path.read_bytes()
    with zipfile.ZipFile(path) as archive:
        start = archive.infolist()[0].header_offset + 30 + len("a.txt")
    path.write_bytes(whole[:start] + b"\xff" * 4 + whole[start + 4 :])
    rows = {r["member"]: r for r in files.unpack_archives(files.read_archives(spark, str(tmp_path))).collect()}
    assert rows["a.txt"]["content"] is None and "unreadable" in rows["a.txt"]["error"]
    assert bytes(rows["b.txt"]["content"]) == b"second part" and rows["b.txt"]["error"] is None


@pytest.mark.parametrize("content", [None, "", "[{\"name\": \"A\"", "{\"name\": \"A\"}", "7", "[]", "  "])
def test_results_that_cannot_be_read_are_empty(spark, tmp_path, content):
    path = tmp_path / "candidates.json"
    if content is not None:
        path.write_text(content)
    assert files.read_results(spark, str(path)).count() == 0


def test_resumable_run(spark, tmp_path):
    path = tmp_path / "candidates.json"
    done = [{"name": "A", "source_file": "001.pdf", "skills": ["Welder"]}, {"name": "B", "source_file": "002.pdf"}]
    path.write_text(json.dumps(done))
    prior = files.read_results(spark, str(path))
    assert [(r["name"], r["skills"]) for r in prior.orderBy("name").collect()] == [("A", ["Welder"]), ("B", None)]
    for n in ("001.pdf", "002.pdf", "003.pdf"):
        (tmp_path / n).write_bytes(b"x")
    listed = files.list_resumes(spark, str(tmp_path))
    assert [r["source_file"] for r in tables.pending(listed, prior).collect()] == ["003.pdf"]
    assert tables.pending_counts(listed, prior).first().asDict() == {"found": 3, "skipped": 2, "pending": 1}
    assert tables.append(prior, prior.limit(1)).count() == 3
    files.write_json_lines(prior, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 2


def test_snapshots(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "store"))
    assert store.read().count() == 0 and store.version() == 0
    first = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    assert store.publish(first, "batch-0")
    assert not store.publish(first, "batch-0")
    change = spark.createDataFrame([(2, "B", True), (3, "c", False)], "id long, name string, is_update boolean")
    assert store.publish(change, "batch-1")
    again = spark.createDataFrame([(2, "BB", True)], "id long, name string, is_update boolean")
    assert store.publish(again, "batch-2")

    def content():
        return sorted((r["id"], r["name"]) for r in store.read().collect())

    assert content() == [(1, "a"), (2, "BB"), (3, "c")]
    # A version without its marker does not count.
    first.write.parquet(str(tmp_path / "store" / "rows" / "99999999-lost"))
    assert content() == [(1, "a"), (2, "BB"), (3, "c")]
    store.compact()
    assert content() == [(1, "a"), (2, "BB"), (3, "c")] and store.version() == 4
    assert store.has_batch("batch-1")


def test_two_writers_cannot_publish_the_same_version(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([(1, "a")], "id long, name string")
    store.publish(rows, "x")
    stale = Snapshots(spark, str(tmp_path / "store"))
    stale.markers = lambda: []
    with pytest.raises(Exception, match="exist"):
        stale.publish(rows, "y")
    assert store.read().count() == 1


def test_manifests(spark, tmp_path):
    path = str(tmp_path / "manifests")
    accepted = spark.createDataFrame(
        [("b1", 0, "a.pdf"), ("b1", 1, "b.pdf"), ("b2", 0, "c.pdf")], "batch_id string, idx long, member string"
    )
    old, new = (F.lit(t).cast("timestamp") for t in ("2026-01-01 00:00:00", "2026-01-02 12:00:00"))
    manifests.save_manifest(batches.dispatch(accepted.where("batch_id = 'b1'"), old), path)
    manifests.save_manifest(batches.dispatch(accepted.where("batch_id = 'b2'"), new), path)
    now = F.lit("2026-01-02 13:00:00").cast("timestamp")
    assert [r["batch_id"] for r in manifests.load_manifest(spark, path, now).collect()] == ["b2"]
    assert manifests.load_manifest(spark, path, now, ttl=48 * 3600).count() == 3

    payload = json.dumps({"batch_id": "j", "files": [{"task_id": "t0", "file": "a"}, {"task_id": "t1", "file": "b"}]})
    texts = spark.createDataFrame([(payload,), ("not json",), (payload[:-1],), (None,)], "payload string")
    parsed = manifests.parse_manifests(texts).orderBy("pos").collect()
    assert [tuple(r) for r in parsed] == [("j", 0, "t0", "a"), ("j", 1, "t1", "b")]


def test_batch_status(spark):
    manifest = spark.createDataFrame(
        [("job", i, t, f"{t}.pdf") for i, t in enumerate("abcd")], "batch_id string, pos long, task_id string, file string"
    )
    reports = spark.createDataFrame(
        [("a", "STARTED", None, 0), ("a", "SUCCESS", None, 1), ("b", "FAILURE", "RuntimeError", 2), ("c", "RETRY", None, 3)],
        "task_id string, state string, error_class string, at int",
    )
    latest = batches.latest_outcomes(reports, "at")
    row = batches.batch_status(manifest, latest).first()
    assert (row["total"], row["done"], row["failed"], row["pending"]) == (4, 1, 1, 2)
    assert row["complete"] is False and row["progress"] == 0.5
    detail = {r["task_id"]: (r["state"], r["status"], r["error"]) for r in batches.file_status(manifest, latest).collect()}
    assert detail == {
        "a": ("SUCCESS", "done", None), "b": ("FAILURE", "failed", "RuntimeError"),
        "c": ("RETRY", "pending", None), "d": ("PENDING", "pending", None),
    }
    finished = batches.batch_status(manifest.where("task_id in ('a', 'b')"), latest).first()
    assert finished["complete"] is True and finished["progress"] == 1.0


def test_finished_files_count_a_repeated_report_once(spark):
    reports = spark.createDataFrame(
        [("b", "x", "SUCCESS"), ("b", "x", "SUCCESS"), ("b", "y", "RETRY"), ("c", "z", "REVOKED")],
        "batch_id string, file string, state string",
    )
    got = {r["batch_id"]: tuple(r)[1:] for r in batches.finished_files(reports).collect()}
    assert got == {"b": (2, 1, False), "c": (1, 1, True)}


def answer(name, mime, payload):
    if name == "slow.pdf":
        raise records.TransientError("quota")
    if name == "bad.pdf":
        raise ValueError("503 in the text changes nothing")
    if name == "odd.txt":
        return "not json"
    if mime is None:
        assert isinstance(payload, str)
        return json.dumps({"name": payload, "raw_title": None, "experience_years": None, "phone": None,
                           "email": None, "skills": []})
    assert isinstance(payload, bytes)
    return json.dumps({"name": mime, "raw_title": "Welder", "experience_years": "4", "phone": "9182468135",
                       "email": None, "skills": ["welder", "x"]})


def test_extraction_never_gives_a_partial_record(spark):
    docs = [("ok.pdf", b"%PDF"), ("note.TXT", "Zoë".encode()), ("slow.pdf", b""), ("bad.pdf", b""),
            ("odd.txt", b"x"), ("list.rtf", b"")]
    frame = spark.createDataFrame(docs, "source_file string, content binary")
    validated = records.validate_replies(records.call_extractor(frame, answer))
    good = {r["source_file"]: r for r in records.records(validated).collect()}
    assert set(good) == {"ok.pdf", "note.TXT"}
    assert good["ok.pdf"]["name"] == "application/pdf" and good["ok.pdf"]["experience_years"] == 4
    assert good["ok.pdf"]["skills"] == ["Welder"] and good["note.TXT"]["name"] == "Zoë"
    assert good["note.TXT"]["skills"] == ["Other"]
    dead = {r["source_file"]: r["error_class"] for r in records.failures(validated).collect()}
    assert dead == {
        "slow.pdf": records.TRANSIENT, "bad.pdf": records.PERMANENT,
        "odd.txt": records.PERMANENT, "list.rtf": records.PERMANENT,
    }
    assert records.public_failures(records.failures(validated)).columns == ["source_file", "error_class"]


def test_folder_run_resumes(spark, tmp_path):
    folder, results, calls = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "calls")
    folder.mkdir()
    Path(calls).mkdir()
    for name in ("a.txt", "b.txt", "busy.txt", "bad.txt", "later.txt"):
        (folder / name).write_text(name)

    def extractor(name, mime, text):
        number = len(list(Path(calls).glob(f"{name}-*")))
        (Path(calls) / f"{name}-{number}").write_text("")
        if name == "bad.txt":
            raise records.PermanentError("unreadable")
        if name == "busy.txt" or (name == "later.txt" and number < 2):
            raise records.TransientError("quota")
        return json.dumps({"name": name, "raw_title": None, "experience_years": None, "phone": None,
                           "email": None, "skills": []})

    waits = []
    failed = process_folder(spark, str(folder), results, extractor, HashingEncoder(4), attempts=4, wait=waits.append)
    assert {r["source_file"]: r["error_class"] for r in failed.collect()} == {
        "bad.txt": records.PERMANENT, "busy.txt": records.TRANSIENT
    }
    assert waits == [3, 4, 6]

    def saved():
        return sorted((r["source_file"], len(r["embedding"])) for r in files.read_json_lines(spark, results).collect())

    assert saved() == [("a.txt", 4), ("b.txt", 4), ("later.txt", 4)]
    (folder / "new.txt").write_text("new")
    process_folder(spark, str(folder), results, extractor, HashingEncoder(4), attempts=1, wait=waits.append)
    assert saved() == [("a.txt", 4), ("b.txt", 4), ("later.txt", 4), ("new.txt", 4)]
    assert len(list(Path(calls).glob("a.txt-*"))) == 1


def test_bulk_load_keeps_the_stale_vector(spark):
    schema = ("id long, name string, raw_title string, experience_years int, skills array<string>, phone string, "
              "phone_normalized string, email string, embedding array<float>, source_file string, batch_id string, "
              "created_at timestamp")
    stored = spark.createDataFrame(
        [(5, "old", None, None, None, "1", "p", "a", [1.0], "x", "b", None)], schema
    )
    incoming = spark.createDataFrame(
        [(0, "first", "a"), (1, "last", "a"), (2, "n1", None), (3, "n2", None), (4, "other", "z"), (5, "newer", "z")],
        "seq long, name string, email string",
    )
    for column in ("raw_title", "phone", "source_file"):
        incoming = incoming.withColumn(column, F.lit(None).cast("string"))
    incoming = incoming.withColumn("experience_years", F.lit(1)).withColumn("skills", F.array(F.lit("Welder")))
    loaded = tables.bulk_load_by_email(stored, incoming, "seq", F.current_timestamp()).orderBy("id").collect()
    assert [(r["id"], r["name"], r["email"]) for r in loaded] == [
        (5, "last", "a"), (8, "n1", None), (9, "n2", None), (10, "newer", "z")
    ]
    assert loaded[0]["embedding"] == [1.0] and loaded[0]["phone_normalized"] == "p" and loaded[0]["phone"] is None


def test_last_write_wins_keeps_rows_without_a_key(spark):
    rows = spark.createDataFrame([(0, "a"), (1, "a"), (2, None), (3, None)], "seq long, k string")
    assert sorted(r["seq"] for r in last_write_wins(rows, F.col("k"), "seq").collect()) == [1, 2, 3]


def test_positions_across_blocks(spark):
    rows = [("hot", i) for i in range(0, 300, 3)] + [("cold", 7), ("cold", 250)]
    frame = spark.createDataFrame(rows, "k string, pos long").repartition(4)
    got = position_within(frame, "k", "pos", "n", width=16).orderBy("pos").collect()
    assert [r["n"] for r in got if r["k"] == "hot"] == list(range(100))
    assert [r["n"] for r in got if r["k"] == "cold"] == [0, 1]


def test_causes_of_a_failed_call_decide_its_class(spark):
    raised = {
        "busy.txt": records.ServiceError("slow down", code=429),
        "down.txt": records.ServiceError("fault", server=True),
        "spent.txt": records.ServiceError("over", status="RESOURCE_EXHAUSTED"),
        "refused.txt": records.ServiceError("no", code=400, status="INVALID_ARGUMENT"),
        "cut.txt": ConnectionError("cut"),
        "odd.txt": KeyError("odd"),
    }

    def answer(name, mime, content):
        if name == "hangs.txt":
            time.sleep(30)
        raise raised[name]

    rows = [(name, b"x") for name in [*raised, "hangs.txt"]] + [("none.pdf", None)]
    frame = spark.createDataFrame(rows, "source_file string, content binary")
    tried = records.call_extractor(frame, answer, seconds=1.5).collect()
    transient = {r["source_file"] for r in tried if r["error_class"] == records.TRANSIENT}
    assert transient == {"busy.txt", "down.txt", "spent.txt", "cut.txt", "hangs.txt"}
    assert {r["error_class"] for r in tried} == {records.TRANSIENT, records.PERMANENT}


@pytest.mark.parametrize("block", [5, 1_000_000])
def test_duplicate_rows_of_a_hot_phone(spark, block):
    rows = [(i, "9182468135" if i % 3 == 0 else f"20100000{i:02d}") for i in range(90)] + [(500, "2010000001")]
    frame = spark.createDataFrame(rows, "id long, phone string")
    got = {(r["key"], r["n"], r["id"]) for r in duplicate_rows(frame, block).collect()}
    expected = {("9182468135", 30, i) for i in range(0, 90, 3)} | {("2010000001", 2, 1), ("2010000001", 2, 500)}
    assert got == expected
    with pytest.raises(ValueError, match="2 phone"):
        assert_unique_phones(frame)
    assert_unique_phones(frame.where("id in (1, 2)"))


# --- archives by byte ranges and JSON arrays in blocks -----------------------------------


def test_members_are_read_at_their_offsets(spark, tmp_path):
    texts = {f"cv/{i}.txt": f"text {i} " * (i * 50 + 1) for i in range(20)} | {"__MACOSX/x.txt": "no", "y.exe": "no", "empty.txt": ""}
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in texts.items():
            archive.writestr(name, text, zipfile.ZIP_STORED if name.endswith("3.txt") else zipfile.ZIP_DEFLATED)
    with zipfile.ZipFile(tmp_path / "none.ZIP", "w"):
        pass
    (tmp_path / "broken.zip").write_bytes(b"no zip at all")
    with zipfile.ZipFile(tmp_path / "many.zip", "w") as archive:
        for i in range(30):
            archive.writestr(f"{i}.txt", "x")
    damaged = bytearray((tmp_path / "a.zip").read_bytes())
    with zipfile.ZipFile(tmp_path / "a.zip") as archive:
        at = archive.getinfo("cv/7.txt").header_offset
    damaged[at + 45] ^= 0xFF
    (tmp_path / "damaged.zip").write_bytes(bytes(damaged))

    limits = Limits(files=25, ratio=1e9)
    rows = zip_ranges.unpack_by_range(spark, str(tmp_path), limits).collect()
    own = {r["member"]: r for r in rows if r["archive"].endswith("/a.zip")}
    assert {m: bytes(r["content"]).decode() for m, r in own.items()} == {m: t for m, t in texts.items() if m.startswith("cv/") or m == "empty.txt"}
    assert [r["spool_name"] for r in sorted(own.values(), key=lambda r: r["idx"])] == [f"{i:05d}.txt" for i in range(21)]
    hurt = {r["member"]: r for r in rows if r["archive"].endswith("/damaged.zip")}
    assert hurt["cv/7.txt"]["error"] and hurt["cv/7.txt"]["content"] is None
    assert all(r["error"] is None and bytes(r["content"]).decode() == texts[m] for m, r in hurt.items() if m != "cv/7.txt")
    assert {r["archive"].rsplit("/", 1)[1] for r in rows} == {"a.zip", "damaged.zip"}
    listed = zip_ranges.directories(zip_ranges.archive_paths(spark, str(tmp_path))).where("member is null").collect()
    assert {(r["archive"].rsplit("/", 1)[1], r["pos"]) for r in listed} == {("none.ZIP", -1), ("broken.zip", None)}


def test_a_member_never_expands_beyond_its_stated_size(tmp_path):
    path = tmp_path / "bomb.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("a.txt", b"0" * 10_000_000)
    with open(path, "rb") as file, zipfile.ZipFile(path) as archive:
        entry = archive.infolist()[0]
        assert len(zip_ranges.read_member(file, entry.header_offset, entry.compress_type, entry.compress_size, entry.file_size, entry.CRC)) == 10_000_000
        with pytest.raises(ValueError, match="directory"):
            zip_ranges.read_member(file, entry.header_offset, entry.compress_type, entry.compress_size, 100, entry.CRC)


def test_scanner_states_compose():
    draw = random.Random(7)
    for _ in range(300):
        text = "".join(draw.choice(['"', "\\", "[", "]", "{", "}", ",", "a", "é"]) for _ in range(draw.randrange(1, 40))).encode()
        data = np.frombuffer(text, np.uint8)
        state, depth, want = 0, 0, []
        for byte in text:  # one byte at a time
            plain = False
            if state == 2:
                state = 1
            elif byte == 34:
                state = 0 if state == 1 else 1
            elif state == 1:
                state = 2 if byte == 92 else 1
            else:
                plain = True
                depth += (byte in b"[{") - (byte in b"]}")
            want.append((plain, depth))
        if any(p and b == 92 for (p, _), b in zip(want, text)):
            continue  # a backslash outside of strings is no JSON
        cut = draw.randrange(len(text) + 1)
        plain, level, middle = json_arrays.scan(data[:cut], json_arrays.OUTSIDE)
        after = json_arrays.scan(data[cut:], middle)
        base = int(level[-1]) if cut else 0
        got = [*zip(plain.tolist(), level.tolist()), *zip(after[0].tolist(), (base + after[1]).tolist())]
        assert got == want and after[2] == state


@pytest.mark.parametrize("block_bytes", [1, 3, 17, 1000])
def test_arrays_in_blocks_equal_whole_reads(spark, tmp_path, block_bytes):
    def record(i):
        return {"name": f'N "{i}" [{{,\\', "raw_title": "é]" * (i % 5), "experience_years": i, "skills": ["a,b", "]"], "phone": None, "email": f"e{i}@x.org",
                "source_file": f"{i}.pdf", "batch_id": "b\\"}

    texts = {
        "many.json": json.dumps([record(i) for i in range(25)], indent=1), "one.json": json.dumps([record(1)]), "none.json": " [ ] ", "empty.json": "",
        "nulls.json": "[null, " + json.dumps(record(2)) + "]", "object.json": json.dumps(record(3)), "cut.json": json.dumps([record(4), record(5)])[:-9],
        "open.json": "[" + json.dumps(record(6)), "trail.json": "[" + json.dumps(record(7)) + ",]", "after.json": json.dumps([record(8)]) + " x",
        "twice.json": json.dumps([record(9)]) + json.dumps([record(10)]), "words.json": "no json", "wrong.json": '[{"name": "a"}, {"name": }]',
    }
    if block_bytes < 17:
        texts["many.json"] = json.dumps([record(i) for i in range(2)])
    want, got = [], []
    for name, text in texts.items():
        folder = tmp_path / name.split(".")[0]
        folder.mkdir()
        (folder / name).write_text(text)
        want.append((name, sorted(map(str, source_files.read_results(spark, str(folder)).collect()))))
    for folder in ("many", "nulls", "cut", "wrong"):
        rows = json_arrays.read_array(spark, str(tmp_path / folder), block_bytes=block_bytes).collect()
        assert sorted(map(str, rows)) == dict(want)[f"{folder}.json"], folder
    whole = str(tmp_path / "all")
    (tmp_path / "all").mkdir()
    for name, text in texts.items():
        (tmp_path / "all" / name).write_text(text)
    rows = json_arrays.read_array(spark, whole, block_bytes=block_bytes).collect()
    assert sorted(map(str, rows)) == sorted(r for _, found in want for r in found)
    assert json_arrays.read_array(spark, str(tmp_path / "missing")).count() == 0
    assert len(want) == len(texts) and got == []


def test_a_large_array_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "big.json").write_text("[" + ",\n".join(f'{{"name": "n{i}", "experience_years": {i}}}' for i in range(200_000)) + "]")
    rows = json_arrays.read_array(spark, str(tmp_path), block_bytes=1 << 18)
    blocks = json_arrays._blocks(spark, str(tmp_path), 1 << 18).count()
    assert blocks > 20 and rows.count() == 200_000
    assert rows.agg(F.sum("experience_years"), F.count_distinct("name")).first()[0:2] == (sum(range(200_000)), 200_000)


def test_results_are_loaded_in_one_call_and_only_changes_are_written(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "store"))
    first = [{"name": "A", "email": "a@x.org", "skills": ["x"]}, {"name": "B", "email": "b@x.org"}, {"name": "C", "email": ""}, {"name": "A2", "email": "a@x.org"}]
    (tmp_path / "one.json").write_text(json.dumps(first))
    assert ingest.load_results(store, str(tmp_path / "one.json"), "one", fixed_now())
    assert sorted((r["name"], r["email"] or "") for r in store.read().collect()) == [("A2", "a@x.org"), ("B", "b@x.org"), ("C", "")]
    assert not ingest.load_results(store, str(tmp_path / "one.json"), "one", fixed_now())
    (tmp_path / "two.json").write_text(json.dumps([{"name": "B", "email": "b@x.org"}, {"name": "A3", "email": "a@x.org"}, {"name": "D", "email": "d@x.org"}]))
    ingest.load_results(store, str(tmp_path / "two.json"), "two", fixed_now())
    written = spark.read.parquet(f"{tmp_path}/store/{store.markers()[-1]['folder']}")
    assert sorted(r["name"] for r in written.collect()) == ["A3", "D"]
    assert sorted(r["name"] for r in store.read().collect()) == ["A3", "B", "C", "D"]
    ids = [r["id"] for r in store.read().collect()]
    assert len(set(ids)) == len(ids)


def test_the_gate_refuses_a_shared_phone_key(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([(1, "9182468135"), (2, "9182468135"), (3, None), (4, None)], "id long, phone_normalized string")
    with pytest.raises(ValueError, match="more than one row"):
        store.publish(rows, "bad", gate=quality.assert_unique_keys)
    assert store.version() == 0 and store.read().count() == 0
    assert store.publish(rows.where("id <> 2"), "good", gate=quality.assert_unique_keys) and store.read().count() == 3


def test_blocks_of_small_arrays_are_dealt_over_many_tasks(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"{i}.json").write_text(json.dumps([{"name": f"n{i}"}]))
    blocks, tasks = json_arrays._blocks(spark, str(tmp_path), 1 << 20)
    assert tasks == 5 and blocks.count() == 40
    assert blocks.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert json_arrays.read_array(spark, str(tmp_path)).count() == 40
