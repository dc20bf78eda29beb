"""The set-based merge against a write-by-write replay."""

import random

import pytest
from pyspark.sql import functions as F

from rollcall.operators import merge as m
from rollcall.plans.scratch import materialize

INCOMING = (
    "seq long, name string, raw_title string, experience_years int, skills array<string>, "
    "phone string, email string, source_file string, batch_id string"
)
STORED = (
    "id long, name string, raw_title string, experience_years int, skills array<string>, "
    "phone string, phone_normalized string, email string, source_file string, "
    "batch_id string, created_at timestamp"
)


def now():
    return F.lit("2026-01-01 00:00:00").cast("timestamp")


def key_of(phone, batch, file):
    if phone:
        return ("p", phone)
    if batch and file:
        return ("b", batch, file)
    return None


def replay(stored, incoming):
    """Apply the writes in order; returns ({id: (name, k, e)}, {seq: (strategy, action)})."""
    rows = {r["id"]: (r["name"], key_of(r["phone_normalized"], r["batch_id"], r["source_file"]), r["email"]) for r in stored}
    base = max(rows, default=-1) + 1
    results = {}
    for w in sorted(incoming, key=lambda w: w["seq"]):
        phone, email, batch = w["phone"], w["email"] or None, w["batch_id"] or None
        key = key_of(phone, batch, w["source_file"])
        first = next((i for i, r in rows.items() if key and r[1] == key), None)
        second = next((i for i, r in rows.items() if email and r[2] == email), None)
        named = "phone" if phone else "batch_file" if batch else "plain"
        if first is not None and second is not None and first != second:
            results[w["seq"]] = ("conflict", "reject")
            continue
        target = first if first is not None else second
        if target is None:
            rows[base + w["seq"]] = (w["name"], key, email)
            results[w["seq"]] = (named, "insert")
        else:
            rows[target] = (w["name"], key, email)
            results[w["seq"]] = (named if first is not None else "email", "update")
    return rows, results


def phone(n):
    return None if n is None else f"{2000000000 + 7919 * n}"


def history(seed, n_stored, n_writes, n_phones, n_emails, hot_phone=0.0, hot_email=0.0, first=0):
    rng = random.Random(seed)
    stored, used_p, used_e, used_b = [], set(), set(), set()
    for i in range(n_stored):
        p = rng.choice([None, *range(n_phones)])
        e = rng.choice([None, *range(n_emails)])
        f = rng.randrange(4)
        if (p is not None and p in used_p) or (e is not None and e in used_e):
            continue
        if p is None and f in used_b:
            continue
        used_p.add(p), used_e.add(e)
        if p is None:
            used_b.add(f)
        stored.append(
            dict(id=i, name=f"old{i}", phone=phone(p), phone_normalized=phone(p),
                 email=None if e is None else f"u{e}@x", source_file=f"f{f}", batch_id="b")
        )
    incoming = []
    for s in range(n_writes):
        p = 0 if rng.random() < hot_phone else rng.choice([None, *range(n_phones)])
        e = 0 if rng.random() < hot_email else rng.choice([None, *range(n_emails)])
        incoming.append(
            dict(seq=first + s, name=f"new{seed}-{s}", phone=phone(p),
                 email=rng.choice(["", None]) if e is None else f"u{e}@x",
                 source_file=f"f{rng.randrange(4)}", batch_id=rng.choice(["b", "b", "c", "", None]))
        )
    return stored, incoming


def frames(spark, stored, incoming):
    incoming = [dict(raw_title=None, experience_years=None, skills=["Other"], **w) for w in incoming]
    stored = [dict(raw_title=None, experience_years=None, skills=["Other"], created_at=None, **r) for r in stored]
    return spark.createDataFrame(stored, STORED), spark.createDataFrame(incoming, INCOMING)


def check(spark, stored, incoming, **options):
    want_rows, want_outcomes = replay(stored, incoming)
    old, new = frames(spark, stored, incoming)
    result = m.merge(old, new, now(), **options)
    table = m.next_snapshot(old, result).collect()
    got_rows = {
        r["id"]: (r["name"], key_of(r["phone_normalized"], r["batch_id"], r["source_file"]), r["email"])
        for r in table
    }
    assert len(table) == len(got_rows)
    got_outcomes = {r["seq"]: (r["strategy"], r["action"]) for r in result.outcomes.collect()}
    assert got_outcomes == want_outcomes
    assert got_rows == want_rows
    rejected = {r["seq"] for r in result.rejected.collect()}
    assert rejected == {s for s, o in want_outcomes.items() if o[1] == "reject"}


def many_histories(count, **shape):
    """Independent histories side by side in one merge: every key gets a prefix."""
    stored, incoming, first = [], [], 0
    for seed in range(count):
        s, w = history(seed, first=first, **shape)
        offset = seed * 1000
        for r in s:
            r["id"] += offset
        for r in s + w:
            shift = seed * 100
            for field in ("phone", "phone_normalized"):
                if r.get(field):
                    r[field] = str(int(r[field]) + 7919 * shift)
            if r["email"]:
                r["email"] = f"h{seed}{r['email']}"
            r["source_file"] = f"h{seed}{r['source_file']}"
        stored += s
        incoming += w
        first += len(w)
    return stored, incoming


@pytest.mark.parametrize("block,split", [(1_000_000, 100), (1_000_000, 1), (40, 1)])
def test_random_histories(spark, block, split):
    stored, incoming = many_histories(
        50, n_stored=4, n_writes=11, n_phones=4, n_emails=4
    )
    check(spark, stored, incoming, block_rows=block, split_after=split)


def test_dense_conflicts_take_several_rounds(spark):
    stored, incoming = history(5, n_stored=3, n_writes=90, n_phones=8, n_emails=8)
    check(spark, stored, incoming, split_after=1)


@pytest.mark.parametrize("hot_phone,hot_email", [(0.4, 0.0), (0.0, 0.4), (0.3, 0.3)])
def test_keys_are_scanned_in_blocks(spark, hot_phone, hot_email):
    stored, incoming = history(
        9, n_stored=5, n_writes=200, n_phones=80, n_emails=80,
        hot_phone=hot_phone, hot_email=hot_email,
    )
    check(spark, stored, incoming, block_rows=16)


def write(seq, **fields):
    row = dict(seq=seq, name=f"w{seq}", phone=None, email=None, source_file=f"{seq}.pdf", batch_id="b")
    return {**row, **fields}


def test_same_file_twice_is_one_row(spark):
    check(spark, [], [write(0, source_file="a.pdf"), write(1, source_file="a.pdf")])


def test_shared_phone_keeps_the_later_values(spark):
    old, new = frames(spark, [], [write(0, phone="(918) 246-8135"), write(1, phone="9182468135")])
    table = m.next_snapshot(old, m.merge(old, new, now())).collect()
    assert [(r["name"], r["phone"]) for r in table] == [("w1", "9182468135")]


def test_placeholder_phones_never_merge(spark):
    old, new = frames(spark, [], [write(0, phone="(555) 555-5555"), write(1, phone="555-555-5555")])
    table = m.next_snapshot(old, m.merge(old, new, now())).collect()
    assert sorted(r["phone"] for r in table) == ["(555) 555-5555", "555-555-5555"]
    assert {r["phone_normalized"] for r in table} == {None}


def test_email_only_match_conflict_and_lost_phone(spark):
    p, q = phone(1), phone(2)
    check(
        spark,
        [],
        [
            write(0, phone=p, email="a"),
            write(1, phone=q, email="b"),
            write(2, phone=p, email="b"),  # two different rows: rejected
            write(3, email="a"),  # takes row 0 by email and drops its phone
            write(4, phone=p),  # the phone is free again: a new row
            write(5, email=""),
            write(6, email="", batch_id=""),
            write(7, batch_id=None),
        ],
    )


def test_created_at_and_id_survive_updates(spark):
    stored = [dict(id=7, name="old", phone=phone(1), phone_normalized=phone(1), email="a",
                   source_file="x", batch_id="b")]
    old, new = frames(spark, stored, [write(0, phone=phone(1)), write(1, phone=phone(2))])
    old = old.withColumn("created_at", F.lit("2020-05-05").cast("timestamp"))
    rows = {r["id"]: r for r in m.next_snapshot(old, m.merge(old, new, now())).collect()}
    assert rows[7]["created_at"].year == 2020 and rows[7]["email"] is None
    assert rows[9]["created_at"].year == 2026


def test_applying_a_batch_again_changes_no_row_count(spark):
    _, incoming = history(3, n_stored=0, n_writes=30, n_phones=20, n_emails=20)
    incoming = [dict(w, email=None) for w in incoming if w["batch_id"]]
    old, new = frames(spark, [], incoming)
    table = materialize(m.next_snapshot(old, m.merge(old, new, now())), "once")
    again = m.next_snapshot(table, m.merge(table, new, now()))
    assert sorted(map(tuple, again.drop("created_at").collect()), key=str) == sorted(
        map(tuple, table.drop("created_at").collect()), key=str
    )
