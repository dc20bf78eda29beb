"""Column functions, case by case."""

import hashlib
import json

import pytest
from values import column_values
from pyspark.sql import functions as F

from rollcall.functions import files, outcomes, phones, scores, skills
from rollcall.operators import records
from rollcall.operators.archives import Limits, check_limits


def one(spark, schema, values, expression):
    return column_values(spark, schema, [(v,) for v in values], expression)


def test_phone_keys(spark):
    written = ["(303) 861-4479", "303 861 4479", "303/861/4479", "+49 303 861 4479", "tel 3038614479 "]
    unusable = [
        None, "", "\t", "861-4479", "99", "none", "(222) 222-2222", "+7 333 333 3333", "(303) 555-0123",
        "1 303 555 0177", "4444444444",
    ]
    usable = {"(303) 555-0203": "3035550203", "303-555-0098": "3035550098", "(303) 556-0150": "3035560150"}
    key = phones.normalize_phone(F.col("p"))
    assert set(one(spark, "p string", written, key)) == {"3038614479"}
    assert set(one(spark, "p string", unusable, key)) == {None}
    assert one(spark, "p string", list(usable), key) == list(usable.values())
    # The last ten digits count, and a repeated digit counts only within them.
    assert one(spark, "p string", ["0033 1 2345 67890", "6666666666642"], key) == ["1234567890", "6666666642"]


def test_phone_pattern_agrees_with_the_placeholder_test(spark):
    numbers = [f"{a}{e}{n:04d}" for a in ("555", "777", "918") for e in ("555", "777") for n in
               (0, 99, 100, 150, 199, 200, 5555, 7777)]
    key = phones.normalize_phone(F.col("p"))
    expected = F.when(~phones.is_placeholder(F.col("p")), F.col("p"))
    assert one(spark, "p string", numbers, key) == one(spark, "p string", numbers, expected)


def test_mask(spark):
    assert one(spark, "p string", ["9182468135"], phones.mask_phone(F.col("p"))) == ["...8135"]


@pytest.mark.parametrize(
    "given,expected",
    [
        (["electrician", "WELDER"], ["Electrician", "Welder"]),
        (["Bell Founding"], ["Other"]),
        (["Plumber", "plumber", "Welder"], ["Plumber", "Welder"]),
        (["Welder", "Nonsense", "Fitter"], ["Welder", "Fitter"]),
        (None, ["Other"]),
        ([], ["Other"]),
        (["", "  ", None], ["Other"]),
        (["\t Welder  \n", "\u00a0Fitter\u3000"], ["Welder", "Fitter"]),
        (skills.TAXONOMY, skills.TAXONOMY),
    ],
)
def test_skills(spark, given, expected):
    got = one(spark, "s array<string>", [given], skills.normalize_skills(F.col("s")))
    assert got == [expected]


def test_taxonomy_size():
    assert len(skills.TAXONOMY) == 23 and skills.TAXONOMY[-1] == skills.FALLBACK_SKILL


def test_embedding_text(spark):
    text = skills.embedding_text(F.col("t"), F.col("y"), F.col("s"))
    rows = [("Welder", 6, ["Welder"]), ("Welder", 6, None), ("Welder", 0, []), (None, None, None),
            ("Cook", 2, ["A", "B"])]
    assert column_values(spark, "t string, y int, s array<string>", rows, text) == [
        "Title: Welder. Experience: 6 years. Skills: Welder.",
        "Title: Welder. Experience: 6 years. Skills: None.",
        "Title: Welder. Experience: 0 years. Skills: None.",
        "Title: None. Experience: None years. Skills: None.",
        "Title: Cook. Experience: 2 years. Skills: A, B.",
    ]


def test_calibration(spark):
    s = F.col("s")
    values = [0.80, 0.55, 0.25, 0.6199, -1.0, 2.0]
    assert one(spark, "s double", values, scores.confidence_tier(s)) == [
        "High Match", "Moderate Match", "Low Match", "Moderate Match", "Low Match", "High Match"
    ]
    assert one(spark, "s double", values, scores.match_score(s)) == [100.0, 58.3, 8.3, 70.0, 0.0, 100.0]
    grid = [i / 50 - 1 for i in range(151)]
    shown = one(spark, "s double", grid, scores.match_score(s))
    assert shown == sorted(shown) and 0 <= shown[0] and shown[-1] <= 100


def test_cosine(spark):
    cosine = scores.cosine_similarity(F.col("a"), F.col("b"))
    rows = [([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [0.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]),
            ([1.0, 2.0], [-1.0, -2.0]), (None, [1.0, 0.0])]
    got = column_values(spark, "a array<float>, b array<float>", rows, cosine)
    assert got == [1.0, 0.0, None, pytest.approx(-1.0), None]
    distance = scores.cosine_distance(F.col("a"), F.col("b"))
    assert column_values(spark, "a array<float>, b array<float>", rows[:2], distance) == [0.0, 1.0]


def test_archive_entries(spark):
    kept = ["cv/one.pdf", "two.DOCX", "deep/er/three.txt", "scan.png", "photo.Jpg", "photo.jpeg"]
    dropped = ["__MACOSX/one.pdf", "cv/.hidden.pdf", "cv/", "run.sh", "table.csv", "", ".txt"]
    usable = files.is_candidate_entry(F.col("n"))
    assert one(spark, "n string", kept, usable) == [True] * len(kept)
    assert one(spark, "n string", dropped, usable) == [False] * len(dropped)


def test_spool_names_are_never_cut(spark):
    rows = [(7, "a.PDF"), (99_999, "a.pdf"), (123_456, "a.pdf"), (123_457, "a.pdf"), (None, "a.pdf")]
    got = column_values(spark, "k long, n string", rows, files.spool_name(F.col("k"), F.col("n")))
    assert got == ["00007.pdf", "99999.pdf", "123456.pdf", "123457.pdf", None]


def test_suffix_and_routes(spark):
    names = ["a.PDF", ".pdf", "cv/b.tar.Txt", "noext", "c.rtf", "x/d.jpeg", "dir.d/file"]
    assert one(spark, "n string", names, files.suffix(F.col("n"))) == [
        ".pdf", "", ".txt", "", ".rtf", ".jpeg", ""
    ]
    assert one(spark, "n string", names, files.route(F.col("n"))) == [
        "binary", "unsupported", "text", "unsupported", "unsupported", "binary", "unsupported"
    ]
    assert one(spark, "n string", ["a.pdf", "a.txt"], files.mime_type(F.col("n"))) == [
        "application/pdf", None
    ]
    names = ["../../../evil.PDF", "one/a.pdf"]
    assert one(spark, "n string", names, files.spool_name(F.lit(3), F.col("n"))) == ["00003.pdf"] * 2


def test_decode_replaces_invalid_bytes(spark):
    got = one(spark, "b binary", [bytearray(b"ok \xff!"), bytearray("é".encode())], files.decode_text(F.col("b")))
    assert got == ["ok �!", "é"]


def test_cache_key(spark):
    rows = [("welder", 10), ("welder", 5), ("welder1", 0), ("welder", 10)]
    got = column_values(spark, "q string, n int", rows, files.cache_key(F.col("q"), F.col("n")))
    assert got[0] == got[3] and len(set(got)) == 3
    assert got[0] == "search:v1:" + hashlib.sha256(b"welder\x0010").hexdigest()


def test_states(spark):
    states = ["PENDING", "RECEIVED", "STARTED", "RETRY", "NEW", None, "SUCCESS", "FAILURE", "REVOKED"]
    assert one(spark, "s string", states, outcomes.task_status(F.col("s"))) == (
        ["pending"] * 6 + ["done", "failed", "failed"]
    )
    assert one(spark, "s string", states, outcomes.is_terminal(F.col("s"))) == [False] * 6 + [True] * 3


def test_progress(spark):
    rows = [(2, 4), (2, 2), (0, 0), (1, 3)]
    shown = outcomes.progress(F.col("f"), F.col("t"))
    assert column_values(spark, "f long, t long", rows, shown) == [0.5, 1.0, 0.0, 0.333]
    done = outcomes.is_complete(F.col("f"), F.col("t"))
    assert column_values(spark, "f long, t long", rows, done) == [False, True, False, False]


def test_error_kinds(spark):
    rows = [
        ("network", None, None), ("server", 500, None), ("api", 429, None), ("api", 503, None),
        ("api", 400, "UNAVAILABLE"), ("api", 400, None), ("api", 401, None), ("api", 404, "NOT_FOUND"),
        ("other", 503, "INTERNAL"), ("api", None, None),
    ]
    kind = outcomes.error_kind(F.col("k"), F.col("c"), F.col("s"))
    assert column_values(spark, "k string, c int, s string", rows, kind) == (
        ["transient"] * 5 + ["permanent"] * 5
    )


def test_retry_delays(spark):
    rows = [(n, f"f{i}") for n in range(13) for i in range(20)]
    delay = outcomes.retry_delay(F.col("n"), F.col("f"))
    got = column_values(spark, "n int, f string", rows, delay)
    for (n, _), seconds in zip(rows, got):
        base = min(2**n + 2, 600)
        assert int(base * 0.8) <= seconds <= base * 1.2 and seconds > 0
    assert len(set(got[-20:])) > 5
    assert got == column_values(spark, "n int, f string", rows, delay)
    uncapped = column_values(spark, "n int, f string", [(n, "x") for n in range(7)], outcomes.batch_delay(F.col("n")))
    assert uncapped == [3, 4, 6, 10, 18, None, None]


def reply(**changes):
    body = dict(name=None, raw_title=None, experience_years=None, phone=None, email=None, skills=[])
    body.update(changes)
    return json.dumps({k: v for k, v in body.items() if v != "drop"})


def test_replies(spark):
    valid = {
        reply(): (None, None, ["Other"]),
        reply(name="A", experience_years=7, skills=["welder"]): ("A", 7, ["Welder"]),
        reply(experience_years="7"): (None, 7, ["Other"]),
        reply(experience_years=7.0): (None, 7, ["Other"]),
        reply(experience_years=True): (None, 1, ["Other"]),
        reply(extra=1): (None, None, ["Other"]),
        f"\n {reply(experience_years=-1)} \n": (None, -1, ["Other"]),
    }
    broken = [
        "not json at all", "", "[]", "null", None, reply(skills="drop"), reply(phone="drop"), reply(skills=None),
        reply(skills=[1]), reply(skills=["a", None]), reply(skills=[None]), reply(skills="Welder"),
        reply(experience_years=7.5), reply(experience_years="many"), reply(name=5), reply()[:-1],
        reply() + " and more", reply() + reply(), f"{reply()},{reply()}", f"[{reply()}]", "7", "{}",
    ]

    def parsed(replies):
        frame = spark.createDataFrame(list(enumerate(replies)), "i int, reply string")
        return [r["record"] for r in records.parse_replies(frame).orderBy("i").collect()]

    got = parsed(valid)
    assert [(r["name"], r["experience_years"], r["skills"]) for r in got] == list(valid.values())
    assert parsed(broken) == [None] * len(broken)


def test_vector_text(spark):
    back = files.text_to_vector(files.vector_to_text(F.col("v")))
    assert one(spark, "v array<float>", [[0.5, -1.25]], back) == [[0.5, -1.25]]


def test_archive_limits(spark):
    def verdict(entries, **limits):
        rows = [("z", i, f"{i}.pdf", size, packed) for i, (size, packed) in enumerate(entries)]
        rows.append(("z", 99, "readme.md", 10**9, 1))
        frame = spark.createDataFrame(
            rows, "archive string, pos long, member string, file_size long, compress_size long"
        )
        row = check_limits(frame, Limits(**limits)).first()
        return row["rejection"], row["member"]

    assert verdict([]) == ("no supported files", None)
    assert verdict([(1, 1)] * 5, files=3) == ("too many files", None)
    assert verdict([(1, 1)] * 3, files=3) == (None, None)
    assert verdict([(60, 60)] * 3, total_bytes=100) == ("too large in total", None)
    assert verdict([(50, 50)] * 2, total_bytes=100, file_bytes=50) == (None, None)
    assert verdict([(1, 1), (200, 200)], file_bytes=50) == ("file too large", "1.pdf")
    assert verdict([(5_000_000, 5000)], ratio=10) == ("ratio too high", "0.pdf")
    assert verdict([(1000, 100)], ratio=10) == (None, None)
    assert verdict([(0, 0)]) == (None, None)
    assert verdict([(90, 1), (60, 60)], file_bytes=50, ratio=10) == ("file too large", "0.pdf")
    assert verdict([(40, 1), (60, 60)], file_bytes=50, ratio=10) == ("ratio too high", "0.pdf")
