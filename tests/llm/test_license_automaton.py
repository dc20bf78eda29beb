"""The licence scan against plain searches."""

import random
import re
from collections import Counter

import pytest

from rollcall.llm import license_automaton as licences
from rollcall.llm.queries import op13_license_scan

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def places(text, phrases=licences.PHRASES):
    words = split(text)
    found = []
    for phrase, label in phrases:
        want = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(want)] == want]
    return len(words), found


def check(row, text):
    n, found = places(text)
    starts = [at for at, _ in found]
    base = {label for _, label in found}
    assert (row.n_words, row.n_base) == (n, len(found))
    assert (row.first_word, row.last_word) == (min(starts, default=None), max(starts, default=None))
    assert row.base_labels == ",".join(sorted(base))
    assert row.labels == ",".join(sorted(base | {s.label for s in row.spans})) and 0 <= row.score <= 1


def test_query_over_whole_tables(spark):
    sf_dir = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op13_license_scan(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for row in rows:
        check(row, texts[row.doc_id])
    notices = {"mit": "Released under the MIT License.", "cc-by-nc": "Licensed under CC BY-NC 4.0.", "apache": "Licensed under the Apache License, Version 2.0.", "gpl": "under the GNU General Public License, version 3."}
    for row in rows:
        here = {label for label, notice in notices.items() if notice in (texts[row.doc_id] or "")}
        assert here <= set(row.labels.split(",")) and (here or row.labels == "")


ODD = [
    (1, None), (2, ""), (3, "MIT"), (4, "The mit\tLICENSE! mit license-apache license,General  Public...license"),
    (5, "mit licensé mit license0"), (6, "x" * 100_000), (7, "Apache License " * 30_000), (None, "mit license"), (None, None), (4, "MIT License"),
    (8, "general public public license general public general public license"),
]


def test_odd_texts(spark):
    frame = spark.createDataFrame([(i, t, 3, "z") for i, t in ODD], "doc_id long, text string, spans long, labels string").repartition(3)
    rows = licences.scan(frame).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in ODD)
    texts = {i: t for i, t in ODD if i not in (4, None)}
    for row in rows:
        if row.doc_id in texts:
            check(row, texts[row.doc_id])
    assert sorted(r.n_base for r in rows if r.doc_id == 4) == [1, 4]
    assert licences.scan(frame.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_chunks_do_not_change_the_result(monkeypatch, chunk):
    whole = [licences.Scanner(licences.Licences()).scan(t) for _, t in ODD if t is None or len(t) < 50_000]
    monkeypatch.setattr(licences, "CHUNK_BYTES", chunk)
    scanner = licences.Scanner(licences.Licences())
    assert [scanner.scan(t) for _, t in ODD if t is None or len(t) < 50_000] == whole
    text = " ".join(t for _, t in licences.TEMPLATES)
    assert {s[0] for s in scanner.scan(text).spans} == {label for label, _ in licences.TEMPLATES}


def test_matching_statistics_equal_a_plain_search():
    draw = random.Random(3)
    for _ in range(30):
        texts = [[draw.randrange(3) for _ in range(draw.randrange(1, 14))] for _ in range(draw.randrange(1, 5))]
        automaton = licences.Automaton(texts)
        runs = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        for run in runs:
            state = automaton.read(list(run))
            assert automaton.ends[state] == {(k, j - 1) for k, t in enumerate(texts) for i in range(len(t)) for j in range(i + 1, len(t) + 1) if tuple(t[i:j]) == run}
        assert not any(tuple(draw.choices(range(3), k=15)) in runs for _ in range(3))


def test_longest_runs_and_phrases_on_random_words():
    draw = random.Random(8)
    alphabet = ["aa", "bb", "cc", "zz"]
    for _ in range(40):
        templates = tuple((f"t{k}", " ".join(draw.choices(alphabet[:3], k=draw.randrange(3, 9)))) for k in range(3))
        phrases = tuple({" ".join(draw.choices(alphabet[:3], k=draw.randrange(1, 4))): "p" for _ in range(2)}.items())
        scanner = licences.Scanner(licences.Licences(templates, phrases, least=2, share=2.0, many=10**9))
        text = " ".join(draw.choices(alphabet, k=80))
        found = scanner.scan(text)
        words, runs = text.split(), set()
        for _, t in (*templates, *((0, p) for p, _ in phrases)):
            own = t.split()
            runs |= {tuple(own[i:j]) for i in range(len(own)) for j in range(i + 1, len(own) + 1)}
        longest = [max((n for n in range(1, i + 2) if tuple(words[i - n + 1 : i + 1]) in runs), default=0) for i in range(len(words))]
        maximal = [(i, n) for i, n in enumerate(longest) if n >= 2 and (i + 1 == len(words) or longest[i + 1] != n + 1)]
        seen = []
        scanner._chain = lambda matches, _, seen=seen: seen.extend((last, size) for last, size, _ in matches)
        assert scanner.scan(text).n_words == len(words) and seen == maximal
        assert sorted(found.base) == sorted(places(text, phrases)[1])


def test_spans_bridge_small_changes():
    scanner = licences.Scanner(licences.Licences())
    template = dict(enumerate(licences.TEMPLATES))[2][1]
    own = template.replace("free of charge", "at no cost").replace("substantial", "large")
    (span,) = scanner.scan("Some words before. " + own + " And after.").spans
    assert span[0] == "mit" and span[2] == 3 and 0.9 < span[5] < 1
    swapped = template.split()
    assert not scanner.scan(" ".join(reversed(swapped))).spans
    half = " ".join(swapped[:12])
    assert not scanner.scan(half).spans
